"""Review of stored observations: samples against their calibration, queue records against their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import finite
from .quality import first_reason

#: Names of the issues.
SOURCE, UNITS, POINTS = "calibration.source_binding", "calibration.units", "calibration.pixel_points"
MISSING, BOUNDS, ENERGY, K = "calibration.missing_sample", "calibration.pixel_bounds", "calibration.energy_mismatch", "calibration.k_mismatch"
UNUSABLE = "calibration.unavailable_or_invalid"
#: Parts that a queued record may be meant for, and the head of its id.
SPLITS, ID_HEAD = ("train", "validation", "evaluation"), "mcp-audit-"


def calibrated_samples(observations: DataFrame, bands: DataFrame, calibrations: DataFrame) -> DataFrame:
    """FLT26: the first issue of each observation that names a calibration; null if its samples agree with it.

    ``observations``: ``obs_id, calibration_id, attachment_id, source_sha256, energy_unit, k_unit,
    k_distance`` (array). ``bands``: ``obs_id, band`` (its place), ``energies`` (array, null where
    missing), ``pixel_points`` (array of [x, y]). ``calibrations``: ``calibration_id, attachment_id,
    source_sha256, energy_unit, k_unit, width, height`` and ``slope, intercept, tolerance`` with
    ``e_`` (of y) and ``k_`` (of x). Binding and units come first; then bands in their order, and in a
    band its samples in theirs: of a sample the first rule that it breaks, of an observation the
    least place. Samples are exploded, so no observation is one task's.
    """
    line = [f"{a}_{p}" for a in "ek" for p in ("slope", "intercept", "tolerance")]
    cal = calibrations.select("calibration_id", *[F.col(c).alias(f"c_{c}") for c in ("attachment_id", "source_sha256", "energy_unit", "k_unit")], "width", "height", *line, F.lit(True).alias("there"))
    usable = F.lit(True)
    for c in (*line, "width", "height"):
        usable = usable & F.col(c).isNotNull()
    same = lambda c: F.col(c).eqNullSafe(F.col(f"c_{c}"))
    held = observations.filter("calibration_id is not null").join(cal, "calibration_id", "left")
    held = held.withColumn("bound", first_reason(
        (F.col("there").isNull(), UNUSABLE), (~same("attachment_id") | ~same("source_sha256"), SOURCE), (~same("energy_unit") | ~same("k_unit"), UNITS), (~usable, UNUSABLE),
    ))
    rows = held.filter("bound is null").select("obs_id", "k_distance", "width", "height", *line).join(bands, "obs_id")
    ragged = F.col("pixel_points").isNull() | (F.size("pixel_points") != F.size(F.coalesce("energies", F.array().cast("array<double>"))))
    whole = rows.filter(ragged).select("obs_id", "band", F.lit(-1).alias("pos"), F.lit(POINTS).alias("issue"))
    each = rows.filter(~ragged).select("obs_id", "band", "k_distance", "width", "height", *line, F.posexplode(F.arrays_zip(F.col("energies").alias("energy"), F.col("pixel_points").alias("point"))).alias("pos", "s"))
    energy, point = F.col("s.energy"), F.col("s.point")
    x, y = F.get(point, F.lit(0)), F.get(point, F.lit(1))
    inside = (F.size(point) == 2) & finite(x) & finite(y) & (x >= 0) & (x < F.col("width")) & (y >= 0) & (y < F.col("height"))
    k = F.get("k_distance", F.col("pos"))
    issue = F.when(energy.isNull(), F.when(point.isNotNull(), MISSING)).otherwise(first_reason(
        (~F.coalesce(inside, F.lit(False)), BOUNDS), (F.abs(F.col("e_slope") * y + F.col("e_intercept") - energy) > F.col("e_tolerance"), ENERGY),
        (k.isNull(), UNUSABLE), (F.abs(F.col("k_slope") * x + F.col("k_intercept") - k) > F.col("k_tolerance"), K),
    ))
    broken = whole.unionByName(each.select("obs_id", "band", "pos", issue.alias("issue")).filter("issue is not null"))
    first = broken.groupBy("obs_id").agg(F.min(F.struct("band", "pos", "issue")).alias("at"))
    return held.select("obs_id", "bound").join(first, "obs_id", "left").select("obs_id", F.coalesce("bound", "at.issue").alias("issue"), "at.band", "at.pos")


def queue_records(records: DataFrame) -> DataFrame:
    """JN24: the first thing wrong with each record of the pending queue, null if nothing is.

    ``records``: ``record_id, schema_version, intended_split, observations`` (canonical JSON text),
    ``observation_sha256, source`` (JSON text), ``independent_human_review,
    operator_authentication, ai_prefilled``. The digest is worked out from the content, the id must
    be made of it, and the record's source must be the content's own.
    """
    digest = F.sha2("observations", 256)
    own = F.get_json_object("observations", "$.source")
    problem = first_reason(
        (F.coalesce(F.col("schema_version") != 1, F.lit(True)), "invalid pending review record"), (~F.coalesce(F.col("intended_split").isin(*SPLITS), F.lit(False)), "invalid pending review split"),
        (F.get_json_object("observations", "$").isNull(), "missing pending observations"), (~F.col("observation_sha256").eqNullSafe(digest), "pending observation SHA mismatch"),
        (~F.col("record_id").eqNullSafe(F.concat(F.lit(ID_HEAD), F.substring(digest, 1, 20))), "pending record ID mismatch"), (~F.col("source").eqNullSafe(own), "pending source binding mismatch"),
        (F.col("independent_human_review").isNotNull(), "pending queue cannot contain human approval"), (F.col("operator_authentication").isNotNull(), "pending queue cannot contain operator authentication"),
        (~F.coalesce(F.col("ai_prefilled"), F.lit(False)), "pending queue must identify AI-prefilled records"),
    )
    return records.select("record_id", problem.alias("problem"))
