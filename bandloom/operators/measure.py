"""Measurements of curves, meshes and pairs of predicted and true energies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bands import band_ranges, sign_crossings


def exact_mean(value: Column | str, by: list[str] | None = None) -> Column:
    """Mean of doubles that does not hang on the order of rows: over the groups of ``by`` as a window, else as an aggregate.

    Values go into the sum as decimals of eight places, so a mean that is a whole number is one. If
    some can't (not finite, 1e20 or more), it is the plain mean.
    """
    v = F.col(value) if isinstance(value, str) else value
    part = (lambda c: c.over(Window.partitionBy(*by))) if by else (lambda c: c)
    exact = v.try_cast("decimal(28,8)")
    n = part(F.count(v))
    return F.when(part(F.count(exact)) == n, part(F.sum(exact)).cast("double") / n).otherwise(part(F.avg(v)))


def extrema_gap(points: DataFrame, conduction: Column) -> DataFrame:
    """AG5: least conduction energy minus largest valence energy of each path; may be negative."""
    return points.groupBy("path_id").agg((F.min(F.when(conduction, F.col("energy"))) - F.max(F.when(~conduction, F.col("energy")))).alias("gap"))


def measure_lines(points: DataFrame, least: int = 3, tie: float = 1e-8) -> DataFrame:
    """AG7: status, crossings, edges, gap and degenerate extrema of each path.

    Refused with missing samples or fewer than ``least``; unknown where one side of the level is
    empty and nothing crosses it. Extrema within ``tie`` count as degenerate.
    """
    crossings = sign_crossings(points).groupBy("path_id").agg(F.count("*").alias("crossings"))
    low, high = F.col("energy") <= 0, F.col("energy") >= 0
    w = Window.partitionBy("path_id")
    rows = points.withColumn("vbm", F.max(F.when(low, F.col("energy"))).over(w)).withColumn("cbm", F.min(F.when(high, F.col("energy"))).over(w))
    per = rows.groupBy("path_id").agg(
        F.max("vbm").alias("vbm"), F.max("cbm").alias("cbm"), F.count("*").alias("n"), F.count("energy").alias("seen"),
        F.count_if(F.abs(F.col("energy") - F.col("vbm")) <= tie).alias("top_ties"), F.count_if(F.abs(F.col("energy") - F.col("cbm")) <= tie).alias("bottom_ties"),
    )
    got = per.join(crossings, "path_id", "left").withColumn("crossings", F.coalesce("crossings", F.lit(0)))
    crossed, both = F.col("crossings") > 0, F.col("vbm").isNotNull() & F.col("cbm").isNotNull()
    status = F.when((F.col("seen") < F.col("n")) | (F.col("n") < least), "refused").when(crossed | both, "ok").otherwise("unknown")
    gap = F.when(crossed, F.lit(0.0)).otherwise(F.col("cbm") - F.col("vbm"))
    return got.select("path_id", status.alias("status"), "crossings", "vbm", "cbm", gap.alias("gap"), "top_ties", "bottom_ties")


def measure_meshes(mesh: DataFrame, slack: float = 1e-5, full: float = 0.99, empty: float = 0.01) -> DataFrame:
    """AG8: electrons by weight, edges, gap (at least 0), direct gap (least over k) and partial occupations.

    A mesh whose weights don't sum to 1 is refused.
    """
    on, off = F.col("occupancy") >= full, F.col("occupancy") <= empty
    top, bottom = F.max(F.when(on, F.col("energy"))), F.min(F.when(off, F.col("energy")))
    direct = mesh.groupBy("mesh_id", "k_idx").agg((bottom - top).alias("d")).groupBy("mesh_id").agg(F.min("d").alias("direct"))
    whole = mesh.groupBy("mesh_id").agg(F.sum(F.col("weight") * F.col("occupancy")).alias("electrons"), top.alias("vbm"), bottom.alias("cbm"), F.count_if(~on & ~off).alias("partial"), F.sum("weight").alias("weight"))
    gap = F.when(F.col("vbm").isNotNull() & F.col("cbm").isNotNull(), F.greatest(F.lit(0.0), F.col("cbm") - F.col("vbm")))
    status = F.when(F.abs(F.col("weight") - 1) <= slack, "ok").otherwise("refused")
    return whole.join(direct, "mesh_id").select("mesh_id", "electrons", "vbm", "cbm", gap.alias("gap"), F.when(F.col("direct").isNotNull(), F.greatest(F.lit(0.0), "direct")).alias("direct_gap"), "partial", status.alias("status"))


def observation_counts(points: DataFrame) -> DataFrame:
    """AG9: observed and missing samples, complete and partial bands of each path."""
    bands = points.groupBy("path_id", "band_id").agg(F.count("*").alias("n"), F.count("energy").alias("seen"))
    whole = F.col("n") == F.col("seen")
    return bands.groupBy("path_id").agg(F.sum("seen").alias("observed"), F.sum(F.col("n") - F.col("seen")).alias("missing"), F.count_if(whole).alias("complete_bands"), F.count_if(~whole).alias("partial_bands"))


def band_mae(pairs: DataFrame, by: list[str]) -> DataFrame:
    """AG21: mean absolute error of predicted energies; pairs with a null side don't count."""
    return pairs.groupBy(*by).agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"), F.count(F.col("pred") - F.col("target")).alias("n"))


def gap_summary(gaps: DataFrame, tiny: float = 1e-6) -> DataFrame:
    """AG23: populations by true gap, coverage, mean errors, and the share of metals with a predicted gap."""
    known = F.col("target").isNotNull() & F.col("pred").isNotNull()
    off = F.abs(F.col("pred") - F.col("target"))
    return gaps.agg(
        F.count("*").alias("n"), F.count_if(F.col("target") > 0).alias("insulators"), F.count_if(F.col("target") == 0).alias("metals"), F.count_if(F.col("target").isNull()).alias("unknown"),
        F.count_if(known).alias("resolved"), F.avg(off).alias("gap_mae"), F.avg(F.when(F.col("target") > 0, off)).alias("insulator_mae"),
        F.avg(F.when((F.col("target") == 0) & known, (F.col("pred") > tiny).cast("double"))).alias("false_gap_rate"),
    )


def path_diagnostics(points: DataFrame) -> DataFrame:
    """AG24: per segment the order inversions and least separation of neighbouring bands, dispersion and frontier state."""
    under = F.lag("energy").over(Window.partitionBy("path_id", "k_idx").orderBy("band_id"))
    rows = points.withColumn("under", under)
    first = rows.groupBy("path_id", "segment_id").agg(
        F.count_if(F.col("energy") < F.col("under")).alias("inversions"), F.min(F.abs(F.col("energy") - F.col("under"))).alias("min_separation"),
        F.count_if(F.col("energy") <= 0).alias("occupied"), F.count_if(F.col("energy") > 0).alias("empty"),
    )
    spread = points.groupBy("path_id", "segment_id", "band_id").agg(F.var_pop("energy").alias("v")).groupBy("path_id", "segment_id").agg(F.sqrt(F.avg("v")).alias("dispersion"))
    state = F.when((F.col("occupied") > 0) & (F.col("empty") > 0), "both").when(F.col("occupied") > 0, "valence only").otherwise("conduction only")
    return first.join(spread, ["path_id", "segment_id"]).withColumn("frontier", state)


def window_audit(points: DataFrame, capacity: int) -> DataFrame:
    """AG26: candidates, dropped bands, branch taken and quotas left unfilled when bands are chosen near the level."""
    low, high = F.col("high") <= 0, F.col("low") >= 0
    half = capacity // 2
    count = lambda c: F.count_if(c)
    return band_ranges(points).groupBy("path_id").agg(
        F.count("*").alias("candidates"), F.greatest(F.lit(0), F.count("*") - capacity).alias("dropped"), count(low).alias("valence"), count(high).alias("conduction"),
        F.when(count(~low & ~high) > 0, "window").otherwise("split").alias("branch"),
        F.greatest(F.lit(0), half - count(low)).alias("valence_underfill"), F.greatest(F.lit(0), capacity - half - count(high)).alias("conduction_underfill"),
    )


def coverage(rows: DataFrame, reason: Column) -> DataFrame:
    """AG27: rows and share of each status; a null reason means eligible. The denominator is all rows."""
    counts = rows.groupBy(F.coalesce(reason, F.lit("eligible")).alias("status")).agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1))))


def proximity(left: DataFrame, right: DataFrame, by: list[str], radius: float) -> DataFrame:
    """JN17: pairs of points of a group within ``radius``: grid cells of that size, the right side sent to its 27 neighbours."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = left.select(*by, *[F.col(c).alias(f"{c}1") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    b = right.select(*by, *[F.col(c).alias(f"{c}2") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    for c in "xyz":
        b = b.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))
    square = sum((F.pow(F.col(f"{c}1") - F.col(f"{c}2"), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    return a.join(b, [*by, "cx", "cy", "cz"]).withColumn("distance", F.sqrt(square)).filter(F.col("distance") <= radius).drop("cx", "cy", "cz")


def mass_proxy(curvature: Column, tiny: float = 1e-9) -> Column:
    """FN13: inverse of the curvature's size; infinite where the curve is flat."""
    return F.when(F.abs(curvature) < tiny, F.lit(float("inf"))).otherwise(1 / F.abs(curvature))


def channel_stats(rows: DataFrame, channel: str, value: str, floor: float = 1e-6) -> DataFrame:
    """AG37: mean and population deviation (at least ``floor``) of each channel, of the given rows only."""
    return rows.groupBy(channel).agg(F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("std"), F.count("*").alias("n"))


def normalise(rows: DataFrame, stats: DataFrame, channel: str, value: str) -> DataFrame:
    """FN4: values in units of frozen statistics; a channel without a positive deviation is refused (no rows)."""
    return rows.join(stats.filter("std > 0").select(channel, "mean", "std"), channel).withColumn("value", (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def strain_warp(points: DataFrame, seed: str, low: float, high: float) -> DataFrame:
    """FN14: stretch each path's axis about its middle by a factor drawn by hash, and interpolate linearly at the old places."""
    part = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("path_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    ends = points.groupBy("path_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).withColumn("f", low + part * (high - low))
    mid = (F.col("lo") + F.col("hi")) / 2
    asked = points.join(ends, "path_id").select("path_id", "band_id", "k_idx", F.least("hi", F.greatest("lo", mid + (F.col("k") - mid) / F.col("f"))).alias("k"), F.lit(None).cast("double").alias("energy"), F.lit(1).alias("kind"))
    known = points.select("path_id", "band_id", "k_idx", "k", "energy", F.lit(0).alias("kind"))
    o = Window.partitionBy("path_id", "band_id").orderBy("k", "kind")
    at = F.when(F.col("kind") == 0, F.struct("k", "energy"))
    both = known.unionByName(asked).withColumn("before", F.last(at, True).over(o.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(at, True).over(o.rowsBetween(0, Window.unboundedFollowing)))
    a, b = F.coalesce("before", "after"), F.coalesce("after", "before")
    blend = F.when(b["k"] > a["k"], (F.col("k") - a["k"]) / (b["k"] - a["k"])).otherwise(0.0)
    return both.filter("kind = 1").select("path_id", "band_id", "k_idx", (a["energy"] + blend * (b["energy"] - a["energy"])).alias("value"))
