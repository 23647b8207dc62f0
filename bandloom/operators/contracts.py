"""Contracts of source records, structures, claims, observations, graphs and traced figures, as rule tables of columns.

A rule is ``(condition, status, reason)`` or ``(condition, reason)``; conditions that can't be told count as not met.
"""

from __future__ import annotations

import json
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ELEMENTS
from .geometry import cross, dot
from .quality import all_reasons, first_reason

#: Fixed value: the largest number of 32 bits.
FLOAT32 = 3.4028234663852886e38
#: Names of importers and of their schemas, and layouts of energies.
SCHEMAS = {"aflow": "aflow_bandsdata_v1", "mp": "mp_pymatgen_v1"}
LAYOUTS = ("bands_k", "spin_major_flat", "spin_band_k")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(xs: Column) -> Column:
    return F.forall(xs, finite)


def steps(xs: Column) -> Column:
    """Differences of neighbours."""
    n = F.greatest(F.size(xs) - 1, F.lit(0))
    return F.zip_with(F.slice(xs, 2, n), F.slice(xs, 1, n), lambda b, a: b - a)


def unknown(value: Column) -> Column:
    """Null, blank, or a word for unknown."""
    return value.isNull() | F.lower(F.trim(value)).isin("", "unknown", "null", "none", "n/a")


def source_quality(rows: DataFrame, quarantine: dict[str, str] | None = None) -> DataFrame:
    """FLT4: ``status`` and ``reasons`` of each imported record: the first broken rule makes it invalid, any open question ambiguous.

    ``rows`` has ``source, source_schema, band_layout, source_semantics_evidence, energy_reference``
    (strings), ``spin_channels, n_bands, n_kpoints`` (integers as declared; ``num_bands`` and
    ``num_kpoints`` too where there are such columns), ``energies`` (arrays of k
    samples, the spins one after the other), ``spin_axis`` (the length of an explicit spin axis, null
    without one), ``k_distances``, ``kpoints`` (arrays), ``efermi, source_efermi_absolute``,
    ``content_sha256``, and ``metadata``, a map of the same names to text that must not contradict.
    Finite, consistent data with a declared importer, layout and spin is ``verified_valid``.
    """
    c, k, e = F.col, F.col("k_distances"), F.col("energies")
    length = F.size(F.get(e, F.lit(0)))
    flat = F.flatten(e)
    told = ("source", "energy_reference", "source_schema", "band_layout", "source_semantics_evidence", "spin_channels", "n_bands", "n_kpoints", "num_bands", "num_kpoints", "efermi", "source_efermi_absolute")
    told = [name for name in told if name in rows.columns]
    nested = lambda name: F.try_element_at(c("metadata"), F.lit(name))
    differs = F.lit(False)
    for name in told:
        numeric = name.startswith(("spin_", "n_", "num_")) or "efermi" in name
        same = nested(name).try_cast("double") == c(name).cast("double") if numeric else nested(name) == c(name)
        differs = differs | (nested(name).isNotNull() & c(name).isNotNull() & ~F.coalesce(same, F.lit(False)))
    blocks = F.coalesce(c("spin_axis"), F.lit(1))
    channels, layout = c("spin_channels"), c("band_layout")
    step = steps(k)
    reached = F.element_at(k, -1).cast("float") > F.get(k, F.lit(0)).cast("float")
    bad_spin = ((layout == "bands_k") & ((channels != 1) | c("spin_axis").isNotNull())) | (
        (layout == "spin_major_flat") & ((channels == 1) | c("spin_axis").isNotNull() | (F.size(e) % channels != 0))
    ) | ((layout == "spin_band_k") & (c("spin_axis").isNull() | (c("spin_axis") != channels)))
    held = quarantine or {}
    why = F.coalesce(*[F.when((c("source") == "aflow") & (c("content_sha256") == d), F.lit(r)) for d, r in held.items()], F.lit(None).cast("string"))
    sizes = [("n_bands", F.size(e) / blocks), ("num_bands", F.size(e) / blocks), ("n_kpoints", length), ("num_kpoints", length)]
    hard = first_reason(
        (differs, "conflicting_source_metadata"),
        (e.isNull() | (F.size(e) == 0) | (length < 2) | ~F.forall(e, lambda b: F.size(b) == length) | (F.size(e) % blocks != 0), "band data unavailable: invalid_energy_shape"),
        (~F.forall(flat, lambda x: finite(x) & (F.abs(x) <= FLOAT32)), "nonfinite_energy_or_float32_overflow"),
        *[(c(name) != size, f"declared_{name}_mismatch_or_illegal") for name, size in sizes if name in rows.columns],
        (k.isNull() | (F.size(k) != length) | ~F.forall(k, lambda x: finite(x) & (x >= 0) & (x <= FLOAT32)) | F.exists(step, lambda d: d < 0) | ~F.exists(step, lambda d: d > 0), "invalid_k_distances"),
        (~reached, "invalid_k_distances: float32 storage loses positive span"),
        (c("kpoints").isNotNull() & ((F.size("kpoints") != length) | ~F.forall("kpoints", lambda p: F.size(p).isin(1, 3) & F.forall(p, lambda x: finite(x) & (F.abs(x) <= FLOAT32)))), "invalid_kpoints"),
        (~finite(c("efermi")), "invalid_efermi"),
        (c("source_efermi_absolute").isNotNull() & ~finite(c("source_efermi_absolute")), "invalid_source_efermi"),
        ((c("source") == "aflow") & (c("efermi") != 0), "invalid_aflow_energy_reference"),
        ((c("energy_reference") == "fermi_shifted_zero") & (c("efermi") != 0), "inconsistent_energy_reference"),
    )
    hard = F.coalesce(hard, why, first_reason((channels < 1, "invalid_spin_channels"), (bad_spin, "inconsistent_spin_layout")))
    known = F.lit(False)
    for name, schema in SCHEMAS.items():
        known = known | ((c("source") == name) & (c("source_schema") == schema))
    soft = all_reasons(
        (~F.coalesce(known, F.lit(False)), "unknown_schema"), (~F.coalesce(layout.isin(*LAYOUTS), F.lit(False)), "unknown_layout"),
        (~F.coalesce(channels.isin(1, 2), F.lit(False)), "unknown_spin"), (F.coalesce(c("source_semantics_evidence"), F.lit("")) == "", "missing_semantics_evidence"),
    )
    status = F.when(c("hard").isNotNull(), "invalid").when(F.size("soft") > 0, "ambiguous").otherwise("verified_valid")
    return rows.withColumns({"hard": hard, "soft": soft}).withColumns({"status": status, "reasons": F.when(c("hard").isNotNull(), F.array("hard")).otherwise(F.col("soft"))}).drop("hard", "soft")


def vectors_of(lattice: Column) -> list[tuple[Column, Column, Column]]:
    return [tuple(F.get(F.get(lattice, F.lit(i)), F.lit(j)) for j in range(3)) for i in range(3)]


def good_lattice(lattice: Column) -> Column:
    """Whether a 3 x 3 lattice is finite, right-handed and not flat."""
    a, b, c = vectors_of(lattice)
    volume = dot(a, cross(b, c))
    sides = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) * F.sqrt(dot(c, c))
    shape = (F.size(lattice) == 3) & F.forall(lattice, lambda v: (F.size(v) == 3) & all_finite(v))
    return F.coalesce(shape & (sides > 0) & (volume > 0) & (volume / sides > 1e-10), F.lit(False))


def dual_lattice(lattice: Column, reciprocal: Column, close: float = 1e-7) -> Column:
    """Whether the rows of two lattices are dual: their products are 2 pi on the diagonal and 0 elsewhere."""
    from math import tau

    ok = F.lit(True)
    for i, a in enumerate(vectors_of(lattice)):
        for j, g in enumerate(vectors_of(reciprocal)):
            want = tau if i == j else 0.0
            ok = ok & (F.abs(dot(a, g) - want) <= close + close * want)
    return F.coalesce(ok, F.lit(False))


def good_species(species: Column) -> Column:
    return F.coalesce((F.size(species) > 0) & F.forall(species, lambda s: s.isin(*ELEMENTS)), F.lit(False))


def good_conventions(c: Column) -> Column:
    """Whether units, row vectors, fractional coordinates of the direct lattice and the cell's setting are declared."""
    ok = c["lattice_units"].isin("angstrom", "bohr") & (c["lattice_vectors"] == "rows") & (c["coordinates"] == "fractional") & (c["coordinate_basis"] == "direct_lattice") & (F.trim(c["cell_setting"]) != "")
    return F.coalesce(ok, F.lit(False))


def good_structure(r) -> Column:
    """Whether a structure is whole: ``r(name)`` gives the columns of ``structure_audit``."""
    coords = F.coalesce((F.size(r("fractional_coordinates")) > 0) & F.forall(r("fractional_coordinates"), lambda p: (F.size(p) == 3) & all_finite(p)), F.lit(False))
    same = (F.size(r("species_per_atom")) == F.size(r("fractional_coordinates"))) & (F.array_sort(F.array_distinct(r("species_per_atom"))) == F.array_sort(F.array_distinct(r("species"))))
    return good_lattice(r("lattice")) & coords & good_species(r("species")) & good_species(r("species_per_atom")) & F.coalesce(same, F.lit(False)) & good_conventions(r("structure_conventions"))


#: The version that binds atoms and basis, and the older one that doesn't.
V2, V1 = "structure-v2", "legacy-v1"


def _structure_digest(rows: pd.DataFrame) -> pd.Series:
    """SHA-256 of the structure as JSON with sorted keys, full precision, its atoms in order and its conventions."""

    def plain(x):
        x = x.tolist() if hasattr(x, "tolist") else x.asDict() if hasattr(x, "asDict") else x
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x

    def one(row: dict) -> str:
        told = {"version": V2} | {k: plain(v) for k, v in row.items()}
        return sha256(json.dumps(told, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":")).encode()).hexdigest()

    # Rows that aren't whole are not asked for, but may pass through.
    return pd.Series([one(r) if r["lattice"] is not None else None for r in rows.to_dict("records")])


def structure_hash(rows: DataFrame) -> Column:
    """KEY12: digest of a whole structure, v2; null for one that isn't whole."""
    parts = ("lattice", "species", "species_per_atom", "fractional_coordinates", "structure_conventions")
    whole = good_structure(F.col)
    filled = F.struct(*[F.when(whole, F.col(p)).alias(p) for p in parts])
    return F.when(whole, F.pandas_udf(_structure_digest, "string")(filled))


def verify_structure_hash(claim: Column, version: Column, v2: Column, v1: Column) -> Column:
    """KEY12: whether a claimed digest holds under the version that it names; another version, or a claim that is no digest, never does."""
    shape = claim.rlike("^[0-9a-f]{64}$")
    return F.coalesce(shape & F.when(version == V2, claim == v2).when(version == V1, claim == v1), F.lit(False))


#: The fields of a structure record that are audited, and those that make a basic structure.
FIELDS = (
    "material_id", "source", "aurl", "lattice", "species", "species_per_atom", "fractional_coordinates", "structure_conventions",
    "structure_basis_evidence", "reciprocal_lattice", "reciprocal_convention", "structure_sha256", "spin_cell", "spin_atom",
    "magnetic_moments", "spin_polarized", "soc", "dft_functional", "dft_type", "hubbard_u", "pseudopotential",
    "pseudopotential_version", "code", "protocol_evidence", "kpath_segments", "kpath_convention", "kpoints_3d", "kpoints_dense",
    "kpoint_basis_evidence",
)
BASIC = ("lattice", "species", "species_per_atom", "fractional_coordinates")
TEXTS = ("material_id", "source", "aurl", "dft_functional", "code", "kpath_convention")
LISTS = ("dft_type", "pseudopotential", "pseudopotential_version", "kpath_segments")


def structure_audit(rows: DataFrame) -> DataFrame:
    """FLT7: status and reason of every field of a structure record, of its basic structure, and of the record.

    Adds ``field_quality`` (a map from ``FIELDS`` to status and reason), ``missing_fields``,
    ``basic_structure_status`` and ``status``. A field that is missing is ambiguous, never false; a
    number that is right proves no source. Of several rules that a field breaks the last one counts.
    ``rows`` has ``FIELDS`` (evidence and ``kpoints_dense`` as text; ``hubbard_u`` a struct of ``enabled,
    species, values_eV, formulation``; ``kpoints_3d`` a struct with ``segments`` of ``start, end``), and
    ``auid, read_error, field_read_errors, field_invalid_errors`` (maps), ``merge_conflicts`` (array),
    ``input_hash_valid``, ``structure_hash_version`` and ``legacy_sha256``, the older digest recomputed.
    """
    r, kinds, given = F.col, dict(rows.dtypes), rows.columns
    atoms = F.size("fractional_coordinates")
    coords = (atoms > 0) & F.forall("fractional_coordinates", lambda p: (F.size(p) == 3) & all_finite(p))
    lack = {f: unknown(r(f)) if kinds[f] == "string" else r(f).isNull() | (F.size(f) == 0) if kinds[f].startswith("array") else r(f).isNull() for f in FIELDS}
    # What several rules ask for is a column of its own, worked out once.
    told_once = {"__lattice": good_lattice(r("lattice")), "__species": good_species(r("species")), "__atoms": good_species(r("species_per_atom")), "__coords": F.coalesce(coords, F.lit(False)), "__conventions": good_conventions(r("structure_conventions"))}
    told_once |= {"__dual": good_lattice(r("reciprocal_lattice")) & dual_lattice(r("lattice"), r("reciprocal_lattice")), "__digest": structure_hash(rows)} | {f"__no_{f}": x for f, x in lack.items()}
    rows, lack = rows.withColumns(told_once), {f: r(f"__no_{f}") for f in FIELDS}
    rules: dict[str, list[tuple[Column, str, str]]] = {f: [] for f in FIELDS}
    bad = "invalid_shape_value_or_convention"
    good = {"lattice": r("__lattice"), "species": r("__species"), "species_per_atom": r("__atoms"), "fractional_coordinates": r("__coords")}
    for f, ok in good.items():
        rules[f] += [(ok, "valid", "numerically_valid"), (~ok, "invalid", bad)]
    rules["structure_conventions"] += [(r("__conventions"), "valid", "explicit_convention"), (~r("__conventions"), "invalid", bad)]
    same = (F.size("species_per_atom") == atoms) & (F.array_sort(F.array_distinct("species_per_atom")) == F.array_sort(F.array_distinct("species")))
    rules["species_per_atom"].append((good["species"] & good["species_per_atom"] & good["fractional_coordinates"] & ~same, "invalid", "atom_count_or_composition_mismatch"))
    rules["spin_cell"].append((~finite(r("spin_cell")), "invalid", "nonfinite_or_wrong_moment_shape"))
    for f in ("spin_atom", "magnetic_moments"):
        # One number a moment, or three; a single one for several atoms is a summary.
        rules[f] += [(~F.size(f).isin(1) & ~(F.size(f) == atoms) & ~(F.size(f) == 3 * atoms) | ~all_finite(r(f)), "invalid", "nonfinite_or_wrong_moment_shape"), (all_finite(r(f)) & (F.size(f) == 1) & (atoms > 1), "ambiguous", "scalar_summary_not_per_atom_moments")]
    dual = r("__dual") & good["lattice"]
    rules["reciprocal_lattice"] += [(dual, "valid", "derived_duality_not_independent_source_check"), (~dual, "invalid", "invalid_reciprocal_or_direct_duality")]
    rules["reciprocal_convention"].append((r("reciprocal_convention") != "rows_2pi_inverse_transpose", "invalid", "unsupported_reciprocal_convention"))
    own = F.concat(F.lit("aflow-"), F.regexp_extract("auid", "^aflow:([0-9a-f]{16})$", 1))
    rules["material_id"].append((r("auid").isNotNull() & ~((own != "aflow-") & (own == F.coalesce("material_id", F.lit("")))), "invalid", "invalid_AUID_or_material_id_mismatch"))
    for f in LISTS:
        rules[f].append((F.exists(f, unknown), "invalid", "nonempty_string_list_required"))
    for f in ("pseudopotential", "pseudopotential_version"):
        rules[f].append((good["species"] & ~F.exists(f, unknown) & (F.size(f) != F.size(F.array_distinct("species"))), "invalid", "pseudopotential_species_cardinality_mismatch"))
    u = r("hubbard_u")
    on, values = F.coalesce(u["enabled"], F.lit(False)), F.coalesce((F.size(u["values_eV"]) > 0) & all_finite(u["values_eV"]), F.lit(False))
    rules["hubbard_u"] += [
        (u["enabled"].isNull(), "ambiguous", "explicit_enabled_and_per_species_protocol_required"), (on & ~values, "invalid", "invalid_U_values"),
        (on & values & ~F.coalesce((F.size(u["species"]) == F.size(u["values_eV"])) & ~unknown(u["formulation"]), F.lit(False)), "ambiguous", "U_species_or_formulation_unknown"),
    ]
    for f in ("structure_basis_evidence", "protocol_evidence", "kpoint_basis_evidence", "kpoints_dense"):
        rules[f].append((F.lit(True), "ambiguous", "external_evidence_not_reverified"))
    path = r("kpoints_3d")["segments"]
    ends = F.coalesce((F.size(path) > 0) & F.forall(path, lambda s: (F.size(s["start"]) == 3) & (F.size(s["end"]) == 3) & all_finite(s["start"]) & all_finite(s["end"]) & (s["start"] != s["end"])), F.lit(False))
    rules["kpoints_3d"] += [(ends, "valid", "endpoints_only_not_dense_alignment"), (~ends, "invalid", "invalid_segment_endpoints")]
    rules["kpath_segments"].append((ends & ~F.exists("kpath_segments", unknown) & (F.size("kpath_segments") != F.size(path)), "invalid", "segment_count_differs_from_endpoints"))
    version = F.coalesce("structure_hash_version", F.lit(V1))
    holds = verify_structure_hash(r("structure_sha256"), version, r("__digest"), r("legacy_sha256"))
    rules["structure_sha256"] += [
        (~holds, "invalid", "digest_mismatch_or_invalid_structure"), (holds & (version == V1), "ambiguous", "legacy_digest_omits_atoms_and_basis"),
        (holds & (version == V2), "valid", "v2_content_digest_matches_not_source_certification"),
    ]
    quality = {}
    for f in FIELDS:
        mark = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
        told = F.coalesce(*[F.when(cond, mark(status, reason)) for cond, status, reason in reversed(rules[f])], mark("valid", "present"))
        told = F.when(lack[f], mark("ambiguous", "missing_or_unknown")).otherwise(told)
        if f == "structure_sha256":
            told = F.when(~F.coalesce("input_hash_valid", F.lit(True)), mark("invalid", "upstream_input_digest_mismatch")).otherwise(told)
        broken, unread = (F.try_element_at(r(m), F.lit(f)) for m in ("field_invalid_errors", "field_read_errors"))
        told = F.when(broken.isNotNull(), mark("invalid", broken)).otherwise(told)
        told = F.when(lack[f] & unread.isNotNull(), mark("read_error", unread)).otherwise(told)
        quality[f] = F.when(r("read_error").isNotNull(), mark("read_error", r("read_error"))).otherwise(told)
    found = rows.withColumn("field_quality", F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*quality.values())))
    missing = F.when(r("read_error").isNotNull(), F.array(*map(F.lit, FIELDS))).otherwise(all_reasons(*[(lack[f], f) for f in FIELDS]))
    # The worst of some fields: a read error, then invalid, then ambiguous.
    of = lambda fields: F.transform(F.array(*map(F.lit, fields)), lambda f: F.element_at("field_quality", f)["status"])
    worst = lambda s: F.when(F.array_contains(s, "invalid"), "invalid").when(F.array_contains(s, "read_error"), "read_error").when(F.array_contains(s, "ambiguous"), "ambiguous").otherwise("valid")
    record = F.when(r("read_error").isNotNull(), "read_error").when(F.size("merge_conflicts") > 0, "invalid").otherwise(worst(of(FIELDS)))
    return found.withColumns({"missing_fields": missing, "basic_structure_status": worst(of(BASIC)), "status": record}).select(*given, "field_quality", "missing_fields", "basic_structure_status", "status")


#: What a claim may be about, rest on and come from; kinds of documents.
CLAIM_KINDS = ("host_composition", "tested_dopants", "crystal_structure", "lattice_parameters", "experimental_synthesis", "cited_synthesis", "property")
BASES, ORIGINS = ("reported", "inferred", "not_reported"), ("current_paper", "cited_work", "author_data")
DOCUMENT_KINDS = ("computational", "experimental", "mixed", "review")


def claim_review(reports: DataFrame) -> DataFrame:
    """FLT23: adds ``status`` and ``issues`` to reports of ``document_kind`` and ``claims``.

    A claim is a struct of ``kind, value, basis, reason, evidence``, and evidence an array of structs
    ``document_id, page_number, excerpt, origin``. Issues are named ``claims[i].what``. A report of an
    unknown kind, or without 1 to 128 claims, is refused; one without issues is valid but not verified.
    """
    allowed = lambda x, names: F.coalesce(x.isin(*names), F.lit(False))
    size = lambda x, lo, hi: F.coalesce(F.length(x).between(lo, hi), F.lit(False))

    def issues(claim: Column, i: Column) -> Column:
        known = allowed(claim["kind"], CLAIM_KINDS) & allowed(claim["basis"], BASES)
        said = claim["basis"] != "not_reported"
        whole = F.coalesce(F.size(claim["evidence"]).between(1, 16), F.lit(False))

        def of(item: Column) -> Column:
            source = size(item["document_id"], 1, 512) & F.coalesce(item["page_number"] >= 1, F.lit(False)) & size(item["excerpt"], 1, 2000) & allowed(item["origin"], ORIGINS)
            cited = (claim["kind"] == "cited_synthesis") & ~F.coalesce(item["origin"] == "cited_work", F.lit(False)) & item["origin"].isNotNull()
            return all_reasons((~source, "source"), (cited, "cited_origin"))

        each = F.when(known & said & whole, F.flatten(F.transform(claim["evidence"], of))).otherwise(F.array().cast("array<string>"))
        recipe = known & said & whole & (claim["kind"] == "experimental_synthesis") & (claim["basis"] == "reported") & (F.col("document_kind") == "computational")
        found = F.concat(
            all_reasons((~known, "kind_or_basis"), (known & ~said & claim["value"].isNotNull(), "not_reported_value"), (known & (claim["basis"] == "inferred") & ~size(F.trim(claim["reason"]), 1, 1 << 30), "inference_reason"), (known & said & ~whole, "evidence")),
            each, all_reasons((recipe, "computational_paper_is_not_an_experimental_sop")),
        )
        return F.transform(found, lambda x: F.concat(F.lit("claims["), i.cast("string"), F.lit("]."), x))

    refused = F.when(~allowed(F.col("document_kind"), DOCUMENT_KINDS), "document_kind").when(~F.coalesce(F.size("claims").between(1, 128), F.lit(False)), "claims")
    listed = F.when(refused.isNotNull(), F.array(refused)).otherwise(F.flatten(F.transform("claims", issues)))
    status = F.when(refused.isNotNull(), "refused").when(F.size("issues") > 0, "needs_more_evidence").otherwise("evidence_contract_valid_unverified")
    return reports.withColumn("issues", listed).withColumn("status", status)


def observation_review(rows: DataFrame) -> DataFrame:
    """FLT24: adds ``invalid_fields`` and ``missing_evidence`` to observations of sampled curves.

    ``rows`` has ``schema_version``, ``source`` (struct ``document_id, page_number, panel_label,
    source_sha256``), ``energy_unit``, ``energy_reference`` (struct ``kind, value_eV, observed, evidence``),
    ``fermi_eV``, ``k_unit``, ``k_distance``, ``segment_ids``, ``bands`` (array of structs ``band_id, role,
    energies``), ``calibration_evidence`` and ``path_segments`` (array of structs ``segment_id,
    start_label, end_label``). A segment is left once; k grows inside it; a missing sample is null.
    """
    c, k, s, bands, ref, src = F.col, F.col("k_distance"), F.col("segment_ids"), F.col("bands"), F.col("energy_reference"), F.col("source")
    text = lambda x, most: F.coalesce((F.trim(x) != "") & (F.length(x) <= most), F.lit(False))
    ok = lambda x: F.coalesce(x, F.lit(False))
    n = F.size(k)
    whole = ok(n.between(2, 8192) & all_finite(k))
    matched = ok(whole & (F.size(s) == n) & F.forall(s, lambda x: x.isNotNull() & (x >= 0)))
    at = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    pairs = F.transform(at, lambda i: F.struct((F.get(k, i) > F.get(k, i - 1)).alias("up"), (F.get(s, i) == F.get(s, i - 1)).alias("same")))
    runs = F.size(F.filter(pairs, lambda p: ~p["same"])) + 1
    order = F.transform("path_segments", lambda p: p["segment_id"])
    energies = F.flatten(F.transform(bands, lambda b: b["energies"]))
    ids = F.transform(bands, lambda b: b["band_id"])
    invalid = all_reasons(
        (~ok(c("schema_version") == 2), "schema_version"),
        (src.isNotNull() & ~text(src["document_id"], 512), "source.document_id"), (src.isNotNull() & ~text(src["panel_label"], 128), "source.panel_label"),
        (src.isNotNull() & ~ok(src["page_number"].between(1, 100_000)), "source.page_number"), (src["source_sha256"].isNotNull() & ~src["source_sha256"].rlike("^[0-9a-f]{64}$"), "source.source_sha256"),
        (~ok(c("energy_unit") == "eV"), "energy_unit"),
        (ref.isNotNull() & ~ok(ref["kind"].isin("fermi", "vbm", "arbitrary")), "energy_reference.kind"), (ref.isNotNull() & ~finite(ref["value_eV"]), "energy_reference.value_eV"),
        (ref.isNotNull() & ref["observed"].isNull(), "energy_reference.observed"), (ref.isNotNull() & ~text(ref["evidence"], 1000), "energy_reference.evidence"),
        ((ref["kind"] == "fermi") & finite(c("fermi_eV")) & ~ok(c("fermi_eV") == ref["value_eV"]), "fermi_eV.reference_mismatch"), (ref.isNotNull() & ~ok(ref["kind"] == "fermi") & c("fermi_eV").isNotNull(), "fermi_eV.requires_fermi_reference"),
        (~ok(c("k_unit").isin("relative", "angstrom^-1")), "k_unit"), (~whole, "k_distance"), (whole & ~(F.array_max(k) > F.array_min(k)), "k_distance.range"),
        (~matched, "segment_ids"), (matched & (runs > F.size(F.array_distinct(s))), "segment_ids.reentered"), (matched & F.exists(pairs, lambda p: p["same"] & ~p["up"]), "k_distance.nonmonotonic"),
        (c("path_segments").isNotNull() & ~ok(F.forall("path_segments", lambda p: text(p["start_label"], 128) & text(p["end_label"], 128))), "path_segments.labels"),
        (c("path_segments").isNotNull() & matched & ~ok(order == F.array_distinct(s)), "path_segments.coverage_or_order"),
        (~ok(F.size(bands).between(1, 4096)), "bands"), (ok(F.size(F.array_distinct(ids)) < F.size(ids)), "bands.band_id"),
        (~ok(F.forall(bands, lambda b: b["role"].isin("valence", "conduction", "unknown"))), "bands.role"), (whole & ~ok(F.forall(bands, lambda b: F.size(b["energies"]) == n)), "bands.energies"),
        (F.exists(energies, lambda x: x.isNotNull() & ~finite(x)), "bands.energies.not_finite"),
    )
    missing = all_reasons(
        (src.isNull(), "source"), (ref.isNull(), "energy_reference"), (ref["observed"] == F.lit(False), "energy_reference.observed"), ((ref["kind"] == "fermi") & ~finite(c("fermi_eV")), "fermi_eV"),
        (~text(c("calibration_evidence"), 1 << 30), "calibration_evidence"), (F.exists(energies, lambda x: x.isNull()), "bands.energies"), (F.exists(bands, lambda b: b["role"] == "unknown"), "bands.role"),
    )
    return rows.withColumns({"invalid_fields": invalid, "missing_evidence": missing})


def pair_contract(rows: DataFrame, key: str, bands: int = 6, features: int = 110, neighbours: int = 12) -> DataFrame:
    """FLT31: first broken rule of each row of a pair table, as ``problem``; null for a good one.

    ``rows`` has ``valid, grp, band_input`` (arrays of ``bands`` numbers), ``segment_ids, atom_features``
    (arrays of ``features``), ``neighbor_list, neighbor_dist`` (an array of ``neighbours`` for each atom,
    -1 for none) and ``n_atoms``. Ids must be unique and known, also over rows.
    """
    c, size = F.col, F.size
    times = F.count("*").over(Window.partitionBy(key))
    flat, far = F.flatten("neighbor_list"), F.flatten("neighbor_dist")
    shaped = lambda x: (size(x) == size("atom_features")) & F.forall(x, lambda a: size(a) == neighbours)
    ok = lambda x: F.coalesce(x, F.lit(False))
    problem = first_reason(
        (c(key).isNull() | (c(key).cast("string") == "") | (times > 1), "identity"), (c("valid").isNull(), "valid"), (~ok(c("grp") > 0), "group"),
        (~ok(all_finite(F.flatten("band_input")) & all_finite(F.flatten("atom_features")) & all_finite(far)), "nonfinite"),
        (~ok((size("band_input") > 0) & F.forall("band_input", lambda b: size(b) == bands)), "band shape"), (~ok(size("segment_ids") == size("band_input")), "segments"),
        (~ok(F.forall("atom_features", lambda a: size(a) == features)), "atom features"), (~ok(shaped("neighbor_list") & shaped("neighbor_dist")), "neighbour shape"),
        (~ok((c("n_atoms") >= 0) & (c("n_atoms") <= size("atom_features"))), "atom count"), (~ok(F.forall(flat, lambda j: (j >= -1) & (j < c("n_atoms"))) & F.forall(far, lambda d: d >= 0)), "neighbours"),
        (c("valid") & (c("n_atoms") < 1), "no usable graph"),
    )
    return rows.withColumn("problem", problem)


def graph_contract(graphs: DataFrame, key: str, cutoff: float = 8.0, neighbours: int = 12) -> DataFrame:
    """FLT31: first broken rule of each row of a graph table, as ``problem``.

    ``graphs`` has ``valid, n_atoms, capacity, descriptors`` (22 numbers), ``atom_present`` (booleans up to
    the capacity) and ``edges`` (structs ``src, dst, vec, len``). Real atoms come first; an edge is as
    long as its vector, within the cutoff, between real atoms, and no atom has over ``neighbours``.
    """
    c, size, edges = F.col, F.size, F.col("edges")
    ok = lambda x: F.coalesce(x, F.lit(False))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    sources = F.transform(edges, lambda e: e["src"])
    problem = first_reason(
        (c(key).isNull() | (F.count("*").over(Window.partitionBy(key)) > 1), "identity"), (c("valid").isNull(), "valid"),
        (~ok((size("descriptors") == 22) & all_finite(c("descriptors"))), "descriptors"), (~ok(F.when(c("valid"), c("n_atoms").between(1, c("capacity"))).otherwise(c("n_atoms") == 0)), "atom count"),
        (~ok(c("atom_present") == F.transform(F.sequence(F.lit(1), c("capacity")), lambda i: i <= c("n_atoms"))), "padding"), (~ok(c("valid")) & (size(edges) > 0), "edges of an invalid row"),
        (~ok(F.forall(edges, lambda e: (size(e["vec"]) == 3) & all_finite(e["vec"]) & (e["len"] > 0) & (e["len"] <= cutoff + 1e-5) & (F.abs(e["len"] - norm(e["vec"])) <= 1e-6 + 1e-5 * norm(e["vec"])))), "edge length"),
        (~ok(F.forall(edges, lambda e: e["src"].between(0, c("n_atoms") - 1) & e["dst"].between(0, c("n_atoms") - 1))), "edge index"),
        (F.exists(F.array_distinct(sources), lambda a: size(F.filter(sources, lambda b: b == a)) > neighbours), "too many neighbours"),
    )
    return graphs.withColumn("problem", problem)


def traceability(records: DataFrame, reviews: DataFrame, assignments: DataFrame, reviewers: list[str], scope: str = "real_human") -> DataFrame:
    """JN23: adds ``errors`` to records of traced figures: their own fields, the operator's registry and the frozen assignment.

    ``records`` has ``record_id, document_id, material_id, group_id, figure, source_kind, page, split,
    document_sha256, image_sha256, image_pixel_sha256, reviewed_by, reviewed_at, decision, record_sha256,
    evidence_sha256``. ``reviews`` (``record_id, record_sha256, evidence_sha256``) and ``assignments``
    (``group_id, split, document_id, document_sha256``) are the operator's, of ``scope``, never derived
    from the records. Ids and images are unique, a group is in one split and a document in one group.
    """
    c = F.col
    ok = lambda x: F.coalesce(x, F.lit(False))
    pinned = reviews.select("record_id", c("record_sha256").alias("__r"), c("evidence_sha256").alias("__e"))
    frozen = assignments.select("group_id", "document_id", c("split").alias("__split"), c("document_sha256").alias("__doc")).distinct()
    shared = lambda col: assignments.filter(c(col).isNotNull()).groupBy(col).agg((F.count_distinct("group_id") > 1).alias(f"__many_{col}"))
    j = records.join(pinned, "record_id", "left").join(frozen, ["group_id", "document_id"], "left").join(shared("document_id"), "document_id", "left").join(shared("document_sha256"), "document_sha256", "left")
    sides = records.groupBy("group_id").agg((F.count_distinct("split") > 1).alias("__sides"))
    j = j.join(sides, "group_id", "left")
    for col in ("record_id", "image_sha256", "image_pixel_sha256"):
        j = j.join(records.groupBy(col).agg((F.count("*") > 1).alias(f"__twice_{col}")), col, "left")
    lacks = [(unknown(c(x)), f"missing_{x}") for x in ("record_id", "document_id", "material_id", "group_id", "figure")]
    digest = lambda x: ok(c(x).rlike("^[0-9a-f]{64}$"))
    errors = all_reasons(
        *lacks, (~ok(c("source_kind").isin("paper_image", "public_arpes")), "synthetic_not_real"), (~ok(c("page") >= 1), "missing_document_page"), (~ok(c("split").isin("train", "validation", "evaluation")), "missing_split"),
        (~digest("document_sha256"), "document_sha_mismatch"), (~digest("image_sha256"), "image_sha_mismatch"),
        (~ok(c("__e") == c("evidence_sha256")), "missing_operator_authentication"), (F.lit(scope != "real_human"), "synthetic_registry_not_real"),
        (~ok((c("__split") == c("split")) & (c("__doc") == c("document_sha256")) & ~ok(c("__many_document_id")) & ~ok(c("__many_document_sha256"))), "frozen_assignment_mismatch"),
        (~ok(c("reviewed_by").isin(*reviewers) & (c("decision") == "approved") & c("reviewed_at").rlike(r"(Z|[+-]\d\d:\d\d)$")), "missing_human_review"), (~ok(c("__r") == c("record_sha256")), "review_record_binding_mismatch"),
        *[(ok(c(f"__twice_{x}")), f"duplicate_{x}") for x in ("record_id", "image_sha256", "image_pixel_sha256")], (ok(c("__sides")), "group_crosses_splits"),
    )
    return j.select(*records.columns, errors.alias("errors"))


def traceability_gate(audited: DataFrame, least: int = 200, most: int = 500) -> DataFrame:
    """JN23: one row: records, those without an error, and whether the set passes: all clean, ``least`` to ``most`` of them."""
    n, clean = F.count("*"), F.count_if(F.size("errors") == 0)
    return audited.agg(n.alias("records"), clean.alias("clean"), ((n == clean) & n.between(least, most)).alias("passes"))


def device_rules(light: float = 0.3, heavy: float = 1.5, flat: float = 0.02) -> list[tuple[str, Column, Column]]:
    """FLT18: name, condition and confidence of what a material may be good for.

    Columns: ``gap, direct, indirect, metal`` (probabilities), ``kind``, ``vbm_mass, cbm_mass,
    vbm_curvature, cbm_curvature, dirac, splitting``.
    """
    c = F.col
    is_direct = (c("kind") == "direct") | (c("direct") >= F.greatest(F.lit(0.5), c("indirect")))
    crossing = (c("kind") == "metal") | (c("metal") >= 0.5)
    mass = F.greatest(F.abs("vbm_mass"), F.abs("cbm_mass"))
    curved = F.least(F.abs("vbm_curvature"), F.abs("cbm_curvature"))
    return [
        ("optoelectronics_direct_1p0_1p6ev", c("gap").between(1.0, 1.6) & is_direct, F.greatest(F.lit(0.7), c("direct"))),
        ("wide_gap_light_cbm_tco", (c("gap") > 3.0) & (F.abs("cbm_mass") < light), F.lit(0.78)),
        ("thermoelectric_flat_band_mid_gap", c("gap").between(0.5, 1.5) & ((mass > heavy) | (curved <= flat)), F.lit(0.74)),
        ("quantum_spintronics_warning", c("dirac") | (crossing & c("splitting")), F.when(c("dirac"), 0.82).otherwise(0.68)),
    ]


def structure_descriptor(lattice: Column, number: Column, per_atom: Column, z: dict[str, int], chi: Column) -> Column:
    """FN8: 22 numbers of a structure: bucket of its group (8), lengths, angles and volume (7), element statistics (7).

    ``per_atom`` lists the symbols; ``z`` maps them to atomic numbers and the map column ``chi`` to
    electronegativities (0 where unknown). Deviations are those of the whole population.
    """
    from .geometry import cell_from_lattice, group_bucket

    cell = cell_from_lattice(*vectors_of(lattice))
    numbers = F.create_map(*[F.lit(x) for kv in z.items() for x in kv])
    values = lambda m: F.transform(per_atom, lambda s: F.coalesce(F.try_element_at(m, s).cast("double"), F.lit(0.0)))
    n = F.size(per_atom).cast("double")
    total = lambda xs, f=lambda x: x: F.aggregate(xs, F.lit(0.0), lambda t, x: t + f(x))
    mean = lambda xs: total(xs) / n
    spread = lambda xs: F.sqrt(F.greatest(F.lit(0.0), total(xs, lambda x: x * x) / n - mean(xs) * mean(xs)))
    e, a = values(chi), values(numbers)
    stats = F.array(mean(e), spread(e), F.array_min(e), F.array_max(e), F.size(F.array_distinct(per_atom)).cast("double"), mean(a), spread(a))
    empty = F.array_repeat(F.lit(0.0), 7)
    return F.concat(F.transform(group_bucket(number), lambda x: x.cast("double")), F.array(*[cell[k] for k in ("a", "b", "c", "alpha", "beta", "gamma", "volume")]), F.when(F.size(per_atom) > 0, stats).otherwise(empty))
