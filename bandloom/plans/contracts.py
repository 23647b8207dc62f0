"""Queries on contracts: rows with one planted defect each, by the key's remainder, and what every rule should say of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import contracts as T
from ..operators import quality as Q
from ..registry import query, read


def case(key: str, n: int, told: dict[int, str], other: str) -> str:
    """SQL: the text for each remainder, else the other one."""
    return f"CASE {key} % {n} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in told.items()) + f" ELSE '{other}' END"


def plant(m: Column, usual, **by: object) -> Column:
    """A value, with another one for the remainder named ``on_<number>``."""
    out = usual if isinstance(usual, Column) else F.lit(usual)
    for name, value in by.items():
        out = F.when(m == int(name[3:]), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def numbers(*rows) -> Column:
    """An array of doubles, or of such arrays."""
    one = lambda x: x.cast("double") if isinstance(x, Column) else F.lit(None if x is None else float(x)).cast("double")
    return F.array(*[numbers(*r) if isinstance(r, list) else one(r) for r in rows])


def words(*texts) -> Column:
    return F.array(*[F.lit(t).cast("string") for t in texts])


NAN, INF = float("nan"), float("inf")

BROKEN = {
    3: "conflicting_source_metadata", 4: "band data unavailable: invalid_energy_shape", 5: "nonfinite_energy_or_float32_overflow", 6: "nonfinite_energy_or_float32_overflow",
    7: "declared_n_bands_mismatch_or_illegal", 8: "declared_n_kpoints_mismatch_or_illegal", 9: "invalid_k_distances", 10: "invalid_k_distances",
    11: "invalid_k_distances: float32 storage loses positive span", 12: "invalid_kpoints", 13: "invalid_efermi", 14: "invalid_source_efermi",
    15: "invalid_aflow_energy_reference", 16: "inconsistent_energy_reference", 17: "held back", 18: "invalid_spin_channels", 19: "inconsistent_spin_layout",
}
OPEN = {20: "unknown_schema", 21: "unknown_layout,unknown_spin", 22: "missing_semantics_evidence", 23: "unknown_schema,unknown_layout,unknown_spin,missing_semantics_evidence"}
FLT4 = f"SELECT c_custkey AS id, {case('c_custkey', 24, dict.fromkeys(BROKEN, 'invalid') | dict.fromkeys(OPEN, 'ambiguous'), 'verified_valid')} AS status, {case('c_custkey', 24, BROKEN | OPEN, '')} AS reasons FROM customer"


@query("flt4_source_qa", FLT4)
def _flt4(spark, sf_dir):
    m, x = F.col("c_custkey") % 24, F.col("c_acctbal")
    text = lambda v: F.lit(v).cast("string")
    bands = numbers([x, x + 1, x + 2], [x + 3, x + 4, x + 5])
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), plant(m, "aflow", on_1="mp", on_2="mp", on_16="mp", on_20="other").alias("source"),
        plant(m, "aflow_bandsdata_v1", on_1="mp_pymatgen_v1", on_2="mp_pymatgen_v1", on_16="mp_pymatgen_v1", on_23=text(None)).alias("source_schema"),
        plant(m, "bands_k", on_1="spin_major_flat", on_2="spin_band_k", on_21=text(None), on_23="rows").alias("band_layout"),
        plant(m, "as declared by the importer", on_22="", on_23=text(None)).alias("source_semantics_evidence"), plant(m, "as reported", on_16="fermi_shifted_zero").alias("energy_reference"),
        plant(m, 1, on_1=2, on_2=2, on_18=0, on_19=2, on_21=F.lit(None).cast("int"), on_23=4).alias("spin_channels"), plant(m, F.lit(None).cast("int"), on_2=2).alias("spin_axis"),
        plant(m, 2, on_2=1, on_7=3).alias("n_bands"), plant(m, F.lit(None).cast("int"), on_8=4).alias("n_kpoints"),
        plant(m, bands, on_4=numbers([x], [x]), on_5=numbers([x, NAN, x], [x, x, x]), on_6=numbers([x, x, 1e39], [x, x, x])).alias("energies"),
        plant(m, numbers(0, 0.5, 1), on_9=numbers(0, 0.7, 0.5), on_10=numbers(-1, 0, 1), on_11=numbers(1, 1 + 1e-9, 1 + 2e-9)).alias("k_distances"),
        plant(m, numbers([0, 0, 0], [0, 0, 1], [0, 0, 2]), on_12=numbers([0, 0], [0, 1], [0, 2])).alias("kpoints"), plant(m, F.lit(0.0), on_13=NAN, on_15=0.5, on_16=0.5).alias("efermi"),
        plant(m, F.lit(None).cast("double"), on_14=INF).alias("source_efermi_absolute"), plant(m, "c0", on_17="c1").alias("content_sha256"),
        plant(m, F.create_map(F.lit("n_bands"), F.lit("2")), on_2=F.create_map(F.lit("n_bands"), F.lit("1")), on_3=F.create_map(F.lit("source"), F.lit("mp")), on_7=F.create_map(F.lit("note"), F.lit("x"))).alias("metadata"),
    )
    return T.source_quality(rows, {"c1": "held back"}).select("id", "status", F.array_join("reasons", ",").alias("reasons"))


@query("ag41_source_qa_ledger", f"SELECT id % 2 AS split, status, count(*) AS n FROM ({FLT4}) GROUP BY ALL")
def _ag41(spark, sf_dir):
    return Q.ledger(_flt4(spark, sf_dir), (F.col("id") % 2).alias("split"), F.col("status"))


def structures(spark, sf_dir):
    """Two atoms in a right-angled cell of each part, with their reciprocal cell and conventions."""
    from math import tau

    p = read(spark, sf_dir, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    a, b, c = 3.0 + z % 5 * 0.5, 4.0 + k % 7 * 0.25, 5.0 + k % 3
    convention = F.struct(*[F.lit(v).alias(n) for n, v in (("lattice_units", "angstrom"), ("lattice_vectors", "rows"), ("coordinates", "fractional"), ("coordinate_basis", "direct_lattice"), ("cell_setting", "primitive"))])
    return p.select(
        k.alias("id"), F.format_string("aflow-%016x", k).alias("material_id"), F.format_string("aflow:%016x", k).alias("auid"), numbers([a, 0, 0], [0, b, 0], [0, 0, c]).alias("lattice"),
        words("Na", "Cl").alias("species"), words("Na", "Cl").alias("species_per_atom"), numbers([0, 0, 0], [0.5, 0.5, 0.25]).alias("fractional_coordinates"), convention.alias("structure_conventions"),
        numbers([F.lit(tau) / a, 0, 0], [0, F.lit(tau) / b, 0], [0, 0, F.lit(tau) / c]).alias("reciprocal_lattice"),
    )


CELL = "SELECT p_partkey AS id, CAST(3.0 + p_size % 5 * 0.5 AS DOUBLE) AS a, CAST(4.0 + p_partkey % 7 * 0.25 AS DOUBLE) AS b, CAST(5.0 + p_partkey % 3 AS DOUBLE) AS c, p_size FROM part"


@query("key12_structure_hash", f"""WITH s AS ({CELL}), d AS (SELECT id, sha256('{{"fractional_coordinates":[[0.0,0.0,0.0],[0.5,0.5,0.25]],"lattice":[[' || a || ',0.0,0.0],[0.0,' || b || ',0.0],[0.0,0.0,' || c || ']],"species":["Na","Cl"],"species_per_atom":["Na","Cl"],"structure_conventions":{{"cell_setting":"primitive","coordinate_basis":"direct_lattice","coordinates":"fractional","lattice_units":"angstrom","lattice_vectors":"rows"}},"version":"structure-v2"}}') AS digest FROM s)
SELECT id, CASE WHEN id % 9 <> 4 THEN digest END AS digest, id % 9 IN (0, 3, 5, 6, 7, 8) AS verified FROM d""")
def _key12(spark, sf_dir):
    """Digests of whole structures, and claims under both versions: another digest, another version, no digest."""
    m = F.col("id") % 9
    rows = structures(spark, sf_dir).withColumn("lattice", F.when(m != 4, F.col("lattice")))
    rows = rows.withColumn("digest", T.structure_hash(rows)).withColumn("old", K.rounded_hash(F.flatten("lattice"), 8))
    claim = plant(m, F.col("digest"), on_1=F.sha2(F.col("digest"), 256), on_2=F.upper("digest"), on_3=F.col("old"))
    return rows.select("id", "digest", T.verify_structure_hash(claim, plant(m, T.V2, on_1=T.V2, on_3=T.V1), F.col("digest"), F.col("old")).alias("verified"))


LINES = {
    1: "lattice=invalid:invalid_shape_value_or_convention,reciprocal_lattice=invalid:invalid_reciprocal_or_direct_duality,structure_sha256=invalid:digest_mismatch_or_invalid_structure",
    2: "species=invalid:invalid_shape_value_or_convention,structure_sha256=invalid:digest_mismatch_or_invalid_structure",
    3: "species_per_atom=invalid:atom_count_or_composition_mismatch,structure_sha256=invalid:digest_mismatch_or_invalid_structure",
    4: "fractional_coordinates=invalid:invalid_shape_value_or_convention,structure_sha256=invalid:digest_mismatch_or_invalid_structure",
    5: "structure_conventions=ambiguous:missing_or_unknown,structure_sha256=invalid:digest_mismatch_or_invalid_structure",
    6: "spin_cell=invalid:nonfinite_or_wrong_moment_shape", 7: "magnetic_moments=ambiguous:scalar_summary_not_per_atom_moments", 8: "reciprocal_lattice=invalid:invalid_reciprocal_or_direct_duality",
    9: "reciprocal_convention=invalid:unsupported_reciprocal_convention", 10: "material_id=invalid:invalid_AUID_or_material_id_mismatch", 11: "dft_type=invalid:nonempty_string_list_required",
    12: "pseudopotential=invalid:pseudopotential_species_cardinality_mismatch", 13: "hubbard_u=invalid:invalid_U_values", 14: "hubbard_u=ambiguous:explicit_enabled_and_per_species_protocol_required",
    15: "kpoints_3d=invalid:invalid_segment_endpoints", 16: "kpath_segments=invalid:segment_count_differs_from_endpoints", 17: "structure_sha256=invalid:digest_mismatch_or_invalid_structure",
    18: "structure_sha256=ambiguous:legacy_digest_omits_atoms_and_basis", 20: "soc=read_error:no bytes", 22: "structure_sha256=invalid:upstream_input_digest_mismatch", 23: "code=invalid:two codes",
}
RECORDS = {k: "invalid" for k, v in LINES.items() if "=invalid" in v} | {19: "read_error", 20: "read_error", 21: "invalid"}


@query("flt7_field_audit", f"""SELECT p_partkey AS id, {case('p_partkey', 24, RECORDS, 'ambiguous')} AS status, {case('p_partkey', 24, {1: 'invalid', 2: 'invalid', 3: 'invalid', 4: 'invalid', 19: 'read_error'}, 'valid')} AS basic_structure_status,
CAST({case('p_partkey', 24, {5: '1', 19: '29', 20: '1'}, '0')} AS INT) AS missing, {case('p_partkey', 24, LINES, '')} AS issues FROM part""")
def _flt7(spark, sf_dir):
    """All fields of a structure record; of evidence that nobody has looked at again only the count would tell, so it isn't listed."""
    m, none = F.col("id") % 24, F.lit(None)
    s = structures(spark, sf_dir).withColumn("structure_hash_version", plant(m, T.V2, on_18=T.V1)).withColumn("legacy_sha256", F.sha2(F.col("material_id"), 256))
    good = s.withColumn("good", T.structure_hash(s))
    u = lambda on, values: F.struct(F.lit(on).cast("boolean").alias("enabled"), words("Na").alias("species"), values.alias("values_eV"), F.lit("rotational").alias("formulation"))
    path = lambda end: F.struct(F.array(F.struct(numbers(0, 0, 0).alias("start"), end.alias("end"))).alias("segments"))
    errors = lambda n, f, why: F.when(m == n, F.create_map(F.lit(f), F.lit(why))).otherwise(F.create_map(F.lit("-"), F.lit("-")))
    rows = good.select(
        "id", "auid", "legacy_sha256", "structure_hash_version", plant(m, F.col("material_id"), on_10="aflow-other").alias("material_id"), F.lit("aflow").alias("source"), F.lit("host/a").alias("aurl"),
        plant(m, F.col("lattice"), on_1=numbers([0, 3, 0], [3, 0, 0], [0, 0, 3])).alias("lattice"), plant(m, F.col("species"), on_2=words("Na", "Xx")).alias("species"), plant(m, F.col("species_per_atom"), on_3=words("Na")).alias("species_per_atom"),
        plant(m, F.col("fractional_coordinates"), on_4=numbers([0, 0, NAN], [0, 0, 0])).alias("fractional_coordinates"), F.when(m != 5, F.col("structure_conventions")).alias("structure_conventions"),
        plant(m, F.col("reciprocal_lattice"), on_8=F.col("lattice")).alias("reciprocal_lattice"), plant(m, "rows_2pi_inverse_transpose", on_9="columns").alias("reciprocal_convention"),
        plant(m, F.col("good"), on_17=F.sha2(F.lit("x"), 256), on_18=F.col("legacy_sha256")).alias("structure_sha256"), plant(m, F.lit(0.0), on_6=INF).alias("spin_cell"), numbers(0, 0).alias("spin_atom"),
        plant(m, numbers(1, -1), on_7=numbers(2)).alias("magnetic_moments"), F.lit(False).alias("spin_polarized"), F.when(m != 20, F.lit(False)).alias("soc"), F.lit("PBE").alias("dft_functional"),
        plant(m, words("PAW"), on_11=words(" ")).alias("dft_type"), plant(m, u(False, numbers(1)), on_13=u(True, numbers(NAN)), on_14=u(None, numbers(1))).alias("hubbard_u"),
        plant(m, words("Na_pv", "Cl"), on_12=words("Na_pv")).alias("pseudopotential"), words("1", "2").alias("pseudopotential_version"), F.lit("vasp").alias("code"), plant(m, words("G-X"), on_16=words("G-X", "X-M")).alias("kpath_segments"),
        F.lit("standard").alias("kpath_convention"), plant(m, path(numbers(0.5, 0, 0)), on_15=path(numbers(0, 0, 0))).alias("kpoints_3d"),
        *[F.lit("seen").alias(f) for f in ("structure_basis_evidence", "protocol_evidence", "kpoint_basis_evidence", "kpoints_dense")],
        F.when(m == 19, "unreadable").alias("read_error"), errors(20, "soc", "no bytes").alias("field_read_errors"), errors(23, "code", "two codes").alias("field_invalid_errors"),
        plant(m, F.array().cast("array<string>"), on_21=words("lattice")).alias("merge_conflicts"), plant(m, none.cast("boolean"), on_22=False).alias("input_hash_valid"),
    )
    got = T.structure_audit(rows)
    lines = F.transform(F.map_entries("field_quality"), lambda e: F.when((e["value"]["status"] != "valid") & (e["value"]["reason"] != "external_evidence_not_reverified") & F.col("read_error").isNull(), F.concat_ws(":", F.concat_ws("=", e["key"], e["value"]["status"]), e["value"]["reason"])))
    return got.select("id", "status", "basic_structure_status", F.size("missing_fields").alias("missing"), F.array_join(lines, ",").alias("issues"))


CLAIMS = {1: "document_kind", 2: "claims", 3: "claims[1].kind_or_basis", 4: "claims[1].not_reported_value", 5: "claims[1].inference_reason", 6: "claims[1].evidence", 7: "claims[1].source", 8: "claims[1].cited_origin", 9: "claims[1].computational_paper_is_not_an_experimental_sop", 10: "claims[1].source,claims[1].cited_origin"}


@query("flt23_claim_issues", f"SELECT c_custkey AS id, {case('c_custkey', 12, {1: 'refused', 2: 'refused', 0: 'evidence_contract_valid_unverified', 11: 'evidence_contract_valid_unverified'}, 'needs_more_evidence')} AS status, {case('c_custkey', 12, CLAIMS, '')} AS issues FROM customer")
def _flt23(spark, sf_dir):
    m, text = F.col("id") % 12, lambda v: F.lit(v).cast("string")
    proof = lambda page, origin: F.array(F.struct(F.lit("paper").alias("document_id"), page.alias("page_number"), F.lit("as written").alias("excerpt"), origin.alias("origin")))
    first = F.struct(F.lit("property").alias("kind"), F.lit("3 eV").alias("value"), F.lit("reported").alias("basis"), text(None).alias("reason"), proof(F.lit(1), F.lit("current_paper")).alias("evidence"))
    second = F.struct(
        plant(m, "crystal_structure", on_3="rumour", on_8="cited_synthesis", on_9="experimental_synthesis", on_10="cited_synthesis").alias("kind"), plant(m, "cubic", on_11=text(None)).alias("value"),
        plant(m, "reported", on_4="not_reported", on_5="inferred", on_11="not_reported").alias("basis"), text(None).alias("reason"),
        F.when(m != 6, proof(plant(m, 2, on_7=0, on_10=0), plant(m, "current_paper", on_0="author_data"))).alias("evidence"),
    )
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select("id", plant(m, "computational", on_1="blog").alias("document_kind"), F.when(m != 2, F.array(first, second)).alias("claims"))
    return T.claim_review(rows).select("id", "status", F.array_join("issues", ",").alias("issues"))


FIELDS = {
    1: "schema_version", 2: "source.page_number", 3: "source.source_sha256", 4: "energy_unit", 5: "energy_reference.kind", 6: "fermi_eV.reference_mismatch", 7: "fermi_eV.requires_fermi_reference", 8: "k_unit",
    9: "k_distance,segment_ids", 10: "segment_ids", 11: "segment_ids.reentered,path_segments.coverage_or_order", 12: "k_distance.nonmonotonic", 13: "path_segments.labels", 14: "bands.band_id", 15: "bands.energies", 16: "bands.energies.not_finite",
}
LACKS = {7: "", 17: "source", 18: "energy_reference", 19: "energy_reference.observed", 20: "fermi_eV", 21: "calibration_evidence", 22: "bands.energies", 23: "bands.role"}


@query("flt24_observation_review", f"SELECT c_custkey AS id, {case('c_custkey', 24, FIELDS, '')} AS invalid_fields, {case('c_custkey', 24, LACKS, '')} AS missing_evidence FROM customer")
def _flt24(spark, sf_dir):
    m, x = F.col("id") % 24, F.col("x")
    ref = lambda kind, seen: F.struct(F.lit(kind).alias("kind"), F.lit(0.5).alias("value_eV"), F.lit(seen).alias("observed"), F.lit("the dashed line").alias("evidence"))
    band = lambda name, role, *e: F.struct(F.lit(name).alias("band_id"), F.lit(role).alias("role"), numbers(*e).alias("energies"))
    path = lambda label: F.array(*[F.struct(F.lit(i).alias("segment_id"), F.lit("G").alias("start_label"), F.lit(t).alias("end_label")) for i, t in ((0, label), (1, "M"))])
    low = band("v", "valence", x, x - 1, x, x)
    ids = lambda *v: F.array(*map(F.lit, v))
    source = F.struct(F.lit("paper").alias("document_id"), plant(m, 3, on_2=0).alias("page_number"), F.lit("a").alias("panel_label"), plant(m, F.sha2(F.lit("x"), 256), on_3="abc").alias("source_sha256"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")).select(
        "id", plant(m, 2, on_1=1).alias("schema_version"), F.when(m != 17, source).alias("source"), plant(m, "eV", on_4="Ry").alias("energy_unit"),
        F.when(m != 18, plant(m, ref("fermi", True), on_5=ref("other", True), on_7=ref("vbm", True), on_19=ref("fermi", False))).alias("energy_reference"),
        F.when(~m.isin(5, 18, 20), plant(m, F.lit(0.5), on_6=0.25)).alias("fermi_eV"), plant(m, "relative", on_8="metre").alias("k_unit"), plant(m, numbers(0, 1, 1, 2), on_9=numbers(0, NAN, 1, 2), on_12=numbers(0, 0, 1, 2)).alias("k_distance"),
        plant(m, ids(0, 0, 1, 1), on_10=ids(0, 0, 1), on_11=ids(0, 1, 0, 0)).alias("segment_ids"),
        plant(m, F.array(low, band("c", "conduction", x, x, x, x)), on_14=F.array(low, low), on_15=F.array(low, band("c", "conduction", x)), on_16=F.array(low, band("c", "conduction", x, INF, x, x)), on_22=F.array(low, band("c", "conduction", x, None, x, x)), on_23=F.array(low, band("c", "unknown", x, x, x, x))).alias("bands"),
        plant(m, "two ticks an axis", on_21=" ").alias("calibration_evidence"), F.when(m != 10, plant(m, path("X"), on_11=F.reverse(path("X")), on_13=path(""))).alias("path_segments"),
    )
    return T.observation_review(rows).select("id", F.array_join("invalid_fields", ",").alias("invalid_fields"), F.array_join("missing_evidence", ",").alias("missing_evidence"))


PAIRS = {1: "group", 2: "nonfinite", 3: "band shape", 4: "segments", 5: "atom features", 6: "neighbour shape", 7: "atom count", 8: "neighbours", 9: "no usable graph", 10: "valid"}


@query("flt31_pair_contract", f"SELECT p_partkey AS id, {case('p_partkey', 12, PAIRS, 'ok')} AS problem FROM part")
def _flt31_pairs(spark, sf_dir):
    m, k = F.col("p_partkey") % 12, F.col("p_partkey")
    ones = lambda n, v=1.0: F.array_repeat(F.lit(float(v)), n)
    near = lambda n, j: F.array(*[F.array_repeat(F.lit(j), n)] * 2)
    rows = read(spark, sf_dir, "part").select(
        k.alias("id"), F.when(m != 10, F.lit(True)).alias("valid"), plant(m, 12, on_1=0).alias("grp"), plant(m, F.array(ones(6), ones(6)), on_2=F.array(ones(6, NAN), ones(6)), on_3=F.array(ones(6), ones(5))).alias("band_input"),
        plant(m, F.array(F.lit(0), F.lit(0)), on_4=F.array(F.lit(0))).alias("segment_ids"), plant(m, F.array(ones(110), ones(110)), on_5=F.array(ones(109), ones(110))).alias("atom_features"),
        plant(m, near(12, 0), on_6=near(11, 0), on_8=near(12, 2), on_9=near(12, -1)).alias("neighbor_list"), plant(m, F.array(ones(12), ones(12)), on_6=F.array(ones(11), ones(11))).alias("neighbor_dist"), plant(m, 2, on_7=3, on_9=0).alias("n_atoms"),
    )
    return T.pair_contract(rows, "id").select("id", F.coalesce("problem", F.lit("ok")).alias("problem"))


GRAPHS = {1: "valid", 2: "descriptors", 3: "atom count", 4: "padding", 5: "edges of an invalid row", 6: "edge length", 7: "edge index", 8: "too many neighbours", 9: "edge length"}


@query("flt31_graph_contract", f"SELECT p_partkey AS id, {case('p_partkey', 11, GRAPHS, 'ok')} AS problem FROM part")
def _flt31_graphs(spark, sf_dir):
    m = F.col("p_partkey") % 11
    edge = lambda a, b, length: F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), numbers(3, 4, 0).alias("vec"), F.lit(float(length)).alias("len"))
    far = F.struct(F.lit(0).alias("src"), F.lit(1).alias("dst"), numbers(8, 6, 0).alias("vec"), F.lit(10.0).alias("len"))
    good = F.array(edge(0, 1, 5), edge(1, 0, 5))
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(m != 1, m != 5).alias("valid"), plant(m, 2, on_3=0, on_5=0).alias("n_atoms"), F.lit(4).alias("capacity"), F.array_repeat(F.lit(1.0), plant(m, 22, on_2=21)).alias("descriptors"),
        plant(m, F.array(*[F.lit(i < 2) for i in range(4)]), on_4=F.array(*[F.lit(i < 3) for i in range(4)]), on_5=F.array(*[F.lit(False)] * 4)).alias("atom_present"),
        plant(m, good, on_6=F.array(edge(0, 1, 4)), on_7=F.array(edge(0, 2, 5)), on_8=F.array_repeat(edge(0, 1, 5), 13), on_9=F.array(far)).alias("edges"),
    )
    return T.graph_contract(rows, "id").select("id", F.coalesce("problem", F.lit("ok")).alias("problem"))


@query("flt31_row_contracts", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'not finite' WHEN vec_id % 7 = 0 THEN 'wrong length' END AS problem FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 7 = 0")
def _flt31(spark, sf_dir):
    """Rows that break the contract of a vector table, with the first reason."""
    v = F.col("embedding")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform(v, lambda x: x * float("nan"))).when(F.col("vec_id") % 7 == 0, F.slice(v, 1, 3)).otherwise(v).alias("v"))
    return Q.vector_contract(rows, "v", 64).filter("problem is not null").select("vec_id", "problem")


TRACE = """WITH r AS (SELECT doc_id, doc_id % 40 AS g, doc_id % 13 AS m, sha256(text) AS image, source FROM documents), l AS (SELECT DISTINCT doc_id FROM labels), t AS (SELECT image, count(*) AS n FROM r GROUP BY 1),
j AS (SELECT r.*, l.doc_id IS NOT NULL AS known, n FROM r LEFT JOIN l USING (doc_id) JOIN t USING (image))
SELECT doc_id AS id, concat_ws(',', CASE WHEN m = 1 THEN 'missing_figure' END, CASE WHEN m = 2 THEN 'synthetic_not_real' END, CASE WHEN m = 3 THEN 'missing_document_page' END, CASE WHEN m = 4 THEN 'document_sha_mismatch' END,
CASE WHEN NOT known OR m = 5 THEN 'missing_operator_authentication' END, CASE WHEN NOT known OR m IN (4, 6) THEN 'frozen_assignment_mismatch' END, CASE WHEN m IN (7, 8, 9) THEN 'missing_human_review' END,
CASE WHEN NOT known OR m = 10 THEN 'review_record_binding_mismatch' END, CASE WHEN n > 1 THEN 'duplicate_image_sha256,duplicate_image_pixel_sha256' END, CASE WHEN g = 7 THEN 'group_crosses_splits' END) AS errors FROM j"""


@query("jn23_traceability", TRACE)
def _jn23(spark, sf_dir):
    """Records are documents; what the operator has registered and allocated comes from the labels."""
    d, c = F.col("doc_id"), F.col
    m, split = d % 13, F.when(d % 40 < 20, "train").otherwise("evaluation")
    digest = lambda *x: F.sha2(F.concat_ws("|", *x), 256)
    rows = read(spark, sf_dir, "documents").select(
        d.cast("string").alias("record_id"), F.concat(F.lit("doc"), d).alias("document_id"), F.lit("m1").alias("material_id"), F.concat(F.lit("g"), d % 40).alias("group_id"), plant(m, "2a", on_1=" ").alias("figure"), plant(m, "paper_image", on_2="drawn").alias("source_kind"),
        plant(m, 1, on_3=0).alias("page"), F.when((d % 40 == 7) & (d % 80 == 7), "validation").otherwise(split).alias("split"), plant(m, digest(F.lit("document"), d), on_4="none").alias("document_sha256"), F.sha2("text", 256).alias("image_sha256"), F.sha2("text", 256).alias("image_pixel_sha256"),
        plant(m, "reviewer a", on_7="someone").alias("reviewed_by"), plant(m, "2024-05-01T10:00:00Z", on_8="2024-05-01T10:00:00").alias("reviewed_at"), plant(m, "approved", on_9="seen").alias("decision"),
        plant(m, digest(F.lit("record"), d), on_10=digest(F.lit("changed"), d)).alias("record_sha256"), plant(m, digest(F.lit("evidence"), d), on_5=digest(F.lit("other"), d)).alias("evidence_sha256"), d,
    )
    known = read(spark, sf_dir, "labels").select("doc_id").distinct()
    reviews = known.select(d.cast("string").alias("record_id"), digest(F.lit("record"), d).alias("record_sha256"), digest(F.lit("evidence"), d).alias("evidence_sha256"))
    crosses = (d % 40 == 7) & (d % 80 == 7)
    held = F.when((m == 6) & ~crosses, "validation").when(crosses & (m != 6), "validation").otherwise(split)  # of every record with m = 6 another split than its own
    frozen = known.select(F.concat(F.lit("g"), d % 40).alias("group_id"), held.alias("split"), F.concat(F.lit("doc"), d).alias("document_id"), digest(F.lit("document"), d).alias("document_sha256"))
    return T.traceability(rows, reviews, frozen, ["reviewer a", "reviewer b"]).select(c("doc_id").alias("id"), F.array_join("errors", ",").alias("errors"))


@query("jn23_trace_gate", f"WITH a AS ({TRACE}) SELECT count(*) AS records, count(*) FILTER (WHERE errors = '') AS clean, count(*) = count(*) FILTER (WHERE errors = '') AND count(*) BETWEEN 200 AND 500 AS passes FROM a")
def _gate(spark, sf_dir):
    return T.traceability_gate(_jn23(spark, sf_dir).withColumn("errors", F.filter(F.split("errors", ","), lambda x: x != "")))


RULES = """WITH e AS (SELECT event_id, value / 25 AS gap, CASE event_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' ELSE 'metal' END AS kind, event_id % 10 / 10.0 AS direct, event_id % 7 / 10.0 AS metal, event_id % 5 * 0.5 - 0.3 AS mass, event_id % 4 * 0.015 AS curve, event_id % 11 = 0 AS dirac, event_id % 2 = 0 AS splitting FROM events),
r AS (SELECT event_id, metal, [{'rule': 'optoelectronics_direct_1p0_1p6ev', 'ok': gap BETWEEN 1.0 AND 1.6 AND (kind = 'direct' OR direct >= greatest(0.5, 1 - direct)), 'c': greatest(0.7, direct)}, {'rule': 'wide_gap_light_cbm_tco', 'ok': gap > 3.0 AND abs(mass) < 0.3, 'c': 0.78},
{'rule': 'thermoelectric_flat_band_mid_gap', 'ok': gap BETWEEN 0.5 AND 1.5 AND (abs(mass) > 1.5 OR curve <= 0.02), 'c': 0.74}, {'rule': 'quantum_spintronics_warning', 'ok': dirac OR ((kind = 'metal' OR metal >= 0.5) AND splitting), 'c': CASE WHEN dirac THEN 0.82 ELSE 0.68 END}] AS l FROM e),
f AS (SELECT event_id, metal, [x for x in l if x.ok] AS l FROM r) SELECT event_id, u.rule AS rule, round(CAST(u.c AS DOUBLE), 8) AS confidence FROM (SELECT event_id, unnest(l) AS u FROM f) UNION ALL SELECT event_id, 'general_semiconductor', round(CAST(greatest(0.45, 1 - metal) AS DOUBLE), 8) FROM f WHERE len(l) = 0"""


@query("flt18_recommendations", RULES)
def _flt18(spark, sf_dir):
    k = F.col("event_id")
    e = read(spark, sf_dir, "events").select(
        "event_id", (F.col("value") / 25).alias("gap"), F.element_at(words("direct", "indirect", "metal"), (k % 3 + 1).cast("int")).alias("kind"), (k % 10 / 10.0).alias("direct"), (1 - k % 10 / 10.0).alias("indirect"), (k % 7 / 10.0).alias("metal"),
        (k % 5 * 0.5 - 0.3).alias("vbm_mass"), (k % 5 * 0.5 - 0.3).alias("cbm_mass"), (k % 4 * 0.015).alias("vbm_curvature"), (k % 4 * 0.015).alias("cbm_curvature"), (k % 11 == 0).alias("dirac"), (k % 2 == 0).alias("splitting"),
    )
    hits = Q.recommendations(T.device_rules(), "general_semiconductor", F.greatest(F.lit(0.45), 1 - F.col("metal")))
    return e.select("event_id", F.explode(hits).alias("r")).select("event_id", "r.rule", F.round("r.confidence", 8).alias("confidence"))


@query("fn8_structure_descriptor", f"""WITH s AS ({CELL}), d AS (SELECT id, [CASE WHEN least(7, floor(log2(p_size))) = i THEN 1.0 ELSE 0.0 END for i in range(8)] || [a, b, c, 90.0, 90.0, 90.0, a * b * c] || [(2 * 0.93 + 3.16) / 3, sqrt((2 * 0.93 * 0.93 + 3.16 * 3.16) / 3 - ((2 * 0.93 + 3.16) / 3) ** 2), 0.93, 3.16, 2.0, (2 * 11 + 17) / 3.0, sqrt((2 * 11 * 11 + 17 * 17) / 3.0 - 13.0 ** 2)] AS v FROM s)
SELECT id, CAST(i AS INT) AS place, round(CAST(v[i] AS DOUBLE), 6) AS x FROM (SELECT id, v, unnest(range(1, 23)) AS i FROM d)""")
def _fn8(spark, sf_dir):
    """The 22 numbers of a structure of three atoms."""
    s = structures(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    chi = F.create_map(F.lit("Na"), F.lit(0.93), F.lit("Cl"), F.lit(3.16))
    v = T.structure_descriptor(F.col("lattice"), F.col("p_size"), words("Na", "Na", "Cl"), {"Na": 11, "Cl": 17}, chi)
    return s.select("id", F.posexplode(v).alias("p", "x")).select("id", (F.col("p") + 1).alias("place"), F.round("x", 6).alias("x"))
