"""Reports, the completion gate, calibrated samples, queue records and declared sizes at their edges."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from bandloom.operators import contracts, features, metrics, reports, review

NULL = None


def test_values_coverage_and_labels(spark):
    rows = spark.createDataFrame([("a", "", 1), ("a", None, -1), (None, "x", None), ("b", "x", 0)], "p string, q string, y int")
    assert {tuple(r) for r in reports.value_counts(rows, ["p", "q"]).collect()} == {("p", "a", 2), ("p", "unknown", 1), ("p", "b", 1), ("q", "", 1), ("q", "unknown", 1), ("q", "x", 2)}
    assert {tuple(r) for r in reports.coverage(rows, ["p", "q", "y"]).collect()} == {("p", 3, 4), ("q", 2, 4), ("y", 3, 4)}
    assert [tuple(r) for r in reports.label_report(rows, ["y"]).collect()] == [("y", 2, 4, "0:1,1:1")]
    values = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 0.99, 1.0, 4.0, 4.1, None)], "v double")
    assert {tuple(r) for r in reports.histogram(values, "v", 0.0, 4.0, 4).collect()} == {(0, 2), (1, 1), (3, 1)}


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "status string, cv_score double, predicted_type string")
    assert tuple(reports.mining_summary(none).first()) == (0, 0.0, None, 0)
    runs = spark.createDataFrame([], "outcome string, submitted timestamp, completed timestamp, spacegroup int")
    got = reports.run_report(runs, 5, 5).first()
    assert (got["attempted"], got["peak_in_flight"], got["total_cached"], got["target_reached"], got["spacegroups"]) == (0, 0, 5, True, "")
    assert tuple(reports.detection_report(spark.createDataFrame([], "b array<int>"), F.col("b")).first()) == (0, 0, 0)


def test_peak_in_flight_by_plain_count(spark):
    rng = random.Random(1)
    jobs = [(b, b + rng.randrange(1, 9) if rng.random() < 0.9 else None) for b in (rng.randrange(60) for _ in range(200))] + [(None, 3)]
    df = spark.createDataFrame(jobs, "b int, e int")
    want = max(sum(b is not None and b <= t and (e is None or e > t) for b, e in jobs) for t in range(70))
    assert reports.peak_in_flight(df.filter("b is not null"), "b", "e").first()[0] == want


def test_detection_counts_missing_lists_as_empty(spark):
    pages = spark.createDataFrame([([1, 2],), ([],), (None,), ([3],)], "b array<int>")
    assert tuple(reports.detection_report(pages, F.col("b")).first()) == (2, 2, 3)


def test_gate_tells_the_first_problem(spark):
    stored = spark.createDataFrame([(r,) for r in "aaabbbcccdddeee"], "run string")
    told = spark.createDataFrame([("a", True, 3, 3), ("c", None, 3, 3), ("d", True, 4, 3), ("e", True, 3, 2)], "run string, target_reached boolean, requested_target int, total_cached int")
    targets = spark.createDataFrame([(r, 3) for r in "abcde"] + [("f", 0), ("g", 1)], "run string, target int")
    got = {r["run"]: r["problem"] for r in reports.completion_gate(stored, told, targets, "run").collect()}
    assert got == {"a": None, "b": "missing report", "c": "target_reached=false", "d": "report requested_target differs", "e": "report total_cached differs", "f": "missing report", "g": "persisted < requested target"}


def plain_issue(obs, bands, cals):
    """The rules one after the other, as a reader would check them by hand."""
    if obs["calibration_id"] is None:
        return "left out"
    cal = cals.get(obs["calibration_id"])
    if cal is None:
        return review.UNUSABLE
    if any(obs[c] != cal[c] for c in ("attachment_id", "source_sha256")):
        return review.SOURCE
    if any(obs[c] != cal[c] for c in ("energy_unit", "k_unit")):
        return review.UNITS
    if cal["k_tolerance"] is None:
        return review.UNUSABLE
    for energies, points in bands:
        if points is None or len(points) != len(energies):
            return review.POINTS
        for i, (e, p) in enumerate(zip(energies, points, strict=True)):
            if e is None:
                if p is not None:
                    return review.MISSING
                continue
            if p is None or len(p) != 2 or not all(v is not None and math.isfinite(v) for v in p) or not (0 <= p[0] < cal["width"] and 0 <= p[1] < cal["height"]):
                return review.BOUNDS
            if abs(cal["e_slope"] * p[1] + cal["e_intercept"] - e) > cal["e_tolerance"]:
                return review.ENERGY
            if i >= len(obs["k_distance"]):
                return review.UNUSABLE
            if abs(cal["k_slope"] * p[0] + cal["k_intercept"] - obs["k_distance"][i]) > cal["k_tolerance"]:
                return review.K
    return None


def test_calibrated_samples_against_plain_rules(spark):
    rng = random.Random(2)
    names = ["calibration_id", "attachment_id", "source_sha256", "energy_unit", "k_unit", "width", "height", "e_slope", "e_intercept", "e_tolerance", "k_slope", "k_intercept", "k_tolerance"]
    cals = [(f"c{i}", f"att{i}", f"s{i}", "eV", "relative", 100, 80, -0.25, 4.0, 0.125, 0.5, 1.0, None if i == 5 else 0.25) for i in range(6)]
    known = {c[0]: dict(zip(names, c, strict=True)) for c in cals}
    observations, bands, want = [], [], {}
    for n in range(400):
        i = rng.randrange(6)
        odd = lambda value, other: other if rng.random() < 0.05 else value
        obs = {"calibration_id": odd(odd(f"c{i}", "lost"), None), "attachment_id": odd(f"att{i}", "other"), "source_sha256": odd(f"s{i}", None), "energy_unit": odd("eV", "Ha"), "k_unit": odd("relative", None), "k_distance": [1.0 + 5 * k for k in range(odd(4, 3))]}
        own = []
        for _ in range(rng.randrange(0, 4)):
            points = [[10.0 * k + odd(0.0, 0.5) + odd(0.0, 1.0), float(rng.randrange(odd(80, 90)))] for k in range(4)]
            energies = [4.0 - 0.25 * p[1] + odd(0.0, 0.125) + odd(0.0, -0.25) for p in points]
            k = rng.randrange(4)
            points[k] = odd(odd(odd(points[k], [points[k][0]]), [float("nan"), 1.0]), None)
            k = rng.randrange(4)
            energies[k] = odd(energies[k], None)
            if energies[k] is None and rng.random() < 0.7:
                points[k] = None
            own.append((energies, odd(odd(points, points[:3]), None)))
        observations.append((n, *obs.values()))
        bands += [(n, b, *x) for b, x in enumerate(own)]
        want[n] = plain_issue(obs, own, known)
    df = spark.createDataFrame(observations, "obs_id int, calibration_id string, attachment_id string, source_sha256 string, energy_unit string, k_unit string, k_distance array<double>")
    kinds = ", ".join(f"{c} {k}" for c, k in zip(names, ["string"] * 5 + ["int"] * 2 + ["double"] * 6, strict=True))
    got = {r["obs_id"]: r["issue"] for r in review.calibrated_samples(df, spark.createDataFrame(bands, "obs_id int, band int, energies array<double>, pixel_points array<array<double>>"), spark.createDataFrame(cals, kinds)).collect()}
    assert got == {n: x for n, x in want.items() if x != "left out"}
    assert set(got.values()) == {None, review.SOURCE, review.UNITS, review.POINTS, review.MISSING, review.BOUNDS, review.ENERGY, review.K, review.UNUSABLE}


def test_queue_records_tell_the_first_problem(spark):
    def record(content='{"source":{"doi":"x"}}', **other):
        digest = hashlib.sha256((content or "").encode()).hexdigest()
        source = json.dumps(json.loads(content)["source"], separators=(",", ":")) if content and content[0] == "{" else None
        return tuple(({"record_id": f"mcp-audit-{digest[:20]}", "schema_version": 1, "intended_split": "train", "observations": content, "observation_sha256": digest, "source": source, "independent_human_review": None, "operator_authentication": None, "ai_prefilled": True} | other).values())

    rows = [
        (record(), None), (record(schema_version=2, intended_split="x"), "invalid pending review record"), (record(intended_split=None), "invalid pending review split"), (record(None), "missing pending observations"), (record("no json"), "missing pending observations"),
        (record(observation_sha256="0"), "pending observation SHA mismatch"), (record(observation_sha256=None), "pending observation SHA mismatch"), (record(record_id="mcp-audit-0"), "pending record ID mismatch"), (record(source=None), "pending source binding mismatch"),
        (record(independent_human_review="yes", ai_prefilled=False), "pending queue cannot contain human approval"), (record(operator_authentication="k"), "pending queue cannot contain operator authentication"), (record(ai_prefilled=None), "pending queue must identify AI-prefilled records"),
    ]
    df = spark.createDataFrame([r for r, _ in rows], "record_id string, schema_version int, intended_split string, observations string, observation_sha256 string, source string, independent_human_review string, operator_authentication string, ai_prefilled boolean")
    assert [r["problem"] for r in review.queue_records(df.coalesce(1)).collect()] == [p for _, p in rows]


@pytest.mark.parametrize("case", [([1.0, 0.0, 0.0], [0.1, 0.9], [0.2, 0.8], 1.0, "green"), ([1.0, 1.0, 1.0], [0.5, 0.5], [0.0, 1.0], 99.0, "red"), ([0.0, 0.0, 0.0], [], [1.0], None, "yellow"), ([8.0, 1.0, 1.0], [0.0, 4.0], [-1.0, 2.0], -0.05, "yellow")])
def test_prediction_confidence(case, spark):
    probs, valence, conduction, gap, level = case
    total = max(sum(probs), 1e-12)
    even = -sum(p / total * math.log(p / total + 1e-12) for p in probs) / math.log(3)
    sharp = min(0.0 if not x or max(x) <= 0 else min(1.0, max(0.0, 1 - sum(x) / len(x) / max(x))) for x in (valence, conduction))
    score = min(1.0, max(0.0, 0.45 * (1 - even) + 0.35 * sharp + 0.2 * (1.0 if gap is not None and -0.05 <= gap <= 15 else 0.3)))
    df = spark.createDataFrame([(probs, valence, conduction, gap)], "p array<double>, v array<double>, c array<double>, g double")
    got = df.select(metrics.prediction_confidence(*map(F.col, "pvcg")).alias("x")).first()["x"]
    assert got["score"] == pytest.approx(score) and got["entropy"] == pytest.approx(even) and got["peak_sharpness"] == pytest.approx(sharp)
    assert got["level"] == ("green" if score >= 0.6 else "yellow" if score >= 0.35 else "red") == level


def test_text_fingerprint(spark):
    df = spark.createDataFrame([([0.0, 1.0], [[1.5, -2.0], [0.0004, 3.0]]), ([0.0], [[1.0, 2.0]]), (None, [[1.0]]), ([0.0, 1.0], [[1.5, -2.0004], [0.0, 3.0]])], "k array<double>, e array<array<double>>")
    got = [r[0] for r in df.select(features.text_fingerprint(F.col("k"), F.col("e"))).collect()]
    assert got[0] == hashlib.sha256(b"(2, 3)0,1500,0;1000,-2000,3000").hexdigest() == got[3] and got[1] is got[2] is None


def test_declared_sizes_are_checked_under_both_names(spark):
    """Two defects at once give the first; without such columns nothing is asked."""
    base = {"source": "aflow", "source_schema": "aflow_bandsdata_v1", "band_layout": "bands_k", "source_semantics_evidence": "x", "energy_reference": "r", "spin_channels": 1, "spin_axis": None, "n_bands": 2, "num_bands": 2, "n_kpoints": 3, "num_kpoints": 3, "efermi": 0.0, "source_efermi_absolute": None, "content_sha256": None, "metadata": {}}
    cases = [({}, ""), ({"num_bands": 3}, "declared_num_bands_mismatch_or_illegal"), ({"num_kpoints": 2, "n_kpoints": 4}, "declared_n_kpoints_mismatch_or_illegal"), ({"num_kpoints": 2, "efermi": 1.0}, "declared_num_kpoints_mismatch_or_illegal"), ({"num_bands": None, "num_kpoints": None}, ""), ({"metadata": {"num_bands": "3"}}, "conflicting_source_metadata")]
    kinds = "source string, source_schema string, band_layout string, source_semantics_evidence string, energy_reference string, spin_channels int, spin_axis int, n_bands int, num_bands int, n_kpoints int, num_kpoints int, efermi double, source_efermi_absolute double, content_sha256 string, metadata map<string,string>"
    numbers = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    rows = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], kinds).coalesce(1).withColumns({"energies": F.array(numbers(1, 2, 3), numbers(4, 5, 6)), "k_distances": numbers(0, 1, 2), "kpoints": F.lit(None).cast("array<array<double>>")})
    assert [",".join(r["reasons"]) for r in contracts.source_quality(rows).collect()] == [x for _, x in cases]
    assert {r["status"] for r in contracts.source_quality(rows.drop("num_bands", "num_kpoints").filter("n_kpoints = 3 and efermi = 0")).collect()} == {"verified_valid"}
