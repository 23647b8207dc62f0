"""Invariants and published values on hand-made tables."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import keys as K
from bandloom.operators import bands as B
from bandloom.operators import figures as G
from bandloom.operators import geometry as X
from bandloom.operators import measure as M
from bandloom.operators import merge as J
from bandloom.operators import metrics as E
from bandloom.operators import quality as Q
from bandloom.operators import retrieval as R
from bandloom.operators import splits as S
from bandloom.operators import topk as T
from bandloom.sources import records as P
from bandloom.streaming import jobs as I

POINTS = "path_id int, band_id string, segment_id int, k_idx int, k double, energy double"
#: Published confusion matrix: rows are true classes.
GOLDEN = [[7788, 86, 197], [22, 941, 90], [162, 138, 2563]]


def curve(spark, bands, path=1, segment=lambda k: 0):
    return spark.createDataFrame([(path, name, segment(i), i, float(i), float(e) if e is not None else None) for name, es in bands.items() for i, e in enumerate(es)], POINTS)


def golden(spark):
    return spark.createDataFrame([(t, p, n) for t, row in enumerate(GOLDEN) for p, n in enumerate(row)], "y_true int, y_pred int, n int").withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "i")


def test_published_scores(spark):
    rows = golden(spark)
    got = E.accuracy(rows).first()
    assert got["n"] == 11987 and got["accuracy"] == pytest.approx(0.9420205, abs=1e-7) and got["macro_accuracy"] == pytest.approx(0.9179294, abs=1e-7)
    f1 = {r["cls"]: r for r in E.f1_scores(rows, 3).collect()}
    assert f1[0]["macro_f1"] == pytest.approx(0.9055516, abs=1e-7) and f1[1]["recall"] == pytest.approx(0.8936372, abs=1e-7)
    assert [r["n"] for r in E.confusion(rows, 3).orderBy("y_true", "y_pred").collect()] == [n for row in GOLDEN for n in row]


def test_unknown_leaves_the_denominator(spark):
    rows = spark.createDataFrame([(0, 0), (-1, 0), (None, 1), (1, 0)], "y_true int, y_pred int")
    got = E.accuracy(rows).first()
    assert (got["n"], got["accuracy"], got["unknown"]) == (2, 0.5, 2)


def test_gap_rules(spark):
    k = np.linspace(-1, 1, 24)
    bands = {"a": -k * k - 1, "b": -k * k - 0.02, "c": k * k + 1.01, "d": k * k + 2}
    got = B.path_gap(curve(spark, bands)).first()
    assert got["topology"] == "gapped" and got["gap"] == pytest.approx(float(min(bands["c"]) - max(bands["b"])))
    assert B.path_gap(curve(spark, {"a": [-1, 1, 2], "b": [3, 3, 3]})).first()["gap"] == 0.0
    # A change of sign only across a segment border is no crossing: the gap is unknown.
    split = B.path_gap(curve(spark, {"a": [-1, -1, 1, 1], "b": [3, 3, 3, 3]}, segment=lambda i: i // 2)).first()
    assert split["gap"] is None and split["topology"] == "unknown"
    flat = B.path_gap(curve(spark, {"a": [0, 0, 0]})).first()
    assert flat["gap"] is None


def test_golden_band_gap_and_metal(spark):
    got = B.path_gap(curve(spark, {"a": [-0.5] * 3, "b": [-1] * 3, "c": [2.5] * 3, "d": [4] * 3})).first()
    assert got["gap"] == 3.0
    g = spark.createDataFrame([(1, 0.0, 3.0), (2, None, None)], "path_id int, target double, pred double")
    s = M.gap_summary(g).first()
    assert (s["metals"], s["unknown"], s["resolved"], s["gap_mae"], s["false_gap_rate"], s["insulator_mae"]) == (1, 1, 1, 3.0, 1.0, None)


def test_crossings_skip_zeros_and_break_at_missing(spark):
    got = B.sign_crossings(curve(spark, {"a": [-1, 0, 1, None, -1, 1]})).orderBy("k_idx").collect()
    assert [(r["k_before"], r["k_idx"]) for r in got] == [(0, 2), (4, 5)]


def test_curvature_is_a_local_parabola(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=12)
    got = B.quadratic_curvature(curve(spark, {"a": e}, segment=lambda i: i // 6), ["path_id", "band_id", "segment_id"]).orderBy("k_idx").collect()
    for r in got:
        i, lo = r["k_idx"], r["k_idx"] // 6 * 6
        at = [j for j in range(i - 2, i + 3) if lo <= j < lo + 6]
        assert r["curvature"] == pytest.approx(2 * np.polyfit([j - i for j in at], e[at], 2)[0], abs=1e-8)


def test_resampling_keeps_shape(spark):
    y = [0, 0, 1, 1, 5, 2]
    got = [r["value"] for r in B.resample(curve(spark, {"a": y}), 51, ["path_id", "band_id"]).orderBy("cell").collect()]
    assert len(got) == 51 and got[0] == 0 and got[-1] == 2 and got[10] == 0 and got[40] == 5
    assert all(-1e-9 <= v <= 5 + 1e-9 for v in got) and all(abs(v) < 1e-9 for v in got[:11]) and all(b >= a - 1e-9 for a, b in zip(got[:40], got[1:41], strict=False))
    line = [r["value"] for r in B.resample(curve(spark, {"a": [1, 3]}), 5, ["path_id", "band_id"]).orderBy("cell").collect()]
    assert line == pytest.approx([1, 1.5, 2, 2.5, 3])
    assert [r["value"] for r in B.resample(curve(spark, {"a": [7]}), 3, ["path_id", "band_id"]).collect()] == [7, 7, 7]


def test_sorted_error_ignores_band_order(spark):
    rows = [(1, k, float(p), float(t)) for k in range(4) for p, t in ((1, 3), (2, 1), (3, 2))]
    got = B.sorted_mae(spark.createDataFrame(rows, "s int, k_idx int, pred double, target double"), ["s"]).first()
    assert got["sorted_mae"] == 0 and M.band_mae(spark.createDataFrame(rows, "s int, k_idx int, pred double, target double"), ["s"]).first()["mae"] > 1


def test_mesh_refuses_bad_weights(spark):
    rows = [("m", "v", 0, -1.0, 1.0, 0.5), ("m", "c", 0, 2.0, 0.0, 0.5), ("n", "v", 0, -1.0, 1.0, 0.9)]
    got = {r["mesh_id"]: r for r in M.measure_meshes(spark.createDataFrame(rows, "mesh_id string, band_id string, k_idx int, energy double, occupancy double, weight double")).collect()}
    assert got["m"]["status"] == "ok" and got["m"]["gap"] == 3.0 and got["m"]["direct_gap"] == 3.0 and got["n"]["status"] == "refused"


def test_keys(spark):
    row = spark.range(1).select(
        K.reduced_formula(F.lit("Na2Cl2")).alias("a"), K.element_set(F.lit("Na2Cl2")).alias("b"), K.reduced_formula(F.lit("??")).alias("c"), K.provider_time(F.lit("20150623_00:05:22_GMT-4")).cast("timestamp_ntz").alias("d"),
        K.provider_time(F.lit("2015")).alias("e"), K.csv_safe(F.lit(" =1")).alias("f"), K.csv_safe(F.lit("-ok")).alias("g"), K.csv_safe(F.lit("plain")).alias("h"), K.valid_elements(F.array(F.lit("Na"), F.lit("Zz"))).alias("i"),
    ).first()
    assert row["a"] == "Cl:1,Na:1" and row["b"] == "Cl-Na" and row["c"] == "unknown" and str(row["d"]) == "2015-06-23 04:05:22" and row["e"] is None
    assert row["f"] == "' =1" and row["g"] == "'-ok" and row["h"] == "plain" and row["i"] == []
    assert len(K.ELEMENTS) == 118


def test_lenient_json_leaves_strings_alone(spark):
    row = spark.range(1).select(P.lenient_json(F.lit('{"s": "a,]", "x": [1, 2,],}'), "struct<s:string,x:array<int>>").alias("j"), P.lenient_json(F.lit("{oops"), "struct<x:int>").alias("k")).first()
    assert row["j"]["s"] == "a,]" and row["j"]["x"] == [1, 2] and (row["k"] is None or row["k"]["x"] is None)


def test_random_split_is_exact(spark):
    for n, share in ((997, 0.8), (10, 0.5), (1, 0.5)):
        got = S.random_split(spark.range(n), "id", share, "s")
        assert got.filter("part = 'train'").count() == int(n * share + 0.5) and got.count() == n


def test_group_splits_are_disjoint_and_near(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 37).alias("g"), (F.col("id") % 3).alias("c"))
    for got in (S.group_split(rows, "g", 0.2, "a"), S.stratified_group_split(rows, "g", "c", 0.2, "a")):
        assert got.count() == 2000 and got.groupBy("g").agg(F.count_distinct("part").alias("p")).filter("p > 1").count() == 0
        assert abs(got.filter("part = 'test'").count() / 2000 - 0.2) < 0.03
        assert S.leakage(got.filter("part = 'train'"), got.filter("part = 'test'"), "id", "g").first() == (0, 0)


def test_temporal_split_is_in_order(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 9 > 0, F.timestamp_seconds(F.col("id") * 7919 % 100_000 * 60)).alias("t"))
    got = S.temporal_split(rows, "id", "t", 0.75)
    part = {r["part"]: r for r in got.groupBy("part").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).collect()}
    assert part["train"]["b"] < part["test"]["a"] and part["excluded"]["a"] is None and abs(part["train"]["n"] / (part["train"]["n"] + part["test"]["n"]) - 0.75) < 0.01


def test_bootstrap_of_one_group_has_no_interval(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (1, 0, "a")], "y_true int, y_pred int, g string")
    got = E.group_bootstrap(rows, "g", 20, "s").first()
    assert got["groups"] == 1 and got["low"] is None and got["mean"] == 0.5


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.1)], "positive boolean, score double")
    assert E.roc_auc(rows).first()["auc"] == pytest.approx(0.875) and E.roc_auc(rows.filter("positive")).first()["auc"] is None


def test_backfill_is_idempotent_and_never_downgrades(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "q")], "id int, p string, q string")
    b = spark.createDataFrame([(1, "y", "z"), (3, "n", None)], "id int, p string, q string")
    once = J.backfill(a, b, "id")
    rows = {r["id"]: r for r in once.collect()}
    assert (rows[1]["p"], rows[1]["q"], rows[1]["filled"], rows[1]["blocked"], rows[3]["new"]) == ("x", "z", 1, 1, True)
    again = J.backfill(once.select("id", "p", "q"), b, "id")
    assert again.select("id", "p", "q").exceptAll(once.select("id", "p", "q")).count() == 0 and again.agg(F.sum("filled")).first()[0] == 0


def test_lattice_round_trip(spark):
    cells = spark.createDataFrame([(4.0, 4.0, 4.0, 90.0, 90.0, 90.0), (5.281256, 5.220942, 5.400221, 80.31969, 90.0, 90.0), (1.0, 1.0, 1.0, 10.0, 10.0, 170.0)], "a double, b double, c double, al double, be double, ga double")
    vs = X.lattice_from_cell(*[F.col(c) for c in cells.columns])
    rows = cells.select(*[x.alias(f"{p}{d}") for p, v in zip("abc", vs, strict=True) for d, x in zip("xyz", v, strict=True)])
    got = rows.select(*[v.alias(k) for k, v in X.cell_from_lattice(*[tuple(F.col(f"{p}{d}") for d in "xyz") for p in "abc"]).items()]).collect()
    assert [got[1][k] for k in ("a", "b", "c", "alpha", "beta", "gamma")] == pytest.approx([5.281256, 5.220942, 5.400221, 80.31969, 90, 90])
    assert got[2]["a"] is None and rows.first()["by"] == pytest.approx(4) and rows.first()["cz"] == pytest.approx(4)


def test_periodic_neighbours_of_a_simple_cube(spark):
    cell = spark.createDataFrame([("m", 2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0)], "material_id string, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    atom = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0)], "material_id string, atom int, fx double, fy double, fz double")
    got = X.periodic_neighbours(atom, cell, 4.0, 12).collect()
    assert sorted(round(r["dist"], 6) for r in got) == [2.0] * 6 + [2.828427] * 6 and all((r["i"], r["j"], r["k"]) != (0, 0, 0) for r in got)
    assert [r["tie"] for r in got if r["rank"] == 12] == [True]
    assert X.periodic_neighbours(atom, cell, 2.1, 12).count() == 6


def test_retrieval_of_itself(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(5)]) for i in range(5)] + [(9, [0.0] * 5)], "id long, v array<double>")
    got = R.rank_metrics(R.match_facts(v, v, blocks=3)).first()
    assert got["queries"] == 5 and got["recall_1"] == got["mrr"] == got["median_rank"] == 1
    assert R.gallery_check(v, 5).collect()[0]["problem"] == "zero or not finite"


def test_box_rules(spark):
    b = lambda *x: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(x, ("x1", "y1", "x2", "y2"), strict=True)])
    row = spark.range(1).select(G.iou(b(0, 0, 2, 2), b(1, 1, 3, 3)).alias("a"), G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)).alias("z")).first()
    assert row["a"] == pytest.approx(1 / 7) and row["z"] == 0
    lic = spark.createDataFrame([("CC BY 4.0",), ("cc-by-nc",), ("https://creativecommons.org/licenses/by/3.0/",), (None,), ("CC0",)], "v string")
    assert [r[0] for r in lic.select(G.license_of(F.col("v"))[0]).collect()] == ["CC-BY", None, "CC-BY", None, None]


def test_figures_of_an_article(spark):
    xml = '<a><fig id="F1"><label>1</label><caption><p>Electronic band structure</p></caption><graphic xlink:href="x/f1.jpg"/></fig><fig id="F2"><caption>Photonic band structure</caption></fig></a>'
    got = P.figures_of(spark.createDataFrame([("p", xml)], "id string, x string"), "id", "x")
    assert [(r["figure_id"], r["asset"]) for r in got.orderBy("n").collect()] == [("F1", "f1.jpg"), ("F2", "")]
    kept = got.filter(F.col("caption").rlike(r"(?i)\bband structure\b") & ~F.col("caption").rlike(r"(?i)\bphotonic\b"))
    assert [r["figure_id"] for r in kept.collect()] == ["F1"]


def test_structure_text(spark):
    text = "t\n2.0\n1 0 0\n0 1 0\n0 0 1\nNa Cl\n1 1\nDirect\n0 0 0\n0.5 0.5 0.5\n"
    rows = spark.createDataFrame([("d", text), ("c", text.replace("Direct", "Cartesian")), ("b", "x\n1\n")], "id string, t string")
    got = {r["id"]: r for r in P.poscar(rows, "id", "t").collect()}
    assert got["d"]["species"] == ["Na", "Cl"] and got["d"]["fractional"][1] == [0.5, 0.5, 0.5] and got["c"]["fractional"][1] == pytest.approx([0.5, 0.5, 0.5]) and got["b"]["status"] == "too short"


def test_assets_are_bound_by_digest(spark, tmp_path):
    import hashlib

    (tmp_path / "a.png").write_bytes(b"one")
    (tmp_path / "b.png").write_bytes(b"two")
    listed = spark.createDataFrame([("a.png", hashlib.sha256(b"one").hexdigest()), ("b.png", "0"), ("c.png", "0")], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in P.assets(spark, str(tmp_path), listed).collect()} == {"a.png": "bound", "b.png": "changed", "c.png": "missing"}


def test_commit_statuses(spark):
    stored = spark.createDataFrame([(1, "a", True), (1, "b", False)], "id int, digest string, canonical boolean")
    batch = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "c", 3), (2, "x", 4), (2, "x", 5)], "id int, digest string, seq int")
    got = [r["status"] for r in I.commit_status(batch, stored, "id", "digest", "seq").orderBy("seq").collect()]
    assert got == ["duplicate", "duplicate_variant", "variant", "duplicate_variant", "canonical", "duplicate"]


def test_quota_and_sample_sizes(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 30, 0).when(F.col("id") < 300, 1).otherwise(2).alias("bin"))
    got = T.quota_by_bin(rows, "id", "bin", 3, 200, "s")
    assert got.count() == 200 and got.select("id").distinct().count() == 200 and got.filter("bin = 0").count() == 30
    assert T.seeded_sample(rows, "id", 77, "s").count() == 77


def test_status_order(spark):
    row = spark.range(1).select(Q.worst_status([F.lit("ambiguous"), F.lit("read_error"), F.lit("valid")]).alias("a"), Q.worst_status([F.lit("invalid"), F.lit("read_error")]).alias("b")).first()
    assert row["a"] == "read_error" and row["b"] == "invalid"


def test_entry_lists_everything():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and json.dumps(sorted(names))


def test_shuffles_in_blocks_are_the_plain_order(spark):
    """Ranks and running sums put together from blocks of any size are those of one sort a trial."""
    rows = spark.createDataFrame([(f"g{i}", i % 7 + 1) for i in range(60)], "g string, n long")
    want = {}
    for t in range(3):
        order = sorted((hashlib.md5(f"s|{t}|g{i}".encode()).hexdigest(), f"g{i}", i % 7 + 1) for i in range(60))
        for k, (_, g, _) in enumerate(order):
            want[t, g] = k + 1, sum(n for _, _, n in order[: k + 1])
    for block in (1, 7, 1000):
        got = S.shuffles(rows, "g", "s", 3, block).collect()
        assert {(r["trial"], r["g"]): (r["rank"], r["upto"]) for r in got} == want


def test_stratified_search_scores_every_cut(spark):
    """The chosen cut has the least score of all shuffles and of seven cuts around the wanted share."""
    rng = np.random.default_rng(0)
    data = [(f"g{i}", str(c)) for i in range(12) for c in rng.choice(3, rng.integers(1, 9), p=[0.7, 0.2, 0.1])]
    rows = spark.createDataFrame(data, "g string, c string")
    got = S.stratified_group_split(rows, "g", "c", 0.3, "s")
    chosen = {r["g"] for r in got.filter("part = 'test'").select("g").distinct().collect()}
    n, classes = len(data), sorted({c for _, c in data})

    def score(side):
        test = [c for g, c in data if g in side]
        lost = sum((test.count(c) == 0) + (test.count(c) == [x for _, x in data].count(c)) for c in classes)
        off = np.mean([abs(test.count(c) / len(test) - [x for _, x in data].count(c) / n) for c in classes])
        return round(abs(len(test) / n - 0.3) + 0.35 * off + 2 * lost, 12)

    scores = []
    for t in range(256):
        order = sorted({g for g, _ in data}, key=lambda g: (hashlib.md5(f"s|{t}|{g}".encode()).hexdigest(), g))
        upto = np.cumsum([sum(x == g for x, _ in data) for g in order])
        centre = int(np.abs(upto - 0.3 * n).round(9).argmin()) + 1
        scores += [score(set(order[: max(1, min(11, centre + d))])) for d in range(-3, 4)]
    assert score(chosen) == min(scores)


def test_manifest_tells_what_is_not_there(spark):
    part = lambda *p: spark.createDataFrame([(i, x) for i, x in enumerate(p)], "id int, part string")
    got = {r["split"]: r for r in S.split_manifest({"a": part("train", "test", "excluded", "test"), "b": part("test", "test")}, "id", {"a": "x", "b": "y", "c": "z"}, {"c": "no dates"}).collect()}
    assert (got["a"]["status"], got["a"]["num_test"], got["a"]["num_excluded"], got["a"]["test_fraction"]) == ("available", 2, 1, 0.5)
    assert got["b"]["status"] == got["c"]["status"] == "unavailable" and got["c"]["reason"] == "no dates" and got["b"]["reason"]
