"""Composed features against numpy on hand-made curves."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import POINTS, curve

from bandloom.operators import features as X


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        for _ in range(8):
            c = rng.random((n, n)).round(1)
            assert X.assignment(c) == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_matching_costs_are_ordered(spark):
    rng = np.random.default_rng(2)
    rows = [(1, b, k // 3, k, float(rng.normal()), float(rng.normal())) for b in range(4) for k in range(6)]
    df = spark.createDataFrame(rows, "sample_id int, band int, segment_id int, k_idx int, pred double, target double")
    r = X.trajectory_matching(df).first()
    assert r["status"] == "ok" and r["transport"] <= r["by_segment"] + 1e-12 <= r["overall"] + 2e-12 <= r["slot"] + 3e-12
    assert X.trajectory_matching(df, budget=5).first()["status"] == "over budget"
    assert X.trajectory_matching(df.filter("not (band = 1 and k_idx = 2)")).first()["status"] == "incomplete"


def test_edge_features_of_parabolas(spark):
    k = np.arange(9.0)
    p = curve(spark, {"v": -((k - 4) ** 2) - 1, "c": (k - 6) ** 2 + 1})
    got = X.edge_features(p, 17).toPandas().sort_values(["edge", "cell"])
    v, c = got[got.edge == "vbm"], got[got.edge == "cbm"]
    assert v.energy.max() == -1 and int(v.cell[v.energy.idxmax()]) == 8 and int(c.cell[c.energy.idxmin()]) == 12 and (v.energy <= 0).all() and (c.energy >= 0).all()
    assert v.distance.iloc[0] == -0.5 and v.distance.iloc[-1] == 0.5
    lone = spark.createDataFrame([(1, "v", 0, 0, 0.0, -1.0), (1, "v", 0, 1, 1.0, -1.0), (1, "c", 0, 0, 0.0, 1.0)], POINTS)
    assert X.edge_features(lone, 5).count() == 0


def test_extraction_stays_in_segments(spark):
    p = curve(spark, {"a": [-1, -2, -1, -5, -6, -5], "b": [1, 2, 1, 5, 6, 5], "far": [99] * 6}, segment=lambda i: i // 3)
    got = X.extract_bands(p, 2, 10.0, 5).toPandas()
    assert set(got.band_id) == {"a", "b"} and len(got) == 2 * 2 * 5 and got.groupby(["band_id", "segment_id"]).value.agg(lambda v: v.abs().max()).tolist() == [2, 6, 2, 6]
    audit = X.resampling_audit(p, 2, 10.0, 5)
    assert {r["stage"] for r in audit.collect()} == {"raw_full", "raw_selected", "resampled"}


def test_directional_mass(spark):
    k = np.arange(9.0)
    good = X.directional_mass(curve(spark, {"c": 0.5 * (k - 4) ** 2 + 1, "far": np.full(9, 50.0)}), True).collect()
    by = {r["band_id"]: r for r in good}
    assert by["c"]["reason"] == "local quadratic fit" and by["c"]["mass"] == pytest.approx(1.0) and by["far"]["mass"] is None
    hole = X.directional_mass(curve(spark, {"v": -2.0 * (k - 4) ** 2}), False).first()
    assert hole["mass"] == pytest.approx(0.25)
    reason = lambda bands, **kw: X.directional_mass(curve(spark, bands, **kw), True).filter("band_id = 'c'").first()["reason"]
    assert reason({"c": (k - 1) ** 2}) == "end of segment"
    assert reason({"c": (k - 4) ** 2}, segment=lambda i: int(i > 4)) == "end of segment"
    assert reason({"c": (k - 4) ** 2, "x": np.full(9, 2.0)}) == "branch not isolated"
    assert reason({"c": np.abs(k - 4)}) == "not quadratic"


def test_content_fingerprint_is_byte_exact(spark):
    k, e = [0.0, 0.5, 1.0], [[-1.0, -1.5, -1.0], [1.0, 2.0, 1.0]]
    df = spark.createDataFrame([(k, e), (k, [[1.0]]), (None, e)], "k array<double>, e array<array<double>>")
    table = np.column_stack([k, *e]).astype("<f4")
    want = hashlib.sha256(b"(3, 3)" + table.tobytes()).hexdigest()
    assert [r[0] for r in df.select(X.content_fingerprint(F.col("k"), F.col("e"))).collect()] == [want, None, None]


def test_mesh_documents(spark):
    xml = '<mesh><generation param="Gamma"/><weights>1.0</weights><spin n="1"><kpoint n="1"><r>-1.0 1.0</r><r>2.0 0.0</r></kpoint></spin></mesh>'
    rows = spark.createDataFrame([("a", xml), ("b", "<!DOCTYPE x>" + xml), ("c", xml.replace("Gamma", "list")), ("d", "<mesh/>")], "id string, t string")
    got = X.mesh_of_xml(rows, "id", "t").collect()
    assert [(r["energy"], r["occupancy"]) for r in got if r["id"] == "a"] == [(-1.0, 1.0), (2.0, 0.0)]
    assert {r["id"]: r["status"] for r in got} == {"a": "ok", "b": "entities", "c": "not a uniform mesh", "d": "not a uniform mesh"}
