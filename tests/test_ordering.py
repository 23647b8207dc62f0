"""Distributed ranks and sums, the as-of match, cell lists and rank counting, against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bandloom.operators import bands, geometry, metrics, ordering, retrieval, splits, topk


def test_ranks_of_a_million_ids_with_one_prefix(spark):
    """One group, all ids alike at the head: more than 100 tasks, equal to the order of the ids."""
    ids = spark.range(1_000_000).select(F.lit("all").alias("g"), F.format_string("aflow-%07d", "id").alias("key"), "id")
    rows = ids.repartition(8, F.xxhash64("id"))
    parts = ordering.dealt(rows, ["g"], [F.col("key")], 128).select(F.shiftright("__at", 33).alias("p")).groupBy("p").count()
    assert parts.count() > 100 and parts.agg(F.max("count")).first()[0] < 40_000
    assert ordering.placed(rows, ["g"], [F.col("key")], "place", 128).filter("place <> id + 1").isEmpty()


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_ranks_with_an_outlier_nulls_and_many_kinds(parts, spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, f"k{i % 1000}"]), rng.choice([float(i), None if i % 50 == 0 else i / 7]), i) for i in range(3000)]
    rows += [("a", 1e300, 3000), ("a", -1e300, 3001)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    got = {r["i"]: r["place"] for r in ordering.placed(df, ["g"], [F.col("x").desc(), F.col("i")], "place", parts).collect()}
    groups = defaultdict(list)
    for g, x, i in rows:
        groups[g].append((x is None, -(x or 0.0), i))
    assert got == {i: k for had in groups.values() for k, (*_, i) in enumerate(sorted(had), 1)}
    sums = {r["i"]: (r["s"], r["n"]) for r in ordering.running(df.withColumn("one", F.lit(1)), ["g"], [F.col("x").desc(), F.col("i")], {"s": "i", "n": "one"}, parts).collect()}
    assert sums == {i: (sum(v[2] for v in sorted(had)[:k]), k) for had in groups.values() for k, (*_, i) in enumerate(sorted(had))}


def test_ranks_of_an_empty_table_and_of_equal_keys(spark):
    assert ordering.placed(spark.createDataFrame([], "g string, x int"), ["g"], [F.col("x")], "place").count() == 0
    got = ordering.placed(spark.createDataFrame([("g", 1)] * 50, "g string, x int"), ["g"], [F.col("x")], "place", 4)
    assert sorted(r["place"] for r in got.collect()) == [*range(1, 51)]


def test_diverse_order_and_stride_of_one_group(spark):
    """A group of one kind, and a group of a thousand kinds."""
    rows = [(f"mp-{i:05d}", g, f"t{i % kinds}") for g, kinds in (("one", 1), ("many", 1000)) for i in range(2500)]
    df = spark.createDataFrame(rows, "id string, g string, t string")
    got = {(r["g"], r["id"]): (r["turn"], r["round"]) for r in topk.diverse_order(df, "g", "t", "id").collect()}
    for g, kinds in (("one", 1), ("many", 1000)):
        mine = [(i // kinds + 1, f"t{i % kinds}", f"mp-{i:05d}") for i in range(2500)]
        assert all(got[g, key] == (turn, k) for k, (turn, _, key) in enumerate(sorted(mine), 1))
    val = {(r["g"], r["id"]) for r in splits.stride_split(df, "g", "id", 5).filter("part = 'val'").collect()}
    assert val == {(g, f"mp-{i:05d}") for g in ("one", "many") for i in range(0, 2500, 5)}


def test_auc_of_scores_in_one_cell(spark):
    """Scores between 0.500 and 0.501 only, with ties: several ranges, equal to counting pairs."""
    rng = random.Random(2)
    rows = [(rng.random() < 0.3, 0.5 + rng.randrange(900) / 1e6) for _ in range(2000)]
    got = metrics.roc_auc(spark.createDataFrame(rows, "positive boolean, score double"), parts=16).first()
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    won = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert math.isclose(got["auc"], won / len(pos) / len(neg), rel_tol=1e-12) and (got["positives"], got["negatives"]) == (len(pos), len(neg))
    assert metrics.roc_auc(spark.createDataFrame([(True, 0.1)], "positive boolean, score double")).first()["auc"] is None


def test_nearest_sample_is_as_of(spark):
    rng = random.Random(3)
    points = [(p, k, float(rng.randrange(12))) for p in range(30) for k in range(rng.randrange(0, 9))]
    labels = [(p, f"l{j}", rng.randrange(-4, 30) / 2) for p in range(31) for j in range(4)] + [(0, "l0", 1.0)]
    got = bands.nearest_sample(spark.createDataFrame(labels, "path_id int, label string, label_k double"), spark.createDataFrame(points, "path_id int, k_idx int, k double"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for p, name, at in labels:
        if near := [(abs(k - at), i) for q, i, k in points if q == p]:
            off, i = min(near)
            want[p, name, at, i, off] += 1
    assert Counter(tuple(r) for r in got.collect()) == want


def brute_neighbours(atoms, cell, radius, most):
    span = range(-12, 13)
    out = []
    for s, f in atoms:
        near = []
        for (d, g), *image in itertools.product(atoms, span, span, span):
            u = [g[n] + image[n] - f[n] for n in range(3)]
            xyz = [sum(u[m] * cell[m][n] for m in range(3)) for n in range(3)]
            dist = math.sqrt(sum(v * v for v in xyz))
            if dist <= radius and not (s == d and dist < 0.01):
                near.append((round(dist, 9), d, *image))
        near.sort()
        out += [(s, d, *image, rank, dist, rank == most and len(near) > most and near[most][0] == dist) for rank, (dist, d, *image) in enumerate(near[:most], 1)]
    return sorted(out)


def test_periodic_neighbours_by_cells(spark):
    """Small, large, flat and skew cells; atoms at the border and outside the cell."""
    rng = random.Random(4)
    cells = {1: ([2.5, 0, 0], [0, 2.5, 0], [0, 0, 2.5]), 2: ([3, 0, 0], [1.4, 2.9, 0], [-1.1, 0.7, 7]), 3: ([9, 0, 0], [0, 11, 0], [3, 0, 10]), 4: ([1.9, 0, 0], [0, 14, 0], [0, 2, 6])}
    atoms = {1: [(0, (0, 0, 0))], 2: [(0, (0, 0, 0)), (1, (0.5, 0.5, 1.0)), (2, (-0.25, 1.75, 0.3))], 3: [(i, tuple(rng.random() for _ in range(3))) for i in range(6)], 4: [(0, (0.999999, 0, 0.5)), (1, (0.1, 0.9, 0.5))]}
    flat = [(m, i, *map(float, f)) for m, had in atoms.items() for i, f in had]
    frame = [(m, *[float(x) for v in cell for x in v]) for m, cell in cells.items()]
    got = geometry.periodic_neighbours(spark.createDataFrame(flat, "material_id int, atom int, fx double, fy double, fz double"), spark.createDataFrame(frame, "material_id int, " + ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz")), 6.0, 12)
    rows = defaultdict(list)
    for r in got.collect():
        rows[r["material_id"]].append((r["src"], r["dst"], r["i"], r["j"], r["k"], r["rank"], round(r["dist"], 9), r["tie"]))
    for m in cells:
        assert sorted(rows[m]) == brute_neighbours(atoms[m], cells[m], 6.0, 12)


def test_own_ranks_both_ways(spark):
    rng = random.Random(5)
    a = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    b = [(i, [x + rng.gauss(0, 0.8) for x in v]) for i, v in a[:-5]] + [(90, [0.0] * 6), (91, None)]
    frames = [spark.createDataFrame(x, "id int, v array<double>") for x in (a, b)]
    unit = lambda v: None if not v or not any(v) else [x / math.sqrt(sum(y * y for y in v)) for x in v]
    for q, g, df, other in ((a, b, *frames), (b, a, *frames[::-1])):
        known = {i: unit(v) for i, v in g if unit(v)}
        got = {r["query"]: (r["rank"], r["loss"]) for r in retrieval.match_facts(df, other, parts=3).collect()}
        assert set(got) == {i for i, v in q if unit(v) and i in known}
        for i, v in q:
            if i in got:
                score = {j: sum(x * y for x, y in zip(unit(v), w, strict=True)) for j, w in known.items()}
                assert got[i][0] == 1 + sum((round(s, 9), -j) > (round(score[i], 9), -i) for j, s in score.items())
                assert math.isclose(got[i][1], math.log(sum(math.exp((s - score[i]) / 0.07) for s in score.values())), rel_tol=1e-9)
    both = {r["direction"]: r["queries"] for r in retrieval.both_directions(*frames, F.lit(True)).collect()}
    assert both == {"a_to_b": 55, "b_to_a": 55}
