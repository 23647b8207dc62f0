"""What the findings of round 4 were about, on the least input that shows it."""

import duckdb
import numpy as np

from pyspark.sql import functions as F

from bandloom import catalog
from bandloom.llm import vector_graph
from bandloom.operators import retrieval
from bandloom.plans import bands


def test_a_vector_goes_to_few_cells_over_all_levels(spark, monkeypatch):
    """guests of a level are no multiple of the last one's, vectors stay floats, and links across borders are found once."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(2500, 64))
    x = (base[rng.integers(0, 2500, 5000)] + rng.normal(size=(5000, 64)) * rng.choice([0.03, 0.1], (5000, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    seen, cells_of = [], vector_graph.cells_of
    monkeypatch.setattr(vector_graph, "cells_of", lambda *a: seen.append(cells_of(*a)) or seen[-1])
    got = {r["id"]: r["n_links"] for r in vector_graph.near_links(df, shard_rows=200).collect()}
    assert seen[0].schema["v"].dataType.simpleString() == "array<float>" and seen[0].count() < 5 * 5000
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    n = np.array([got[i] for i in range(5000)])
    assert want.sum() > 5000 and (n <= want).all() and n.sum() >= 0.99 * want.sum()


def test_a_pair_counts_in_one_cell():
    """of two cells that share a pair, the home of one of them with the other as a guest; the first, if both are that."""
    homes, guests = np.array([[0], [1], [1], [2]]), [np.array([[1, -1], [0, 2], [-1, -1], [0, 1]])]
    pairs, times = [(0, 1), (0, 2), (1, 2), (0, 3), (1, 3)], []
    for a, b in pairs:
        cells = [set(homes[i].tolist()) | set(guests[0][i].tolist()) - {-1} for i in (a, b)]
        times.append([c for c in cells[0] & cells[1] if vector_graph.counted_here(f".{c}", homes, guests, np.array([a]), np.array([b]))[0]])
    assert times == [[0], [1], [1], [0], [1]]


def test_ties_are_rounded_as_the_sql_does(spark):
    """11.096953125, a difference of splines at eighths, comes out one bit low and is a tie all the same."""
    rng = np.random.default_rng(10)
    values = [11.096953124999999, -11.096953124999999, 0.0, 1e300, 5e-9, 2.5, *(rng.integers(-(10**6), 10**6, 300) / 512 * 0.01 * (1 - 2.0**-53)).tolist()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(CAST(? AS DOUBLE), 8)", [v]).fetchone()[0] for v in values]
    got = bands.r8(spark.createDataFrame(list(enumerate(values)), "i int, v double").coalesce(1), "v").orderBy("i").collect()
    assert want[0] == 11.09695313 and [r["v"] for r in got] == want


def test_every_vector_is_a_query_both_ways(spark, sf):
    """all rows are ranked, not every fiftieth."""
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert {r["direction"]: r["queries"] for r in catalog.queries()["ag19_both_directions"](spark, sf).collect()} == {"a_to_b": n, "b_to_a": n}


def test_ranks_both_ways_from_one_product(spark):
    """copies, a zero vector, vectors of two lengths, rows without a partner or an id, and chosen ones only, in small blocks."""
    rng = np.random.default_rng(11)
    base = [rng.normal(size=6 if i % 4 else 4) for i in range(12)]
    sides = [[(i, (base[i % 12] + (rng.integers(0, 3) * shift)).tolist()) for i in ids] + [(200 + k, [0.0] * 6), (None, base[1].tolist()), (210, None)] for k, (ids, shift) in enumerate(((range(100), 0.0), (range(10, 120), 0.25)))]
    a, b = (spark.createDataFrame(x, "id long, v array<double>") for x in sides)
    unit = lambda v: None if not v or not any(v) else [x / np.sqrt(sum(y * y for y in v)) for x in v]
    want = {}
    for way, (mine, other) in (("a_to_b", sides), ("b_to_a", sides[::-1])):
        known = [(j, unit(w)) for j, w in other if unit(w)]
        for i, v in mine:
            own = next((w for j, w in known if j == i and i is not None and len(w) == len(v)), None)
            if own and i % 3:
                mark = lambda w: round(sum(x * y for x, y in zip(unit(v), w, strict=True)), 9)  # noqa: B023, E731
                want[way, i] = 1 + sum(mark(w) > mark(own) or (mark(w) == mark(own) and j is not None and j < i) for j, w in known if len(w) == len(v))
    for most in (30, 64_000):
        got = {(r["direction"], r["query"]): r["rank"] for r in retrieval.both_ranks(a, b, F.col("id") % 3 != 0, most=most).collect()}
        assert got == want and len(want) == 120
