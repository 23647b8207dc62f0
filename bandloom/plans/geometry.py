"""Queries on geometry, graphs and vectors; structures are derived from part, vectors are embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import geometry as G
from ..operators import retrieval as R
from ..registry import query, read
from .keys import PARTS_SQL, formulas

CELL = "s AS (SELECT p_partkey AS id, CAST(3.0 + p_size % 5 * 0.5 AS DOUBLE) AS a, CAST(4.0 + p_partkey % 7 * 0.25 AS DOUBLE) AS b, CAST(5.0 + p_partkey % 3 AS DOUBLE) AS c, CAST(90.0 AS DOUBLE) AS al, CAST(90.0 + p_size % 3 * 5 AS DOUBLE) AS be, CAST(CASE WHEN p_partkey % 50 = 0 THEN 181.0 ELSE 90.0 + p_partkey % 4 * 10 END AS DOUBLE) AS ga FROM part)"
LAT = CELL + """, t AS (SELECT *, cos(radians(al)) AS ca, cos(radians(be)) AS cb, cos(radians(ga)) AS cg, sin(radians(ga)) AS sg FROM s), u AS (SELECT *, c * (ca - cb * cg) / sg AS cy FROM t), w AS (SELECT *, c * c - c * c * cb * cb - cy * cy AS sq FROM u),
l AS (SELECT id, a, b * cg AS bx, b * sg AS b_y, c * cb AS cx, cy, sqrt(greatest(sq, 0)) AS cz, sg > 1e-9 AND sq > 1e-12 AS ok FROM w)"""


def cells(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    return p.select(k.alias("id"), (3.0 + z % 5 * 0.5).alias("a"), (4.0 + k % 7 * 0.25).alias("b"), (5.0 + k % 3).alias("c"), F.lit(90.0).alias("al"), (90.0 + z % 3 * 5).alias("be"), F.when(k % 50 == 0, 181.0).otherwise(90.0 + k % 4 * 10).alias("ga"))


def lattices(spark, sf_dir):
    rows = cells(spark, sf_dir)
    vs = G.lattice_from_cell(*[F.col(c) for c in ("a", "b", "c", "al", "be", "ga")])
    return rows.select("id", *[x.alias(f"{p}{d}") for p, v in zip("abc", vs, strict=True) for d, x in zip("xyz", v, strict=True)])


def vectors():
    return [tuple(F.col(f"{p}{d}") for d in "xyz") for p in "abc"]


@query("fn5_lattice", f"WITH {LAT} SELECT id, CASE WHEN ok THEN round(a, 8) END AS ax, CASE WHEN ok THEN round(bx, 8) + 0 END AS bx, CASE WHEN ok THEN round(b_y, 8) END AS b_y, CASE WHEN ok THEN round(cx, 8) + 0 END AS cx, CASE WHEN ok THEN round(cy, 8) + 0 END AS cy, CASE WHEN ok THEN round(cz, 8) END AS cz FROM l")
def _fn5(spark, sf_dir):
    r = lambda c, n=None: (F.round(c, 8) + F.lit(0)).alias(n or c)
    return lattices(spark, sf_dir).select("id", r("ax"), r("bx"), r("by", "b_y"), r("cx"), r("cy"), r("cz"))


@query("fn6_reciprocal", f"WITH {LAT} SELECT id, round(a * b_y * cz, 6) AS volume, round(2 * pi() / a, 8) AS g1x, round(2 * pi() / cz, 8) AS g3z FROM l WHERE ok")
def _fn6(spark, sf_dir):
    volume, (g1, _, g3) = G.reciprocal(*vectors())
    return lattices(spark, sf_dir).filter("ax is not null").select("id", F.round(volume, 6).alias("volume"), F.round(g1[0], 8).alias("g1x"), F.round(g3[2], 8).alias("g3z"))


@query("fn7_cell_parameters", f"WITH {LAT} SELECT s.id, round(s.a, 6) AS a, round(s.b, 6) AS b, round(s.c, 6) AS c, round(al, 6) AS alpha, round(be, 6) AS beta, round(ga, 6) AS gamma FROM s JOIN l USING (id) WHERE ok")
def _fn7(spark, sf_dir):
    got = {k: v for k, v in G.cell_from_lattice(*vectors()).items() if k != "volume"}
    return lattices(spark, sf_dir).filter("ax is not null").select("id", *[F.round(v, 6).alias(k) for k, v in got.items()])


@query("fn8_group_buckets", "SELECT p_partkey AS id, CAST(list_position([least(7, floor(log2(p_size))) = i for i in range(8)], true) - 1 AS INT) AS bucket FROM part")
def _fn8(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.array_position(G.group_bucket(F.col("p_size")), 1) - 1).cast("int").alias("bucket"))


@query("fn9_dense_path", """WITH g AS (SELECT l_orderkey AS path_id, l_linenumber AS segment, l_quantity AS x1, l_discount * 100 AS y1, 0.0 AS z1, l_quantity + 3 AS x2, l_discount * 100 + l_linenumber AS y2, 1.0 AS z2, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS r FROM lineitem),
s AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2 + (z2 - z1) ** 2) AS len FROM g WHERE r = 1), o AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY path_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM s), i AS (SELECT *, unnest(range(5)) AS i FROM o)
SELECT path_id, segment, CAST(i AS INT) AS i, round(x1 + i / 4 * (x2 - x1), 8) AS x, round(y1 + i / 4 * (y2 - y1), 8) AS y, round(z1 + i / 4 * (z2 - z1), 8) AS z, round(st + i / 4 * len, 8) AS distance FROM i""")
def _fn9(spark, sf_dir):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    g = read(spark, sf_dir, "lineitem").withColumn("r", r).filter("r = 1")
    g = g.select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("segment"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), F.lit(0.0).alias("z1"), (F.col("l_quantity") + 3).alias("x2"), (F.col("l_discount") * 100 + F.col("l_linenumber")).alias("y2"), F.lit(1.0).alias("z2"))
    return G.dense_path(g, 5).withColumns({c: F.round(c, 8) for c in ("x", "y", "z", "distance")})


@query("fn10_rbf", "SELECT event_id, round(exp(-(((value / 60 - 7 * 8.0 / 39) / (8.0 / 39)) ** 2)), 10) AS g7, round(list_sum([exp(-(((value / 60 - i * 8.0 / 39) / (8.0 / 39)) ** 2)) for i in range(40)]), 8) AS total FROM events")
def _fn10(spark, sf_dir):
    g = G.rbf(F.col("value") / 60)
    return read(spark, sf_dir, "events").select("event_id", F.round(F.get(g, F.lit(7)), 10).alias("g7"), F.round(F.aggregate(g, F.lit(0.0), lambda s, x: s + x), 8).alias("total"))


@query("fn11_unit_vectors", "WITH n AS (SELECT vec_id, sqrt(list_sum([CAST(x AS DOUBLE) ** 2 for x in embedding])) AS n, embedding AS e FROM embeddings) SELECT vec_id, round(CAST(e[1] AS DOUBLE) / n, 9) AS first, round(CAST(e[64] AS DOUBLE) / n, 9) AS last FROM n")
def _fn11(spark, sf_dir):
    u = G.unit_vector(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(u, F.lit(0)), 9).alias("first"), F.round(F.get(u, F.lit(63)), 9).alias("last"))


def elements(spark):
    """One row an element: symbol, atomic number, and a property derived from it."""
    return spark.createDataFrame([(s, z) for z, s in enumerate(K.ELEMENTS, 1)], "element string, z int").withColumn("value", F.sqrt(F.col("z").cast("double")))


@query("ag46_composition_stats", f"WITH {PARTS_SQL}, e AS (SELECT id, element, n, CASE element WHEN 'Na' THEN 11 WHEN 'Cl' THEN 17 WHEN 'Ga' THEN 31 WHEN 'As' THEN 33 WHEN 'Fe' THEN 26 WHEN 'O' THEN 8 WHEN 'Ti' THEN 22 WHEN 'Si' THEN 14 WHEN 'C' THEN 6 WHEN 'N' THEN 7 END AS z FROM c), q AS (SELECT id, sum(n) AS t, sum(n * sqrt(z)) AS s, sum(n * z) AS q, min(sqrt(z)) AS low, max(sqrt(z)) AS high, count(*) AS elements FROM e GROUP BY id) SELECT id, round(s / t, 8) AS mean, round(sqrt(greatest(0, q / t - (s / t) ** 2)), 6) AS std, round(low, 8) AS low, round(high, 8) AS high, elements, round(q / t, 8) AS mean_z FROM q")
def _ag46(spark, sf_dir):
    parts = formulas(spark, sf_dir).select("id", F.explode(K.formula_parts("formula")).alias("p")).select("id", "p.element", "p.count")
    got = G.composition_stats(parts, "id", elements(spark))
    return got.withColumns({c: F.round(c, 8) for c in ("mean", "low", "high", "mean_z")}).withColumn("std", F.round("std", 6))


@query("jn18_periodic_neighbours", """WITH s AS (SELECT p_partkey AS m, 3.0 + p_size % 5 * 0.5 AS a, 4.0 + p_partkey % 7 * 0.25 AS b, 5.0 + p_partkey % 3 AS c, p_size / 100.0 AS f FROM part),
t AS (SELECT m, 0 AS atom, 0.0 AS x, 0.0 AS y, 0.0 AS z FROM s UNION ALL SELECT m, 1, 0.5, 0.5, f FROM s), g AS (SELECT CAST(unnest(range(-4, 5)) AS INT) AS v),
d AS (SELECT p.m, p.atom AS src, q.atom AS dst, i.v AS i, j.v AS j, k.v AS k, sqrt(((q.x + i.v - p.x) * a) ** 2 + ((q.y + j.v - p.y) * b) ** 2 + ((q.z + k.v - p.z) * c) ** 2) AS dist FROM t p JOIN t q ON p.m = q.m JOIN s ON s.m = p.m CROSS JOIN g i CROSS JOIN g j CROSS JOIN g k),
r AS (SELECT *, row_number() OVER w AS rank, lead(round(dist, 9)) OVER w AS nx FROM d WHERE dist <= 8 AND NOT (src = dst AND dist < 0.01) WINDOW w AS (PARTITION BY m, src ORDER BY round(dist, 9), dst, i, j, k))
SELECT m AS material_id, src, dst, i, j, k, round(dist, 8) AS dist, CAST(rank AS INT) AS rank, coalesce(rank = 12 AND nx = round(dist, 9), false) AS tie FROM r WHERE rank <= 12""")
def _jn18(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    s = read(spark, sf_dir, "part")
    zero = F.lit(0.0)
    cell = s.select(k.alias("material_id"), (3.0 + z % 5 * 0.5).alias("ax"), zero.alias("ay"), zero.alias("az"), zero.alias("bx"), (4.0 + k % 7 * 0.25).alias("by"), zero.alias("bz"), zero.alias("cx"), zero.alias("cy"), (5.0 + k % 3).alias("cz"))
    atom = F.explode(F.array(F.struct(F.lit(0).alias("atom"), zero.alias("fx"), zero.alias("fy"), zero.alias("fz")), F.struct(F.lit(1).alias("atom"), F.lit(0.5).alias("fx"), F.lit(0.5).alias("fy"), (z / 100.0).alias("fz"))))
    atoms = s.select(k.alias("material_id"), atom.alias("t")).select("material_id", "t.*")
    return G.periodic_neighbours(atoms, cell, 8.0, 12).withColumn("dist", F.round("dist", 8))


def vecs(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


VEC = "n AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) ** 2 for y in embedding])) for x in embedding] AS u FROM embeddings), p AS (SELECT q.id AS query, g.id AS found, list_dot_product(q.u, g.u) AS score FROM n q, n g WHERE q.id % 50 = 0)"


@query("jn19_top_k", f"WITH {VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, found) AS rank FROM p) SELECT query, found, round(score, 8) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def _jn19(spark, sf_dir):
    v = vecs(spark, sf_dir)
    return R.top_k(v.filter("id % 50 = 0"), v, 10).withColumn("score", F.round("score", 8))


NOISY = "n AS (SELECT vec_id AS id, embedding AS e FROM embeddings), m AS (SELECT id, [CAST(x AS DOUBLE) for x in e] AS a, [CAST(e[i] AS DOUBLE) + CASE WHEN i % 3 = id % 3 THEN 0.25 ELSE -0.1 END for i in range(1, 65)] AS b FROM n), u AS (SELECT id, [x / sqrt(list_sum([y ** 2 for y in a])) for x in a] AS a, [x / sqrt(list_sum([y ** 2 for y in b])) for x in b] AS b FROM m), p AS (SELECT q.id AS query, g.id AS found, list_dot_product(q.b, g.a) AS score FROM u q, u g WHERE q.id % 50 = 0)"


def noisy(spark, sf_dir):
    v = vecs(spark, sf_dir)
    q = v.filter("id % 50 = 0").select("id", F.transform("v", lambda x, i: x.cast("double") + F.when((i + 1) % 3 == F.col("id") % 3, 0.25).otherwise(-0.1)).alias("v"))
    return R.match_facts(q, v)


@query("ag19_retrieval_metrics", f"WITH {NOISY}, o AS (SELECT query, round(score, 9) AS own FROM p WHERE query = found), r AS (SELECT p.query, 1 + count(*) FILTER (WHERE round(score, 9) > own OR (round(score, 9) = own AND found < p.query)) AS rank FROM p JOIN o USING (query) GROUP BY p.query) SELECT count(*) AS queries, avg(CAST(rank <= 1 AS DOUBLE)) AS recall_1, avg(CAST(rank <= 5 AS DOUBLE)) AS recall_5, avg(CAST(rank <= 10 AS DOUBLE)) AS recall_10, round(avg(1.0 / rank), 8) AS mrr, median(rank) AS median_rank, round(avg(rank), 8) AS mean_rank FROM r")
def _ag19(spark, sf_dir):
    got = R.rank_metrics(noisy(spark, sf_dir))
    return got.withColumns({"mrr": F.round("mrr", 8), "mean_rank": F.round("mean_rank", 8)})


TWO_WAYS = "n AS (SELECT vec_id AS id, embedding AS e FROM embeddings), m AS (SELECT id, [CAST(x AS DOUBLE) for x in e] AS a, [CAST(e[i] AS DOUBLE) + CASE WHEN i % 3 = id % 3 THEN 0.25 ELSE -0.1 END for i in range(1, 65)] AS b FROM n), u AS (SELECT id, [x / sqrt(list_sum([y ** 2 for y in a])) for x in a] AS a, [x / sqrt(list_sum([y ** 2 for y in b])) for x in b] AS b FROM m), p AS (SELECT 'a_to_b' AS direction, q.id AS query, g.id AS found, list_dot_product(q.b, g.a) AS score FROM u q, u g UNION ALL SELECT 'b_to_a', q.id, g.id, list_dot_product(q.a, g.b) FROM u q, u g)"


@query("ag19_both_directions", f"WITH {TWO_WAYS}, o AS (SELECT direction, query, round(score, 9) AS own FROM p WHERE query = found), r AS (SELECT direction, p.query, 1 + count(*) FILTER (WHERE round(score, 9) > own OR (round(score, 9) = own AND found < p.query)) AS rank FROM p JOIN o USING (direction, query) GROUP BY ALL) SELECT direction, count(*) AS queries, avg(CAST(rank <= 1 AS DOUBLE)) AS recall_1, avg(CAST(rank <= 5 AS DOUBLE)) AS recall_5, avg(CAST(rank <= 10 AS DOUBLE)) AS recall_10, round(avg(1.0 / rank), 8) AS mrr, median(rank) AS median_rank, round(avg(rank), 8) AS mean_rank FROM r GROUP BY direction")
def _ag19_both(spark, sf_dir):
    """Noisy vectors against clean ones, and the other way; every row is a query."""
    v = vecs(spark, sf_dir).select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    noise = v.select("id", F.transform("v", lambda x, i: x + F.when((i + 1) % 3 == F.col("id") % 3, 0.25).otherwise(-0.1)).alias("v"))
    got = R.both_directions(noise, v, F.lit(True))
    return got.withColumns({"mrr": F.round("mrr", 8), "mean_rank": F.round("mean_rank", 8)})


@query("ag20_info_nce", f"WITH {NOISY}, t AS (SELECT query, max(score / 0.07) AS m, max(CASE WHEN query = found THEN score / 0.07 END) AS own FROM p GROUP BY query), l AS (SELECT p.query, any_value(m) + ln(sum(exp(score / 0.07 - m))) - any_value(own) AS loss FROM p JOIN t USING (query) GROUP BY p.query) SELECT round(avg(loss), 6) AS loss, count(*) AS queries FROM l")
def _ag20(spark, sf_dir):
    return R.info_nce(noisy(spark, sf_dir)).withColumn("loss", F.round("loss", 6))


@query("jn20_gallery_check", "SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN 'wrong length' ELSE 'zero or not finite' END AS problem FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 13 = 0")
def _jn20(spark, sf_dir):
    v = vecs(spark, sf_dir)
    bad = F.when(F.col("id") % 11 == 0, F.slice("v", 1, 5)).when(F.col("id") % 13 == 0, F.transform("v", lambda x: x * 0)).otherwise(F.col("v"))
    return R.gallery_check(v.withColumn("v", bad), 64)
