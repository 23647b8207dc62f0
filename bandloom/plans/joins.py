"""Queries on merges: customers as existing and incoming records, orders as versions, parts as lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as G
from ..registry import query, read

OLD = "a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0)"
NEW = "b AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 2 = 0)"


def old_new(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    a = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, "unknown").otherwise(F.col("c_mktsegment")).alias("segment"))
    b = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("segment"))
    return a, b


@query("jn1_enrich", f"WITH {OLD}, {NEW} SELECT a.id, coalesce(b.name, a.name) AS name, coalesce(b.segment, a.segment) AS segment, 0 AS duplicates FROM a LEFT JOIN b USING (id)")
def _jn1(spark, sf_dir):
    a, b = old_new(spark, sf_dir)
    return G.enrich(a.withColumns({c: G.filled(F.col(c)) for c in ("name", "segment")}), "id", b).select("id", "name", "segment", F.col("duplicates").cast("int").alias("duplicates"))


@query("jn2_backfill", f"""WITH {OLD}, {NEW} SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name, coalesce(a.segment, b.segment) AS segment,
CASE WHEN a.id IS NULL OR b.id IS NULL THEN 0 ELSE CAST(a.name IS NULL AS INT) + CAST(a.segment IS NULL AS INT) END AS filled,
coalesce(CAST(a.name <> b.name AS INT), 0) + coalesce(CAST(a.segment <> b.segment AS INT), 0) AS blocked, a.id IS NULL AS new FROM a FULL JOIN b ON a.id = b.id""")
def _jn2(spark, sf_dir):
    return G.backfill(*old_new(spark, sf_dir), "id")


VERS = "v AS (SELECT o_custkey AS id, o_orderkey AS seq, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority FROM orders), f AS (SELECT id, seq, 'status' AS field, status AS value FROM v UNION ALL SELECT id, seq, 'priority', priority FROM v), s AS (SELECT *, first_value(value) OVER (PARTITION BY id, field ORDER BY seq) AS kept FROM f WHERE value IS NOT NULL)"


def versions(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))


@query("jn3_fold_versions", f"WITH {VERS} SELECT id, field, any_value(kept) AS value, count(*) FILTER (WHERE value <> kept) AS conflicts FROM s GROUP BY id, field")
def _jn3(spark, sf_dir):
    return G.fold_versions(versions(spark, sf_dir), "id", "seq", ["status", "priority"])


@query("jn3_conflict_audit", f"WITH {VERS} SELECT id, field, seq, sha256(CAST(id AS VARCHAR)) AS key_sha, sha256(kept) AS kept_sha, sha256(value) AS refused_sha FROM s WHERE value <> kept")
def _jn3b(spark, sf_dir):
    return G.conflict_audit(versions(spark, sf_dir), "id", "seq", ["status", "priority"])


@query("jn4_strict_merge", f"WITH {VERS} SELECT id, field, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, CASE WHEN count(DISTINCT value) > 1 THEN 'conflict' WHEN count(value) = 0 THEN 'missing' END AS error FROM f GROUP BY id, field")
def _jn4(spark, sf_dir):
    return G.strict_merge(versions(spark, sf_dir), "id", "seq", ["status", "priority"])


@query("jn5_fixed_ids", f"""WITH {OLD}, {NEW}, i AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 > 0), j AS (SELECT coalesce(i.id, a.id, b.id) AS id, i.id AS i, a.segment AS o, b.segment AS n FROM i FULL JOIN a ON i.id = a.id FULL JOIN b ON coalesce(i.id, a.id) = b.id),
s AS (SELECT *, CASE WHEN i IS NULL THEN 'out of scope' WHEN o <> n THEN 'conflict' WHEN coalesce(n, o) IS NULL THEN 'read_error' ELSE 'merged' END AS status FROM j) SELECT id, CASE WHEN status = 'merged' THEN coalesce(n, o) END AS segment, status FROM s""")
def _jn5(spark, sf_dir):
    a, b = old_new(spark, sf_dir)
    ids = read(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"))
    return G.fixed_ids(ids, a.withColumn("segment", G.filled(F.col("segment"))), b, "id", "segment")


@query("jn6_pair_valid", f"WITH {OLD}, {NEW} SELECT a.id, a.name, b.segment, b.id IS NOT NULL AS valid FROM a LEFT JOIN b USING (id)")
def _jn6(spark, sf_dir):
    """All rows of the left side, and whether the right side has them."""
    a, b = old_new(spark, sf_dir)
    got = a.select("id", G.filled(F.col("name")).alias("name")).join(b.select("id", "segment", F.lit(True).alias("valid")), "id", "left")
    return got.withColumn("valid", F.coalesce("valid", F.lit(False)))


@query("jn7_align_labels", "WITH l AS (SELECT o_custkey AS id, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey AS place, c_custkey AS id, CASE WHEN n = 1 THEN o_orderpriority END AS label, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'doubled' END AS problem FROM customer LEFT JOIN l ON c_custkey = id LEFT JOIN orders ON o_orderkey = first")
def _jn7(spark, sf_dir):
    lab = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"))
    t = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("place"))
    return G.aligned(lab, t, "id", "place").withColumn("label", F.when(F.col("problem").isNull(), F.col("label")))


@query("jn8_new_candidates", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')")
def _jn8(spark, sf_dir):
    """Candidates that are neither downloaded nor excluded."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    done = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    out = o.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"))
    return c.join(done, "id", "left_anti").join(out, "id", "left_anti")


@query("jn11_top_up", f"WITH {OLD}, p AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM a)), r AS (SELECT id, row_number() OVER (ORDER BY md5('t1|' || id)) AS k FROM p) SELECT id FROM a UNION ALL SELECT id FROM r WHERE k <= (SELECT greatest(0, CAST(floor((SELECT count(*) FROM customer) * 0.9) AS BIGINT) - (SELECT count(*) FROM a)))")
def _jn11(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return G.top_up(c.filter("id % 5 <> 0"), c, "id", int(c.count() * 0.9), "t1")


@query("jn12_reconcile", f"WITH {OLD}, {NEW} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'stale' WHEN b.id IS NULL THEN 'backfill' ELSE 'kept' END AS action FROM a FULL JOIN b ON a.id = b.id")
def _jn12(spark, sf_dir):
    return G.reconcile(*old_new(spark, sf_dir), "id")


@query("jn14_lookup_cascade", f"""WITH {OLD}, {NEW}, j AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN b.segment END AS x, CASE WHEN c_custkey % 4 = 1 THEN a.segment END AS y, CASE WHEN c_custkey % 5 = 2 THEN 'PARSED' END AS z FROM customer LEFT JOIN a ON a.id = c_custkey LEFT JOIN b ON b.id = c_custkey)
SELECT id, coalesce(x, y, z) AS value, CASE WHEN x IS NOT NULL THEN 'provider' WHEN y IS NOT NULL THEN 'local' WHEN z IS NOT NULL THEN 'parsed' ELSE 'unknown' END AS origin, round((CASE WHEN x IS NULL THEN 0 ELSE 1 END + CASE WHEN y IS NULL THEN 0 ELSE 0.8 END + CASE WHEN z IS NULL THEN 0 ELSE 0.5 END) / 3, 8) AS confidence FROM j""")
def _jn14(spark, sf_dir):
    a, b = old_new(spark, sf_dir)
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(b.select("id", F.col("segment").alias("x")), "id", "left").join(a.select("id", G.filled(F.col("segment")).alias("y")), "id", "left")
    x, y, z = F.when(F.col("id") % 3 == 0, F.col("x")), F.when(F.col("id") % 4 == 1, F.col("y")), F.when(F.col("id") % 5 == 2, "PARSED")
    return G.cascade(c, x, y, z).select("id", "value", "origin", F.round("confidence", 8).alias("confidence"))


@query("jn15_crystal_system", "WITH g AS (SELECT p_partkey AS id, CAST(p_partkey * 7 % 240 AS INT) AS n FROM part) SELECT CASE WHEN n < 1 OR n > 230 THEN NULL WHEN n <= 2 THEN 'triclinic' WHEN n <= 15 THEN 'monoclinic' WHEN n <= 74 THEN 'orthorhombic' WHEN n <= 142 THEN 'tetragonal' WHEN n <= 167 THEN 'trigonal' WHEN n <= 194 THEN 'hexagonal' ELSE 'cubic' END AS system, count(*) AS n FROM g GROUP BY 1")
def _jn15(spark, sf_dir):
    g = read(spark, sf_dir, "part").select((F.col("p_partkey") * 7 % 240).cast("int").alias("g"))
    return g.groupBy(G.crystal_system(F.col("g")).alias("system")).agg(F.count("*").alias("n"))


@query("jn25_catalog_refresh", "SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderkey >= 10000 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 10000) GROUP BY 1")
def _jn25(spark, sf_dir):
    """Ids first seen after a refresh."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return o.filter("o_orderkey >= 10000").join(o.filter("o_orderkey < 10000").select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n"))


@query("jn26_corroboration", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'no evidence' WHEN s_suppkey % 3 = 0 THEN 'contradicted' ELSE 'corroborated' END AS state FROM supplier")
def _jn26(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.md5("s_name").alias("sha"), F.array(F.col("s_acctbal"), F.lit(1.0)).alias("v"))
    claim = s.withColumn("sha", F.when(F.col("id") % 5 == 0, "stale").otherwise(F.col("sha"))).withColumn("v", F.when(F.col("id") % 3 == 0, F.transform("v", lambda x: x + 0.01)).otherwise(F.transform("v", lambda x: x + 1e-9)))
    return G.corroborate(claim, s, "id", "sha", "v", 1e-6).select("id", "state")


@query("jn27_clip_ids", "WITH n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN id % 3 = 0 THEN 'clipped' WHEN n > 1 THEN 'duplicate' ELSE 'in scope' END AS state, CAST(sum(n) AS BIGINT) AS rows, count(*) AS ids FROM n GROUP BY 1")
def _jn27(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    known = read(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"))
    return G.clip(o, known, "id").groupBy("state").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query("ag40_quality_ledger", "WITH x AS (SELECT 'name' AS field, CASE WHEN c_custkey % 9 = 0 THEN 'invalid' ELSE 'valid' END AS s FROM customer UNION ALL SELECT 'balance', CASE WHEN c_acctbal < 0 THEN 'ambiguous' WHEN c_custkey % 10 = 0 THEN 'read_error' ELSE 'valid' END FROM customer) SELECT field, count(*) FILTER (WHERE s = 'valid') AS valid, count(*) FILTER (WHERE s = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE s = 'invalid') AS invalid, count(*) FILTER (WHERE s = 'read_error') AS read_error, count(*) AS n, true AS adds_up FROM x GROUP BY field")
def _ag40(spark, sf_dir):
    k = F.col("c_custkey")
    fields = {"name": F.when(k % 9 == 0, "invalid").otherwise("valid"), "balance": F.when(F.col("c_acctbal") < 0, "ambiguous").when(k % 10 == 0, "read_error").otherwise("valid")}
    return G.ledger(read(spark, sf_dir, "customer"), fields)
