"""Queries on orders, quotas, samples and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topk as T
from ..registry import query, read


@query("tk1_diverse_order", "WITH a AS (SELECT p_partkey AS id, p_brand AS g, p_type AS t, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS i FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i, t, id) AS j FROM a) SELECT id, CAST(j AS INT) AS round, CAST(i AS INT) AS turn FROM b")
def _tk1(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), F.col("p_type").alias("t"))
    return T.diverse_order(p, "g", "t", "id").select("id", "round", "turn")


@query("tk2_quota_by_bin", """WITH b AS (SELECT p_partkey AS id, CAST(floor((p_size - 1) / 10) AS INT) AS bin FROM part WHERE p_size <> 7), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('q1|' || id)) AS k, count(*) OVER (PARTITION BY bin) AS n FROM b),
q AS (SELECT bin, any_value(n) AS n, 400 // 5 + CASE WHEN bin < 400 % 5 THEN 1 ELSE 0 END AS quota FROM r GROUP BY bin), d AS (SELECT sum(greatest(0, quota - n)) AS spare FROM q),
x AS (SELECT r.*, quota, CASE WHEN k > quota THEN row_number() OVER (PARTITION BY k > quota ORDER BY k, bin) END AS more FROM r JOIN q USING (bin)) SELECT id, bin FROM x, d WHERE k <= quota OR more <= spare""")
def _tk2(spark, sf_dir):
    p = read(spark, sf_dir, "part").filter("p_size <> 7").select(F.col("p_partkey").alias("id"), F.floor((F.col("p_size") - 1) / 10).cast("int").alias("bin"))
    return T.quota_by_bin(p, "id", "bin", 5, 400, "q1").select("id", "bin")


@query("tk4_seeded_sample", "SELECT o_orderkey AS id FROM orders ORDER BY md5('k1|' || o_orderkey) LIMIT 500")
def _tk4(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return T.seeded_sample(o, "id", 500, "k1")


@query("tk5_group_cap", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents), b AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM a WHERE r = 1) SELECT doc_id, source FROM b WHERE k <= 2")
def _tk5(spark, sf_dir):
    from ..operators.figures import per_group_cap

    return per_group_cap(read(spark, sf_dir, "documents"), "source", 2, ["text"], "doc_id").select("doc_id", "source")


@query("tk6_text_chunks", "WITH c AS (SELECT doc_id, text, sha256(text) AS sha, unnest(range(0, greatest(1, CAST(length(text) AS BIGINT)), 1000)) AS start FROM documents) SELECT doc_id, CAST(start // 1000 AS INT) AS chunk, CAST(start AS INT) AS start, CAST(length(substr(text, start + 1, 1000)) AS INT) AS length, sha, md5(substr(text, start + 1, 1000)) AS chunk_md5 FROM c")
def _tk6(spark, sf_dir):
    got = T.text_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 1000)
    return got.select("doc_id", "chunk", "start", F.length("part").alias("length"), "sha", F.md5("part").alias("chunk_md5"))
