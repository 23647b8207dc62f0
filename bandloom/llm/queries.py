"""The registered queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, small_batches, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: what is kept of each."""
    from .line_dedup import line_dedup

    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("text", "kept_text")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out."""
    small_batches(spark)
    from .langid import fit, held_out, identify

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out("doc_id")))
    got = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits", "most_bits")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of weights 1, 2, 3 takes of each document, and the places of its draws in the shards."""
    from .mixing import draw, words

    sized = table(read(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text"), words("text").alias("size")), "mix-sized")
    rows, _ = draw(sized, size_col="size")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, _: total + F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    small_batches(spark)
    from .ngram_join import jaccard_links

    return jaccard_links(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token pieces in sequences of at most 4096 tokens."""
    small_batches(spark)
    import public_tokenizers

    from .packing import pack, token_pieces

    pieces = table(token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "pack-pieces")
    return pack(pieces.withColumnRenamed("id", "doc_id"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a string of 100 bytes covers which also starts earlier."""
    small_batches(spark)
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a progressive JPEG, read back, with its full-resolution RGB tensor and features of it."""
    small_batches(spark)
    from .media import decode_media, encode_media

    media = table(encode_media(read(spark, sf_dir, "documents")), "media")
    return decode_media(media, with_tensor=True).drop("payload").withColumnRenamed("id", "doc_id")


def op8_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of equal-label vectors with a cosine of 0.98 or more, their components and keepers."""
    from .vector_graph import near_links

    return near_links(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op9_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, read back and assembled."""
    from .warc import captures, write_warc

    path = scratch(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    target = F.when(F.col("record_type") == "revisit", F.regexp_extract("refers_to", r"urn:page:(-?\d+):", 1).cast("long"))
    return captures(spark, path).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", target.alias("refers_to"), F.col("request.record_id").alias("request_id"), F.col("metadata.record_id").alias("metadata_id"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    from .sharding import kd_shards

    got = kd_shards(read(spark, sf_dir, "documents"), 8)
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by a compiled vocabulary."""
    small_batches(spark)
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two vocabularies that cover the same bytes, and corpus-wide counts of their links."""
    small_batches(spark)
    import public_tokenizers

    from .token_align import align

    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align(read(spark, sf_dir, "documents"), *paths).withColumnRenamed("id", "doc_id")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and the cheapest edits that repair it."""
    small_batches(spark)
    from .turn_repair import damage, repair

    return repair(damage(read(spark, sf_dir, "conversations")), present_col="present")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


LINE_DEDUP_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
w AS (SELECT doc_id, i, x[i] || chr(10) || x[i+1] || chr(10) || x[i+2] AS w
      FROM (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS i FROM l WHERE len(x) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE k > 1),
p AS (SELECT doc_id, x[i] AS line, i FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM l)),
j AS (SELECT p.doc_id, p.i, line, c.i IS NOT NULL AS gone, lag(c.i IS NOT NULL, 1, false) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS before
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') END AS kept_text,
       count(j.i) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_spans
FROM l LEFT JOIN j ON l.doc_id = j.doc_id GROUP BY l.doc_id, l.text
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND best <> page_id THEN best END AS refers_to,
       'urn:page:' || page_id || ':0:request' AS request_id, 'urn:page:' || page_id || ':0:metadata' AS metadata_id
FROM g
"""


NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE k * 5 >= (x.n + y.n - k) * 4),
r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT l.b, r.label FROM r JOIN l ON r.node = l.a),
m AS (SELECT node, min(label) AS class_id FROM r GROUP BY node)
SELECT node AS doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = node) AS n_links FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard": NGRAM_SQL, "op1_line_dedup": LINE_DEDUP_SQL, "op9_warc_captures": WARC_SQL}
