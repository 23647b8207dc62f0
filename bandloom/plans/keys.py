"""Queries on keys, hashes and text rules, over part, supplier, events, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..registry import query, read

FORMULA_SQL = """m AS (SELECT p_partkey AS id, ['Na','Ga','Fe','Ti','Si','C'][1 + p_partkey % 6] || CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size % 4 * 2 AS VARCHAR) END || ['Cl','As','O','O','Si','N'][1 + p_partkey % 6] || CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size % 3 * 2 AS VARCHAR) END AS formula FROM part)"""
PARTS_SQL = FORMULA_SQL + """,
f AS (SELECT id, formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS element, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 2)) AS c FROM m),
c AS (SELECT id, formula, element, CAST(sum(CASE WHEN c = '' THEN 1 ELSE CAST(c AS INT) END) AS INT) AS n FROM f GROUP BY ALL)"""


def formulas(spark, sf_dir):
    """A two-element formula for every part."""
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (1 + F.col("p_partkey") % 6).cast("int"))
    count = lambda m: F.when(F.col("p_size") % m == 0, "").otherwise((F.col("p_size") % m * 2).cast("string"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(pick(["Na", "Ga", "Fe", "Ti", "Si", "C"]), count(4), pick(["Cl", "As", "O", "O", "Si", "N"]), count(3)).alias("formula"))


@query("key1_formula_parts", f"WITH {PARTS_SQL} SELECT id, element, CASE WHEN c = '' THEN 1 ELSE CAST(c AS INT) END AS count FROM f")
def _key1(spark, sf_dir):
    return formulas(spark, sf_dir).select("id", F.explode(K.formula_parts("formula")).alias("p")).select("id", "p.element", "p.count")


@query("key2_reduced_formula", f"WITH {PARTS_SQL}, g AS (SELECT id, list_reduce(list(n), lambda a, b: gcd(a, b)) AS g FROM c GROUP BY id) SELECT id, string_agg(element || ':' || CAST(n // g AS INT), ',' ORDER BY element) AS composition FROM c JOIN g USING (id) GROUP BY id")
def _key2(spark, sf_dir):
    return formulas(spark, sf_dir).select("id", K.reduced_formula("formula").alias("composition"))


@query("key3_element_set", f"WITH {PARTS_SQL} SELECT id, string_agg(element, '-' ORDER BY element) AS elements FROM c GROUP BY id")
def _key3(spark, sf_dir):
    return formulas(spark, sf_dir).select("id", K.element_set("formula").alias("elements"))


@query("key4_prototype", """SELECT p_partkey AS id, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN ' ' END), ''),
  concat_ws('|', coalesce(nullif(trim(CASE WHEN p_partkey % 5 > 0 THEN p_brand END), ''), 'unknown'), 'sg' || coalesce(CAST(CASE WHEN p_size > 2 THEN p_size END AS VARCHAR), '?'), 'n' || CAST(p_size % 7 AS VARCHAR))) AS prototype FROM part""")
def _key4(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, " ").alias("t"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("b"), F.when(F.col("p_size") > 2, F.col("p_size")).alias("s"), (F.col("p_size") % 7).alias("n"))
    return rows.select("id", K.prototype_key("t", "b", "s", "n").alias("prototype"))


URL = "'http://host/' || CASE p_partkey % 3 WHEN 0 THEN 'LIB3_WEB' WHEN 1 THEN 'ICSD_RAW' ELSE 'plain' END || '/' || p_type || '/x'"


def _urls(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "LIB3_WEB").when(F.col("p_partkey") % 3 == 1, "ICSD_RAW").otherwise("plain")
    return read(spark, sf_dir, "part").withColumn("url", F.concat(F.lit("http://host/"), kind, F.lit("/"), "p_type", F.lit("/x")))


@query("key5_catalog", f"SELECT p_partkey AS id, list_filter(regexp_split_to_array({URL}, '[/:]'), lambda x: x LIKE '%\\_WEB' ESCAPE '\\' OR x LIKE '%\\_RAW' ESCAPE '\\')[1] AS catalog FROM part")
def _key5(spark, sf_dir):
    return _urls(spark, sf_dir).select(F.col("p_partkey").alias("id"), K.catalog_of("url").alias("catalog"))


@query("key6_source_protocol", f"WITH u AS (SELECT *, list_filter(regexp_split_to_array({URL}, '[/:]'), lambda x: x LIKE '%\\_WEB' ESCAPE '\\' OR x LIKE '%\\_RAW' ESCAPE '\\')[1] AS c FROM part) SELECT p_partkey AS id, concat_ws('|', coalesce(nullif(trim(p_brand), ''), 'unknown'), coalesce(c, 'unknown'), array_to_string(list_sort([p_type, 'PBE']), '+')) AS protocol FROM u")
def _key6(spark, sf_dir):
    return _urls(spark, sf_dir).select(F.col("p_partkey").alias("id"), K.source_protocol(F.col("p_brand"), K.catalog_of("url"), F.array("p_type", F.lit("PBE"))).alias("protocol"))


@query("key7_valid_elements", f"WITH {PARTS_SQL}, x AS (SELECT id, list(element ORDER BY element) AS s FROM c GROUP BY id) SELECT id, CASE WHEN id % 9 = 0 THEN '' ELSE array_to_string(s, ',') END AS species FROM x")
def _key7(spark, sf_dir):
    rows = formulas(spark, sf_dir)
    species = F.array_sort(F.array_distinct(F.transform(K.formula_parts("formula"), lambda p: p["element"])))
    with_bad = F.when(F.col("id") % 9 == 0, F.concat(species, F.array(F.lit("Xx")))).otherwise(species)
    return rows.select("id", F.array_join(K.valid_elements(with_bad), ",").alias("species"))


@query("key8_provider_time", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('second', ts) + to_hours(CAST(event_id % 12 AS BIGINT)) + to_minutes(CASE WHEN event_id % 2 = 0 THEN 30 ELSE 0 END) END AS utc FROM events""")
def _key8(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    zone = F.concat(F.lit("_GMT-"), (F.col("event_id") % 12).cast("string"), F.when(F.col("event_id") % 2 == 0, ":30").otherwise(""))
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HH:mm:ss"), zone)
    rows = e.select("event_id", F.when(F.col("event_id") % 11 == 0, F.regexp_replace(text, "GMT", "UTC")).otherwise(text).alias("t"))
    return rows.select("event_id", K.provider_time("t").cast("timestamp_ntz").alias("utc"))


@query("key9_provider_id", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN 'aflow-' || substr(md5(s_name), 1, 16) END AS material_id FROM supplier")
def _key9(spark, sf_dir):
    digest = F.substring(F.md5("s_name"), 1, 16)
    short = F.when(F.col("s_suppkey") % 4 == 0, F.substring(digest, 1, 5)).otherwise(digest)
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("aflow:"), short).alias("auid"))
    return rows.select("id", K.provider_id("auid").alias("material_id"))


@query("key10_semantic_hash", """SELECT c_custkey AS id, sha256('{' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '"name":"' || c_name || '",' END || '"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}') AS digest FROM customer""")
def _key10(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"), F.lit("2024").alias("fetched"))
    return rows.select("id", K.semantic_hash(rows.columns, ("id", "fetched")).alias("digest"))


@query("key13_candidate_id", "SELECT page_id, 'cand-' || substr(sha256(url || '|' || page_id), 1, 24) AS candidate_id, substr(sha256(url), 1, 20) AS audit_id FROM pages")
def _key13(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", K.candidate_id("cand-", F.concat_ws("|", "url", "page_id")).alias("candidate_id"), K.candidate_id("", F.col("url"), 20).alias("audit_id"))


@query("key14_content_dedupe", "SELECT sha256(text) AS sha, lang AS kind, source AS meta, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY ALL")
def _key14(spark, sf_dir):
    """Content-addressed rows: one for each digest, kind and metadata, the smallest id first."""
    d = read(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    return d.groupBy("sha", F.col("lang").alias("kind"), F.col("source").alias("meta")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("key15_observation_digest", "WITH b AS (SELECT c_nationkey AS part, c_custkey // 500 AS block, sha256(string_agg(c_custkey || '=' || c_mktsegment, ';' ORDER BY c_custkey)) AS d FROM customer GROUP BY ALL) SELECT part, sha256(string_agg(d, ';' ORDER BY block)) AS digest FROM b GROUP BY 1")
def _key15(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("part"), "c_custkey", F.concat_ws("=", "c_custkey", "c_mktsegment").alias("t"))
    return K.block_digest(rows, "part", F.floor(F.col("c_custkey") / 500), "c_custkey", "t")


@query("snk3_csv_safe", """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '  -' WHEN 2 THEN chr(9) WHEN 3 THEN '@' ELSE '' END || props AS v FROM events)
SELECT event_id, CASE WHEN event_id % 5 < 4 THEN '''' || v ELSE v END AS cell FROM t""")
def _snk3(spark, sf_dir):
    m = F.col("event_id") % 5
    start = F.when(m == 0, "=").when(m == 1, "  -").when(m == 2, "\t").when(m == 3, "@").otherwise("")
    return read(spark, sf_dir, "events").select("event_id", K.csv_safe(F.concat(start, "props")).alias("cell"))


@query("flt3_lenient_casts", """SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END, -1.0) AS number, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag FROM events""")
def _flt3(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    number = F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.col("value").cast("string"))
    flag = F.element_at(F.array(*[F.lit(x) for x in (" TRUE", "0", "Yes", "no ", "maybe")]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = e.select("event_id", number.alias("n"), flag.alias("f"))
    return rows.select("event_id", K.lenient_float(F.col("n"), -1.0).alias("number"), K.lenient_bool(F.col("f")).alias("flag"))


@query("flt8_missing_values", "SELECT event_type, count(*) FILTER (WHERE event_id % 6 < 4) AS missing, count(*) AS rows FROM events GROUP BY event_type")
def _flt8(spark, sf_dir):
    v = F.element_at(F.array(F.lit(" "), F.lit(None), F.lit("Unknown"), F.lit("NaN"), F.lit("x"), F.lit("0")), (F.col("event_id") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_type", v.alias("v"))
    return rows.groupBy("event_type").agg(F.count_if(K.is_missing(F.col("v"))).alias("missing"), F.count("*").alias("rows"))
