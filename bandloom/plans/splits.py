"""Queries on splits: customers by nation and segment, orders by date, parts by brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from ..registry import query, read
from .keys import PARTS_SQL, formulas


def customers(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("cls"))


C = "c AS (SELECT c_custkey AS id, c_nationkey AS grp, c_mktsegment AS cls FROM customer)"
RANDOM = f"{C}, s1 AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('r1|' || id)) <= CAST(floor(0.8 * (SELECT count(*) FROM c) + 0.5) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM c)"


@query("sp1_random_split", f"WITH {RANDOM} SELECT id, part FROM s1")
def _sp1(spark, sf_dir):
    return S.random_split(customers(spark, sf_dir), "id", 0.8, "r1").select("id", "part")


def group_sql(table: str, grp: str, seed: str, share: float, out: str) -> str:
    return f"""{out}n AS (SELECT {grp} AS g, count(*) AS n FROM {table} GROUP BY 1), {out}t AS (SELECT g, n, CAST(unnest(range((SELECT least(1024, greatest(64, count(*))) FROM {out}n))) AS INT) AS trial, sum(n) OVER () AS a, count(*) OVER () AS k FROM {out}n),
{out}r AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER w AS rank FROM {out}t WINDOW w AS (PARTITION BY trial ORDER BY md5(concat_ws('|', '{seed}', trial, g)), g)),
{out}b AS (SELECT trial, rank FROM {out}r WHERE rank < k OR k = 1 ORDER BY round(abs(upto / a - {share}), 12), trial, rank LIMIT 1),
{out} AS (SELECT x.*, CASE WHEN r.rank <= b.rank THEN 'test' ELSE 'train' END AS part FROM {table} x JOIN {out}r r ON x.{grp} = r.g JOIN {out}b b ON r.trial = b.trial)"""


@query("sp2_group_split", f"WITH {C}, {group_sql('c', 'grp', 'g1', 0.2, 's2')} SELECT id, grp, part FROM s2")
def _sp2(spark, sf_dir):
    return S.group_split(customers(spark, sf_dir), "grp", 0.2, "g1").select("id", "grp", "part")


@query("sp3_stratified_group_split", f"""WITH {C}, n AS (SELECT grp, cls, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT grp, sum(n) AS n FROM n GROUP BY 1), q AS (SELECT cls, sum(n) AS cn FROM n GROUP BY 1),
t AS (SELECT grp, n, CAST(unnest(range((SELECT least(2048, greatest(256, 16 * count(*))) FROM p))) AS INT) AS trial, sum(n) OVER () AS a, count(*) OVER () AS k FROM p),
r AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER w AS rank FROM t WINDOW w AS (PARTITION BY trial ORDER BY md5(concat_ws('|', 'h1', trial, grp)), grp)),
m AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY round(abs(upto - 0.2 * a), 9), rank) AS o FROM r), cut AS (SELECT DISTINCT trial, a, greatest(1, least(k - 1, rank + d)) AS rank FROM m, (SELECT unnest(range(-3, 4)) AS d) WHERE o = 1),
s AS (SELECT cut.trial, cut.rank, n.cls, sum(n.n) AS tn FROM cut JOIN r ON r.trial = cut.trial AND r.rank <= cut.rank JOIN n ON n.grp = r.grp GROUP BY ALL),
g AS (SELECT cut.trial, cut.rank, a, q.cls, cn, coalesce(tn, 0) AS tn, sum(coalesce(tn, 0)) OVER (PARTITION BY cut.trial, cut.rank) AS upto FROM cut CROSS JOIN q LEFT JOIN s ON s.trial = cut.trial AND s.rank = cut.rank AND s.cls = q.cls),
z AS (SELECT trial, rank, round(abs(max(upto) / max(a) - 0.2) + 0.35 * avg(abs(tn / upto - cn / a)) + 2 * sum((tn = 0)::INT + (tn = cn)::INT), 12) AS score FROM g GROUP BY ALL), b AS (SELECT * FROM z ORDER BY score, trial, rank LIMIT 1)
SELECT c.id, c.grp, CASE WHEN r.rank <= b.rank THEN 'test' ELSE 'train' END AS part FROM c JOIN r ON c.grp = r.grp JOIN b ON r.trial = b.trial""")
def _sp3(spark, sf_dir):
    return S.stratified_group_split(customers(spark, sf_dir), "grp", "cls", 0.2, "h1").select("id", "grp", "part")


def parts_rows(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_brand", "p_type").alias("composition"), F.concat_ws("|", F.concat(F.lit("sg"), F.col("p_size").cast("string"))).alias("prototype"))


P = "p AS (SELECT p_partkey AS id, p_brand || '|' || p_type AS composition, 'sg' || p_size AS prototype FROM part)"


@query("sp4_composition_split", f"WITH {P}, {group_sql('p', 'composition', 'c1', 0.25, 's4')} SELECT id, composition, part FROM s4")
def _sp4(spark, sf_dir):
    return S.group_split(parts_rows(spark, sf_dir), "composition", 0.25, "c1").select("id", "composition", "part")


@query("sp4_prototype_split", f"WITH {P}, {group_sql('p', 'prototype', 'c2', 0.25, 's4')} SELECT id, prototype, part FROM s4")
def _sp4b(spark, sf_dir):
    return S.group_split(parts_rows(spark, sf_dir), "prototype", 0.25, "c2").select("id", "prototype", "part")


def species(spark, sf_dir):
    from ..functions.keys import formula_parts

    names = F.array_sort(F.array_distinct(F.transform(formula_parts("formula"), lambda p: p["element"])))
    return formulas(spark, sf_dir).select("id", F.when(F.col("id") % 10 != 0, names).alias("elements"))


@query("sp5_leave_element_out", f"""WITH {PARTS_SQL}, s AS (SELECT id, list(DISTINCT element ORDER BY element) AS e FROM c GROUP BY id), k AS (SELECT * FROM s WHERE id % 10 <> 0), n AS (SELECT unnest(e) AS e, count(*) AS n FROM k GROUP BY 1),
b AS (SELECT e AS held FROM n ORDER BY round(abs(n / (SELECT count(*) FROM k) - 0.2), 12), e LIMIT 1)
SELECT id, held AS held_out, CASE WHEN id % 10 = 0 THEN 'excluded' WHEN list_contains(e, held) THEN 'test' ELSE 'train' END AS part FROM s, b""")
def _sp5(spark, sf_dir):
    return S.leave_element_out(species(spark, sf_dir), "id", "elements", 0.2).select("id", "held_out", "part")


@query("sp6_source_protocol_split", f"WITH d AS (SELECT doc_id AS id, source || '|' || lang AS protocol FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), {group_sql('d', 'protocol', 'p1', 0.2, 's6')} SELECT id, protocol, part FROM s6")
def _sp6(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("source is not null and lang is not null").select(F.col("doc_id").alias("id"), F.concat_ws("|", "source", "lang").alias("protocol"))
    return S.group_split(d, "protocol", 0.2, "p1").select("id", "protocol", "part")


def dated(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("t"))


@query("sp7_temporal_split", """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS t FROM orders), d AS (SELECT t, row_number() OVER (ORDER BY t) AS r, count(*) OVER () AS n FROM o WHERE t IS NOT NULL), c AS (SELECT t AS cut FROM d WHERE r = greatest(1, CAST(floor(n * 0.8) AS BIGINT)))
SELECT id, CASE WHEN t IS NULL THEN 'excluded' WHEN t <= cut THEN 'train' ELSE 'test' END AS part FROM o, c""")
def _sp7(spark, sf_dir):
    return S.temporal_split(dated(spark, sf_dir), "id", "t", 0.8).select("id", "part")


#: What each of the seven splits claims to hold out.
CLAIMS = {
    "random": "sample_random_holdout_not_group_ood", "space_group": "spacegroup_number", "composition": "reduced_stoichiometric_composition", "prototype": "prototype_or_explicit_proxy",
    "leave_element": "held_out_element", "source_protocol": "reported_source_catalog_functional_key_disjoint_not_full_protocol", "temporal": "catalog_entry_time_not_blind_dft",
}


def materials(spark, sf_dir):
    """A material a part, with all that the seven splits go by; some have no species, no protocol or no date."""
    p = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("spacegroup"), F.concat_ws("|", "p_brand", "p_type").alias("composition"), F.concat(F.lit("sg"), "p_size").alias("prototype"),
        F.when(F.col("p_partkey") % 13 != 0, F.concat_ws("|", "p_brand", (F.col("p_partkey") % 5).cast("string"))).alias("protocol"), F.when(F.col("p_partkey") % 17 != 0, F.timestamp_add("DAY", F.col("p_partkey") * 7 % 400, F.lit("2024-01-01").cast("timestamp"))).alias("dated"),
    )
    return p.join(species(spark, sf_dir), "id")


def seven_splits(spark, sf_dir):
    m = materials(spark, sf_dir)
    known = S.group_split(m.filter("protocol is not null"), "protocol", 0.2, "m5").select("id", "part")
    return {
        "random": S.random_split(m, "id", 0.8, "m1"), "space_group": S.group_split(m, "spacegroup", 0.2, "m2"), "composition": S.group_split(m, "composition", 0.2, "m3"), "prototype": S.group_split(m, "prototype", 0.2, "m4"),
        "leave_element": S.leave_element_out(m, "id", "elements", 0.2), "source_protocol": known.unionByName(m.filter("protocol is null").select("id", F.lit("excluded").alias("part"))), "temporal": S.temporal_split(m, "id", "dated", 0.8),
    }


SEVEN = f"""mat AS (SELECT p_partkey AS id, p_size AS spacegroup, p_brand || '|' || p_type AS composition, 'sg' || p_size AS prototype, CASE WHEN p_partkey % 13 <> 0 THEN p_brand || '|' || p_partkey % 5 END AS protocol, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 7 % 400 END AS dated FROM part), mp AS (SELECT * FROM mat WHERE protocol IS NOT NULL),
s1 AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('m1|' || id)) <= CAST(floor(0.8 * (SELECT count(*) FROM mat) + 0.5) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM mat), {group_sql('mat', 'spacegroup', 'm2', 0.2, 's2')}, {group_sql('mat', 'composition', 'm3', 0.2, 's3')}, {group_sql('mat', 'prototype', 'm4', 0.2, 's4')}, {group_sql('mp', 'protocol', 'm5', 0.2, 's6')},
{PARTS_SQL}, e AS (SELECT id, list(DISTINCT element ORDER BY element) AS e FROM c GROUP BY id), k AS (SELECT * FROM e WHERE id % 10 <> 0), en AS (SELECT unnest(e) AS e, count(*) AS n FROM k GROUP BY 1), eb AS (SELECT e AS held FROM en ORDER BY round(abs(n / (SELECT count(*) FROM k) - 0.2), 12), e LIMIT 1),
td AS (SELECT dated, row_number() OVER (ORDER BY dated) AS r, count(*) OVER () AS n FROM mat WHERE dated IS NOT NULL), tc AS (SELECT dated AS cut FROM td WHERE r = greatest(1, CAST(floor(n * 0.8) AS BIGINT))),
a AS (SELECT 'random' AS split, id, part FROM s1 UNION ALL SELECT 'space_group', id, part FROM s2 UNION ALL SELECT 'composition', id, part FROM s3 UNION ALL SELECT 'prototype', id, part FROM s4 UNION ALL SELECT 'source_protocol', id, part FROM s6 UNION ALL SELECT 'source_protocol', id, 'excluded' FROM mat WHERE protocol IS NULL
UNION ALL SELECT 'leave_element', id, CASE WHEN id % 10 = 0 THEN 'excluded' WHEN list_contains(e, held) THEN 'test' ELSE 'train' END FROM e, eb UNION ALL SELECT 'temporal', id, CASE WHEN dated IS NULL THEN 'excluded' WHEN dated <= cut THEN 'train' ELSE 'test' END FROM mat, tc)"""
CLAIM = "CASE split " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLAIMS.items()) + " END"


@query("sp8_split_manifest", f"""WITH {SEVEN}, g AS (SELECT split, count(*) FILTER (WHERE part = 'train') AS num_train, count(*) FILTER (WHERE part = 'test') AS num_test, count(*) FILTER (WHERE part = 'excluded') AS num_excluded, round(count(*) FILTER (WHERE part = 'test') / count(*), 6) AS test_fraction FROM a GROUP BY split)
SELECT split, CASE WHEN num_train = 0 OR num_test = 0 THEN 'unavailable' ELSE 'available' END AS status, {CLAIM} AS claim, num_train, num_test, num_excluded, test_fraction, CASE WHEN num_train = 0 OR num_test = 0 THEN 'a side is empty' END AS reason FROM g""")
def _sp8(spark, sf_dir):
    """The manifest of the seven splits of all materials."""
    return S.split_manifest(seven_splits(spark, sf_dir), "id", CLAIMS).drop("held_out")


@query("sp8_held_out", f"WITH {SEVEN} SELECT 'leave_element' AS split, held AS held_out FROM eb")
def _sp8_held(spark, sf_dir):
    """What the manifest says of the split by an element: which one is held out."""
    one = {"leave_element": S.leave_element_out(materials(spark, sf_dir), "id", "elements", 0.2)}
    return S.split_manifest(one, "id", CLAIMS).select("split", "held_out")


@query("sp8_manifest_ids", f"WITH {SEVEN} SELECT split, part, id FROM a")
def _sp8_ids(spark, sf_dir):
    return S.manifest_ids(seven_splits(spark, sf_dir), "id")


@query("sp9_grouped_validation", "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT source, coalesce(sum(n) OVER (ORDER BY md5('v1|0|' || source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS a FROM n) SELECT doc_id AS id, CASE WHEN b < a * 0.2 THEN 'val' ELSE 'train' END AS part FROM documents JOIN o USING (source)")
def _sp9(spark, sf_dir):
    return S.grouped_validation(read(spark, sf_dir, "documents"), "source", 0.2, "v1").select(F.col("doc_id").alias("id"), "part")


@query("sp10_stride_split", "SELECT event_id AS id, CASE WHEN (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS part FROM events")
def _sp10(spark, sf_dir):
    return S.stride_split(read(spark, sf_dir, "events"), "user_id", "event_id", 5).select(F.col("event_id").alias("id"), "part")


@query("sp11_inherited_parts", f"""WITH {RANDOM}, u AS (SELECT id, part FROM s1 WHERE id % 20 <> 3), j AS (SELECT c.id, c.grp % 10 * 1000 + c.id % 300 AS g, u.part FROM c LEFT JOIN u USING (id)), s AS (SELECT g, count(DISTINCT part) AS k FROM j GROUP BY g)
SELECT id, part, CASE WHEN part IS NULL THEN 'not allocated' WHEN k > 1 THEN 'group on both sides' END AS problem FROM j JOIN s USING (g)""")
def _sp11(spark, sf_dir):
    c = customers(spark, sf_dir)
    up = S.random_split(c, "id", 0.8, "r1").filter("id % 20 <> 3")
    return S.inherit_parts(c.withColumn("g", F.col("grp") % 10 * 1000 + F.col("id") % 300), up, "id", "g").select("id", "part", "problem")


@query("sp12_frozen_allocation", "SELECT page_id AS id, CASE WHEN ('0x' || substr(md5('f1|' || page_id), 1, 8))::BIGINT % 10 < 3 THEN 'evaluation' ELSE 'development' END AS part FROM pages")
def _sp12(spark, sf_dir):
    """Allocation of the whole candidate frame before any label is seen."""
    draw = F.conv(F.substring(S.keyed("f1", "page_id"), 1, 8), 16, 10).cast("long")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(draw % 10 < 3, "evaluation").otherwise("development").alias("part"))


@query("ag39_split_audit", f"WITH {RANDOM}, g AS (SELECT grp, count(DISTINCT part) AS p FROM s1 GROUP BY grp) SELECT part, count(*) AS n, count(DISTINCT grp) AS groups, count(DISTINCT cls) AS classes, count(DISTINCT CASE WHEN p > 1 THEN grp END) AS shared_groups FROM s1 JOIN g USING (grp) GROUP BY part")
def _ag39(spark, sf_dir):
    return S.split_audit(S.random_split(customers(spark, sf_dir), "id", 0.8, "r1"), "id", "grp", "cls")


@query("st1_partition_check", f"WITH {RANDOM}, q AS (SELECT id + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS id FROM s1), n AS (SELECT id, count(*) AS t FROM q GROUP BY id) SELECT count(*) FILTER (WHERE n.id IS NULL) AS missing, count(*) FILTER (WHERE c.id IS NULL) AS extra, count(*) FILTER (WHERE t > 1) AS repeated FROM c FULL JOIN n ON c.id = n.id")
def _st1(spark, sf_dir):
    c = customers(spark, sf_dir)
    parts = S.random_split(c, "id", 0.8, "r1").withColumn("id", F.col("id") + F.when(F.col("id") % 50 == 0, 1).otherwise(0))
    return S.partition_check(c, parts, "id")


@query("st2_excluded_ids", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 17 = 0")
def _st2(spark, sf_dir):
    rows = dated(spark, sf_dir)
    parts = S.temporal_split(rows, "id", "t", 0.8).filter("part <> 'excluded'")
    return rows.select("id").exceptAll(parts.select("id"))


@query("st3_id_sets", """WITH a AS (SELECT c_custkey AS id FROM customer), b AS (SELECT o_custkey AS id FROM orders) SELECT (SELECT count(*) FROM (SELECT id FROM b GROUP BY id HAVING count(*) > 1)) AS duplicate, (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) AS missing, (SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) AS extra""")
def _st3(spark, sf_dir):
    a, b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(b.groupBy("id").count().filter("count > 1"), "duplicate").crossJoin(count(a.subtract(b), "missing")).crossJoin(count(b.subtract(a), "extra"))


@query("st4_union_sources", "SELECT 'supplier' AS origin, s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS balance, 0 AS segments FROM supplier GROUP BY 2 UNION ALL SELECT 'customer', c_nationkey, count(*), round(sum(c_acctbal), 2), count(DISTINCT c_mktsegment) FROM customer GROUP BY 2")
def _st4(spark, sf_dir):
    """Union of two sources with their provenance; a column that one lacks is null."""
    s = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("b"))
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("b"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True).groupBy("origin", "nation").agg(F.count("*").alias("n"), F.round(F.sum("b"), 2).alias("balance"), F.count_distinct("segment").alias("segments"))


@query("st5_group_overlap", "SELECT source AS grp FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 2 = 1 AND lang <> 'en'")
def _st5(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.filter("doc_id % 2 = 0").select(F.col("source").alias("grp")).intersect(d.filter("doc_id % 2 = 1 and lang <> 'en'").select("source"))


@query("st6_id_violations", "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'blank' WHEN event_id % 7 = 1 THEN 'not trimmed' END AS problem FROM events WHERE event_id % 7 < 2")
def _st6(spark, sf_dir):
    name = F.when(F.col("event_id") % 7 == 0, "  ").when(F.col("event_id") % 7 == 1, F.concat(F.lit(" "), "event_type")).otherwise(F.concat_ws("-", "event_type", "event_id"))
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), name.alias("name"))
    problem = F.when(F.trim("name") == "", "blank").when(F.trim("name") != F.col("name"), "not trimmed")
    return rows.withColumn("problem", problem).filter("problem is not null").select("id", "problem")


@query("st7_audit_reconciliation", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars < 500) AS short, count(*) FILTER (WHERE n_chars >= 500) AS long, true AS adds_up FROM documents GROUP BY lang")
def _st7(spark, sf_dir):
    got = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count_if(F.col("n_chars") >= 500).alias("long"))
    return got.withColumn("adds_up", (F.col("short") + F.col("long") == F.col("n")) & (F.col("short") <= F.col("n")))


@query("jn9_leakage_gate", f"WITH {RANDOM} SELECT (SELECT count(*) FROM (SELECT id FROM s1 WHERE part = 'train' INTERSECT SELECT id FROM s1 WHERE part = 'test')) AS shared_ids, (SELECT count(*) FROM (SELECT grp FROM s1 WHERE part = 'train' INTERSECT SELECT grp FROM s1 WHERE part = 'test')) AS shared_groups")
def _jn9(spark, sf_dir):
    s = S.random_split(customers(spark, sf_dir), "id", 0.8, "r1")
    return S.leakage(s.filter("part = 'train'"), s.filter("part = 'test'"), "id", "grp")


@query("jn10_axis_rules", f"""WITH {PARTS_SQL}, s AS (SELECT id, element AS e FROM c WHERE id % 10 <> 0), k AS (SELECT DISTINCT e FROM s WHERE id < 100 AND e <> 'Fe'), t AS (SELECT c.id, max(CASE WHEN c.id % 10 = 0 THEN 1 ELSE 0 END) AS unk, count(*) FILTER (WHERE c.id % 10 <> 0 AND k.e IS NULL) AS fresh FROM c LEFT JOIN k ON k.e = c.element WHERE id >= 100 GROUP BY c.id)
SELECT count(*) FILTER (WHERE fresh = 0 AND unk = 0) AS covered_rows, count(*) FILTER (WHERE unk > 0) AS unknown_rows, true AS in_order FROM t""")
def _jn10(spark, sf_dir):
    s = species(spark, sf_dir).withColumn("t", F.col("id"))
    seen = s.filter("id < 100").withColumn("elements", F.array_remove("elements", "Fe"))
    return S.axis_rules(seen, s.filter("id >= 100"), "id", "elements", "t")
