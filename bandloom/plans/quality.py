"""Queries on row quality and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measure as M
from ..operators import quality as Q
from ..registry import query, read

UG = "g AS (SELECT user_id AS id, max(value) - 200 AS gap, avg(value) AS m, count(*) AS n, min(value) AS lo, CAST(floor(max(value)) AS INT) % 9 AS top, CAST(floor(min(value) * 100) AS INT) % 9 AS bottom FROM events GROUP BY user_id)"


def gaps(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg((F.max("value") - 200).alias("gap"), M.exact_mean("value").alias("m"), F.count("*").alias("n"), F.min("value").alias("lo"), (F.floor(F.max("value")).cast("int") % 9).alias("top"), (F.floor(F.min("value") * 100).cast("int") % 9).alias("bottom"))


@query("flt1_candidate_filter", "SELECT event_id FROM events WHERE (CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END IS NULL OR value BETWEEN 10 AND 60) AND user_id BETWEEN 5 AND 100")
def _flt1(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 6 != 0, F.col("value")))
    return Q.candidates(e, {"value": (10, 60), "user_id": (5, 100)}).select("event_id")


@query("flt2_whitelist", "SELECT p_partkey AS id, nullif(trim(CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE p_brand END), '') AS brand, p_type AS first_type FROM part")
def _flt2(spark, sf_dir):
    """Listed columns only; blanks dropped, of a list the first value."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.col("p_brand")).alias("brand"), F.array("p_type", "p_name").alias("dates"))
    return p.select("id", F.nullif(F.trim("brand"), F.lit("")).alias("brand"), F.get("dates", F.lit(0)).alias("first_type"))


@query("flt5_quarantine", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 1)")
def _flt5(spark, sf_dir):
    """Rows whose content is not that of a quarantined one; ids don't matter."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.join(d.filter("doc_id % 10 = 1").select("sha").distinct(), "sha", "left_anti").select("doc_id")


@query("flt6_skip_ledger", f"""WITH {UG}, s AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'no energies' WHEN id % 9 = 0 THEN 'no space group' WHEN id % 8 = 0 THEN 'no gap' WHEN n < 60 THEN 'no envelope' WHEN gap < -0.05 AND id % 2 = 0 THEN 'negative gap' END AS reason FROM g) SELECT coalesce(reason, 'used') AS reason, count(*) AS n FROM s GROUP BY 1""")
def _flt6(spark, sf_dir):
    k = F.col("id")
    reason = Q.skip_reason(F.when(k % 10 != 0, 1), F.when(k % 9 != 0, 1), F.when(k % 8 != 0, F.col("gap")), F.col("n") >= 60, k % 2 != 0)
    return gaps(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


@query("flt9_caption_filter", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\p{L}])(the|und)([^\\p{L}]|$)', 'i') AND NOT regexp_matches(text, '(^|[^\\p{L}])(trash|stupid)([^\\p{L}]|$)', 'i')")
def _flt9(spark, sf_dir):
    word = lambda w: F.col("text").rlike(rf"(?i)(^|[^\p{{L}}])({w})([^\p{{L}}]|$)")
    return read(spark, sf_dir, "documents").filter(word("the|und") & ~word("trash|stupid")).select("doc_id")


@query("flt10_license", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'CC-BY' WHEN 1 THEN 'CC-BY' END AS license, CASE event_id % 4 WHEN 2 THEN 'restricted' WHEN 3 THEN 'unknown' END AS reason FROM events")
def _flt10(spark, sf_dir):
    from ..operators.figures import license_of

    raw = F.element_at(F.array(*[F.lit(x) for x in ("CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/", "cc-by-nc 4.0", "all rights reserved")]), (F.col("event_id") % 4 + 1).cast("int"))
    name, reason = license_of(raw)
    return read(spark, sf_dir, "events").select("event_id", name.alias("license"), reason.alias("reason"))


@query("flt11_eligible_articles", "SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0 AND strlen(html) BETWEEN 500 AND 8000")
def _flt11(spark, sf_dir):
    """Open, not retracted, and of a size within bounds."""
    p = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3 != 0).alias("open"), (F.col("page_id") % 5 == 0).alias("retracted"), F.octet_length("html").alias("size"), F.concat(F.lit("PMC"), "page_id").alias("pmcid"))
    return p.filter(F.col("open") & ~F.col("retracted") & F.col("size").between(500, 8000) & F.col("pmcid").rlike("^PMC[0-9]+$")).select("page_id")


@query("flt12_error_routing", "SELECT CASE event_id % 4 WHEN 0 THEN 'no_data' WHEN 1 THEN 'failed' WHEN 2 THEN 'no_data' ELSE 'ok' END AS route, count(*) AS n FROM events GROUP BY 1")
def _flt12(spark, sf_dir):
    msg = F.element_at(F.array(F.lit("No band data"), F.lit("timeout"), F.lit("path is Line-Mode only"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").groupBy(Q.route_error(msg).alias("route")).agg(F.count("*").alias("n"))


@query("flt13_buckets", "SELECT CASE WHEN x BETWEEN 1 AND 74 THEN '1-74' WHEN x BETWEEN 75 AND 167 THEN '75-167' WHEN x BETWEEN 168 AND 230 THEN '168-230' ELSE 'unknown' END AS spacegroup, CASE WHEN s IN (1, 2, 3) THEN CAST(s AS VARCHAR) WHEN s >= 4 THEN '4+' ELSE 'unknown' END AS sites, count(*) AS n FROM (SELECT p_partkey * 7 % 240 AS x, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 6 END AS s FROM part) GROUP BY ALL")
def _flt13(spark, sf_dir):
    x, s = F.col("p_partkey") * 7 % 240, F.when(F.col("p_size") % 6 != 0, F.col("p_size") % 6)
    return read(spark, sf_dir, "part").groupBy(Q.group_band(x).alias("spacegroup"), Q.sites_band(s).alias("sites")).agg(F.count("*").alias("n"))


@query("flt14_topology", f"WITH {UG}, t AS (SELECT id, CASE WHEN gap < 0 THEN 0 WHEN top = bottom THEN 1 ELSE 2 END AS line, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 3 END AS provider FROM g) SELECT id, line, CASE WHEN provider IS NULL THEN -1 ELSE CAST(line <> provider AS INT) END AS disagreement FROM t")
def _flt14(spark, sf_dir):
    line = Q.line_topology(F.col("gap") < 0, F.col("top"), F.col("bottom"))
    return gaps(spark, sf_dir).select("id", line.alias("line"), Q.disagreement(line, F.when(F.col("id") % 4 != 0, F.col("id") % 3)).alias("disagreement"))


@query("flt15_three_tasks", f"WITH {UG}, m AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 3 AS INT) END AS meta FROM g WHERE id % 4 <> 0), f AS (SELECT id, CAST(id % 2 + 1 AS INT) AS man FROM g) SELECT g.id, CASE WHEN gap < 0 THEN 0 WHEN top = bottom THEN 1 ELSE 2 END AS line, CASE WHEN m.id IS NULL THEN man ELSE coalesce(meta, -1) END AS provider FROM g LEFT JOIN m USING (id) JOIN f USING (id)")
def _flt15(spark, sf_dir):
    """Labels of two tasks; the manifest's type is used only where the metadata lacks the row."""
    g = gaps(spark, sf_dir)
    meta = g.filter("id % 4 <> 0").select("id", F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("int")).alias("meta"), F.lit(True).alias("there"))
    manifest = g.select("id", (F.col("id") % 2 + 1).cast("int").alias("man"))
    line = Q.line_topology(F.col("gap") < 0, F.col("top"), F.col("bottom"))
    j = g.join(meta, "id", "left").join(manifest, "id", "left")
    return j.select("id", line.alias("line"), F.when(F.col("there"), F.coalesce("meta", F.lit(-1))).otherwise(F.col("man")).alias("provider"))


@query("flt16_legacy_type", f"WITH {UG} SELECT CASE WHEN gap < 0.01 THEN 0 WHEN top = bottom THEN 1 ELSE 2 END AS kind, count(*) AS n FROM g GROUP BY 1")
def _flt16(spark, sf_dir):
    return gaps(spark, sf_dir).groupBy(Q.legacy_type(F.col("gap"), F.col("top"), F.col("bottom")).alias("kind")).agg(F.count("*").alias("n"))


@query("flt17_material_class", "SELECT CASE WHEN v <= 0.05 THEN 'metal' WHEN v <= 0.5 THEN 'narrow' WHEN v <= 3 THEN 'semiconductor' ELSE 'insulator' END AS kind, count(*) AS n FROM (SELECT value / 40 AS v FROM events) GROUP BY 1")
def _flt17(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(Q.material_class(F.col("value") / 40).alias("kind")).agg(F.count("*").alias("n"))


@query("flt19_alignment", """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS n, -s_acctbal / 1000 AS v, -s_acctbal / 1000 + s_suppkey % 4 + 0.5 AS c FROM supplier)
SELECT a.id AS a, b.id AS b, CASE WHEN a.c < b.v OR b.c < a.v THEN 'III' WHEN (a.v >= b.v AND a.c <= b.c) OR (b.v >= a.v AND b.c <= a.c) THEN 'I' ELSE 'II' END AS kind FROM s a JOIN s b ON a.n = b.n AND a.id < b.id""")
def _flt19(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"), (-F.col("s_acctbal") / 1000).alias("v"), (-F.col("s_acctbal") / 1000 + F.col("s_suppkey") % 4 + 0.5).alias("c"))
    o = s.select(F.col("id").alias("b"), "n", F.col("v").alias("v2"), F.col("c").alias("c2"))
    return s.join(o, "n").filter("id < b").select(F.col("id").alias("a"), "b", Q.alignment(F.col("v"), F.col("c"), F.col("v2"), F.col("c2")).alias("kind"))


@query("flt20_peak_override", f"WITH {UG} SELECT id, CASE WHEN m / 100 < 0.5 AND abs(top - bottom) <= 4 THEN 'direct' ELSE 'indirect' END AS kind FROM g")
def _flt20(spark, sf_dir):
    return gaps(spark, sf_dir).select("id", Q.peak_override(F.lit("indirect"), F.abs(F.col("top") - F.col("bottom")), 128, F.col("m") / 100).alias("kind"))


@query("flt21_traffic_light", f"WITH {UG}, s AS (SELECT id, (0.6 * least(1, greatest(0, m / 100)) + 0.4 * least(1, greatest(0, gap / 200))) / 1.0 AS score FROM g) SELECT id, round(score, 11) AS score, CASE WHEN score >= 0.6 THEN 'green' WHEN score >= 0.35 THEN 'amber' ELSE 'red' END AS level FROM s")
def _flt21(spark, sf_dir):
    score = Q.weighted_score([(F.col("m") / 100, 0.6), (F.col("gap") / 200, 0.4)])
    return gaps(spark, sf_dir).select("id", F.round(score, 11).alias("score"), Q.traffic_light(score).alias("level"))


@query("flt22_token_flags", "WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'O5' WHEN 1 THEN '12' WHEN 2 THEN 'Il' ELSE 'eV' END AS t, value FROM events) SELECT event_id, concat_ws(',', CASE WHEN regexp_matches(t, '[O0]') THEN 'O or 0' END, CASE WHEN regexp_matches(t, '[Il|]') THEN 'I or l or |' END, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 'digits only' END, CASE WHEN value / 50 < 0.5 THEN 'low score' END) AS flags FROM t")
def _flt22(spark, sf_dir):
    t = F.element_at(F.array(*[F.lit(x) for x in ("O5", "12", "Il", "eV")]), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(Q.token_flags(t, F.col("value") / 50), ",").alias("flags"))


@query("flt25_axis_fit", """WITH t AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 10.0 AS pixel, CASE WHEN user_id % 5 = 0 THEN value ELSE row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 2.5 + 1 END AS v FROM events),
f AS (SELECT id, count(*) AS n, regr_slope(v, pixel) AS slope, regr_intercept(v, pixel) AS i FROM t GROUP BY id), s AS (SELECT *, sign(v - lag(v) OVER (PARTITION BY id ORDER BY pixel)) AS st FROM t),
r AS (SELECT s.id, any_value(n) AS n, any_value(slope) AS slope, min(st) AS a, max(st) AS b, max(abs(v - slope * pixel - i)) AS res FROM s JOIN f USING (id) GROUP BY s.id)
SELECT id, n, CASE WHEN n < 2 THEN 'too few' WHEN a <> b OR a = 0 THEN 'not monotone' WHEN res > greatest(1e-6, abs(slope) / 2) THEN 'residual' ELSE 'ok' END AS status FROM r""")
def _flt25(spark, sf_dir):
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    t = e.select(F.col("user_id").alias("id"), (i * 10.0).alias("pixel"), F.when(F.col("user_id") % 5 == 0, F.col("value")).otherwise(i * 2.5 + 1).alias("value"))
    return Q.axis_fit(t, "id").select("id", "n", "status")


@query("flt27_completion_gate", "SELECT event_type, count(*) AS persisted, count(*) >= 1000 AS reached, count(*) = count(DISTINCT event_id) AS agrees FROM events GROUP BY 1")
def _flt27(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("persisted"), (F.count("*") >= 1000).alias("reached"), (F.count("*") == F.count_distinct("event_id")).alias("agrees"))


@query("flt28_species", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'A,B' WHEN 1 THEN 'A,A' WHEN 2 THEN 'A,B' END AS species, CASE p_partkey % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'single' WHEN 2 THEN 'unverified order' ELSE 'ambiguous' END AS label FROM part")
def _flt28(spark, sf_dir):
    m = F.col("p_partkey") % 4
    ab = F.array(F.lit("A"), F.lit("B"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(m == 0, ab).alias("x"), F.when(m == 1, F.array(F.lit("A"))).when(m == 3, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).otherwise(ab).alias("s"), F.lit(2).alias("n"))
    value, label = Q.resolve_species(F.col("x"), F.col("s"), F.col("n"))
    return rows.select("id", F.array_join(value, ",").alias("species"), label.alias("label"))
