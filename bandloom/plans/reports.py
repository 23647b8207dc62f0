"""Queries on reports, the completion gate, calibrated samples and the pending queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contracts as T
from ..operators import metrics as M
from ..operators import reports as P
from ..operators import review as V
from ..registry import query, read


@query("ag38_value_counts", "SELECT 'lang' AS field, coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY 2")
def _ag38_values(spark, sf_dir):
    return P.value_counts(read(spark, sf_dir, "documents"), ["lang", "source"])


@query("ag38_coverage", "SELECT 'lang' AS field, count(*) FILTER (WHERE lang <> '') AS covered, count(*) AS total FROM documents UNION ALL SELECT 'text', count(*) FILTER (WHERE text <> ''), count(*) FROM documents UNION ALL SELECT 'n_chars', count(n_chars), count(*) FROM documents")
def _ag38_coverage(spark, sf_dir):
    return P.coverage(read(spark, sf_dir, "documents"), ["lang", "text", "n_chars"])


@query("ag38_label_report", "WITH x AS (SELECT 'quality' AS field, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE quality END AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels), g AS (SELECT field, v, count(*) AS n FROM x GROUP BY ALL) SELECT field, CAST(sum(n) FILTER (WHERE v >= 0) AS BIGINT) AS coverage, CAST(sum(n) AS BIGINT) AS total, string_agg(v || ':' || n, ',' ORDER BY v) FILTER (WHERE v >= 0) AS distribution FROM g GROUP BY field")
def _ag38_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").withColumn("quality", F.when(F.col("doc_id") % 13 == 0, -1).otherwise(F.col("quality")))
    return P.label_report(rows, ["quality", "toxic"])


@query("ag38_histogram", "SELECT CAST(least(19, floor(l_quantity / 2.5)) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def _ag38_histogram(spark, sf_dir):
    return P.histogram(read(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0, 20)


MINED = "m AS (SELECT CASE WHEN quality = 1 THEN 'stored' WHEN toxic = 1 THEN 'low_confidence' ELSE 'failed' END AS status, CASE WHEN n_chars >= 500 THEN n_chars / 20000.0 END AS cv_score, CASE n_chars % 3 WHEN 0 THEN 'metal' WHEN 1 THEN 'direct' ELSE 'indirect' END AS predicted_type FROM labels JOIN documents USING (doc_id))"


@query("ag43_mined_documents", f"WITH {MINED} SELECT count(*) AS total, round(count(*) FILTER (WHERE status = 'stored') / count(*), 8) AS success_rate, round(avg(cv_score), 8) AS average_confidence, count(*) FILTER (WHERE status = 'stored' AND predicted_type = 'direct') AS direct_gap_candidates FROM m")
def _ag43_documents(spark, sf_dir):
    n = F.col("n_chars")
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    status = F.when(F.col("quality") == 1, "stored").when(F.col("toxic") == 1, "low_confidence").otherwise("failed")
    kind = F.when(n % 3 == 0, "metal").when(n % 3 == 1, "direct").otherwise("indirect")
    got = P.mining_summary(rows.select(status.alias("status"), F.when(n >= 500, n / 20000.0).alias("cv_score"), kind.alias("predicted_type")))
    return got.withColumns({c: F.round(c, 8) for c in ("success_rate", "average_confidence")})


@query("ag47_run_outcomes", """WITH o AS (SELECT p_size AS g, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS r, CASE WHEN l_linenumber < 7 THEN l_shipdate END AS b, CASE WHEN l_linenumber < 6 THEN l_shipdate + to_days(CAST(l_quantity AS INT)) END AS e FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT b AS t, 1 AS up, 0 AS gone FROM o WHERE b IS NOT NULL UNION ALL SELECT e, 0, 1 FROM o WHERE e IS NOT NULL), d AS (SELECT t, sum(up) AS up, sum(gone) AS gone FROM t GROUP BY t), f AS (SELECT sum(up - gone) OVER (ORDER BY t) AS f FROM d),
g AS (SELECT CAST(g AS VARCHAR) AS g, count(*) AS n FROM o WHERE r = 'A' GROUP BY 1), c AS (SELECT count(*) AS attempted, count(b) AS submitted, count(e) AS completed, count(*) FILTER (WHERE r = 'A') AS success, count(*) FILTER (WHERE r = 'R') AS failed, count(*) FILTER (WHERE r = 'N') AS no_data FROM o)
SELECT c.*, (SELECT string_agg(g || ':' || n, ',' ORDER BY g) FROM g) AS spacegroups, (SELECT CAST(max(f) AS BIGINT) FROM f) AS peak_in_flight, 1000 AS initial_cached, 20000 AS requested_target, submitted - completed AS in_flight, 1000 + success AS total_cached, 1000 + success >= 20000 AS target_reached FROM c""")
def _ag47_outcomes(spark, sf_dir):
    line, part, f = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part"), F.col("l_returnflag")
    outcome = F.when((F.col("l_linestatus") == "O") & (f == "N"), None).when(f == "A", "success").when(f == "R", "failed").otherwise("no_data")
    begun, ended = F.when(F.col("l_linenumber") < 7, F.col("l_shipdate")), F.when(F.col("l_linenumber") < 6, F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int")))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_size").alias("spacegroup"), outcome.alias("outcome"), begun.alias("submitted"), ended.alias("completed"))
    return P.run_report(rows, 1000, 20000)


@query("flt27_report_gate", """WITH p AS (SELECT o_custkey AS run, count(*) AS n, count(DISTINCT o_orderdate) AS dates FROM orders GROUP BY 1), t AS (SELECT c_custkey AS run, 5 + c_nationkey % 8 AS target, c_custkey % 17 <> 0 AS there, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal > 0 END AS reached, CASE WHEN c_custkey % 17 <> 0 THEN 5 + c_nationkey % 8 + CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 5 THEN 1 ELSE 0 END END AS asked FROM customer)
SELECT run, coalesce(n, 0) AS persisted, target, CASE WHEN coalesce(n, 0) < target THEN 'persisted < requested target' WHEN NOT there THEN 'missing report' WHEN NOT reached THEN 'target_reached=false' WHEN asked <> target THEN 'report requested_target differs' WHEN dates <> n THEN 'report total_cached differs' END AS problem FROM t LEFT JOIN p USING (run)""")
def _flt27_report(spark, sf_dir):
    """A run a customer: its orders are persisted, its report counts the days on which it ordered."""
    c, target = read(spark, sf_dir, "customer"), 5 + F.col("c_nationkey") % 8
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_orderdate")
    days = orders.groupBy("run").agg(F.count_distinct("o_orderdate").alias("total_cached"))
    more = ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") < 5)).cast("int")
    reports = c.filter("c_custkey % 17 <> 0").select(F.col("c_custkey").alias("run"), (F.col("c_acctbal") > 0).alias("target_reached"), (target + more).alias("requested_target")).join(days, "run", "left")
    return P.completion_gate(orders, reports, c.select(F.col("c_custkey").alias("run"), target.alias("target")), "run")


SAMPLES = """l AS (SELECT l_orderkey AS obs_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) - 1 AS r, * FROM lineitem),
s AS (SELECT obs_id, r // 3 AS band, r % 3 AS pos, 40.0 * (r % 3) + obs_id % 50 + CASE WHEN l_quantity > 45 THEN (l_discount - 0.05) * 20 ELSE 0 END AS x, CAST(l_suppkey * 3 % 400 AS DOUBLE) AS y, CASE WHEN l_quantity < 8 THEN (l_tax - 0.04) * 0.5 ELSE 0 END AS off, l_quantity = 20 AS no_energy, l_quantity = 30 OR (l_quantity = 20 AND l_linestatus = 'O') AS no_point FROM l)"""


@query("flt26_calibration_review", f"""WITH {SAMPLES}, o AS (SELECT o_orderkey AS obs_id, o_custkey, o_custkey % 37 = 0 AS lost, o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 AS other, c.* FROM orders LEFT JOIN customer c ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'),
h AS (SELECT *, CASE WHEN lost OR c_custkey IS NULL THEN 'calibration.unavailable_or_invalid' WHEN other THEN 'calibration.source_binding' WHEN c_mktsegment = 'MACHINERY' THEN 'calibration.units' WHEN c_acctbal < -900 THEN 'calibration.unavailable_or_invalid' END AS bound FROM o),
b AS (SELECT obs_id, band, count(*) AS n FROM s GROUP BY ALL), w AS (SELECT obs_id, band, -1 AS pos, 'calibration.pixel_points' AS issue FROM b WHERE obs_id % 19 = 0 AND band = 1),
e AS (SELECT s.*, -0.02 - c_nationkey * 0.001 AS slope FROM s JOIN h USING (obs_id) WHERE bound IS NULL AND NOT (obs_id % 19 = 0 AND band = 1)),
i AS (SELECT obs_id, band, pos, CASE WHEN no_energy THEN CASE WHEN NOT no_point THEN 'calibration.missing_sample' END WHEN no_point OR x < 0 OR x >= 170 OR y < 0 OR y >= 390 THEN 'calibration.pixel_bounds' WHEN abs(slope * y + 3 - (slope * y + 3 + off)) > 0.016 THEN 'calibration.energy_mismatch' WHEN pos = 2 AND obs_id % 23 = 0 THEN 'calibration.unavailable_or_invalid' WHEN abs(0.01 * x + 0.1 - (0.01 * (40.0 * pos + obs_id % 50) + 0.1)) > 0.0085 THEN 'calibration.k_mismatch' END AS issue FROM e),
a AS (SELECT * FROM i WHERE issue IS NOT NULL UNION ALL SELECT w.* FROM w JOIN h USING (obs_id) WHERE bound IS NULL), f AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY band, pos) AS k FROM a)
SELECT h.obs_id, coalesce(bound, issue) AS issue, CAST(band AS INT) AS band, CAST(pos AS INT) AS pos FROM h LEFT JOIN f ON f.obs_id = h.obs_id AND k = 1""")
def _flt26_review(spark, sf_dir):
    """An observation an order: its lines are samples of bands of three, its customer's record the calibration."""
    o, c, k = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), F.col("o_orderkey")
    owner = F.concat(F.lit("att"), "o_custkey")
    other = (F.col("o_orderpriority") == "1-URGENT") & (k % 2 == 0)
    axis = F.transform(F.sequence(F.lit(0), F.when(k % 23 == 0, 1).otherwise(2)), lambda i: 0.01 * (40.0 * i + k % 50) + 0.1)
    obs = o.select(
        k.alias("obs_id"), F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_custkey") % 37 == 0, -1).otherwise(F.col("o_custkey"))).alias("calibration_id"), owner.alias("attachment_id"),
        F.when(other, F.sha2(F.lit("another"), 256)).otherwise(F.sha2(owner, 256)).alias("source_sha256"), F.lit("eV").alias("energy_unit"), F.lit("relative").alias("k_unit"), axis.alias("k_distance"),
    )
    name = F.concat(F.lit("att"), "c_custkey")
    slope = -0.02 - F.col("c_nationkey") * 0.001
    cal = c.select(
        F.col("c_custkey").alias("calibration_id"), name.alias("attachment_id"), F.sha2(name, 256).alias("source_sha256"), F.when(F.col("c_mktsegment") == "MACHINERY", "Ha").otherwise("eV").alias("energy_unit"), F.lit("relative").alias("k_unit"),
        F.lit(170).alias("width"), F.lit(390).alias("height"), slope.alias("e_slope"), F.lit(3.0).alias("e_intercept"), F.when(F.col("c_acctbal") >= -900, 0.016).alias("e_tolerance"), F.lit(0.01).alias("k_slope"), F.lit(0.1).alias("k_intercept"), F.lit(0.0085).alias("k_tolerance"),
    )
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")) - 1
    q = F.col("l_quantity")
    line = read(spark, sf_dir, "lineitem").withColumn("r", place).join(o.select(k.alias("l_orderkey"), "o_custkey"), "l_orderkey").join(c.select(F.col("c_custkey").alias("o_custkey"), slope.alias("slope")), "o_custkey", "left")
    pos = F.col("r") % 3
    x = 40.0 * pos + F.col("l_orderkey") % 50 + F.when(q > 45, (F.col("l_discount") - 0.05) * 20).otherwise(0.0)
    y = (F.col("l_suppkey") * 3 % 400).cast("double")
    energy = F.coalesce("slope", F.lit(-0.02)) * y + 3.0 + F.when(q < 8, (F.col("l_tax") - 0.04) * 0.5).otherwise(0.0)
    point = F.when((q == 30) | ((q == 20) & (F.col("l_linestatus") == "O")), None).otherwise(F.array(x, y))
    each = line.select(F.col("l_orderkey").alias("obs_id"), F.floor(F.col("r") / 3).cast("int").alias("band"), F.struct(pos.alias("pos"), F.when(q != 20, energy).alias("energy"), point.alias("point")).alias("s"))
    bands = each.groupBy("obs_id", "band").agg(F.array_sort(F.collect_list("s")).alias("s"))
    short = (F.col("obs_id") % 19 == 0) & (F.col("band") == 1)
    points = F.transform("s", lambda v: v["point"])
    bands = bands.select("obs_id", "band", F.transform("s", lambda v: v["energy"]).alias("energies"), F.when(short, F.slice(points, 1, F.size(points) - 1)).otherwise(points).alias("pixel_points"))
    return V.calibrated_samples(obs, bands, cal)


QUEUE = r"""h AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), j AS (SELECT page_id, url, host, html, CASE WHEN page_id % 31 <> 0 THEN '{"length":' || length(html) || ',"page":' || page_id || ',"source":"' || host || '"}' END AS obs, '{"length":' || CASE WHEN page_id % 5 = 0 THEN strlen(html) ELSE length(html) END || ',"page":' || page_id || ',"source":"' || host || '"}' AS old FROM h),
r AS (SELECT *, sha256(old) AS claimed, 'mcp-audit-' || substr(sha256(CASE WHEN url LIKE '%page=2%' THEN url ELSE old END), 1, 20) AS id, CASE WHEN page_id % 29 = 0 THEN 2 ELSE 1 END AS version, CASE page_id % 11 WHEN 0 THEN 'other' WHEN 1 THEN 'validation' WHEN 2 THEN 'evaluation' ELSE 'train' END AS split FROM j)"""


@query("jn24_queue_records", f"""WITH {QUEUE} SELECT id AS record_id, CASE WHEN version <> 1 THEN 'invalid pending review record' WHEN split = 'other' THEN 'invalid pending review split' WHEN obs IS NULL THEN 'missing pending observations' WHEN sha256(obs) <> claimed THEN 'pending observation SHA mismatch' WHEN id <> 'mcp-audit-' || substr(sha256(obs), 1, 20) THEN 'pending record ID mismatch'
WHEN length(host) % 7 = 0 THEN 'pending source binding mismatch' WHEN page_id % 13 = 0 THEN 'pending queue cannot contain human approval' WHEN page_id % 17 = 0 THEN 'pending queue cannot contain operator authentication' WHEN page_id % 19 = 0 THEN 'pending queue must identify AI-prefilled records' END AS problem FROM r""")
def _jn24_records(spark, sf_dir):
    """A record a page; every fifth was queued with the length in bytes, so its digest holds only for pages of plain characters."""
    k, host = F.col("page_id"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    text = lambda length: F.concat(F.lit('{"length":'), length, F.lit(',"page":'), k, F.lit(',"source":"'), host, F.lit('"}'))
    queued = text(F.when(k % 5 == 0, F.octet_length("html")).otherwise(F.length("html")))
    rows = read(spark, sf_dir, "pages").select(
        F.concat(F.lit("mcp-audit-"), F.substring(F.sha2(F.when(F.col("url").contains("page=2"), F.col("url")).otherwise(queued), 256), 1, 20)).alias("record_id"), F.when(k % 29 == 0, 2).otherwise(1).alias("schema_version"),
        F.when(k % 11 == 0, "other").when(k % 11 == 1, "validation").when(k % 11 == 2, "evaluation").otherwise("train").alias("intended_split"), F.when(k % 31 != 0, text(F.length("html"))).alias("observations"), F.sha2(queued, 256).alias("observation_sha256"),
        F.when(F.length(host) % 7 == 0, F.concat(host, F.lit(".other"))).otherwise(host).alias("source"), F.when(k % 13 == 0, "yes").alias("independent_human_review"), F.when(k % 17 == 0, "key").alias("operator_authentication"), (k % 19 != 0).alias("ai_prefilled"),
    )
    return V.queue_records(rows)


HEADS = "p AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'view') AS b, count(*) FILTER (WHERE event_type = 'error') AS c, list(value ORDER BY event_id) AS v, list(event_id % 7 * 1.0 ORDER BY event_id) AS w, avg(value) / 3.5 AS gap FROM events GROUP BY user_id), q AS (SELECT *, greatest(a + b + c, 1e-12) AS t FROM p), e AS (SELECT *, list_sum([-(x / t) * ln(x / t + 1e-12) for x in [a, b, c]]) / ln(3) AS h, least(CASE WHEN list_max(v) > 0 THEN least(1, greatest(0, 1 - list_avg(v) / list_max(v))) ELSE 0 END, CASE WHEN list_max(w) > 0 THEN least(1, greatest(0, 1 - list_avg(w) / list_max(w))) ELSE 0 END) AS s FROM q), z AS (SELECT *, least(1, greatest(0, 0.45 * (1 - h) + 0.35 * s + 0.2 * CASE WHEN gap BETWEEN -0.05 AND 15 THEN 1 ELSE 0.3 END)) AS score FROM e)"


@query("ag33_prediction_confidence", f"WITH {HEADS} SELECT user_id, round(score, 8) AS score, CASE WHEN score >= 0.6 THEN 'green' WHEN score >= 0.35 THEN 'yellow' ELSE 'red' END AS level, round(h, 8) AS entropy, round(s, 8) AS peak_sharpness, gap BETWEEN -0.05 AND 15 AS gap_plausible FROM z")
def _ag33_confidence(spark, sf_dir):
    """Three classes, two heads and a gap of each user's events."""
    is_ = lambda name: F.count_if(F.col("event_type") == name).cast("double")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("event_id", c.alias("v")))), lambda x: x["v"])
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array(is_("click"), is_("view"), is_("error")).alias("probs"), ordered(F.col("value")).alias("v"), ordered(F.col("event_id") % 7 * F.lit(1.0)).alias("w"), (F.avg("value") / 3.5).alias("gap"))
    got = u.select("user_id", M.prediction_confidence(F.col("probs"), F.col("v"), F.col("w"), F.col("gap")).alias("x")).select("user_id", "x.*")
    return got.withColumns({c: F.round(c, 8) for c in ("score", "entropy", "peak_sharpness")})


SIZES = "r AS (SELECT c_custkey AS id, 1 + c_custkey % 3 AS bands, 2 + c_custkey % 4 AS points, CASE WHEN c_custkey % 2 = 0 THEN 1 + c_nationkey % 3 END AS n_bands, CASE WHEN c_custkey % 5 < 3 THEN 1 + length(c_mktsegment) % 3 END AS num_bands, CASE WHEN c_custkey % 7 < 2 THEN 2 + c_nationkey % 4 END AS n_kpoints, CASE WHEN c_custkey % 3 = 0 THEN 2 + CAST(floor(abs(c_acctbal)) AS INT) % 4 END AS num_kpoints, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey // 2 END AS held, round(c_acctbal / 2000) AS efermi FROM customer)"


@query("flt4_declared_sizes", f"""WITH {SIZES}, x AS (SELECT id, CASE WHEN held IS NOT NULL AND num_bands IS NOT NULL AND held <> num_bands THEN 'conflicting_source_metadata' WHEN n_bands <> bands THEN 'declared_n_bands_mismatch_or_illegal' WHEN num_bands <> bands THEN 'declared_num_bands_mismatch_or_illegal' WHEN n_kpoints <> points THEN 'declared_n_kpoints_mismatch_or_illegal' WHEN num_kpoints <> points THEN 'declared_num_kpoints_mismatch_or_illegal' WHEN efermi <> 0 THEN 'invalid_aflow_energy_reference' END AS reason FROM r)
SELECT id, CASE WHEN reason IS NULL THEN 'verified_valid' ELSE 'invalid' END AS status, coalesce(reason, '') AS reasons FROM x""")
def _flt4_sizes(spark, sf_dir):
    """Declared numbers of bands and samples against the arrays, several defects at once, each rule worked out from values."""
    k, nation, null = F.col("c_custkey"), F.col("c_nationkey"), F.lit(None)
    points = (2 + k % 4).cast("int")
    axis = F.transform(F.sequence(F.lit(0), points - 1), lambda i: i.cast("double"))
    held = F.when(nation % 2 == 0, F.create_map(F.lit("num_bands"), F.floor(nation / 2).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = read(spark, sf_dir, "customer").select(
        k.alias("id"), F.lit("aflow").alias("source"), F.lit("aflow_bandsdata_v1").alias("source_schema"), F.lit("bands_k").alias("band_layout"), F.lit("declared").alias("source_semantics_evidence"), F.lit("as reported").alias("energy_reference"), F.lit(1).alias("spin_channels"), null.cast("int").alias("spin_axis"),
        F.when(k % 2 == 0, 1 + nation % 3).alias("n_bands"), F.when(k % 5 < 3, 1 + F.length("c_mktsegment") % 3).alias("num_bands"), F.when(k % 7 < 2, 2 + nation % 4).alias("n_kpoints"), F.when(k % 3 == 0, 2 + F.floor(F.abs("c_acctbal")).cast("int") % 4).alias("num_kpoints"),
        F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda b: F.transform(axis, lambda v: v + b)).alias("energies"), axis.alias("k_distances"), null.cast("array<array<double>>").alias("kpoints"), F.round(F.col("c_acctbal") / 2000).alias("efermi"), null.cast("double").alias("source_efermi_absolute"), null.cast("string").alias("content_sha256"), held.alias("metadata"),
    )
    return T.source_quality(rows).select("id", "status", F.array_join("reasons", ",").alias("reasons"))


@query("key11_text_fingerprint", "WITH p AS (SELECT l_orderkey AS id, list([CAST(l_quantity * 1000 AS BIGINT), CAST(round(l_extendedprice * 1000) AS BIGINT), CAST(round(l_tax * 1000) AS BIGINT)] ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS t FROM lineitem GROUP BY 1) SELECT id, sha256('(' || len(t) || ', 3)' || array_to_string([array_to_string(x, ',') for x in t], ';')) AS fingerprint FROM p")
def _key11_text(spark, sf_dir):
    """The SQL form of the content fingerprint: shape and numbers in thousandths, as text."""
    from ..operators.features import text_fingerprint

    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"]
    p = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*cols, F.col("l_quantity").alias("k")))).alias("x"))
    side = lambda c: F.transform("x", lambda v: v[c])
    return p.select("id", text_fingerprint(side("k"), F.array(side("l_extendedprice"), side("l_tax"))).alias("fingerprint"))
