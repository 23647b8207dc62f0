"""Queries on boxes, reviews and evidence; boxes are derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import figures as G
from ..operators import quality as Q
from ..operators import reports as R
from ..registry import query, read

BOX = "b AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS box_id, l_quantity * 4 AS x1, l_discount * 1000 AS y1, l_quantity * 4 + 60 + l_linenumber * 12 AS x2, l_discount * 1000 + 50 + l_suppkey % 90 AS y2, l_extendedprice AS score FROM lineitem)"


def boxes(spark, sf_dir):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    x, y = F.col("l_quantity") * 4, F.col("l_discount") * 1000
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), r.alias("box_id"), x.alias("x1"), y.alias("y1"), (x + 60 + F.col("l_linenumber") * 12).alias("x2"), (y + 50 + F.col("l_suppkey") % 90).alias("y2"), F.col("l_extendedprice").alias("score"))


IOU = "greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1))"


@query("jn21_box_match", f"""WITH {BOX}, a AS (SELECT * FROM b WHERE box_id % 2 = 1), c AS (SELECT * FROM b WHERE box_id % 2 = 0), p AS (SELECT a.image, a.box_id, c.box_id AS o, {IOU} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - {IOU}) AS v FROM a LEFT JOIN c ON a.image = c.image),
g AS (SELECT image, box_id, coalesce(max(v), 0) AS best, count(o) AS labels FROM p GROUP BY ALL) SELECT image, box_id, round(best, 9) AS best, labels, CASE WHEN labels = 0 THEN 'missing' WHEN best < 0.5 THEN 'low' WHEN labels > 1 THEN 'multi' ELSE 'ok' END AS flag FROM g""")
def _jn21(spark, sf_dir):
    b = boxes(spark, sf_dir).select("image", "box_id", F.struct("x1", "y1", "x2", "y2").alias("box"))
    return G.best_match(b.filter("box_id % 2 = 1"), b.filter("box_id % 2 = 0"), "image").withColumn("best", F.round("best", 9))


@query("jn22_suppression", f"""WITH RECURSIVE {BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS r FROM b),
k AS (SELECT image, 1 AS r, [struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept, [box_id] AS ids FROM o WHERE r = 1
UNION ALL SELECT k.image, o.r, CASE WHEN hit THEN kept ELSE list_append(kept, struct_pack(x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) END, CASE WHEN hit THEN ids ELSE list_append(ids, box_id) END
FROM k JOIN o ON o.image = k.image AND o.r = k.r + 1, LATERAL (SELECT coalesce(list_bool_or([greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1)) >= 0.55 * ((q.x2 - q.x1) * (q.y2 - q.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1))) for q in kept]), false) AS hit) h),
l AS (SELECT image, max_by(ids, r) AS ids FROM k GROUP BY image) SELECT image, unnest(ids) AS box_id FROM l""")
def _jn22(spark, sf_dir):
    return G.suppress(boxes(spark, sf_dir), "image").select("image", "box_id")


@query("flt32_clean_boxes", f"WITH {BOX}, c AS (SELECT image, box_id, least(200, greatest(0, x1)) AS x1, least(200, greatest(0, x2)) AS x2, least(150, greatest(0, y1)) AS y1, least(150, greatest(0, y2)) AS y2 FROM b) SELECT image, box_id, round((x2 - x1) * (y2 - y1), 6) AS area FROM c WHERE x2 - x1 >= 70 AND y2 - y1 >= 55 AND (x2 - x1) * (y2 - y1) <= 0.85 * 200 * 150")
def _flt32(spark, sf_dir):
    got = G.clean_boxes(boxes(spark, sf_dir), 200, 150)
    return got.select("image", "box_id", F.round((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), 6).alias("area"))


@query("fn15_percent_boxes", "WITH p AS (SELECT event_id, value / 2 AS x, event_id % 90 AS y, user_id / 2.0 AS w, 12.0 AS h FROM events), q AS (SELECT *, CAST(round(x * 8) AS INT) AS x1, CAST(round(y * 6) AS INT) AS y1, CAST(round((x + w) * 8) AS INT) AS x2, CAST(round((y + h) * 6) AS INT) AS y2, x + w <= 100 AND y + h <= 100 AS ok FROM p) SELECT event_id, CASE WHEN ok AND x2 > x1 THEN x1 END AS x1, CASE WHEN ok AND x2 > x1 THEN y2 END AS y2 FROM q")
def _fn15(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.struct((F.col("value") / 2).alias("x"), (F.col("event_id") % 90).alias("y"), (F.col("user_id") / 2.0).alias("w"), F.lit(12.0).alias("h")).alias("b"))
    p = G.to_pixels(F.col("b"), F.lit(800), F.lit(600))
    return e.select("event_id", p["x1"].alias("x1"), p["y2"].alias("y2"))


@query("snk5_coco_rows", f"WITH {BOX} SELECT image AS image_id, CAST(box_id AS INT) AS annotation, round(x1, 6) AS x, round(x2 - x1, 6) AS w, round((x2 - x1) * (y2 - y1), 6) AS area, CASE WHEN image % 3 = 0 THEN 1 ELSE 0 END AS ignore FROM b")
def _snk5(spark, sf_dir):
    b = boxes(spark, sf_dir).groupBy(F.col("image").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("box_id", "x1", "y1", "x2", "y2"))).alias("boxes"))
    b = b.withColumn("target", F.when(F.col("image_id") % 3 == 0, "uncertain").otherwise("yes"))
    return G.coco_rows(b).select("image_id", "annotation", *[F.round(c, 6).alias(c) for c in ("x", "w", "area")], "ignore")


@query("snk6_label_lines", f"WITH {BOX} SELECT image, box_id, printf('%d %.6f %.6f %.6f %.6f', CAST(image % 2 AS INT), least(1, greatest(0, (x1 + x2) / 2 / 487)), least(1, greatest(0, (y1 + y2) / 2 / 487)), least(1, greatest(0, (x2 - x1) / 487)), least(1, greatest(0, (y2 - y1) / 487))) AS line FROM b")
def _snk6(spark, sf_dir):
    line = G.label_line(F.col("image") % 2, *[F.col(c) for c in ("x1", "y1", "x2", "y2")], 487.0, 487.0)
    return boxes(spark, sf_dir).select("image", "box_id", line.alias("line"))


@query("jn13_review_queue", "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'no mark' WHEN page_id % 5 = 0 THEN 'sha differs' WHEN page_id % 7 = 0 THEN 'host differs' END AS problem FROM pages")
def _jn13(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"), F.substring("url", 1, 20).alias("host"))
    k = F.col("page_id")
    marks = p.filter(k % 6 != 0).withColumn("sha", F.when(k % 5 == 0, "other").otherwise(F.col("sha"))).withColumn("host", F.when(k % 7 == 0, "other").otherwise(F.col("host")))
    return G.review_queue(p, marks, "page_id", ["sha", "host"])


@query("jn24_digest_check", "SELECT doc_id, doc_id % 8 <> 0 AS bound FROM documents")
def _jn24(spark, sf_dir):
    """Recompute the digest that a queue record claims and compare."""
    d = read(spark, sf_dir, "documents")
    claim = F.when(F.col("doc_id") % 8 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return d.select("doc_id", "text", claim.alias("claim")).select("doc_id", (F.sha2("text", 256) == F.col("claim")).alias("bound"))


@query("wn10_duplicate_flags", "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS repeated, dense_rank() OVER (PARTITION BY text ORDER BY source) + dense_rank() OVER (PARTITION BY text ORDER BY source DESC) - 1 > 1 AS across_sources FROM documents")
def _wn10(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("sha")
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return d.select("doc_id", (F.count("*").over(w) > 1).alias("repeated"), (F.size(F.collect_set("source").over(w)) > 1).alias("across_sources"))


@query("flt26_calibrated_samples", "WITH s AS (SELECT user_id AS id, event_id, abs(value - (value + CASE WHEN event_id % 97 = 0 THEN 0.2 ELSE 0.001 END)) AS off FROM events) SELECT id, count(*) FILTER (WHERE off > 0.01) AS bad, min(event_id) FILTER (WHERE off > 0.01) AS first_bad FROM s GROUP BY id")
def _flt26(spark, sf_dir):
    """Samples whose value disagrees with what the calibration says, and the first of them."""
    s = read(spark, sf_dir, "events").withColumn("seen", F.col("value") + F.when(F.col("event_id") % 97 == 0, 0.2).otherwise(0.001))
    off = F.abs(F.col("value") - F.col("seen")) > 0.01
    return s.groupBy(F.col("user_id").alias("id")).agg(F.count_if(off).alias("bad"), F.min(F.when(off, F.col("event_id"))).alias("first_bad"))


@query("flt29_questions", "SELECT id, CAST(i - 1 AS INT) AS place, CASE c WHEN 'reference' THEN 'Which reference level?' WHEN 'units' THEN 'Which units?' ELSE 'Please add evidence.' END AS question FROM (SELECT id, unnest(l) AS c, unnest(range(1, len(l) + 1)) AS i FROM (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN ['reference', 'units'] WHEN 1 THEN ['units', 'odd'] ELSE ['odd'] END AS l FROM customer))")
def _flt29(spark, sf_dir):
    """Missing-evidence codes to questions, each once and in order; unknown codes get the default."""
    k = F.col("c_custkey") % 3
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    codes = F.when(k == 0, arr("reference", "units", "reference")).when(k == 1, arr("units", "odd", "units")).otherwise(arr("odd", "odd"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(F.array_distinct(codes)).alias("place", "code"))
    table = spark.createDataFrame([("reference", "Which reference level?"), ("units", "Which units?")], "code string, question string")
    return rows.join(F.broadcast(table), "code", "left").select("id", "place", F.coalesce("question", F.lit("Please add evidence.")).alias("question"))


@query("flt30_decisions", "SELECT event_type, CASE WHEN event_type IN ('view', 'error') THEN NULL WHEN user_id % 2 = 0 THEN 'reviewed' ELSE 'proposed' END AS status, CASE event_type WHEN 'view' THEN 'approval refused' WHEN 'error' THEN 'unknown decision' END AS refused, count(*) AS n FROM events GROUP BY ALL")
def _flt30(spark, sf_dir):
    t = F.col("event_type")
    d = F.when(t == "view", "approved").when(t == "error", "maybe").when(t == "click", "accept").when(t == "signup", "reject").otherwise("unclear")
    status, refused = G.decision_status(d, F.when(F.col("user_id") % 2 == 0, "human").otherwise("assistant"), F.col("props"))
    return read(spark, sf_dir, "events").groupBy("event_type", status.alias("status"), refused.alias("refused")).agg(F.count("*").alias("n"))


@query("ag44_batch_coverage", "WITH w AS (SELECT unnest(range(1, 1001)) AS i), g AS (SELECT o_custkey AS i, count(*) AS t FROM orders GROUP BY 1) SELECT count(*) FILTER (WHERE t IS NULL) AS missing, count(*) FILTER (WHERE t > 1 AND w.i IS NOT NULL) AS doubled, count(*) FILTER (WHERE w.i IS NULL) AS out_of_range FROM w FULL JOIN g ON w.i = g.i")
def _ag44(spark, sf_dir):
    return G.batch_coverage(read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("number")), 1000)


@query("ag45_status_crosstab", "SELECT event_type AS status, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS target, count(*) AS n FROM events GROUP BY ALL")
def _ag45(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.when(F.col("value") > 50, "yes").otherwise("no").alias("target"))
    return R.status_crosstab(rows, "status", "target")


@query("ag48_detection_report", f"WITH {BOX}, i AS (SELECT image, count(*) FILTER (WHERE score > 30000) AS n FROM b GROUP BY image) SELECT count(*) FILTER (WHERE n > 0) AS positive, count(*) FILTER (WHERE n = 0) AS hard_negative, CAST(sum(n) AS BIGINT) AS boxes FROM i")
def _ag48(spark, sf_dir):
    pages = boxes(spark, sf_dir).groupBy("image").agg(F.collect_list(F.when(F.col("score") > 30000, F.col("box_id"))).alias("found"))
    return R.detection_report(pages, F.col("found")).withColumnsRenamed({"positive_pages": "positive", "hard_negative_pages": "hard_negative"})
