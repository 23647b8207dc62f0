"""Queries on predictions: quality and toxic labels of documents, prices, and embeddings as scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import reports as P
from ..registry import query, read

PRED = """x AS (SELECT d.doc_id, lang, source, n_chars, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE quality + toxic END AS y_true, CASE WHEN n_chars % 7 = 0 THEN 2 WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS y_pred
FROM documents d JOIN labels l USING (doc_id)), k AS (SELECT * FROM x WHERE y_true <> -1)"""


def predictions(spark, sf_dir):
    """Three classes: quality plus toxic; predicted from the length."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    y = F.when(F.col("doc_id") % 13 == 0, -1).otherwise(F.col("quality") + F.col("toxic"))
    p = F.when(F.col("n_chars") % 7 == 0, 2).when(F.col("n_chars") % 3 == 0, 0).otherwise(1)
    return d.join(lab, "doc_id").select("doc_id", "lang", "source", "n_chars", y.alias("y_true"), p.alias("y_pred"))


def r8(df, *cols):
    return df.withColumns({c: F.round(c, 8) for c in cols})


CONF = "g AS (SELECT a.i AS y_true, b.i AS y_pred FROM (SELECT CAST(unnest(range(3)) AS INT) i) a, (SELECT CAST(unnest(range(3)) AS INT) i) b), m AS (SELECT g.y_true, g.y_pred, count(k.doc_id) AS n FROM g LEFT JOIN k USING (y_true, y_pred) GROUP BY ALL)"


@query("ag10_confusion", f"WITH {PRED}, {CONF} SELECT * FROM m")
def _ag10(spark, sf_dir):
    return M.confusion(predictions(spark, sf_dir), 3)


@query("ag11_accuracy", f"WITH {PRED}, r AS (SELECT y_true, avg(CAST(y_true = y_pred AS DOUBLE)) AS r FROM k GROUP BY 1) SELECT count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 8) AS accuracy, (SELECT round(avg(r), 8) FROM r) AS macro_accuracy, (SELECT count(*) FROM x WHERE y_true = -1) AS unknown FROM k")
def _ag11(spark, sf_dir):
    return r8(M.accuracy(predictions(spark, sf_dir)), "accuracy", "macro_accuracy")


@query("ag12_f1_scores", f"""WITH {PRED}, {CONF}, s AS (SELECT c.i AS cls, (SELECT n FROM m WHERE y_true = c.i AND y_pred = c.i) AS tp, (SELECT sum(n) FROM m WHERE y_true = c.i) AS re, (SELECT sum(n) FROM m WHERE y_pred = c.i) AS sa FROM (SELECT CAST(unnest(range(3)) AS INT) i) c)
SELECT cls, round(CASE WHEN sa > 0 THEN tp / sa ELSE 0 END, 8) AS precision, round(CASE WHEN re > 0 THEN tp / re ELSE 0 END, 8) AS recall, round(CASE WHEN re + sa > 0 THEN 2 * tp / (re + sa) ELSE 0 END, 8) AS f1, round(avg(CASE WHEN re + sa > 0 THEN 2 * tp / (re + sa) ELSE 0 END) OVER (), 8) AS macro_f1 FROM s""")
def _ag12(spark, sf_dir):
    return r8(M.f1_scores(predictions(spark, sf_dir), 3), "precision", "recall", "f1", "macro_f1")


@query("ag13_scoped_accuracy", f"""WITH {PRED}, r AS (SELECT source, CAST(y_true = y_pred AS DOUBLE) AS ok, lang = 'en' AS m FROM k), g AS (SELECT source, avg(ok) AS a FROM r GROUP BY source)
SELECT round(avg(ok), 8) AS sample_accuracy, (SELECT round(avg(a), 8) FROM g) AS group_accuracy, round(avg(ok) FILTER (WHERE m), 8) AS matched_accuracy, round(avg(ok) FILTER (WHERE NOT m), 8) AS other_accuracy FROM r""")
def _ag13(spark, sf_dir):
    return r8(M.scoped_accuracy(predictions(spark, sf_dir), "source", F.col("lang") == "en"), "sample_accuracy", "group_accuracy", "matched_accuracy", "other_accuracy")


@query("ag14_stratified_errors", f"WITH {PRED} SELECT 'lang' AS stratum, lang AS value, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 8) AS accuracy FROM k GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(CAST(y_true = y_pred AS DOUBLE)), 8) FROM k GROUP BY source")
def _ag14(spark, sf_dir):
    return r8(M.stratified_errors(predictions(spark, sf_dir), ["lang", "source"]), "accuracy")


@query("ag14_crossed_errors", f"WITH {PRED} SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 8) AS accuracy FROM k GROUP BY CUBE (lang, source)")
def _ag14x(spark, sf_dir):
    return r8(M.crossed_errors(predictions(spark, sf_dir), "lang", "source"), "accuracy")


@query("ag15_task_summary", f"""WITH {PRED}, t AS (SELECT unnest(['quality', 'length']) AS task, * FROM x), u AS (SELECT task, CASE WHEN task = 'length' AND y_true <> -1 THEN CAST(n_chars > 2000 AS INT) ELSE y_true END AS y_true, y_pred FROM t),
r AS (SELECT task, avg(a) AS ma FROM (SELECT task, y_true, avg(CAST(y_true = y_pred AS DOUBLE)) AS a FROM u WHERE y_true <> -1 GROUP BY ALL) GROUP BY task)
SELECT task, count(*) FILTER (WHERE y_true <> -1) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)) FILTER (WHERE y_true <> -1), 8) AS accuracy, round(any_value(ma), 8) AS macro_accuracy, count(*) FILTER (WHERE y_true = -1) AS unknown FROM u JOIN r USING (task) GROUP BY task""")
def _ag15(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("task", F.explode(F.array(F.lit("quality"), F.lit("length"))))
    rows = rows.withColumn("y_true", F.when((F.col("task") == "length") & (F.col("y_true") != -1), (F.col("n_chars") > 2000).cast("int")).otherwise(F.col("y_true")))
    return r8(M.accuracy(rows, ["task"]), "accuracy", "macro_accuracy").select("task", "n", "accuracy", "macro_accuracy", "unknown")


PRICE = "z AS (SELECT l_returnflag, l_extendedprice / 1000 AS pred, p_retailprice * l_quantity / 1000 AS target FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("ag16_regression", f"""WITH {PRICE} SELECT l_returnflag, count(*) AS n, round(avg(abs(pred - target)), 6) AS mae, round(avg((pred - target) ** 2), 5) AS mse, round(sqrt(avg((pred - target) ** 2)), 6) AS rmse, round(avg(pred - target), 6) AS bias, round(max(abs(pred - target)), 6) AS max_abs,
round(corr(pred, target), 6) AS r, round(1 - avg((pred - target) ** 2) / var_pop(target), 6) AS r2, round(avg(CASE WHEN abs(pred - target) > 20 THEN 1.0 ELSE 0.0 END), 8) AS over FROM z GROUP BY 1""")
def _ag16(spark, sf_dir):
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    z = line.join(part, line["l_partkey"] == part["p_partkey"]).select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("pred"), (F.col("p_retailprice") * F.col("l_quantity") / 1000).alias("target"))
    got = M.regression(z, 20.0, ["l_returnflag"])
    return got.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "bias", "max_abs", "r", "r2")}).withColumns({"mse": F.round("mse", 5), "over": F.round("over", 8)})


@query("ag17_group_bootstrap", f"""WITH {PRED}, g AS (SELECT source AS g, count(*) AS n, sum(CAST(y_true = y_pred AS INT)) AS c, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM k GROUP BY source),
d AS (SELECT b, CAST(floor(('0x' || substr(md5(concat_ws('|', 's1', b, i)), 1, 8))::BIGINT / 4294967296.0 * k) AS INT) AS i FROM g, (SELECT unnest(range(500)) AS b)),
p AS (SELECT b, sum(c) / sum(n) AS pooled, avg(c / n) AS macro, max(k) AS k FROM d JOIN g USING (i) GROUP BY b)
SELECT max(k) AS groups, round(avg(pooled), 8) AS mean, round(stddev_pop(pooled), 8) AS std, round(quantile_cont(pooled, 0.025), 8) AS low, round(quantile_cont(pooled, 0.975), 8) AS high, round(quantile_cont(macro, 0.025), 8) AS macro_low, round(quantile_cont(macro, 0.975), 8) AS macro_high FROM p""")
def _ag17(spark, sf_dir):
    return r8(M.group_bootstrap(predictions(spark, sf_dir), "source", 500, "s1"), "mean", "std", "low", "high", "macro_low", "macro_high")


@query("ag18_seed_summary", f"""WITH {PRED}, r AS (SELECT lang AS split, doc_id % 3 AS seed, avg(CAST(y_true = y_pred AS DOUBLE)) AS a FROM k GROUP BY ALL)
SELECT split, round(avg(a), 8) AS mean, round(coalesce(stddev_samp(a), 0), 8) AS std, round(min(a), 8) AS min, round(max(a), 8) AS max, count(a) AS n FROM r GROUP BY split""")
def _ag18(spark, sf_dir):
    runs = predictions(spark, sf_dir).filter(M.KNOWN).groupBy(F.col("lang").alias("split"), (F.col("doc_id") % 3).alias("seed")).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a"))
    return r8(M.seed_summary(runs, ["split"], "a"), "mean", "std", "min", "max")


@query("ag31_ensemble", "SELECT user_id, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS std, count(value) AS passes, round(CASE WHEN abs(avg(value)) > 1e-9 THEN coalesce(stddev_samp(value), 0) / abs(avg(value)) END, 8) AS cv, round(avg(value) - 1.96 * coalesce(stddev_samp(value), 0), 8) AS low, round(avg(value) + 1.96 * coalesce(stddev_samp(value), 0), 8) AS high FROM events GROUP BY user_id")
def _ag31(spark, sf_dir):
    return r8(M.ensemble(read(spark, sf_dir, "events"), ["user_id"], "value"), "mean", "std", "cv", "low", "high")


@query("ag32_calibration", """WITH s AS (SELECT user_id, avg(value) AS mean, stddev_samp(value) AS std, max_by(value, event_id) AS target FROM events GROUP BY user_id)
SELECT round(avg(CASE WHEN abs(target - mean) <= 1.96 * std THEN 1.0 ELSE 0.0 END), 8) AS coverage, round(avg(CASE WHEN abs(target - mean) <= 1.96 * std + 25 THEN 1.0 ELSE 0.0 END), 8) AS widened, round(avg(std), 8) AS mean_std, round(median(std), 8) AS median_std, round(max(std), 8) AS max_std, count(*) AS n FROM s""")
def _ag32(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max_by("value", "event_id").alias("target"))
    return r8(M.calibration(s, 25.0), "coverage", "widened", "mean_std", "median_std", "max_std")


PROBS = "q AS (SELECT user_id, event_type, count(*) * 1.0 AS c FROM events GROUP BY ALL), p AS (SELECT user_id, list(c / t ORDER BY event_type) AS p FROM (SELECT *, sum(c) OVER (PARTITION BY user_id) AS t FROM q) GROUP BY user_id)"


def _probs(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("c"))
    per = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "c"))).alias("x"), F.sum("c").alias("t"))
    return per.select("user_id", F.transform("x", lambda v: v["c"] / F.col("t")).alias("p"))


ENT = "CASE WHEN len(p) > 1 THEN -list_sum([CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END for v in p]) / ln(len(p)) ELSE 0 END"


@query("ag33_uncertainty", f"WITH {PROBS} SELECT user_id, round(0.5 * ({ENT}) + 0.5 * (list_avg(p) / list_max(p)), 8) AS uncertainty FROM p")
def _ag33(spark, sf_dir):
    return _probs(spark, sf_dir).select("user_id", F.round(M.uncertainty(F.col("p"), F.col("p")), 8).alias("uncertainty"))


@query("ag34_self_consistency", f"WITH {PROBS}, e AS (SELECT user_id, avg(value) AS m, min(value) AS lo FROM events GROUP BY user_id) SELECT user_id, (CAST(m - 40 <= 0 AS INT) + CAST(lo - 1 >= 0 AS INT) + CAST(m - 45 >= -0.05 AS INT) + CAST(({ENT}) < 0.65 AS INT)) / 4.0 AS confidence FROM p JOIN e USING (user_id)")
def _ag34(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.min("value").alias("lo"))
    return _probs(spark, sf_dir).join(e, "user_id").select("user_id", M.self_consistency(F.col("m") - 40, F.col("lo") - 1, F.col("m") - 45, F.col("p")).alias("confidence"))


@query("ag35_class_weights", f"WITH {PRED}, c AS (SELECT y_true, count(*) AS n FROM k GROUP BY 1), g AS (SELECT CAST(unnest(range(4)) AS INT) AS y_true), j AS (SELECT g.y_true, n, sum(n) OVER () AS t, count(n) OVER () AS pr FROM g LEFT JOIN c USING (y_true)) SELECT y_true, coalesce(n, 0) AS n, round(CASE WHEN n > 0 THEN t / (pr * n) ELSE 1 END, 8) AS weight FROM j")
def _ag35(spark, sf_dir):
    return r8(M.class_weights(predictions(spark, sf_dir), 4), "weight")


@query("ag36_roc_auc", """WITH s AS (SELECT toxic = 1 AS pos, (d.n_chars % 1000) / 1000.0 AS score FROM labels JOIN documents d USING (doc_id)),
r AS (SELECT pos, score, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS r FROM s)
SELECT round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 8) AS auc, count(*) FILTER (WHERE pos) AS positives, count(*) FILTER (WHERE NOT pos) AS negatives FROM r""")
def _ag36(spark, sf_dir):
    s = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select((F.col("toxic") == 1).alias("positive"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"))
    return r8(M.roc_auc(s), "auc")


@query("ag30_violation_rates", """WITH e AS (SELECT user_id, max(value) - 200 AS gap, avg(value) - 50 AS vc, min(value) - 0.5 AS cc, max(value) - 195 AS gr FROM events GROUP BY user_id),
r AS (SELECT avg(CAST(gap < 0 AS DOUBLE)) AS negative_gap, avg(CAST(vc > 0 AS DOUBLE)) AS vbm_sign, avg(CAST(cc < 0 AS DOUBLE)) AS cbm_sign, avg(CAST(abs(gap - gr) > 6 AS DOUBLE)) AS residual, count(*) AS n FROM e)
SELECT round(negative_gap, 8) AS negative_gap, round(vbm_sign, 8) AS vbm_sign, round(cbm_sign, 8) AS cbm_sign, round(residual, 8) AS residual, n, round(1 - greatest(negative_gap, vbm_sign, cbm_sign, residual), 8) AS score FROM r""")
def _ag30(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") - 200).alias("gap"), (F.avg("value") - 50).alias("vbm_curv"), (F.min("value") - 0.5).alias("cbm_curv"), (F.max("value") - 195).alias("gap_ref"))
    return r8(M.violations(e, 6.0), "negative_gap", "vbm_sign", "cbm_sign", "residual", "score")


@query("snk7_prediction_table", f"WITH {PROBS} SELECT user_id, list_position(p, list_max(p)) - 1 AS y_pred, round(list_max(p), 8) AS confidence FROM p")
def _snk7(spark, sf_dir):
    return _probs(spark, sf_dir).select("user_id", M.best_class(F.col("p")).cast("int").alias("y_pred"), F.round(F.array_max("p"), 8).alias("confidence"))


@query("ag38_value_report", "SELECT lang, count(*) AS n, count(source) AS with_source, count(*) FILTER (WHERE n_chars < 500) AS short, CAST(floor(log10(greatest(1, max(n_chars)))) AS INT) AS top_decade FROM documents GROUP BY lang")
def _ag38(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count("source").alias("with_source"), F.count_if(F.col("n_chars") < 500).alias("short"), F.floor(F.log10(F.greatest(F.lit(1), F.max("n_chars")))).cast("int").alias("top_decade"))


@query("ag43_mining_summary", "SELECT count(*) AS n, round(avg(CAST(event_type <> 'error' AS DOUBLE)), 8) AS success_rate, round(avg(CASE WHEN event_type IN ('view', 'click') THEN value END), 8) AS mean_score, count(*) FILTER (WHERE event_type = 'purchase') AS direct FROM events")
def _ag43(spark, sf_dir):
    t = F.col("event_type")
    rows = read(spark, sf_dir, "events").select(F.when(t != "error", "stored").otherwise("failed").alias("status"), F.when(t.isin("view", "click"), F.col("value")).alias("cv_score"), F.when(t == "purchase", "direct").alias("predicted_type"))
    got = P.mining_summary(rows).withColumnsRenamed({"total": "n", "average_confidence": "mean_score", "direct_gap_candidates": "direct"})
    return r8(got, "success_rate", "mean_score")
