"""Classification, regression, calibration and uncertainty metrics as grouped aggregates.

Predictions have ``y_true`` and ``y_pred``; a true class of -1 or null is unknown and never counts
as an error: it leaves the denominator and is counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running

KNOWN = "y_true is not null and y_true <> -1"


def hash_share(*parts: Column) -> Column:
    """A draw in [0, 1) from the first eight hex digits of an MD5; other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def confusion(pred: DataFrame, classes: int) -> DataFrame:
    """AG10: count of each pair of true and predicted class; zeros stay."""
    spark = pred.sparkSession
    grid = spark.range(classes).select(F.col("id").cast("int").alias("y_true"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("y_pred"))
    counts = pred.filter(KNOWN).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def accuracy(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AG11: accuracy and the mean recall of the classes that are present, with the unknown rows counted."""
    by = by or []
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    known = pred.filter(KNOWN)
    whole = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))
    recall = known.groupBy(*by, "y_true").agg(F.avg(right).alias("recall")).groupBy(*by).agg(F.avg("recall").alias("macro_accuracy"))
    unknown = pred.groupBy(*by).agg(F.count_if(~F.expr(KNOWN)).alias("unknown"))
    if not by:
        return whole.crossJoin(recall).crossJoin(unknown)
    return unknown.join(whole, by, "left").join(recall, by, "left")


def f1_scores(pred: DataFrame, classes: int) -> DataFrame:
    """AG12: precision, recall and F1 of every class, 0 where undefined, and the macro F1 of all classes."""
    m = confusion(pred, classes)
    hit = m.filter("y_true = y_pred").select(F.col("y_true").alias("cls"), F.col("n").alias("tp"))
    rows = m.groupBy(F.col("y_true").alias("cls")).agg(F.sum("n").alias("real"))
    cols = m.groupBy(F.col("y_pred").alias("cls")).agg(F.sum("n").alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    got = hit.join(rows, "cls").join(cols, "cls")
    got = got.select("cls", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("real")).alias("recall"), ratio(2 * F.col("tp"), F.col("real") + F.col("said")).alias("f1"))
    return got.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy(F.lit(1))))


def scoped_accuracy(pred: DataFrame, group: str, matched: Column) -> DataFrame:
    """AG13: accuracy over samples, mean accuracy over groups, and accuracy of matched and other rows."""
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    rows = pred.filter(KNOWN).withColumn("right", right).withColumn("matched", matched)
    per = rows.groupBy(group).agg(F.sum("right").alias("r"), F.count("*").alias("n"), F.sum(F.when(F.col("matched"), F.col("right"))).alias("rm"), F.count_if("matched").alias("nm"))
    part = lambda a, b: F.when(b > 0, a / b)
    return per.agg((F.sum("r") / F.sum("n")).alias("sample_accuracy"), F.avg(F.col("r") / F.col("n")).alias("group_accuracy"), part(F.sum("rm"), F.sum("nm")).alias("matched_accuracy"), part(F.sum("r") - F.coalesce(F.sum("rm"), F.lit(0.0)), F.sum("n") - F.sum("nm")).alias("other_accuracy"))


def stratified_errors(pred: DataFrame, strata: list[str]) -> DataFrame:
    """AG14: rows and accuracy of each value of each stratum, in one pass over grouping sets."""
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    rows = pred.filter(KNOWN)
    if not strata:
        raise ValueError("name a stratum")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("value")) for s in strata]))
    return rows.select(each.alias("x"), right.alias("right")).groupBy("x.stratum", "x.value").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"))


def crossed_errors(pred: DataFrame, first: str, second: str) -> DataFrame:
    """AG14: accuracy of all crosses of two strata with their margins (grouping sets; ``all`` marks a margin)."""
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    got = pred.filter(KNOWN).cube(first, second).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.grouping(first).alias("g1"), F.grouping(second).alias("g2"))
    name = lambda c, g: F.when(F.col(g) == 1, "all").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("unknown")))
    return got.select(name(first, "g1").alias(first), name(second, "g2").alias(second), "n", "accuracy")


def regression(pairs: DataFrame, tolerance: float, by: list[str] | None = None) -> DataFrame:
    """AG16: MAE, MSE, RMSE, mean and largest residual, Pearson r (0 for one row), R2 (0 if all targets are equal), share over tolerance."""
    e = F.col("pred") - F.col("target")
    rows = pairs.filter(F.col("pred").isNotNull() & F.col("target").isNotNull())
    got = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("max_abs"),
        F.corr("pred", "target").alias("r"), F.var_pop("target").alias("v"), F.avg((F.abs(e) > tolerance).cast("double")).alias("over"),
    )
    r2 = F.when(F.col("v") * F.col("n") <= 1e-12, 0.0).otherwise(1 - F.col("mse") / F.col("v"))
    return got.select(*(by or []), "n", "mae", "mse", F.sqrt("mse").alias("rmse"), "bias", "max_abs", F.coalesce(F.when(F.col("n") > 1, F.col("r")), F.lit(0.0)).alias("r"), r2.alias("r2"), "over")


def group_bootstrap(pred: DataFrame, group: str, trials: int, seed: str) -> DataFrame:
    """AG17: percentile interval of pooled and group-mean accuracy, resampling whole groups with replacement.

    Rows shrink to one a group before trials multiply them; the i-th draw of a trial is the group
    whose rank equals an MD5 draw. With fewer than two groups the interval is null.
    """
    right = (F.col("y_true") == F.col("y_pred")).cast("long")
    groups = pred.filter(KNOWN).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.sum(right).alias("c"))
    one = Window.partitionBy(F.lit(1))  # a row a group
    groups = groups.withColumn("i", F.row_number().over(one.orderBy("g")) - 1).withColumn("k", F.count("*").over(one))
    draws = groups.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    pick = F.floor(hash_share(F.lit(seed), F.col("b").cast("string"), F.col("i").cast("string")) * F.col("k")).cast("int")
    hit = draws.select("b", pick.alias("i")).join(groups.select("i", "n", "c", "k"), "i")
    per = hit.groupBy("b").agg((F.sum("c") / F.sum("n")).alias("pooled"), F.avg(F.col("c") / F.col("n")).alias("macro"), F.max("k").alias("k"))
    q = lambda c, p: F.when(F.max("k") > 1, F.percentile(c, F.lit(p)))
    return per.agg(F.max("k").alias("groups"), F.avg("pooled").alias("mean"), F.stddev_pop("pooled").alias("std"), q("pooled", 0.025).alias("low"), q("pooled", 0.975).alias("high"), q("macro", 0.025).alias("macro_low"), q("macro", 0.975).alias("macro_high"))


def seed_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG18: mean, sample deviation (0 for one run), least, largest and number of runs."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def ensemble(passes: DataFrame, by: list[str], value: str, tiny: float = 1e-9) -> DataFrame:
    """AG31: mean, sample deviation, relative deviation (null near 0) and 95% band over passes."""
    got = passes.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("passes"))
    return got.withColumn("cv", F.when(F.abs("mean") > tiny, F.col("std") / F.abs("mean"))).withColumn("low", F.col("mean") - 1.96 * F.col("std")).withColumn("high", F.col("mean") + 1.96 * F.col("std"))


def calibration(rows: DataFrame, tolerance: float) -> DataFrame:
    """AG32: share of targets within the 95% band, raw and widened, and mean, median and largest deviation."""
    e = F.abs(F.col("target") - F.col("mean"))
    return rows.agg(F.avg((e <= 1.96 * F.col("std")).cast("double")).alias("coverage"), F.avg((e <= 1.96 * F.col("std") + tolerance).cast("double")).alias("widened"), F.avg("std").alias("mean_std"), F.percentile("std", F.lit(0.5)).alias("median_std"), F.max("std").alias("max_std"), F.count("*").alias("n"))


def entropy(probs: Column) -> Column:
    """Entropy of an array of probabilities over its largest value; 0 for one class."""
    raw = -F.aggregate(probs, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return F.when(F.size(probs) > 1, raw / F.log(F.size(probs).cast("double"))).otherwise(0.0)


def sharpness(values: Column) -> Column:
    """1 minus mean over peak of an array of scores; 0 without a positive peak."""
    peak, mean = F.array_max(values), F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.when(peak > 0, 1 - mean / peak).otherwise(0.0)


def uncertainty(probs: Column, *peaks: Column) -> Column:
    """AG33: half the normalised entropy and half the worst lack of sharpness."""
    worst = F.greatest(*[1 - sharpness(p) for p in peaks]) if len(peaks) > 1 else 1 - sharpness(peaks[0])
    return 0.5 * entropy(probs) + 0.5 * worst


def prediction_confidence(probs: Column, valence: Column, conduction: Column, gap: Column) -> Column:
    """AG33: a struct of ``score`` in [0, 1], ``level`` (green, yellow, red), ``entropy``, ``peak_sharpness`` and ``gap_plausible``.

    45% is how far the classes (scaled to one in all) are from even, 35% the sharpness of the duller of
    the two heads, 20% whether the gap lies between -0.05 and 15 (a third of it if not).
    """
    total = F.greatest(F.aggregate(probs, F.lit(0.0), lambda s, p: s + p), F.lit(1e-12))
    even = -F.aggregate(probs, F.lit(0.0), lambda s, p: s + p / total * F.log(p / total + 1e-12)) / F.log(F.size(probs).cast("double"))
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    sharp = F.least(clip(F.coalesce(sharpness(valence), F.lit(0.0))), clip(F.coalesce(sharpness(conduction), F.lit(0.0))))
    plausible = F.coalesce(gap.between(-0.05, 15.0), F.lit(False))
    score = clip(0.45 * (1 - even) + 0.35 * sharp + 0.2 * F.when(plausible, 1.0).otherwise(0.3))
    level = F.when(score >= 0.6, "green").when(score >= 0.35, "yellow").otherwise("red")
    return F.struct(score.alias("score"), level.alias("level"), even.alias("entropy"), sharp.alias("peak_sharpness"), plausible.alias("gap_plausible"))


def self_consistency(valence_curvature: Column, conduction_curvature: Column, gap: Column, probs: Column) -> Column:
    """AG34: share of four checks that hold: curvature signs, gap of at least -0.05, low entropy."""
    checks = [valence_curvature <= 0, conduction_curvature >= 0, gap >= -0.05, entropy(probs) < 0.65]
    return sum((F.coalesce(c, F.lit(False)).cast("double") for c in checks), F.lit(0.0)) / len(checks)


def class_weights(pred: DataFrame, classes: int) -> DataFrame:
    """AG35: rows over present classes times the class's rows; 1 for a class without rows."""
    grid = pred.sparkSession.range(classes).select(F.col("id").cast("int").alias("y_true"))
    counts = pred.filter(KNOWN).groupBy("y_true").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    got = grid.join(counts, "y_true", "left").withColumn("total", F.sum("n").over(w)).withColumn("present", F.count("n").over(w))
    return got.select("y_true", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") > 0, F.col("total") / (F.col("present") * F.col("n"))).otherwise(1.0).alias("weight"))


def roc_auc(scores: DataFrame, parts: int | None = None) -> DataFrame:
    """AG36: area under the ROC curve from counts per distinct score; ties count half, null with one class only.

    ``scores`` has ``positive`` (boolean) and ``score``. Rows are first summed by score, so a score that
    most rows share is one row; the negatives below each score are running sums over sampled ranges of
    scores, so it doesn't matter where the scores lie.
    """
    per = scores.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    below = running(per, [], [F.col("score")], {"under": "q"}, parts)
    won = F.col("p") * (F.col("under") + F.col("q") / 2)
    return below.agg(F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.sum(won) / (F.sum("p") * F.sum("q"))).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def violations(rows: DataFrame, tolerance: float) -> DataFrame:
    """AG30: shares of negative gaps, of wrong curvature signs at the extrema, and of residuals over tolerance; score is 1 minus the worst."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    got = rows.agg(rate(F.col("gap") < 0).alias("negative_gap"), rate(F.col("vbm_curv") > 0).alias("vbm_sign"), rate(F.col("cbm_curv") < 0).alias("cbm_sign"), rate(F.abs(F.col("gap") - F.col("gap_ref")) > tolerance).alias("residual"), F.count("*").alias("n"))
    return got.withColumn("score", 1 - F.greatest("negative_gap", "vbm_sign", "cbm_sign", "residual"))


def best_class(probs: Column) -> Column:
    """SNK7: index of the largest probability; the first on ties."""
    return F.array_position(probs, F.array_max(probs)) - 1
