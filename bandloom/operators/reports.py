"""Reports on tables of records: values, coverage, runs, mining, detection; and the gate that a finished run must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running
from .quality import first_reason


def fields_of(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each field of each record, ``field, value``, from one pass."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")


def value_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """AG38: how often each field has each value; what is missing counts as ``unknown``."""
    return fields_of(rows, fields).groupBy("field", F.coalesce("value", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """AG38: of each field the records that have it (neither null nor empty) and all records."""
    return fields_of(rows, fields).groupBy("field").agg(F.count_if(F.coalesce(F.col("value") != "", F.lit(False))).alias("covered"), F.count("*").alias("total"))


def label_report(rows: DataFrame, labels: list[str]) -> DataFrame:
    """AG38: of each label its known values (not below 0) with their numbers, the known records and all."""
    each = fields_of(rows, labels).withColumn("value", F.col("value").try_cast("long"))
    known = F.coalesce(F.col("value") >= 0, F.lit(False))
    return each.groupBy("field", F.when(known, F.col("value")).alias("value")).agg(F.count("*").alias("n")).groupBy("field").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("coverage"), F.sum("n").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "n")))), lambda x: F.concat_ws(":", x["value"], x["n"])), ",").alias("distribution"),
    )


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """AG38: numbers of values in equal bins from ``low`` to ``high``, the last one closed; what lies outside isn't counted."""
    v = F.col(value).cast("double")
    at = F.least(F.lit(bins - 1), F.floor((v - low) / ((high - low) / bins)).cast("int"))
    return rows.filter((v >= low) & (v <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def mining_summary(records: DataFrame) -> DataFrame:
    """AG43: records, share of stored ones among all, mean score of those that have one, stored ones with a direct gap.

    ``records`` has ``status, cv_score, predicted_type``.
    """
    stored = F.coalesce(F.col("status") == "stored", F.lit(False))
    rate = F.when(F.count("*") > 0, F.count_if(stored) / F.count("*")).otherwise(0.0)
    return records.agg(F.count("*").alias("total"), rate.alias("success_rate"), F.avg("cv_score").alias("average_confidence"), F.count_if(stored & (F.col("predicted_type") == "direct")).alias("direct_gap_candidates"))


def status_crosstab(rows: DataFrame, status: str, target: str) -> DataFrame:
    """AG45: numbers by status and target; a missing one is ``unknown``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return rows.groupBy(name(status), name(target)).agg(F.count("*").alias("n"))


def peak_in_flight(rows: DataFrame, begin: str, end: str) -> DataFrame:
    """The most rows that have begun and not ended at one time; a row that ends when others begin is gone first.

    Begins and ends are summed by time, then running sums go over sampled ranges of time.
    """
    ends = F.array(F.struct(F.col(begin).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))
    steps = rows.filter(F.col(begin).isNotNull()).select(F.explode(ends).alias("x")).filter("x.t is not null").groupBy("x.t").agg(F.sum(F.when(F.col("x.d") > 0, 1).otherwise(0)).alias("up"), F.sum("x.d").alias("net"))
    gone = F.col("up") - F.col("net")
    flown = running(steps, [], [F.col("t")], {"before": "net"})
    return flown.agg(F.coalesce(F.max(F.col("before") - gone + F.col("up")), F.lit(0)).alias("peak_in_flight"))


def run_report(outcomes: DataFrame, cached: int, target: int) -> DataFrame:
    """AG47: one row: attempted, submitted, completed, in flight and its peak, cached in all, target reached, success, failed, no data, and rows by space group.

    ``outcomes`` has ``outcome`` (success, failed, no_data or null), ``submitted, completed`` (times or
    null) and ``spacegroup``; ``cached`` is the number of records there were before.
    """
    is_ = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    counts = outcomes.agg(F.count("*").alias("attempted"), F.count("submitted").alias("submitted"), F.count("completed").alias("completed"), is_("success"), is_("failed"), is_("no_data"))
    groups = outcomes.filter("outcome = 'success'").groupBy(F.coalesce(F.col("spacegroup").cast("string"), F.lit("unknown")).alias("g")).agg(F.count("*").alias("n"))
    by = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "n"))), lambda x: F.concat_ws(":", x["g"], x["n"])), ",").alias("spacegroups"))
    got = counts.crossJoin(F.broadcast(by)).crossJoin(F.broadcast(peak_in_flight(outcomes, "submitted", "completed")))  # one row each
    total = F.lit(cached) + F.col("success")
    return got.withColumns({"initial_cached": F.lit(cached), "requested_target": F.lit(target), "in_flight": F.col("submitted") - F.col("completed"), "total_cached": total, "target_reached": total >= target})


def detection_report(pages: DataFrame, boxes: Column) -> DataFrame:
    """AG48: pages with boxes, pages without (hard negatives), boxes in all. A missing list is an empty one."""
    n = F.coalesce(F.size(boxes), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return pages.agg(F.count_if(n > 0).alias("positive_pages"), F.count_if(n == 0).alias("hard_negative_pages"), F.coalesce(F.sum(n), F.lit(0)).alias("boxes"))


def completion_gate(persisted: DataFrame, reports: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """FLT27: why a run's results may not be used yet: too few persisted, no report, or a report that doesn't agree.

    ``persisted`` has a row a stored record, ``reports`` (``target_reached, requested_target,
    total_cached``) and ``targets`` (``target``) a row a run, all with the run's name in ``by``.
    """
    n = persisted.groupBy(by).agg(F.count("*").alias("persisted"))
    rows = targets.join(n, by, "left").join(reports.withColumn("__there", F.lit(True)), by, "left").withColumn("persisted", F.coalesce("persisted", F.lit(0)))
    differs = lambda a, b: F.coalesce(F.col(a), F.lit(-1)) != F.col(b)
    why = first_reason(
        (F.col("persisted") < F.col("target"), "persisted < requested target"), (F.col("__there").isNull(), "missing report"), (~F.coalesce(F.col("target_reached"), F.lit(False)), "target_reached=false"),
        (differs("requested_target", "target"), "report requested_target differs"), (differs("total_cached", "persisted"), "report total_cached differs"),
    )
    return rows.select(by, "persisted", "target", why.alias("problem"))
