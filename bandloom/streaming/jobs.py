"""Rules of incremental jobs on tables, and outcome counters as a stream; ``state`` has the jobs that keep state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def commit_status(batch: DataFrame, stored: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """SS1: status of each incoming row against the stored ``(key, digest)`` rows and earlier rows of the batch.

    canonical: a new id; duplicate: same id and content as the canonical one; variant: same id, other
    content, seen for the first time; duplicate_variant: such content again.
    """
    old = stored.select(key, digest, F.lit(-1).cast("long").alias("__o"))
    rows = batch.withColumn("__o", F.col(order).cast("long"))
    both = rows.unionByName(old, allowMissingColumns=True)
    by_id = Window.partitionBy(key).orderBy("__o", order)
    by_both = Window.partitionBy(key, digest).orderBy("__o", order)
    # Of stored rows the canonical one carries ``canonical``.
    if "canonical" in stored.columns:
        both = rows.unionByName(stored.select(key, digest, F.when(F.col("canonical"), -2).otherwise(-1).cast("long").alias("__o")), allowMissingColumns=True)
    both = both.withColumn("__first", F.first(digest).over(by_id)).withColumn("__n", F.row_number().over(by_id)).withColumn("__m", F.row_number().over(by_both))
    same = F.col(digest) == F.col("__first")
    status = F.when(F.col("__n") == 1, "canonical").when(same, "duplicate").when(F.col("__m") == 1, "variant").otherwise("duplicate_variant")
    return both.withColumn("status", status).filter("__o >= 0").drop("__o", "__first", "__n", "__m")


def page_state(pages: DataFrame, limit: int, patience: int = 3) -> DataFrame:
    """SS2: per query the pages read, ids found, and why paging stops: the limit, or ``patience`` pages without a new id.

    ``pages`` has ``query, page, id``.
    """
    first = pages.groupBy("query", "id").agg(F.min("page").alias("page"))
    fresh = first.groupBy("query", "page").agg(F.count("*").alias("new"))
    every = pages.select("query", "page").distinct().join(fresh, ["query", "page"], "left").fillna(0, ["new"])
    o = Window.partitionBy("query").orderBy("page")
    every = every.withColumn("found", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0))).withColumn("idle", F.sum("new").over(o.rowsBetween(-(patience - 1), 0))).withColumn("n", F.row_number().over(o))
    reason = F.when(F.col("found") >= limit, "limit").when((F.col("n") >= patience) & (F.col("idle") == 0), "no new ids")
    stop = every.withColumn("reason", reason).groupBy("query").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("page", "reason"))).alias("s"), F.max("page").alias("last"))
    stop = stop.select("query", F.coalesce("s.page", "last").alias("cursor"), F.coalesce("s.reason", F.lit("more")).alias("state"))
    return stop.join(every, "query").filter("page = cursor").select("query", "cursor", "found", "state")


def live_artifacts(rows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """SS3: artifacts that may still be read, and those that can be pruned; attachments never expire."""
    expires = F.when(F.col("kind") != "attachment", F.col("created") + F.make_interval(hours=F.lit(hours)))
    return rows.withColumn("state", F.when(expires.isNull() | (expires > now), "live").otherwise("prunable"))


def outcome_counts(stream: DataFrame, time: str, status: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """SS4: outcomes per window and status, with a watermark for late rows; works on streams and tables."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    got = rows.groupBy(F.window(time, width), status).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), status, "n", "total")


def start_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """SS4: run an aggregated stream in update mode; every batch's changed counters go to a folder of its own under ``path``.

    A batch that is run again overwrites its folder; nothing passes the driver.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str, keys: tuple[str, ...] = ("start", "event_type")) -> DataFrame:
    """SS4: the counters as they stand: of each key the row of its last batch."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rows.columns if c not in (*keys, "batch")])


def read_files(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
