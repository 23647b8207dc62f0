"""Incremental jobs that keep their state between micro-batches and runs: commits, paging, expiry.

State lives in Spark's state store under the query's checkpoint, keyed and partitioned; a stopped job
goes on from there. No job reads again what it has written, but for a row a query of the paging table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The store of ``transformWithState``: a key's map is kept as rows of its own, never loaded whole.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the RocksDB state store; the session's setting is as before afterwards."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one id and content in an Arrow batch as one row: least order, number of rows."""
    for frame in frames:
        if len(frame):
            yield frame.groupby(["key", "digest"], as_index=False, dropna=False).agg(order=("order", "min"), n=("n", "sum"))[["key", "digest", "order", "n"]]


class Commits(StatefulProcessor):
    """Of each id the canonical content and all contents seen.

    In a micro-batch contents come in the order of their first rows. A new one is canonical if the
    id has none yet, otherwise a variant; its further rows and those of a known one are duplicates.
    Memory is a row for each content that the batch has of the id.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.canonical = handle.getValueState("canonical", "digest string")
        self.seen = handle.getMapState("seen", "digest string", "first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        met: dict[str, list[int]] = {}
        for frame in rows:
            for digest, order, n in zip(frame["digest"], frame["order"], frame["n"], strict=True):
                had = met.setdefault(digest, [int(order), 0])
                had[0], had[1] = min(had[0], int(order)), had[1] + int(n)
        canonical = self.canonical.get()[0] if self.canonical.exists() else None
        out = []
        for digest, (order, n) in sorted(met.items(), key=lambda x: (x[1][0], x[0])):
            if not self.seen.containsKey((digest,)):
                self.seen.updateValue((digest,), (order,))
                if canonical is None:
                    canonical = digest
                    self.canonical.update((digest,))
                out.append((key[0], digest, digest == canonical, "canonical" if digest == canonical else "variant", order, 1))
                n -= 1
            if n:
                out.append((key[0], digest, digest == canonical, "duplicate" if digest == canonical else "duplicate_variant", order, n))
        yield pd.DataFrame(out, columns=["key", "digest", "canonical", "status", "order", "n"])

    def close(self) -> None:
        pass


def commit_stream(stream: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """SS1: rows ``(key, digest, canonical, status, order, n)`` of every micro-batch: each new content once, and how often known ones came.

    ``order`` is a whole number; a row without a digest has the empty one. Rows are combined before
    they are shuffled, so that an id of which most rows are retries sends few.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.coalesce(F.col(digest), F.lit("")).alias("digest"), F.col(order).cast("long").alias("order"), F.lit(1).cast("long").alias("n"))
    some = rows.mapInPandas(combine, f"key {kind}, digest string, order long, n long")
    got = some.groupBy("key").transformWithStateInPandas(Commits(), f"key {kind}, digest string, canonical boolean, status string, order long, n long", "append", "none")
    return got.withColumnRenamed("key", key).withColumnRenamed("digest", digest)


def start_commits(stream: DataFrame, path: str, checkpoint: str, key: str, digest: str, order: str) -> StreamingQuery:
    """SS1: run ``commit_stream`` on what has arrived; its rows are appended under ``path`` exactly once."""
    with rocks(stream.sparkSession):
        return commit_stream(stream, key, digest, order).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PAGING = "query string, cursor long, found long, idle long, state string, last long"


def paging_step(touched: DataFrame, before: DataFrame, limit: int, patience: int) -> DataFrame:
    """SS2: the paging table after a micro-batch. ``touched`` has ``query, id, mark, first``: first pages of ids, and of page marks (without an id).

    An id is new if its first page is beyond the last page read before. A query that has stopped
    stays as it is, except that a higher limit lets it go on.
    """
    had = before.select("query", F.col("cursor").alias("c0"), F.col("found").alias("f0"), F.col("idle").alias("i0"), F.col("state").alias("s0"), F.col("last").alias("l0"))
    fresh = touched.join(had, "query", "left").filter(F.col("l0").isNull() | (F.col("first") > F.col("l0")))
    pages = fresh.groupBy("query", F.col("first").alias("page"), "f0", "i0").agg(F.count("id").alias("new"))
    o = Window.partitionBy("query").orderBy("page")
    pages = pages.withColumn("found", F.coalesce("f0", F.lit(0)) + F.sum("new").over(o)).withColumn("n", F.row_number().over(o))
    hit = F.max(F.when(F.col("new") > 0, F.col("n"))).over(o)
    pages = pages.withColumn("idle", F.when(hit.isNull(), F.coalesce("i0", F.lit(0)) + F.col("n")).otherwise(F.col("n") - hit).cast("long"))
    pages = pages.withColumn("reason", F.when(F.col("found") >= limit, "limit").when(F.col("idle") >= patience, "no new ids"))
    at = F.struct("page", "found", "idle", "reason")
    new = pages.groupBy("query").agg(F.min(F.when(F.col("reason").isNotNull(), at)).alias("stop"), F.max(at).alias("end"))
    new = new.select("query", F.coalesce("stop", "end").alias("x"), F.col("end.page").alias("l1"))
    both = had.join(new, "query", "full_outer")
    closed = (F.col("s0") == "no new ids") | ((F.col("s0") == "limit") & (F.col("f0") >= limit))
    kept = F.coalesce(closed, F.lit(False)) | F.col("x").isNull()
    pick = lambda old, got: F.when(kept, F.col(old)).otherwise(got)
    state = F.coalesce("x.reason", F.lit("more"))
    return both.select("query", pick("c0", F.col("x.page")).alias("cursor"), pick("f0", F.col("x.found")).alias("found"), pick("i0", F.col("x.idle")).alias("idle"), pick("s0", state).alias("state"), F.greatest("l0", "l1").alias("last"))


def start_paging(pages: DataFrame, path: str, checkpoint: str, limit: int, patience: int = 3) -> StreamingQuery:
    """SS2: read pages of catalogue queries as they come; of each query the cursor, ids found, and why paging stopped.

    ``pages`` has ``query, page, id``; pages of a query come in order. Ids seen are the state of a
    streaming aggregation, spread over (query, id), so no query is one task's. The paging table, a
    row a query, is written anew under ``path`` by batch; a batch that is run again overwrites its own.
    """
    spark = pages.sparkSession
    page, none = F.col("page").cast("long"), F.lit(None)
    each = F.explode(F.array(F.struct(F.col("id").cast("string").alias("id"), none.cast("long").alias("mark")), F.struct(none.cast("string").alias("id"), page.alias("mark"))))
    seen = pages.select(F.col("query").cast("string").alias("query"), page.alias("page"), each.alias("e")).groupBy("query", F.col("e.id").alias("id"), F.col("e.mark").alias("mark")).agg(F.min("page").alias("first"))

    def put(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(PAGING).parquet(f"{path}/batch={n - 1}") if n else spark.createDataFrame([], PAGING)
        paging_step(batch, before, limit, patience).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return seen.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def paging_table(spark: SparkSession, path: str) -> DataFrame:
    """SS2: the paging table of the last batch."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.agg(F.max("batch").alias("newest"))  # one row
    return rows.join(F.broadcast(newest), F.col("batch") == F.col("newest")).select("query", "cursor", "found", "state")


def expiry_stream(stream: DataFrame, key: str, kind: str, created: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """SS3: rows ``(key, kind, created, expires, state)``: ``live`` when an artifact begins to live, ``prunable`` when it has expired.

    Time is event time: a row counts once the watermark has passed it, so rows may come late by
    ``late``, in any order, and later ones are dropped. A row of an artifact that lives repeats it and
    gives nothing; after its expiry a row begins a new life. Attachments never expire. A timer of
    each artifact waits for its next row to count or for its expiry; what has expired leaves the state.
    """
    life = hours * 3_600_000
    key_kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(created).cast("timestamp").alias("created")).withWatermark("created", late)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, what, waiting = state.get if state.exists else (None, None, [])
        waiting = set(waiting)
        for frame in frames:
            waiting |= {x // 1000 for x in frame["at"].tolist()}
            what = what or frame["kind"].iloc[0]
        now, out = state.getCurrentWatermarkMs(), []
        ends = lambda: None if start is None or what == "attachment" else start + life
        note = lambda label: out.append((group[0], what, start, -1 if ends() is None else ends(), label))
        for at in sorted(x for x in waiting if x < now):
            if start is not None and (ends() is None or at < ends()):
                continue
            if start is not None:
                note("prunable")
            start = at
            note("live")
        waiting = sorted(x for x in waiting if x >= now)
        if ends() is not None and ends() < now:
            note("prunable")
            start = None
        due = [x for x in (*waiting[:1], ends()) if x is not None]
        if start is None and not waiting:
            state.remove()
        else:
            state.update((start, what, waiting))
            if due:
                state.setTimeoutTimestamp(min(due))
        if out:
            yield pd.DataFrame(out, columns=["key", "kind", "created", "expires", "state"])

    timed = rows.withColumn("at", F.unix_micros("created"))
    got = timed.groupBy("key").applyInPandasWithState(step, f"key {key_kind}, kind string, created long, expires long, state string", "start long, kind string, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    when = lambda c: F.when(F.col(c) >= 0, F.timestamp_millis(c)).alias(c)
    return got.select(F.col("key").alias(key), F.col("kind").alias(kind), when("created"), when("expires"), "state")


def start_expiry(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """SS3: run ``expiry_stream`` rows into a folder exactly once; expiries that are due come with the last batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
