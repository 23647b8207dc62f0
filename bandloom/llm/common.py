"""Helpers shared by the training-data operators: scratch tables, keys and grouped batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (or the session's checkpoint folder), which all executors share.

    Only a local session (one machine, as in tests) that names none gets a temporary one; on a cluster
    that is an error, since other machines wouldn't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="bandloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Spark hand texts to Python in Arrow batches of about ``size`` bytes.

    By default a batch has up to 64 MB, which every task holds several times over, outside the heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return memory that this Python worker has freed to the system; workers live on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def unit_hash(*cols: Column | str) -> Column:
    """A deterministic hash in [0, 1) of the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def byte_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose texts have at most so many bytes together; a longer text goes alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def row_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys as frames; the input is sorted by them.

    Holds one group and one Arrow batch at a time.
    """
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        same = (frame[keys] == frame[keys].shift()).all(axis=1).to_numpy()
        starts = [0, *[i for i in range(1, len(frame)) if not same[i]], len(frame)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            part = frame.iloc[lo:hi]
            key = tuple(part.iloc[0][keys])
            if held and key != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, salt: list[str] | None = None) -> DataFrame:
    """Apply ``fn`` to each group of bounded size; many small groups share one Arrow batch.

    Like ``applyInPandas``, without its cost for each group: rows are dealt and sorted by the
    keys, and a task walks over its sorted groups. ``fn`` gets plain pandas frames.
    """
    names = [x.strip().split()[0] for x in schema.split(",")]
    out_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        held, n = [], 0
        for group in row_groups(batches, keys):
            got = fn(group)
            if got is not None and len(got):
                held.append(got[names])
                n += len(got)
            if n > 20_000:
                yield pa.RecordBatch.from_pandas(pd.concat(held), schema=arrow, preserve_index=False)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(pd.concat(held), schema=arrow, preserve_index=False)
        held = []
        give_back()

    return df.repartition(*(salt or keys)).sortWithinPartitions(*keys).mapInArrow(run, schema)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable node for each node of ``edges(a, b)``: rows ``(node, component)``.

    Each round takes the smallest label of the neighbours and then the label of that label, so
    chains shrink by doubling. Every round is a written table; nothing is collected but a count.
    Self-edges keep a node that has no other.
    """
    both = table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), f"{name}-0")
    for k in range(1, 60):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        best = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = table(best.join(jump, "via").select("node", "was", F.least("via", "far").alias("component")), f"{name}-{k}")
        labels = new.select("node", "component")
        if new.filter("was <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
