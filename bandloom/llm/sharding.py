"""Sharding by a k-d tree: weighted medians along the widest metadata dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Bits of a dimension's code, and of one step of the search for a median.
BITS, STEP = 48, 12


def text_metadata(text: Column | str) -> list[Column]:
    """Metadata of a text that equal texts share: log bytes, mean word length, share of non-ASCII bytes."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.octet_length(text)
    spaces = F.length(text) - F.length(F.translate(text, " \n\t", ""))
    return [F.log2(n + F.lit(1.0)), (F.length(text) + F.lit(1.0)) / (spaces + 1), (n - F.length(text)) / F.greatest(n, F.lit(1))]


def kd_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, size, text_crc32, shard, slot)`` with near-equal bytes in each of ``shards`` leaves.

    A node that should become s leaves is cut along the dimension that is widest in it (its range
    over the range of all rows) at the weighted median, or at s//2 : s of its bytes, until s is 1.
    The cut is found by counting bytes under ever finer prefixes of a 48-bit order code: each step is
    one aggregate over all nodes of the level, at most 4096 sums a node. A code is the dimension's
    value (24 bits) and then a hash of the text (24 bits), so equal texts have equal codes and stay
    in one shard, unless their group alone holds over half a leaf's target bytes: then the id goes
    into its hash, as near-equal bytes are the law.

    ``slot`` counts from 0 without gaps in each shard; it is laid out in buckets of about 512 rows
    whose counts are summed up, so no shard is sorted by one task. Size is the text's UTF-8 bytes (0
    for null) plus 1. A null text has the metadata of an empty one; ties keep together; repeated
    rows are sharded one by one; an empty table gives no rows. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    dims = text_metadata(text)
    k = len(dims)
    base = df.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), *[d.cast("double").alias(f"d{i}") for i, d in enumerate(dims)])
    base = table(base, "kd-rows")
    total, n, *ends = base.agg(F.sum("size"), F.count("*"), *[f(f"d{i}") for i in range(k) for f in (F.min, F.max)]).first()
    if not n:
        return base.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    spans = [(ends[2 * i], (ends[2 * i + 1] - ends[2 * i]) or 1.0) for i in range(k)]
    heavy = base.groupBy("h", "text_crc32").agg(F.sum("size").alias("all")).filter(F.col("all") > total / shards / 2).select("h", "text_crc32", F.lit(True).alias("heavy"))
    # At most 2 * shards groups can be so heavy: a bound for the broadcast.
    base = base.join(F.broadcast(heavy), ["h", "text_crc32"], "left")
    h = F.when(F.col("heavy"), F.xxhash64("h", "id")).otherwise(F.col("h"))
    low = F.shiftrightunsigned(h, 40)
    unit = [F.floor((F.col(f"d{i}") - lo) / span * ((1 << 24) - 1)).cast("long") for i, (lo, span) in enumerate(spans)]
    codes = [F.shiftleft(u, 24).bitwiseOR(low).alias(f"c{i}") for i, u in enumerate(unit)]
    rows = table(base.select("id", "size", "text_crc32", *codes), "kd-codes")
    leaves: dict[int, tuple[int, int]] = {0: (0, shards)}  # node: first shard, number of shards
    shard: Column = F.lit(0)
    while any(s > 1 for _, s in leaves.values()):
        at = rows.withColumn("node", shard)
        open_nodes = [v for v, (_, s) in leaves.items() if s > 1]
        wide = at.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(k) for f in (F.min, F.max)]).collect()
        cuts = _cuts(at, {r["node"]: (max(range(k), key=lambda i: r[f"max{i}"] - r[f"min{i}"]), r["bytes"] * (leaves[r["node"]][1] // 2) / leaves[r["node"]][1]) for r in wide if r["node"] in open_nodes})
        new, out = {}, F.col("node")
        for v, (first, s) in leaves.items():
            if s == 1:
                new[v] = (first, s)
                continue
            left, right = v, first + s // 2
            new[left], new[right] = (first, s // 2), (first + s // 2, s - s // 2)
            if v in cuts:
                dim, code = cuts[v]
                out = F.when((F.col("node") == v) & (F.col(f"c{dim}") >= code), right).otherwise(out)
        leaves = new
        rows, shard = at.select("id", "size", "text_crc32", *[f"c{i}" for i in range(k)], out.cast("int").alias("node")), F.col("node")
    out = table(rows.select("id", "size", "text_crc32", F.col("node").alias("shard"), F.pmod(F.xxhash64("id", "text_crc32"), F.lit(max(1, n // 512 // shards))).alias("bucket")), "kd-shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = out.groupBy("shard", "bucket").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32")) - 1
    return out.join(starts, ["shard", "bucket"]).select("id", "size", "text_crc32", F.col("shard"), (F.col("start") + inside).cast("long").alias("slot"))


def _cuts(at: DataFrame, wanted: dict[int, tuple[int, float]]) -> dict[int, tuple[int, int]]:
    """Per node the dimension and the code at which the bytes before it come nearest to the wanted."""
    prefix, before = {v: 0 for v in wanted}, {v: 0 for v in wanted}
    for step in range(STEP, BITS + 1, STEP):
        code, ok = F.lit(None).cast("long"), F.lit(False)
        for v, (dim, _) in wanted.items():
            mine = (F.col("node") == v) & (F.shiftright(f"c{dim}", BITS - step + STEP) == prefix[v])
            code, ok = F.when(mine, F.shiftright(f"c{dim}", BITS - step)).otherwise(code), ok | mine
        found: dict[int, list[tuple[int, int]]] = {v: [] for v in wanted}
        for r in at.filter(ok).groupBy("node", code.alias("code")).agg(F.sum("size").alias("bytes")).collect():
            found[r["node"]].append((r["code"], r["bytes"]))
        for v, (_, bytes_) in wanted.items():
            for c, b in sorted(found[v]):
                prefix[v] = c
                if before[v] + b >= bytes_:
                    if step == BITS and before[v] + b - bytes_ < bytes_ - before[v]:
                        prefix[v] = c + 1
                    break
                before[v] += b
    return {v: (dim, prefix[v]) for v, (dim, _) in wanted.items()}
