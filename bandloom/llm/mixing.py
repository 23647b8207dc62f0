"""Mixing sources to target weights: exact block quotas, split among output shards by a hypergeometric tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, unit_hash


def words(text: Column | str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = 3.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is reshared by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else left * weights[i] / weight
        left -= sum(out[i] for i in over)
        free = free - over if over else set()
    return out


def quota_tree(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard, of equal block counts: rows are shards, columns sources.

    The root holds the exact quotas of all sources. Each node gives its left child as many blocks as
    its share of the leaves, drawn without replacement (multivariate hypergeometric), and the rest
    to the right one; so every column sums to its quota and every leaf is a fair draw.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        n = int(own.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, n, method="marginals") if n else np.zeros_like(own)
        split(lo, mid, left)
        split(mid, hi, own - left)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def source_targets(sized: DataFrame, cycle: Sequence[float], most: float) -> list[dict]:
    """Per source, by code point with null last: its size and target. One row a source reaches the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["size"] or 0) for r in rows]
    got = targets(sizes, [cycle[i % len(cycle)] for i in range(len(rows))], sum(sizes), most)
    return [{"source": r["source"], "size": s, "target": t} for r, s, t in zip(rows, sizes, got, strict=True)]


def draw(df: DataFrame, shards: int = 8, block_rows: int = 4096, seed: int = 7, cycle: Sequence[float] = (1, 2, 3), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, plan)``: every row with its draws, and one row for each source.

    A source's rows are dealt by a hash of id, source and text to blocks, 1024 or one for ``block_rows``
    rows of the table. A source whose target is q times its size gives every block floor(q) times and
    then, in an order permuted by hash, further blocks up to the rest; of the block at the edge it
    gives the rows (by hash) that come nearest to the rest, so a source misses its target by less than
    one row. These block quotas go down ``quota_tree``; the shards then take disjoint runs of each
    source's permuted block copies, and ``rank`` orders a shard locally by hash.

    ``rows`` has the input's columns and ``size, source_size, target, draws array<struct<copy int, shard
    int, rank long>>``, empty for a row that is never drawn; input columns of these names are replaced.
    Texts that are null or have no word have size 0 and are drawn with their block. Rows of a null
    source form the last source; a null id is a value like others. Rows that repeat an id are drawn each
    by itself; of rows that are equal throughout it is open which is drawn. An empty table gives no
    rows. Reruns agree. ``plan`` has a row a source; windows are over block sums, and over the rows of
    one block of each source, so a source with a third of all rows is no task of its own.
    """
    own = [c for c in df.columns if c not in ("size", "source_size", "target", "draws")]
    spark, blocks = df.sparkSession, max(1024, -(-df.count() // block_rows))
    key = F.xxhash64(id_col, source_col, text_col)
    size = F.col(size_col) if size_col else words(text_col)
    src = [F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__src"), F.col(source_col).isNull().alias("__none")]
    keyed = df.select(*own, size.alias("size"), *src, key.alias("__key")).withColumn("__blk", F.pmod(F.xxhash64("__key", F.lit(seed)), F.lit(blocks)).cast("int"))
    sums = table(keyed.groupBy("__src", "__none", "__blk").agg(F.sum("size").alias("words")), "mix-blocks")
    known = source_targets(sums.select(F.when(~F.col("__none"), F.col("__src")).alias("source"), F.col("words").alias("size")), cycle, most)
    plan = [(r["source"] or "", r["source"] is None, r["size"], r["target"], int(r["target"] // r["size"]) if r["size"] else 0) for r in known]
    plan = spark.createDataFrame(plan, "__src string, __none boolean, source_size long, target double, full int")
    by = Window.partitionBy("__src", "__none").orderBy(F.xxhash64("__blk", "__src", F.lit(seed + 1)), "__blk")
    edge = F.col("target") - F.col("full") * F.col("source_size")
    laid = sums.join(plan, ["__src", "__none"]).withColumn("upto", F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    laid = laid.withColumn("upto", F.coalesce("upto", F.lit(0)).cast("double")).withColumn("more", edge - F.col("upto"))
    # More > 0: part or all of the block is drawn once again.
    laid = laid.withColumn("copies", F.col("full") + (F.col("more") > 0).cast("int"))
    laid = laid.withColumn("room", F.when((F.col("more") > 0) & (F.col("more") < F.col("words")), F.col("more")))
    copies = laid.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    order = Window.partitionBy("__src", "__none").orderBy(F.xxhash64("__blk", "copy", "__src", F.lit(seed + 2)), "__blk", "copy")
    ranked = table(copies.withColumn("place", F.row_number().over(order).cast("long")), "mix-copies")
    quotas = {(r["__src"], r["__none"]): r["n"] for r in ranked.groupBy("__src", "__none").agg(F.count("*").alias("n")).collect()}
    keys = sorted(quotas)
    tree = quota_tree([quotas[k] for k in keys], shards, seed)
    cuts = spark.createDataFrame([(*k, [int(x) for x in np.cumsum(tree[:, i])]) for i, k in enumerate(keys)], "__src string, __none boolean, cuts array<long>")
    ranked = ranked.join(cuts, ["__src", "__none"]).withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("place"))))
    each = table(ranked.groupBy("__src", "__none", "__blk").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("__copies"), F.first("full").alias("__full"), F.first("room").alias("__room")), "mix-plan")
    # One block a source is drawn in part the last time: its rows alone are put in order.
    here = ["__src", "__none", "__blk"]
    edges = each.filter("__room is not null")
    parts = spark.createDataFrame(edges.collect(), edges.schema)  # a row a source at most, as in the plan
    inside = Window.partitionBy(*here).orderBy(unit_hash("__key", F.lit(seed + 3)), "__key").rowsBetween(Window.unboundedPreceding, 0)
    cut = keyed.join(parts, here).withColumn("__upto", F.sum("size").over(inside))
    # Such a row is drawn if the larger half of it lies within the room.
    last = (F.col("__upto") - F.col("size") / 2 <= F.col("__room")).cast("int")
    cut = cut.withColumn("__copies", F.slice("__copies", 1, F.col("__full") + last))
    rest = keyed.join(parts.select(*here), here, "left_anti").join(each, here, "left")
    rows = rest.select(*cut.drop("__upto").columns).unionByName(cut.drop("__upto"))
    rank = lambda c: F.struct(c["copy"].alias("copy"), c["shard"].alias("shard"), F.xxhash64("__key", c["copy"], F.lit(seed + 4)).alias("rank"))
    draws = F.transform(F.coalesce("__copies", F.array().cast("array<struct<copy:int,shard:int>>")), rank)
    rows = rows.join(plan.drop("full"), ["__src", "__none"]).select(*own, "size", "source_size", "target", draws.alias("draws"))
    return rows, plan.select(F.when(~F.col("__none"), F.col("__src")).alias("source"), "source_size", "target")


def mix(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``(draws, plan)``: the drawn copies of rows by ``draw``, whose parameters and results for odd input hold.

    ``draws`` has ``copy int, shard int, rank long`` in place of the list: a row drawn three times is
    there three times, one never drawn is absent.
    """
    rows, plan = draw(df, **options)
    own = [c for c in rows.columns if c not in ("copy", "shard", "rank", "draws")]
    return rows.select(*own, F.inline("draws")), plan


def in_order(draws: DataFrame, parts: int) -> DataFrame:
    """The mix as it is to be written: every shard in ``parts`` ranges of ``rank``, each in its order."""
    part = F.floor((F.shiftrightunsigned("rank", 11) / F.lit(float(1 << 53))) * parts)
    return draws.withColumn("__part", part).repartition("shard", "__part").sortWithinPartitions("shard", "__part", "rank").drop("__part")
