"""Orders, quotas and samples without a global sort of rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import placed
from .splits import exact_cut, keyed, ranked


def diverse_order(rows: DataFrame, group: str, kind: str, key: str) -> DataFrame:
    """TK1: places for a round-robin over groups and, inside a group, over kinds: sort by ``round``, then group (null last).

    ``turn`` is a row's place in its kind, ``round`` its place in its group; neither is ranked in a
    task of its own, however large the group.
    """
    turns = placed(rows, [group, kind], [F.col(key)], "turn")
    rounds = placed(turns, [group], [F.col("turn"), F.col(kind), F.col(key)], "round")
    return rounds.withColumns({c: F.col(c).cast("int") for c in ("turn", "round")})


def quota_by_bin(rows: DataFrame, key: str, bin_: str, bins: int, total: int, seed: str) -> DataFrame:
    """TK2: an equal share of ``total`` from every bin, the remainder to the first ones; unused quota goes to rows next in line.

    Rows are ranked by hash in their bin; spare places go round the bins, so only the ranks near
    the quotas meet in a global order.
    """
    digest = keyed(seed, key)
    placed = ranked(rows, [bin_], [digest], F.substring(digest, 1, 3), "k")
    quota = F.lit(total // bins) + F.when(F.col(bin_) < total % bins, 1).otherwise(0)
    sizes = rows.groupBy(bin_).agg(F.count("*").alias("n")).withColumn("quota", quota)
    spare = sizes.agg(F.sum(F.greatest(F.lit(0), F.col("quota") - F.col("n"))).alias("spare"))
    marked = placed.join(sizes, bin_).crossJoin(F.broadcast(spare))  # one row
    first = marked.filter("k <= quota")
    # The spare is at most the total, so are the rows of each bin that can take it.
    waiting = marked.filter("k > quota and k <= quota + spare")
    more = waiting.withColumn("more", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("k", bin_))).filter("more <= spare").drop("more")
    return first.unionByName(more)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """TK4: ``n`` rows without replacement, the first in the order of a hash."""
    digest = keyed(seed, key)
    return exact_cut(rows, digest, n, F.substring(digest, 1, 3), "took").filter("took").drop("took")


def text_chunks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """TK6: slices of ``size`` characters with offset and the whole text's SHA-256; an empty text is one empty slice."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(size))
    got = rows.select(key, F.col(text).alias("t"), F.sha2(text, 256).alias("sha"), F.posexplode(starts).alias("chunk", "start"))
    return got.select(key, "chunk", "start", F.expr(f"substring(t, start + 1, {size})").alias("part"), "sha")
