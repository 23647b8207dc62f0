"""Ranks and running sums over groups of any size.

Rows are dealt to tasks by ranges of (group, order), whose bounds Spark samples, and sorted there. So a
group is spread over as many tasks as its share of the rows asks for, whatever its keys look like: one
prefix, an outlier, many kinds. The dealt rows are written to the shared folder, since bounds are
sampled anew whenever a plan runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import shared_folder


def dealt(rows: DataFrame, by: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows with ``__at``, a number that goes up in the order of (group, order); its bits from 33 name the range.

    Equal keys go to one range. ``parts`` is the number of ranges; by default Spark's number of shuffle
    partitions, of which adaptive execution joins small neighbours.
    """
    keys = [*[F.col(c) for c in by], *order]
    spread = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    path = shared_folder(rows.sparkSession, "ranges")
    sorted_ = spread.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    sorted_.write.parquet(path)
    return rows.sparkSession.read.schema(sorted_.schema).parquet(path)


def _with_pieces(rows: DataFrame, by: list[str], facts: dict[str, Column], made: dict[str, Column]) -> DataFrame:
    """Join each row with columns made of its piece's facts; a piece is what a range has of a group.

    There is a piece for each group and each range it reaches into, at most groups plus ranges.
    """
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    pieces = rows.groupBy(*by, "__part").agg(*[x.alias(k) for k, x in facts.items()])
    mine = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    pieces = pieces.select(*mine, F.col("__part").alias("__piece"), *[x.alias(k) for k, x in made.items()])
    same = F.col("__part") == F.col("__piece")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return rows.join(pieces, same).drop("__piece", *[f"__by{i}" for i in range(len(by))])


def _before(by: list[str], column: str) -> Column:
    """The sum of a fact over a group's earlier pieces."""
    window = Window.partitionBy(*by or [F.lit(1)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def placed(rows: DataFrame, by: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Add ``name``, the place of a row (from 1) in its group in ``order``: ``row_number`` without a task a group.

    Counts of pieces give each piece its first place; inside it the dealt number gives the rest. Among
    rows that are equal in ``order`` the places are arbitrary, but each is given once.
    """
    got = _with_pieces(dealt(rows, by, order, parts), by, {"__first": F.min("__at"), "__n": F.count("*")}, {"__shift": _before(by, "__n") - F.col("__first") + 1})
    return got.withColumn(name, F.col("__at") + F.col("__shift")).select(*[c for c in rows.columns if c != name], name)


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Add sums over all earlier rows of the group in ``order``: ``sums`` maps a new column to the summed one.

    Sums of pieces give each piece its start; a window goes over one piece at a time.
    """
    facts = {f"__s{i}": F.sum(c) for i, c in enumerate(sums.values())}
    got = _with_pieces(dealt(rows, by, order, parts), by, facts, {f"__b{i}": _before(by, f"__s{i}") for i in range(len(sums))})
    window = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    made = {name: F.col(f"__b{i}") + F.coalesce(F.sum(c).over(window), F.lit(0)) for i, (name, c) in enumerate(sums.items())}
    return got.withColumns(made).select(*[c for c in rows.columns if c not in sums], *sums)
