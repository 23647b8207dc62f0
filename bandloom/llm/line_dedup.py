"""Line dedup: repeated windows of consecutive lines, found over all documents (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(df: DataFrame, id_col: str, text_col: str, window: int = 3) -> DataFrame:
    """Rows ``(id, h, pos, key)``: id, hash of the text, and the MD5 of each run of ``window`` consecutive lines."""
    lines = F.split(text_col, "\n", -1)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), lines.alias("lines")).filter(F.col("id").isNotNull() & (F.size("lines") >= window))
    keys = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (window - 1)),
        lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", i, F.lit(window))))),
    )
    return docs.select("id", "h", F.posexplode(keys).alias("pos", "key"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Drop the lines of every window that also occurs earlier (by id, then by position).

    Returns the input's columns with the kept text in ``text_col``, and ``n_lines``,
    ``n_removed`` and ``n_spans`` (maximal removed runs of lines) after them; input columns of
    these names are replaced. Covered positions of overlapping windows are merged. Texts of fewer
    lines than the window stay whole; a null text stays null with 0 lines; an empty text is one
    empty line. Windows of empty lines count like others. A row without an id keeps its text. Texts
    that repeat an id are documents of their own, in the order of a hash; rows that repeat both id and
    text are one, and each keeps what it keeps. An empty table gives no rows.

    The hash windows are pre-aggregated before the shuffle that finds the first places, so a passage
    that is on a third of all documents sends one row a task; in the join back to the places adaptive
    execution splits such a key. Texts move once, in the join by id and hash.
    """
    found = windows(df, id_col, text_col, window)
    firsts = found.groupBy("key").agg(F.min(F.struct("id", "h", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    later = found.join(firsts, "key").filter(F.struct("id", "h", "pos") != F.col("first"))
    spans = later.groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    last = F.size("at") - 1
    starts = F.filter("at", lambda x, i: (i == 0) | (x > F.get("at", i - 1) + window))
    ends = F.transform(F.filter("at", lambda x, i: (i == last) | (F.get("at", i + 1) > x + window)), lambda x: x + window)
    spans = spans.select(F.col("id").alias("__span_id"), F.col("h").alias("__span_h"), starts.alias("__starts"), ends.alias("__ends"))
    own = [c for c in df.columns if c not in ("n_lines", "n_removed", "n_spans")]
    docs = df.select(*own).withColumn("__lines", F.split(text_col, "\n", -1))
    n = F.size("__starts")
    gaps = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.slice(
            "__lines",
            F.when(i == 0, 0).otherwise(F.get("__ends", i - 1)) + 1,
            F.when(i == n, F.size("__lines")).otherwise(F.get("__starts", i)) - F.when(i == 0, 0).otherwise(F.get("__ends", i - 1)),
        ),
    )
    cut = F.col("__starts").isNotNull()
    removed = F.aggregate(F.zip_with("__starts", "__ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    kept = F.when(cut, F.array_join(F.flatten(gaps), "\n")).otherwise(F.col(text_col))
    joined = docs.join(spans, (docs[id_col] == spans["__span_id"]) & (F.xxhash64(docs[text_col]) == spans["__span_h"]), "left")
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in own],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(cut, n).otherwise(0).cast("long").alias("n_spans"),
    )
