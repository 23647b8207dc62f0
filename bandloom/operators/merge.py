"""Merging and reconciling tables: backfill, folds with a conflict audit, fixed id lists, ledgers, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import is_missing


def filled(value: Column) -> Column:
    """A text value; null where it counts as missing."""
    return F.when(~is_missing(value), value)


def enrich(rows: DataFrame, key: str, *layers: DataFrame) -> DataFrame:
    """JN1: later layers override earlier values where they hold one; keys of a layer must be unique.

    ``duplicates`` counts the layer rows of a key beyond the first; such a key takes nothing from it.
    """
    out = rows.withColumn("duplicates", F.lit(0).cast("long"))
    for layer in layers:
        cols = [c for c in layer.columns if c != key]
        one = layer.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(f"__{c}") for c in cols])
        out = out.join(one, key, "left")
        for c in cols:
            new = F.when(F.col("__n") == 1, filled(F.col(f"__{c}")))
            out = out.withColumn(c, F.coalesce(new, F.col(c)) if c in out.columns else new)
        out = out.withColumn("duplicates", F.col("duplicates") + F.coalesce(F.col("__n") - 1, F.lit(0))).drop("__n", *[f"__{c}" for c in cols])
    return out


def backfill(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """JN2: fill only empty fields; ``filled`` and ``blocked`` count fields taken and refused, ``new`` marks new keys."""
    cols = [c for c in existing.columns if c != key]
    a = existing.select(F.col(key), F.lit(True).alias("__a"), *[filled(F.col(c)).alias(c) for c in cols])
    b = incoming.select(F.col(key), F.lit(True).alias("__b"), *[filled(F.col(c)).alias(f"__{c}") for c in cols])
    j = a.join(b, key, "full")
    took = [(F.col("__a").isNotNull() & F.col(c).isNull() & F.col(f"__{c}").isNotNull()).cast("int") for c in cols]
    kept = [(F.col(c).isNotNull() & F.col(f"__{c}").isNotNull() & (F.col(c) != F.col(f"__{c}"))).cast("int") for c in cols]
    total = lambda x: sum((F.coalesce(v, F.lit(0)) for v in x), F.lit(0))
    return j.select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in cols], total(took).alias("filled"), total(kept).alias("blocked"), F.col("__a").isNull().alias("new"))


def long_fields(rows: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """One row a field: ``(key, seq, field, value)`` with missing values as null."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), filled(F.col(c).cast("string")).alias("value")) for c in cols]))
    return rows.select(key, seq, each.alias("f")).select(key, seq, "f.field", "f.value")


def fold_versions(rows: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """JN3: the first value of each field over all versions of a record, with the number of disagreeing ones."""
    seen = long_fields(rows, key, seq, cols).filter(F.col("value").isNotNull())
    first = F.min_by("value", seq)
    w = Window.partitionBy(key, "field")
    seen = seen.withColumn("first", F.first("value").over(w.orderBy(seq)))
    return seen.groupBy(key, "field").agg(first.alias("value"), F.count_if(F.col("value") != F.col("first")).alias("conflicts"))


def conflict_audit(rows: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """JN3/JN4: each later value that disagrees with the first one, with SHA-256 of key, kept and refused value."""
    seen = long_fields(rows, key, seq, cols).filter(F.col("value").isNotNull())
    seen = seen.withColumn("kept", F.first("value").over(Window.partitionBy(key, "field").orderBy(seq)))
    bad = seen.filter(F.col("value") != F.col("kept"))
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256)
    return bad.select(key, "field", seq, sha(key).alias("key_sha"), sha("kept").alias("kept_sha"), sha("value").alias("refused_sha"))


def strict_merge(rows: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """JN4: one value a field, or an error where layers disagree."""
    seen = long_fields(rows, key, seq, cols)
    got = seen.groupBy(key, "field").agg(F.count_distinct("value").alias("k"), F.min("value").alias("v"))
    return got.select(key, "field", F.when(F.col("k") == 1, F.col("v")).alias("value"), F.when(F.col("k") > 1, "conflict").when(F.col("k") == 0, "missing").alias("error"))


def fixed_ids(ids: DataFrame, old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """JN5: exactly the given ids; new beats old, different values of both are quarantined, absent ones read_error; clipped ids are told."""
    i = ids.select(key).distinct().withColumn("__i", F.lit(1))
    a, b = old.select(key, F.col(value).alias("__o")), new.select(key, F.col(value).alias("__n"))
    j = i.join(a, key, "full").join(b, key, "full")
    clash = F.col("__o").isNotNull() & F.col("__n").isNotNull() & (F.col("__o") != F.col("__n"))
    status = F.when(F.col("__i").isNull(), "out of scope").when(clash, "conflict").when(F.coalesce("__n", "__o").isNull(), "read_error").otherwise("merged")
    return j.select(key, F.when(status == "merged", F.coalesce("__n", "__o")).alias(value), status.alias("status"))


def reconcile(data: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """JN12: ids of data and metadata: kept, to backfill, or stale; with how often each happens."""
    a, b = data.select(key).distinct().withColumn("__a", F.lit(1)), meta.select(key).distinct().withColumn("__b", F.lit(1))
    j = a.join(b, key, "full")
    return j.select(key, F.when(F.col("__a").isNull(), "stale").when(F.col("__b").isNull(), "backfill").otherwise("kept").alias("action"))


def top_up(base: DataFrame, proxy: DataFrame, key: str, target: int, seed: str) -> DataFrame:
    """JN11: all base rows and so many proxy rows, in an order drawn by hash, that ``target`` is reached."""
    from .splits import exact_cut, keyed

    need = max(0, target - base.count())
    fresh = proxy.join(base.select(key), key, "left_anti")
    digest = keyed(seed, key)
    return base.unionByName(exact_cut(fresh, digest, need, F.substring(digest, 1, 3), "took").filter("took").drop("took"))


def aligned(labels: DataFrame, targets: DataFrame, key: str, place: str) -> DataFrame:
    """JN7: labels in the order of the target ids; ``problem`` marks missing and doubled ids."""
    one = labels.groupBy(key).agg(F.count("*").alias("__n"), F.first("label").alias("label"))
    j = targets.join(one, key, "left")
    return j.select(place, key, "label", F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "doubled").alias("problem"))


def clip(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """JN27: rows with their state: in scope, clipped (unknown id), or duplicate (an id more than once)."""
    n = F.count("*").over(Window.partitionBy(key))
    got = rows.withColumn("__n", n).join(known.select(key, F.lit(1).alias("__k")).distinct(), key, "left")
    return got.withColumn("state", F.when(F.col("__k").isNull(), "clipped").when(F.col("__n") > 1, "duplicate").otherwise("in scope")).drop("__n", "__k")


def corroborate(rows: DataFrame, evidence: DataFrame, key: str, digest: str, value: str, tolerance: float) -> DataFrame:
    """JN26: whether each claimed array equals, within ``tolerance``, that of the evidence row with the same id and digest."""
    e = evidence.select(key, digest, F.col(value).alias("__e"))
    j = rows.join(e, [key, digest], "left")
    close = F.forall(F.zip_with(value, "__e", lambda a, b: F.abs(a - b) <= tolerance), lambda x: F.coalesce(x, F.lit(False)))
    state = F.when(F.col("__e").isNull(), "no evidence").when((F.size(value) == F.size("__e")) & close, "corroborated").otherwise("contradicted")
    return j.withColumn("state", state).drop("__e")


def cascade(rows: DataFrame, first: Column, second: Column, third: Column) -> DataFrame:
    """JN14: the first source that has a value, its name, and the mean confidence of the three (zeros count)."""
    has = lambda c, w: F.when(c.isNotNull(), w).otherwise(0.0)
    origin = F.when(first.isNotNull(), "provider").when(second.isNotNull(), "local").when(third.isNotNull(), "parsed").otherwise("unknown")
    return rows.withColumn("value", F.coalesce(first, second, third)).withColumn("origin", origin).withColumn("confidence", (has(first, 1.0) + has(second, 0.8) + has(third, 0.5)) / 3)


def crystal_system(number: Column) -> Column:
    """JN15: crystal system of a space-group number; null outside 1 to 230. The ranges' last numbers."""
    return (
        F.when((number < 1) | (number > 230), None).when(number <= 2, "triclinic").when(number <= 15, "monoclinic").when(number <= 74, "orthorhombic")
        .when(number <= 142, "tetragonal").when(number <= 167, "trigonal").when(number <= 194, "hexagonal").when(number <= 230, "cubic")
    )


def ledger(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """AG40: per field the rows of each status and whether they add up to all rows."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("status")) for k, v in fields.items()]))
    got = rows.select(each.alias("x")).groupBy("x.field").agg(*[F.count_if(F.col("x.status") == s).alias(s) for s in ("valid", "ambiguous", "invalid", "read_error")], F.count("*").alias("n"))
    return got.withColumn("adds_up", F.col("valid") + F.col("ambiguous") + F.col("invalid") + F.col("read_error") == F.col("n"))
