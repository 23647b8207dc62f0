"""Leakage-free splits: random, group, stratified group, held-out element, source, temporal; and their checks.

All randomness is an order by MD5 of a seed and a key, so reruns and other engines agree. Exact cuts
over all rows use counts by hash prefix, then a rank inside the one prefix at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import placed


def keyed(seed: str, *cols: Column | str) -> Column:
    """The MD5 of the seed and some columns, joined by '|'."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def exact_cut(rows: DataFrame, order: Column, n: int, prefix: Column, flag: str = "first") -> DataFrame:
    """Flag the ``n`` rows that come first in ``order``; ``prefix`` is a coarse key that sorts like it.

    Counts per prefix say which prefix holds the edge; only that one is ranked.
    """
    rows = rows.withColumn("__o", order).withColumn("__p", prefix)
    counts = rows.groupBy("__p").agg(F.count("*").alias("__c"))
    upto = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy(F.lit(1)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = rows.join(upto, "__p").withColumn("__edge", (F.col("__before") < n) & (F.col("__before") + F.col("__c") > n))
    edge = got.filter("__edge").withColumn(flag, F.row_number().over(Window.partitionBy("__p").orderBy("__o")) + F.col("__before") <= n)
    rest = got.filter("not __edge").withColumn(flag, F.col("__before") < n)
    return edge.unionByName(rest).drop("__o", "__p", "__c", "__before", "__edge")


def ranked(rows: DataFrame, by: list[str], order: list[Column], block: Column, name: str) -> DataFrame:
    """Add ``name``, the place of a row (from 1) in its group in ``order``; ``block`` is a coarse key of even size that sorts like it.

    For orders by a hash, whose head is such a key; any other order goes by ``ordering.placed``.

    Counts per block give each block its first place; only a block is ranked in one task, so a group with
    a third of all rows is no task of its own.
    """
    keyed_ = rows.withColumn("__b", block)
    upto = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed_.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    first = counts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__b").alias("__at"), F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__first"))
    same = F.col("__b").eqNullSafe(F.col("__at"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order))
    return keyed_.join(first, same).withColumn(name, (F.col("__first") + inside).cast("int")).select(*[c for c in rows.columns if c != name], name)


def random_split(rows: DataFrame, key: str, train: float, seed: str) -> DataFrame:
    """SP1: exactly round(train * n) rows train, by hash order."""
    n = rows.count()
    digest = keyed(seed, key)
    got = exact_cut(rows, digest, int(n * train + 0.5), F.substring(digest, 1, 3), "train")
    return got.withColumn("part", F.when(F.col("train"), "train").otherwise("test")).drop("train")


def shuffles(counts: DataFrame, group: str, seed: str, trials: int, block: int = 4096) -> DataFrame:
    """Every group once for each trial, with its ``rank`` in the trial's hash order and ``upto``, the rows up to it.

    ``counts`` has a row a group with ``n``. Adds ``all`` and ``groups``. The order is cut into blocks of
    about ``block`` groups by the head of the hash; running sums go over block sums, then inside blocks,
    so no task sorts all groups of a trial.
    """
    whole = counts.agg(F.sum("n").alias("all"), F.count("*").alias("groups"))
    sized = counts.crossJoin(F.broadcast(whole))  # one row
    tries = sized.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("__o", keyed(seed, "trial", group))
    head = F.conv(F.substring("__o", 1, 8), 16, 10).cast("double") / float(1 << 32)
    tries = tries.withColumn("__b", F.floor(head * F.ceil(F.col("groups") / block)).cast("int"))
    upto = Window.partitionBy("trial").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = tries.groupBy("trial", "__b").agg(F.sum("n").alias("__n"), F.count("*").alias("__k"))
    blocks = blocks.select("trial", "__b", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__n"), F.coalesce(F.sum("__k").over(upto), F.lit(0)).alias("__k"))
    inside = Window.partitionBy("trial", "__b").orderBy("__o", group)
    got = tries.join(blocks, ["trial", "__b"])
    got = got.withColumn("upto", F.col("__n") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", (F.col("__k") + F.row_number().over(inside)).cast("int"))
    return got.drop("__b", "__n", "__k", "__o")


def trials_for(counts: DataFrame, least: int, most: int, each: int = 1) -> int:
    """Number of shuffles: ``each`` for a group, within bounds."""
    return max(least, min(most, counts.count() * each))


def group_split(rows: DataFrame, group: str, test: float, seed: str, trials: int | None = None) -> DataFrame:
    """SP2: whole groups go to one side; of all shuffles the cut whose test share is nearest to ``test``.

    There are 64 to 1024 shuffles, one for each group. Trials multiply groups, not rows. Each shuffle
    tries every prefix of its order as the test side.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    tries = shuffles(counts, group, seed, trials or trials_for(counts, 64, 1024))
    usable = tries.filter((F.col("rank") < F.col("groups")) | (F.col("groups") == 1))
    best = usable.agg(F.min(F.struct(F.round(F.abs(F.col("upto") / F.col("all") - test), 12).alias("miss"), "trial", "rank")).alias("b")).select("b.*")
    chosen = tries.join(F.broadcast(best.select(F.col("trial").alias("t"), F.col("rank").alias("r"))), (F.col("trial") == F.col("t"))).select(group, (F.col("rank") <= F.col("r")).alias("__test"))
    return rows.join(chosen, group).withColumn("part", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def stratified_group_split(rows: DataFrame, group: str, cls: str, test: float, seed: str, trials: int | None = None, around: int = 3) -> DataFrame:
    """SP3: like the group split, with the score share error + 0.35 mean class-share error + 2 per class missing on a side.

    There are 256 to 2048 shuffles, 16 for each group; each tries the prefix nearest to the share and
    ``around`` shorter and longer ones, and every such cut is scored.
    """
    counts = rows.groupBy(group, cls).agg(F.count("*").alias("n"))
    per = counts.groupBy(group).agg(F.sum("n").alias("n"))
    classes = counts.groupBy(cls).agg(F.sum("n").alias("cn"))
    tries = shuffles(per, group, seed, trials or trials_for(per, 256, 2048, 16))
    off = F.round(F.abs(F.col("upto") - test * F.col("all")), 9)
    centre = tries.groupBy("trial").agg(F.min(F.struct(off.alias("off"), "rank")).alias("c"), F.first("groups").alias("groups"), F.first("all").alias("all"))
    bound = lambda x: F.greatest(F.lit(1), F.least(F.col("groups").cast("int") - 1, x))
    spans = centre.select("trial", "all", bound(F.col("c.rank") - around).alias("low"), bound(F.col("c.rank") + around).alias("high"))
    # Groups up to the shortest cut are summed once, later ones a rank at a time.
    steps = tries.select("trial", group, "rank").join(spans, "trial").filter("rank <= high").withColumn("step", F.greatest(F.col("rank"), F.col("low")))
    steps = steps.join(counts.withColumnRenamed("n", "own"), group).groupBy("trial", "step", cls).agg(F.sum("own").alias("own"))
    cuts = spans.select("trial", "all", F.explode(F.sequence("low", "high")).alias("rank")).crossJoin(F.broadcast(classes))
    grid = cuts.join(steps, ["trial", cls], "left").groupBy("trial", "rank", cls, "all", "cn").agg(F.coalesce(F.sum(F.when(F.col("step") <= F.col("rank"), F.col("own"))), F.lit(0)).alias("tn"))
    size = F.sum("tn").over(Window.partitionBy("trial", "rank"))
    grid = grid.withColumn("upto", size)
    lost = (F.col("tn") == 0).cast("int") + (F.col("tn") == F.col("cn")).cast("int")
    score = F.abs(F.max("upto") / F.max("all") - test) + 0.35 * F.avg(F.abs(F.col("tn") / F.col("upto") - F.col("cn") / F.col("all"))) + 2 * F.sum(lost)
    best = grid.groupBy("trial", "rank").agg(F.round(score, 12).alias("score")).agg(F.min(F.struct("score", "trial", "rank")).alias("b")).select(F.col("b.trial").alias("t"), F.col("b.rank").alias("r"))
    chosen = tries.join(F.broadcast(best), F.col("trial") == F.col("t")).select(group, (F.col("rank") <= F.col("r")).alias("__test"))
    return rows.join(chosen, group).withColumn("part", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def split_manifest(splits: dict[str, DataFrame], key: str, claims: dict[str, str], unavailable: dict[str, str] | None = None) -> DataFrame:
    """SP8: one row a split: status, claim, numbers of rows on either side and of excluded ones, test share, why it isn't there, and what is held out.

    Each split has ``key, part`` (train, test or excluded), and ``held_out`` if one value is held out, as
    of an element. A split of which a side is empty, or that has an id twice, is unavailable;
    ``unavailable`` names those that could not be built, with the reason.
    """
    out = None
    for name, rows in splits.items():
        n = lambda part: F.count_if(F.col("part") == part)
        held = F.max("held_out").cast("string") if "held_out" in rows.columns else F.lit(None).cast("string")
        got = rows.agg(n("train").alias("num_train"), n("test").alias("num_test"), n("excluded").alias("num_excluded"), F.round(n("test") / F.count("*"), 6).alias("test_fraction"), (F.count("*") - F.count_distinct(key)).alias("twice"), held.alias("held_out"))
        why = F.when((F.col("num_train") == 0) | (F.col("num_test") == 0), "a side is empty").when(F.col("twice") > 0, "an id is there twice")
        got = got.select(F.lit(name).alias("split"), F.when(why.isNotNull(), "unavailable").otherwise("available").alias("status"), F.lit(claims[name]).alias("claim"), "num_train", "num_test", "num_excluded", "test_fraction", why.alias("reason"), "held_out")
        out = got if out is None else out.unionByName(got)
    for name, reason in (unavailable or {}).items():
        zero = F.lit(0).cast("long")
        lost = out.limit(1).select(F.lit(name).alias("split"), F.lit("unavailable").alias("status"), F.lit(claims[name]).alias("claim"), zero.alias("num_train"), zero.alias("num_test"), zero.alias("num_excluded"), F.lit(0.0).alias("test_fraction"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("held_out"))
        out = out.unionByName(lost)
    return out


def manifest_ids(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """SP8: the ids of every split by part, those left out with them."""
    out = None
    for name, rows in splits.items():
        got = rows.select(F.lit(name).alias("split"), "part", key)
        out = got if out is None else out.unionByName(got)
    return out


def leave_element_out(rows: DataFrame, key: str, elements: str, test: float) -> DataFrame:
    """SP5: the element whose rows come nearest to the share ``test`` is held out with all rows that contain it.

    Rows of unknown species (null or empty) are excluded; the share is of all known rows.
    """
    known = F.col(elements).isNotNull() & (F.size(elements) > 0)
    per = rows.filter(known).select(key, F.explode(F.array_distinct(elements)).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    n = rows.filter(known).agg(F.count("*").alias("all"))
    best = per.crossJoin(F.broadcast(n)).agg(F.min(F.struct(F.round(F.abs(F.col("n") / F.col("all") - test), 12).alias("miss"), "e")).alias("b")).select(F.col("b.e").alias("held_out"))
    part = F.when(~known | F.col(elements).isNull(), "excluded").when(F.array_contains(elements, F.col("held_out")), "test").otherwise("train")
    return rows.crossJoin(F.broadcast(best)).withColumn("part", part)


def temporal_split(rows: DataFrame, key: str, time: str, train: float) -> DataFrame:
    """SP7: rows up to the floor(train * n)-th time train, later ones test; undated rows are excluded.

    The cut is an order statistic: counts per day, then per second of the day at the edge, then per
    microsecond, so a day with a third of all rows is counted, never sorted; a step has at most a
    million counts.
    """
    dated = rows.filter(F.col(time).isNotNull()).select(F.col(time).cast("timestamp").alias("__t"))
    place, lo, above = None, None, None
    for unit in ("day", "second", "microsecond"):  # each step counts inside the one before
        inside = dated if lo is None else dated.filter(F.date_trunc(above, "__t") == F.lit(lo))
        counts = inside.groupBy(F.date_trunc(unit, "__t").alias("u")).agg(F.count("*").alias("c"))
        whole = Window.partitionBy(F.lit(1))
        counts = counts.withColumn("before", F.sum("c").over(whole.orderBy("u")) - F.col("c")).withColumn("all", F.sum("c").over(whole))
        wanted = F.greatest(F.lit(1), F.floor(F.col("all") * train)) if place is None else F.lit(place)
        edge = counts.withColumn("place", wanted).filter((F.col("before") < F.col("place")) & (F.col("before") + F.col("c") >= F.col("place"))).first()
        if edge is None:
            return rows.withColumn("cutoff", F.lit(None).cast(rows.schema[time].dataType)).withColumn("part", F.lit("excluded"))
        lo, place, above = edge["u"], edge["place"] - edge["before"], unit
    part = F.when(F.col(time).isNull(), "excluded").when(F.col(time).cast("timestamp") <= F.lit(lo), "train").otherwise("test")
    return rows.withColumn("cutoff", F.lit(lo).cast(rows.schema[time].dataType)).withColumn("part", part)


def stride_split(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """SP10: every n-th row of a group goes to validation; ranks are distributed, so a group of any size is spread over tasks."""
    got = placed(rows, [group], [F.col(order)], "__place")
    return got.withColumn("part", F.when((F.col("__place") - 1) % n == 0, "val").otherwise("train")).drop("__place")


def grouped_validation(rows: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """SP9: whole groups in hash order go to validation until they hold ``share`` of the rows; at least one does."""
    counts = shuffles(rows.groupBy(group).agg(F.count("*").alias("n")), group, seed, 1)
    chosen = counts.select(group, (F.col("upto") - F.col("n") < F.col("all") * share).alias("__val"))
    return rows.join(chosen, group).withColumn("part", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")


def inherit_parts(rows: DataFrame, upstream: DataFrame, key: str, group: str) -> DataFrame:
    """SP11: parts of an upstream allocation; ``problem`` marks rows that it misses and groups on both sides."""
    got = rows.join(upstream.select(key, "part"), key, "left")
    sides = F.size(F.collect_set("part").over(Window.partitionBy(group)))
    return got.withColumn("problem", F.when(F.col("part").isNull(), "not allocated").when(sides > 1, "group on both sides"))


def split_audit(rows: DataFrame, key: str, group: str, cls: str) -> DataFrame:
    """AG39: per part the rows, groups, classes, and the groups that another part has too."""
    parts = rows.filter("part <> 'excluded'").groupBy(group).agg(F.count_distinct("part").alias("p")).filter("p > 1").select(group, F.lit(1).alias("shared"))
    return rows.join(parts, group, "left").groupBy("part").agg(F.count("*").alias("n"), F.count_distinct(group).alias("groups"), F.count_distinct(cls).alias("classes"), F.count_distinct(F.when(F.col("shared") == 1, F.col(group))).alias("shared_groups"))


def partition_check(all_rows: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """ST1-ST3: ids that the parts miss, add or repeat; three counts that should be 0."""
    a, b = all_rows.select(key).distinct().withColumn("in_all", F.lit(1)), parts.groupBy(key).agg(F.count("*").alias("times"))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("in_all").isNull()).alias("extra"), F.count_if(F.col("times") > 1).alias("repeated"))


def leakage(seen: DataFrame, test: DataFrame, key: str, group: str) -> DataFrame:
    """JN9: ids and groups that both sides have."""
    ids = test.select(key).distinct().join(seen.select(key), key, "left_semi").agg(F.count("*").alias("shared_ids"))
    groups = test.select(group).distinct().join(seen.select(group), group, "left_semi").agg(F.count("*").alias("shared_groups"))
    return ids.crossJoin(groups)


def axis_rules(seen: DataFrame, test: DataFrame, key: str, elements: str, time: str) -> DataFrame:
    """JN10: test rows without an element that is unseen, rows of unknown species, and whether time is strictly in order."""
    known = seen.select(F.explode(elements).alias("e")).distinct()
    fresh = test.select(key, F.explode_outer(elements).alias("e")).join(known.withColumn("old", F.lit(1)), "e", "left")
    rows = fresh.groupBy(key).agg(F.count_if(F.col("e").isNotNull() & F.col("old").isNull()).alias("unseen"), F.count_if(F.col("e").isNull()).alias("unknown"))
    told = rows.agg(F.count_if((F.col("unseen") == 0) & (F.col("unknown") == 0)).alias("covered_rows"), F.count_if(F.col("unknown") > 0).alias("unknown_rows"))
    order = seen.agg(F.max(time).alias("a")).crossJoin(test.agg(F.min(time).alias("b"))).select((F.col("a") < F.col("b")).alias("in_order"))
    return told.crossJoin(order)
