"""Sampled energy curves in long form: envelopes, crossings, gaps, segments, curvature, resampling.

``points`` has ``path_id, band_id, segment_id, k_idx, k, energy``; energies are relative to the
reference level 0, null where a sample is missing. Nothing crosses a segment border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATH = ["path_id"]


def band_ranges(points: DataFrame) -> DataFrame:
    """AG1: least, largest and mean energy and the samples of each band."""
    return points.groupBy("path_id", "band_id").agg(F.min("energy").alias("low"), F.max("energy").alias("high"), F.avg("energy").alias("mean"), F.count("energy").alias("n"))


def edge_envelopes(points: DataFrame, at: str = "k_idx", level: float = 0.0) -> DataFrame:
    """AG2: at each k the highest energy at or below the level and the lowest at or above it.

    ``complete`` says whether every k of the path has both sides.
    """
    per = points.groupBy("path_id", at).agg(F.max(F.when(F.col("energy") <= level, F.col("energy"))).alias("vbm"), F.min(F.when(F.col("energy") >= level, F.col("energy"))).alias("cbm"))
    whole = Window.partitionBy("path_id")
    return per.withColumn("complete", F.min((F.col("vbm").isNotNull() & F.col("cbm").isNotNull()).cast("int")).over(whole) == 1)


def frontier_bands(points: DataFrame, level: float = 0.0) -> DataFrame:
    """AG3: the valence and conduction band of each path.

    A clean split takes the highest band below and the lowest above the level; else the bands whose
    edges are nearest to it; else the two in the middle by mean. Ties go to the smaller band.
    """
    r = band_ranges(points)
    below, above = F.col("high") <= level, F.col("low") >= level
    occupied = r.filter(below).groupBy("path_id").agg(F.max(F.struct("high", "band_id")).alias("v"))
    empty = r.filter(above).groupBy("path_id").agg(F.min(F.struct("low", "band_id")).alias("c"))
    near = r.groupBy("path_id").agg(
        F.min(F.struct(F.abs(F.col("high") - level).alias("d"), "band_id")).alias("nv"),
        F.array_sort(F.collect_list(F.struct(F.abs(F.col("low") - level).alias("d"), "band_id"))).alias("edges"),
        F.max((~below & ~above).cast("int")).alias("mixed"),
    )
    other = F.get(F.filter("edges", lambda e: e["band_id"] != F.col("nv.band_id")), F.lit(0))
    joined = near.join(occupied, "path_id", "left").join(empty, "path_id", "left")
    clean = F.col("v").isNotNull() & F.col("c").isNotNull() & (F.col("mixed") == 0)
    return joined.select(
        "path_id",
        F.when(clean, F.col("v.band_id")).otherwise(F.col("nv.band_id")).alias("valence"),
        F.when(clean, F.col("c.band_id")).otherwise(other["band_id"]).alias("conduction"),
        clean.alias("clean"),
    )


def crossing_band(points: DataFrame, level: float = 0.0) -> DataFrame:
    """AG4: the band that spans the level inside one segment and comes nearest to it; smaller band on ties."""
    seg = points.groupBy("path_id", "band_id", "segment_id").agg(F.min("energy").alias("low"), F.max("energy").alias("high"), F.min(F.abs(F.col("energy") - level)).alias("near"))
    hit = seg.filter((F.col("low") <= level) & (F.col("high") >= level))
    return hit.groupBy("path_id").agg(F.min(F.struct("near", "band_id")).alias("x")).select("path_id", F.col("x.band_id").alias("band_id"), F.col("x.near").alias("near"))


def path_gap(points: DataFrame, level: float = 0.0) -> DataFrame:
    """AG6: gap of each path: positive if bands split cleanly, 0 if one crosses strictly inside a segment, else null.

    A band that lies on the level counts as valence only.
    """
    seg = points.groupBy("path_id", "band_id", "segment_id").agg(F.min("energy").alias("low"), F.max("energy").alias("high"))
    band = seg.groupBy("path_id", "band_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max(((F.col("low") < level) & (F.col("high") > level)).cast("int")).alias("crosses"))
    valence, conduction = F.col("high") <= level, (F.col("low") >= level) & (F.col("high") > level)
    path = band.groupBy("path_id").agg(
        F.max(F.when(valence, F.col("high"))).alias("vbm"), F.min(F.when(conduction, F.col("low"))).alias("cbm"),
        F.max("crosses").alias("crosses"), F.max((~valence & ~conduction).cast("int")).alias("mixed"), F.count("*").alias("bands"),
    )
    gap = F.when(F.col("crosses") == 1, F.lit(0.0)).when((F.col("mixed") == 0) & (F.col("cbm") > F.col("vbm")), F.col("cbm") - F.col("vbm"))
    kind = F.when(F.col("crosses") == 1, "metal").when(gap.isNotNull(), "gapped").otherwise("unknown")
    return path.select("path_id", gap.alias("gap"), kind.alias("topology"), "bands")


def sign_crossings(points: DataFrame, level: float = 0.0) -> DataFrame:
    """WN4: strict sign changes of each band inside a segment; zeros are skipped and a missing sample breaks the run."""
    order = Window.partitionBy("path_id", "band_id", "segment_id").orderBy("k_idx")
    runs = points.withColumn("run", F.sum(F.col("energy").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = runs.filter(F.col("energy").isNotNull() & (F.col("energy") != level))
    inside = Window.partitionBy("path_id", "band_id", "segment_id", "run").orderBy("k_idx")
    rows = rows.withColumn("before", F.lag("energy").over(inside)).withColumn("k_before", F.lag("k_idx").over(inside))
    return rows.filter((F.signum(F.col("energy") - level) != F.signum(F.col("before") - level))).select("path_id", "band_id", "segment_id", "k_before", "k_idx", "before", "energy")


def segments(points: DataFrame, tiny: float = 1e-12) -> DataFrame:
    """WN1: ``segment`` counts up where the distance does not grow by more than ``tiny`` from one sample to the next."""
    order = Window.partitionBy("path_id").orderBy("k_idx")
    step = F.col("k") - F.lag("k").over(order)
    return points.withColumn("segment", F.sum(F.when(step <= tiny, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def label_segments(labels: DataFrame, last: int) -> DataFrame:
    """WN2: rows ``(path_id, k_idx, segment)`` from label positions: a segment runs from one label up to the next.

    The first and last position always are labels; doubled positions count once.
    """
    ends = labels.select("path_id", "position").union(labels.select("path_id", F.lit(0))).union(labels.select("path_id", F.lit(last))).distinct()
    order = Window.partitionBy("path_id").orderBy("position")
    spans = ends.withColumn("next", F.lead("position").over(order)).withColumn("segment", F.row_number().over(order) - 1).filter("next is not null")
    upto = F.when(F.col("next") == last, last).otherwise(F.col("next") - 1)
    return spans.select("path_id", "segment", F.explode(F.sequence("position", upto)).alias("k_idx"))


def quadratic_curvature(points: DataFrame, by: list[str], x: str = "k_idx", y: str = "energy") -> DataFrame:
    """WN3: twice the leading coefficient of a least-squares parabola over two rows on each side.

    The window stays in the group. With fewer than three samples the curvature is 0. Power sums of
    the offsets from the centre row solve the normal equations in closed form.
    """
    frame = Window.partitionBy(*by).orderBy(x).rowsBetween(-2, 2)
    rows = points.withColumn("near", F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y"))).over(frame))
    mid = F.col(x).cast("double")
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda s, p: s + f(p["x"] - mid, p["y"]))
    sums = {f"s{p}": total(lambda u, v, p=p: F.pow(u, F.lit(float(p)))) for p in range(5)} | {f"t{p}": total(lambda u, v, p=p: F.pow(u, F.lit(float(p))) * v) for p in range(3)}
    rows = rows.withColumns(sums)
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    top = t2 * (n * s2 - s1 * s1) - t1 * (n * s3 - s1 * s2) + t0 * (s1 * s3 - s2 * s2)
    low = s4 * (n * s2 - s1 * s1) - s3 * (n * s3 - s1 * s2) + s2 * (s1 * s3 - s2 * s2)
    return rows.withColumn("curvature", F.when((n >= 3) & (low != 0), 2 * top / low).otherwise(0.0)).drop("near", *sums)


def extremum_distance(points: DataFrame, largest: bool, by: list[str] = PATH) -> DataFrame:
    """WN5: signed distance of each sample to the extremum's place, over the number of steps; first place on ties."""
    order = F.struct("energy", (-F.col("k_idx") if largest else F.col("k_idx")).alias("i"))
    w = Window.partitionBy(*by)
    at = F.abs((F.max(order).over(w) if largest else F.min(order).over(w))["i"])
    n = F.count("*").over(w)
    return points.withColumn("at", at).withColumn("distance", F.when(n > 1, (F.col("k_idx") - F.col("at")) / (n - 1)).otherwise(0.0)).drop("at")


def smooth_trace(points: DataFrame, by: list[str] = PATH) -> DataFrame:
    """WN6: moving median of five, then moving mean of five; the first and last value are repeated outside."""
    order = Window.partitionBy(*by).orderBy("k_idx")
    span, whole = order.rowsBetween(-2, 2), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def padded(col: str) -> Column:
        """Five values around each row."""
        near = F.collect_list(col).over(span)
        at, n = F.row_number().over(order), F.count("*").over(whole)
        front = F.array_repeat(F.first(col).over(whole), F.greatest(F.lit(0), 3 - at).cast("int"))
        back = F.array_repeat(F.last(col).over(whole), F.greatest(F.lit(0), 2 - (n - at)).cast("int"))
        return F.concat(front, near, back)

    rows = points.withColumn("median", F.element_at(F.array_sort(padded("energy")), 3))
    return rows.withColumn("smooth", F.aggregate(padded("median"), F.lit(0.0), lambda s, x: s + x) / 5).drop("median")


def contiguous_runs(points: DataFrame, by: list[str], label: str = "segment_id") -> DataFrame:
    """WN7: per label of a group, the number of its runs in k order and whether k grows strictly in each run."""
    order = Window.partitionBy(*by).orderBy("k_idx")
    rows = points.withColumn("new", F.coalesce((F.lag(label).over(order) != F.col(label)).cast("int"), F.lit(1)))
    rows = rows.withColumn("grows", (F.col("new") == 1) | (F.col("k") > F.lag("k").over(order)))
    return rows.groupBy(*by, label).agg(F.sum("new").alias("runs"), F.min(F.col("grows").cast("int")).alias("strict"))


def binned_extremes(points: DataFrame, bins: int, by: list[str] = PATH) -> DataFrame:
    """WN8: per equal-width bin of k, the highest point below the level and the lowest above it."""
    w = Window.partitionBy(*by)
    lo, hi = F.min("k").over(w), F.max("k").over(w)
    bin_ = F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.col("k") - lo) / (hi - lo) * bins))).otherwise(0).cast("int")
    return points.withColumn("bin", bin_).groupBy(*by, "bin").agg(F.max(F.when(F.col("energy") <= 0, F.col("energy"))).alias("valence"), F.min(F.when(F.col("energy") > 0, F.col("energy"))).alias("conduction"), F.count("*").alias("n"))


def span_mask(points: DataFrame, span: int, low: float, high: float, seed: str, by: list[str] = PATH) -> DataFrame:
    """WN9: mask whole spans in an order drawn by hash, until the masked share is nearest to a target drawn from [low, high].

    Spans are ``span`` samples long and stay inside a segment.
    """
    w = Window.partitionBy(*by, "segment_id").orderBy("k_idx")
    rows = points.withColumn("cell", F.floor((F.row_number().over(w) - 1) / span))
    cells = rows.groupBy(*by, "segment_id", "cell").agg(F.count("*").alias("size"))
    draw = F.md5(F.concat_ws("|", F.lit(seed), *by, "segment_id", "cell"))
    part = Window.partitionBy(*by)
    order = part.orderBy(draw, "segment_id", "cell")
    share = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *by)), 1, 8), 16, 10).cast("double") / 4294967296.0
    cells = cells.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("size").over(part))
    cells = cells.withColumn("miss", F.abs(F.col("upto") / F.col("n") - (low + share * (high - low))))
    best = F.min(F.struct("miss", "upto")).over(part)["upto"]
    return rows.join(cells.withColumn("masked", F.col("upto") <= best).select(*by, "segment_id", "cell", "masked"), [*by, "segment_id", "cell"])


def fermi_window(points: DataFrame, capacity: int, half: float, level: float = 0.0) -> DataFrame:
    """TK3: up to ``capacity`` bands of each path near the level.

    With a clean split half of them are the highest valence bands and the rest the lowest conduction
    bands. Otherwise bands that overlap the window around the level, crossing ones first, then by
    distance and name; if none overlaps, the two nearest.
    """
    r = band_ranges(points)
    below, above = F.col("high") <= level, F.col("low") >= level
    w = Window.partitionBy("path_id")
    r = r.withColumn("mixed", F.max((~below & ~above).cast("int")).over(w)).withColumn("sides", F.max(below.cast("int")).over(w) + F.max(above.cast("int")).over(w))
    clean = (F.col("mixed") == 0) & (F.col("sides") == 2)
    distance = F.when(below, level - F.col("high")).when(above, F.col("low") - level).otherwise(0.0)
    overlap = (F.col("low") <= level + half) & (F.col("high") >= level - half)
    r = r.withColumn("clean", clean).withColumn("side", F.when(clean, F.when(below, 0).otherwise(1)).otherwise(2)).withColumn("distance", distance).withColumn("overlap", overlap)
    r = r.withColumn("any", F.max(overlap.cast("int")).over(w))
    order = Window.partitionBy("path_id", "side").orderBy(F.col("overlap").cast("int").desc(), "distance", "band_id")
    r = r.withColumn("rank", F.row_number().over(order))
    room = F.when(F.col("side") == 0, capacity // 2).when(F.col("side") == 1, capacity - capacity // 2).when(F.col("any") == 1, capacity).otherwise(2)
    keep = (F.col("rank") <= room) & (F.col("clean") | F.col("overlap") | (F.col("any") == 0))
    return r.filter(keep).select("path_id", "band_id", "side", "rank", "distance")


def resample(points: DataFrame, size: int, by: list[str], x: str = "k", y: str = "energy") -> DataFrame:
    """FN1: shape-preserving cubic interpolation on ``size`` equal steps of each group's axis.

    Samples with the same x are averaged; slopes are the weighted harmonic means of the neighbouring
    differences, 0 where they change sign, and three-point slopes at the ends; two knots give a
    line, one a constant. Each interval gets the grid points in it by index arithmetic, no range join.
    """
    knots = points.filter(F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x")).agg(F.avg(y).alias("y"))
    o, g = Window.partitionBy(*by).orderBy("x"), Window.partitionBy(*by)
    rows = knots.withColumn("h", F.lead("x").over(o) - F.col("x")).withColumn("d", (F.lead("y").over(o) - F.col("y")) / F.col("h"))
    rows = rows.withColumn("h0", F.lag("h").over(o)).withColumn("d0", F.lag("d").over(o)).withColumn("n", F.count("*").over(g)).withColumn("i", F.row_number().over(o))
    rows = rows.withColumn("h2", F.lead("h").over(o)).withColumn("d2", F.lead("d").over(o)).withColumn("h00", F.lag("h0").over(o)).withColumn("d00", F.lag("d0").over(o))
    h0, h, d0, d = (F.col(c) for c in ("h0", "h", "d0", "d"))
    w1, w2 = 2 * h + h0, h + 2 * h0
    inner = F.when(d0 * d <= 0, 0.0).otherwise((w1 + w2) / (w1 / d0 + w2 / d))

    def end(ha: Column, hb: Column, da: Column, db: Column) -> Column:
        s = ((2 * ha + hb) * da - ha * db) / (ha + hb)
        return F.when(F.signum(s) != F.signum(da), 0.0).when((F.signum(da) != F.signum(db)) & (F.abs(s) > 3 * F.abs(da)), 3 * da).otherwise(s)

    first, final = F.col("i") == 1, F.col("i") == F.col("n")
    slope = F.when(F.col("n") == 1, 0.0).when(F.col("n") == 2, F.coalesce(d, d0)).when(first, end(h, F.col("h2"), d, F.col("d2"))).when(final, end(h0, F.col("h00"), d0, F.col("d00"))).otherwise(inner)
    rows = rows.withColumn("m", slope)
    rows = rows.withColumn("y1", F.lead("y").over(o)).withColumn("m1", F.lead("m").over(o)).withColumn("lo", F.min("x").over(g)).withColumn("hi", F.max("x").over(g))
    step = (F.col("hi") - F.col("lo")) / (size - 1)
    at = lambda c: (F.col(c) - F.col("lo")) / step
    rows = rows.withColumn("x1", F.col("x") + F.col("h"))
    begin = F.ceil(F.round(at("x"), 9)).cast("int")
    upto = F.when(F.col("i") == F.col("n") - 1, F.lit(size - 1)).otherwise(F.ceil(F.round(at("x1"), 9)).cast("int") - 1)
    upto = F.when(F.col("n") == 1, size - 1).otherwise(upto)
    begin = F.when(F.col("n") == 1, 0).otherwise(begin)
    cells = rows.filter((F.col("n") == 1) | F.col("h").isNotNull()).withColumn("begin", begin).withColumn("upto", upto).filter("begin <= upto")
    cells = cells.withColumn("cell", F.explode(F.sequence("begin", "upto")))
    t = F.when(F.col("n") == 1, 0.0).otherwise((F.col("lo") + F.col("cell") * step - F.col("x")) / F.col("h"))
    cells = cells.withColumn("t", t)
    t, h = F.col("t"), F.col("h")
    curve = (1 + 2 * t) * (1 - t) * (1 - t) * F.col("y") + t * (1 - t) * (1 - t) * h * F.col("m") + t * t * (3 - 2 * t) * F.col("y1") + t * t * (t - 1) * h * F.col("m1")
    return cells.select(*by, "cell", F.when(F.col("n") == 1, F.col("y")).otherwise(curve).alias("value"))


def nearest_sample(labels: DataFrame, points: DataFrame) -> DataFrame:
    """JN16: the sample whose distance is nearest to each label's; the first one on ties.

    An as-of match without a join: labels and samples of a path go in one order of distance, where the
    last sample before a label and the first after it are running values; the nearer of both wins. Of
    samples at one distance (a break) the first stands for all.
    """
    samples = points.filter("k is not null").groupBy("path_id", "k").agg(F.min("k_idx").alias("k_idx"))
    both = samples.select("path_id", "k", F.struct("k", "k_idx").alias("s")).unionByName(labels.select("path_id", F.col("label_k").alias("k"), "label"), allowMissingColumns=True)
    is_label = F.col("s").isNull()
    upto = Window.partitionBy("path_id").rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("s", ignorenulls=True).over(upto.orderBy("k", is_label))
    after = F.last("s", ignorenulls=True).over(upto.orderBy(F.col("k").desc(), is_label))
    near = lambda s: F.when(s.isNotNull(), F.struct(F.abs(s["k"] - F.col("k")).alias("d"), s["k_idx"].alias("k_idx")))
    got = both.withColumn("b", before).withColumn("a", after).filter(is_label).withColumn("x", F.least(near(F.col("b")), near(F.col("a"))))
    return got.filter("x.d is not null").select("path_id", "label", F.col("k").alias("label_k"), F.col("x.k_idx").alias("k_idx"), F.col("x.d").alias("off"))


def long_samples(points: DataFrame) -> DataFrame:
    """SNK4: samples with their state, observed or missing."""
    return points.withColumn("sample_state", F.when(F.col("energy").isNull(), "missing").otherwise("observed"))


def sorted_mae(pairs: DataFrame, by: list[str]) -> DataFrame:
    """AG22: mean absolute error after both sides are sorted by energy at each k (1-D optimal transport)."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by, "k_idx").orderBy(c))
    a = pairs.select(*by, "k_idx", F.col("pred").alias("a"), rank("pred").alias("r"))
    b = pairs.select(*by, "k_idx", F.col("target").alias("b"), rank("target").alias("r"))
    return a.join(b, [*by, "k_idx", "r"]).groupBy(*by).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("sorted_mae"), F.count("*").alias("n"))
