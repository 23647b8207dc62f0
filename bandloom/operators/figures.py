"""Figure corpus: licences, boxes, overlap, review queues and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def license_of(value: Column) -> tuple[Column, Column]:
    """FLT10: CC-BY or null, and the reason of a refusal: only attribution-only Creative Commons is taken."""
    low = F.regexp_replace(F.lower(F.trim(value)), r"[\s_]+", "-")
    cc = low.rlike(r"^(cc-by|https?://creativecommons\.org/licenses/by)(-?[0-9.]+|/[0-9.]+/?)?$")
    limited = low.rlike(r"(-|/by-)(nc|nd|sa)")
    return F.when(cc & ~limited, "CC-BY"), F.when(limited, "restricted").when(~cc | value.isNull(), "unknown")


def iou(a: Column, b: Column) -> Column:
    """JN21: overlap over union of two boxes (structs x1, y1, x2, y2); 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def best_match(left: DataFrame, right: DataFrame, image: str) -> DataFrame:
    """JN21: for each left box its best overlap with the right boxes of the same image, and a flag."""
    pairs = left.join(right.select(image, F.col("box").alias("other")), image, "left")
    got = pairs.groupBy(image, "box_id").agg(F.max(iou(F.col("box"), F.col("other"))).alias("best"), F.count("other").alias("labels"))
    flag = F.when(F.col("labels") == 0, "missing").when(F.col("best") < 0.5, "low").when(F.col("labels") > 1, "multi").otherwise("ok")
    return got.withColumn("best", F.coalesce("best", F.lit(0.0))).withColumn("flag", flag)


def suppress(boxes: DataFrame, image: str, bound: float = 0.55) -> DataFrame:
    """JN22: greedy suppression: boxes by falling score, each dropped if it overlaps a kept one by ``bound`` or more.

    The order matters, so an image's boxes are one array, folded over once; ties go by ``box_id``.
    """
    own = [c for c in boxes.columns if c != image]
    listed = boxes.groupBy(image).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("__o"), F.col("box_id").alias("__b"), *own))).alias("all"))
    size = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])

    def hit(a: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
        h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        union = size(a) + size(b) - w * h
        return (union > 0) & (w * h >= bound * union)

    add = lambda kept, b: F.when(F.exists(kept, lambda k: hit(k, b)), kept).otherwise(F.array_append(kept, b))
    kept = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), add)
    return listed.select(image, F.inline(kept)).select(*boxes.columns)


def clean_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """FLT32: clamp boxes to the image; drop those under 70 x 55 pixels or over 85% of it."""
    lim = lambda c, hi: F.least(F.lit(float(hi)), F.greatest(F.lit(0.0), F.col(c)))
    got = boxes.withColumns({"x1": lim("x1", width), "x2": lim("x2", width), "y1": lim("y1", height), "y2": lim("y2", height)})
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return got.filter((w >= 70) & (h >= 55) & (w * h <= 0.85 * width * height))


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """FN15: percent box (x, y, w, h) to whole pixels; null where it leaves the image or collapses."""
    at = lambda c, s: F.round(c * s / 100).cast("int")
    x1, y1 = at(box["x"], width), at(box["y"], height)
    x2, y2 = at(box["x"] + box["w"], width), at(box["y"] + box["h"], height)
    ok = (box["x"] >= 0) & (box["y"] >= 0) & (box["x"] + box["w"] <= 100) & (box["y"] + box["h"] <= 100) & (x2 > x1) & (y2 > y1)
    return F.when(ok, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def coco_rows(images: DataFrame) -> DataFrame:
    """SNK5: one annotation a box: x, y, width, height, area, and an ignore flag for uncertain targets."""
    rows = images.select("image_id", "target", F.posexplode("boxes").alias("i", "b"))
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    return rows.select("image_id", (F.col("i") + 1).alias("annotation"), F.col("b.x1").alias("x"), F.col("b.y1").alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"), (F.col("target") == "uncertain").cast("int").alias("ignore"))


def label_line(cls: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    """SNK6: class, centre and size in shares of the image with six decimals; null for an empty box."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    cx, cy, w, h = unit((x1 + x2) / 2 / width), unit((y1 + y2) / 2 / height), unit((x2 - x1) / width), unit((y2 - y1) / height)
    return F.when((w > 0) & (h > 0), F.format_string("%d %.6f %.6f %.6f %.6f", cls.cast("int"), cx, cy, w, h))


def per_group_cap(rows: DataFrame, group: str, most: int, keys: list[str], order: str) -> DataFrame:
    """TK5: first rows of a group, after duplicates of each key are dropped (the first in order stays)."""
    for k in keys:
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(k).orderBy(order))).filter("__r = 1").drop("__r")
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("__r") <= most).drop("__r")


def review_queue(data: DataFrame, marks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JN13: rows of both sides; ``problem`` names a missing side or the first field that differs."""
    b = marks.select(key, F.lit(1).alias("__b"), *[F.col(c).alias(f"__{c}") for c in fields])
    j = data.withColumn("__a", F.lit(1)).join(b, key, "full")
    differs = F.coalesce(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(f"{c} differs")) for c in fields])
    problem = F.when(F.col("__a").isNull(), "no data").when(F.col("__b").isNull(), "no mark").otherwise(differs)
    return j.select(key, problem.alias("problem"))


def batch_coverage(labels: DataFrame, n: int) -> DataFrame:
    """AG44: whether 1..n is covered exactly once: missing, doubled and out-of-range numbers, and counts by target."""
    want = labels.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("number"), F.lit(1).alias("want"))
    got = labels.groupBy("number").agg(F.count("*").alias("times"))
    j = want.join(got, "number", "full")
    return j.agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if((F.col("times") > 1) & F.col("want").isNotNull()).alias("doubled"), F.count_if(F.col("want").isNull()).alias("out_of_range"))


def decision_status(decision: Column, reviewer: Column, note: Column) -> tuple[Column, Column]:
    """FLT30: status of a review decision, or the reason why it is refused; ``approved`` is never allowed."""
    bad = F.when(decision == "approved", "approval refused").when(~decision.isin("accept", "reject", "unclear") | decision.isNull(), "unknown decision").when(F.coalesce(F.length(note), F.lit(0)) < 1, "no note").when(F.length(note) > 5000, "note too long")
    status = F.when(reviewer == "human", "reviewed").when(reviewer == "assistant", "proposed").otherwise("unattributed")
    return F.when(bad.isNull(), status), bad
