"""Crystal geometry: lattices, reciprocal lattices, dense paths, periodic neighbours, composition statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def lattice_from_cell(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> tuple[Vec, Vec, Vec]:
    """FN5: row vectors of a cell given by lengths and degrees; null where no such cell exists."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    cy = c * (ca - cb * cg) / sg
    square = c * c - c * c * cb * cb - cy * cy
    ok = (a > 0) & (b > 0) & (c > 0) & (sg > 1e-9) & (square > 1e-12)
    when = lambda x: F.when(ok, x)
    zero = F.lit(0.0)
    return (when(a), when(zero), when(zero)), (when(b * cg), when(b * sg), when(zero)), (when(c * cb), when(cy), when(F.sqrt(F.greatest(square, zero))))


def cross(u: Vec, v: Vec) -> Vec:
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def dot(u: Vec, v: Vec) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def reciprocal(a: Vec, b: Vec, c: Vec) -> tuple[Column, tuple[Vec, Vec, Vec]]:
    """FN6: cell volume (signed) and reciprocal vectors with the factor 2 pi; null for a flat cell."""
    volume = dot(a, cross(b, c))
    scale = F.when(F.abs(volume) > 1e-12, 2 * math.pi / volume)
    return volume, tuple(tuple(x * scale for x in cross(*p)) for p in ((b, c), (c, a), (a, b)))


def cell_from_lattice(a: Vec, b: Vec, c: Vec) -> dict[str, Column]:
    """FN7: lengths, angles in degrees and volume of a lattice."""
    n = {k: F.sqrt(dot(v, v)) for k, v in (("a", a), ("b", b), ("c", c))}
    angle = lambda u, v, p: F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(u, v) / p))))
    return n | {"alpha": angle(b, c, n["b"] * n["c"]), "beta": angle(a, c, n["a"] * n["c"]), "gamma": angle(a, b, n["a"] * n["b"]), "volume": F.abs(dot(a, cross(b, c)))}


def group_bucket(number: Column, buckets: int = 8) -> Column:
    """FN8: one-hot array of floor(log2(space group))."""
    at = F.least(F.lit(buckets - 1), F.floor(F.log2(number.cast("double")))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: (i == at).cast("int"))


def dense_path(segments: DataFrame, points: int) -> DataFrame:
    """FN9: ``points`` places along each segment, both ends included, with the distance summed up over a path's segments.

    ``segments`` has ``path_id, segment, x1, y1, z1, x2, y2, z2`` in cartesian units.
    """
    length = F.sqrt(sum((F.pow(F.col(f"{c}2") - F.col(f"{c}1"), F.lit(2.0)) for c in "xyz"), F.lit(0.0)))
    o = Window.partitionBy("path_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("length", length).withColumn("start", F.coalesce(F.sum("length").over(o), F.lit(0.0))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t = F.col("i") / (points - 1)
    return rows.select("path_id", "segment", "i", *[(F.col(f"{c}1") + t * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(c) for c in "xyz"], (F.col("start") + t * F.col("length")).alias("distance"))


def rbf(distance: Column, bins: int = 40, top: float = 8.0) -> Column:
    """FN10: Gaussians of a distance at ``bins`` centres from 0 to ``top``, as wide as their spacing."""
    step = top / (bins - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.exp(-F.pow((distance - i * step) / step, F.lit(2.0))))


def unit_vector(v: Column) -> Column:
    """FN11: a vector over its length; null for a zero or non-finite one.

    The length stands beside the vector as an array, since inside a lambda it would be worked out again for every component.
    """
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ok = (square > 0) & (square < float("inf")) & ~F.isnan(square)
    return F.when(ok, F.zip_with(v, F.array_repeat(F.sqrt(square), F.size(v)), lambda x, n: x.cast("double") / n))


def composition_stats(parts: DataFrame, by: str, table: DataFrame) -> DataFrame:
    """AG46: weighted mean, population deviation, least and largest of an element property, distinct elements, mean Z.

    ``parts`` has ``element, count``; ``table`` a row an element with ``z`` and ``value``.
    """
    rows = parts.join(F.broadcast(table), "element")
    w = F.col("count").cast("double")
    got = rows.groupBy(by).agg(F.sum(w).alias("n"), F.sum(w * F.col("value")).alias("s"), F.sum(w * F.col("value") * F.col("value")).alias("q"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("element").alias("elements"), F.sum(w * F.col("z")).alias("z"))
    mean = F.col("s") / F.col("n")
    return got.select(by, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"), "low", "high", "elements", (F.col("z") / F.col("n")).alias("mean_z"))


def periodic_neighbours(atoms: DataFrame, cells: DataFrame, radius: float, most: int, fine: int = 2) -> DataFrame:
    """JN18: the ``most`` nearest atom images within ``radius`` of each atom, with image and a flag for a tie at the edge.

    ``atoms`` has ``material_id, atom, fx, fy, fz``; ``cells`` the lattice ``ax..cz`` of each material. A
    cell list: the cell is cut along each axis into bins at least ``radius / fine`` thick (one bin if it
    is thinner), whose thickness follows from the cell's heights. An atom looks only into the bins
    that its radius reaches; a bin beyond the cell is the wrapped bin in another image, so each (bin,
    image) is met once, and source and target meet on the key (material, bin). An atom's own zero
    image (nearer than 0.01) is left out.
    """
    vec = lambda p: (F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{p}z"))
    a, b, c = vec("a"), vec("b"), vec("c")
    volume = F.abs(dot(a, cross(b, c)))
    height = lambda u, v: volume / F.sqrt(dot(cross(u, v), cross(u, v)))
    tall = {"x": height(b, c), "y": height(c, a), "z": height(a, b)}
    frame = cells.select("material_id", *[F.col(f"{v}{x}") for v in "abc" for x in "xyz"], *[(radius / h).alias(f"r{x}") for x, h in tall.items()])
    frame = frame.withColumns({f"n{x}": F.greatest(F.lit(1), F.floor(fine / F.col(f"r{x}"))).cast("int") for x in "xyz"})
    placed = atoms.join(frame, "material_id").withColumns({f"o{x}": F.floor(f"f{x}").cast("int") for x in "xyz"})
    bins = {x: F.least(F.col(f"n{x}") - 1, F.floor((F.col(f"f{x}") - F.col(f"o{x}")) * F.col(f"n{x}")).cast("int")) for x in "xyz"}
    dst = placed.select("material_id", *[bins[x].alias(f"g{x}") for x in "xyz"], F.col("atom").alias("dst"), *[F.col(f"f{x}").alias(f"d{x}") for x in "xyz"], *[F.col(f"o{x}").alias(f"w{x}") for x in "xyz"])
    src = placed.select("material_id", F.col("atom").alias("src"), *[F.col(f"f{x}").alias(f"s{x}") for x in "xyz"], *frame.columns[1:])
    for x in "xyz":
        reach = lambda sign: F.floor((F.col(f"s{x}") + sign * F.col(f"r{x}")) * F.col(f"n{x}") + sign * 1e-9).cast("int")  # noqa: B023, E731
        n = F.col(f"n{x}")
        src = src.withColumn(f"t{x}", F.sequence(reach(-1), reach(1))).withColumn(f"g{x}", F.explode(F.array_distinct(F.transform(f"t{x}", lambda t: F.pmod(t, n)))))  # noqa: B023
        src = src.withColumn(f"m{x}", F.transform(F.filter(f"t{x}", lambda t: F.pmod(t, n) == F.col(f"g{x}")), lambda t: F.floor(t / n).cast("int")))  # noqa: B023
    # Only wrapped bins are dealt out; their images follow where source and target have met, axis by axis.
    near = src.drop("tx", "ty", "tz").join(dst, ["material_id", "gx", "gy", "gz"])
    for x in "xyz":
        near = near.withColumn(f"i{x}", F.explode(f"m{x}")).filter(F.abs(F.col(f"d{x}") - F.col(f"w{x}") + F.col(f"i{x}") - F.col(f"s{x}")) <= F.col(f"r{x}") + 1e-9)
    # A target outside the cell (whole part w) is the image that takes it back by w.
    image = {x: F.col(f"i{x}") - F.col(f"w{x}") for x in "xyz"}
    off = {x: F.col(f"d{x}") + image[x] - F.col(f"s{x}") for x in "xyz"}
    xyz = tuple(off["x"] * a[n] + off["y"] * b[n] + off["z"] * c[n] for n in range(3))
    rows = near.select("material_id", "src", "dst", *[image[x].alias(k) for x, k in zip("xyz", "ijk", strict=True)], F.sqrt(dot(xyz, xyz)).alias("dist"))
    rows = rows.filter((F.col("dist") <= radius) & ~((F.col("src") == F.col("dst")) & (F.col("dist") < 0.01)))
    o = Window.partitionBy("material_id", "src").orderBy(F.round("dist", 9), "dst", "i", "j", "k")
    # One more than asked for is kept to see a tie at the edge; the limit is applied before the shuffle too.
    rows = rows.withColumn("rank", F.row_number().over(o)).filter(F.col("rank") <= most + 1)
    rows = rows.withColumn("next", F.lead(F.round("dist", 9)).over(o)).filter(F.col("rank") <= most)
    tie = (F.col("rank") == most) & (F.col("next") == F.round("dist", 9))
    return rows.select("material_id", "src", "dst", "i", "j", "k", "dist", "rank", F.coalesce(tie, F.lit(False)).alias("tie"))
