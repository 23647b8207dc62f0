"""Feature tables built from several operators: edge channels, band extraction, masses, assignments, traces."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bands import edge_envelopes, extremum_distance, fermi_window, quadratic_curvature, resample
from .measure import path_diagnostics
from .quality import all_reasons


def edge_features(points: DataFrame, size: int = 128) -> DataFrame:
    """FN3: per path, edge and grid cell the energy, its curvature and the signed distance to the extremum.

    Envelopes of the whole path are resampled, clamped at the level, and differenced on the grid;
    a path with a k that lacks one side is left out.
    """
    env = edge_envelopes(points).filter("complete").join(points.groupBy("path_id", "k_idx").agg(F.min("k").alias("k")), ["path_id", "k_idx"])
    out = []
    for edge, clamp in (("vbm", F.least), ("cbm", F.greatest)):
        grid = resample(env, size, ["path_id"], y=edge).select("path_id", F.col("cell").alias("k_idx"), clamp(F.col("value"), F.lit(0.0)).alias("energy"))
        curved = quadratic_curvature(grid, ["path_id"])
        out.append(extremum_distance(curved, edge == "vbm").withColumn("edge", F.lit(edge)))
    return out[0].unionByName(out[1]).select("path_id", "edge", F.col("k_idx").alias("cell"), "energy", "curvature", "distance")


def extract_bands(points: DataFrame, capacity: int, half: float, size: int) -> DataFrame:
    """FN2: bands chosen near the level, resampled inside each segment; ``slot`` numbers a path's bands, absent slots have no rows."""
    chosen = fermi_window(points, capacity, half)
    slot = F.row_number().over(Window.partitionBy("path_id").orderBy("side", "rank", "band_id")) - 1
    chosen = chosen.withColumn("slot", slot).select("path_id", "band_id", "slot")
    grid = resample(points.join(chosen, ["path_id", "band_id"]), size, ["path_id", "band_id", "segment_id"])
    return grid.join(chosen, ["path_id", "band_id"]).select("path_id", "slot", "band_id", "segment_id", "cell", "value")


def resampling_audit(points: DataFrame, capacity: int, half: float, size: int) -> DataFrame:
    """AG25: the same diagnostics on all bands, the chosen bands, and the chosen bands resampled; absent stages mean no such rows."""
    chosen = fermi_window(points, capacity, half).select("path_id", "band_id")
    picked = points.join(chosen, ["path_id", "band_id"])
    grid = resample(picked, size, ["path_id", "band_id", "segment_id"]).select("path_id", "band_id", "segment_id", (F.col("segment_id") * size + F.col("cell")).alias("k_idx"), F.col("value").alias("energy"))
    stages = [("raw_full", points), ("raw_selected", picked), ("resampled", grid)]
    out = [path_diagnostics(df).withColumn("stage", F.lit(name)) for name, df in stages]
    return out[0].unionByName(out[1]).unionByName(out[2])


def directional_mass(points: DataFrame, electrons: bool, isolation: float = 1e-6) -> DataFrame:
    """FN12: inverse curvature at each band's extremum from five samples in a row, or the reason why there is none.

    The five samples must lie in one segment at growing k, no other band may touch or cross the band
    within them, the extremum must be strict, and the fits through five and through three samples
    must agree within 1e-5.
    """
    o = Window.partitionBy("path_id", "band_id").orderBy("k_idx")
    near = o.rowsBetween(-2, 2)
    rows = points.withColumn("w", F.collect_list(F.struct("k", "energy", "segment_id", "k_idx")).over(near))
    sign = 1.0 if electrons else -1.0
    best = F.min(F.struct((F.lit(sign) * F.col("energy")).alias("e"), "k_idx", "w")).alias("b")
    at = rows.groupBy("path_id", "band_id").agg(best).select("path_id", "band_id", F.col("b.k_idx").alias("k_idx"), F.col("b.w").alias("w"))
    field = lambda i, f: F.get("w", F.lit(i))[f]
    x = [field(i, "k") - field(2, "k") for i in range(5)]
    y = [F.lit(sign) * (field(i, "energy") - field(2, "energy")) for i in range(5)]
    whole = (F.size("w") == 5) & (field(2, "k_idx") == F.col("k_idx"))
    one = F.size(F.array_distinct(F.transform("w", lambda v: v["segment_id"]))) == 1
    grows = F.forall(F.array(*[x[i + 1] - x[i] for i in range(4)]), lambda d: d > 1e-12)
    # Order against every other band must be the same at all five places.
    others = points.select("path_id", F.col("band_id").alias("other"), F.col("k_idx").alias("at"), F.col("energy").alias("oe"))
    mine = at.select("path_id", "band_id", F.explode("w").alias("v")).select("path_id", "band_id", F.col("v.k_idx").alias("at"), F.col("v.energy").alias("e"))
    gap = mine.join(others, ["path_id", "at"]).filter("other <> band_id").groupBy("path_id", "band_id", "other").agg(F.min(F.abs(F.col("oe") - F.col("e"))).alias("m"), F.count_distinct(F.signum(F.col("oe") - F.col("e"))).alias("s"))
    touched = gap.filter((F.col("m") <= isolation) | (F.col("s") > 1)).select("path_id", "band_id").distinct().withColumn("touched", F.lit(True))
    s = lambda p, q=None: sum((F.pow(v, F.lit(float(p))) * (q[i] if q else 1) for i, v in enumerate(x)), F.lit(0.0))
    n, s1, s2, s3, s4, t0, t1, t2 = F.lit(5.0), s(1), s(2), s(3), s(4), s(0, y), s(1, y), s(2, y)
    a5 = (t2 * (n * s2 - s1 * s1) - t1 * (n * s3 - s1 * s2) + t0 * (s1 * s3 - s2 * s2)) / (s4 * (n * s2 - s1 * s1) - s3 * (n * s3 - s1 * s2) + s2 * (s1 * s3 - s2 * s2))
    a3 = (y[3] / x[3] - y[1] / x[1]) / (x[3] - x[1])
    got = at.join(touched, ["path_id", "band_id"], "left")
    strict = (y[1] > 0) & (y[3] > 0)
    reason = F.when(~whole | ~one, "end of segment").when(~grows, "k does not grow").when(F.col("touched"), "branch not isolated").when(~strict | (a5 <= 0) | (F.abs(a5 - a3) > 1e-5 * F.abs(a3)), "not quadratic").otherwise("local quadratic fit")
    return got.select("path_id", "band_id", "k_idx", reason.alias("reason"), F.when(reason == "local quadratic fit", 1 / (2 * a5)).alias("mass"))


def assignment(cost: np.ndarray) -> float:
    """Least sum of a square cost matrix over all assignments: shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        best, back, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            done[col] = True
            slack = cost[match[col] - 1] - u[match[col]] - v[1:]
            better = ~done[1:] & (slack < best[1:])
            best[1:][better], back[1:][better] = slack[better], col
            nxt = int(np.where(done[1:], np.inf, best[1:]).argmin()) + 1
            step = best[nxt]
            u[match[done]] += step
            v[done] -= step
            best[~done] -= step
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col], col = match[back[col]], back[col]
    return float(sum(cost[match[c] - 1, c - 1] for c in range(1, n + 1)))


def matched(x: np.ndarray, y: np.ndarray, seg: np.ndarray, listed: int = 4) -> np.ndarray:
    """Mean errors of samples of one shape (samples, k, bands): by slot, by assignment per segment and over all, and sorted at each k.

    Up to ``listed`` bands all assignments are tried, for all samples at once; of more bands each
    sample's least assignment is searched. Segments (samples, k) are in a row.
    """
    m, n, b = x.shape
    first = np.concatenate([np.ones((m, 1), bool), seg[:, 1:] != seg[:, :-1]], axis=1).ravel()
    begin = np.flatnonzero(first)
    if b <= listed:
        cost = np.stack([np.abs(x - y[:, :, list(p)]).sum(2) for p in permutations(range(b))])
        overall, parts = cost.sum(2).min(0), np.add.reduceat(cost.reshape(len(cost), -1), begin, axis=1).min(0)
    else:
        pair = lambda c, d: assignment(np.abs(c.T[:, None] - d.T[None]).sum(-1))
        overall = np.array([pair(c, d) for c, d in zip(x, y, strict=True)])
        flat_x, flat_y, ends = x.reshape(-1, b), y.reshape(-1, b), np.append(begin[1:], m * n)
        parts = np.array([pair(flat_x[lo:hi], flat_y[lo:hi]) for lo, hi in zip(begin, ends, strict=True)])
    by_segment = np.bincount(begin // n, parts, m)
    mean = lambda d: np.abs(d).mean((1, 2))
    return np.stack([mean(x - y), by_segment / (n * b), overall / (n * b), mean(np.sort(x, 2) - np.sort(y, 2))], axis=1)


def trajectory_matching(pairs: DataFrame, budget: int = 1_000_000) -> DataFrame:
    """AG29: per sample the mean error by slot, by assignment of whole bands (per segment and over all), and by sorting at each k.

    ``pairs`` has ``sample_id, band, segment_id, k_idx, pred, target``, every band at every k. A
    sample of more than ``budget`` cost elements is refused (nulls and a status). A task walks over
    its sorted samples, those of an Arrow batch that have one shape at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            ids = frame["sample_id"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            sizes = np.diff(np.append(starts, len(ids)))
            at, code = np.repeat(np.arange(len(starts)), sizes), np.unique(frame["band"].to_numpy(), return_inverse=True)[1]
            o = np.lexsort((code, at))
            fresh = np.concatenate([[True], (code[o][1:] != code[o][:-1]) | (at[o][1:] != at[o][:-1])])
            bands = np.bincount(at[o][fresh], minlength=len(starts))
            status, values = np.full(len(starts), "incomplete", object), np.full((len(starts), 4), np.nan)
            status[bands**2 * (sizes // bands) > budget] = "over budget"
            todo = (status != "over budget") & (sizes % bands == 0)
            cols = [frame[c].to_numpy(kind) for c, kind in (("k_idx", None), ("segment_id", None), ("pred", float), ("target", float))]
            for n, b in np.unique(np.stack([sizes, bands])[:, todo], axis=1).T:
                some = np.flatnonzero(todo & (sizes == n) & (bands == b))
                rows = (starts[some][:, None] + np.arange(n)).reshape(len(some), -1, b)
                band, k, seg, x, y = (c[rows] for c in (code, *cols))
                whole = (np.diff(band[:, 0]) > 0).all(1) & (band == band[:, :1]).all((1, 2)) & (k == k[:, :, :1]).all((1, 2)) & (np.isfinite(x) & np.isfinite(y)).all((1, 2))
                if whole.any():
                    status[some[whole]], values[some[whole]] = "ok", matched(x[whole], y[whole], seg[whole][:, :, 0])
            return pd.DataFrame({"sample_id": ids[starts], "status": status} | {c: values[:, i] for i, c in enumerate(("slot", "by_segment", "overall", "transport"))})

        for frame in frames:  # a sample may go on in the next frame
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            last = int(np.argmax(frame["sample_id"].to_numpy() == frame["sample_id"].iloc[-1]))
            held = frame.iloc[last:]
            if last:
                yield work(frame.iloc[:last])
        if held is not None:
            yield work(held)

    kind = pairs.schema["sample_id"].dataType.simpleString()
    rows = pairs.select("sample_id", "band", "segment_id", "k_idx", F.col("pred").cast("double"), F.col("target").cast("double"))
    dealt = rows.repartition("sample_id").sortWithinPartitions("sample_id", "segment_id", "k_idx", "band")
    return dealt.mapInPandas(run, f"sample_id {kind}, status string, slot double, by_segment double, overall double, transport double")


def derivative_eligibility(dims: Column, points: Column, segments: Column, unit: Column) -> Column:
    """AG28: reasons why physical derivatives can't be certified; never empty, so nothing is eligible."""
    return F.concat(
        all_reasons((dims == 1, "k is a scalar"), ((dims != 3) | (points != segments), "k and segments differ"), (unit.isNull() | (unit != "1/angstrom"), "no reciprocal unit")),
        F.array(F.lit("source binding not verified"), F.lit("derivatives not certified")),
    )


def preparation_report(rows: DataFrame, split: str, reason: str, bands: str, capacity: int) -> DataFrame:
    """AG42: per split the valid and excluded rows, rows by reason, mean bands, and the share at capacity; excluded rows have a reason."""
    ok = F.col(reason).isNull()
    counts = rows.groupBy(split).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("excluded"), F.avg(F.when(ok, F.col(bands))).alias("mean_bands"), F.avg(F.when(ok, (F.col(bands) >= capacity).cast("double"))).alias("at_capacity"))
    why = rows.filter(~ok).groupBy(split, reason).agg(F.count("*").alias("n")).groupBy(split).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(reason, "n"))), lambda x: F.concat_ws("=", x[reason], x["n"])), ",").alias("reasons"))
    return counts.join(why, split, "left")


def content_fingerprint(k: Column, energies: Column) -> Column:
    """KEY11: SHA-256 of the shape as text and the table (k first, then the bands) as little-endian 32-bit floats.

    Exact bytes need a vectorised Python function; a ragged or null table gives null.
    """

    @F.pandas_udf("string")
    def digest(ks: pd.Series, es: pd.Series) -> pd.Series:
        import hashlib

        def one(x, y):
            if x is None or y is None or any(r is None or len(r) != len(x) for r in y):
                return None
            table = np.column_stack([np.asarray(x), *[np.asarray(r) for r in y]]).astype("<f4")
            return hashlib.sha256(str(table.shape).encode("ascii") + table.tobytes()).hexdigest()

        return pd.Series([one(a, b) for a, b in zip(ks, es, strict=True)])

    return digest(k, energies)


def text_fingerprint(k: Column, energies: Column, scale: int = 1000) -> Column:
    """KEY11: the same in SQL alone: SHA-256 of the shape and of the numbers in whole parts of ``scale``, row by row as text.

    A ragged or null table gives null, like the byte form; numbers closer than half a part are equal.
    """
    whole = lambda x: F.round(x * scale).cast("long").cast("string")
    even = F.forall(energies, lambda e: F.size(e) == F.size(k))
    row = lambda i: F.array_join(F.concat(F.array(whole(F.get(k, i))), F.transform(energies, lambda e: whole(F.get(e, i)))), ",")
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.size(k) - 1), row), ";")
    shape = F.concat(F.lit("("), F.size(k), F.lit(", "), F.size(energies) + 1, F.lit(")"))
    return F.when(even & (F.size(k) > 0), F.sha2(F.concat(shape, body), 256))


def pixel_trace(points: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """FN16: pixels to k and energy by two anchors an axis, with a reason where the calibration can't be used.

    ``anchors`` has ``px1, kx1, px2, kx2`` for k and ``py1, ey1, py2, ey2, level_y`` for energy.
    Points outside the calibrated k interval are refused, never clipped.
    """
    bad = F.when((F.col("px1") == F.col("px2")) | (F.col("py1") == F.col("py2")), "anchors coincide").when(F.col("ey1") == F.col("ey2"), "flat energy axis").when(F.array_sort(F.array("kx1", "kx2")) != F.array(F.lit(0.0), F.lit(1.0)), "k endpoints are not 0 and 1")
    a = anchors.withColumn("problem", bad)
    ks, es = (F.col("kx2") - F.col("kx1")) / (F.col("px2") - F.col("px1")), (F.col("ey2") - F.col("ey1")) / (F.col("py2") - F.col("py1"))
    j = points.join(a, by)
    k, e = F.col("kx1") + (F.col("x") - F.col("px1")) * ks, (F.col("y") - F.col("level_y")) * es
    problem = F.coalesce("problem", F.when((k < -1e-9) | (k > 1 + 1e-9), "outside the k interval"))
    return j.select(by, "x", "y", F.when(problem.isNull(), k).alias("k"), F.when(problem.isNull(), e).alias("energy"), problem.alias("problem"))


def mesh_of_xml(rows: DataFrame, key: str, text: str) -> DataFrame:
    """SRC8: energies and occupancies of a mesh document: rows ``(key, spin, k_idx, band_idx, energy, occupancy, weight, status)``.

    Only Gamma-centred and Monkhorst-Pack meshes are read; a document with entities, another
    generation scheme or a broken form gives one row with the reason.
    """
    schema = "generation struct<_param:string>, weights array<double>, spin array<struct<_n:int, kpoint:array<struct<_n:int, r:array<string>>>>>"
    got = rows.select(key, F.col(text).alias("t"), F.when(~F.col(text).rlike("<!DOCTYPE|<!ENTITY"), F.from_xml(F.col(text), schema, {"rowTag": "mesh"})).alias("m"))
    kind = F.lower(F.coalesce("m.generation._param", F.lit("")))
    status = F.when(F.col("t").rlike("<!DOCTYPE|<!ENTITY"), "entities").when(~kind.isin("gamma", "monkhorst-pack"), "not a uniform mesh").when(F.col("m.spin").isNull(), "no energies").otherwise("ok")
    got = got.withColumn("status", status)
    spins = got.select(key, "status", F.col("m.weights").alias("weights"), F.explode_outer(F.when(F.col("status") == "ok", F.col("m.spin"))).alias("s"))
    ks = spins.select(key, "status", "weights", F.col("s._n").alias("spin"), F.posexplode_outer("s.kpoint").alias("k_idx", "kp"))
    cells = ks.select(key, "status", "weights", "spin", "k_idx", F.posexplode_outer("kp.r").alias("band_idx", "r"))
    pair = F.split(F.trim("r"), r"\s+")
    return cells.select(key, "spin", "k_idx", "band_idx", F.get(pair, F.lit(0)).try_cast("double").alias("energy"), F.get(pair, F.lit(1)).try_cast("double").alias("occupancy"), F.get("weights", F.col("k_idx")).alias("weight"), "status")
