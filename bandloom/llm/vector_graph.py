"""Embedding near-dedup: robust-pruned flat graphs of overlapping cluster shards, searched within a range."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_groups, table, unit_hash


def robust_prune(vectors: np.ndarray, rows: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of the nodes ``rows`` (-1 fills) out of each one's candidates ``cand`` (-1 for none), pruned by occlusion.

    The nearest candidate left becomes a neighbour and drops every candidate that is ``alpha`` times
    nearer to it than to the node, by squared distance of unit vectors; so long edges survive.
    """
    out, line = np.full((len(rows), degree), -1, np.int32), np.arange(len(rows))
    x = vectors[cand]
    near = np.einsum("qd,qkd->qk", vectors[rows], x)
    near[(cand < 0) | (cand == rows[:, None])] = -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    cand, near, x = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(x, order[:, :, None], 1)
    alive, between = np.isfinite(near), x @ x.transpose(0, 2, 1)
    for k in range(degree):
        pick = alive.argmax(1)
        ok = alive[line, pick]
        if not ok.any():
            break
        out[ok, k] = cand[line, pick][ok]
        alive[line, pick] = False
        alive &= ~(ok[:, None] & (alpha * (1 - between[line, pick]) <= 1 - near))
    return out


def medoids(vectors: np.ndarray, count: int = 64) -> np.ndarray:
    """Nodes from which searches start: of ``count`` groups around nodes at random (in a fixed order) the one nearest to each group's mean."""
    centres = np.random.default_rng(len(vectors)).permutation(len(vectors))[:count]
    group = (vectors @ vectors[centres].T).argmax(1)
    sums = np.zeros((len(centres), vectors.shape[1]))
    np.add.at(sums, group, vectors)
    near = np.einsum("ij,ij->i", vectors, sums[group])
    order = np.lexsort((-near, group))
    return order[np.concatenate([[True], group[order][1:] != group[order][:-1]])]


def adjacency(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``n`` nodes' list begins, and all lists in a row, of edges told as ``from * n + to``."""
    pairs = np.unique(pairs)
    return np.searchsorted(pairs, np.arange(n + 1) * n), pairs % n


def walk(vectors: np.ndarray, links: tuple[np.ndarray, np.ndarray], queries: np.ndarray, starts: np.ndarray, beam: int, radius: float | None = None) -> np.ndarray:
    """Greedy search of the nodes ``queries``: similarity to each node that was visited, minus infinity for others.

    Each query starts at the nodes ``starts`` and at itself. It expands its nearest unexpanded node, ``beam`` times; with a ``radius``, then all unexpanded
    nodes within it at once, until there are none. All queries take their steps side by side, and
    similarities are worked out for visited nodes only.
    """
    own, line, (begin, to) = vectors[queries], np.arange(len(queries)), links
    sims = np.full((len(queries), len(vectors)), -np.inf, np.float32)
    todo = sims.copy()

    def visit(q: np.ndarray, at: np.ndarray) -> None:
        new = np.isneginf(sims[q, at])
        q, at = q[new], at[new]
        for lo in range(0, len(q), 50_000):
            a, b = q[lo : lo + 50_000], at[lo : lo + 50_000]
            sims[a, b] = todo[a, b] = np.einsum("id,id->i", own[a], vectors[b])

    visit(np.repeat(line, len(starts)), np.tile(starts, len(line)))
    visit(line, queries)
    live = line
    for _ in range(beam):
        best = todo[live].argmax(1)
        go = np.isfinite(todo[live, best])
        live, best = live[go], best[go]
        if not len(live):
            break
        todo[live, best] = -np.inf
        size = begin[best + 1] - begin[best]
        at = np.arange(int(size.sum())) + np.repeat(begin[best] - (np.cumsum(size) - size), size)
        visit(np.repeat(live, size), to[at])
    if radius is None:
        return sims
    edges = np.zeros((len(vectors), len(vectors)), np.float32)
    edges[np.repeat(np.arange(len(vectors)), np.diff(begin)), to] = 1
    while True:  # what a whole front reaches is one product with the edges
        front = todo >= radius
        if not front.any():
            return sims
        todo[front] = -np.inf
        visit(*np.nonzero((front.astype(np.float32) @ edges > 0) & np.isneginf(sims)))


def build_graph(vectors: np.ndarray, degree: int = 16, alpha: float = 1.2, beam: int = 24, pool: int = 48, batch: int = 256) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Adjacency lists of one shard (where each begins, and all in a row), and its medoids.

    The medoids go in first, then all others, one batch after the other, in a fixed random order: each
    node searches the graph as it is from the medoids, its visited nodes are pruned to its neighbours, and
    these get it as a neighbour in turn. Edges back are never pruned: the middle of a tight cluster must
    lead to all of it. A second round searches for every node once more in the whole graph.
    """
    n, starts = len(vectors), medoids(vectors)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([starts, order[~np.isin(order, starts)]])
    pairs = np.zeros(0, np.int64)
    for again in (False, True):
        lo = 0
        while lo < n:
            rows = order[lo : lo + (batch if again else min(batch, max(len(starts), lo)))]  # at most as large as what is in
            sims = walk(vectors, adjacency(pairs, n), rows, starts, beam)
            k = min(pool, n)
            cand = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            got = robust_prune(vectors, rows, np.where(np.isfinite(np.take_along_axis(sims, cand, 1)), cand, -1), degree, alpha)
            a, b = np.repeat(rows, degree), got.reshape(-1).astype(np.int64)
            a, b = a[b >= 0], b[b >= 0]
            pairs = np.concatenate([pairs, a * n + b, b * n + a])
            lo += len(rows)
    return adjacency(pairs, n), starts


def spread_pivots(pivots: np.ndarray, angle: float) -> np.ndarray:
    """Places of the unit vectors that are kept, in their order: none lies within ``angle`` of an earlier kept one."""
    free, kept = np.ones(len(pivots), bool), []
    for i in range(len(pivots)):
        if free[i]:
            kept.append(i)
            free &= pivots @ pivots[i] < np.cos(min(angle, np.pi))
    return np.array(kept, np.int64)


def _unit(frame: pd.DataFrame) -> np.ndarray:
    x = np.stack(frame["v"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_cells(x: np.ndarray, pivots: np.ndarray, border: float, overlap: int) -> tuple[np.ndarray, list[list[int]]]:
    """The nearest pivot of each row (home), and the others that are among the ``overlap`` nearest or whose border with it lies within ``border`` (guests).

    Between two pivots the border is the plane of equal distance; how far a row lies from it doesn't
    hang on how near the pivots are to each other.
    """
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 1e-18))
    homes, guests = [], []
    for lo in range(0, len(x), 512):
        near = x[lo : lo + 512] @ pivots.T
        home, line = near.argmax(1), np.arange(len(near))
        inside = near[line, home][:, None] - near <= (border + 1e-6) * apart[home]
        if overlap > 1:
            np.put_along_axis(inside, np.argsort(-near, axis=1, kind="stable")[:, :overlap], True, 1)
        inside[line, home] = False
        homes.append(home)
        guests += [np.flatnonzero(row).tolist() for row in inside]
    return np.concatenate(homes), guests


def cells_of(reps: DataFrame, reach: float, shard_rows: int, fan: int, overlap: int, slack: float, levels: int = 12) -> DataFrame:
    """Overlapping shards: rows of ``reps`` (``space, node, n, v``) with ``cell, homes, guests``, once for each shard.

    A cell of more than ``shard_rows`` is split around at most some ``fan`` of its vectors, sampled by hash,
    less those within three link angles of another; its members go to the nearest of these pivots
    (home), to the ``overlap`` nearest, and to all whose border with it is at most half a link's length away
    (guests), times ``slack`` over the root of the dimension where that is less than one. Of two linked vectors on either
    side of a border one lies within half their distance of it, so it is a guest where the other is
    at home. ``homes`` and ``guests`` tell for each level which these were. A cell of one pivot, a tight
    cluster, stays whole. A level sends a vector to a number of cells that doesn't grow with the
    table, and each part of 8,000 rows the cell's pivots. Only cells to be split are looked up, one for
    some ``shard_rows`` rows; what a level leaves as it is isn't written again.
    """
    kind = reps.schema["v"].dataType.simpleString()
    rows = reps.select("space", F.lit("").alias("cell"), "node", "n", "v", F.array().cast("array<int>").alias("homes"), F.array().cast("array<array<int>>").alias("guests"), F.lit(False).alias("whole"))
    leaves: DataFrame | None = None
    for level in range(levels):
        large = F.broadcast(table(rows.filter("not whole").groupBy("space", "cell").agg(F.count("*").alias("m")).filter(F.col("m") > shard_rows), f"vec-large-{level}"))
        done = rows.join(large, ["space", "cell"], "left_anti").drop("whole")
        leaves = done if leaves is None else leaves.union(done)
        rest = rows.join(large, ["space", "cell"])
        if rest.isEmpty():
            return leaves
        parts = F.ceil(F.col("m") / 8000).cast("int")
        members = rest.withColumn("part", F.pmod(F.xxhash64("node", F.lit(level)), parts).cast("int")).withColumn("pivot", F.lit(False))
        wanted = F.least(F.lit(float(fan)), F.greatest(F.lit(8.0), 4 * F.col("m") / shard_rows))
        pivots = rest.filter(unit_hash("node", F.lit(100 + level)) * F.col("m") < wanted).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("pivot", F.lit(True))

        def assign(frame: pd.DataFrame) -> pd.DataFrame | None:
            pivot = frame["pivot"].to_numpy(bool)
            found, frame = frame[pivot].sort_values("node"), frame[~pivot]
            if not len(frame):
                return None
            keep = ["space", "node", "n", "v"]
            base = [list(x) for x in frame["homes"]], [[list(y) for y in x] for x in frame["guests"]]
            p = _unit(found) if len(found) else np.zeros((0, 1))
            p = p[spread_pivots(p, 3 * reach)] if len(found) else p
            if len(p) < 2:
                return frame[keep].assign(cell=frame["cell"] + ".0", homes=[x + [0] for x in base[0]], guests=[x + [[]] for x in base[1]], whole=True)
            x = _unit(frame)
            home, guests = nearest_cells(x, p, min(1.0, slack / x.shape[1] ** 0.5) * np.sin(reach / 2), overlap)
            to = [[int(h), *g] for h, g in zip(home, guests, strict=True)]
            r = np.repeat(np.arange(len(x)), [len(t) for t in to])
            made = frame.iloc[r][keep].assign(cell=[f"{c}.{t}" for c, own in zip(frame["cell"], to, strict=True) for t in own], whole=False)
            return made.assign(homes=[base[0][i] + [to[i][0]] for i in r.tolist()], guests=[base[1][i] + [guests[i]] for i in r.tolist()])

        schema = f"space string, cell string, node binary, n long, v {kind}, homes array<int>, guests array<array<int>>, whole boolean"
        rows = table(map_groups(members.unionByName(pivots).drop("m", "whole"), ["space", "cell", "part"], assign, schema), f"vec-level-{level + 1}")
    return leaves.union(rows.drop("whole"))


def counted_here(cell: str, homes: np.ndarray, guests: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of members ``a, b`` of ``cell`` count in it, so that each counts in one cell.

    At each level that is the home of both, or the home of one where the other is a guest; of two such
    cells the first. ``guests`` has a matrix of cells a level, filled up with -1.
    """
    ok = np.ones(len(a), bool)
    for level, own in enumerate(int(c) for c in cell.split(".")[1:]):
        x, y, g = homes[a, level], homes[b, level], guests[level]
        first = lambda i, h: (h < own) & (g[i] == h[:, None]).any(1)  # noqa: B023, E731
        ok &= np.where(x == own, (y == own) | ~first(a, y), (y == own) & ~first(b, x))
    return ok


def near_links(df: DataFrame, threshold: float = 0.98, shard_rows: int = 2000, fan: int = 1024, overlap: int = 1, slack: float = 3.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows ``(id, n_links, component_id, kept)``: vectors of equal labels linked by a cosine of ``threshold`` or more.

    Null labels, null or zero vectors, and vectors with null or non-finite components link with
    nothing. Vectors of another length than the other are never linked with it. Equal vectors of a
    label are one node with a count. Rows that repeat an id count as rows and share the smallest
    component and the largest number of links; rows without an id are left out. An empty table gives
    no rows; extra columns are ignored.

    ``cells_of`` makes overlapping shards. One of more than ``shard_rows`` (a tight cluster) is cut into
    blocks of half as many, and each pair of blocks has a graph of its own, so a label or a cluster with a third of
    all rows stays bounded. A graph is built and searched in one task; a link counts in one shard only
    (``counted_here``). Links are found by the search, so some may be missed
    (``audit_recall`` measures it), and each is verified in double precision. A graph returns counts and a
    spanning forest, no pairs.
    """
    kind = df.schema[id_col].dataType.simpleString()
    v = F.col(vector_col) if df.schema[vector_col].dataType.simpleString() == "array<float>" else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).filter(F.col("id").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("v", lambda x: x != 0)
    good = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & some)
    # A node is the digest of a label and a vector, so equal vectors of a label are one.
    key = F.unhex(F.md5(F.concat_ws(",", F.concat_ws("|", F.length("label"), "label"), F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")))))
    good = good.withColumn("node", key)
    classes = table(good.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")), "vec-classes")
    reach = float(np.arccos(np.clip(threshold, -1, 1)))
    reps = classes.select(F.concat_ws("|", "label", F.size("v").cast("string")).alias("space"), "node", "n", "v")
    each = cells_of(reps, reach, shard_rows, fan, overlap, slack)
    large = F.broadcast(table(each.groupBy("space", "cell").agg(F.count("*").alias("m")).filter(F.col("m") > shard_rows), "vec-large"))
    blocks = each.join(large, ["space", "cell"], "left").withColumn("blocks", F.coalesce(F.ceil(2 * F.col("m") / shard_rows), F.lit(1)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("space", "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "n", "v", "homes", "guests")

    def search(frame: pd.DataFrame) -> pd.DataFrame | None:
        if len(frame) < 2:
            return None
        frame = frame.sort_values("node", ignore_index=True)
        x, nodes = _unit(frame), frame["node"].to_numpy()
        small = x.astype(np.float32)
        links, starts = build_graph(small)
        cell, homes = frame["cell"].iloc[0], np.array([list(h) for h in frame["homes"]], np.int32).reshape(len(x), -1)
        guests = []
        for level in range(homes.shape[1]):
            at = [g[level] for g in frame["guests"]]
            guests.append(np.full((len(x), max(1, *map(len, at))), -1, np.int32))
            for i, g in enumerate(at):
                guests[-1][i, : len(g)] = g
        queries = np.flatnonzero(homes[:, -1] == int(cell.split(".")[-1])) if homes.shape[1] else np.arange(len(x))
        own, p, q = frame["own"].to_numpy(), int(frame["p"].iloc[0]), int(frame["q"].iloc[0])
        n, total, low, seen = frame["n"].to_numpy(np.int64), np.zeros(len(x), np.int64), np.arange(len(x)), []
        for lo in range(0, len(queries), 256):
            part = queries[lo : lo + 256]
            sims = walk(small, links, part, starts, 24, float(np.cos(1.4 * reach)))
            i, b = np.nonzero(sims >= threshold - 1e-4)
            a = part[i]
            seen.append((np.minimum(a, b) * len(x) + np.maximum(a, b))[a != b])
        a, b = np.divmod(np.unique(np.concatenate(seen)), len(x)) if seen else np.zeros((2, 0), np.int64)  # found from either end
        if p != q:
            ok = own[a] != own[b]
            a, b = a[ok], b[ok]
        ok = np.zeros(len(a), bool)
        for k in range(0, len(a), 100_000):
            i, j = a[k : k + 100_000], b[k : k + 100_000]
            ok[k : k + 100_000] = counted_here(cell, homes, guests, i, j) & (np.einsum("ij,ij->i", x[i], x[j]) >= threshold)
        a, b = a[ok], b[ok]
        np.add.at(total, a, n[b])
        np.add.at(total, b, n[a])
        if not len(a):
            return None
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = np.minimum(new, new[new])
            if (new == low).all():
                break
            low = new
        hit = total > 0
        return pd.DataFrame({"node": nodes[hit], "links": total[hit], "low": nodes[low[hit]]})

    found = table(map_groups(cells, ["space", "cell", "p", "q"], search, "node binary, links long, low binary"), "vec-links")
    linked = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "vec-components").join(classes.select("node", "rep"), "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    links = linked.join(least, "component").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node").select("node", "least", "links")
    known = classes.select("node", "rep", "n").join(links, "node", "left").select("node", F.coalesce("least", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    per_row = good.select("id", "node").join(known, "node").groupBy("id").agg(F.min("component").alias("component"), F.max("n_links").alias("n_links"))
    out = rows.select("id").join(per_row, "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast(kind).alias("component_id"), (F.col("id") == component).alias("kept"))


def audit_recall(df: DataFrame, every: int = 50, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", result: DataFrame | None = None) -> DataFrame:
    """Links found over links that exist, for the query vectors whose id is divisible by ``every``.

    Brute force in blocks: the queries of a label meet all vectors of that label. One row:
    ``(queries, wanted, found, recall)``.
    """
    cosine = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter("label is not null and v is not null")
    rows = rows.withColumn("norm", F.sqrt(cosine("v", "v"))).filter("norm > 0 and norm < double('infinity')")
    queries = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("q"), "label", F.col("v").alias("w"), F.col("norm").alias("own"))
    pairs = queries.join(rows, "label").filter(F.col("q") != F.col("id")).filter(cosine("v", "w") >= threshold * F.col("norm") * F.col("own"))
    wanted = queries.select("q").join(pairs.groupBy("q").agg(F.count("*").alias("wanted")), "q", "left").fillna(0)
    got = (near_links(df, threshold, id_col=id_col, vector_col=vector_col, label_col=label_col) if result is None else result).select(F.col("id").alias("q"), "n_links")
    return wanted.join(got, "q").agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), F.sum(F.least("wanted", "n_links")).alias("found")).withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(1.0))
