"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, connected_components, give_back, map_groups, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_plan(threshold: float, recall: float, hashes: int = 160) -> tuple[int, int]:
    """``(bands, rows)``: the most rows a band for which pairs at the threshold meet with ``recall``."""
    for rows in range(hashes, 0, -1):
        need = np.log1p(-recall) / np.log1p(-(threshold**rows)) if threshold**rows < 1 else 1
        if (bands := int(np.ceil(need))) * rows <= hashes:
            return bands, rows
    raise ValueError("the recall needs more hashes")


class _Words(dict):
    """64-bit hash of a word, kept for a while."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def shingles(text: str | None, known: _Words, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; of all words if there are fewer."""
    got = [known[w] for w in _WORD.findall(text or "")]
    if not got:
        return np.zeros(0, np.uint64)
    h = np.array(got, np.uint64)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray, odd: np.ndarray, add: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of MinHash values."""
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    folded = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    for lo in range(0, len(folded), 2048):
        part = folded[lo : lo + 2048]
        x = odd[:, None] * part[None, :] + add[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(1), out=low)
    out = np.zeros(bands, np.uint64)
    for k in range(rows):
        out = (out ^ low.reshape(bands, rows)[:, k]) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def jaccard_links(df: DataFrame, **options) -> DataFrame:
    """Rows ``(id, class_id, n_links)`` of ``text_classes``, whose parameters and results for odd input hold."""
    return text_classes(df, **options).select("id", "class.id", "n_links").toDF("id", "class_id", "n_links")


def text_classes(df: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, hashes: int = 160, block: int = 192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, h, class, n_links)``: documents linked by a Jaccard similarity of word n-grams of ``threshold`` or more.

    ``h`` is a hash of the text, ``class`` the smallest ``(id, h)`` reachable by links, ``n_links`` the
    number of other rows linked directly. Words are split at ASCII white space and kept as they are. Texts of fewer than ``n``
    words have one n-gram of all their words; null texts and texts without words link with nothing,
    not even with each other, and are classes of their own. Ties and repeated rows: rows of equal
    n-gram sets are one node with a count, so copies are never paired. A row without an id has no
    class and is left out; rows that repeat an id are rows like others, each with its own text. An
    empty table gives no rows; extra columns are ignored.

    MinHash bands (``band_plan``: at the threshold a pair meets with ``recall``) are shuffled on their
    hashes; each bucket becomes a star around its smallest set, and components of stars hold all
    candidates. A component is cut into blocks of about ``block`` documents, and each pair of blocks
    is compared by itself on full n-gram sets. A block pair returns link counts and a spanning
    forest of its links, never the pairs, so a group of thousands of near copies makes few rows,
    fits in memory, and is spread over tasks.
    """
    bands, rows = band_plan(threshold, recall, hashes)
    bound = Fraction(str(threshold))
    kind = df.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, known = np.random.default_rng(20_240), _Words()
        odd, add = rng.integers(0, 2**31, bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, bands * rows).astype(np.uint32)
        for batch in batches:
            for lo, hi in byte_slices(batch.column(2), 2_000_000):
                part = batch.slice(lo, hi - lo)
                sets, sigs = [], []
                for t in part.column(2).to_pylist():
                    grams = shingles(t, known, n)
                    sets.append(hashlib.md5(grams.tobytes()).digest() if len(grams) else None)
                    sigs.append(signature(grams, odd, add, bands, rows) if len(grams) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "h", "set", "bands"])
        known.clear()
        give_back()

    # A text is known by its id and hash, a node by the digest of its n-gram set.
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    marks = table(docs.mapInArrow(sketch, f"id {kind}, h long, set binary, bands array<long>"), "ngram-bands")
    sets = table(marks.filter("set is not null").groupBy("set").agg(F.min(F.struct("id", "h")).alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands")), "ngram-sets")
    buckets = sets.select("set", F.posexplode("bands").alias("band", "hash"))
    stars = buckets.groupBy("band", "hash").agg(F.min("set").alias("b"), F.count("*").alias("m")).filter("m > 1").select("band", "hash", "b")
    edges = buckets.join(stars, ["band", "hash"]).select(F.col("set").alias("a"), "b").filter("a <> b").distinct()
    groups = connected_components(edges, "ngram-candidates")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = groups.join(sizes, "component").join(sets.select(F.col("set").alias("node"), "rep", "n"), "node")
    placed = placed.select("node", "rep.id", "rep.h", "n", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    texts = docs.join(placed, ["id", "h"])
    sent = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "text", "n", "component", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame | None:
        p, q = int(frame["p"].iloc[0]), int(frame["q"].iloc[0])
        known = _Words()
        frame = frame.drop_duplicates("node").sort_values("node", ignore_index=True)  # rows may repeat an id and text
        left, right = ((frame.index[frame["own"] == x]).to_numpy() for x in (p, q))
        if not len(left) or not len(right) or len(frame) < 2:
            return None
        grams = [shingles(t, known, n) for t in frame["text"]]
        counts = np.array([len(g) for g in grams])
        shared = overlaps([grams[i] for i in left], [grams[i] for i in right])
        union = counts[left][:, None] + counts[right][None, :] - shared
        link = shared * bound.denominator >= union * bound.numerator
        if p == q:
            np.fill_diagonal(link, False)
        weight = frame["n"].to_numpy(np.int64)
        own = np.zeros(len(frame), np.int64)
        own[left] += link @ weight[right]
        if p != q:
            own[right] += weight[left] @ link
        lowest = np.arange(len(frame))
        while True:  # smallest reachable row; link has at most block x block cells
            new = lowest.copy()
            a = np.where(link, lowest[right][None, :], len(frame)).min(1)
            new[left] = np.minimum(new[left], a)
            b = np.where(link, lowest[left][:, None], len(frame)).min(0)
            new[right] = np.minimum(new[right], b)
            new = np.minimum(new, new[new])
            if (new == lowest).all():
                break
            lowest = new
        hit = own > 0
        nodes = frame["node"].to_numpy()
        return pd.DataFrame({"node": nodes[hit], "links": own[hit], "low": nodes[lowest[hit]]})

    found = table(map_groups(sent, ["component", "p", "q"], compare, "node binary, links long, low binary"), "ngram-links")
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "ngram-classes")
    linked = classes.join(sets.select(F.col("set").alias("node"), "rep"), "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("class"))
    links = linked.join(least, "component").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node").select(F.col("node").alias("set"), "class", "links")
    known = sets.join(links, "set", "left").select("set", F.coalesce("class", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return marks.select("id", "h", "set").join(known, "set", "left").select("id", "h", F.coalesce("class", F.struct("id", "h")).alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets: a product of incidence matrices.

    Only n-grams on both sides count; columns are taken some thousand at a time.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    ra, rb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    if not len(both):
        return out

    def places(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, x), len(both) - 1)
        ok = both[at] == x
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], r[ok][order]

    (ca, ra), (cb, rb) = places(a, ra), places(b, rb)
    step = 4096
    for lo in range(0, len(both), step):
        i, j = np.searchsorted(ca, [lo, lo + step]), np.searchsorted(cb, [lo, lo + step])
        width = min(step, len(both) - lo)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[ra[i[0] : i[1]], ca[i[0] : i[1]] - lo] = 1
        y[rb[j[0] : j[1]], cb[j[0] : j[1]] - lo] = 1
        use = np.flatnonzero(x.any(1)), np.flatnonzero(y.any(1))
        out[np.ix_(*use)] += (x[use[0]] @ y[use[1]].T).astype(np.int64)
    return out


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``df`` whose id and text are the smallest of their class; rows without an id stay.

    Rows that repeat both id and text are one document and stay or go together; of different texts
    under one id each is judged by itself.
    """
    found = text_classes(df, id_col=id_col, text_col=text_col, **options)
    gone = found.filter(F.struct("id", "h") != F.col("class")).select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    return df.join(gone, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__h")), "left_anti")
