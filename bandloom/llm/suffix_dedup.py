"""Suffix-array dedup: repeated byte strings found by hash-compared suffix sorting of sampled blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bytes whose hash picks a window's anchor, and bytes that are sketched at once.
GRAM, CHUNK = 32, 1 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
ROWS = "kind byte, kg long, id long, h long, start int, m int, off int"
PAIR = ", pid long, ph long, ps int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Prefixes:
    """Prefix polynomial hashes of a byte array: any substring's hash in one step."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(10, len(data).bit_length())
        self.up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def anchors(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: ``(first window, windows, anchor - first, gram hash, block hash)``.

    ``data`` holds texts up to ``ends``. A window's anchor is its gram of least hash, the leftmost of
    equal ones, so equal windows have equal grams at the same place; a run's block is all its bytes.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    n = len(data) - window + 1
    if n < 1:
        return none
    x = data.astype(np.uint64) + np.uint64(1)
    step, power = 1, int(_BASE)
    while step < GRAM:
        x = x[:-step] * np.uint64(power) + x[step:]
        power = power * power % (1 << 64)
        step *= 2
    x = _mix(x)
    bits = max(20, len(data).bit_length())
    low = np.uint64((1 << bits) - 1)
    key = (x & ~low) | np.arange(len(x), dtype=np.uint64)
    cover, span = 1, window - GRAM + 1
    while cover < span:
        c = min(cover, span - cover)
        key = np.minimum(key[:-c], key[c:])
        cover += c
    at = (key & low).astype(np.int64)[:n]
    ok = np.ones(n + window, bool)
    starts = np.concatenate([[0], ends[:-1]])
    bad = np.maximum(starts, ends - window + 1)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, bad, 1)
    np.add.at(edge, ends, -1)
    ok = np.cumsum(edge[:-1])[:n] == 0
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    last = np.ones(n, bool)
    last[:-1] = new[1:] | ~ok[1:]
    first, final = np.flatnonzero(new & ok), np.flatnonzero(last & ok)
    m, off = final - first + 1, at[first] - first
    block = _mix(Prefixes(data).hash(first, m + window - 1) + (m * 256 + off).astype(np.uint64))
    return first, m, off, x[at[first]], block


def _batch(kind, kg, doc, start, m, off, pair=None, **more) -> pa.RecordBatch:
    """Rows of ``ROWS`` as an Arrow batch, with ``PAIR`` if given; ``doc`` and the pair have id and text hash."""
    n = len(doc[0])
    full = lambda v, t: pa.array(np.broadcast_to(np.asarray(v, t), n))
    cols = [full(kind, np.int8), full(kg, np.int64), *[full(x, np.int64) for x in doc], *[full(x, np.int32) for x in (start, m, off)]]
    names = ["kind", "kg", "id", "h", "start", "m", "off"]
    if pair is not None:
        cols += [full(pair[0], np.int64), full(pair[1], np.int64), full(pair[2], np.int32)]
        names += ["pid", "ph", "ps"]
    return pa.RecordBatch.from_arrays([*cols, *more.values()], names=[*names, *more])


def _equals(cols: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by gram, block hash, id, text hash, start: firsts of equal blocks, and the others but for repeated rows."""
    kg, bh, *place = cols
    new = np.ones(len(kg), bool)
    new[1:] = (kg[1:] != kg[:-1]) | (bh[1:] != bh[:-1])
    other = np.zeros(len(kg), bool)
    other[1:] = ~new[1:] & np.logical_or.reduce([x[1:] != x[:-1] for x in place])
    return new, other


def _sketch(window: int):
    """Task: anchors (kind 0) of all texts; of equal hashes in one stretch only the first, the others with the one before (kind 1)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, h, start, m, off, kg, bh = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((start, h, ids, bh, kg))
        ids, h, start, m, off, kg, bh = (c[order] for c in (ids, h, start, m, off, kg, bh))
        new, dup = _equals((kg, bh, ids, h, start))
        yield _batch(0, kg[new].view(np.int64), (ids[new], h[new]), start[new], m[new], off[new], (0, 0, 0), bh=pa.array(bh[new].view(np.int64)))
        if dup.any():
            was = np.flatnonzero(dup) - 1
            yield _batch(1, 0, (ids[dup], h[dup]), start[dup], m[dup], 0, (ids[was], h[was], start[was]), bh=pa.array(np.zeros(len(was), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw, owner, base, size = [], [], [], 0

            def sketch() -> tuple[np.ndarray, ...]:
                ends = np.cumsum([len(x) for x in raw])
                first, m, off, kg, bh = anchors(np.frombuffer(b"".join(raw), np.uint8), ends, window)
                part = np.searchsorted(ends, first, side="right")
                start, doc = first - np.concatenate([[0], ends[:-1]])[part] + np.array(base, np.int64)[part], np.array(owner, np.int64)[part]
                return ids[doc], hashes[doc], start, m, off, kg, bh

            for i, text in enumerate(batch.column(2).to_pylist()):
                data = (text or "").encode()
                for at in range(0, max(1, len(data) - window + 1), CHUNK):  # a long text in overlapping parts
                    part = data[at : at + CHUNK + window - 1]
                    if len(part) < window:
                        continue
                    raw.append(part)
                    owner.append(i)
                    base.append(at)
                    size += len(part)
                    if size >= CHUNK:
                        held.append(sketch())
                        n += len(held[-1][0])
                        raw, owner, base, size = [], [], [], 0
                        if n > 200_000:
                            yield from flush(held)
                            held, n = [], 0
            if raw:
                held.append(sketch())
                n += len(held[-1][0])
        if held:
            yield from flush(held)

    return run


def _repeats(window: int, hot: int):
    """Task over rows sorted by gram, block hash and place: equal hashes in pairs (1); differing blocks of one gram go on (2, or 3 if more than ``hot``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def work(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            kg, bh, ids, h, start, m, off = cols
            new, later = _equals((kg, bh, ids, h, start))
            if later.any():
                was = np.flatnonzero(later) - 1
                yield _batch(1, 0, (ids[later], h[later]), start[later], m[later], 0, (ids[was], h[was], start[was]))
            kg, ids, h, start, m, off = (c[new] for c in (kg, ids, h, start, m, off))
            heads = np.flatnonzero(np.concatenate([[True], kg[1:] != kg[:-1]]))
            size = np.diff(np.append(heads, len(kg)))
            size = np.repeat(size, size)
            for kind, some in ((2, (size > 1) & (size <= hot)), (3, size > hot)):
                if some.any():
                    yield _batch(kind, kg[some], (ids[some], h[some]), start[some], m[some], off[some], (0, 0, 0))

        for batch in batches:
            c = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            done = c["kind"] == 1
            if done.any():
                yield _batch(1, 0, (c["id"][done], c["h"][done]), c["start"][done], c["m"][done], 0, tuple(c[k][done] for k in ("pid", "ph", "ps")))
            cols = [c[k][~done] for k in ("kg", "bh", "id", "h", "start", "m", "off")]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last gram may go on in the next batch
            carry = [x[cut:] for x in cols]
            if cut:
                yield from work([x[:cut] for x in cols])
        if carry is not None:
            yield from work(carry)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches without rows that repeat an id and text hash (the first two columns) of this task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        new = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new.append(key not in seen)
            seen.add(key)
        yield batch if all(new) else batch.filter(pa.array(new))


def _copies(window: int):
    """Task over texts with their pairs: the bytes of each maximal stretch that should also lie in another text, for that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in _once(batches):
            lists = batch.column(2)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, m, pid, ph, ps = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
            order = np.lexsort((start, start - ps, ph, pid, doc))
            doc, start, m, pid, ph, ps = (x[order] for x in (doc, start, m, pid, ph, ps))
            end = start + m + window - 1
            head = np.ones(len(doc), bool)
            # Pairs of one text pair and shift go together where they touch; ends grow with starts as blocks are runs.
            head[1:] = (doc[1:] != doc[:-1]) | (pid[1:] != pid[:-1]) | (ph[1:] != ph[:-1]) | (start[1:] - ps[1:] != start[:-1] - ps[:-1]) | (start[1:] > end[:-1])
            at = np.flatnonzero(head)
            if not len(at):
                continue
            end, doc, start, pid, ph, ps = np.maximum.reduceat(end, at), doc[at], start[at], pid[at], ph[at], ps[at]
            texts = [unzip.decompress(x) for x in batch.column(3).to_pylist()]
            part = [texts[d][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)]
            ids, h = (batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
            for lo in range(0, len(at), 20_000):
                own = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays([*[pa.array(x[own].astype(np.int64)) for x in (pid, ph, ids, h)], pa.array(start[own].astype(np.int32)), pa.array(ps[own].astype(np.int32)), pa.array(part[own], pa.binary())], names=["pid", "ph", "id", "h", "start", "ps", "part"])

    return run


def _verify(window: int):
    """Task over texts with the stretches that should lie in them: those that do, byte by byte, are covered (1).

    A stretch that doesn't (equal hashes of different blocks) goes on as blocks, and so does its place here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in _once(batches):
            good, bad = [], []
            for pid, ph, parts, packed in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                text = unzip.decompress(packed)
                for x in parts:
                    own, part = (x["id"], x["h"]), x["part"]
                    if text[x["ps"] : x["ps"] + len(part)] == part:
                        good.append((*own, x["start"], len(part)))
                    else:
                        bad += [((pid, ph), x["ps"], text[x["ps"] : x["ps"] + len(part)]), (own, x["start"], part)]
            if good:
                ids, h, start, n = zip(*good, strict=True)
                yield _batch(1, 0, (ids, h), start, n, 0, block=pa.nulls(len(ids), pa.binary()))
            for doc, base, data in bad:
                first, m, off, kg, _ = anchors(np.frombuffer(data, np.uint8), np.array([len(data)]), window)
                for f, k, o, g in zip(first.tolist(), m.tolist(), off.tolist(), kg.view(np.int64).tolist(), strict=True):
                    block = data[f : f + k + window - 1]
                    yield _batch(2, g, ([doc[0]], [doc[1]]), base + f, k, o, block=pa.array([block], pa.binary()))
                    for j in range(k):  # as single windows too, for a gram that is hot
                        w = block[j : j + window]
                        yield _batch(2, _content(o - j, w), ([doc[0]], [doc[1]]), base + f + j, 1, o - j, block=pa.array([w], pa.binary()))

    return run


def _content(off: int, window: bytes) -> int:
    """Key of a single window with its anchor at ``off``."""
    return int.from_bytes(hashlib.blake2b(b"%d:" % off + window, digest_size=8).digest(), "little", signed=True)


def suffix_sort(prefix: Prefixes, data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes ``at`` (to ``depth`` bytes) within ascending groups, by mergesort.

    Two suffixes are compared in logarithmic time: equal hashes of ``depth`` bytes are equal, else a
    binary search over prefix hashes finds their common extension, and the next byte decides. All
    merges of a level go side by side: a suffix moves by its rank in the sibling run.
    """
    order = np.arange(len(at))
    if not len(at):
        return order
    whole = prefix.hash(at, depth)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(heads, len(at)))
    head, size = np.repeat(heads, size), np.repeat(size, size)
    place = np.arange(len(at)) - head

    def less(x: np.ndarray, y: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; ``tie`` where they are equal."""
        out = tie.copy()
        diff = np.flatnonzero(whole[x] != whole[y])
        if len(diff):
            a, b = at[x[diff]], at[y[diff]]
            lo, hi = np.zeros(len(a), np.int64), np.full(len(a), depth - 1)
            while (lo < hi).any():  # longest common prefix
                mid = (lo + hi + 1) // 2
                same = prefix.hash(a, mid) == prefix.hash(b, mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            out[diff] = data[a + lo] < data[b + lo]
        return out

    run = 1
    while True:
        active = np.flatnonzero(size > run)
        if not len(active):
            return order
        p, h, n = place[active], head[active], size[active]
        own = p // run
        sibling = (own ^ 1) * run
        length = np.clip(n - sibling, 0, run)
        lo, hi, tie = np.zeros(len(active), np.int64), length.copy(), own % 2 == 1  # the left one first
        item = order[h + p]
        while (go := np.flatnonzero(lo < hi)).size:
            mid = (lo[go] + hi[go]) // 2
            other = order[h[go] + sibling[go] + mid]
            before = less(other, item[go], tie[go])
            lo[go] = np.where(before, mid + 1, lo[go])
            hi[go] = np.where(before, hi[go], mid)
        new = order.copy()
        new[h + (own & ~1) * run + p % run + lo] = item
        order = new
        run *= 2


def covered_windows(kg: np.ndarray, ids: np.ndarray, start: np.ndarray, m: np.ndarray, off: np.ndarray, blocks: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches ``(id, start, length)`` covered by windows that an earlier block of their gram also has.

    ``ids`` are in the order of the texts.
    """
    data = np.frombuffer(b"".join(blocks), np.uint8)
    base = np.cumsum([0, *[len(b) for b in blocks[:-1]]])
    owner = np.repeat(np.arange(len(m)), m)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
    at, place = base[owner] + nth, off[owner] - nth  # place: the anchor's, within the window
    prefix = Prefixes(data)
    with np.errstate(over="ignore"):
        key = _mix(kg.view(np.uint64)[owner] + place.astype(np.uint64) * _BASE)
        tag = _mix(key ^ prefix.hash(at, window))
    _, back, seen = np.unique(tag, return_inverse=True, return_counts=True)
    some = np.flatnonzero(seen[back] > 1)  # others equal no window
    some = some[np.argsort(key[some], kind="stable")]
    order = some[suffix_sort(prefix, data, at[some], key[some], window)]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    views = np.lib.stride_tricks.sliding_window_view(data, window)
    same = np.zeros(len(order), bool)
    for lo in range(0, len(order), 20_000):  # verification: the bytes themselves
        x, y = order[lo : lo + 20_000], order[lo + 1 : lo + 20_001]
        x = x[: len(y)]
        same[lo + 1 : lo + 1 + len(y)] = (key[x] == key[y]) & (views[at[x]] == views[at[y]]).all(1)
    hashed = np.zeros(len(order), bool)
    hashed[1:] = tag[order[1:]] == tag[order[:-1]]
    if (hashed & ~same).any():  # a collision: sort this chunk by its bytes
        rows = np.concatenate([key[some].astype(">u8").view(np.uint8).reshape(-1, 8), views[at[some]]], axis=1)
        order = some[np.lexsort(rows.T[::-1])]
        same[1:] = (key[order[1:]] == key[order[:-1]]) & (views[at[order[1:]]] == views[at[order[:-1]]]).all(1)
    run = np.cumsum(~same) - 1
    doc, pos = ids[owner[order]], start[owner[order]] + nth[order]
    by = np.lexsort((pos, doc, run))
    later = np.zeros(len(order), bool)
    later[1:] = (run[by][1:] == run[by][:-1]) & ((doc[by][1:] != doc[by][:-1]) | (pos[by][1:] != pos[by][:-1]))
    # A copy of the first occurrence itself (repeated rows) is no later one.
    first = np.repeat(np.flatnonzero(np.concatenate([[True], run[by][1:] != run[by][:-1]])), np.bincount(run))
    later &= (doc[by] != doc[by][first]) | (pos[by] != pos[by][first])
    doc, pos = doc[by][later], pos[by][later]
    by = np.lexsort((pos, doc))
    doc, pos = doc[by], pos[by]
    if not len(doc):
        return doc, pos, pos
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)])
    tail = np.concatenate([head[1:], [True]])
    return doc[head], pos[head], pos[tail] + window - pos[head]


def _fetch(window: int):
    """Task: bytes of the blocks of a text; a hot gram's blocks go on as single windows, dealt by their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        held: list[tuple] = []
        windows: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        covered: list[tuple[int, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                kg, ids, h, start, m, off, raw = zip(*held, strict=True)
                yield _batch(2, kg, (ids, h), start, m, off, block=pa.array(raw, pa.binary()))
            if covered:
                ids, h, start = zip(*covered, strict=True)
                yield _batch(1, 0, (ids, h), start, window, 0, block=pa.nulls(len(ids), pa.binary()))
            held.clear()
            covered.clear()

        def flush_windows() -> Iterator[pa.RecordBatch]:
            if windows:
                keys, (ids, h, start) = [_content(*w) for w in windows], zip(*windows.values(), strict=True)
                yield _batch(2, keys, (ids, h), start, 1, [o for o, _ in windows], block=pa.array([w for _, w in windows], pa.binary()))
                windows.clear()

        for batch in _once(batches):
            for key, h, blocks, packed in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                text = unzip.decompress(packed)
                for b in blocks:
                    start, m, off = b["start"], b["m"], b["off"]
                    if b["kind"] == 2:
                        held.append((b["kg"], key, h, start, m, off, text[start : start + m + window - 1]))
                        continue
                    for j in range(m):
                        at = (off - j, text[start + j : start + j + window])
                        was, now = windows.get(at), (key, h, start + j)
                        if was is None:
                            windows[at] = now
                        elif was != now:
                            windows[at] = min(was, now)
                            covered.append(max(was, now))
                if len(held) + len(covered) > 5000:
                    yield from flush()
                if len(windows) > 100_000:
                    yield from flush_windows()
        yield from flush()
        yield from flush_windows()

    return run


def _resolve(window: int, most: int = 4096):
    """Task over blocks sorted by gram: covered stretches, some thousand blocks at once, grams kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            kg, ids, h, start, m, off = (t.column(c).to_numpy().astype(np.int64) for c in ("kg", "id", "h", "start", "m", "off"))
            docs, doc = np.unique(np.stack([ids, h], 1), axis=0, return_inverse=True)
            doc, pos, length = covered_windows(kg, doc.reshape(-1), start, m, off, t.column("block").to_pylist(), window)
            if len(doc):
                yield _batch(1, 0, docs[doc].T, pos, length, 0)

        held: pa.Table | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                t = pa.Table.from_batches([batch.slice(lo, most)])
                done = pa.compute.equal(t.column("kind"), 1)
                got = t.filter(done)
                if got.num_rows:
                    yield _batch(1, 0, tuple(got.column(c).to_numpy() for c in ("id", "h")), *(got.column(c).to_numpy() for c in ("start", "m")), 0)
                t = t.filter(pa.compute.invert(done))
                if held is not None:
                    t = pa.concat_tables([held, t])
                if not t.num_rows:
                    continue
                kg = t.column("kg").to_numpy()
                cut = int(np.searchsorted(kg, kg[-1]))
                held = t.slice(cut)
                if cut:
                    yield from work(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield from work(held)

    return run


def _cut(with_kept: bool):
    """Task: merge a text's covered stretches and digest what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for key, packed, spans in zip(batch.column(0), *[batch.column(i).to_pylist() for i in (1, 2)], strict=True):
                text, merged = unzip.decompress(packed), []
                for s in sorted((x["start"], min(len(text), x["start"] + x["m"])) for x in spans or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                edges = [0, *[e for s in merged for e in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (key.as_py(), len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept, merged) if with_kept else row)
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary(), pa.list_(pa.list_(pa.int32()))] * with_kept
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_kept
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts as compressed UTF-8, for the shuffles by id."""
    import zstandard

    for batch in batches:
        zip_ = zstandard.ZstdCompressor(level=1)
        packed = [zip_.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "h", "packed"])


def suffix_dedup(df: DataFrame, window: int = 100, hot: int = 512, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Remove each byte that lies in a string of ``window`` bytes which also starts earlier.

    Earlier means in a smaller id, or in the same text before; overlapping occurrences count, and
    strings are judged on the input. Texts are UTF-8 bytes, null is empty; matches never cross
    texts; texts shorter than the window stay whole. Returns ``(id, n_bytes, n_removed, n_spans,
    kept_sha256[, kept binary, spans])``, a row for each row. Ids are integers; rows without an id
    stay whole. Texts that repeat an id are texts of their own, in the order of a hash; rows that
    repeat both id and text are one text and share its cuts. An empty table gives no rows. Extra
    columns are ignored.

    Every window has an anchor, the gram of least hash in it, so equal windows meet in the group of
    their gram. Runs of windows with one anchor are blocks (some three in a hundred bytes). Blocks with
    equal prefix hashes are chained, each to the one before it by place; stretches of a text that are
    chained to one other text go there, once, and are covered if they lie there byte by byte. So a
    group of thousands of copies is compared neighbour by neighbour. Where a gram has several blocks
    that differ (or a chain that didn't hold), the suffixes of their windows are sorted by
    ``suffix_sort``, equal neighbours are verified byte by byte, and all but the first of a run are
    covered. A gram with more than ``hot`` different blocks goes on as single windows dealt by
    content, combined before the shuffle, so no group is unbounded. No byte goes by a hash alone.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    found = docs.filter(F.col("id").isNotNull()).mapInArrow(_sketch(window), ROWS + PAIR + ", bh long")
    spread = F.when(F.col("kind") == 1, F.xxhash64("id", "h")).otherwise(F.col("kg"))
    dealt = found.withColumn("key", spread).repartition("key").sortWithinPartitions("kg", "bh", "id", "h", "start").drop("key")
    seen = table(dealt.mapInArrow(_repeats(window, hot), ROWS + PAIR), "suffix-blocks")
    packed, place = docs.mapInArrow(_pack, "id long, h long, packed binary"), ["id", "h"]
    pairs = seen.filter("kind = 1").groupBy(*place).agg(F.collect_list(F.struct("start", "m", "pid", "ph", "ps")).alias("pairs"))
    copies = pairs.join(packed, place).select(*place, "pairs", "packed").mapInArrow(_copies(window), "pid long, ph long, id long, h long, start int, ps int, part binary")
    asked = copies.groupBy(F.col("pid").alias("id"), F.col("ph").alias("h")).agg(F.collect_list(F.struct("id", "h", "start", "ps", "part")).alias("parts"))
    checked = table(asked.join(packed, place).select(*place, "parts", "packed").mapInArrow(_verify(window), ROWS + ", block binary"), "suffix-copies")
    open_ = seen.filter("kind > 1").groupBy(*place).agg(F.collect_list(F.struct("kind", "kg", "start", "m", "off")).alias("blocks"))
    fetched = open_.join(packed, place).select(*place, "blocks", "packed").mapInArrow(_fetch(window), ROWS + ", block binary").union(checked.filter("kind = 2"))
    sorted_ = fetched.withColumn("key", spread).repartition("key").sortWithinPartitions("kg").drop("key")
    more = table(sorted_.mapInArrow(_resolve(window), ROWS), "suffix-covered")
    covered = checked.filter("kind = 1").select(*place, "start", "m").union(more.select(*place, "start", "m"))
    spans = covered.groupBy(*place).agg(F.collect_list(F.struct("start", "m")).alias("spans"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<int>>" * with_kept
    return packed.join(spans, place, "left").select("id", "packed", "spans").mapInArrow(_cut(with_kept), schema)
