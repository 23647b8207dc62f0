"""Best-fit packing: token pieces into sequences by minimum bin slack."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, give_back, map_groups

#: Bytes of text that are looked up at once; a longer text goes alone.
SLICE = 4_000_000
PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


#: Characters that the vocabulary's pattern keeps apart from letters, without the apostrophe of contractions.
APART = r"[\-.,!?;:|$%&*#()\[\]{}<>=+@~^/\\\"_]*"
#: A chunk of plain lower-case letters below U+0250 within such characters: what stands before, the letters, what stands after.
PLAIN = f"^(?P<a>{APART})(?P<b>[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f]+)(?P<c>{APART})$"


class _Ids:
    """Ids of chunks without ASCII white space; those of their parts are found once and kept for a while.

    A ``PLAIN`` chunk is put together from its parts, since the vocabulary drops case and never joins
    across such a border; so most words are encoded once. All other chunks, and those that hold a
    special token's text, go to the tokenizer as they are. The table is an Arrow array of words and one
    array of ids, some 40 bytes a word; when it has more than ``most`` words, the half that was not
    used for longest goes.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tok, self.most, self.clock = Tokenizer.from_file(path), most, 0
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words, self.pool = pa.array([""], pa.string()), np.zeros(0, np.uint32)
        self.sizes, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def parts(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Distinct parts of the chunks, and for each chunk the places of its three (-1: none)."""
        found = pc.extract_regex(pc.utf8_lower(chunks), PLAIN)
        odd = pc.or_(pc.is_null(found), pc.match_substring(chunks, "\u0130"))
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(chunks, x))
        cols = [pc.if_else(odd, "", pc.struct_field(found, k)) for k in range(3)]
        cols[1] = pc.if_else(odd, chunks, cols[1])
        flat = pa.chunked_array(cols).combine_chunks().dictionary_encode()
        return flat.dictionary, flat.indices.to_numpy().reshape(3, -1)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Encode words that the table doesn't have yet; their places in it."""
        plain = pc.match_substring_regex(words, "^[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f]+$").to_numpy(zero_copy_only=False)
        rest, found, sizes = words.to_pylist(), [], np.zeros(len(words), np.int64)
        line = np.flatnonzero(plain)
        for lo in range(0, len(line), 1000):  # each of these is one word of the vocabulary's pattern
            part = line[lo : lo + 1000]
            got = np.array(self.tok.encode_batch_fast([" ".join([rest[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(part):
                plain[part] = False
                continue
            found.append((part, got))
            sizes[part] = np.diff(ends, prepend=0)
        line = np.flatnonzero(~plain)
        for lo in range(0, len(line), 1000):
            part = line[lo : lo + 1000]
            each = [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast([rest[i] for i in part], add_special_tokens=False)]
            found.append((part, np.concatenate(each)))
            sizes[part] = [len(x) for x in each]
        order = np.concatenate([part for part, _ in found])
        places = np.empty(len(order), np.int64)
        places[order] = len(self.words) + np.arange(len(order))
        self.words = pa.concat_arrays([self.words, words.take(pa.array(order))])
        self.pool = np.concatenate([self.pool, *[ids for _, ids in found]])
        self.sizes = np.concatenate([self.sizes, sizes[order]])
        self.used = np.concatenate([self.used, np.full(len(order), self.clock)])
        return places

    def forget(self) -> None:
        """Keep the half of the table that was used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        keep = np.union1d(keep, [0])  # the empty part
        inside = np.zeros(len(self.sizes), bool)
        inside[keep] = True
        self.pool = self.pool[np.repeat(inside, self.sizes)]
        self.words, self.sizes, self.used = self.words.take(pa.array(keep)), self.sizes[keep], self.used[keep]

    def of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, begin, sizes)``: ids of all distinct chunks in a row, and where those of each lie."""
        self.clock += 1
        if len(self.words) > self.most:
            self.forget()
        words, of = self.parts(chunks)
        found = pc.index_in(words, self.words)
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if found.null_count:
            new = pc.is_null(found)
            at[new.to_numpy(zero_copy_only=False)] = self.learn(words.filter(new))
        self.used[at] = self.clock
        at = at[of]  # three rows: the table's places of each chunk's parts
        begin = np.cumsum(self.sizes) - self.sizes
        each = self.sizes[at.T.reshape(-1)]
        ids = self.pool[runs(begin[at.T.reshape(-1)], each)]
        sizes = each.reshape(-1, 3).sum(1)
        return ids, np.cumsum(sizes) - sizes, sizes


def runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs of the given sizes, one run after the other."""
    upto = np.cumsum(sizes)
    out = np.arange(int(upto[-1]) if len(upto) else 0)
    out += np.repeat(begin - (upto - sizes), sizes)
    return out


_KEPT: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    """This Python worker's table; later tasks of the worker use it again."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = _Ids(path)
    return _KEPT[path]


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows ``(id, piece, start, length, ids_crc32[, ids])``: each text's ids and ``end_id``, cut at ``capacity``.

    The vocabulary drops white space and never joins across it, so ids are found once for each
    distinct chunk between white space and kept in a bounded table. A null text counts as empty: the
    end id alone. Long texts are cut at ``capacity``; each of repeated rows has pieces of its own, so
    ties don't matter; an empty table gives no rows; other columns than the id and the text go,
    so names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages left in this worker
        ids = _ids(tokenizer_path)
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), SLICE):
                yield cut(ids, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))
                pa.default_memory_pool().release_unused()

    def cut(ids: _Ids, key: pa.Array, text: pa.Array) -> pa.RecordBatch:
        # Each distinct chunk is looked up once; the ids are then gathered by position.
        split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_trim_whitespace(text), ""))
        flat = split.flatten().dictionary_encode()
        counts = np.diff(split.offsets.to_numpy())
        pool, begin, sizes = ids.of(flat.dictionary)
        pool = np.append(pool, np.uint32(end_id))
        begin, sizes = np.append(begin, len(pool) - 1), np.append(sizes, 1)
        ends = np.cumsum(counts + 1)
        codes = np.full(int(ends[-1]) if len(ends) else 0, len(sizes) - 1, np.int32)
        inner = np.ones(len(codes), bool)
        inner[ends - 1] = False
        codes[inner] = flat.indices.to_numpy()
        each = sizes[codes]
        upto = np.cumsum(each)
        out = pool[runs(begin[codes], each)]
        stop = upto[ends - 1]
        total = np.diff(stop, prepend=0)
        pieces = -(-total // capacity)
        rows = np.repeat(np.arange(len(key)), pieces)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(capacity, total[rows] - start)
        at = (stop - total)[rows] + start
        crc = [zlib.crc32(out[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        cols = [key.take(pa.array(rows)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols.append(pa.array([out[a : a + n].astype("<i4") for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {PIECE_SCHEMA}" + ", ids array<int>" * with_ids)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    Bit s of ``reach`` says that sum s can be made. Lengths go in from the largest; each is added
    up to as often as it is there; the search ends early once ``room`` itself is reached. The
    earlier bitsets lead back from the best sum to the lengths that make it.
    """
    full = (1 << (room + 1)) - 1
    reach, seen = 1, []
    for x in lengths:
        if x > room:
            continue
        for _ in range(min(counts[x], room // x)):
            new = reach | (reach << x) & full
            if new == reach:
                break
            seen.append((x, reach))
            reach = new
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for x, before in reversed(seen):
        if not before >> at & 1:
            out.append(x)
            at -= x
    return out


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin number and offset for each length; every bin starts with the largest length left."""
    order = np.argsort(-lengths, kind="stable")
    values, firsts, found = np.unique(-lengths[order], return_index=True, return_counts=True)
    counts = {int(-v): int(c) for v, c in zip(values, found, strict=True)}
    take = {int(-v): int(at) for v, at in zip(values, firsts, strict=True)}
    left = [int(-v) for v in values]
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while left:
        big = left[0]
        counts[big] -= 1
        rest = fullest(left, counts, capacity - big) if capacity > big else []
        for x in rest:
            counts[x] -= 1
        at = 0
        for x in [big, *rest]:
            row = order[take[x]]
            take[x] += 1
            bins[row], offsets[row] = n, at
            at += x
        n += 1
        if any(not counts[x] for x in {big, *rest}):
            left = [x for x in left if counts[x]]
    return bins, offsets, n


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = 8192, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of lengths from 1 to ``capacity``.

    Rows are dealt by a hash of all their columns and of their place in the table to groups of about
    ``group_rows``, whose number grows with the input, and each group is packed by itself; a group
    wastes at most part of its last bins. Repeated rows are packed one by one and spread like all
    others. ``sequence_id`` is unique over all groups. The rows are counted first and their places must
    not change, so give a written table. An empty table gives no rows; columns of the added names are
    replaced.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_rows))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    simple = [f.name for f in pieces.schema if f.name in names and f.dataType.simpleString() in ("int", "bigint", "string")]
    dealt = pieces.select(*names, F.pmod(F.xxhash64(*simple, F.monotonically_increasing_id()), F.lit(groups)).alias("__group"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame[length_col].to_numpy(np.int64)
        bins, offsets, _ = minimum_bin_slack(lengths, capacity)
        return frame.drop(columns="__group").assign(sequence_id=bins + (int(frame["__group"].iloc[0]) << 32), offset=offsets)

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return map_groups(dealt, ["__group"], run, schema)
