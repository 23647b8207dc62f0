"""Alignment of two tokenizers on the same bytes, with corpus-wide counts of the id pairs that end together."""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, give_back, table
from .packing import runs
from .token_count import byte_names

#: Bytes of text that are cut at once; a longer text goes alone.
SLICE = 4_000_000
#: First bytes of characters among which there is Unicode white space.
SPACES = (0xC2, 0xE1, 0xE2, 0xE3)
#: Bytes that are neither white space nor may begin it.
DARK = np.ones(256, bool)
DARK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), *SPACES]] = False


class _Bytes:
    """The bytes of each of a number of things in one array."""

    def __init__(self, parts: list[bytes]):
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.begin = np.cumsum(self.size) - self.size

    def of(self, which: np.ndarray) -> np.ndarray:
        return self.flat[runs(self.begin[which], self.size[which])]


class Pair:
    """A byte-level vocabulary (A) and a sentencepiece model (B), and what they make of units of text.

    A unit is a space and what follows it up to the next single space between two characters that
    are no white space. Neither vocabulary joins anything across such a space, so a text's tokens
    are those of its units. What is known of a unit is kept in arrays; when there are over ``most``
    units, all are forgotten.
    """

    def __init__(self, path_a: str, path_b: str, most: int = 800_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), most
        self.a.encode_special_tokens = True
        code = {c: b for b, c in enumerate(byte_names())}
        known = {i: bytes(code[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b}: a piece goes across a space")
        self.of_a, self.of_b = _Bytes(self.bytes_a), _Bytes(self.bytes_b)
        self.fallback = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.decimal = _Bytes([b"%d," % i for i in range(max(len(self.bytes_a), len(pieces)))])
        self.forget()

    def bound(self) -> int:
        """How many id pairs can end together at all: one token's bytes are the end of the other's."""
        one, two = Counter(self.bytes_a), Counter(self.bytes_b)
        return sum(two[x[k:]] for x in self.bytes_a for k in range(len(x))) + sum(one[x[k:]] for x in self.bytes_b for k in range(1, len(x)))

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.place: dict[bytes, int] = {}
        self.facts = np.zeros((0, 4), np.int64)  # sound, A tokens, B tokens, groups
        self.text, self.text_size = bytearray(), none  # groups of all units, each with a semicolon
        self.linked = none  # id pairs as a << 32 | b, as many as groups

    def places(self, units: pa.Array) -> np.ndarray:
        """Where each unit's facts are; units that aren't known yet are learned, most of them many in one text."""
        names = units.to_pylist()
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            new = [names[k] for k in lacking.tolist()]
            whole = _Bytes(new)
            last = whole.begin + whole.size - 1
            fits = (whole.size > 1) & open_before(whole.flat, last + 1) & DARK[whole.flat[np.minimum(whole.begin + 1, last)]]
            alone, rest = list(compress(new, (~fits).tolist())), list(compress(new, fits.tolist()))
            for lo in range(0, len(rest), 10_000):
                part = rest[lo : lo + 10_000]
                alone += self.learn([part[k : k + 250] for k in range(0, len(part), 250)])
            for lo in range(0, len(alone), 5000):
                self.learn([[u] for u in alone[lo : lo + 5000]])
            at[lacking] = [self.place[u] for u in new]
        return at

    def learn(self, texts: list[list[bytes]]) -> list[bytes]:
        """Note the facts of new units, those of a list read as one text; units of unsound texts of several are given back.

        The spans that both libraries give are coarse cuts: A's in characters, B's in bytes of the
        text without the space, of which the fallback bytes of a character but its last one have
        none. Inside a character that several tokens share, and for fallback bytes, the ends are
        found by the tokens' decoded bytes. A text is sound if both vocabularies give its bytes back.
        """
        whole = _Bytes([b"".join(x) for x in texts])
        plain = [bytes(whole.flat[x : x + n]).decode() for x, n in zip(whole.begin.tolist(), whole.size.tolist(), strict=True)]
        ours = self.a.encode_batch(plain, add_special_tokens=False)
        theirs = [x.pieces for x in self.b.encode([t[1:] for t in plain], return_type="proto", num_threads=1)]
        flat, ids = chain.from_iterable, [x.ids for x in ours]
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (ids, theirs))
        a, spans_a = np.fromiter(flat(ids), np.int64), np.fromiter(flat(flat(x.offsets for x in ours)), np.int64)[1::2]
        b, spans_b = np.fromiter(flat(map(attrgetter("id", "end"), flat(theirs))), np.int64).reshape(-1, 2).T
        text_a, text_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
        lead = np.append(np.flatnonzero((whole.flat & 0xC0) != 0x80), len(whole.flat))  # where characters begin
        coarse_a = lead[np.searchsorted(lead, whole.begin)[text_a] + spans_a]
        coarse_b = whole.begin[text_b] + 1 + spans_b
        fine_a, sound_a = self.ends(self.of_a, a, text_a, whole)
        fine_b, sound_b = self.ends(self.of_b, b, text_b, whole)
        shared = np.append((coarse_a[1:] == coarse_a[:-1]) & (text_a[1:] == text_a[:-1]), False)
        end_a = np.where(shared, fine_a, coarse_a)
        end_b = np.where(self.fallback[b], fine_b, coarse_b)
        end_a, end_b = (np.where(e == f, e, f) for e, f in ((end_a, fine_a), (end_b, fine_b)))  # bytes have the last word
        sound = sound_a & sound_b & (n_b > 0)
        each, units = np.array([len(x) for x in texts]), list(flat(texts))
        size = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(size) - size
        cuts = np.intersect1d(end_a[sound[text_a]], end_b[sound[text_b]], assume_unique=True)
        joined = np.repeat(sound, each) & ~np.isin(begin + size, cuts)  # should a vocabulary go across a unit's end
        sound[np.repeat(np.arange(len(texts)), each)[joined]] = False
        keep_a, keep_b = sound[text_a], sound[text_b]
        a, b, end_a, end_b = a[keep_a], b[keep_b], end_a[keep_a], end_b[keep_b]
        cuts = np.intersect1d(end_a, end_b, assume_unique=True) if joined.any() else cuts
        linked = a[np.searchsorted(end_a, cuts)] << 32 | b[np.searchsorted(end_b, cuts)]
        # Tokens in the order of groups, A before B, each with its separator.
        group = np.concatenate([2 * np.searchsorted(cuts, end_a), 2 * np.searchsorted(cuts, end_b) + 1])
        order = np.argsort(group, kind="stable")
        tokens, group = np.concatenate([a, b])[order], group[order]
        text, upto = self.decimal.of(tokens), np.cumsum(self.decimal.size[tokens])
        last = np.flatnonzero(np.diff(group, append=-1))
        text[upto[last] - 1] = np.where(group[last] & 1, ord(";"), ord("|"))
        # All of that by unit; a text of several that isn't sound tells nothing of its units.
        told = np.repeat(sound | (each == 1), each)
        unit_a, unit_b, of_cut = (np.searchsorted(begin, e, side="left") - 1 for e in (end_a, end_b, cuts))
        count = lambda which, weights=None: np.bincount(which, weights, len(units)).astype(np.int64)[told]
        facts = np.column_stack([np.repeat(sound, each)[told], count(unit_a), count(unit_b), count(of_cut)])
        digits = count(np.concatenate([unit_a, unit_b])[order], self.decimal.size[tokens])
        known = len(self.place)
        self.place.update(zip(compress(units, told.tolist()), range(known, known + len(facts)), strict=True))
        self.text += text.tobytes()
        self.facts, self.text_size, self.linked = np.concatenate([self.facts, facts]), np.concatenate([self.text_size, digits]), np.concatenate([self.linked, linked])
        return list(compress(units, (~told).tolist()))

    @staticmethod
    def ends(known: _Bytes, tokens: np.ndarray, unit: np.ndarray, whole: _Bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each token's decoded bytes end if each unit's tokens begin with it, and which units are given back."""
        size = known.size[tokens]
        total = np.bincount(unit, size, len(whole.size)).astype(np.int64)
        sound = total == whole.size
        end = np.cumsum(size) + (whole.begin - (np.cumsum(total) - total))[unit]
        keep = sound[unit]
        there = whole.flat[runs(whole.begin[sound], whole.size[sound])]
        wrong = np.flatnonzero(known.of(tokens[keep]) != there)
        sound[np.repeat(np.flatnonzero(sound), whole.size[sound])[wrong]] = False
        return end, sound


def open_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place of UTF-8 bytes is no white space (nor one of the characters that begin like some)."""
    before = raw[at - 1]
    odd = (before >= 0x80) & ((raw[at - 2] == SPACES[0]) | ~DARK[raw[np.maximum(at - 3, 0)]] & (raw[np.maximum(at - 3, 0)] > SPACES[0]))
    return DARK[before] & ~odd


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of all texts in a row, each text after a space, and where those of each text end."""
    flat = b"".join([b" " + t for t in texts.cast(pa.binary()).to_pylist()])
    raw = np.frombuffer(flat, np.uint8)
    begin = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = np.flatnonzero(raw == 0x20)
    at = at[(at > 0) & (at < len(raw) - 1)]
    at = at[DARK[raw[at + 1]]]
    starts = np.sort(np.concatenate([at[open_before(raw, at)], [0], begin[:-1]]), kind="stable").astype(np.int64)
    starts = starts[np.append(True, starts[1:] > starts[:-1])]
    offsets = np.append(starts, len(raw)).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)])
    return units, np.searchsorted(starts, begin)


_KEPT: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    """This Python worker's vocabularies; later tasks of the worker use them again."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path_a, path_b)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Pair(path_a, path_b)
    if len(_KEPT[key].place) > _KEPT[key].most:
        _KEPT[key].forget()
    return _KEPT[key]


def _slices(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[tuple]:
    """For each slice of rows: keys, the pair, facts of the distinct units, where their group texts end in the pool, their linked pairs in a row, the units' codes, where each text's units begin and end, which texts are sound."""
    for batch in batches:
        text = pc.fill_null(batch.column(1), "")
        for lo, hi in byte_slices(text, SLICE):
            pair, part = _pair(path_a, path_b), text.slice(lo, hi - lo)
            units, upto = cut_units(part)
            coded = units.dictionary_encode()
            place = pair.places(coded.dictionary)
            facts, codes = pair.facts[place], coded.indices.to_numpy()
            links = np.cumsum(pair.facts[:, 3])[place]
            linked = pair.linked[runs(links - facts[:, 3], facts[:, 3])]
            unsound = np.concatenate([[0], np.cumsum(facts[codes, 0] == 0)])
            begin = np.concatenate([[0], upto[:-1]]).astype(np.int64)
            yield batch.column(0).slice(lo, hi - lo), pair, place, facts, linked, codes, begin, upto, unsound[upto] == unsound[begin]
            pa.default_memory_pool().release_unused()


def pair_counts(df: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """Rows ``(a, b, n)``: how many links of all texts hold the id pair. Each task sums what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, _, place, facts, linked, codes, begin, upto, sound in _slices(batches, path_a, path_b):
            times = np.bincount(codes[np.repeat(sound, upto - begin)], minlength=len(place))
            each = np.repeat(times, facts[:, 3])
            found = np.concatenate([pairs, linked])
            pairs, inverse = np.unique(found, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, each])).astype(np.int64)
        keep = counts > 0
        cols = [pa.array(pairs[keep] >> 32), pa.array(pairs[keep] & 0xFFFFFFFF), pa.array(counts[keep])]
        yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "n"])

    texts = df.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Rows ``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups])``, one for each row.

    Two passes over the texts: one counts id pairs, one looks the counts up. The table of counts is
    broadcast; it can't have more rows than there are pairs of tokens of which one ends as the other
    (some 300,000 for these vocabularies, whatever the corpus), which is checked. Null and empty
    texts and those that a vocabulary doesn't give back byte for byte have no tokens: zeros and an
    empty digest. Ties for a B id's best count all count. Long texts are cut into units; each of
    repeated rows counts and has a row; an empty table gives none; columns other than the id and the
    text go, so clashing names don't matter.
    """
    found = table(pair_counts(df, path_a, path_b, text_col), "id-pairs")
    most = Pair(path_a, path_b).bound()
    if found.count() > most:
        raise RuntimeError(f"over {most} id pairs end together, more than the vocabularies allow")
    rows = found.toArrow().to_pandas()
    rows = rows.assign(key=rows["a"] * (1 << 32) + rows["b"]).sort_values("key")
    best = rows["n"].to_numpy() == rows.groupby("b")["n"].transform("max").to_numpy() if len(rows) else np.zeros(0, bool)
    shared = df.sparkSession.sparkContext.broadcast((rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        keys, times, top = shared.value
        for key, pair, place, facts, linked, codes, begin, upto, sound in _slices(batches, path_a, path_b):
            sizes = facts[:, 3]
            # Pairs that only unsound texts hold aren't in the table; what they find isn't used.
            at = np.minimum(np.searchsorted(keys, linked), max(0, len(keys) - 1))
            stop = np.cumsum(sizes)
            totals = [np.concatenate([[0], np.cumsum(x[at] if len(x) else np.zeros(len(at)), dtype=np.int64)]) for x in (top, times)]
            unit = np.column_stack([facts[:, 1:], sizes, *[t[stop] - t[stop - sizes] for t in totals]])
            upper = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(unit[codes], axis=0)])
            doc = np.where(sound[:, None], upper[upto] - upper[begin], 0)
            ends = np.cumsum(pair.text_size)[place]
            texts = [bytes(pair.text[x:y]) for x, y in zip((ends - pair.text_size[place]).tolist(), ends.tolist(), strict=True)]
            digest, groups = [], []
            for lo, hi, fine in zip(begin.tolist(), upto.tolist(), sound.tolist(), strict=True):
                joined = b"".join([texts[c] for c in codes[lo:hi].tolist()])[:-1] if fine else b""
                digest.append(hashlib.sha256(joined).hexdigest() if fine else "")
                if with_groups:
                    groups.append(joined.decode())
            cols = [key, *[pa.array(np.ascontiguousarray(doc[:, k])) for k in range(6)], pa.array(digest, pa.string())]
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            if with_groups:
                cols.append(pa.array(groups, pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
