"""Token counts by a BPE vocabulary compiled into a deterministic transducer."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, give_back

#: Bytes of text that are read at once; a longer text goes alone.
SLICE = 4_000_000
#: Symbols of a chunk, and symbols before a chunk from which its first state is worked out.
CHUNK, BEFORE = 512, 64
#: Added to the byte that ends a word.
LAST = 256
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: The vocabulary's pattern of words, and the endings that an apostrophe begins.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ONE, TWO = "stmd", ("re", "ve", "ll")


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Transducer:
    """States and transitions of a BPE vocabulary with word ends, worked out as texts need them.

    A symbol is a byte, plus ``LAST`` for a word's last byte. The tokens of a prefix end with one
    certain token: the longest that may follow the tokens before it, where two tokens may be
    neighbours if merging their bytes gives these two. So a state holds, for each place from which
    the read bytes begin some token: the node of the vocabulary's trie, the token before that
    place, and how many tokens lie before it. The least of these numbers is certain whatever
    follows; a transition emits how much it grows, and a word's last byte emits the rest and goes
    back to the first state. States that agree in all this are one state, whatever was read.

    Transitions are kept in an open hash table of arrays. ``forget`` starts anew when there are
    more than ``most`` of them, so memory is bounded by ``most`` and one slice of text.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [{}])
        split = steps[0].get("pattern", {}).get("Regex")
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or split != PATTERN:
            raise ValueError(f"{path}: not a BPE vocabulary with word ends and the known pattern")
        self.tok, self.most, self.end = Tokenizer.from_file(path), most, "</w>"
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        code = {c: b for b, c in enumerate(byte_names())}
        self.child: dict[tuple[int, int], int] = {}
        self.token: dict[int, tuple[str, ...]] = {}  # by node of the trie: the token's symbols
        self.inner = {0}
        for text in model["vocab"]:
            ends = text.endswith(self.end) and len(text) > len(self.end)
            chars = list(text[: -len(self.end)] if ends else text)
            node = 0
            for k, c in enumerate(chars):
                self.inner.add(node)
                key = (node, code[c] + (LAST if ends and k == len(chars) - 1 else 0))
                node = self.child.setdefault(key, len(self.child) + 1)
            self.token[node] = (*chars[:-1], chars[-1] + self.end) if ends else tuple(chars)
        self.fits = lru_cache(300_000)(self._fits)
        self.kind = np.zeros(0x110000, np.uint8)
        self.forget()

    def forget(self) -> None:
        first = array("q", [0]).tobytes()
        self.rows, self.number = [first], {first: 0}
        self.keys, self.to, self.n = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64), 0

    def merged(self, parts: list[str]) -> list[str]:
        """Merge neighbours, the best rank first and of equal ranks the leftmost."""
        while len(parts) > 1:
            best, k = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if best == len(self.rank):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fits(self, before: int, node: int) -> bool:
        """Whether the tokens of two nodes may be neighbours; node 0 is a word's start."""
        one, two = self.token.get(before, ()), self.token[node]
        return self.merged([*one, *two]) == [x for x in ("".join(one), "".join(two)) if x]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and what is emitted. A part of a state is ``node << 32 | token before << 8 | number``."""
        parts = memoryview(self.rows[state]).cast("q")
        out, found = [], None
        for x in parts:  # the longest first
            node = self.child.get((x >> 32, symbol))
            if node is None:
                continue
            if found is None and node in self.token and self.fits(x >> 8 & 0xFFFFFF, node):
                found = node << 8 | ((x & 255) + 1)
                if symbol >= LAST:
                    return 0, x + 1 & 255
            if node in self.inner:
                out.append(node << 32 | x & 0xFFFFFFFF)
        out.append(found)  # any byte is a token, so there is one
        least = min(x & 255 for x in out)
        row = array("q", [x - least for x in out]).tobytes()
        if row not in self.number:
            self.number[row] = len(self.rows)
            self.rows.append(row)
        return self.number[row], least

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key: its own or the free one where it belongs."""
        size = len(self.keys)
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)
        held = self.keys[at]
        off = np.flatnonzero((held != keys) & (held >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (size - 1)
            held = self.keys[at[off]]
            off = off[(held != keys[off]) & (held >= 0)]
        return at

    def put(self, keys: np.ndarray, to: np.ndarray) -> None:
        while len(keys):  # of keys that want one slot the last gets it
            at = self.slots(keys)
            self.keys[at] = keys
            mine = self.keys[at] == keys
            self.to[at[mine]] = to[mine]
            keys, to = keys[~mine], to[~mine]

    def learn(self, keys: np.ndarray) -> None:
        steps = [self.step(k >> 9, k & 511) for k in keys.tolist()]
        self.n += len(keys)
        if self.n > len(self.keys) // 2:
            held = self.keys >= 0
            old, to = self.keys[held], self.to[held]
            size = 4 * len(self.keys)
            self.keys, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            self.put(old, to)
        self.put(keys, np.array([s << 8 | e for s, e in steps], np.int64))

    def go(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of each state: the next states and what they emit."""
        keys = states << 9 | symbols
        at = self.slots(keys)
        new = self.keys[at] != keys
        if new.any():
            self.learn(np.unique(keys[new]))
            at = self.slots(keys)
        to = self.to[at]
        return to >> 8, to & 255

    def emitted(self, symbols: np.ndarray) -> np.ndarray:
        """What each symbol of a stream emits, the stream cut into chunks that are read side by side.

        A chunk maps the state before it to the state after it. Each chunk is first read from the
        state that up to ``BEFORE`` symbols before it lead to, which is the right one if a word
        begins among them. Then the maps are composed from left to right: where a chunk's first
        state isn't the last one of the chunk before, its map is taken at that state instead, until
        all meet. Only words longer than ``BEFORE`` need that.
        """
        n = -(-len(symbols) // CHUNK)
        stream = np.full(n * CHUNK, LAST + ord("a"), np.int64)
        stream[: len(symbols)] = symbols
        out = np.zeros(n * CHUNK, np.uint8)
        begin = np.arange(n) * CHUNK
        starts = np.concatenate([[0], np.flatnonzero(stream >= LAST) + 1])
        warm = np.maximum(starts[np.searchsorted(starts, begin, side="right") - 1], begin - BEFORE)
        entry = np.zeros(n, np.int64)
        for back in range(BEFORE, 0, -1):
            k = np.flatnonzero(begin - warm >= back)
            if len(k):
                entry[k], _ = self.go(entry[k], stream[begin[k] - back])
        leave = np.zeros(n, np.int64)
        todo = np.arange(n)
        while len(todo):
            state = entry[todo]
            for j in range(CHUNK):
                state, out[begin[todo] + j] = self.go(state, stream[begin[todo] + j])
            leave[todo] = state
            todo = np.flatnonzero(entry[1:] != leave[:-1]) + 1
            entry[todo] = leave[todo - 1]
        return out[: len(symbols)]

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Letter, number, white space or other of each code point, as the vocabulary's own splitter sees it."""
        for p in np.unique(points[self.kind[points] == 0]).tolist():
            if 0xD800 <= p < 0xE000:
                continue
            split = self.tok.pre_tokenizer.pre_tokenize_str
            parts = len(split(f"a{chr(p)}a"))
            self.kind[p] = LETTER if parts == 1 else SPACE if parts == 2 else OTHER if len(split(f"!{chr(p)}!")) == 1 else NUMBER
        return self.kind[points]

    def symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words of normalised texts in a row, and where those of each text end.

        A word ends where the kind changes, after each number, before an apostrophe that begins one
        of the known endings (it isn't within a run of other characters), after such an ending, and
        at the text's end.
        """
        flat = b"".join(texts.cast(pa.binary()).to_pylist())
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(lengths)
        points = np.frombuffer(flat.decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        kind = self.kinds(points)
        stop = np.zeros(len(points) + 2, bool)  # a text ends here
        stop[upto[lengths > 0] - 1] = True
        ends = np.ones(len(points), bool)
        ends[:-1] = (kind[:-1] != kind[1:]) | (kind[:-1] == NUMBER)
        quote = np.flatnonzero(points == ord("'"))
        quote = quote[((quote == 0) | (kind[quote - 1] != OTHER) | stop[quote - 1]) & ~stop[quote]]
        after = np.concatenate([points, [0, 0]])
        one = quote[np.isin(after[quote + 1], [ord(c) for c in ONE])]
        two = quote[np.any([(after[quote + 1] == ord(x[0])) & (after[quote + 2] == ord(x[1])) for x in TWO], axis=0) & ~stop[quote + 1]]
        ends[one], ends[one + 1] = False, True
        ends[two], ends[two + 1], ends[two + 2] = False, False, True
        ends |= stop[: len(points)]
        raw = np.frombuffer(flat, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        width = np.diff(lead, append=len(raw))
        out = raw.astype(np.int64)
        out[(lead + width - 1)[ends]] += LAST
        keep = np.repeat(kind != SPACE, width)
        total = np.concatenate([[0], np.cumsum(np.where(kind != SPACE, width, 0))])
        return out[keep], total[upto]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a special token's text counts as one and parts the text around it."""
        rows, parts, extra = np.arange(len(texts)), texts, np.zeros(len(texts), np.int64)
        special = np.zeros(len(texts), bool)
        for x in self.special:
            special |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if special.any():
            cut = re.compile("|".join(map(re.escape, self.special)))
            split = [cut.split(t) if s else [t] for t, s in zip(texts.to_pylist(), special.tolist(), strict=True)]
            each = np.array([len(x) for x in split])
            rows, parts, extra = np.repeat(rows, each), pa.array([x for p in split for x in p], pa.string()), each - 1
        symbols, upto = self.symbols(self.normal(parts))
        total = np.concatenate([[0], np.cumsum(self.emitted(symbols), dtype=np.int64)])[upto]
        return extra + np.bincount(rows, np.diff(total, prepend=0), len(texts)).astype(np.int64)

    def normal(self, texts: pa.Array) -> pa.Array:
        """Texts as the vocabulary's normaliser gives them; below U+0300 (but for U+0130) that is lower case, up to white space."""
        odd = pc.match_substring_regex(texts, "[İ̀-\U0010ffff]").to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(texts)
        if not odd.any():
            return low
        values = low.to_pylist()
        for k in np.flatnonzero(odd).tolist():
            values[k] = self.tok.normalizer.normalize_str(texts[k].as_py())
        return pa.array(values, pa.string())


_KEPT: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """This Python worker's transducer; later tasks of the worker use it again."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Transducer(path)
    return _KEPT[path]


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_bytes, n_tokens, over_limit)``: one for each row, in one pass without a shuffle.

    Null and empty texts have no bytes and no tokens. Long texts are read in chunks side by side.
    Ties don't arise; each of repeated rows has a row; an empty table gives none; columns other than
    the id and the text go, so clashing names don't matter. ``over_limit`` means more than ``limit``
    tokens. Counts are those of the tokenizer without added tokens, its special strings in texts
    being one token each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        machine = transducer(tokenizer_path)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            for lo, hi in byte_slices(text, SLICE):
                if machine.n > machine.most:
                    machine.forget()
                part = text.slice(lo, hi - lo)
                n = machine.counts(part)
                cols = [batch.column(0).slice(lo, hi - lo), pc.binary_length(part).cast(pa.int64()), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "n_tokens", "over_limit"])
                pa.default_memory_pool().release_unused()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
