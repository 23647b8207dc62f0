"""Language identification by cross-parsing: suffix automata of labelled text, fewest normalised phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, give_back, unit_hash

#: Symbols of a lane: texts are cut into lanes, which are parsed side by side; bytes of text parsed at once, a longer text alone.
LANE, SLICE = 512, 2_000_000


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton as rows of ``width``; row 0 is dead, row 1 the start."""
    links, lengths, nexts = [0, 0], [0, 0], [{}, {}]
    last = 1
    for c in symbols:
        cur = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        nexts.append({})
        p = last
        while p and c not in nexts[p]:
            nexts[p][c] = cur
            p = links[p]
        if not p:
            links[cur] = 1
        else:
            q = nexts[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[cur] = q
            else:
                copy = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                nexts.append(dict(nexts[q]))
                while p and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = links[p]
                links[q] = links[cur] = copy
        last = cur
    out = np.zeros((len(links), width), np.int32)
    for state, follow in enumerate(nexts):
        for c, to in follow.items():
            out[state, c] = to
    return out


@dataclass
class Model:
    """Automata of all languages in one table, and the byte codes that they know."""

    langs: list[str]
    codes: np.ndarray  # byte of a letter in UTF-8: symbol; 0 is the space between words, 1 a byte that no language has
    table: np.ndarray  # flat transitions of all languages; state 0 is dead
    roots: np.ndarray
    width: int
    bits: np.ndarray  # bits of one phrase: log2 of the labelled text's length
    usual: np.ndarray  # bits a symbol of further labelled text, of the same with its symbols shuffled, and the spread
    noise: np.ndarray
    spread: np.ndarray

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in a row and the number of each; a run of anything but letters is one space."""
        raw, counts = letter_bytes(texts)
        return self.codes[raw], counts

    def phrases(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Phrases of each text under each language: rows are texts, columns languages.

        A phrase is the longest match with the labelled text from where the last one ended. Lanes of
        ``LANE`` symbols are parsed side by side, each as if a phrase began with it. Then every lane is
        parsed on from the state in which the lane before ended, until both parses begin a phrase at
        the same place, from where on they agree; so the counts are those of one parse of the whole text.
        """
        n, k = len(counts), len(self.langs)
        lanes = -(-counts // LANE)
        owner = np.repeat(np.arange(n), lanes)
        if not len(owner) or not k:
            return np.zeros((n, k))
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts = np.repeat(np.cumsum(counts) - counts, lanes) + nth * LANE
        lengths = np.minimum(LANE, np.repeat(counts, lanes) - nth * LANE)
        order = np.argsort(-lengths, kind="stable")
        begin, longest = starts[order], lengths[order]
        state = np.repeat(self.roots[None, :], len(begin), 0)
        found = np.ones((len(begin), k), np.int32)
        first = self.table.reshape(-1, self.width)[self.roots].T.copy()  # symbol, language: state after the start
        first = np.where(first == 0, self.roots[None, :], first)
        live = np.searchsorted(-longest, -np.arange(LANE), side="left")  # lanes longer than t
        for t in range(int(longest[0])):
            m = live[t]
            c = symbols[begin[:m] + t].astype(np.int32)
            to = self.table[state[:m] * self.width + c[:, None]]
            miss = to == 0
            if t:
                found[:m] += miss
            state[:m] = np.where(miss, first[c], to)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        found, state = found[back], state[back]
        lane = np.flatnonzero(nth > 0)
        seam, lang = np.repeat(lane, k), np.tile(np.arange(k), len(lane))
        alone, delta = state.copy(), np.zeros_like(found)
        while len(seam):  # mostly once; again after a lane whose two parses never agreed
            change, end, open_ = self._seams(symbols, starts[seam], lengths[seam], lang, state[seam - 1, lang], first)
            delta[seam, lang] = change
            end = np.where(open_, end, alone[seam, lang])
            on = (end != state[seam, lang]) & (seam + 1 < len(owner))
            state[seam, lang] = end
            on[on] = nth[seam[on] + 1] > 0
            seam, lang = seam[on] + 1, lang[on]
        out = np.zeros((n, k))
        np.add.at(out, owner, found + delta)
        return out

    def _seams(self, symbols: np.ndarray, at: np.ndarray, length: np.ndarray, lang: np.ndarray, state: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per seam: phrases more than from a fresh start, the state at the lane's end, and whether the parses never agreed."""
        change, end, open_ = np.zeros(len(at), np.int32), state.copy(), np.zeros(len(at), bool)
        own, on, fresh, t = np.arange(len(at)), state, self.roots[lang].copy(), 0
        while len(own):
            c = symbols[at[own] + t].astype(np.int32)
            a, b = self.table[on * self.width + c], self.table[fresh * self.width + c]
            new_a, new_b = a == 0, (b == 0) | (t == 0)
            start = first[c, lang[own]]
            on, fresh = np.where(new_a, start, a), np.where(new_b, start, b)
            go = ~(new_a & new_b)
            change[own] += np.where(go, new_a.astype(np.int32) - new_b, 0)
            t += 1
            stop = go & (length[own] == t)
            end[own[stop]], open_[own[stop]] = on[stop], True
            go &= ~stop
            own, on, fresh = own[go], on[go], fresh[go]
        return change, end, open_

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a symbol of each text under each language; its symbols and its letters' symbols."""
        symbols, counts = self.symbols(texts)
        ends = np.cumsum(counts)
        letters = np.concatenate([[0], np.cumsum(symbols != 0)])
        return self.phrases(symbols, counts) * self.bits / np.maximum(counts, 1)[:, None], counts, letters[ends] - letters[ends - counts]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits a symbol and the most bits at which the language explains each text."""
        rate, counts, letters = self.rates(texts)
        if not self.langs:
            none = np.zeros(len(texts))
            return ["und"] * len(texts), none, none, none
        best = rate.argmin(1)
        low = rate[np.arange(len(texts)), best]
        score = 1 / np.exp2(-4 * (rate - low[:, None])).sum(1)
        none = letters == 0
        limit = (self.usual + (self.noise - self.usual) * 2 / 3 + 3 * self.spread / np.sqrt(np.maximum(counts, 1))[:, None])[np.arange(len(texts)), best]
        return ["und" if x else self.langs[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, score), np.where(none, 0.0, low), np.where(none, 0.0, limit)


_LETTER = np.zeros(0x110000, np.uint8)  # 0: not seen yet, 1: no letter, 2: letter


def letter_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in lower case and the number of each; each run of anything but letters is one space."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), "<u4")
    for c in np.unique(points[_LETTER[points] == 0]):
        _LETTER[c] = 2 if chr(c).isalpha() else 1
    space = _LETTER[points] == 1
    ends = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[ends - 1] = False
    wide = keep * (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)) if len(points) else keep
    wide = np.where(space, keep, wide)
    total = np.concatenate([[0], np.cumsum(wide)])
    shown = np.where(space, np.uint32(32), points)[keep]
    raw = np.frombuffer(shown.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    return raw, total[ends] - total[np.concatenate([[0], ends[:-1]])]


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = 96, chars: int = 30_000, most_bytes: int = 256_000_000) -> Model:
    """Fit on a bounded sample of rows: about ``docs`` rows a language by hash of the id, each of at most ``chars`` characters.

    Of a longer row a stretch of so many characters counts, which begins at a place given by the hash.
    In the order of the hash, rows go into a language's automaton while they have ``chars`` characters
    together; the others tell how many bits a symbol such text usually takes. The alphabet is all bytes
    that the sample's letters have in UTF-8, so no letter is left out. Rows without text or language, and languages without a
    letter, are left out; equal rows of one id count each; without any row nothing is learned
    and every text is ``und``; extra columns are ignored. The driver gets at most some ``docs * chars``
    characters a language; an automaton has at most two states a byte of its text, and all have at most
    ``most_bytes`` together: with many languages or letters each learns from fewer characters.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("n", F.length("text")).filter("n > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share, order = F.lit(0.0), unit_hash(F.col("id"), F.lit(17))
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, docs / n)).otherwise(share)
    begin = F.floor(unit_hash(F.col("id"), F.lit(18)) * F.greatest(F.lit(0), F.col("n") - chars + 1)).cast("int") + 1
    sample = rows.filter(order < share).select("lang", order.alias("at"), "id", F.substring("text", begin, chars).alias("text")).collect()
    sample.sort(key=lambda r: (r["lang"], r["at"], str(r["id"]), r["text"]))
    texts, further = _dealt(sample, chars)
    letters = {b for own in texts.values() for b in np.unique(letter_bytes(own)[0]).tolist()}
    needed = 8 * (len(letters) + 2) * sum(len(letter_bytes(["\n".join(own)])[0]) for own in texts.values())
    if needed > most_bytes:
        texts, further = _dealt(sample, int(chars * most_bytes / needed))
    whole = {lang: letter_bytes(["\n".join(own)])[0] for lang, own in texts.items()}
    langs = sorted(lang for lang, raw in whole.items() if (raw != 32).any())
    letters = np.setdiff1d(np.concatenate([whole[x] for x in langs]), [32]) if langs else np.zeros(0, np.uint8)
    codes = np.ones(256, np.uint8)
    codes[32], codes[letters] = 0, 2 + np.arange(len(letters))
    width, tables, roots, base = len(letters) + 2, [], [], 0
    tables.append(np.zeros((1, width), np.int32))
    for lang in langs:
        own = suffix_automaton(codes[whole[lang]].tolist(), width)
        tables.append(np.where(own[1:] > 0, own[1:] + base, 0).astype(np.int32))
        roots.append(base + 1)
        base += len(own) - 1
    bits = np.array([np.log2(max(2, len(whole[x]))) for x in langs])
    k = len(langs)
    model = Model(langs, codes, np.concatenate(tables).reshape(-1), np.array(roots, np.int32), width, bits, np.zeros(k), np.full(k, np.inf), np.zeros(k))
    for i, lang in enumerate(langs):
        model.usual[i], model.noise[i], model.spread[i] = _usual(model, i, further.get(lang, []))
    return model


def _dealt(sample: list, chars: int) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Texts of each language to learn from, of at most ``chars`` characters together (one at least, cut to so many), and further ones."""
    texts: dict[str, list[str]] = {}
    further: dict[str, list[str]] = {}
    for r in sample:
        if not letter_bytes([r["text"]])[1][0]:
            continue
        own = texts.setdefault(r["lang"], [])
        if not own:
            own.append(r["text"][:chars])
        else:
            (own if sum(map(len, own)) + len(r["text"]) <= chars else further.setdefault(r["lang"], [])).append(r["text"])
    return texts, further


def _usual(model: Model, i: int, texts: list[str]) -> tuple[float, float, float]:
    """Of labelled texts that language ``i`` wasn't learned from: bits a symbol, those of their shuffled symbols, and the spread a symbol."""
    rate, counts, _ = model.rates(texts)
    rate = rate[:, i] if len(texts) else np.zeros(0)
    if not counts.sum():
        return 0.0, np.inf, 0.0  # nothing to go by: every text counts as explained
    usual = float(rate @ counts / counts.sum())
    mixed = np.random.default_rng(i).permutation(model.symbols(texts)[0])
    noise = float(model.phrases(mixed, np.array([len(mixed)]))[0, i] * model.bits[i] / len(mixed))
    return usual, noise, float(np.sqrt(np.mean((rate - usual) ** 2 * counts)))


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``bits`` (bits a symbol under the winner) and ``most_bits`` to each row.

    The whole text counts. ``und`` with score, bits and most bits 0 where the text is null or has no
    letter; of languages with equal rates the first by name wins; equal texts get equal results; an
    empty table gives no rows; input columns of these names are replaced; ``keep`` names the input
    columns to return, else all. A language's rate is its number of phrases times the bits of one
    phrase over the symbols; the score is its share of 16 to the power of minus the rate. The winner
    explains a text of n symbols up to ``most_bits``: two thirds of the way from the rate of its own
    further text to that of the same symbols shuffled, and three spreads over the root of n more.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "bits", "most_bits"]
    own = [c for c in df.columns if c not in added]
    keep = own if keep is None else [c for c in keep if c in own]
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("bits", "double").add("most_bits", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi in byte_slices(batch.column(at), SLICE):
                part = batch.slice(lo, hi - lo)
                lang, *numbers = known.predict([t or "" for t in part.column(at).to_pylist()])
                cols = [*[part.column(c) for c in keep], pa.array(lang, pa.string()), *map(pa.array, numbers)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])
        give_back()

    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)
