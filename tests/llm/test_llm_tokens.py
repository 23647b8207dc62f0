"""Token counts, alignment of two tokenizers and conversation repair, each against a brute-force version."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bandloom.llm import queries
from bandloom.llm.token_align import Pair, align, pair_counts
from bandloom.llm.token_count import Transducer, token_counts
from bandloom.llm.turn_repair import DELETE, FAR, INSERT, KEEP, REROLE, chain, damage, piece_map, repair, solve

WORDS, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
CLASHING = "doc_id long, text string, id string, n_tokens string, n_a int, groups string"


def texts_of(seed, n):
    rng = random.Random(seed)
    odd = [*"abcde  '’srtvml!?", "'ll", "the", "<|endoftext|>", "<s>", "\u0085", " ", "　", "日本", "é", "É", "İ", "ß", "ςΣ", "\x00", "\t", "\n", "0", "٣", "①", "ﬁ", "🙂", "½", "▁", "<0x41>", "Ǆ", " word", " other"]
    return ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(n)]


LONG = ["a" * 3000, "ab" * 2000 + " x", "'s" * 1500, "the" * 1500, "".join(random.Random(5).choice("aeiouthnr") for _ in range(4000)), "don't I'LL we've 's''s !'s they're'd ''ll 'lla 'r", "x<|endoftext|>" * 50, " lead", "two  spaces ", " "]


@pytest.fixture(scope="module")
def words():
    return Transducer(WORDS)


def test_transducer_counts_as_the_tokenizer(words, spark, sf):
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    texts = [*texts_of(1, 3000), *LONG, *docs, ""]
    want = [len(x.ids) for x in words.tok.encode_batch(texts, add_special_tokens=False)]
    for size in (500, len(texts)):
        assert sum((words.counts(pa.array(texts[i : i + size], pa.string())).tolist() for i in range(0, len(texts), size)), []) == want
    states = len(words.rows)
    words.forget()
    assert len(words.rows) == 1 < states
    assert words.counts(pa.array(texts[:200], pa.string())).tolist() == want[:200]


def test_low_characters_are_lower_case_only(words):
    for c in {*map(chr, range(0x300))} - {"İ"}:
        assert words.tok.normalizer.normalize_str(c) in (c.lower(), " ")


def test_states_emit_what_no_suffix_can_undo(words):
    """Along a word the emitted numbers are never below zero, and their sum is the count of its tokens."""
    for word in ("internationalisation", "aaaaaaaaaaaaaaa", "thethethe"):
        state, total = 0, 0
        for k, b in enumerate(word.encode()):
            state, out = words.step(state, b + 256 * (k == len(word) - 1))
            assert out >= 0
            total += out
        assert state == 0 and total == len(words.tok.encode(word, add_special_tokens=False).ids)


def test_token_counts_edges(spark):
    rows = [(1, None, "x", None, None, None), (2, "", "x", "y", 1, "z"), (3, "hello world", None, None, None, None), (3, "hello world", None, None, None, None), (None, "Ünï", None, None, None, None), (4, "w " * 2049, None, None, None, None), (5, "w " * 2048, None, None, None, None)]
    got = Counter(tuple(r) for r in token_counts(spark.createDataFrame(rows, CLASHING), WORDS).collect())
    assert got == Counter({(1, 0, 0, False): 1, (2, 0, 0, False): 1, (3, 11, 2, False): 2, (None, 5, len(Tokenizer.from_file(WORDS).encode("Ünï", add_special_tokens=False).ids), False): 1, (4, 4098, 2049, True): 1, (5, 4096, 2048, False): 1})
    assert token_counts(spark.createDataFrame([], CLASHING), WORDS).count() == 0
    with pytest.raises(ValueError, match="word ends"):
        Transducer(BYTES)


def test_token_count_query(spark, sf):
    tok = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op11_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        assert got[r["doc_id"]] == (len((r["text"] or "").encode()), n, n > 2048)


def brute_alignment(rows):
    """Whole texts by both libraries; byte ends of every token; the places where both end."""
    pair = Pair(BYTES, PIECES)
    tok, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tok.encode_special_tokens = True
    found = []
    for key, text in rows:
        groups, linked, a, b = [], [], [], []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            one, two = [pair.bytes_a[x] for x in a], [pair.bytes_b[x] for x in b]
            if not b"".join(one) == b"".join(two) == (" " + text).encode():
                a, b = [], []
        ends = [{e: k + 1 for k, e in enumerate(itertools.accumulate(map(len, part)))} for part in ([pair.bytes_a[x] for x in a], [pair.bytes_b[x] for x in b])]
        i = j = 0
        for at in sorted(ends[0].keys() & ends[1].keys()):
            m, n = ends[0][at], ends[1][at]
            groups.append(f"{','.join(map(str, a[i:m]))}|{','.join(map(str, b[j:n]))}")
            linked.append((a[m - 1], b[n - 1]))
            i, j = m, n
        found.append((key, len(a), len(b), groups, linked))
    count = Counter(x for *_, linked in found for x in linked)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter((key, n_a, n_b, len(groups), len(linked), sum(count[x] == best[x[1]] for x in linked), sum(count[x] for x in linked), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "") for key, n_a, n_b, groups, linked in found), count


def test_alignment_against_brute_force(spark, sf):
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = list(enumerate([*texts_of(2, 1500), *LONG, *docs[:80], None, ""]))
    rows += rows[-5:] + [(None, "no id")]
    want, count = brute_alignment(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = align(df, BYTES, PIECES, with_groups=True).collect()
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])
    assert sum(r["n_a"] == 0 for r in got) < len(rows) / 2  # most of the odd texts hold no U+2581
    assert {(r["a"], r["b"]): r["n"] for r in pair_counts(df, BYTES, PIECES).collect()} == count


def test_alignment_edges(spark):
    rows = [(1, None, "x", None, 2, None), (2, "", "x", "y", 1, "z"), (3, "▁", None, None, None, None)]
    zeros = (0, 0, 0, 0, 0, 0, "")
    assert {r[0]: tuple(r[1:]) for r in align(spark.createDataFrame(rows, CLASHING), BYTES, PIECES).collect()} == {1: zeros, 2: zeros, 3: zeros}
    assert align(spark.createDataFrame([], CLASHING), BYTES, PIECES).count() == 0
    pair = Pair(BYTES, PIECES)
    assert pair.bound() < 500_000


def test_alignment_query(spark, sf):
    want, _ = brute_alignment([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert Counter(tuple(r) for r in queries.op12_token_alignment(spark, sf).collect()) == want


SPACE = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def brute_edits(rows):
    """Least (cost, letters, lines) over all edits, state by state; a row is (role, text, fault)."""

    def put(states, q, value):
        if q is not None and (q not in states or value < states[q]):
            states[q] = value

    def inserted(states):
        for _ in range(3):
            for q, (cost, letters, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    put(states, NEXT.get((q, role[0])), (cost + 2, letters + INSERT, [*lines, f"{role}:"]))
        return states

    states = inserted({0: (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for q, (cost, letters, lines) in states.items():
            put(new, q, (cost + 3, letters + DELETE, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                put(new, NEXT.get((q, role[:1])), (cost + more, letters + KEEP, [*lines, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    put(new, NEXT.get((q, other[0])), (cost + 2 + more, letters + REROLE, [*lines, f"{other}:{text}"]))
        states = inserted(new)
    return min(v for q, v in states.items() if q in (0, 3))


def brute_repair(rows):
    convs, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, had in convs.items():
        had.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns, seen, faults = [x[0] for x in had if x[0] is not None], set(), []
        for _, role, text in had:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(had))
        cost, letters, lines = brute_edits([(r, t, f) for (_, r, t), f in zip(had, faults, strict=True)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def lines_of(codes):
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
    return [(roles[c.lower()], str(k), "blank" if c == "d" else "truncated" if c.isupper() else "") for k, c in enumerate(codes)]


def test_auction_gives_the_least_edits():
    for codes in map("".join, itertools.chain(*(itertools.product("suaUxd", repeat=n) for n in range(5)))):
        assert solve(codes) == brute_edits(lines_of(codes))[:2]
    rng = random.Random(3)
    for _ in range(60):
        codes = "".join(rng.choice("suaSUAxXd") for _ in range(rng.randrange(5, 50)))
        assert solve(codes) == brute_edits(lines_of(codes))[:2]


def test_pieces_compose():
    rng = random.Random(4)
    for _ in range(60):
        parts = ["".join(rng.choice("suaSUAxXd") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 6))]
        maps = [piece_map(p) for p in parts]
        assert all(c >= FAR or sum(x != INSERT for x in a) == len(p) for p, (costs, audits) in zip(parts, maps, strict=True) for c, a in zip(costs, audits, strict=True))
        cost, states = chain([(c, [sorted(set(a)).index(x) for x in a]) for c, a in maps])
        letters = "".join(a[4 * s + t] for (_, a), (s, t) in zip(maps, states, strict=True)) + ["", "II", "I", ""][states[-1][1]]
        assert (cost, letters) == brute_edits(lines_of("".join(parts)))[:2]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_repair_against_brute_force(adaptive, spark):
    """Nulls, ties and repeated rows, and two conversations that hold most rows, over several tasks."""
    rng, rows = random.Random(6), []
    for conv in [*range(60), None]:
        for i in range(400 if conv in (7, 30) else rng.choice([1, 2, 3, 5, 8, 70])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "unknown", "tool", None, "", "u"]) if rng.random() < 0.3 else ["user", "assistant"][i % 2]
            text = rng.choice([None, "", "  \n", "same.", "cut off"]) if rng.random() < 0.3 else f"text {rng.randrange(900)}" + rng.choice([".", "!", "?", "", ". \n", ". "])
            rows.append((conv, rng.choice([i, i, i, i, None, i * 2]), role, text))
    rng.shuffle(rows)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = repair(damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), present_col="present").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert len(got) == len({r[0] for r in rows})
    assert {r[0]: tuple(r[1:]) for r in got} == brute_repair(rows)


def test_repair_edges(spark):
    kinds = "conv_id long, turn int, role string, text string, gaps string, cost int, part string"
    assert repair(spark.createDataFrame([], kinds)).count() == 0
    rows = [(1, 0, "user", "Hi.", "x", 1, "y"), (1, 1, "assistant", "Yes.", None, None, None), (2, None, None, None, None, None, None), (3, 5, "user", "a" * 100_000, None, None, None)]
    got = {r[0]: tuple(r[1:-1]) for r in repair(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "KK"), 2: (0, 1, 0, 0, 0, 3, "D"), 3: (0, 0, 0, 1, 0, 3, "D")}
    gone = spark.createDataFrame([(9, 1, "user", "x", False)], "conv_id long, turn long, role string, text string, present boolean")
    assert [tuple(r) for r in repair(gone, present_col="present").collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_query(spark, sf):
    rows = [tuple(r[x] for x in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert {r[0]: tuple(r[1:]) for r in queries.op13_turn_repair(spark, sf).collect()} == brute_repair(rows)
