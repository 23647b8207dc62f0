"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from bandloom.llm import jpeg, media, mixing, packing, queries
from bandloom.llm import suffix_dedup as suffix_module
from bandloom.llm.langid import LANE, Model, fit, held_out, identify, suffix_automaton
from bandloom.llm.line_dedup import line_dedup
from bandloom.llm.mixing import mix, quota_tree, targets
from bandloom.llm.ngram_join import band_plan, jaccard_links, keep_one
from bandloom.llm.packing import fullest, minimum_bin_slack, pack, token_pieces
from bandloom.llm.sharding import kd_shards
from bandloom.llm.suffix_dedup import Prefixes, suffix_dedup, suffix_sort
from bandloom.llm.vector_graph import audit_recall, build_graph, cells_of, near_links, walk
from bandloom.llm.warc import BORDER, assemble, captures, parse_warc, read_warc, write_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, n_lines string, score string, `group` int, key string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long_ = " ".join(f"word{i % 997} the" for i in range(20_000))
    rows = [
        (1, "a b c d e f g h\nx\ny\nz\nlast", "en", "s1"), (2, "a b c d e f g h\nx\ny\nz\nother", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"), (5, "   \n ", None, ""),
        (6, long_, "en", "s2"), (7, long_ + " end", "de", "s2"), (8, "one two", "de", None), (8, "one two", "de", None), (9, "日本語 テスト 12", "fr", "s3"), (None, "no id here at all x", "en", "s3"), (10, "\n\n\n\n\n", "en", "s1"), (11, "x\ny\nz", "en", "s1"),
    ]
    return spark.createDataFrame([(*r, None, 7, "clash", None, 1, "k") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_lines(docs, window=3):
    seen, out = set(), {}
    for key, text in sorted(docs):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - window + 1):
            w = tuple(lines[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


def test_line_dedup(edge, none, spark):
    got = line_dedup(edge)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "score", "group", "key", "n_lines", "n_removed", "n_spans"]
    rows = {r["doc_id"]: r for r in got.collect() if r["doc_id"] not in (None, 8)}
    assert got.count() == edge.count()
    want = brute_lines([(r["doc_id"], r["text"]) for r in edge.collect() if r["doc_id"] not in (None, 8) and r["text"] is not None])
    for key, (text, n) in want.items():
        assert (rows[key]["text"], rows[key]["n_removed"]) == (text, n)
    assert rows[3]["text"] is None and rows[3]["n_lines"] == 0
    assert rows[11]["text"] == "" and rows[11]["n_removed"] == 3
    assert line_dedup(none).count() == 0
    rng = np.random.default_rng(0)
    docs = [(i, "\n".join(rng.choice(list("abc"), rng.integers(1, 30)))) for i in range(40)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_of_repeated_ids(spark):
    """Unique lines under an id that is there twice stay; a repeated window goes from the text that has it."""
    one, two = "a\nb\nc\nd", "e\nf\ng\nh\ni"
    rows = [(1, one), (2, "x\n" + one), (2, two), (2, two), (3, two + "\nz"), (None, one)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"], r["n_removed"]) for r in got) == Counter([(1, one, 0), (2, "x", 4), (2, two, 0), (2, two, 0), (3, "z", 5), (None, one, 0)])


def test_automaton_accepts_all_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    table = suffix_automaton(text, 5)

    def accepted(s):
        state = 1
        for c in s:
            state = table[state, c]
        return state > 0

    assert all(accepted(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
    assert not accepted([2, 2]) and not accepted([3, 3]) and not accepted([4])


def greedy(model, symbols, root):
    """Phrases of one text, symbol by symbol."""
    table, state, n = model.table.reshape(-1, model.width), root, 1
    for place, c in enumerate(symbols):
        if not table[state, c]:  # the phrase can't go on: the next one starts here
            n += place > 0
            state = table[root, c] or root
        else:
            state = table[state, c]
    return n


def test_phrases_are_greedy_longest_matches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs.filter(~held_out("doc_id")), chars=3000)
    texts = [r["text"] for r in docs.collect()]
    # Long texts of many lanes, some of learned text, in which the parses of a lane agree late or never.
    own = max(texts, key=len)
    texts = [*texts[:30], own, own[5:] * 3, "ab" * 4000, "xyzzy " * 900, texts[3], "", "?"]
    symbols, counts = model.symbols(texts)
    assert max(counts) > 8 * LANE
    got, ends = model.phrases(symbols, counts), np.cumsum(counts)
    for i, n in enumerate(counts):
        for k, root in enumerate(model.roots):
            assert got[i, k] == (greedy(model, symbols[ends[i] - n : ends[i]], root) if n else 0)


def test_parses_that_never_agree():
    text = [2, 3] * 40
    one = suffix_automaton(text, 5)
    bits = np.array([np.log2(80)])
    codes = np.ones(256, np.uint8)
    codes[[32, 97, 98, 99]] = 0, 2, 3, 4
    model = Model(["x"], codes, one.reshape(-1).astype(np.int32), np.array([1], np.int32), 5, bits, np.zeros(1), np.ones(1), np.zeros(1))
    for tail in ("", "a", "ab", "abc", "c"):
        symbols, counts = model.symbols(["c" + "ab" * 3000 + tail, "ba" * 2000])
        assert [greedy(model, symbols[: counts[0]], 1), greedy(model, symbols[counts[0] :], 1)] == model.phrases(symbols, counts)[:, 0].tolist()


def test_language(edge, none, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs.filter(~held_out("doc_id")))
    got = identify(docs, model, keep=["doc_id", "lang"]).filter(held_out("doc_id"))
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()
    assert got.filter("bits > most_bits").count() == 0
    rows = identify(edge, model)
    assert rows.columns[-4:] == ["lang_pred", "score", "bits", "most_bits"] and rows.columns.count("score") == 1
    by = {r["doc_id"]: r for r in rows.collect()}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == by[10]["lang_pred"] == "und" and by[3]["score"] == 0
    assert by[9]["lang_pred"] in model.langs and all(0 <= r["score"] <= 1 for r in by.values())
    assert identify(none, model).count() == 0


def test_language_of_nothing_learned(none, edge):
    model = fit(none)
    assert model.langs == [] and identify(none, model).count() == 0
    assert {r["lang_pred"] for r in identify(edge, model).collect()} == {"und"}


def test_language_alphabet_is_complete(spark):
    """A language of over 250 letters keeps them apart, und is a label like others, long texts are learned whole or not at all."""
    rng = np.random.default_rng(3)
    one, two = ([chr(base + i) for i in range(400)] for base in (0x4E00, 0x5E00))
    write = lambda letters, n: "".join(rng.choice(letters, n))
    rows = [(i, write(one, 300), "zh") for i in range(20)] + [(100 + i, write(two, 300), "und") for i in range(20)] + [(200, write(one, 50_000), "zh"), (201, "x" * 40_000, "long")]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["long", "und", "zh"]
    assert model.predict([write(one, 200), write(two, 200), "xxxx"])[0] == ["zh", "und", "long"]
    seen = {c for t in (rows[0][1], rows[25][1]) for b in t for c in b.encode()}
    assert (model.codes[list(seen)] > 1).all()


def test_targets():
    assert targets([100, 100, 100], [1, 2, 3], 300) == [50, 100, 150]
    got = targets([10, 1000, 10], [1, 2, 3], 1020)
    assert got == [30, 960, 30]
    assert targets([0, 5], [1, 2], 5) == [0, 5] and targets([], [], 0) == []


def test_quota_tree_keeps_every_quota():
    tree = quota_tree([1000, 10, 0, 333], 7, 3)
    assert tree.sum(0).tolist() == [1000, 10, 0, 333]
    assert tree.sum(1).max() - tree.sum(1).min() <= 3
    assert (quota_tree([5, 6], 4, 1) == quota_tree([5, 6], 4, 1)).all()


def test_mix(edge, none, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    draws, plan = mix(docs)
    per = draws.groupBy("source").agg(F.sum("size").alias("taken"), F.first("target").alias("target")).collect()
    most = draws.agg(F.max("size")).first()[0]
    assert all(abs(r["taken"] - r["target"]) <= most for r in per)
    assert draws.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert plan.agg(F.sum("target")).first()[0] == pytest.approx(plan.agg(F.sum("source_size")).first()[0])
    assert draws.select("shard").distinct().count() == 8
    again = mix(docs)[0]
    assert draws.select("doc_id", "copy", "shard", "rank").exceptAll(again.select("doc_id", "copy", "shard", "rank")).count() == 0
    draws, plan = mix(edge)
    assert plan.count() == 5 and plan.orderBy(F.col("source").asc_nulls_last()).collect()[-1]["source"] is None
    assert draws.columns.count("size") == 1 and draws.groupBy("source").agg(F.sum("size").alias("s")).count() >= 3
    assert mix(none)[0].count() == 0


def test_mix_comes_out_of_its_shards(spark, sf, monkeypatch):
    """What a document gives is the sum over the shards' draws, and another tree makes other shards."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_source_mix(spark, sf).collect()
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text"), mixing.words("text").alias("size"))
    draws = mix(sized, size_col="size")[0].select("doc_id", "shard", "size").collect()
    own = Counter()
    for r in draws:
        own[r["doc_id"]] += r["size"]
    assert len(got) == docs.count() and all(r["taken"] == len(r["draws"]) * r["size"] == own[r["doc_id"]] for r in got)
    monkeypatch.setattr(mixing, "quota_tree", lambda quotas, shards, seed: np.array([quotas] + [[0] * len(quotas)] * (shards - 1)))
    assert {d["shard"] for r in queries.op3_source_mix(spark, sf).collect() for d in r["draws"]} == {0}


def test_mix_draws_every_row_by_itself(spark):
    """Null ids keep their share; of rows that repeat an id each is drawn or not, so no target is missed by more than a row."""
    rows = [(None, "a b c", "x"), (None, "d e", "x"), (1, "f " * 10, "x"), (1, "g " * 6, "x"), (1, "f " * 10, "x"), (2, "h " * 90, "y"), (3, None, "y")]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.draw(made)[0].collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["size"] * len(r["draws"])
    target = {r["source"]: r["target"] for r in got}
    assert target == pytest.approx({"x": 121 / 3, "y": 242 / 3})
    assert abs(taken["x"] - target["x"]) <= 10 and abs(taken["y"] - target["y"]) <= 90
    assert all(len(r["draws"]) >= 1 for r in got if r["source"] == "x")  # a target above the size: each is there once at least


def brute_links(docs, n=5, bound=0.8):
    grams = {}
    for key, text in docs:
        w = [x for x in (text or "").replace("\n", " ").split(" ") if x]
        grams[key] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    keys, root = sorted(grams), {k: k for k in grams}
    links = dict.fromkeys(keys, 0)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if grams[a] and grams[b] and len(grams[a] & grams[b]) * 5 >= len(grams[a] | grams[b]) * 4:
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                for k in keys:
                    if root[k] in (x, y):
                        root[k] = min(x, y)
    return {k: (root[k], links[k]) for k in keys}


def test_ngram_join(edge, none, spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 400, 120)] for _ in range(12)]
    docs = []
    for i in range(90):
        words = list(base[i % 12])
        for _ in range(rng.integers(0, 7)):
            words[rng.integers(0, 120)] = f"n{rng.integers(0, 9999)}"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, docs[0][1]) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_links(docs)
    for block in (192, 4):
        got = {r["id"]: (r["class_id"], r["n_links"]) for r in jaccard_links(df, block=block).collect()}
        assert got == want
    assert keep_one(df).count() == len({c for c, _ in want.values()})
    got = {r["id"]: r for r in jaccard_links(edge).collect()}
    assert got[7]["class_id"] == 6 and got[6]["n_links"] == 1 and got[3]["n_links"] == 0 and got[4]["class_id"] == 4 and got[8]["n_links"] == 1
    assert None not in got and keep_one(edge).filter("doc_id is null").count() == 1
    assert jaccard_links(none).count() == 0


def test_ngram_join_of_repeated_ids(spark):
    """Texts under one id are rows of their own: each has its own class, and one that is a copy goes alone."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (3, b + " end"), (4, None), (4, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_links(df).collect())) == Counter([(1, 1, 1), (2, 1, 1), (2, 2, 2), (2, 2, 2), (3, 2, 2), (4, 4, 0), (4, 4, 0)])
    assert Counter((r["doc_id"], r["text"]) for r in keep_one(df).collect()) == Counter([(1, a), (2, b), (2, b), (4, None), (4, "alone here")])


def test_band_plan_meets_recall():
    for recall in (0.9, 0.99, 0.999):
        bands, rows = band_plan(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall


def test_fullest_against_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(50):
        items = rng.integers(1, 40, 9).tolist()
        room = int(rng.integers(1, 90))
        counts = {x: items.count(x) for x in items}
        got = fullest(sorted(counts, reverse=True), counts, room)
        best = max(s for m in range(512) if (s := sum(x for k, x in enumerate(items) if m >> k & 1)) <= room)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_packing(edge, none, spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edge.filter("doc_id > 2").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    pieces = token_pieces(docs, path, with_ids=True).cache()
    tok = Tokenizer.from_file(path)
    for r in docs.dropDuplicates(["doc_id"]).collect():
        want = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces.filter(F.col("id") == r["doc_id"]).dropDuplicates(["id", "piece"]).collect(), key=lambda p: p["piece"]) if r["doc_id"] % 40 == 0 or r["doc_id"] > 10**6 else None
        if own is not None:
            assert [x for p in own for x in p["ids"]] == want and [p["start"] for p in own] == list(range(0, len(want), 4096))
            assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in own)
    packed = pack(pieces.drop("ids")).toPandas()
    assert len(packed) == pieces.count()
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1].tolist()] and g["length"].sum() <= 4096
    assert packed["sequence_id"].nunique() <= -(-int(packed["length"].sum()) // 4096) + 2
    assert pack(token_pieces(none, path)).count() == 0


def test_ids_are_the_tokenizers(spark):
    """Odd letters, marks, contractions, special tokens and a table that forgets: as the tokenizer itself gives them."""
    import public_tokenizers
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, ids, rng = Tokenizer.from_file(path), packing._Ids(path, most=500), np.random.default_rng(8)
    marks = [*"abDEFßéÖçİıſKÅǅªºµĿŉǰΣς中ひ🙂١2'’-.,!<>|_\"\\/́ \x1c\x85 \t\n", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "the", "And"]
    for _ in range(40):
        texts = ["".join(rng.choice(marks, rng.integers(0, 40))) for _ in range(40)]
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(texts)))
        flat = split.flatten().dictionary_encode()
        pool, begin, sizes = ids.of(flat.dictionary)
        at, ends = flat.indices.to_numpy(), split.offsets.to_numpy()
        for i, text in enumerate(texts):
            assert [int(x) for k in at[ends[i] : ends[i + 1]] for x in pool[begin[k] : begin[k] + sizes[k]]] == tok.encode(text, add_special_tokens=False).ids
    assert len(ids.words) < 2000
    made = token_pieces(spark.createDataFrame([(1, "hello <|endoftext|> w")], "doc_id long, text string"), path, with_ids=True).first()
    assert made["ids"] == [*tok.encode("hello <|endoftext|> w", add_special_tokens=False).ids, 1]


def test_minimum_bin_slack_fills_exactly():
    bins, offsets, n = minimum_bin_slack(np.array([6, 5, 4, 3, 2]), 10)
    assert n == 2 and sorted(np.bincount(bins, [6, 5, 4, 3, 2]).tolist()) == [10, 10]


def brute_cover(docs, w=100):
    seen, out = {}, {}
    for key, text in sorted(docs):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - w + 1):
            if seen.setdefault(b[p : p + w], (key, p)) != (key, p):
                gone[p : p + w] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[key] = len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("hot", [512, 3])
def test_suffix_dedup(spark, hot):
    rng = np.random.default_rng(1)
    word = lambda a, n: "".join(rng.choice(list(a), n))
    common = word("abcdefgh", 150)
    docs = [(i, word("ab", rng.integers(0, 300))) for i in range(20)] + [(30, "a" * 700), (31, "xyz" * 150), (32, None), (33, ""), (34, "é" * 130), (35, "xyz" * 60 + "q" + "xyz" * 60), (36, "a" * 99)]
    docs += [(100 + i, word("abcdefgh", rng.integers(50, 250)) + common + word("abcdefgh", rng.integers(50, 250))) for i in range(30)]
    docs += [(200, docs[-1][1]), (201, docs[-1][1])]
    got = suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot, with_kept=True).collect()
    assert {r["id"]: tuple(r)[1:5] for r in got} == brute_cover(docs)
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(b - a for a, b in r["spans"]) == r["n_removed"]


def test_suffix_dedup_of_texts_made_to_collide(spark):
    """Thue-Morse strings of 1,024 letters have one polynomial hash modulo 2**64 with their complements."""
    letters = np.random.default_rng(6).integers(97, 123, 1600).astype(np.uint8).tobytes().decode()
    turn = [i.bit_count() % 2 for i in range(1024)]
    x, y = ("".join("ab"[b ^ flip] for b in turn) for flip in (0, 1))
    docs = [(1, letters[:800] + x + letters[800:]), (2, letters[:800] + y + letters[800:])]
    x, y = (Prefixes(np.frombuffer(s.encode(), np.uint8)) for s in (x, y))
    assert x.hash(np.array([0]), 1024) == y.hash(np.array([0]), 1024)
    docs += [(3, docs[1][1]), (4, docs[0][1])]  # true copies of both are found all the same
    for window in (1100, 1500):
        got = suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string"), window=window).collect()
        assert {r["id"]: tuple(r)[1:5] for r in got} == brute_cover(docs, window)


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup_of_forged_block_hashes(spark, hot):
    """Blocks that only seem to be equal: their bytes are compared, and they are resolved like any others."""
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    first, shared = word(900), word(300)
    docs = {1: first + shared, 2: word(500) + shared + word(400), 3: first[:400] + word(30) + first[430:] + shared}
    batch = lambda rows, kinds: iter([pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[str(i) for i in range(len(kinds))])])
    zip_ = lambda t: zstandard.compress(t.encode())
    pair = pa.list_(pa.struct([("start", pa.int32()), ("m", pa.int32()), ("pid", pa.int64()), ("ph", pa.int64()), ("ps", pa.int32())]))
    claims = [(k, k, [{"start": i, "m": 100, "pid": 1, "ph": 1, "ps": i} for i in range(0, 900, 100)], zip_(docs[k])) for k in (2, 3)]
    asked = [r for b in suffix_module._copies(100)(batch(claims, [pa.int64(), pa.int64(), pair, pa.binary()])) for r in b.to_pylist()]
    assert len(asked) == 2  # touching pairs go as one stretch
    part = pa.list_(pa.struct([("id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("ps", pa.int32()), ("part", pa.binary())]))
    checked = [r for b in suffix_module._verify(100)(batch([(1, 1, asked, zip_(docs[1]))], [pa.int64(), pa.int64(), part, pa.binary()])) for r in b.to_pylist()]
    assert {r["kind"] for r in checked} == {2}  # no byte goes by the claim
    rows = sorted(checked, key=lambda r: r["kg"])
    columns = ["kind", "kg", "id", "h", "start", "m", "off", "block"]
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    blocks = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds, strict=True)], names=columns)
    gone = {k: np.zeros(len(t), bool) for k, t in docs.items()}
    for b in suffix_module._resolve(100)(iter([blocks])):
        for r in b.to_pylist():
            gone[r["id"]][r["start"] : r["start"] + r["m"]] = True
    want = brute_cover([(k, t[:999]) for k, t in docs.items()])
    assert {k: int(x[:999].sum()) for k, x in gone.items()} == {k: v[1] for k, v in want.items()}


def test_suffix_dedup_of_repeated_ids(spark):
    """Two texts of one id are two texts; rows that repeat both are one."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    a, b, c = word(300), word(400), word(350)
    docs = [(1, a), (2, b), (2, c), (2, c), (3, a + b), (None, a), (5, c)]
    got = suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r["id"], r["n_bytes"], r["n_removed"]) for r in got) == Counter([(1, 300, 0), (2, 400, 0), (2, 350, 0), (2, 350, 0), (3, 700, 700), (None, 300, 0), (5, 350, 350)])


def test_suffix_dedup_edges(edge, none):
    rows = suffix_dedup(edge).collect()
    assert len(rows) == edge.count()
    by = {r["id"]: r for r in rows}
    assert by[3]["n_bytes"] == by[3]["n_removed"] == 0 and by[None]["n_removed"] == 0 and by[7]["n_removed"] > 0.9 * by[7]["n_bytes"]
    assert suffix_dedup(none).count() == 0


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    at = rng.permutation(350)
    group = np.sort(rng.integers(0, 5, 350))
    order = suffix_sort(Prefixes(data), data, at, group, 20)
    keys = [(group[i], data[at[i] : at[i] + 20].tobytes()) for i in order]
    assert keys == sorted(keys)


def scalar_decode(raw):
    """Coefficients of a 4:2:0 progressive JPEG, read bit by bit as the standard describes it; and how often each kind of code was met."""
    at, tables, restart, comps, out, met = 2, {}, 0, {}, {}, Counter()
    while raw[at + 1] != 0xD9:
        marker, n = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC4:
            while body:
                code, k, own = 0, 17, {}
                for length in range(1, 17):
                    for _ in range(body[length]):
                        own[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]], body = own, body[k:]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])}
            assert list(comps.values()) == [(2, 2), (1, 1), (1, 1)]
            out = {c: np.zeros((height * v // 16 * (width * h // 16), 64), int) for c, (h, v) in comps.items()}
        elif marker == 0xDA:
            c, lo, hi, high, low = body[1], body[3], body[4], body[5] >> 4, body[5] & 15
            table = tables[body[2] >> 4 if lo == 0 else 0x10 | body[2] & 15]
            pred = eob = 0
            bits = iter(())

            def interval():
                nonlocal at
                while True:
                    b = raw[at]
                    if b == 0xFF and raw[at + 1]:
                        return
                    at += 2 if b == 0xFF else 1
                    yield from (b >> i & 1 for i in range(7, -1, -1))

            def take(n):
                v = 0
                for _ in range(n):
                    v = v << 1 | next(bits)
                return v

            def symbol():
                length = code = 0
                while (length, code) not in table:
                    length, code = length + 1, code << 1 | next(bits)
                return table[length, code]

            def extend(s):
                v = take(s)
                return v if not s or v >> (s - 1) else v - (1 << s) + 1

            for nth, block in enumerate(out[c]):
                if nth % restart == 0:
                    if nth:
                        assert raw[at] == 0xFF and raw[at + 1] == 0xD0 + (nth // restart - 1) % 8
                        at += 2
                    bits, pred, eob = interval(), 0, 0
                if lo == 0:
                    pred += extend(symbol())
                    block[0] = pred << low
                    continue
                k = lo
                while k <= hi and not eob:
                    s = symbol()
                    r, s = s >> 4, s & 15
                    if not s and r < 15:
                        met["end"] += 1
                        eob = (1 << r) + take(r)
                        break
                    met["sixteen" if not s else "run" if r else "plain"] += 1
                    value = (extend(s) << low) if s else 0
                    while k <= hi:
                        if high and block[k]:
                            block[k] += np.sign(block[k]) * (take(1) << low)
                        elif r:
                            r -= 1
                        else:
                            block[k] = value
                            k += 1
                            break
                        k += 1
                if eob:
                    for k in range(k, hi + 1):
                        if high and block[k]:
                            block[k] += np.sign(block[k]) * (take(1) << low)
                    eob -= 1
            assert all(bits)  # only ones fill the last byte
    return [out[c] for c in comps], met


def payloads_for_jpeg():
    rng = np.random.default_rng(0)
    made = [rng.integers(0, 256, 64 * n).astype(np.uint8).tobytes() for n in (1, 2, 6, 7, 100)] + [b"\xff" * 640, bytes(64), bytes(1280) + b"a" * 64 + bytes(640)]
    made += [np.where(rng.random(6400) < q, rng.integers(97, 122, 6400), 97).astype(np.uint8).tobytes() for q in (0.01, 0.05, 0.3)]
    return [*made, (b"The quick brown fox jumps over the lazy dog. " * 64)]


def test_jpeg_against_a_scalar_decoder():
    met = Counter()
    for raw, image in ((s, jpeg.parse(s)) for s in jpeg.encode(payloads_for_jpeg())):
        want, kinds = scalar_decode(raw)
        met += kinds
        got = jpeg.decode([image])[0]
        assert all((a == b).all() for a, b in zip(want, got, strict=True))
    assert min(met[k] for k in ("end", "sixteen", "run", "plain")) > 20


def test_huffman_codes_are_prefix_free():
    for counts, symbols, codes, sizes in (jpeg.DC, jpeg.AC, jpeg.REFINE, jpeg.huffman({k: 3.0**-k for k in range(60)})):
        told = [format(codes[s], f"0{sizes[s]}b") for s in symbols]
        assert sum(counts) == len(symbols) and max(map(len, told)) <= 16 and all("0" in t for t in told)
        assert not any(b.startswith(a) for a, b in zip(sorted(told), sorted(told)[1:], strict=False))


def test_jpeg_round_trip_and_any_batch():
    payloads = payloads_for_jpeg()
    streams = jpeg.encode(payloads)
    images = [jpeg.parse(s) for s in streams]
    coefs = jpeg.decode(images)
    assert [media.payload_of(i, c) for i, c in zip(images, coefs, strict=True)] == payloads
    alone = jpeg.encode(payloads[3:4])
    assert alone == streams[3:4]
    one = jpeg.parse(alone[0])
    tensor = jpeg.rgb(one, jpeg.samples([one], jpeg.decode([one]))[0])
    assert (tensor == jpeg.rgb(images[3], jpeg.samples(images, coefs)[3])).all() and tensor.shape == (one.height, one.width, 3)
    with pytest.raises(ValueError):
        jpeg.parse(b"GIF89a")


def test_inverse_transform_of_flat_and_cosine():
    coefs = np.zeros((2, 64), np.int16)
    coefs[0, 0], coefs[1, 1] = 80, 100
    pix = jpeg._inverse(coefs, np.ones(64))
    assert (pix[0] == 138).all()
    want = 128 + 100 / 4 * np.sqrt(0.5) * np.cos((2 * np.arange(8) + 1) * np.pi / 16)
    assert np.abs(pix[1].reshape(8, 8) - want).max() <= 0.5


def test_general_refinement_with_new_coefficients():
    """A hand-written stream: runs over zeros, new coefficients and corrections, without restarts."""
    rng = np.random.default_rng(9)
    final = np.where(rng.random((3, 64)) < 0.3, rng.integers(-7, 8, (3, 64)), 0)
    final[:, 0] = 0
    first = np.sign(final) * (np.abs(final) >> 1)
    bits: list[str] = []
    table = {s: i for i, s in enumerate([r << 4 | s for r in range(16) for s in range(4)])}
    put = lambda sym: bits.append(format(table[sym], "07b"))

    def ends() -> bytes:
        s = "".join(bits)
        s += "1" * (-len(s) % 8)
        bits.clear()
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")

    for b in first:
        run = 0
        for k in range(1, 64):
            v = int(b[k])
            if not v:
                run += 1
                continue
            while run > 15:
                put(0xF0)
                run -= 16
            s = abs(v).bit_length()
            put(run << 4 | s)
            bits.append(format(v if v > 0 else v + (1 << s) - 1, f"0{s}b"))
            run = 0
        if run:
            put(0)
    one = ends()
    for b, f in zip(final, first, strict=True):
        run, tail = 0, []
        news = [k for k in range(1, 64) if abs(b[k]) == 1]
        last = max(news, default=0)
        for k in range(1, 64):
            v = abs(int(b[k]))
            if v > 1:
                tail.append(str(v & 1))
                continue
            if v == 0 and k < last:
                run += 1
                if run == 16:
                    put(0xF0)
                    bits.extend(tail)
                    tail, run = [], 0
            elif v == 1:
                put(run << 4 | 1)
                bits.append("1" if b[k] > 0 else "0")
                bits.extend(tail)
                tail, run = [], 0
        put(0)
        bits.extend(tail)
    two = ends()
    seg = jpeg._segment
    dht = seg(0xC4, bytes([0x10, *[0] * 6, 64, *[0] * 9, *table]))
    frame = seg(0xC2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0]))
    scan = lambda a, b, data: seg(0xDA, bytes([1, 1, 0, 1, 63, a << 4 | b])) + data
    raw = b"\xff\xd8" + seg(0xDB, bytes([0, *[1] * 64])) + frame + dht + scan(0, 1, one) + scan(1, 0, two) + b"\xff\xd9"
    image = jpeg.parse(raw)
    assert (jpeg.decode([image])[0][0] == final).all()


def test_media_column(edge, none):
    got = media.decode_media(media.encode_media(edge), with_tensor=True).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in edge.collect()}
    assert len(got) == edge.count()
    for r in got:
        raw = texts[r["id"]]
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["payload"] == full and r["n_bytes"] == len(raw) and r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-64:])
        assert len(r["tensor"]) == r["height"] * r["width"] * 3
    twice = [tuple(r)[2:8] for r in got if r["id"] == 8]
    assert twice[0] == twice[1]
    assert media.decode_media(media.encode_media(none)).count() == 0


def test_media_and_tensors_are_stored(spark, tmp_path):
    from bandloom.llm.queries import op7_progressive_jpeg

    spark.createDataFrame([(1, "some text"), (2, "x" * 500), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.iterdir())
    got = {r["doc_id"]: r for r in op7_progressive_jpeg(spark, str(tmp_path)).collect()}
    new = {p.name.split("-")[0]: str(p) for p in set(root.iterdir()) - before}
    assert set(new) == {"media"}
    assert {r["id"]: len(r["media"]) for r in spark.read.parquet(new["media"]).collect()} == {k: r["media_bytes"] for k, r in got.items()}
    for r in got.values():  # the result holds the tensors, so whoever writes it stores them
        assert len(r["tensor"]) == r["height"] * r["width"] * 3 and r["feature"].endswith(f"{zlib.crc32(r['tensor']):08x}")


def test_equal_pieces_are_spread_over_groups(spark):
    """Rows equal in all columns go to many groups, and no token is lost."""
    pieces = spark.createDataFrame([(None, 0, 0, 1, 7)] * 3000 + [(i, 0, 0, 900 + i, i) for i in range(200)], "id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    got = pack(pieces, 4096, group_rows=256).collect()
    per = Counter(r["sequence_id"] >> 32 for r in got)
    assert len(got) == 3200 and len(per) == 13 and max(per.values()) < 400
    for key in {r["sequence_id"] for r in got}:
        at = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == key)
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) <= 4096


def test_language_of_long_rows(spark):
    """A language whose rows are all longer than the bound is learned from stretches of them, within the bound on automata."""
    rng = np.random.default_rng(3)
    words = {"aa": ["tala", "mero", "sanu", "vilo"], "bb": ["krush", "stropf", "zwelk", "gratz"]}
    rows = [(i, " ".join(rng.choice(words[lang], 3000)), lang) for i, lang in enumerate(["aa", "bb"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (256_000_000, 400_000):
        model = fit(docs, chars=2000, most_bytes=most)
        assert model.langs == ["aa", "bb"] and model.table.nbytes <= most
        assert all(r["lang"] == r["lang_pred"] and r["bits"] <= r["most_bits"] for r in identify(docs, model).collect())


def test_near_links(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows, k = [], 0
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * 0.12
        rows.append((k, [float(x) for x in v], i % 3))
        k += 1
    rows += [(k, rows[0][1], rows[0][2]), (k + 1, [2 * x for x in rows[1][1]], rows[1][2]), (k + 2, None, 0), (k + 3, [0.0] * 16, 0), (k + 4, [float("nan")] * 16, 0), (k + 5, rows[0][1], None), (k + 6, [1.0] * 15 + [None], 0), (k + 7, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [r for r in rows if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    x = np.stack([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in good])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    low = np.arange(len(good))
    for _ in range(len(good)):
        low = np.minimum(low, np.where(link, low[None, :], 10**9).min(1))
    want = {r[0]: (0, r[0], True) for r in rows} | {good[i][0]: (int(link[i].sum()), good[low[i]][0], low[i] == i) for i in range(len(good))}
    for size in (60,):
        got = near_links(df, shard_rows=size, overlap=3)
        assert got.count() == len(rows)
        hit = sum(min(r["n_links"], want[r["id"]][0]) for r in got.collect())
        assert hit >= 0.97 * sum(w[0] for w in want.values())
        assert all(r["n_links"] <= want[r["id"]][0] for r in got.collect())
    whole = near_links(df).cache()  # one shard a label
    got = {r["id"]: tuple(r)[1:] for r in whole.collect()}
    assert sum(got[k][0] for k in want) >= 0.99 * sum(w[0] for w in want.values()) and {k: g for k, g in got.items() if want[k][0] == 0} == {k: w for k, w in want.items() if w[0] == 0}
    told = audit_recall(df.filter("size(embedding) = 16 and vec_id < 402"), every=5, result=whole).first()
    assert told["wanted"] > 100 and told["recall"] >= 0.9 and told["queries"] > 50
    assert near_links(df.limit(0)).count() == 0


def brute_counts(x, label):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    return link.sum(1)


def test_near_links_of_a_cluster_with_many_pivots(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(900, 16)) * 0.14, rng.normal(size=(600, 16))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = brute_counts(x, np.zeros(len(x)))
    assert want.sum() > 100_000
    for rows in (60, 2000):  # the cluster is blocks of its own, or lies in one cell
        got = {r["id"]: r["n_links"] for r in near_links(df, shard_rows=rows).collect()}
        n = np.array([got[i] for i in range(len(x))])
        assert (n <= want).all() and n.sum() >= 0.98 * want.sum()


def test_near_links_in_many_small_groups(spark):
    """Groups without a pivot of their own, over several levels of cells: the recall of links that exist is measured."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(700, 64))
    x = base[rng.integers(0, 700, 2400)] + rng.normal(size=(2400, 64)) * rng.choice([0.03, 0.1], (2400, 1))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = brute_counts(x, np.zeros(len(x)))
    assert want.sum() > 4000
    got = {r["id"]: r["n_links"] for r in near_links(df, shard_rows=150, fan=12).collect()}
    n = np.array([got[i] for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.9 * want.sum()


def test_cells_grow_with_the_table_not_with_its_square(spark):
    """Four and sixteen times as many vectors of one label: a vector goes to hardly more cells."""
    rng, per = np.random.default_rng(7), []
    x = rng.normal(size=(6400, 32))
    for n in (400, 1600, 6400):
        reps = spark.createDataFrame([("s", b"%05d" % i, 1, x[i].tolist()) for i in range(n)], "space string, node binary, n long, v array<double>")
        per.append(cells_of(reps, float(np.arccos(0.98)), 200, 32, 2, 3.0).count() / n)
    assert per[2] < 2.5 * per[1] and per[1] < 2.5 * per[0] * 2


def test_graph_is_searched_not_compared(spark):
    """Greedy walks visit a part of a shard's nodes, and find the links of a tight cluster and of pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 32))
    x[:60] = x[0] + rng.normal(size=(60, 32)) * 0.1
    x[500:600] = x[400:500] + rng.normal(size=(100, 32)) * 0.05
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    links, starts = build_graph(x)
    assert len(links[0]) == 901 and not (np.repeat(np.arange(900), np.diff(links[0])) == links[1]).any()
    sims = walk(x, links, np.arange(900), starts, 24, float(np.cos(1.4 * np.arccos(0.98))))
    true = x @ x.T >= 0.98
    found = np.isfinite(sims) & true
    assert (found | found.T)[true].mean() >= 0.98 and np.isfinite(sims).mean() < 0.6


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1200 + "é\r\n\r\nWARC/1.1</p>"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c\r\nX: y", None), (5, "http://d", ""), (6, "http://e", "short"), (7, "http://f", "short"), (8, "u", "y" * 2000), (8, "u", "y" * 2000), (9, "v", "in\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx\r\n\r\n"), (None, "n", "z" * 1500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    write_warc(df, path)
    got = captures(spark, path, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got if r["page_id"] != 8}
    raw = big.encode()
    assert by[3]["record_type"] == "response" and by[3]["payload"] == raw
    assert {by[k]["record_type"] for k in (1, 2)} == {"revisit"} and {by[k]["refers_to"] for k in (1, 2)} == {by[3]["record_id"]}
    assert all(r["digest"] == hashlib.sha1(raw).hexdigest() and r["payload_bytes"] == len(raw) for r in (by[1], by[2], by[3]))
    assert by[6]["record_type"] == by[7]["record_type"] == "response" and by[4]["payload_bytes"] == by[5]["payload_bytes"] == 0
    assert sorted(r["record_type"] for r in got if r["page_id"] == 8) == ["response", "revisit"]
    assert all(r["request"]["record_id"].endswith(":request") and r["metadata"]["record_id"].endswith(":metadata") for r in got)
    records = read_warc(spark, path)
    assert records.count() == 3 * len(rows)
    lone = assemble(records.filter("record_type <> 'request'")).collect()
    assert len(lone) == len(rows) and all(r["request"] is None for r in lone)
    empty = str(tmp_path / "none")
    write_warc(df.limit(0), empty)
    assert captures(spark, empty).count() == 0
    record = lambda block, n=None: b"1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n" % (len(block) if n is None else n) + block
    blocks = [b"", b"ab", b"in\r\n\r\nWARC/1.1\r\nside\r\n\r\nWARC/", b"\r\n\r\n"]
    for cut in ([("f", x) for x in (b"WARC/" + BORDER.join(map(record, blocks)) + b"\r\n\r\n").split(BORDER)],):
        assert [b for _, b in parse_warc(iter([*cut, ("g", b"WARC/" + record(b"z"))]))] == [*blocks, b"z"]
    missed = [("f", b"WARC/" + BORDER.join(map(record, blocks)) + b"\r\n\r\n")]  # no border was seen
    assert [b for _, b in parse_warc(iter(missed))] == blocks
    for bad in ([("f", b"junk")], [("f", b"WARC/" + record(b"ab", 9))], [("f", b"WARC/" + record(b"ab", 9)), ("g", b"WARC/" + record(b"z"))], [("f", b"WARC/" + record(b"abc", 1))]):
        with pytest.raises(ValueError):
            list(parse_warc(iter(bad)))


def test_kd_shards(edge, none, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = kd_shards(docs, 8).toPandas()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(s == len(texts[i].encode()) + 1 and c == zlib.crc32(texts[i].encode()) for i, s, c in zip(got["id"], got["size"], got["text_crc32"], strict=True))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() - total.min() <= 2 * got["size"].max()
    got["text"] = got["id"].map(texts)
    assert got.groupby("text")["shard"].nunique().max() == 1
    hot = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 7 + 1)) for i in range(900)], "doc_id long, text string")
    total = kd_shards(hot, 8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(total) == 8 and total.max() <= 1.1 * total.mean()
    rows = kd_shards(edge, 3).collect()
    assert len(rows) == edge.count() and {r["id"]: r["size"] for r in rows}[3] == 1
    assert kd_shards(none).count() == 0
