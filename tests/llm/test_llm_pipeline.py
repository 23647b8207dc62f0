"""The corpus pipeline: every stage against what its operator promises, on all rows of a small table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from bandloom.llm.common import connected_components, map_groups, read, table
from test_llm_operators import brute_lines, brute_links


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = read(spark, sf, "documents"), []
    odd = docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit(" 12 ...").alias("text"), "lang", "source", F.lit(7).cast("long").alias("n_chars"))
    docs = docs.unionByName(odd).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1).withColumn("text", F.lit(None).cast("string")))
    out.append(("documents", table(docs, "test")))
    for name, stage in P.STAGES:
        out.append((name, table(stage(spark, out[-1][1], sf), "test")))
    return dict(out)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stage_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "source_mix", "best_fit_pack"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == P.COLUMNS


def test_language_stage_rejects_only_texts_without_language(stages):
    before, after = texts(stages["documents"]), texts(stages["language_id"])
    assert set(before) - set(after) == {10**6, 10**6 + 1}
    assert stages["language_id"].join(stages["documents"].select("doc_id", F.col("lang").alias("was")), "doc_id").filter("lang <> was").count() == 0


def test_line_stage_is_brute_force(stages):
    want = brute_lines(texts(stages["language_id"]).items())
    kept = {k: t for k, (t, n) in want.items() if t or not n}
    assert texts(stages["line_dedup"]) == kept
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"].collect())


def test_near_duplicate_stage_keeps_one_of_each_class(stages):
    docs = texts(stages["line_dedup"])
    classes = brute_links([(k, t.replace("\t", " ")) for k, t in docs.items()])
    assert set(texts(stages["ngram_jaccard"])) == {c for c, _ in classes.values()}


def test_mix_stage_draws_towards_targets(stages):
    from bandloom.llm.mixing import mix

    draws, _ = mix(stages["ngram_jaccard"])
    assert Counter(r["doc_id"] for r in draws.collect()) == Counter(r["doc_id"] for r in stages["source_mix"].collect())
    per = draws.groupBy("source").agg(F.sum("size").alias("taken"), F.first("target").alias("target")).collect()
    most = draws.agg(F.max("size")).first()[0]
    assert all(abs(r["taken"] - r["target"]) <= most for r in per)


def test_pack_stage_holds_every_drawn_row(stages):
    drawn, packed = Counter(r["doc_id"] for r in stages["source_mix"].collect()), stages["best_fit_pack"].toPandas()
    assert Counter(packed[packed["piece"] == 0]["doc_id"]) == drawn
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1].tolist()] and g["length"].sum() <= 4096


def test_run_and_registration(spark, sf, stages):
    assert P.ORACLE_SQL is None and __spark_entry__.queries()["pipeline"] is P.run
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert P.run(spark, sf).columns == stages["best_fit_pack"].columns


def test_stages_of_nothing(spark, sf, tmp_path):
    none = read(spark, sf, "documents").limit(0)
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, none, sf)
        assert got.columns == P.COLUMNS and got.count() == 0
    assert P.STAGES[-1][1](spark, none, sf).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_with_odd_rows(spark, sf):
    """Null columns, empty and equal texts, one id on two texts, and extra columns with clashing names."""
    long_ = "the " * 3000 + "end of it"
    own = read(spark, sf, "documents").filter("lang = 'en'").first()["text"]
    rows = [(1, own, "en", "a", 1), (1, own, "en", "a", 1), (1, "line one\nline two\nline three\nand four", None, None, None), (None, own + " more", None, "b", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, long_, "xx", "", 9)]
    docs = spark.createDataFrame([(*r, 5, "clash", 0.5, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, n_lines string, score double, shard string")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == P.COLUMNS
    kept = [(r["doc_id"], r["text"]) for r in P.language_id(spark, docs, sf).collect()]
    assert (2, None) not in kept and (3, "") not in kept and kept.count((1, own)) == 2 and (None, own + " more") in kept
    lines = [(r["doc_id"], r["text"]) for r in P.dedup_lines(spark, docs, sf).collect()]
    assert (1, "line one\nline two\nline three\nand four") in lines and (2, None) in lines and (None, own + " more") in lines
    assert Counter(r["doc_id"] for r in P.pack_sequences(spark, docs, sf).filter("piece = 0").collect()) == Counter(r[0] for r in rows)


def test_helpers(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a % 50 <> 49")
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert all(c == n // 50 * 50 for n, c in got.items()) and len(got) == 200
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    sums = map_groups(rows, ["k"], lambda g: g.groupby("k", as_index=False).agg(n=("id", "size")), "k long, n long")
    assert {r["k"]: r["n"] for r in sums.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}
