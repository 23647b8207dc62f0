"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, source mixing, best-fit packing.

Each stage reads the table that the stage before wrote. All but the last return the columns of
``documents``; the last returns one row a packed piece. Stages that hand texts to Python do so in
Arrow batches of 4 MB, and Python workers give back what a stage has freed, so that an executor's
memory doesn't climb from stage to stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm.common import read, small_batches, table
from bandloom.llm.langid import fit, held_out, identify
from bandloom.llm.line_dedup import line_dedup
from bandloom.llm.mixing import in_order, mix
from bandloom.llm.ngram_join import keep_one
from bandloom.llm.packing import pack, token_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it now is."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter, and those that no learned language explains; ``lang`` becomes the prediction.

    Learned from the labelled documents of ``sf_dir`` that are not held out. A text goes if its bits a
    symbol are over ``most_bits`` of ``identify``, a bound from labelled text that narrows with the
    length and has no step. Equal texts are judged alike, repeated rows one by one; an empty table
    stays empty; columns other than those of documents go.
    """
    small_batches(spark)
    model = fit(read(spark, sf_dir, "documents").filter(~held_out("doc_id")))
    got = identify(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != "und") & (F.col("bits") <= F.col("most_bits")))
    return got.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of three lines go; a document of which nothing is left goes with them.

    Null and empty texts and texts of fewer than three lines stay as they are; of equal windows that of
    the smallest id stays, of repeated rows the first; an empty table stays empty; columns other than
    those of documents go.
    """
    return _sized(line_dedup(docs.select(*COLUMNS)).filter((F.col("n_removed") == 0) | (F.length("text") > 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity of 0.8 or more stays: the smallest id.

    Rows without an id, null texts and texts without words stay; rows that repeat an id and text are one
    document; an empty table stays empty; columns other than those of documents go.
    """
    small_batches(spark)
    return keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn to the target weights, in the order of the mix's shards; a document drawn twice is there twice.

    A null source is a source; texts without words are drawn with their block; an empty table stays
    empty; columns other than those of documents go.
    """
    return in_order(mix(docs.select(*COLUMNS))[0], parts=1 + docs.count() // 20_000).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows in sequences of at most 4096 tokens.

    A null or empty text is one piece of the end id; each of repeated rows has pieces of its own; an
    empty table gives no rows; columns other than the id and the text go.
    """
    small_batches(spark)
    pieces = table(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pipeline-pieces")
    return pack(pieces.withColumnRenamed("id", "doc_id"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", near_duplicates),
    ("source_mix", mix_sources),
    ("best_fit_pack", pack_sequences),
]

#: Language ID and packing can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
