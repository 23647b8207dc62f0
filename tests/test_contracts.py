"""Contracts against hand-made records and against plain Python."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import contracts as T
from bandloom.plans import contracts as P


def test_structure_digest_is_that_of_plain_json(spark, sf):
    rows = P.structures(spark, sf).limit(20)
    for r in rows.withColumn("digest", T.structure_hash(rows)).collect():
        told = {
            "version": "structure-v2", "lattice": r["lattice"], "species": r["species"], "species_per_atom": r["species_per_atom"],
            "fractional_coordinates": r["fractional_coordinates"], "structure_conventions": r["structure_conventions"].asDict(),
        }
        assert r["digest"] == hashlib.sha256(json.dumps(told, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_digest_needs_a_whole_structure_and_keeps_precision(spark, sf):
    rows = P.structures(spark, sf).limit(1)
    whole = rows.withColumn("digest", T.structure_hash(rows)).first()["digest"]
    for column, value in (("species_per_atom", P.words("Na")), ("species", P.words("Na", "Q")), ("lattice", P.numbers([0, 1, 0], [1, 0, 0], [0, 0, 1])), ("fractional_coordinates", P.numbers([0, 0, float("nan")], [0, 0, 0]))):
        other = rows.withColumn(column, value)
        assert other.withColumn("digest", T.structure_hash(other)).first()["digest"] is None
    moved = rows.withColumn("fractional_coordinates", P.numbers([0, 0, 0], [0.5, 0.5, 0.25 + 1e-15]))
    assert moved.withColumn("digest", T.structure_hash(moved)).first()["digest"] not in (None, whole)


@pytest.mark.parametrize("claim,version,want", [("v2", T.V2, True), ("v1", T.V1, True), ("v1", T.V2, False), ("v2", T.V1, False), ("v2", "structure-v3", False), ("V2", T.V2, False), (None, T.V2, False)])
def test_digest_holds_only_under_its_version(spark, claim, version, want):
    v2, v1 = "ab" * 32, "cd" * 32
    text = {"v2": v2, "v1": v1, "V2": v2.upper(), None: None}[claim]
    assert spark.range(1).select(T.verify_structure_hash(F.lit(text).cast("string"), F.lit(version), F.lit(v2), F.lit(v1)).alias("x")).first()["x"] is want


def test_dual_lattice(spark):
    rng = np.random.default_rng(4)
    cell = np.eye(3) * 4 + rng.random((3, 3))
    dual = 2 * np.pi * np.linalg.inv(cell).T
    rows = spark.createDataFrame([(cell.tolist(), dual.tolist()), (cell.tolist(), (dual * 1.01).tolist()), (cell.tolist(), None)], "a array<array<double>>, b array<array<double>>")
    assert [r["x"] for r in rows.select(T.dual_lattice(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]
    assert [r["x"] for r in rows.select(T.good_lattice(F.col("a")).alias("x"), "b").collect()] == [True] * 3


def test_descriptor_of_a_cubic_cell(spark):
    chi = F.create_map(F.lit("Na"), F.lit(0.93), F.lit("Cl"), F.lit(3.16))
    cell = P.numbers([4, 0, 0], [0, 4, 0], [0, 0, 4])
    got = spark.range(1).select(T.structure_descriptor(cell, F.lit(225), P.words("Na", "Cl"), {"Na": 11, "Cl": 17}, chi).alias("v"), T.structure_descriptor(cell, F.lit(1), F.array().cast("array<string>"), {"Na": 11}, chi).alias("w")).first()
    assert got["v"] == pytest.approx([0, 0, 0, 0, 0, 0, 0, 1, 4, 4, 4, 90, 90, 90, 64, 2.045, 1.115, 0.93, 3.16, 2, 14, 3])
    assert got["w"] == pytest.approx([1, 0, 0, 0, 0, 0, 0, 0, 4, 4, 4, 90, 90, 90, 64, *[0] * 7])


def test_every_field_is_audited(spark, sf):
    got = P._flt7(spark, sf)
    assert {r["id"] % 24 for r in got.filter("issues <> ''").collect()} == set(P.LINES) and len(T.FIELDS) == 29


def test_gate_wants_a_clean_set_of_the_right_size(spark):
    clean = spark.range(250).select(F.array().cast("array<string>").alias("errors"))
    bad = spark.range(1).select(F.array(F.lit("x")).alias("errors"))
    passes = lambda df: T.traceability_gate(df).first()["passes"]
    assert passes(clean) and not passes(clean.union(bad)) and not passes(clean.limit(199)) and not passes(clean.union(clean).union(clean))
