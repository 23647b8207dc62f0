"""What the findings of round 3 were about, on the least input that shows it."""

import datetime
import math
import random
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom import catalog
from bandloom.operators import features, retrieval
from bandloom.plans import bands, incremental, quality
from bandloom.sources import records

#: Eight values with a mean of exactly 50, of which the sum of doubles is below 400 from left to right.
WHOLE = [25.67, 38.99, 25.84, 86.71, 64.88, 3.48, 11.49, 142.94]


@pytest.fixture
def whole_means(spark, tmp_path):
    """User 0 has the values in one order of time, user 1 in the other."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(8 * u + i, start + datetime.timedelta(hours=i), u, "view", v, "") for u, vs in enumerate((WHOLE, WHOLE[::-1])) for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_whole_means_do_not_hang_on_order(spark, whole_means):
    """F1 to F5, F8 to F10: energies are relative to 50, whichever way the doubles are added up."""
    got = bands.points(spark, whole_means).groupBy("path_id").agg(F.sort_array(F.collect_list("energy")).alias("e")).collect()
    assert len(got) == 2 and all(r["e"] == sorted(round(v - 50, 2) for v in WHOLE) for r in got)
    low = {r["path_id"]: (r["low"], r["high"]) for r in catalog.queries()["ag1_band_ranges"](spark, whole_means).collect()}
    assert low[0] == low[1]


def test_values_that_are_no_decimals_have_a_plain_mean(spark):
    from bandloom.operators import measure

    df = spark.createDataFrame([(1, 1e300), (1, 3e300), (2, float("nan")), (3, None), (3, 2.0)], "id int, v double")
    got = {r["id"]: r["m"] for r in df.groupBy("id").agg(measure.exact_mean("v").alias("m")).collect()}
    assert got[1] == 2e300 and got[2] != got[2] and got[3] == 2.0


def test_even_odds_do_not_hang_on_order(spark, whole_means):
    """a mean of exactly half the scale is no metal below even odds."""
    assert {r["m"] for r in quality.gaps(spark, whole_means).collect()} == {50.0}
    assert [r["kind"] for r in catalog.queries()["flt20_peak_override"](spark, whole_means).collect()] == ["indirect"] * 2


def test_frozen_split_of_a_crossing_group_can_differ(spark, tmp_path):
    """of records with remainder 6 the frozen split is another one, in a group that is in two splits too."""
    docs = [(i, f"text {i}", "en", "web", 8) for i in (6, 7, 47, 127, 487, 1527)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], 1, 0) for d in docs], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = dict(con.execute(catalog.oracle_sql()["jn23_traceability"]).fetchall())
    assert want[487].startswith("frozen_assignment_mismatch")
    assert {r["id"]: r["errors"] for r in catalog.queries()["jn23_traceability"](spark, str(tmp_path)).collect()} == want


def test_best_rows_of_copies_and_other_lengths(spark):
    """F11 to F14: blocks and parts give what each pair alone gives, with many copies, a zero vector, and vectors of two lengths."""
    rng = random.Random(7)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)] + [[rng.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    rows = [(i, rng.choice(base)) for i in range(150)] + [(150, [0.0] * 6), (151, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    length = lambda v: math.sqrt(sum(x * x for x in v))
    unit = {i: [x / length(v) for x in v] for i, v in rows if v and any(v)}
    got = defaultdict(list)
    for r in retrieval.top_k(df.filter("id % 10 = 0"), df, 7, blocks=2, parts=3).orderBy("query", "rank").collect():
        got[r["query"]].append(r["found"])
    facts = {r["query"]: r["rank"] for r in retrieval.match_facts(df.filter("id % 10 = 0"), df, blocks=2, parts=3).collect()}
    assert set(got) == set(facts) == {i for i in unit if i % 10 == 0}
    for i, found in got.items():
        score = {j: round(sum(x * y for x, y in zip(unit[i], w, strict=True)), 9) for j, w in unit.items() if len(w) == len(unit[i])}
        order = sorted(score, key=lambda j: (-score[j], j))
        assert found == order[:7] and facts[i] == 1 + order.index(i)


def test_samples_of_one_shape_at_once(spark):
    """F16: one to five bands at several k of several segments, whole or not, against all assignments one by one."""
    rng, rows, want = random.Random(8), [], {}
    for sample in range(60):
        bands, at = 1 + sample % 5, [(s, 2 * s + i) for s in range(1 + sample % 3) for i in range(2)]
        x, y = ({(s, k, b): rng.gauss(0, 1) for s, k in at for b in range(bands)} for _ in range(2))
        gone = (0, 0, 0) if sample % 7 == 3 and bands > 1 else None
        rows += [(sample, f"b{b}", s, k, v, float("nan") if sample == 20 else y[s, k, b]) for (s, k, b), v in x.items() if (s, k, b) != gone]
        n = bands * len(at)
        least = lambda some: min(sum(abs(x[s, k, b] - y[s, k, p[b]]) for s, k in some for b in range(bands)) for p in permutations(range(bands)))  # noqa: B023, E731
        if gone or sample == 20:
            want[sample] = ("incomplete", None, None, None, None)
        else:
            level = lambda z, s, k: sorted(z[s, k, b] for b in range(bands))  # noqa: B023, E731
            flat = sum(abs(c - d) for s, k in at for c, d in zip(level(x, s, k), level(y, s, k), strict=True))
            want[sample] = ("ok", sum(abs(v - y[p]) for p, v in x.items()) / n, sum(least([p for p in at if p[0] == g]) for g in {s for s, _ in at}) / n, least(at) / n, flat / n)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sample_id int, band string, segment_id int, k_idx int, pred double, target double")
    got = {r["sample_id"]: tuple(r)[1:] for r in features.trajectory_matching(df).collect()}
    assert {i: tuple(v if isinstance(v, str | None) else round(v, 9) for v in r) for i, r in got.items()} == {i: tuple(v if isinstance(v, str | None) else round(v, 9) for v in r) for i, r in want.items()}
    at_once = features.matched(np.zeros((50, 2, 2)), np.ones((50, 2, 2)), np.zeros((50, 2), int))
    assert at_once.tolist() == [[1.0] * 4] * 50


def test_parts_are_dealt_by_key(spark, tmp_path):
    """F17 to F19: a part that a stream reads is written by several tasks, and a key is in one file of it."""
    incremental.in_turn([spark.range(400).select((F.col("id") % 40).alias("id"))], str(tmp_path), "id")
    files = spark.read.parquet(f"{tmp_path}/part0").withColumn("f", F.input_file_name()).groupBy("id").agg(F.collect_set("f").alias("f"), F.count("*").alias("n")).collect()
    assert len(files) == 40 and all(len(r["f"]) == 1 and r["n"] == 10 for r in files)
    assert len({r["f"][0] for r in files}) > 1


def suppliers(spark, folder, rows):
    spark.createDataFrame(rows, "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{folder}/supplier.parquet")


@pytest.mark.parametrize("local", [True, False])
def test_assets_are_written_and_listed_by_all_cores(spark, tmp_path, monkeypatch, local):
    """short rows are not coalesced into one writing task, and a folder is not a listing task."""
    if not local:
        monkeypatch.setattr(records, "local_folder", lambda spark, path: None)
    suppliers(spark, tmp_path, [(i, f"Supplier#{i}") for i in range(90)])
    cores, width = spark.sparkContext.defaultParallelism, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(width)
    spark.sparkContext.setJobGroup("f15", "assets")
    df = catalog.queries()["src10_bound_assets"](spark, str(tmp_path))
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("f15") for s in status.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) <= 4 * cores and spark.conf.get(width) == before
    files = [f.rsplit("/", 2)[1:] for f in df.inputFiles() if "/name=" in f]
    assert sorted(b if local else a for a, b in files) == sorted(f"name={i}" for i in range(90))
    assert len({a if local else b.split("-")[1] for a, b in files}) > cores
    assert {(r["name"], r["size"], r["state"]) for r in df.collect()} == {(str(i), len(f"Supplier#{i}") + 1, "bound" if i % 4 else "changed") for i in range(90)}


def test_assets_of_odd_suppliers_are_as_sparks_writer_has_them(spark, tmp_path, monkeypatch):
    """no supplier, one without a name, a name with a line break, a key twice and a negative one."""
    for k, rows in enumerate(([], [(1, None), (2, ""), (3, "a\r\nb"), (5, "twice"), (5, "twice"), (-7, "x")])):
        suppliers(spark, tmp_path / str(k), rows)
        got = []
        for plain in (False, True):
            with monkeypatch.context() as m:
                if plain:
                    m.setattr(records, "local_folder", lambda spark, path: None)
                got.append(sorted(map(tuple, catalog.queries()["src10_bound_assets"](spark, str(tmp_path / str(k))).collect())))
        assert got[0] == got[1] and len(got[0]) == len(rows)


def test_local_folders(spark):
    assert [records.local_folder(spark, p) for p in ("/a/b", "file:/a/b c", "file:///a/b", "viewfs://far/a", "hdfs:/a")] == ["/a/b", "/a/b c", "/a/b", None, None]
