"""Jobs with state: stopped and started again they give what one run gives."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from bandloom.streaming import jobs as J
from bandloom.streaming import state as Z


def write(df, path, k):
    df.coalesce(1).write.parquet(f"{path}/part{k}")


def test_commits_with_retries_over_two_runs(spark, tmp_path):
    """Four files with one hot id and shuffled retries; the job is stopped after two of them."""
    rng, src, out = random.Random(1), str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, 0 if i % 3 else i % 7, rng.choice("abcdef")) for i in range(400)]
    first, canonical = {}, {}
    for seq, key, digest in rows:
        canonical.setdefault(key, digest)
        first.setdefault((key, digest), seq)
    for k in range(4):
        batch = rows[100 * k : 100 * (k + 1)] + rng.sample(rows[: 100 * (k + 1)], 60)
        rng.shuffle(batch)
        write(spark.createDataFrame(batch, "seq long, id long, digest string"), src, k)
        if k % 2:
            was = spark.conf.get(Z.PROVIDER, None)
            Z.start_commits(J.read_files(spark, f"{src}/*", "seq long, id long, digest string"), out, str(tmp_path / "mark"), "id", "digest", "seq").awaitTermination()
            assert spark.conf.get(Z.PROVIDER, None) == was
    got = spark.read.parquet(out).collect()
    new = {(r["id"], r["digest"]): r["canonical"] for r in got if r["status"] in ("canonical", "variant")}
    assert new == {(key, digest): canonical[key] == digest for key, digest in first}
    assert sum(r["n"] for r in got) == 640 and Counter(r["status"] for r in got)["canonical"] == len(canonical)
    assert all(r["canonical"] == (r["status"] in ("canonical", "duplicate")) for r in got)


def test_paging_over_two_runs(spark, tmp_path):
    """Equal to the table rule after any cut into runs; a higher limit lets a query go on."""
    rng = random.Random(2)
    rows = [(q, page, rng.randrange(top)) for q, top in (("wide", 5000), ("narrow", 30), ("hot", 800)) for page in range(16) for _ in range(60 if q == "hot" else 12)]
    df = spark.createDataFrame(rows, "query string, page long, id long")
    want = {tuple(r) for r in J.page_state(df, 500).collect()}
    assert {state for *_, state in want} == {"more", "limit", "no new ids"}
    for cuts in ((16,), (3, 9, 16)):
        src, out, mark = (str(tmp_path / f"{x}{len(cuts)}") for x in ("in", "out", "mark"))
        for k, upto in enumerate(cuts):
            write(df.filter((F.col("page") < upto) & (F.col("page") >= ([0, *cuts])[k])), src, k)
            Z.start_paging(J.read_files(spark, f"{src}/*", df.schema), out, mark, 500).awaitTermination()
        assert {tuple(r) for r in Z.paging_table(spark, out).collect()} == want
    write(df.filter("query = 'hot'").withColumn("page", F.col("page") + 16), src, 9)
    Z.start_paging(J.read_files(spark, f"{src}/*", df.schema), out, mark, 5000).awaitTermination()
    after = {r["query"]: r for r in Z.paging_table(spark, out).collect()}
    assert after["hot"]["state"] == "no new ids" and after["hot"]["cursor"] == 18
    assert {tuple(r) for q, r in after.items() if q != "hot"} == {r for r in want if r[0] != "hot"}


def test_expiry_with_late_rows_and_new_lives(spark, tmp_path):
    """Lives begin in the order of event time however rows arrive; what is due has gone, in two runs."""
    day = 86_400
    rng, src, out = random.Random(3), str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(rng.randrange(12), "attachment" if rng.random() < 0.2 else "result", rng.randrange(30 * day)) for _ in range(300)]
    rows = [(key, "attachment" if key == 3 else "result", t) for key, _, t in rows]
    files = defaultdict(list)
    for row in rows:  # up to two days late
        files[min(3, (row[2] + rng.randrange(2 * day)) // (8 * day))].append(row)
    kinds = "id int, kind string, s long"
    for k in range(4):
        write(spark.createDataFrame(files[k], kinds).select("id", "kind", F.timestamp_seconds("s").alias("created")), src, k)
        if k in (1, 3):
            schema = "id int, kind string, created timestamp"
            Z.start_expiry(Z.expiry_stream(J.read_files(spark, f"{src}/*", schema), "id", "kind", "created", 24, "3 days"), out, str(tmp_path / "mark")).awaitTermination()
    edge = max(t for *_, t in rows) - 3 * day
    want = Counter()
    for key in range(12):
        begun = None
        for t in sorted(t for k, _, t in rows if k == key and t < edge):
            if begun is None or (key != 3 and t >= begun + day):
                want[key, t, "live"] += 1
                begun = t
                want[key, t, "prunable"] += key != 3 and t + day < edge
    got = Counter((r["id"], int(r["created"].timestamp()), r["state"]) for r in spark.read.parquet(out).collect())
    assert got == +want
