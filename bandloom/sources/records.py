"""Readers of provider records and text formats as DataFrame transformations, and create-only writers."""

from __future__ import annotations

import os
import re
from itertools import groupby
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import is_missing

#: The name in a path of ``write_texts``.
NAMED = "name=([^/]+)(?:/[^/]+)?$"


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """SRC2: the last row of each id."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("__r = 1").drop("__r")


def lenient_json(text: Column | str, schema: str) -> Column:
    """SRC3: a JSON value with commas before closing brackets forgiven, outside strings only; null if malformed."""
    # Strings are matched whole and put back as they are; a comma before a bracket is dropped.
    return F.from_json(F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])', "$1"), schema)


def payload_table(rows: DataFrame, key: str, text: str) -> DataFrame:
    """SRC3: long rows of a band table ``{"table": [[k, e1, e2, ..], ..]}``: the first column is k; a malformed payload is one error row."""
    got = rows.select(key, lenient_json(text, "struct<table:array<array<double>>>").alias("j"))
    lines = got.select(key, F.posexplode_outer("j.table").alias("k_idx", "line"))
    cells = lines.select(key, "k_idx", F.get("line", F.lit(0)).alias("k"), F.posexplode_outer(F.when(F.col("line").isNotNull(), F.slice("line", 2, F.greatest(F.lit(0), F.size("line") - 1)))).alias("band", "energy"))
    return cells.withColumn("error", F.when(F.col("k_idx").isNull(), "malformed"))


def provider_material(rows: DataFrame) -> DataFrame:
    """SRC4: material row of a provider row with ``auid, aurl, files, gap, type``; null ``problem`` where it can be used.

    Metal where the gap is at most 0.01 or the type says so; without a type, directness is unknown.
    """
    file = F.get(F.filter("files", lambda f: f.endswith("_bandsdata.json.xz")), F.lit(0))
    kind = F.lower("type")
    problem = F.when(is_missing(F.col("auid")), "no id").when(is_missing(F.col("aurl")), "no url").when(file.isNull(), "no band file")
    metal = F.when((F.col("gap") <= 0.01) | F.coalesce(kind.contains("metal"), F.lit(False)), True).when(F.col("gap").isNotNull(), False)
    direct = F.when(is_missing(F.col("type")), None).otherwise(kind.contains("direct") & ~kind.contains("indirect"))
    return rows.select("auid", "aurl", file.alias("band_file"), metal.alias("is_metal"), direct.alias("is_direct"), problem.alias("problem"))


def second_provider(rows: DataFrame) -> DataFrame:
    """SRC5: the same columns from a provider with a nested symmetry and other names."""
    return rows.select(F.col("material_id"), F.coalesce("spacegroup", "symmetry.number").alias("spacegroup_number"), F.coalesce("formula", "formula_pretty").alias("formula"), F.col("band_gap").cast("double").alias("band_gap"))


def kpath_segments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """SRC6: segments of a line-mode path text: header, count, mode, basis, then coordinate lines in strict pairs.

    ``status`` is ok, or why the text can't be read.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(key, lines.alias("l")).withColumn("body", F.slice("l", 5, F.greatest(F.lit(0), F.size("l") - 4)))
    nums = lambda x: F.transform(F.slice(F.split(x, r"\s+"), 1, 3), lambda v: v.try_cast("double"))
    rows = rows.withColumn("xyz", F.transform("body", nums))
    good = F.forall("xyz", lambda v: (F.size(v) == 3) & F.forall(v, lambda x: x.isNotNull()))
    status = F.when(F.size("l") < 6, "too short").when(~F.lower(F.get("l", F.lit(2))).startswith("l"), "not line mode").when(F.size("body") % 2 != 0, "odd number of points").when(~good, "bad coordinates").otherwise("ok")
    rows = rows.withColumn("status", status)
    pair = F.when(F.col("status") == "ok", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size("body") / 2).cast("int") - 1)), lambda i: F.struct(F.get("xyz", i * 2).alias("start"), F.get("xyz", i * 2 + 1).alias("stop"))))
    return rows.select(key, "status", F.posexplode_outer(pair).alias("segment", "p")).select(key, "status", "segment", "p.start", "p.stop")


def poscar(rows: DataFrame, key: str, text: str) -> DataFrame:
    """SRC7: lattice, species of every atom and fractional coordinates of a structure text with a symbols line.

    Cartesian coordinates are turned by the inverse lattice (closed form); ``status`` tells what is wrong.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    words = lambda i: F.filter(F.split(F.coalesce(F.get("l", F.lit(i)), F.lit("")), r"\s+"), lambda x: x != "")
    num = lambda a: F.transform(a, lambda x: x.try_cast("double"))
    rows = rows.select(key, lines.alias("l"))
    rows = rows.withColumn("scale", F.get(num(words(1)), F.lit(0))).withColumn("lattice", F.array(*[F.transform(F.slice(num(words(i)), 1, 3), lambda x: x * F.col("scale")) for i in (2, 3, 4)]))
    rows = rows.withColumn("symbols", words(5)).withColumn("counts", F.transform(words(6), lambda x: x.try_cast("int")))
    rows = rows.withColumn("species", F.flatten(F.zip_with("symbols", "counts", lambda s, n: F.array_repeat(s, F.coalesce(n, F.lit(0))))))
    rows = rows.withColumn("atoms", F.transform(F.slice("l", 9, F.greatest(F.lit(0), F.size("species"))), lambda x: F.transform(F.slice(F.split(x, r"\s+"), 1, 3), lambda v: v.try_cast("double"))))
    m = [[F.get(F.get("lattice", F.lit(i)), F.lit(j)) for j in range(3)] for i in range(3)]
    det = sum((m[0][j] * (m[1][(j + 1) % 3] * m[2][(j + 2) % 3] - m[1][(j + 2) % 3] * m[2][(j + 1) % 3]) for j in range(3)), F.lit(0.0))
    inv = [[(m[(j + 1) % 3][(i + 1) % 3] * m[(j + 2) % 3][(i + 2) % 3] - m[(j + 1) % 3][(i + 2) % 3] * m[(j + 2) % 3][(i + 1) % 3]) / F.col("det") for j in range(3)] for i in range(3)]
    rows = rows.withColumn("det", det)
    cartesian = F.lower(F.coalesce(F.get("l", F.lit(7)), F.lit(""))).rlike("^[ck]")
    turn = lambda a: F.array(*[sum((F.get(a, F.lit(i)) * F.col("scale") * inv[i][j] for i in range(3)), F.lit(0.0)) for j in range(3)])
    frac = F.when(cartesian, F.transform("atoms", turn)).otherwise(F.col("atoms"))
    bad = F.when(F.size("l") < 9, "too short").when(F.coalesce(F.abs("det") < 1e-9, F.lit(True)), "no lattice").when(F.size("symbols") != F.size("counts"), "symbols and counts differ").when(F.size("atoms") < F.size("species"), "atoms are missing").otherwise("ok")
    return rows.select(key, bad.alias("status"), "lattice", "species", F.when(bad == "ok", frac).alias("fractional"))


def figures_of(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """SRC9: figures of an article: id of at most 128 safe characters, label, caption without markup, base name of the asset."""
    fig = F.regexp_extract_all(xml, F.lit(r"(?s)(<fig[ >].*?</fig>)"), F.lit(1))
    one = lambda p, n=1: F.regexp_extract("f", p, n)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    got = rows.select(key, F.posexplode(fig).alias("n", "f"))
    got = got.select(key, "n", one(r'<fig[^>]* id="([^"]*)"').alias("figure_id"), F.substring(plain(one(r"(?s)<label>(.*?)</label>")), 1, 256).alias("label"), F.substring(plain(one(r"(?s)<caption>(.*?)</caption>")), 1, 20000).alias("caption"), F.regexp_extract(one(r'<graphic[^>]* (?:xlink:)?href="([^"]*)"'), r"([^/\\]*)$", 1).alias("asset"))
    return got.filter(F.col("figure_id").rlike(r"^[A-Za-z0-9._-]{1,128}$"))


def links_of(rows: DataFrame, key: str, html: str) -> DataFrame:
    """SRC9: the same scan over a page: each link's place, target and text."""
    a = F.regexp_extract_all(html, F.lit(r'(?s)<a href="([^"]*)">(.*?)</a>'), F.lit(1))
    t = F.regexp_extract_all(html, F.lit(r'(?s)<a href="([^"]*)">(.*?)</a>'), F.lit(2))
    return rows.select(key, F.posexplode(F.arrays_zip(a.alias("href"), t.alias("text"))).alias("n", "x")).select(key, "n", "x.href", "x.text")


def assets(spark: SparkSession, path: str, manifest: DataFrame, name: str = "([^/]+)$") -> DataFrame:
    """SRC10: files of a folder with size and SHA-256, bound to a manifest of ``name, sha256``; ``name`` is the pattern of the name in a path.

    Folders are listed by at most four tasks a core; by default Spark starts one a folder, up to 10,000.
    """
    width = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(width)
    spark.conf.set(width, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    finally:
        spark.conf.set(width, before)
    files = scan.select(F.regexp_extract("path", name, 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("found"))
    j = manifest.join(files, "name", "full")
    return j.select("name", "size", F.when(F.col("sha256").isNull(), "not listed").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").otherwise("bound").alias("state"))


def stringified_list(text: Column | str) -> Column:
    """SRC11: numbers of a list in text form, bracketed or not, with commas, semicolons or spaces between."""
    parts = F.split(F.trim(F.regexp_replace(text, r"[\[\]()\s]+", " ")), r"[,; ]+")
    return F.filter(F.transform(parts, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def first_annotations(sources: list[DataFrame], key: str) -> DataFrame:
    """SRC12: of several sources the first record of an id wins; ``reason`` tells why a record can't be used."""
    rows = sources[0].withColumn("__p", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("__p", F.lit(i)), allowMissingColumns=True)
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__p"))).filter("__r = 1").drop("__r", "__p")
    return rows.withColumn("reason", F.when(F.col("box").isNull(), "no box").when(F.col("width").isNull() | F.col("height").isNull(), "no size"))


def write_new(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK1/SNK2: write a dataset, by part if asked for; a version that is there is never overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """A path on the local file system without its scheme; null for other stores."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    got = re.fullmatch(r"(file:(?://)?)?(/[^/].*)", path)
    return got[2] if got and (got[1] or default.startswith("file:")) else None


def write_texts(rows: DataFrame, path: str) -> None:
    """A text file a name of ``name, value`` with its rows as lines, for ``assets`` with the pattern ``NAMED``.

    Rows are dealt over a stated number of tasks, since short ones would all be coalesced into one.
    In a local folder, which executors must share, tasks write the files themselves, for Hadoop
    starts a process there for each folder, file and checksum; a rename puts a file in place, so
    that a task can run again. Elsewhere Spark's writer makes a folder a name.
    """
    spark = rows.sparkSession
    dealt, home = rows.select("name", "value").repartition(4 * spark.sparkContext.defaultParallelism, "name"), local_folder(spark, path)
    if home is None:
        dealt.write.partitionBy("name").text(path)
        return

    def write(part):
        task = TaskContext.get()
        folder = f"{home}/{task.partitionId()}"
        os.makedirs(folder, exist_ok=True)
        for name, lines in groupby(part, key=lambda r: r["name"]):
            file = "name=" + ("__HIVE_DEFAULT_PARTITION__" if name is None else quote(name, safe=""))
            draft = f"{folder}/.{file}.{task.taskAttemptId()}"
            with open(draft, "w", encoding="utf-8", newline="") as f:
                f.writelines((r["value"] or "") + "\n" for r in lines)
            os.replace(draft, f"{folder}/{file}")

    os.makedirs(home)
    dealt.sortWithinPartitions("name").foreachPartition(write)
