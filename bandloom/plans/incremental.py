"""Queries on sources, sinks and incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, read, shared_folder
from ..sources import records as S
from ..streaming import jobs as J
from ..streaming import state as Z


@query("src2_latest_rows", "SELECT o_custkey AS id, max(o_orderkey) AS seq, max_by(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1")
def _src2(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("priority"))
    return S.latest_rows(rows, "id", "seq")


@query("src3_payload_table", """SELECT event_id, 0 AS k_idx, value AS k, 0 AS band, CAST(user_id AS DOUBLE) AS energy, NULL AS error FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, 0, value, 1, 1.5, NULL FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, 'malformed' FROM events WHERE event_id % 10 = 0""")
def _src3(spark, sf_dir):
    text = F.concat(F.lit('{"note": "a,]", "table": [['), F.col("value").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit(", 1.5,], ],}"))
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(text).alias("t"))
    return S.payload_table(rows, "event_id", "t")


@query("src4_provider_material", """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'x_bandsdata.json.xz' END AS band_file, (p_size % 5 * 0.01 <= 0.01 OR p_type = 'ECONOMY') AS is_metal, CASE p_type WHEN 'ECONOMY' THEN false WHEN 'SMALL' THEN true WHEN 'MEDIUM' THEN false END AS is_direct,
CASE WHEN p_partkey % 7 = 0 THEN 'no url' WHEN p_partkey % 6 = 0 THEN 'no band file' END AS problem FROM part""")
def _src4(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(F.col("p_type") == "ECONOMY", "Metal").when(F.col("p_type") == "SMALL", "direct").when(F.col("p_type") == "MEDIUM", "Indirect")
    rows = read(spark, sf_dir, "part").select(k.cast("string").alias("auid"), F.when(k % 7 == 0, " ").otherwise("host:path").alias("aurl"), F.when(k % 6 == 0, F.array(F.lit("a.json"))).otherwise(F.array(F.lit("a"), F.lit("x_bandsdata.json.xz"))).alias("files"), (F.col("p_size") % 5 * 0.01).alias("gap"), kind.alias("type"))
    return S.provider_material(rows).select(F.col("auid").cast("long").alias("id"), "band_file", "is_metal", "is_direct", "problem")


@query("src5_second_provider", "SELECT p_partkey AS material_id, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size + 100 END AS spacegroup_number, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS formula, p_retailprice AS band_gap FROM part")
def _src5(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(k.alias("material_id"), F.when(k % 3 == 0, F.col("p_size")).alias("spacegroup"), F.struct((F.col("p_size") + 100).alias("number")).alias("symmetry"), F.when(k % 2 == 0, F.col("p_name")).alias("formula"), F.col("p_type").alias("formula_pretty"), F.col("p_retailprice").alias("band_gap"))
    return S.second_provider(rows)


@query("src6_kpath_segments", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not line mode' WHEN event_id % 7 = 0 THEN 'odd number of points' ELSE 'ok' END AS status, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE s END AS segment, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL WHEN s = 0 THEN value ELSE 0.5 END AS stop_x FROM events, (SELECT CAST(unnest(range(2)) AS INT) AS s) WHERE s = 0 OR (event_id % 5 <> 0 AND event_id % 7 <> 0)""")
def _src6(spark, sf_dir):
    e = F.col("event_id")
    text = F.concat(F.lit("path\n20\n"), F.when(e % 5 == 0, "Monkhorst").otherwise("Line-mode"), F.lit("\nreciprocal\n0 0 0 ! G\n"), F.col("value").cast("string"), F.lit(" 0 0 ! X\n\n0.5 0 0\n"), F.when(e % 7 == 0, "").otherwise("0.5 0.5 0\n"))
    return S.kpath_segments(read(spark, sf_dir, "events").select("event_id", text.alias("t")), "event_id", "t").select("event_id", "status", "segment", F.get("stop", F.lit(0)).alias("stop_x"))


@query("src7_structure_text", "SELECT s_suppkey AS id, 'ok' AS status, 'Na,Na,Cl' AS species, round((s_suppkey % 5 + 1) / (2.0 * (s_suppkey % 3 + 2)), 8) AS x2 FROM supplier")
def _src7(spark, sf_dir):
    k = F.col("s_suppkey")
    a = (k % 3 + 2).cast("string")
    text = F.concat(F.lit("t\n1.0\n"), a, F.lit(" 0 0\n0 3 0\n0 0 4\nNa Cl\n2 1\nCartesian\n0 0 0\n1 1 1\n"), ((k % 5 + 1) / 2.0).cast("string"), F.lit(" 0 0\n"))
    got = S.poscar(read(spark, sf_dir, "supplier").select(k.alias("id"), text.alias("t")), "id", "t")
    return got.select("id", "status", F.array_join("species", ",").alias("species"), F.round(F.get(F.get("fractional", F.lit(2)), F.lit(0)), 8).alias("x2"))


@query("src9_page_links", """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2) AS t FROM pages) SELECT page_id, CAST(i - 1 AS INT) AS n, h[i] AS href, t[i] AS text FROM (SELECT page_id, h, t, unnest(range(1, len(h) + 1)) AS i FROM l)""")
def _src9(spark, sf_dir):
    return S.links_of(read(spark, sf_dir, "pages"), "page_id", "html")


@query("src9_article_figures", "SELECT page_id, 0 AS n, 'F' || page_id AS figure_id, 'Fig. 1' AS label, 'Band structure of ' || page_id AS caption, 'g' || page_id || '.jpg' AS asset FROM pages WHERE page_id % 4 <> 0")
def _src9b(spark, sf_dir):
    k = F.col("page_id").cast("string")
    ident = F.when(F.col("page_id") % 4 == 0, "bad id!").otherwise(F.concat(F.lit("F"), k))
    xml = F.concat(F.lit('<article><fig id="'), ident, F.lit('"><label>Fig. 1</label><caption><p>Band <i>structure</i>\n of '), k, F.lit('</p></caption><graphic xlink:href="a/b/g'), k, F.lit('.jpg"/></fig></article>'))
    return S.figures_of(read(spark, sf_dir, "pages").select("page_id", xml.alias("x")), "page_id", "x")


@query("src11_list_fields", "SELECT event_id, 3 AS n, round(value + user_id + 1.5, 8) AS total FROM events")
def _src11(spark, sf_dir):
    text = F.concat(F.lit("[ "), F.col("value").cast("string"), F.lit("; "), F.col("user_id").cast("string"), F.lit(",1.5 ]"))
    v = S.stringified_list(text)
    return read(spark, sf_dir, "events").select("event_id", F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 8).alias("total"))


@query("src12_first_annotations", "WITH a AS (SELECT page_id AS id, 'manifest' AS origin, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 1 END AS box FROM pages WHERE page_id % 2 = 0), b AS (SELECT page_id AS id, 'file' AS origin, 2 AS box FROM pages WHERE page_id NOT IN (SELECT id FROM a)), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, origin, CASE WHEN box IS NULL THEN 'no box' WHEN id % 9 = 0 THEN 'no size' END AS reason FROM u")
def _src12(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 9 != 0, 100).alias("width"), F.lit(100).alias("height"))
    a = p.filter("id % 2 = 0").withColumn("origin", F.lit("manifest")).withColumn("box", F.when(F.col("id") % 4 != 0, 1))
    return S.first_annotations([a, p.withColumn("origin", F.lit("file")).withColumn("box", F.lit(2))], "id").select("id", "origin", "reason")


@query("snk1_partitioned_dataset", "SELECT c_mktsegment AS part, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def _snk1(spark, sf_dir):
    """Write by part, read back; only the listed columns of each part are scanned."""
    path = shared_folder(spark, "dataset")
    S.write_new(read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "part"), path, ["part"])
    return spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("snk2_create_only", "SELECT s_nationkey AS nation, count(*) AS n, true AS refused FROM supplier GROUP BY 1")
def _snk2(spark, sf_dir):
    """A second write to the same place is refused and leaves the first one as it was."""
    from pyspark.errors import AnalysisException

    path, rows = shared_folder(spark, "once"), read(spark, sf_dir, "supplier")
    S.write_new(rows, path)
    try:
        S.write_new(rows.limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


COMMITS = "b AS (SELECT event_id, user_id AS id, md5(event_type || CAST(event_id % 3 AS VARCHAR)) AS digest FROM events), s AS (SELECT *, first_value(digest) OVER (PARTITION BY id ORDER BY event_id) AS f, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n, row_number() OVER (PARTITION BY id, digest ORDER BY event_id) AS m FROM b)"


def commits(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), F.md5(F.concat("event_type", (F.col("event_id") % 3).cast("string"))).alias("digest"))


@query("ss1_commit_status", f"WITH {COMMITS} SELECT event_id, CASE WHEN n = 1 THEN 'canonical' WHEN digest = f THEN 'duplicate' WHEN m = 1 THEN 'variant' ELSE 'duplicate_variant' END AS status FROM s")
def _ss1(spark, sf_dir):
    rows = commits(spark, sf_dir)
    return J.commit_status(rows, rows.limit(0).select("id", "digest"), "id", "digest", "event_id").select("event_id", "status")


def in_turn(parts, folder, key=None):
    """Write tables as files that a stream reads one after the other; with a key each as a file a core, all rows of a key in one."""
    for k, part in enumerate(parts):
        dealt = part.repartition(part.sparkSession.sparkContext.defaultParallelism, key) if key else part.coalesce(1)
        dealt.write.parquet(f"{folder}/part{k}")


def committed(spark, rows, order, files, stops=()):
    """The commit stream over ``files`` parts of the rows, stopped and started again before the parts in ``stops``.

    A part is a file a core. Parts come in the order in which they were written, and an id is in
    one file of a part, so it meets its parts in turn wherever a micro-batch ends.
    """
    src, out, mark = (shared_folder(spark, x) for x in ("commit-in", "commit-out", "commit-mark"))
    for k in range(files):
        in_turn([rows.filter(F.col("part") == k).drop("part")], f"{src}/{k}", "id")
        if k + 1 in (*stops, files):
            stream = J.read_files(spark, f"{src}/*/*", rows.drop("part").schema, spark.sparkContext.defaultParallelism)
            Z.start_commits(stream, out, mark, "id", "digest", order).awaitTermination()
    return spark.read.parquet(out)


@query("ss1_commit_stream", f"WITH {COMMITS} SELECT id, digest, n = 1 AS canonical FROM s WHERE n = 1 OR (digest <> f AND m = 1)")
def _ss1b(spark, sf_dir):
    """The same rule as a stream with keyed state over four files, restarted after the second."""
    rows = commits(spark, sf_dir)
    most = rows.agg(F.max("event_id")).first()[0] or 0
    got = committed(spark, rows.withColumn("part", F.least(F.lit(3), F.floor(F.col("event_id") * 4 / (most + 1))).cast("int")), "event_id", 4, stops=(2,))
    return got.filter("status in ('canonical', 'variant')").select("id", "digest", "canonical")


@query("ss1_commit_retries", f"""WITH {COMMITS}, r AS (SELECT CASE WHEN digest = f THEN 'duplicate' ELSE 'duplicate_variant' END AS status FROM s WHERE event_id % 3 = 0), a AS (SELECT CASE WHEN n = 1 THEN 'canonical' WHEN digest = f THEN 'duplicate' WHEN m = 1 THEN 'variant' ELSE 'duplicate_variant' END AS status FROM s UNION ALL SELECT status FROM r)
SELECT status, count(*) AS n FROM a GROUP BY status""")
def _ss1c(spark, sf_dir):
    """Every third row comes again a file later, in any order within the file: no retry changes what was committed."""
    rows = commits(spark, sf_dir)
    most = rows.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * 3 / (most + 1)).cast("int")
    again = rows.filter("event_id % 3 = 0").withColumn("part", part + 1)
    both = rows.withColumn("part", part).unionByName(again)
    return committed(spark, both, "event_id", 4).groupBy("status").agg(F.sum("n").alias("n"))


PAGES = """WITH p AS (SELECT event_type AS query, CAST(event_id // 200 AS BIGINT) AS page, user_id AS id FROM events), f AS (SELECT query, id, min(page) AS page FROM p GROUP BY ALL), w AS (SELECT query, page, count(*) AS new FROM f GROUP BY ALL), d AS (SELECT DISTINCT query, page FROM p), e AS (SELECT d.query, d.page, coalesce(new, 0) AS new FROM d LEFT JOIN w USING (query, page)),
x AS (SELECT *, sum(new) OVER (PARTITION BY query ORDER BY page) AS found, sum(new) OVER (PARTITION BY query ORDER BY page ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS idle, row_number() OVER (PARTITION BY query ORDER BY page) AS n FROM e),
r AS (SELECT *, CASE WHEN found >= 140 THEN 'limit' WHEN n >= 3 AND idle = 0 THEN 'no new ids' END AS reason FROM x), s AS (SELECT query, min(page) FILTER (WHERE reason IS NOT NULL) AS stop, max(page) AS last FROM r GROUP BY query)
SELECT s.query, coalesce(stop, last) AS cursor, CAST(found AS BIGINT) AS found, CASE WHEN stop IS NULL THEN 'more' ELSE reason END AS state FROM s JOIN r ON r.query = s.query AND r.page = coalesce(stop, last)"""


def catalogue_pages(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.floor(F.col("event_id") / 200).alias("page"), F.col("user_id").alias("id"))


@query("ss2_page_state", PAGES)
def _ss2(spark, sf_dir):
    return J.page_state(catalogue_pages(spark, sf_dir), 140)


@query("ss2_paging_stream", PAGES)
def _ss2b(spark, sf_dir):
    """The same as a stream with a cursor kept between runs: pages come in four files, the job is stopped after two."""
    rows = catalogue_pages(spark, sf_dir)
    most = rows.agg(F.max("page")).first()[0] or 0
    src, out, mark = (shared_folder(spark, x) for x in ("paging-in", "paging-out", "paging-mark"))
    for k in range(4):
        in_turn([rows.filter(F.floor(F.col("page") * 4 / (most + 1)) == k)], f"{src}/{k}")
        if k % 2:
            Z.start_paging(J.read_files(spark, f"{src}/*/*", rows.schema), out, mark, 140).awaitTermination()
    return Z.paging_table(spark, out)


@query("ss3_live_artifacts", "SELECT CASE WHEN event_type = 'view' OR ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-15' THEN 'live' ELSE 'prunable' END AS state, count(*) AS n FROM events GROUP BY 1")
def _ss3(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("created"), F.when(F.col("event_type") == "view", "attachment").otherwise("result").alias("kind"))
    return J.live_artifacts(rows, F.lit("2024-01-15").cast("timestamp")).groupBy("state").agg(F.count("*").alias("n"))


@query("ss3_expiry_stream", """WITH RECURSIVE e AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS ms FROM events WHERE NOT (event_id % 11 = 0 AND ts < TIMESTAMP '2024-01-03')), w AS (SELECT max(ms) - 10 * 86400000 AS w FROM e), k AS (SELECT id, ms FROM e, w WHERE ms < w),
l AS (SELECT id, min(ms) AS s FROM k GROUP BY id UNION ALL SELECT l.id, n.ms FROM l, LATERAL (SELECT min(ms) AS ms FROM k WHERE k.id = l.id AND k.ms >= l.s + 86400000) n WHERE n.ms IS NOT NULL AND l.id % 5 <> 0)
SELECT id, CASE WHEN id % 5 = 0 THEN 'attachment' ELSE 'result' END AS kind, count(*) AS lives, count(*) FILTER (WHERE id % 5 <> 0 AND s + 86400000 < w) AS pruned, min(s) AS first_ms, max(s) AS last_ms FROM l, w GROUP BY id""")
def _ss3b(spark, sf_dir):
    """Expiry with event-time state, an artifact a user: a week a file, some rows a file late, some so late that they are dropped; rows repeat a living artifact or begin a new life."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when(F.col("user_id") % 5 == 0, "attachment").otherwise("result").alias("kind"), F.col("ts").cast("timestamp").alias("created"), "event_id")
    week = F.least(F.lit(3), F.floor(F.datediff("created", F.lit("2024-01-01")) / 8))
    lost = (F.col("event_id") % 11 == 0) & (F.col("created") < "2024-01-03")
    rows = e.withColumn("part", F.when(lost, 3).when(F.col("event_id") % 7 == 0, F.least(F.lit(3), week + 1)).otherwise(week)).drop("event_id")
    src, out, mark = (shared_folder(spark, x) for x in ("expiry-in", "expiry-out", "expiry-mark"))
    for k in range(4):  # a run a part: all its files are one micro-batch, so that the watermark moves between parts only
        in_turn([rows.filter(F.col("part") == k).drop("part")], f"{src}/{k}", "id")
        files = J.read_files(spark, f"{src}/*/*", rows.drop("part").schema, spark.sparkContext.defaultParallelism)
        Z.start_expiry(Z.expiry_stream(files, "id", "kind", "created", 24, "10 days"), out, mark).awaitTermination()
    live, ms = F.col("state") == "live", F.unix_millis("created")
    return spark.read.parquet(out).groupBy("id", "kind").agg(F.count_if(live).alias("lives"), F.count_if(~live).alias("pruned"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


@query("ss4_outcome_counts", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _ss4(spark, sf_dir):
    """Counters as a stream in complete mode over the events, written as they change."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    src, mark, out = (shared_folder(spark, x) for x in ("outcome-in", "outcome-mark", "outcome-out"))
    e.repartition(3).write.parquet(src)
    stream = J.outcome_counts(J.read_files(spark, src, e.schema, files=2), "ts", "event_type", late="60 days")
    J.start_counts(stream, out, mark).awaitTermination()
    return J.latest_counts(spark, out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ag47_run_report", "SELECT count(*) AS attempted, count(*) FILTER (WHERE event_type <> 'view') AS submitted, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS success, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'signup') AS no_data, count(DISTINCT user_id) AS groups FROM events")
def _ag47(spark, sf_dir):
    c = lambda cond, name: F.count_if(cond).alias(name)
    t = F.col("event_type")
    return read(spark, sf_dir, "events").agg(F.count("*").alias("attempted"), c(t != "view", "submitted"), c(t.isin("purchase", "click"), "success"), c(t == "error", "failed"), c(t == "signup", "no_data"), F.count_distinct("user_id").alias("groups"))
