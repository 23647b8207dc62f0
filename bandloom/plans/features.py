"""Queries on composed features, assignments, traces and the formats that need them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..registry import query, read, shared_folder
from ..sources import records as S
from .bands import DAILY, POINTS, SHIFTED, WINDOW, _power_sums, daily, diagnostics_sql, points, r8, resample_sql, shifted

PICKED = f"{SHIFTED}, {WINDOW}, slots AS (SELECT path_id, band_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY side, rank, band_id) - 1 AS INT) AS slot FROM chosen), picked AS (SELECT d.* FROM d JOIN slots USING (path_id, band_id)), {resample_sql('z', 'picked', 'path_id, band_id, segment_id', 9)}"


@query("fn2_extract_bands", f"WITH {PICKED} SELECT path_id, slot, band_id, segment_id, cell, round(value, 8) AS value FROM zr JOIN slots USING (path_id, band_id)")
def _fn2(spark, sf_dir):
    return r8(X.extract_bands(shifted(spark, sf_dir), 3, 60.0, 9), "value")


@query("fn3_edge_features", f"""WITH {POINTS}, ev AS (SELECT path_id, segment_id AS k, max(CASE WHEN energy <= 0 THEN energy END) AS vbm, min(CASE WHEN energy >= 0 THEN energy END) AS cbm FROM p GROUP BY ALL), ew AS (SELECT *, min(CASE WHEN vbm IS NOT NULL AND cbm IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY path_id) AS whole FROM ev),
env AS (SELECT path_id, CAST(k AS DOUBLE) AS k, vbm, cbm FROM ew WHERE whole = 1), {resample_sql('l', 'env', 'path_id', 32, y='vbm')}, {resample_sql('u_', 'env', 'path_id', 32, y='cbm')},
d AS (SELECT path_id, 'vbm' AS edge, cell AS k_idx, least(value, 0) AS energy FROM lr UNION ALL SELECT path_id, 'cbm', cell, greatest(value, 0) FROM u_r), {_power_sums('k_idx', 'energy', 'path_id, edge', 'k_idx')},
top AS (SELECT path_id, edge, first(k_idx ORDER BY CASE WHEN edge = 'vbm' THEN -energy ELSE energy END, k_idx) AS top FROM d GROUP BY ALL)
SELECT path_id, edge, k_idx AS cell, round(energy, 8) AS energy, round(2 * (t2 * (n * s2 - s1 * s1) - t1 * (n * s3 - s1 * s2) + t0 * (s1 * s3 - s2 * s2)) / (s4 * (n * s2 - s1 * s1) - s3 * (n * s3 - s1 * s2) + s2 * (s1 * s3 - s2 * s2)), 8) AS curvature, round((k_idx - top) / 31.0, 8) AS distance FROM u JOIN top USING (path_id, edge)""")
def _fn3(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("k_idx", F.col("segment_id")).withColumn("k", F.col("segment_id").cast("double"))
    return r8(X.edge_features(p, 32), "energy", "curvature", "distance")


@query("ag25_resampling_audit", f"""WITH {PICKED}, grid AS (SELECT path_id, band_id, segment_id, segment_id * 9 + cell AS k_idx, value AS energy FROM zr), {diagnostics_sql('f_', 'd')}, {diagnostics_sql('g_', 'picked')}, {diagnostics_sql('h_', 'grid')}
SELECT *, 'raw_full' AS stage FROM f_z UNION ALL SELECT *, 'raw_selected' FROM g_z UNION ALL SELECT *, 'resampled' FROM h_z""")
def _ag25(spark, sf_dir):
    return r8(X.resampling_audit(shifted(spark, sf_dir), 3, 60.0, 9), "min_separation", "dispersion")


@query("fn12_directional_mass", f"""WITH {DAILY}, w0 AS (SELECT *, list(struct_pack(k := k, e := energy, s := segment_id, i := k_idx)) OVER (PARTITION BY path_id, band_id ORDER BY k_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w, row_number() OVER (PARTITION BY path_id, band_id ORDER BY energy, k_idx) AS o FROM d),
best AS (SELECT path_id, band_id, k_idx, w, len(w) = 5 AND coalesce(w[3].i, -1) = k_idx AND len(list_distinct([z.s for z in w])) = 1 AS inside FROM w0 WHERE o = 1), mine AS (SELECT path_id, band_id, unnest(w) AS v FROM best),
near AS (SELECT m.path_id, m.band_id, d.band_id AS other, min(abs(d.energy - m.v.e)) AS m, count(DISTINCT sign(d.energy - m.v.e)) AS s FROM mine m JOIN d ON d.path_id = m.path_id AND d.k_idx = m.v.i AND d.band_id <> m.band_id GROUP BY ALL), touched AS (SELECT DISTINCT path_id, band_id FROM near WHERE m <= 1e-6 OR s > 1),
xy AS (SELECT b.*, t.path_id IS NOT NULL AS touched, [z.k - w[3].k for z in w] AS x, [z.e - w[3].e for z in w] AS y FROM best b LEFT JOIN touched t USING (path_id, band_id)),
sums AS (SELECT *, list_sum(x) AS s1, list_sum([a ** 2 for a in x]) AS s2, list_sum([a ** 3 for a in x]) AS s3, list_sum([a ** 4 for a in x]) AS s4, list_sum(y) AS t0, list_sum([x[i] * y[i] for i in range(1, 6)]) AS t1, list_sum([x[i] ** 2 * y[i] for i in range(1, 6)]) AS t2, (y[4] / x[4] - y[2] / x[2]) / (x[4] - x[2]) AS a3 FROM xy),
fit AS (SELECT *, (t2 * (5 * s2 - s1 * s1) - t1 * (5 * s3 - s1 * s2) + t0 * (s1 * s3 - s2 * s2)) / (s4 * (5 * s2 - s1 * s1) - s3 * (5 * s3 - s1 * s2) + s2 * (s1 * s3 - s2 * s2)) AS a5 FROM sums),
told AS (SELECT *, CASE WHEN NOT inside THEN 'end of segment' WHEN touched THEN 'branch not isolated' WHEN NOT (y[2] > 0 AND y[4] > 0) OR a5 <= 0 OR abs(a5 - a3) > 1e-5 * abs(a3) THEN 'not quadratic' ELSE 'local quadratic fit' END AS reason FROM fit)
SELECT path_id, band_id, k_idx, reason, CASE WHEN reason = 'local quadratic fit' THEN round(1 / (2 * a5), 8) END AS mass FROM told""")
def _fn12(spark, sf_dir):
    return X.directional_mass(daily(spark, sf_dir), True).withColumn("mass", F.round("mass", 8))


@query("ag28_eligibility", "SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'k is a scalar' END, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'k and segments differ' END, CASE WHEN event_id % 2 = 0 THEN 'no reciprocal unit' END, 'source binding not verified', 'derivatives not certified') AS reasons FROM events")
def _ag28(spark, sf_dir):
    e = F.col("event_id")
    reasons = X.derivative_eligibility(F.when(e % 3 == 0, 1).otherwise(3), F.lit(10), F.when(e % 5 == 0, 9).otherwise(10), F.when(e % 2 == 1, "1/angstrom"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(reasons, ",").alias("reasons"))


TRACKS = """x AS (SELECT l_orderkey AS sample_id, l_extendedprice AS pred, p_retailprice * l_quantity AS target, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS r FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("ag29_trajectory_matching", f"""WITH {TRACKS}, n AS (SELECT sample_id, count(*) AS n FROM x GROUP BY 1), p AS (SELECT a.sample_id, a.r // 2 AS k, a.r // 4 AS seg, a.pred AS p0, a.target AS t0, b.pred AS p1, b.target AS t1 FROM x a JOIN x b ON a.sample_id = b.sample_id AND a.r % 2 = 0 AND b.r = a.r + 1),
q AS (SELECT *, abs(p0 - t0) + abs(p1 - t1) AS own, abs(p0 - t1) + abs(p1 - t0) AS swap, abs(least(p0, p1) - least(t0, t1)) + abs(greatest(p0, p1) - greatest(t0, t1)) AS sorted FROM p),
s AS (SELECT sample_id, seg, least(sum(own), sum(swap)) AS best FROM q GROUP BY ALL), g AS (SELECT sample_id, sum(best) AS best FROM s GROUP BY 1), o AS (SELECT sample_id, sum(own) AS own, least(sum(own), sum(swap)) AS best, sum(sorted) AS sorted FROM q GROUP BY 1),
y AS (SELECT sample_id, avg(abs(pred - target)) AS one FROM x GROUP BY 1)
SELECT n.sample_id, CASE WHEN n = 1 OR n % 2 = 0 THEN 'ok' ELSE 'incomplete' END AS status, CASE WHEN n = 1 THEN round(one, 7) WHEN n % 2 = 0 THEN round(o.own / n, 7) END AS slot, CASE WHEN n = 1 THEN round(one, 7) WHEN n % 2 = 0 THEN round(g.best / n, 7) END AS by_segment, CASE WHEN n = 1 THEN round(one, 7) WHEN n % 2 = 0 THEN round(o.best / n, 7) END AS overall, CASE WHEN n = 1 THEN round(one, 7) WHEN n % 2 = 0 THEN round(o.sorted / n, 7) END AS transport FROM n JOIN y USING (sample_id) LEFT JOIN g USING (sample_id) LEFT JOIN o USING (sample_id)""")
def _ag29(spark, sf_dir):
    """Two bands at several k of several segments: the best assignment keeps or swaps them, which SQL can tell; an odd line is incomplete."""
    from pyspark.sql import Window

    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    rows = line.join(part, line["l_partkey"] == part["p_partkey"]).withColumn("r", r)
    rows = rows.select(F.col("l_orderkey").alias("sample_id"), (F.col("r") % 2).alias("band"), F.floor(F.col("r") / 4).alias("segment_id"), F.floor(F.col("r") / 2).alias("k_idx"), F.col("l_extendedprice").alias("pred"), (F.col("p_retailprice") * F.col("l_quantity")).alias("target"))
    return X.trajectory_matching(rows).withColumns({c: F.round(c, 7) for c in ("slot", "by_segment", "overall", "transport")})


@query("ag42_preparation_report", """WITH u AS (SELECT user_id % 2 AS split, user_id, count(DISTINCT event_type) AS bands, CASE WHEN user_id % 7 = 0 THEN 'no energies' WHEN count(*) < 60 THEN 'too short' END AS reason FROM events GROUP BY user_id),
w AS (SELECT split, reason, count(*) AS n FROM u WHERE reason IS NOT NULL GROUP BY ALL), y AS (SELECT split, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM w GROUP BY split)
SELECT split, count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE reason IS NOT NULL) AS excluded, avg(bands) FILTER (WHERE reason IS NULL) AS mean_bands, avg(CAST(bands >= 5 AS DOUBLE)) FILTER (WHERE reason IS NULL) AS at_capacity, any_value(reasons) AS reasons FROM u LEFT JOIN y USING (split) GROUP BY split""")
def _ag42(spark, sf_dir):
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("bands"), F.count("*").alias("n"))
    u = u.withColumn("split", F.col("user_id") % 2).withColumn("reason", F.when(F.col("user_id") % 7 == 0, "no energies").when(F.col("n") < 60, "too short"))
    return X.preparation_report(u, "split", "reason", "bands", 5)


@query("key11_content_fingerprint")
def _key11(spark, sf_dir):
    p = points(spark, sf_dir).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("k_idx", "k", "energy"))).alias("x"))
    return p.select("path_id", X.content_fingerprint(F.transform("x", lambda v: v["k"]), F.array(F.transform("x", lambda v: v["energy"]))).alias("fingerprint"))


@query("fn16_pixel_trace", "SELECT event_id, round(CASE WHEN user_id % 6 = 0 OR value > 200 OR value < 0.5 THEN NULL ELSE (value - 0.5) / 199.5 END, 9) AS k, round(CASE WHEN user_id % 6 = 0 OR value > 200 OR value < 0.5 THEN NULL ELSE (event_id % 50 - 10) * CAST(-0.1 AS DOUBLE) END, 9) + 0 AS energy, CASE WHEN user_id % 6 = 0 THEN 'anchors coincide' WHEN value > 200 OR value < 0.5 THEN 'outside the k interval' END AS problem FROM events")
def _fn16(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    pts = e.select("event_id", F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    anchors = e.select("event_id", F.lit(0.5).alias("px1"), F.lit(0.0).alias("kx1"), F.when(F.col("user_id") % 6 == 0, 0.5).otherwise(200.0).alias("px2"), F.lit(1.0).alias("kx2"), F.lit(0.0).alias("py1"), F.lit(1.0).alias("ey1"), F.lit(20.0).alias("py2"), F.lit(-1.0).alias("ey2"), F.lit(10.0).alias("level_y"))
    return X.pixel_trace(pts, anchors, "event_id").select("event_id", F.round("k", 9).alias("k"), (F.round("energy", 9) + F.lit(0)).alias("energy"), "problem")


@query("src8_mesh_document", "SELECT s_suppkey AS id, 1 AS spin, k AS k_idx, b AS band_idx, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal + k * 2 + b END AS energy, CASE WHEN s_suppkey % 5 > 0 THEN CAST(1.0 - b AS DOUBLE) END AS occupancy, CAST(0.5 AS DOUBLE) AS weight, 'ok' AS status FROM supplier, (SELECT CAST(unnest(range(2)) AS INT) AS k), (SELECT CAST(unnest(range(2)) AS INT) AS b) WHERE s_suppkey % 5 > 0 UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, 'not a uniform mesh' FROM supplier WHERE s_suppkey % 5 = 0")
def _src8(spark, sf_dir):
    s = F.col("s_acctbal")
    r = lambda k, b: F.concat(F.lit("<r>"), (s + (k * 2 + b)).cast("string"), F.lit(f" {1.0 - b}</r>"))
    kp = lambda k: F.concat(F.lit(f'<kpoint n="{k + 1}">'), r(k, 0), r(k, 1), F.lit("</kpoint>"))
    kind = F.when(F.col("s_suppkey") % 5 == 0, "listgenerated").otherwise("Monkhorst-Pack")
    xml = F.concat(F.lit('<mesh><generation param="'), kind, F.lit('"/><weights>0.5</weights><weights>0.5</weights><spin n="1">'), kp(0), kp(1), F.lit("</spin></mesh>"))
    return X.mesh_of_xml(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), xml.alias("t")), "id", "t")


@query("src10_bound_assets", "SELECT CAST(s_suppkey AS VARCHAR) AS name, length(s_name) + 1 AS size, CASE WHEN s_suppkey % 4 = 0 THEN 'changed' ELSE 'bound' END AS state FROM supplier")
def _src10(spark, sf_dir):
    """A file a supplier in the shared folder, scanned as bytes and bound to a manifest by digest."""
    rows, path = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_name").alias("value"), (F.col("s_suppkey") % 4 == 0).alias("old")), shared_folder(spark, "assets")
    S.write_texts(rows, path)
    manifest = rows.select("name", F.when(F.col("old"), "0").otherwise(F.sha2(F.concat("value", F.lit("\n")), 256)).alias("sha256"))
    return S.assets(spark, path, manifest, S.NAMED).select("name", F.col("size").cast("int").alias("size"), "state")
