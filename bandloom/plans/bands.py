"""Queries on sampled curves: a path is a user's events, a band an event type, a segment a week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bands as B
from ..operators import measure as M
from ..registry import query, read

POINTS = """
e AS (SELECT user_id AS path_id, event_type AS band_id, ts, event_id, value,
             date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
p AS (SELECT path_id, band_id, CAST(day // 7 AS INT) AS segment_id, CAST(day AS INT) AS day,
             CAST(row_number() OVER (PARTITION BY path_id ORDER BY ts, event_id) - 1 AS INT) AS k_idx,
             round(date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600.0, 8) AS k,
             round(value - floor(avg(value) OVER (PARTITION BY path_id)), 2) AS energy FROM e)
"""
DAILY = POINTS + """,
d AS (SELECT path_id, band_id, segment_id, day AS k_idx, day * 1.0 AS k, round(avg(energy), 8) AS energy FROM p GROUP BY ALL)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of curves; energies are relative to the whole part of the path's mean."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("path_id"), F.col("event_type").alias("band_id"), "ts", "event_id", "value")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    order = Window.partitionBy("path_id").orderBy("ts", "event_id")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return e.select(
        "path_id", "band_id", F.floor(day / 7).cast("int").alias("segment_id"), day.alias("day"), (F.row_number().over(order) - 1).alias("k_idx"),
        F.round(seconds / F.lit(3600.0), 8).alias("k"), F.round(F.col("value") - F.floor(M.exact_mean("value", ["path_id"])), 2).alias("energy"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample a band and day."""
    p = points(spark, sf_dir).groupBy("path_id", "band_id", "segment_id", F.col("day").alias("k_idx")).agg(F.round(F.avg("energy"), 8).alias("energy"))
    return p.withColumn("k", F.col("k_idx") * F.lit(1.0))


def places(c: str, digits: int = 8) -> Column:
    """A double rounded as the SQL does it: the product by a power of ten, half away from zero.

    The product swallows the last bits of noise, so a tie (the ninth digit of splines at eighths) stays one.
    """
    return F.round(F.col(c) * F.lit(10.0**digits)) / F.lit(10.0**digits)


def r8(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: places(c) for c in cols})


query("src1_band_points", f"WITH {POINTS} SELECT * FROM p")(points)


@query("ag1_band_ranges", f"WITH {POINTS} SELECT path_id, band_id, min(energy) AS low, max(energy) AS high, round(avg(energy), 8) AS mean, count(energy) AS n FROM p GROUP BY ALL")
def _ag1(spark, sf_dir):
    return r8(B.band_ranges(points(spark, sf_dir)), "mean")


ENVELOPES = "v AS (SELECT path_id, day, max(CASE WHEN energy <= 0 THEN energy END) AS vbm, min(CASE WHEN energy >= 0 THEN energy END) AS cbm FROM p GROUP BY ALL)"


@query("ag2_edge_envelopes", f"WITH {POINTS}, {ENVELOPES} SELECT path_id, day, vbm, cbm, min(CASE WHEN vbm IS NOT NULL AND cbm IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY path_id) = 1 AS complete FROM v")
def _ag2(spark, sf_dir):
    return B.edge_envelopes(points(spark, sf_dir), at="day")


@query("ag3_frontier_bands", f"""WITH {DAILY},
r AS (SELECT path_id, band_id, min(energy) AS low, max(energy) AS high FROM d WHERE segment_id = 1 GROUP BY ALL),
f AS (SELECT *, high <= 0 AS below, low >= 0 AS above, row_number() OVER (PARTITION BY path_id ORDER BY abs(high), band_id) AS nv FROM r),
m AS (SELECT path_id, max(CASE WHEN NOT below AND NOT above THEN 1 ELSE 0 END) AS mixed, max(struct_pack(e := high, b := band_id)) FILTER (WHERE below) AS v,
      min(struct_pack(e := low, b := band_id)) FILTER (WHERE above) AS c, max(band_id) FILTER (WHERE nv = 1) AS near FROM f GROUP BY path_id),
o AS (SELECT f.path_id, min(struct_pack(e := abs(low), b := band_id)).b AS far FROM f JOIN m USING (path_id) WHERE band_id <> near GROUP BY ALL)
SELECT m.path_id, CASE WHEN mixed = 0 AND v IS NOT NULL AND c IS NOT NULL THEN v.b ELSE near END AS valence,
       CASE WHEN mixed = 0 AND v IS NOT NULL AND c IS NOT NULL THEN c.b ELSE far END AS conduction,
       mixed = 0 AND v IS NOT NULL AND c IS NOT NULL AS clean FROM m LEFT JOIN o USING (path_id)""")
def _ag3(spark, sf_dir):
    return B.frontier_bands(daily(spark, sf_dir).filter("segment_id = 1"))


@query("ag4_crossing_band", f"""WITH {POINTS},
s AS (SELECT path_id, band_id, segment_id, min(energy) AS low, max(energy) AS high, min(abs(energy)) AS near FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY near, band_id) AS k FROM s WHERE low <= 0 AND high >= 0)
SELECT path_id, band_id, near FROM r WHERE k = 1""")
def _ag4(spark, sf_dir):
    return B.crossing_band(points(spark, sf_dir))


@query("ag5_extrema_gap", f"WITH {POINTS} SELECT path_id, round(min(CASE WHEN band_id IN ('purchase', 'signup') THEN energy END) - max(CASE WHEN band_id NOT IN ('purchase', 'signup') THEN energy END), 8) AS gap FROM p GROUP BY path_id")
def _ag5(spark, sf_dir):
    return r8(M.extrema_gap(points(spark, sf_dir), F.col("band_id").isin("purchase", "signup")), "gap")


GAP = """
s AS (SELECT path_id, band_id, segment_id, min(energy) AS low, max(energy) AS high FROM d GROUP BY ALL),
b AS (SELECT path_id, band_id, min(low) AS low, max(high) AS high, max(CASE WHEN low < 0 AND high > 0 THEN 1 ELSE 0 END) AS x FROM s GROUP BY ALL),
g AS (SELECT path_id, max(CASE WHEN high <= 0 THEN high END) AS vbm, min(CASE WHEN low >= 0 AND high > 0 THEN low END) AS cbm, max(x) AS x,
      max(CASE WHEN NOT high <= 0 AND NOT (low >= 0 AND high > 0) THEN 1 ELSE 0 END) AS mixed, count(*) AS bands FROM b GROUP BY path_id)
"""
SHIFTED = DAILY.replace("d AS (", "d0 AS (") + """,
d AS (SELECT path_id, band_id, segment_id, k_idx, k, round(energy + CASE WHEN path_id % 3 = 0 AND band_id IN ('view', 'click') THEN -400 WHEN path_id % 3 = 0 THEN 400 ELSE 0 END, 8) AS energy FROM d0)
"""


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily samples; a third of the paths have bands that lie well apart."""
    move = F.when((F.col("path_id") % 3 == 0) & F.col("band_id").isin("view", "click"), -400).when(F.col("path_id") % 3 == 0, 400).otherwise(0)
    return daily(spark, sf_dir).withColumn("energy", F.round(F.col("energy") + move, 8))


@query("ag6_path_gap", f"""WITH {SHIFTED}, {GAP}
SELECT path_id, CASE WHEN x = 1 THEN 0.0 WHEN mixed = 0 AND cbm > vbm THEN round(cbm - vbm, 8) END AS gap,
       CASE WHEN x = 1 THEN 'metal' WHEN mixed = 0 AND cbm > vbm THEN 'gapped' ELSE 'unknown' END AS topology, bands FROM g""")
def _ag6(spark, sf_dir):
    return r8(B.path_gap(shifted(spark, sf_dir)), "gap")


CROSS = """
r AS (SELECT *, sum(CASE WHEN energy IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY path_id, band_id, segment_id ORDER BY k_idx) AS run FROM p),
z AS (SELECT path_id, band_id, segment_id, k_idx, energy, lag(energy) OVER w AS before, lag(k_idx) OVER w AS k_before FROM r WHERE energy <> 0
      WINDOW w AS (PARTITION BY path_id, band_id, segment_id, run ORDER BY k_idx))
"""


@query("wn4_sign_crossings", f"WITH {POINTS}, {CROSS} SELECT path_id, band_id, segment_id, k_before, k_idx, before, energy FROM z WHERE sign(energy) <> sign(before)")
def _wn4(spark, sf_dir):
    return B.sign_crossings(points(spark, sf_dir))


@query("ag7_line_measurement", f"""WITH {POINTS}, {CROSS},
c AS (SELECT path_id, count(*) AS crossings FROM z WHERE sign(energy) <> sign(before) GROUP BY path_id),
v AS (SELECT path_id, max(energy) FILTER (WHERE energy <= 0) AS vbm, min(energy) FILTER (WHERE energy >= 0) AS cbm, count(*) AS n, count(energy) AS seen FROM p GROUP BY path_id),
t AS (SELECT path_id, count(*) FILTER (WHERE abs(energy - vbm) <= 1e-8) AS top_ties, count(*) FILTER (WHERE abs(energy - cbm) <= 1e-8) AS bottom_ties FROM p JOIN v USING (path_id) GROUP BY path_id)
SELECT path_id, CASE WHEN seen < n OR n < 3 THEN 'refused' WHEN coalesce(crossings, 0) > 0 OR (vbm IS NOT NULL AND cbm IS NOT NULL) THEN 'ok' ELSE 'unknown' END AS status,
       coalesce(crossings, 0) AS crossings, vbm, cbm, CASE WHEN coalesce(crossings, 0) > 0 THEN 0.0 ELSE round(cbm - vbm, 8) END AS gap, top_ties, bottom_ties
FROM v LEFT JOIN c USING (path_id) JOIN t USING (path_id)""")
def _ag7(spark, sf_dir):
    return r8(M.measure_lines(points(spark, sf_dir)), "gap")


@query("ag9_observation_counts", f"""WITH {POINTS},
o AS (SELECT path_id, band_id, CASE WHEN k_idx % 7 = 3 THEN NULL ELSE energy END AS energy FROM p),
b AS (SELECT path_id, band_id, count(*) AS n, count(energy) AS seen FROM o GROUP BY ALL)
SELECT path_id, CAST(sum(seen) AS BIGINT) AS observed, CAST(sum(n - seen) AS BIGINT) AS missing, count(*) FILTER (WHERE n = seen) AS complete_bands, count(*) FILTER (WHERE n > seen) AS partial_bands FROM b GROUP BY path_id""")
def _ag9(spark, sf_dir):
    return M.observation_counts(holed(spark, sf_dir))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of which every seventh is missing."""
    return points(spark, sf_dir).withColumn("energy", F.when(F.col("k_idx") % 7 != 3, F.col("energy")))


@query("snk4_long_samples", f"WITH {POINTS} SELECT path_id, band_id, k_idx, CASE WHEN k_idx % 7 = 3 THEN NULL ELSE energy END AS energy, CASE WHEN k_idx % 7 = 3 THEN 'missing' ELSE 'observed' END AS sample_state FROM p")
def _snk4(spark, sf_dir):
    return B.long_samples(holed(spark, sf_dir)).select("path_id", "band_id", "k_idx", "energy", "sample_state")


@query("wn1_path_segments", f"WITH {POINTS}, s AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY path_id ORDER BY k_idx) <= 1e-12 THEN 1 ELSE 0 END AS b FROM p) SELECT path_id, k_idx, CAST(sum(b) OVER (PARTITION BY path_id ORDER BY k_idx) AS BIGINT) AS segment FROM s")
def _wn1(spark, sf_dir):
    return B.segments(points(spark, sf_dir).withColumn("k", F.col("day"))).select("path_id", "k_idx", "segment")


@query("wn2_label_segments", """WITH e AS (SELECT user_id AS path_id, CAST(value AS INT) % 40 AS position FROM events WHERE event_type = 'error'),
a AS (SELECT path_id, position FROM e UNION SELECT DISTINCT path_id, 0 FROM e UNION SELECT DISTINCT path_id, 39 FROM e),
s AS (SELECT path_id, position, lead(position) OVER w AS nxt, CAST(row_number() OVER w - 1 AS INT) AS segment FROM a WINDOW w AS (PARTITION BY path_id ORDER BY position))
SELECT path_id, segment, CAST(unnest(range(position, CASE WHEN nxt = 39 THEN 40 ELSE nxt END)) AS INT) AS k_idx FROM s WHERE nxt IS NOT NULL""")
def _wn2(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("event_type = 'error'")
    labels = e.select(F.col("user_id").alias("path_id"), (F.rint("value").cast("int") % 40).alias("position"))
    return B.label_segments(labels, 39)


def _power_sums(x: str, y: str, part: str, order: str) -> str:
    return f"""w AS (SELECT *, list(struct_pack(x := CAST({x} AS DOUBLE), y := {y})) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS q FROM d),
u AS (SELECT *, len(q) * 1.0 AS n, list_sum([z.x - {x} for z in q]) AS s1, list_sum([(z.x - {x}) ** 2 for z in q]) AS s2, list_sum([(z.x - {x}) ** 3 for z in q]) AS s3, list_sum([(z.x - {x}) ** 4 for z in q]) AS s4,
      list_sum([z.y for z in q]) AS t0, list_sum([(z.x - {x}) * z.y for z in q]) AS t1, list_sum([(z.x - {x}) ** 2 * z.y for z in q]) AS t2 FROM w)"""


@query("wn3_quadratic_curvature", f"""WITH {DAILY}, {_power_sums('k_idx', 'energy', 'path_id, band_id, segment_id', 'k_idx')}
SELECT path_id, band_id, k_idx, round(CASE WHEN n >= 3 AND s4 * (n * s2 - s1 * s1) - s3 * (n * s3 - s1 * s2) + s2 * (s1 * s3 - s2 * s2) <> 0
  THEN 2 * (t2 * (n * s2 - s1 * s1) - t1 * (n * s3 - s1 * s2) + t0 * (s1 * s3 - s2 * s2)) / (s4 * (n * s2 - s1 * s1) - s3 * (n * s3 - s1 * s2) + s2 * (s1 * s3 - s2 * s2)) ELSE 0 END, 8) + 0 AS curvature FROM u""")
def _wn3(spark, sf_dir):
    got = B.quadratic_curvature(daily(spark, sf_dir), ["path_id", "band_id", "segment_id"])
    return got.select("path_id", "band_id", "k_idx", (F.round("curvature", 8) + F.lit(0)).alias("curvature"))


@query("wn5_extremum_distance", f"""WITH {POINTS}, a AS (SELECT path_id, k_idx, first_value(k_idx) OVER (PARTITION BY path_id ORDER BY energy DESC, k_idx) AS top, count(*) OVER (PARTITION BY path_id) AS n FROM p)
SELECT path_id, k_idx, round(CASE WHEN n > 1 THEN (k_idx - top) / (n - 1) ELSE 0 END, 9) AS distance FROM a""")
def _wn5(spark, sf_dir):
    return B.extremum_distance(points(spark, sf_dir), True).select("path_id", "k_idx", F.round("distance", 9).alias("distance"))


@query("wn6_smooth_trace", f"""WITH {POINTS},
n AS (SELECT path_id, max(k_idx) AS last FROM p GROUP BY path_id),
o AS (SELECT path_id, k_idx, last, unnest([-2, -1, 0, 1, 2]) AS d FROM p JOIN n USING (path_id)),
m AS (SELECT o.path_id, o.k_idx, last, median(p.energy) AS med FROM o JOIN p ON p.path_id = o.path_id AND p.k_idx = greatest(0, least(last, o.k_idx + d)) GROUP BY ALL),
o2 AS (SELECT path_id, k_idx, last, unnest([-2, -1, 0, 1, 2]) AS d FROM m)
SELECT o2.path_id, o2.k_idx, round(sum(m.med) / 5, 8) AS smooth FROM o2 JOIN m ON m.path_id = o2.path_id AND m.k_idx = greatest(0, least(o2.last, o2.k_idx + d)) GROUP BY ALL""")
def _wn6(spark, sf_dir):
    return B.smooth_trace(points(spark, sf_dir)).select("path_id", "k_idx", places("smooth").alias("smooth"))


@query("wn7_contiguous_runs", f"""WITH {POINTS}, n AS (SELECT *, coalesce(CAST(lag(band_id) OVER w <> band_id AS INT), 1) AS new, lag(k) OVER w AS kb FROM p WINDOW w AS (PARTITION BY path_id ORDER BY k_idx))
SELECT path_id, band_id, CAST(sum(new) AS BIGINT) AS runs, min(CASE WHEN new = 1 OR k > kb THEN 1 ELSE 0 END) AS strict FROM n GROUP BY ALL""")
def _wn7(spark, sf_dir):
    return B.contiguous_runs(points(spark, sf_dir), ["path_id"], "band_id")


@query("wn8_binned_extremes", f"""WITH {POINTS}, b AS (SELECT *, min(k) OVER (PARTITION BY path_id) AS lo, max(k) OVER (PARTITION BY path_id) AS hi FROM p)
SELECT path_id, CAST(CASE WHEN hi > lo THEN least(11, floor((k - lo) / (hi - lo) * 12)) ELSE 0 END AS INT) AS bin, max(energy) FILTER (WHERE energy <= 0) AS valence, min(energy) FILTER (WHERE energy > 0) AS conduction, count(*) AS n FROM b GROUP BY ALL""")
def _wn8(spark, sf_dir):
    return B.binned_extremes(points(spark, sf_dir), 12)


@query("wn9_span_mask", f"""WITH {POINTS},
c AS (SELECT path_id, segment_id, k_idx, CAST((row_number() OVER (PARTITION BY path_id, segment_id ORDER BY k_idx) - 1) // 3 AS BIGINT) AS cell FROM p),
s AS (SELECT path_id, segment_id, cell, count(*) AS size FROM c GROUP BY ALL),
o AS (SELECT *, sum(size) OVER (PARTITION BY path_id ORDER BY md5(concat_ws('|', 'm1', path_id, segment_id, cell)), segment_id, cell) AS upto, sum(size) OVER (PARTITION BY path_id) AS n FROM s),
m AS (SELECT *, abs(upto / n - (0.15 + ('0x' || substr(md5(concat_ws('|', 'm1', path_id)), 1, 8))::BIGINT / 4294967296.0 * (0.3 - 0.15))) AS miss FROM o),
b AS (SELECT path_id, segment_id, cell, upto <= first_value(upto) OVER (PARTITION BY path_id ORDER BY miss, upto) AS masked FROM m)
SELECT path_id, segment_id, k_idx, masked FROM c JOIN b USING (path_id, segment_id, cell)""")
def _wn9(spark, sf_dir):
    return B.span_mask(points(spark, sf_dir), 3, 0.15, 0.30, "m1").select("path_id", "segment_id", "k_idx", "masked")


WINDOW = """r AS (SELECT path_id, band_id, min(energy) AS low, max(energy) AS high FROM d GROUP BY ALL),
f AS (SELECT *, high <= 0 AS below, low >= 0 AS above, max(CASE WHEN NOT high <= 0 AND NOT low >= 0 THEN 1 ELSE 0 END) OVER w AS mixed, max(CAST(high <= 0 AS INT)) OVER w + max(CAST(low >= 0 AS INT)) OVER w AS sides,
      low <= 60 AND high >= -60 AS overlap, max(CAST(low <= 60 AND high >= -60 AS INT)) OVER w AS any_in FROM r WINDOW w AS (PARTITION BY path_id)),
s AS (SELECT *, mixed = 0 AND sides = 2 AS clean, CASE WHEN mixed = 0 AND sides = 2 THEN CASE WHEN below THEN 0 ELSE 1 END ELSE 2 END AS side, CASE WHEN below THEN -high WHEN above THEN low ELSE 0 END AS distance FROM f),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY path_id, side ORDER BY CAST(overlap AS INT) DESC, distance, band_id) AS INT) AS rank FROM s),
chosen AS (SELECT * FROM k WHERE rank <= CASE side WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE CASE WHEN any_in = 1 THEN 3 ELSE 2 END END AND (clean OR overlap OR any_in = 0))"""


@query("tk3_fermi_window", f"WITH {SHIFTED}, {WINDOW} SELECT path_id, band_id, side, rank, round(distance, 8) AS distance FROM chosen")
def _tk3(spark, sf_dir):
    return r8(B.fermi_window(shifted(spark, sf_dir), 3, 60.0), "distance")


def resample_sql(p: str, source: str, keys: str, size: int, x: str = "k", y: str = "energy") -> str:
    """CTEs that resample ``source``; the last one, named ``p`` and r, has the keys, cell and value."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    own = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"""{p}x AS (SELECT {keys}, {x} AS x, avg({y}) AS y FROM {source} WHERE {y} IS NOT NULL GROUP BY ALL),
{p}a AS (SELECT *, lead(x) OVER o - x AS h, (lead(y) OVER o - y) / (lead(x) OVER o - x) AS dd, count(*) OVER (PARTITION BY {keys}) AS n, row_number() OVER o AS i FROM {p}x WINDOW o AS (PARTITION BY {keys} ORDER BY x)),
{p}b AS (SELECT *, lag(h) OVER o AS h0, lag(dd) OVER o AS d0, lead(h) OVER o AS h2, lead(dd) OVER o AS d2, lag(h, 2) OVER o AS h00, lag(dd, 2) OVER o AS d00 FROM {p}a WINDOW o AS (PARTITION BY {keys} ORDER BY x)),
{p}c AS (SELECT *, ((2 * h + h2) * dd - h * d2) / (h + h2) AS e1, ((2 * h0 + h00) * d0 - h0 * d00) / (h0 + h00) AS e2 FROM {p}b),
{p}m AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN coalesce(dd, d0)
      WHEN i = 1 THEN CASE WHEN sign(e1) <> sign(dd) THEN 0 WHEN sign(dd) <> sign(d2) AND abs(e1) > 3 * abs(dd) THEN 3 * dd ELSE e1 END
      WHEN i = n THEN CASE WHEN sign(e2) <> sign(d0) THEN 0 WHEN sign(d0) <> sign(d00) AND abs(e2) > 3 * abs(d0) THEN 3 * d0 ELSE e2 END
      WHEN d0 * dd <= 0 THEN 0 ELSE (3 * h + 3 * h0) / ((2 * h + h0) / d0 + (h + 2 * h0) / dd) END AS m FROM {p}c),
{p}q AS (SELECT {keys}, x, y, h, m, lead(y) OVER o AS y1, lead(m) OVER o AS m1, min(x) OVER g AS lo, max(x) OVER g AS hi, n, i FROM {p}m WINDOW o AS (PARTITION BY {keys} ORDER BY x), g AS (PARTITION BY {keys})),
{p}g AS (SELECT DISTINCT {keys}, lo, hi, n, unnest(range({size})) AS cell FROM {p}q),
{p}t AS (SELECT {own}, g.cell, q.y, q.n, q.h, q.m, q.y1, q.m1, CASE WHEN g.n = 1 THEN 0 ELSE (g.lo + g.cell * (g.hi - g.lo) / {size - 1} - q.x) / q.h END AS t,
      row_number() OVER (PARTITION BY {own}, g.cell ORDER BY q.x DESC) AS k
      FROM {p}g g JOIN {p}q q ON {same("g", "q")} AND (g.n = 1 OR (q.h IS NOT NULL AND q.x <= g.lo + g.cell * (g.hi - g.lo) / {size - 1} + 1e-9))),
{p}r AS (SELECT {keys}, CAST(cell AS INT) AS cell, CASE WHEN n = 1 THEN y ELSE (1 + 2 * t) * (1 - t) * (1 - t) * y + t * (1 - t) * (1 - t) * h * m + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * m1 END AS value FROM {p}t WHERE k = 1)"""


@query("fn1_resample", f"WITH {DAILY}, {resample_sql('z', 'd', 'path_id, band_id', 17)} SELECT path_id, band_id, cell, round(value, 10) + 0 AS value FROM zr")
def _fn1(spark, sf_dir):
    return B.resample(daily(spark, sf_dir), 17, ["path_id", "band_id"]).select("path_id", "band_id", "cell", (F.round("value", 10) + F.lit(0)).alias("value"))


@query("jn16_nearest_sample", f"""WITH {POINTS},
l AS (SELECT DISTINCT path_id, CAST(v AS VARCHAR) AS label, CAST(v AS DOUBLE) AS label_k FROM p, (SELECT unnest([0, 150, 333, 500]) AS v)),
j AS (SELECT l.*, k_idx, abs(k - label_k) AS off, row_number() OVER (PARTITION BY path_id, label ORDER BY abs(k - label_k), k_idx) AS r FROM l JOIN p USING (path_id))
SELECT path_id, label, label_k, k_idx, round(off, 8) AS off FROM j WHERE r = 1""")
def _jn16(spark, sf_dir):
    p = points(spark, sf_dir)
    at = F.explode(F.array(*[F.lit(x) for x in (0, 150, 333, 500)]))
    labels = p.select("path_id").distinct().select("path_id", at.alias("v")).select("path_id", F.col("v").cast("string").alias("label"), (F.col("v") * F.lit(1.0)).alias("label_k"))
    return r8(B.nearest_sample(labels, p), "off")


PAIRS = "x AS (SELECT l_orderkey AS sample_id, l_linenumber AS band, l_suppkey % 5 AS k_idx, l_extendedprice AS pred, p_retailprice * l_quantity AS target FROM lineitem JOIN part ON l_partkey = p_partkey)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and true energies: line prices against list prices."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("band"), (F.col("l_suppkey") % 5).alias("k_idx"), F.col("l_extendedprice").alias("pred"), (F.col("p_retailprice") * F.col("l_quantity")).alias("target"))


@query("ag21_band_mae", f"WITH {PAIRS} SELECT sample_id, round(avg(abs(pred - target)), 8) AS mae, count(*) AS n FROM x GROUP BY sample_id")
def _ag21(spark, sf_dir):
    return M.band_mae(pairs(spark, sf_dir), ["sample_id"]).withColumn("mae", F.round("mae", 8))


@query("ag22_sorted_mae", f"""WITH {PAIRS},
a AS (SELECT sample_id, k_idx, pred, row_number() OVER (PARTITION BY sample_id, k_idx ORDER BY pred) AS r FROM x), b AS (SELECT sample_id, k_idx, target, row_number() OVER (PARTITION BY sample_id, k_idx ORDER BY target) AS r FROM x)
SELECT sample_id, round(avg(abs(pred - target)), 8) AS sorted_mae, count(*) AS n FROM a JOIN b USING (sample_id, k_idx, r) GROUP BY sample_id""")
def _ag22(spark, sf_dir):
    return B.sorted_mae(pairs(spark, sf_dir), ["sample_id"]).withColumn("sorted_mae", F.round("sorted_mae", 8))


@query("ag23_multiband_gaps", f"""WITH {SHIFTED}, {GAP}, t AS (SELECT path_id, CASE WHEN x = 1 THEN 0.0 WHEN mixed = 0 AND cbm > vbm THEN cbm - vbm END AS target FROM g),
y AS (SELECT path_id, target, CASE WHEN path_id % 4 = 0 THEN NULL ELSE target * 1.1 + (path_id % 5) * 0.5 END AS pred FROM t)
SELECT count(*) AS n, count(*) FILTER (WHERE target > 0) AS insulators, count(*) FILTER (WHERE target = 0) AS metals, count(*) FILTER (WHERE target IS NULL) AS unknown,
       count(*) FILTER (WHERE target IS NOT NULL AND pred IS NOT NULL) AS resolved, round(avg(abs(pred - target)), 8) AS gap_mae, round(avg(abs(pred - target)) FILTER (WHERE target > 0), 8) AS insulator_mae,
       round(avg(CASE WHEN pred > 1e-6 THEN 1.0 ELSE 0.0 END) FILTER (WHERE target = 0 AND pred IS NOT NULL), 8) AS false_gap_rate FROM y""")
def _ag23(spark, sf_dir):
    g = B.path_gap(shifted(spark, sf_dir)).select("path_id", F.col("gap").alias("target"))
    g = g.withColumn("pred", F.when(F.col("path_id") % 4 != 0, F.col("target") * 1.1 + (F.col("path_id") % 5) * 0.5))
    return r8(M.gap_summary(g), "gap_mae", "insulator_mae", "false_gap_rate")


def diagnostics_sql(p: str, source: str) -> str:
    """CTEs of the diagnostics of ``source``; the last one is named ``p`` and z."""
    return f"""{p}o AS (SELECT path_id, segment_id, k_idx, band_id, energy, lag(energy) OVER (PARTITION BY path_id, k_idx ORDER BY band_id) AS under FROM {source}),
{p}i AS (SELECT path_id, segment_id, count(*) FILTER (WHERE energy < under) AS inversions, min(abs(energy - under)) AS min_separation, count(*) FILTER (WHERE energy <= 0) AS occupied, count(*) FILTER (WHERE energy > 0) AS empty FROM {p}o GROUP BY ALL),
{p}b AS (SELECT path_id, segment_id, band_id, var_pop(energy) AS v FROM {source} GROUP BY ALL), {p}v AS (SELECT path_id, segment_id, sqrt(avg(v)) AS dispersion FROM {p}b GROUP BY ALL),
{p}z AS (SELECT path_id, segment_id, inversions, round(min_separation, 8) AS min_separation, occupied, empty, round(dispersion, 8) AS dispersion, CASE WHEN occupied > 0 AND empty > 0 THEN 'both' WHEN occupied > 0 THEN 'valence only' ELSE 'conduction only' END AS frontier FROM {p}i JOIN {p}v USING (path_id, segment_id))"""


@query("ag24_path_diagnostics", f"WITH {DAILY}, {diagnostics_sql('y', 'd')} SELECT * FROM yz")
def _ag24(spark, sf_dir):
    return r8(M.path_diagnostics(daily(spark, sf_dir)), "min_separation", "dispersion")


@query("ag26_window_audit", f"""WITH {SHIFTED}, r AS (SELECT path_id, band_id, min(energy) AS low, max(energy) AS high FROM d GROUP BY ALL)
SELECT path_id, count(*) AS candidates, greatest(0, count(*) - 3) AS dropped, count(*) FILTER (WHERE high <= 0) AS valence, count(*) FILTER (WHERE low >= 0) AS conduction,
       CASE WHEN count(*) FILTER (WHERE high > 0 AND low < 0) > 0 THEN 'window' ELSE 'split' END AS branch, greatest(0, 1 - count(*) FILTER (WHERE high <= 0)) AS valence_underfill, greatest(0, 2 - count(*) FILTER (WHERE low >= 0)) AS conduction_underfill FROM r GROUP BY path_id""")
def _ag26(spark, sf_dir):
    return M.window_audit(shifted(spark, sf_dir), 3)


@query("ag27_coverage_report", f"""WITH {POINTS}, n AS (SELECT path_id, count(*) AS n, count(DISTINCT segment_id) AS segs, count(DISTINCT band_id) AS bands FROM p GROUP BY path_id),
s AS (SELECT CASE WHEN n < 55 THEN 'too_short' WHEN segs < 5 THEN 'few_segments' WHEN bands < 5 THEN 'few_bands' ELSE 'eligible' END AS status FROM n)
SELECT status, count(*) AS paths, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM s GROUP BY status""")
def _ag27(spark, sf_dir):
    n = points(spark, sf_dir).groupBy("path_id").agg(F.count("*").alias("n"), F.count_distinct("segment_id").alias("segs"), F.count_distinct("band_id").alias("bands"))
    reason = F.when(F.col("n") < 55, "too_short").when(F.col("segs") < 5, "few_segments").when(F.col("bands") < 5, "few_bands")
    return r8(M.coverage(n, reason), "share").withColumnRenamed("rows", "paths")


@query("ag8_mesh_measurement", """WITH m AS (SELECT l_orderkey AS mesh_id, l_linenumber AS band_id, l_suppkey % 4 AS k_idx, l_extendedprice / 1000 - 40 AS energy, CASE WHEN l_tax < 0.03 THEN 1.0 WHEN l_tax > 0.05 THEN 0.0 ELSE 0.5 END AS occupancy FROM lineitem),
w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY mesh_id) AS weight FROM m),
k AS (SELECT mesh_id, k_idx, min(energy) FILTER (WHERE occupancy <= 0.01) - max(energy) FILTER (WHERE occupancy >= 0.99) AS direct FROM w GROUP BY ALL),
g AS (SELECT mesh_id, min(direct) AS direct FROM k GROUP BY mesh_id),
a AS (SELECT mesh_id, round(sum(weight * occupancy), 8) AS electrons, max(energy) FILTER (WHERE occupancy >= 0.99) AS vbm, min(energy) FILTER (WHERE occupancy <= 0.01) AS cbm, count(*) FILTER (WHERE occupancy > 0.01 AND occupancy < 0.99) AS partial FROM w GROUP BY mesh_id)
SELECT mesh_id, electrons, round(vbm, 8) AS vbm, round(cbm, 8) AS cbm, round(CASE WHEN vbm IS NOT NULL AND cbm IS NOT NULL THEN greatest(0, cbm - vbm) END, 8) AS gap, round(CASE WHEN direct IS NOT NULL THEN greatest(0, direct) END, 8) AS direct_gap, partial, 'ok' AS status FROM a JOIN g USING (mesh_id)""")
def _ag8(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    occ = F.when(F.col("l_tax") < 0.03, 1.0).when(F.col("l_tax") > 0.05, 0.0).otherwise(0.5)
    mesh = line.select(F.col("l_orderkey").alias("mesh_id"), F.col("l_linenumber").alias("band_id"), (F.col("l_suppkey") % 4).alias("k_idx"), (F.col("l_extendedprice") / 1000 - 40).alias("energy"), occ.alias("occupancy"))
    mesh = mesh.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("mesh_id")))
    return r8(M.measure_meshes(mesh), "electrons", "vbm", "cbm", "gap", "direct_gap")


@query("jn17_proximity", f"""WITH {POINTS}, v AS (SELECT path_id, k_idx, day * 1.0 AS x, energy AS y, segment_id * 1.0 AS z FROM p WHERE band_id = 'view'), c AS (SELECT path_id, k_idx, day * 1.0 AS x, energy AS y, segment_id * 1.0 AS z FROM p WHERE band_id = 'click')
SELECT v.path_id, count(*) AS pairs, round(min(sqrt((v.x - c.x) ** 2 + (v.y - c.y) ** 2 + (v.z - c.z) ** 2)), 8) AS nearest FROM v JOIN c ON v.path_id = c.path_id AND sqrt((v.x - c.x) ** 2 + (v.y - c.y) ** 2 + (v.z - c.z) ** 2) <= 5 GROUP BY v.path_id""")
def _jn17(spark, sf_dir):
    p = points(spark, sf_dir).select("path_id", "band_id", F.col("day").cast("double").alias("x"), F.col("energy").alias("y"), F.col("segment_id").cast("double").alias("z"))
    near = M.proximity(p.filter("band_id = 'view'"), p.filter("band_id = 'click'"), ["path_id"], 5.0)
    return near.groupBy("path_id").agg(F.count("*").alias("pairs"), F.round(F.min("distance"), 8).alias("nearest"))


@query("fn13_mass_proxy", f"""WITH {DAILY}, {_power_sums('k_idx', 'energy', 'path_id, band_id, segment_id', 'k_idx')},
c AS (SELECT path_id, band_id, k_idx, CASE WHEN n >= 3 AND s4 * (n * s2 - s1 * s1) - s3 * (n * s3 - s1 * s2) + s2 * (s1 * s3 - s2 * s2) <> 0 THEN round(2 * (t2 * (n * s2 - s1 * s1) - t1 * (n * s3 - s1 * s2) + t0 * (s1 * s3 - s2 * s2)) / (s4 * (n * s2 - s1 * s1) - s3 * (n * s3 - s1 * s2) + s2 * (s1 * s3 - s2 * s2)), 8) + 0 ELSE 0 END AS c FROM u)
SELECT path_id, band_id, count(*) FILTER (WHERE abs(c) < 1e-3) AS flat, round(median(1 / abs(c)) FILTER (WHERE abs(c) >= 1e-3), 3) AS median_mass FROM c GROUP BY ALL""")
def _fn13(spark, sf_dir):
    got = B.quadratic_curvature(daily(spark, sf_dir), ["path_id", "band_id", "segment_id"]).withColumn("curvature", F.round("curvature", 8) + F.lit(0))
    mass = M.mass_proxy(F.col("curvature"), 1e-3)
    return got.withColumn("mass", mass).groupBy("path_id", "band_id").agg(F.count_if(F.col("mass") == float("inf")).alias("flat"), F.round(F.percentile(F.when(F.col("mass") < float("inf"), F.col("mass")), F.lit(0.5)), 3).alias("median_mass"))


@query("fn4_normalise", f"""WITH {POINTS}, s AS (SELECT band_id, avg(energy) AS mean, greatest(stddev_pop(energy), 1e-6) AS std FROM p WHERE path_id % 5 <> 0 GROUP BY band_id)
SELECT path_id, band_id, k_idx, round((energy - mean) / std, 8) + 0 AS value FROM p JOIN s USING (band_id)""")
def _fn4(spark, sf_dir):
    p = points(spark, sf_dir)
    stats = M.channel_stats(p.filter("path_id % 5 <> 0"), "band_id", "energy")
    return M.normalise(p, stats, "band_id", "energy").select("path_id", "band_id", "k_idx", (F.round("value", 8) + F.lit(0)).alias("value"))


@query("ag37_channel_stats", f"WITH {POINTS} SELECT band_id, round(avg(energy), 8) AS mean, round(greatest(stddev_pop(energy), 1e-6), 8) AS std, count(*) AS n FROM p WHERE path_id % 5 <> 0 GROUP BY band_id")
def _ag37(spark, sf_dir):
    return r8(M.channel_stats(points(spark, sf_dir).filter("path_id % 5 <> 0"), "band_id", "energy"), "mean", "std")


@query("fn14_strain_warp", f"""WITH {DAILY}, n AS (SELECT path_id, min(k) AS lo, max(k) AS hi, 0.95 + ('0x' || substr(md5(concat('warp|', path_id)), 1, 8))::BIGINT / 4294967296.0 * 0.1 AS f FROM d GROUP BY path_id),
x AS (SELECT path_id, band_id, k, energy, lead(k) OVER w AS k1, lead(energy) OVER w AS e1, lag(k) OVER w IS NULL AS first FROM d WINDOW w AS (PARTITION BY path_id, band_id ORDER BY k)),
q AS (SELECT d.path_id, d.band_id, d.k_idx, least(hi, greatest(lo, (lo + hi) / 2 + (d.k - (lo + hi) / 2) / f)) AS k FROM d JOIN n USING (path_id)),
j AS (SELECT q.path_id, q.band_id, q.k_idx, x.energy + CASE WHEN x.k1 IS NULL OR q.k <= x.k THEN 0 ELSE (q.k - x.k) / (x.k1 - x.k) * (x.e1 - x.energy) END AS value,
      row_number() OVER (PARTITION BY q.path_id, q.band_id, q.k_idx ORDER BY x.k DESC) AS r FROM q JOIN x ON q.path_id = x.path_id AND q.band_id = x.band_id AND (x.k <= q.k OR x.first))
SELECT path_id, band_id, k_idx, round(value, 8) + 0 AS value FROM j WHERE r = 1""")
def _fn14(spark, sf_dir):
    return M.strain_warp(daily(spark, sf_dir), "warp", 0.95, 1.05).select("path_id", "band_id", "k_idx", (F.round("value", 8) + F.lit(0)).alias("value"))
