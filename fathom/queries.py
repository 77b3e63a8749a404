"""Queries over the adapter's fixes, and the same in SQL.

The limits below are examples for the adapter's tracks; the operators take them
as arguments and have none of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import geo
from fathom.operators import activity, clean, motion, places, runs, zones
from fathom.plans.tables import Scratch
from fathom.sources import reports as files
from fathom.sources.adapter import FIXES_SQL, REPORTS_SQL, fixes, reports
from fathom.streaming import activity as live

BOX, KNOTS, GAP_S, RUN_GAP, THIN_S, EPS_KM, LEAST, CELL = (54.8, 55.2, 12.4, 12.9), 50.0, 600, 45, 300, 30.0, 4, 0.25
FILTER = motion.Kalman(process=1e-6, measurement=1e-5, initial=1.0)


def hav(a: str, b: str, c: str, d: str) -> str:
    x = f"sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"2 * 6371e0 * asin({x} - greatest({x} - 1e0, 0e0))"


OK_SQL = "coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 0.01 AND abs(lon) < 0.01), FALSE)"
BASE = f"""WITH RECURSIVE fixes AS MATERIALIZED ({FIXES_SQL.format(events="events")}),
reports AS MATERIALIZED ({REPORTS_SQL.replace("{fixes}", "SELECT * FROM fixes")}),
lagged AS (SELECT *, lag(t) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY t, i)),
steps AS (SELECT *, t - t0 AS dt_s, {hav("lat0", "lon0", "lat", "lon")} AS km FROM lagged),
moves AS MATERIALIZED (SELECT *, CASE WHEN dt_s > 0 THEN km / (dt_s / 3600e0) / 1.852e0 END AS knots FROM steps),
segs AS MATERIALIZED (SELECT *, (sum(CASE WHEN dt_s > {GAP_S} OR dt_s <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t, i))::BIGINT AS seg FROM moves),
fast AS (SELECT DISTINCT mmsi, t // 60 AS minute FROM moves WHERE knots > {KNOTS}),
opened AS (SELECT *, CASE WHEN minute - lag(minute) OVER (PARTITION BY mmsi ORDER BY minute) <= {RUN_GAP} THEN 0 ELSE 1 END AS o FROM fast),
numbered AS (SELECT *, (sum(o) OVER (PARTITION BY mmsi ORDER BY minute))::BIGINT AS run FROM opened),
runs AS MATERIALIZED (SELECT mmsi, run, min(minute) AS first, max(minute) AS last, count(*) AS n_minutes FROM numbered GROUP BY ALL),
line AS MATERIALIZED (SELECT slot, count(DISTINCT mmsi) AS active FROM (SELECT mmsi, unnest(generate_series(first, last)) AS slot FROM runs) AS u GROUP BY slot),
ends AS (SELECT r.mmsi, run, max(t) FILTER (WHERE t // 60 < first) AS ta, min(t) FILTER (WHERE t // 60 > last) AS tb FROM runs r JOIN fixes f ON f.mmsi = r.mmsi GROUP BY ALL),
lines AS MATERIALIZED (SELECT e.mmsi * 1000000 + run AS line, e.mmsi, run, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM ends e JOIN fixes a ON a.mmsi = e.mmsi AND a.t = ta JOIN fixes b ON b.mmsi = e.mmsi AND b.t = tb),
dets AS (SELECT p.line AS line1, q.line AS line2, p.mmsi AS mmsi1, q.mmsi AS mmsi2, p.lat1 AS ay, p.lon1 AS ax, p.lat2 AS by_, p.lon2 AS bx, q.lat1 AS cy, q.lon1 AS cx, q.lat2 AS dy, q.lon2 AS dx,
         (p.lon2 - p.lon1) * (q.lat2 - q.lat1) - (p.lat2 - p.lat1) * (q.lon2 - q.lon1) AS det FROM lines p JOIN lines q ON p.line < q.line AND p.mmsi <> q.mmsi),
params AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det AS pt, ((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / det AS pu FROM dets WHERE abs(det) >= 1e-12),
met AS MATERIALIZED (SELECT line1, line2, mmsi1, mmsi2, ay + pt * (by_ - ay) AS lat, ax + pt * (bx - ax) AS lon FROM params WHERE pt BETWEEN 0 AND 1 AND pu BETWEEN 0 AND 1),
points AS MATERIALIZED (SELECT line1 || ':' || line2 AS point, lat, lon FROM met),
near AS MATERIALIZED (SELECT a.point AS u, b.point AS v FROM points a JOIN points b ON {hav("a.lat", "a.lon", "b.lat", "b.lon")} <= {EPS_KM}),
core AS MATERIALIZED (SELECT u FROM near GROUP BY u HAVING count(*) >= {LEAST}),
reached AS (SELECT u AS a, u AS b FROM core UNION SELECT a, v FROM reached JOIN near ON u = b JOIN (SELECT u AS w FROM core) AS c ON v = w),
cores AS (SELECT a AS point, min(b) AS cluster FROM reached GROUP BY a),
labels AS MATERIALIZED (SELECT p.point, p.lat, p.lon, coalesce(min(c.cluster) FILTER (WHERE c.point = p.point), min(c.cluster), 'noise') AS cluster FROM points p JOIN near n ON n.u = p.point LEFT JOIN cores c ON c.point = n.v GROUP BY ALL),
homes AS MATERIALIZED (SELECT mmsi, CASE WHEN count(*) FILTER (WHERE calm) >= 3 THEN median(lat) FILTER (WHERE calm) ELSE median(lat) END AS home_lat,
          CASE WHEN count(*) FILTER (WHERE calm) >= 3 THEN median(lon) FILTER (WHERE calm) ELSE median(lon) END AS home_lon FROM (SELECT *, coalesce(knots <= {KNOTS}, FALSE) AS calm FROM moves) AS m GROUP BY mmsi)
"""


def _moves(spark, sf):
    return motion.steps(fixes(spark, sf))


def _fast() -> F.Column:
    return F.coalesce(F.col("knots") > KNOTS, F.lit(False))


def _runs(spark, sf):
    return runs.runs(runs.minutes(_moves(spark, sf), {"fast": _fast()}).where("fast > 0").select("mmsi", "minute"), RUN_GAP)


def _lines(spark, sf):
    return zones.jump_lines(_runs(spark, sf), fixes(spark, sf))


def _points(spark, sf, scratch):
    """The crossings, named by both lines."""
    met = scratch.save(zones.crossings(_lines(spark, sf), CELL), "met")
    return met.select(F.concat_ws(":", "line1", "line2").alias("point"), "lat", "lon")


def _labels(spark, sf):
    scratch = Scratch(spark, "zones")
    points = _points(spark, sf, scratch)
    return points.join(scratch.save(zones.dbscan(points, EPS_KM, LEAST, scratch), "labels"), "point")


def _rounded(df: DataFrame, **places) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def fix_counters(spark: SparkSession, sf: str) -> DataFrame:
    return clean.counters(reports(spark, sf), 0.01)


def report_faults(spark, sf):
    raw = reports(spark, sf)
    return runs.counted_names(raw.withColumn("fault", clean.fault(F.col("mmsi"), F.col("lat"), F.col("lon"), 0.01)), ["mmsi"], "fault")


def distinct_reports(spark, sf):
    return _rounded(clean.dedup_positions(reports(spark, sf)).select("mmsi", "t", "lat", "lon"), lat=6, lon=6)


def clean_tracks(spark, sf):
    return clean.tracks(reports(spark, sf), 0.01, 20, 15.0).select("mmsi", "i", "t")


def antimeridian_steps(spark, sf):
    far = reports(spark, sf).where("mmsi >= 300000000")
    turn = geo.wrapped(F.col("lon") - F.lag("lon").over(motion.track()))
    return _rounded(motion.steps(far.withColumn("turn", turn)).where("km IS NOT NULL").select("mmsi", "i", "km", "turn"), km=3, turn=6)


def box_vessels(spark, sf):
    return clean.seen_in_box(fixes(spark, sf), BOX).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"))


def thinned(spark, sf):
    return clean.thin(fixes(spark, sf), THIN_S).select("mmsi", "i", "t")


def dedup_times(spark, sf):
    return clean.dedup_times(fixes(spark, sf).withColumn("t", F.col("t") - F.col("t") % 120)).select("mmsi", "i", "t")


def filled_speed(spark, sf):
    return clean.filled(fixes(spark, sf), "sog", 0.0).select("mmsi", "i", "sog")


def vessel_reach(spark, sf):
    return _rounded(clean.reach(fixes(spark, sf)), reach_km=3, extent_km=3)


def valid_vessels(spark, sf):
    return reports(spark, sf).select("mmsi").distinct().select("mmsi", clean.valid_mmsi(F.col("mmsi")).alias("valid"))


def speed_over(spark, sf):
    return _rounded(_moves(spark, sf).where(_fast()).select("mmsi", "i", "dt_s", "km", "knots"), km=3, knots=3)


def gap_segments(spark, sf):
    return motion.segments(fixes(spark, sf), GAP_S).groupBy("mmsi", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def kalman_residuals(spark, sf):
    return _rounded(motion.kalman(motion.segments(fixes(spark, sf), GAP_S), FILTER).select("mmsi", "i", "seg", "resid_km"), resid_km=3)


def minute_flags(spark, sf):
    return runs.minutes(_moves(spark, sf), {"fast": _fast()})


def fast_runs(spark, sf):
    return _runs(spark, sf)


def fast_within(spark, sf):
    return runs.trailing(minute_flags(spark, sf).where("fast > 0").select("mmsi", "minute"), 30)


def quorum_minutes(spark, sf):
    first = fixes(spark, sf).groupBy("mmsi").agg(F.floor(F.min("t") / 60).alias("first"))
    return runs.quorum(minute_flags(spark, sf).where("fast > 0").select("mmsi", "minute"), first, 20, 0.3)


def any_violation(spark, sf):
    far = motion.kalman(motion.segments(fixes(spark, sf), GAP_S), FILTER).select("mmsi", "i", "resid_km")
    both = _moves(spark, sf).join(far, ["mmsi", "i"])
    return both.select("mmsi", "i", runs.any_of(F.col("knots") > KNOTS, F.col("resid_km") > 20.0).alias("bad"))


def run_times(spark, sf):
    return _runs(spark, sf).select("mmsi", "run", clean.iso(F.col("first") * 60).alias("first"), clean.iso(F.col("last") * 60).alias("last"))


def fast_ranking(spark, sf):
    per = minute_flags(spark, sf).where("fast > 0").groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"))
    return clean.ranked(per, [F.desc("n"), F.asc("mmsi")], 10)


def never_fast(spark, sf):
    return zones.not_among(fixes(spark, sf), _runs(spark, sf))


def far_median(spark, sf):
    return _rounded(places.median_of_most(_moves(spark, sf).where(_fast()), "mmsi", "km"), median=6)


def run_shares(spark, sf):
    return _rounded(runs.run_stats(_runs(spark, sf), _moves(spark, sf), {"fast": _fast()}), fast_share=6)


def vessel_rollup(spark, sf):
    return _runs(spark, sf).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("last") - F.col("first")).alias("minutes"))


def vessel_bounds(spark, sf):
    per = fixes(spark, sf).agg(F.countDistinct("mmsi").alias("n_vessels"), F.min("t").alias("first"), F.max("t").alias("last"))
    return per.crossJoin(F.broadcast(_runs(spark, sf).agg(F.countDistinct("mmsi").alias("n_fast"), F.countDistinct(F.when(F.col("last") - F.col("first") >= 30, F.col("mmsi"))).alias("n_long"))))


def vessel_homes(spark, sf):
    return _rounded(places.home(_moves(spark, sf), F.col("knots") <= KNOTS, 3), home_lat=6, home_lon=6)


def vessel_spread(spark, sf):
    moves = _moves(spark, sf)
    out = places.spread(moves.where(_fast()), places.home(moves, F.col("knots") <= KNOTS, 3), 0.9, 3)
    return _rounded(out, q_lat=6, q_lon=6, far_km=3, r2=6)


def active_timeline(spark, sf):
    return activity.timeline(_runs(spark, sf))


def active_grid(spark, sf):
    return activity.gridded(activity.timeline(_runs(spark, sf)), 1733184000 // 60, 1733184000 // 60 + 299)


def active_hours(spark, sf):
    return activity.gridded_whole(activity.timeline(_runs(spark, sf)), 60)


def spans_by_group(spark, sf):
    return activity.span_counts(_runs(spark, sf).withColumn("k", F.col("mmsi") % 4), 1, ("k",))


def active_by_group(spark, sf):
    return activity.timeline(_runs(spark, sf).withColumn("k", F.col("mmsi") % 4), 10, ("k",))


def active_peak(spark, sf):
    return activity.peak(activity.timeline(_runs(spark, sf)))


def active_days(spark, sf):
    return activity.timeline(_runs(spark, sf), 1440)


def local_peaks(spark, sf):
    return activity.local_peaks(activity.timeline(_runs(spark, sf)).withColumn("k", F.col("slot") % 2), 0.5).fillna(-1, ["gap"])


def hourly_variation(spark, sf):
    return _rounded(activity.variation(activity.timeline(_runs(spark, sf)).withColumn("k", F.col("slot") % 2), 15), cv=6)


def _series(spark, sf):
    return activity.timeline(_runs(spark, sf)).withColumn("k", F.col("slot") % 2)


def peak_spacing(spark, sf):
    return _rounded(activity.peak_spacing(_series(spark, sf), 0.5), cv=6)


def top_peaks(spark, sf):
    return activity.highest(_series(spark, sf), 0.5, 2)


def series_summary(spark, sf):
    return _rounded(activity.summary(_series(spark, sf)), mean=6)


def jump_lines(spark, sf):
    return _rounded(_lines(spark, sf), lat1=6, lon1=6, lat2=6, lon2=6)


def line_crossings(spark, sf):
    return _rounded(zones.crossings(_lines(spark, sf), CELL), lat=6, lon=6)


def zone_labels(spark, sf):
    return _labels(spark, sf).select("point", F.coalesce("cluster", F.lit("noise")).alias("cluster"))


def zone_centres(spark, sf):
    return _rounded(zones.centre(_labels(spark, sf).where("cluster IS NOT NULL"), "cluster"), lat=6, lon=6)


def zone_points(spark, sf):
    return zones.without_outliers(_labels(spark, sf).where("cluster IS NOT NULL"), "cluster", 2.0, 3).select("point", "cluster")


def zone_vessels(spark, sf):
    scratch = Scratch(spark, "zones")
    met = scratch.save(zones.crossings(_lines(spark, sf), CELL), "met").withColumn("point", F.concat_ws(":", "line1", "line2"))
    found = scratch.save(zones.dbscan(met.select("point", "lat", "lon"), EPS_KM, LEAST, scratch), "labels").where("cluster IS NOT NULL")
    return zones.members(met.join(found, "point"), "cluster")


def csv_round_trip(spark, sf):
    """The fixes written in three layouts, plain and compressed, and read back."""
    root, f = f"{Scratch(spark, 'csv').root}/", fixes(spark, sf)
    said = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss")
    f.select(F.col("mmsi").alias("MMSI"), said.alias("BaseDateTime"), F.col("lat").alias("LAT"), F.col("lon").alias("LON"), F.col("sog").alias("SOG")).write.option("header", True).option("compression", "gzip").csv(root + "classic")
    f.select("mmsi", F.replace(said, F.lit("T"), F.lit(" ")).alias("base_date_time"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), "sog").write.option("header", True).csv(root + "lower")
    f.select(F.date_format(F.timestamp_seconds("t"), "dd/MM/yyyy HH:mm:ss").alias("# Timestamp"), F.col("mmsi").alias("MMSI"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.col("sog").alias("SOG")).write.option("header", True).csv(root + "danish")
    read = [files.read_csv(spark, [root + k] if k == "classic" else root + k, k == "danish").withColumn("layout", F.lit(k)) for k in ("classic", "lower", "danish")]
    return _rounded(read[0].unionByName(read[1]).unionByName(read[2]).select("layout", "mmsi", "t", "lat", "lon", "sog"), lat=6, lon=6)


def route_round_trip(spark, sf):
    """The fixes written as JSON route files and read back."""
    root = f"{Scratch(spark, 'routes').root}/routes"
    files.write_routes(fixes(spark, sf), root, 4)
    return _rounded(files.read_routes(spark, root, 3, 0.01).select("mmsi", "i", "t", "lat", "lon", "speed"), lat=6, lon=6)


def _stream(spark, sf):
    return fixes(spark, sf).select("mmsi", F.timestamp_seconds("t").alias("ts"))


def live_minutes(spark, sf):
    """The streaming form over all fixes at once."""
    return live.active_by_minute(_stream(spark, sf), "10 minutes").select(F.floor(F.unix_seconds("at") / 60).alias("minute"), "mmsi", "n")


def live_sessions(spark, sf):
    return live.sessions(_stream(spark, sf), "10 minutes", "45 minutes").select("mmsi", "n", F.unix_seconds("first").alias("first"), F.unix_seconds("last").alias("last"))


QUERIES = {f.__name__: f for f in (
    fix_counters, box_vessels, thinned, dedup_times, filled_speed, vessel_reach, valid_vessels, speed_over, gap_segments, kalman_residuals, minute_flags, fast_runs, fast_within, run_shares, vessel_rollup,
    vessel_bounds, vessel_homes, vessel_spread, active_timeline, active_grid, active_peak, active_days, local_peaks, hourly_variation, jump_lines, line_crossings, zone_labels, zone_centres, zone_points,
    report_faults, distinct_reports, clean_tracks, antimeridian_steps, quorum_minutes, any_violation, run_times, fast_ranking, never_fast, far_median, active_hours, spans_by_group, active_by_group,
    peak_spacing, top_peaks, series_summary, zone_vessels, csv_round_trip, route_round_trip, live_minutes, live_sessions,
)}

_PEAKS = """SELECT k, slot, active, slot - lag(slot) OVER (PARTITION BY k ORDER BY slot) AS gap FROM (SELECT *, lag(active) OVER w AS b, lead(active) OVER w AS f, max(active) OVER (PARTITION BY k) AS most FROM (SELECT slot % 2 AS k, slot, active FROM line) AS s WINDOW w AS (PARTITION BY k ORDER BY slot)) AS n WHERE active >= b AND active >= f AND active >= 0.5 * most"""
_TWO = "SELECT slot % 2 AS k, slot, active FROM line"
_KALMAN = f"""
rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mmsi, seg ORDER BY t, i) AS n FROM segs),
filter AS (SELECT mmsi, seg, n, i, t, lat AS y, lon AS x, 0e0 AS vy, 0e0 AS vx, {FILTER.initial}::DOUBLE AS a, 0e0 AS b, {FILTER.initial}::DOUBLE AS c, NULL::DOUBLE AS resid FROM rows WHERE n = 1
  UNION ALL SELECT mmsi, seg, n, i, t, py + k1 * (lat - py), px + k1 * (lon - px), vy + k2 * (lat - py), vx + k2 * (lon - px), (1 - k1) * pa, (1 - k1) * pb, pc - k2 * pb, {hav("py", "px", "lat", "lon")}
  FROM (SELECT *, pa / (pa + {FILTER.measurement}) AS k1, pb / (pa + {FILTER.measurement}) AS k2 FROM (
    SELECT r.mmsi, r.seg, r.n, r.i, r.t, r.lat, r.lon, f.vy, f.vx, f.y + d * f.vy AS py, f.x + d * f.vx AS px, f.a + 2 * d * f.b + d * d * f.c + {FILTER.process} AS pa, f.b + d * f.c AS pb, f.c + {FILTER.process} AS pc
    FROM (SELECT f.*, r.n AS rn, (r.t - f.t) / 3600e0 AS d FROM filter f JOIN rows r ON r.mmsi = f.mmsi AND r.seg = f.seg AND r.n = f.n + 1) AS f JOIN rows r ON r.mmsi = f.mmsi AND r.seg = f.seg AND r.n = f.rn) AS p) AS g)"""
SQL = {
    "fix_counters": "SELECT count(*) AS n_rows, count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE NOT ok) AS n_invalid FROM (SELECT " + OK_SQL + " AS ok FROM reports) AS o",
    "box_vessels": f"SELECT mmsi, count(*) AS n FROM fixes WHERE mmsi IN (SELECT mmsi FROM fixes WHERE lat BETWEEN {BOX[0]} AND {BOX[1]} AND lon BETWEEN {BOX[2]} AND {BOX[3]}) GROUP BY mmsi",
    "thinned": f"SELECT mmsi, i, t FROM fixes QUALIFY row_number() OVER (PARTITION BY mmsi, t // {THIN_S} ORDER BY t, i) = 1",
    "dedup_times": "SELECT mmsi, i, t - t % 120 AS t FROM fixes QUALIFY row_number() OVER (PARTITION BY mmsi, t - t % 120 ORDER BY i) = 1",
    "filled_speed": "SELECT mmsi, i, coalesce(last_value(sog IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY t, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS sog FROM fixes",
    "vessel_reach": f"SELECT mmsi, n, round(max({hav('la', 'lo', 'lat', 'lon')}), 3) AS reach_km, round({hav('min(lat)', 'min(lon)', 'max(lat)', 'max(lon)')}, 3) AS extent_km FROM (SELECT *, count(*) OVER (PARTITION BY mmsi) AS n, first_value(lat) OVER w AS la, first_value(lon) OVER w AS lo FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY t, i)) AS f GROUP BY mmsi, n",
    "valid_vessels": "SELECT DISTINCT mmsi, regexp_full_match(mmsi::VARCHAR, '[0-9]{9}') AS valid FROM reports",
    "speed_over": f"SELECT mmsi, i, dt_s, round(km, 3) AS km, round(knots, 3) AS knots FROM moves WHERE knots > {KNOTS}",
    "gap_segments": "SELECT mmsi, seg, count(*) AS n, min(t) AS first, max(t) AS last FROM segs GROUP BY ALL",
    "kalman_residuals": (_KALMAN, "SELECT mmsi, i, seg, round(resid, 3) AS resid_km FROM filter"),
    "minute_flags": f"SELECT mmsi, t // 60 AS minute, count(*) AS n, count(*) FILTER (WHERE knots > {KNOTS}) AS fast FROM moves GROUP BY ALL",
    "fast_runs": "SELECT * FROM runs",
    "fast_within": "SELECT mmsi, minute, count(*) OVER (PARTITION BY mmsi ORDER BY minute RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS within FROM fast",
    "run_shares": f"SELECT r.mmsi, run, first, last, count(*) AS n_fixes, round(avg(CASE WHEN knots > {KNOTS} THEN 1e0 ELSE 0e0 END), 6) AS fast_share FROM runs r JOIN moves m ON m.mmsi = r.mmsi AND t // 60 BETWEEN first AND last GROUP BY ALL",
    "vessel_rollup": "SELECT mmsi, count(*) AS n_runs, sum(last - first)::BIGINT AS minutes FROM runs GROUP BY mmsi",
    "vessel_bounds": "SELECT (SELECT count(DISTINCT mmsi) FROM fixes) AS n_vessels, (SELECT min(t) FROM fixes) AS first, (SELECT max(t) FROM fixes) AS last, count(DISTINCT mmsi) AS n_fast, count(DISTINCT mmsi) FILTER (WHERE runs.last - runs.first >= 30) AS n_long FROM runs",
    "vessel_homes": "SELECT mmsi, round(home_lat, 6) AS home_lat, round(home_lon, 6) AS home_lon FROM homes",
    "vessel_spread": f"SELECT mmsi, n, round(q_lat, 6) AS q_lat, round(q_lon, 6) AS q_lon, round(far_km, 3) AS far_km, round(CASE WHEN n >= 3 AND vx + vy > 0 THEN ((vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + cxy * cxy)) / (vx + vy) END, 6) AS r2 FROM (SELECT mmsi, count(*) AS n, quantile_cont(abs(lat - home_lat), 0.9) AS q_lat, quantile_cont(abs(lon - home_lon), 0.9) AS q_lon, max({hav('home_lat', 'home_lon', 'lat', 'lon')}) AS far_km, var_samp(lon) AS vx, var_samp(lat) AS vy, covar_samp(lon, lat) AS cxy FROM moves JOIN homes USING (mmsi) WHERE knots > {KNOTS} GROUP BY mmsi) AS s",
    "active_timeline": "SELECT slot, active FROM line",
    "active_grid": "SELECT g AS slot, coalesce(active, 0) AS active FROM (SELECT unnest(generate_series(28886400, 28886699)) AS g) AS s LEFT JOIN line ON slot = g",
    "active_peak": "SELECT max(active) AS peak, (SELECT slot FROM line ORDER BY active DESC, slot LIMIT 1) AS peak_at, count(*) AS n_active FROM line",
    "active_days": "SELECT slot, count(DISTINCT mmsi) AS active FROM (SELECT mmsi, unnest(generate_series(first // 1440, last // 1440)) AS slot FROM runs) AS u GROUP BY slot",
    "local_peaks": f"SELECT k, slot, active, coalesce(slot - lag(slot) OVER (PARTITION BY k ORDER BY slot), -1) AS gap FROM (SELECT *, lag(active) OVER w AS b, lead(active) OVER w AS f, max(active) OVER (PARTITION BY k) AS most FROM ({_TWO}) AS s WINDOW w AS (PARTITION BY k ORDER BY slot)) AS n WHERE active >= b AND active >= f AND active >= 0.5 * most",
    "hourly_variation": f"SELECT k, count(*) AS n_units, round(CASE WHEN count(*) > 1 THEN stddev_pop(most) / avg(most) END, 6) AS cv FROM (SELECT k, slot // 15 AS u, max(active) AS most FROM ({_TWO}) AS s GROUP BY ALL) AS m GROUP BY k",
    "jump_lines": "SELECT line, mmsi, run, round(lat1, 6) AS lat1, round(lon1, 6) AS lon1, round(lat2, 6) AS lat2, round(lon2, 6) AS lon2 FROM lines",
    "line_crossings": "SELECT line1, line2, mmsi1, mmsi2, round(lat, 6) AS lat, round(lon, 6) AS lon FROM met",
    "zone_labels": "SELECT point, cluster FROM labels",
    "zone_centres": "SELECT cluster, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM labels WHERE cluster <> 'noise' GROUP BY cluster",
    "report_faults": "SELECT mmsi, sum(n)::BIGINT AS n, string_agg(fault || ':' || n, ',' ORDER BY fault) AS counts FROM (SELECT mmsi, fault, count(*) AS n FROM (SELECT mmsi, CASE WHEN NOT regexp_full_match(mmsi::VARCHAR, '[0-9]{9}') THEN 'identity' WHEN lat IS NULL OR lon IS NULL THEN 'position missing' WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'out of range' WHEN abs(lat) < 0.01 AND abs(lon) < 0.01 THEN 'null island' END AS fault FROM reports) AS f WHERE fault IS NOT NULL GROUP BY ALL) AS c GROUP BY mmsi",
    "distinct_reports": "SELECT DISTINCT mmsi, t, round(lat, 6) AS lat, round(lon, 6) AS lon FROM reports",
    "clean_tracks": f"SELECT mmsi, i, t FROM (SELECT mmsi, t, row_number() OVER w - 1 AS i, max(d) OVER (PARTITION BY mmsi) AS far FROM (SELECT *, {hav('first_value(lat) OVER w', 'first_value(lon) OVER w', 'lat', 'lon')} AS d FROM (SELECT mmsi, t, lat, lon, min(i) AS i, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY mmsi) AS n FROM reports WHERE {OK_SQL} AND regexp_full_match(mmsi::VARCHAR, '[0-9]{{9}}')) AS v WHERE n >= 20 GROUP BY mmsi, t, lat, lon) AS o WINDOW w AS (PARTITION BY mmsi ORDER BY t, i)) AS d WINDOW w AS (PARTITION BY mmsi ORDER BY t, i)) AS x WHERE far >= 15",
    "antimeridian_steps": f"SELECT mmsi, i, round({hav('la', 'lo', 'lat', 'lon')}, 3) AS km, round(CASE WHEN lon - lo > 180 THEN lon - lo - 360 WHEN lon - lo <= -180 THEN lon - lo + 360 ELSE lon - lo END, 6) AS turn FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM reports WHERE mmsi >= 300000000 WINDOW w AS (PARTITION BY mmsi ORDER BY t, i)) AS s WHERE la IS NOT NULL",
    "quorum_minutes": "SELECT mmsi, minute, within FROM (SELECT mmsi, minute, count(*) OVER (PARTITION BY mmsi ORDER BY minute RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS within FROM fast) AS q JOIN (SELECT mmsi, min(t) // 60 AS first FROM fixes GROUP BY mmsi) AS a USING (mmsi) WHERE minute - first >= 19 AND within >= 6",
    "any_violation": (_KALMAN, f"SELECT m.mmsi, m.i, coalesce(knots > {KNOTS}, FALSE) OR coalesce(resid > 20e0, FALSE) AS bad FROM moves m JOIN filter f ON f.mmsi = m.mmsi AND f.i = m.i"),
    "run_times": "SELECT mmsi, run, strftime(to_timestamp(first * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(to_timestamp(last * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS last FROM runs",
    "fast_ranking": "SELECT mmsi, n, (row_number() OVER (ORDER BY n DESC, mmsi))::INT AS place FROM (SELECT mmsi, count(*) AS n FROM fast GROUP BY mmsi) AS f ORDER BY place LIMIT 10",
    "never_fast": "SELECT DISTINCT mmsi FROM fixes EXCEPT SELECT mmsi FROM runs",
    "far_median": f"SELECT count(*) AS n, round(median(most), 6) AS median FROM (SELECT mmsi, max(km) AS most FROM moves WHERE knots > {KNOTS} GROUP BY mmsi) AS m",
    "active_hours": "SELECT g AS slot, coalesce(active, 0) AS active FROM (SELECT unnest(generate_series((SELECT min(slot) // 60 * 60 FROM line), (SELECT max(slot) // 60 * 60 + 59 FROM line))) AS g) AS s LEFT JOIN line ON slot = g",
    "spans_by_group": "SELECT k, slot, count(*) AS active FROM (SELECT mmsi % 4 AS k, unnest(generate_series(first, last)) AS slot FROM runs) AS u GROUP BY ALL",
    "active_by_group": "SELECT k, slot, count(DISTINCT mmsi) AS active FROM (SELECT mmsi % 4 AS k, mmsi, unnest(generate_series(first // 10, last // 10)) AS slot FROM runs) AS u GROUP BY ALL",
    "peak_spacing": f"SELECT k, count(*) AS n_peaks, round(CASE WHEN count(gap) > 1 THEN stddev_pop(gap) / avg(gap) END, 6) AS cv FROM ({_PEAKS}) AS p GROUP BY k",
    "top_peaks": f"SELECT k, place, slot, active FROM (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY active DESC, slot))::INT AS place FROM ({_PEAKS}) AS p) AS r WHERE place <= 2",
    "series_summary": f"SELECT k, count(*) AS n_slots, max(slot) - min(slot) AS duration, max(active) AS most, round(avg(active), 6) AS mean FROM ({_TWO}) AS s GROUP BY k",
    "zone_vessels": "SELECT DISTINCT cluster, unnest([mmsi1, mmsi2]) AS mmsi FROM labels JOIN met ON point = line1 || ':' || line2 WHERE cluster <> 'noise'",
    "csv_round_trip": "SELECT layout, mmsi, t, round(lat, 6) AS lat, round(lon, 6) AS lon, sog FROM fixes, (SELECT unnest(['classic', 'lower', 'danish']) AS layout) AS l",
    "route_round_trip": "SELECT mmsi::VARCHAR AS mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY t, i) - 1 AS i, t, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(sog, 0) AS speed FROM fixes QUALIFY count(*) OVER (PARTITION BY mmsi) >= 3",
    "live_minutes": "SELECT t // 60 AS minute, mmsi, count(*) AS n FROM fixes GROUP BY ALL",
    "live_sessions": "SELECT mmsi, count(*) AS n, min(t) AS first, max(t) AS last FROM (SELECT *, sum(o) OVER (PARTITION BY mmsi ORDER BY t, i) AS s FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi ORDER BY t, i) < 2700 THEN 0 ELSE 1 END AS o FROM fixes) AS a) AS b GROUP BY mmsi, s",
    "zone_points": f"""SELECT point, cluster FROM (SELECT *, avg(d) OVER (PARTITION BY cluster) AS m FROM (SELECT l.*, n, {hav('c.lat', 'c.lon', 'l.lat', 'l.lon')} AS d FROM labels l JOIN (SELECT cluster, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM labels GROUP BY cluster) AS c USING (cluster) WHERE cluster <> 'noise') AS s) AS t WHERE n < 3 OR d <= 2 * m""",
}
ORACLE_SQL = {k: f"{BASE}, {v[0]}\n{v[1]}" if isinstance(v, tuple) else f"{BASE}\n{v}" for k, v in SQL.items()}
