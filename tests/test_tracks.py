"""Track operators on hand-made rows, against plain loops, and the queries against their SQL."""

import math
import os
import random
import zipfile
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fathom import queries
from fathom.functions import geo
from fathom.operators import activity, clean, motion, places, runs, zones
from fathom.plans.graph import components
from fathom.plans.tables import Scratch
from fathom.sources import reports
from fathom.streaming import activity as live

SF = "/root/testdata/sf0.001"
FIXES = "mmsi long, i long, t long, lat double, lon double, sog double"


def fixes(spark, rows):
    return spark.createDataFrame([(*r, None)[:6] if len(r) == 5 else r for r in rows], FIXES)


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    clean_row = lambda r: tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x if isinstance(x, str) else int(x) for x in r)
    assert sorted((clean_row(r) for r in got.select(*names).collect()), key=repr) == sorted((clean_row(r) for r in want[names].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_distance_and_angles(spark):
    pairs = [(0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 50.0), (10.0, 179.9, 10.0, -179.9), (55.1, 12.3, 55.2, 12.5)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = df.select("*", geo.haversine_km(*map(F.col, "abcd")).alias("km"), geo.wrapped(F.col("d") - F.col("b")).alias("w")).collect()
    assert all(abs(r.km - km(*r[:4])) < 1e-9 for r in got)
    assert [round(r.w, 9) for r in got] == [180.0, 50.0, 0.2, 0.2]


def test_validity(spark):
    rows = [(0.0, 0.0), (0.0005, 0.0005), (0.0, 1.0), (91.0, 1.0), (1.0, -180.0), (1.0, 180.1), (math.nan, 1.0), (None, 1.0)]
    got = spark.createDataFrame(rows, "lat double, lon double").select(clean.valid_position(F.col("lat"), F.col("lon"), 0.001).alias("ok")).collect()
    assert [r.ok for r in got] == [False, False, True, False, True, False, False, False]
    ids = spark.createDataFrame([("000000000",), ("012345678",), ("12345678",), ("1234567890",), (None,), ("12345678x",)], "m string").select(clean.valid_mmsi(F.col("m")).alias("ok")).collect()
    assert [r.ok for r in ids] == [False, True, False, False, False, False]


def test_first_rows_and_filling(spark):
    df = fixes(spark, [(1, 1, 5, 1.0, 1.0, None), (1, 0, 5, 2.0, 2.0, math.nan), (1, 2, 61, 3.0, 3.0, 7.0), (1, 3, 70, 3.0, 3.0, math.nan), (2, 0, 5, 1.0, 1.0, None)])
    assert rows_of(clean.dedup_times(df).select("mmsi", "i")) == [(0, 1), (0, 2), (2, 1), (3, 1)]
    assert rows_of(clean.thin(df, 60).select("mmsi", "i")) == [(0, 1), (0, 2), (2, 1)]
    assert clean.thin(df, 0).count() == 5
    assert {(r.mmsi, r.i): r.sog for r in clean.filled(df, "sog", 0.0).collect()} == {(1, 0): 0.0, (1, 1): 0.0, (1, 2): 7.0, (1, 3): 7.0, (2, 0): 0.0}
    assert clean.dedup_positions(df.union(df)).count() == 5
    assert clean.seen_in_box(df, (2.5, 3.5, 0, 9)).count() == 4


def test_steps_and_segments(spark):
    df = fixes(spark, [(1, 0, 0, 0.0, 0.0), (1, 1, 3600, 1.0, 0.0), (1, 2, 3600, 1.0, 1.0), (1, 3, 9000, 1.0, 1.0)])
    got = {r.i: r for r in motion.steps(df).collect()}
    assert got[0].knots is None and got[2].knots is None and abs(got[1].knots - km(0, 0, 1, 0) / 1.852) < 1e-9
    assert [r.seg for r in motion.segments(df, 3600).orderBy("i").collect()] == [0, 0, 1, 2]


def test_kalman_equals_the_matrix_form(spark):
    rng, t, rows = random.Random(1), 0, []
    for i in range(80):
        t += rng.randint(30, 400)
        rows.append((7, i, t, 10 + 0.001 * i + rng.gauss(0, 1e-3), 179.95 + 0.002 * i, None))
    rows = [(*r[:4], (r[4] + 180) % 360 - 180, None) for r in rows]
    c = motion.Kalman(1e-6, 1e-5, 1.0)
    got = motion.kalman(motion.segments(fixes(spark, rows), 10_000), c).orderBy("i").collect()
    x, P = np.array([rows[0][3], rows[0][4], 0, 0]), np.eye(4) * c.initial
    H = np.eye(2, 4)
    for k in range(1, 80):
        A = np.eye(4)
        A[0, 2] = A[1, 3] = (rows[k][2] - rows[k - 1][2]) / 3600
        x, P = A @ x, A @ P @ A.T + np.eye(4) * c.process
        z = np.array(rows[k][3:5])
        z[1] = x[1] + (z[1] - x[1] + 180) % 360 - 180
        assert abs(got[k].resid_km - km(x[0], x[1], rows[k][3], rows[k][4])) < 1e-6
        K = P @ H.T @ np.linalg.inv(H @ P @ H.T + np.eye(2) * c.measurement)
        x, P = x + K @ (z - H @ x), (np.eye(4) - K @ H) @ P
    assert got[0].resid_km is None


def test_runs_match_a_loop(spark):
    rng = random.Random(2)
    flagged = {m: sorted(rng.sample(range(400), rng.randint(1, 40))) for m in range(20)}
    df = spark.createDataFrame([(m, x) for m, xs in flagged.items() for x in xs], "mmsi long, minute long")
    want = []
    for m, xs in flagged.items():
        groups = [[xs[0]]]
        for a, b in zip(xs, xs[1:]):
            if b - a > 9:
                groups.append([])
            groups[-1].append(b)
        want += [(g[0], g[-1], m, len(g), k + 1) for k, g in enumerate(groups)]
    assert rows_of(runs.runs(df, 9)) == sorted(want, key=repr)
    near = {(r.mmsi, r.minute): r.within for r in runs.trailing(df, 30).collect()}
    assert near == {(m, x): sum(x - 30 < y <= x for y in xs) for m, xs in flagged.items() for x in xs}


def test_spread_and_home(spark):
    rng = random.Random(3)
    rows = [(1, i, i, rng.gauss(0, 1), rng.gauss(0, 0.1)) for i in range(50)] + [(2, 0, 0, 1.0, 1.0), (2, 1, 1, 1.0, 1.0)]
    df = fixes(spark, rows)
    homes = places.home(df, F.col("lat") > 0, 3)
    up = np.array([r[3] for r in rows[:50] if r[3] > 0])
    assert abs({r.mmsi: r.home_lat for r in homes.collect()}[1] - np.median(up)) < 1e-12
    got = {r.mmsi: r for r in places.spread(df, homes, 0.9, 3).collect()}
    lat, lon = (np.array([r[k] for r in rows[:50]]) for k in (3, 4))
    eig = np.linalg.eigvalsh(np.cov(lon, lat))
    assert abs(got[1].r2 - eig[-1] / eig.sum()) < 1e-9 and got[2].r2 is None
    assert abs(got[1].q_lat - np.quantile(abs(lat - np.median(up)), 0.9)) < 1e-12


def test_timeline_peaks_and_variation(spark):
    spans = spark.createDataFrame([(1, 0, 10), (2, 5, 7), (1, 6, 8), (3, 30, 30)], "mmsi long, first long, last long")
    line = {r.slot: r.active for r in activity.timeline(spans).collect()}
    assert line[6] == 2 and line[10] == 1 and 11 not in line and line[30] == 1
    top = activity.peak(activity.timeline(spans)).first()
    assert (top.peak, top.peak_at, top.n_active) == (2, 5, 12)
    assert [r.active for r in activity.gridded(activity.timeline(spans), 9, 12).orderBy("slot").collect()] == [1, 1, 0, 0]
    series = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 5, 2, 2, 9, 1, 3, 3, 1])], "k long, slot long, active long")
    assert rows_of(activity.local_peaks(series, 0.5)) == sorted([(5, None, 0, 1), (9, 3, 0, 4)], key=repr)
    assert activity.variation(series, 3).first().cv == pytest.approx(np.std([5, 9, 3]) / np.mean([5, 9, 3]))
    assert activity.variation(series, 100).first().cv is None


def dbscan_loop(points, eps, least):
    near = {p: [q for q in points if km(*points[p], *points[q]) <= eps] for p in points}
    core = {p for p in points if len(near[p]) >= least}
    label = {}
    for p in sorted(core):
        if p not in label:
            stack, label[p] = [p], p
            while stack:
                for q in near[stack.pop()]:
                    if q in core and q not in label:
                        label[q] = p
                        stack.append(q)
    return {p: label.get(p, min([label[q] for q in near[p] if q in core], default=None)) for p in points}


@pytest.mark.parametrize("seed", [0, 1])
def test_dbscan_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    centres = [(0.0, 179.95), (89.5, 10.0), (55.0, 12.0), (-40.0, 0.0)]
    points = {}
    for i in range(160):
        la, lo = rng.choice(centres)
        points[i] = (max(-90.0, min(90.0, la + rng.gauss(0, 0.3))), (lo + rng.gauss(0, 0.4) + 180) % 360 - 180)
    points |= {200 + i: (10.0, 10.0) for i in range(6)}
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "point long, lat double, lon double")
    got = {r.point: r.cluster for r in zones.dbscan(df, 15.0, 5, Scratch(spark, "t")).collect()}
    assert got == dbscan_loop(points, 15.0, 5)
    assert zones.dbscan(df.limit(0), 15.0, 5, Scratch(spark, "t")).count() == 0


def test_dbscan_of_heaps_of_unequal_points(spark):
    """Full cubes, facing edges and a gap just wider and narrower than eps; the pairs of a heap are never written."""
    rng = random.Random(7)
    heap = lambda lat, n: [(lat + rng.uniform(0, 0.05), 10 + rng.uniform(0, 0.05)) for _ in range(n)]
    spots = heap(0.0, 700) + heap(0.14, 700) + heap(0.6, 300) + [(0.6 + 0.05 + 0.17, 10.02), (3.0, 3.0)]
    points = dict(enumerate(spots))
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(f"p{k:04d}", *v) for k, v in points.items()], "point string, lat double, lon double")
    for eps in (9.0, 11.0, 20.0):
        got = {int(r.point[1:]): None if r.cluster is None else int(r.cluster[1:]) for r in zones.dbscan(df, eps, 5, scratch).collect()}
        assert got == dbscan_loop(points, eps, 5)
        assert spark.read.parquet(f"{scratch.root}/facing").count() < 20 * len(points)


def test_lines_go_into_passed_cells_alone(spark):
    rng = random.Random(11)
    rows = [(i, i, *[rng.uniform(-40, 40) for _ in range(4)]) for i in range(30)] + [(90, 90, 0.0, 1.0, 30.0, 1.0), (91, 91, 5.0, -3.0, 5.0, 60.0), (92, 92, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "line long, mmsi long, lat1 double, lon1 double, lat2 double, lon2 double")
    cells = defaultdict(set)
    for r in zones.passed_cells(df, 0.25).collect():
        cells[r.line].add((r.cy, r.cx))
    for line, _, la1, lo1, la2, lo2 in rows:
        # a line along the border of two rows or columns is in both
        assert len(cells[line]) <= (1 + (line >= 90)) * (abs(la2 - la1) / 0.25 + abs(lo2 - lo1) / 0.25) + 6
        for k in range(2001):
            lat, lon = la1 + (la2 - la1) * k / 2000, lo1 + (lo2 - lo1) * k / 2000
            assert (math.floor(lat / 0.25), math.floor(lon / 0.25)) in cells[line]


def test_lines_of_many_runs_keep_their_own_ids(spark):
    found = spark.createDataFrame([(5, 1001, 10, 11), (5, 1, 2, 3), (6, 1, 10, 11), (7, 0, 0, 1)], "mmsi long, run long, first long, last long")
    rows = [(m, i, 60 * i, float(i), float(m)) for m in (5, 6, 7) for i in range(20)]
    got = {(r.mmsi, r.run): (r.line, r.lat1, r.lat2) for r in zones.jump_lines(found, fixes(spark, rows)).collect()}
    assert set(got) == {(5, 1001), (5, 1), (6, 1)} and len({x[0] for x in got.values()}) == 3
    assert got[5, 1001][1:] == (9.0, 12.0) and got[5, 1][1:] == (1.0, 4.0)
    with pytest.raises(Exception, match="run's number"):
        zones.jump_lines(spark.createDataFrame([(5, 1_000_000, 10, 11)], found.schema), fixes(spark, rows)).collect()


def test_run_statistics_match_a_loop(spark):
    rng = random.Random(12)
    spans = {m: [(k + 1, 50 * k + rng.randint(0, 9), 50 * k + rng.randint(10, 30)) for k in range(8)] for m in range(4)}
    rows = [(m, i, rng.randint(0, 26_000), 0.0, 0.0, float(i % 2) if i % 5 else None) for m in range(4) for i in range(300)]
    found = spark.createDataFrame([(m, *x) for m, xs in spans.items() for x in xs], "mmsi long, run long, first long, last long")
    got = {(r.mmsi, r.run): (r.first, r.last, r.n_fixes, r.odd_share) for r in runs.run_stats(found, fixes(spark, rows), {"odd": F.col("sog") > 0}).collect()}
    want = {}
    for m, xs in spans.items():
        for run, a, b in xs:
            own = [r[5] or 0 for r in rows if r[0] == m and a <= r[2] // 60 <= b]
            if own:
                want[m, run] = (a, b, len(own), sum(own) / len(own))
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()} and all(abs(got[k][3] - v[3]) < 1e-12 for k, v in want.items())


def test_kalman_goes_on_over_batches(spark):
    """Segments that are cut by Arrow batches, and many of them in one, against the same filter on whole segments."""
    rng, rows = random.Random(4), []
    for m in range(30):
        t = 0
        for i in range(rng.choice([1, 2, 5, 60])):
            t += rng.choice([30, 60, 9000])
            rows.append((m, i, t, 10 + rng.gauss(0, 1e-2), 20 + rng.gauss(0, 1e-2)))
    df = motion.segments(fixes(spark, rows), 600)
    config, got = motion.Kalman(1e-6, 1e-5, 1.0), []
    for size in (10_000, 7, 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append(rows_of(motion.kalman(df, config).select("mmsi", "i", "seg", "resid_km")))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_crossings_match_all_pairs(spark):
    rng = random.Random(4)
    lines = [(i, i % 15, *[rng.uniform(-3, 3) for _ in range(4)]) for i in range(60)] + [(90, 90, 0.0, 0.0, 1.0, 1.0), (91, 91, 0.0, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame(lines, "line long, mmsi long, lat1 double, lon1 double, lat2 double, lon2 double")
    want = set()
    for a in lines:
        for b in lines:
            if a[0] < b[0] and a[1] != b[1]:
                p, r, q, s = np.array(a[2:4]), np.array(a[4:6]) - a[2:4], np.array(b[2:4]), np.array(b[4:6]) - b[2:4]
                d = r[0] * s[1] - r[1] * s[0]
                if abs(d) > 1e-12:
                    t, u = ((q - p)[0] * s[1] - (q - p)[1] * s[0]) / d, ((q - p)[0] * r[1] - (q - p)[1] * r[0]) / d
                    if 0 <= t <= 1 and 0 <= u <= 1:
                        want.add((a[0], b[0]))
    got = [(r.line1, r.line2) for r in zones.crossings(df, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_outliers_go(spark):
    df = spark.createDataFrame([(i, 1, 0.0, 0.001 * i) for i in range(10)] + [(99, 1, 5.0, 0.0), (50, 2, 0.0, 0.0), (51, 2, 9.0, 0.0)], "point long, cluster long, lat double, lon double")
    assert {r.point for r in zones.without_outliers(df, "cluster", 3.0, 3).collect()} == {*range(10), 50, 51}


def test_components_join_what_is_linked(spark):
    scratch = Scratch(spark, "t")
    links = scratch.save(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)], "a long, b long"), "links")
    groups = defaultdict(set)
    for r in components(links, scratch, "c").collect():
        groups[r.root].add(r.node)
    assert sorted(map(min, groups.values())) == [0, 100] and sorted(map(len, groups.values())) == [41, 50]


US = "MMSI,BaseDateTime,LAT,LON,SOG,COG,VesselType\n1,2024-12-31T00:00:08,1.5,2.5,3,4,70\nx,bad,y,2.5,,,\n"
US_LOW = "mmsi,base_date_time,longitude,latitude,sog\n1,2025-01-01 00:00:00,2.5,1.5,3\n"
DK = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,SOG,COG,Ship  type\n31/12/2024 00:00:08,Class A,1,91.0,2.5,3,4,Cargo\n"


def test_csv_layouts(spark, tmp_path):
    for name, text, first, want in (("a", US, False, (1, 1735603208, 1.5, 2.5, 3.0, 4.0, "70")), ("b", US_LOW, False, (1, 1735689600, 1.5, 2.5, 3.0, None, None)), ("c", DK, True, (1, 1735603208, 91.0, 2.5, 3.0, 4.0, "Cargo"))):
        (tmp_path / f"{name}.csv").write_text(text)
        got = reports.read_csv(spark, str(tmp_path / f"{name}.csv"), first).collect()
        assert tuple(got[0]) == want
        if name == "a":
            assert tuple(got[1]) == (None, None, None, 2.5, None, None, None)
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("readme.txt", "x")
            z.writestr("in.csv", text)
        assert list(map(tuple, reports.read_zip(spark, str(tmp_path / f"{name}.zip"), first).collect())) == list(map(tuple, got))
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        reports.read_csv(spark, str(tmp_path / "d.csv"))


def test_files_with_bad_bytes_fractions_and_many_paths(spark, tmp_path):
    import gzip

    import zstandard

    head, row = "MMSI,BaseDateTime,LAT,LON,VesselType\n", "1,2024-12-31 00:00:08.250,1.5,2.5,"
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress((head + row + "a\n").encode()))
    (tmp_path / "b.csv.zst").write_bytes(zstandard.compress((head + row.replace("08.250", "09+02:00") + "b\n").encode()))
    got = reports.read_csv(spark, [str(tmp_path / "a.csv.gz"), str(tmp_path / "b.csv.zst")]).orderBy("t").collect()
    assert [(r.t, r.vessel_type) for r in got] == [(1735603208, "a"), (1735603209, "b")]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in.csv", (head + row + "caf").encode() + b"\xe9\xff\n" + row.encode() + "Ærø".encode() + b"\n")
    assert [r.vessel_type for r in reports.read_zip(spark, str(tmp_path / "c.zip")).collect()] == ["caf��", "Ærø"]


def test_faults_tracks_and_counted_names(spark):
    rows = [(200000000, i, 60 * i, 1.0 + i, 2.0) for i in range(5)] + [(200000000, 9, 0, 1.0, 2.0), (200000000, 10, 5, 95.0, 2.0), (200000000, 11, 6, None, 2.0), (200000000, 12, 7, math.nan, 2.0), (200000000, 13, 8, 0.0, 0.0), (7, 0, 0, 1.0, 1.0)]
    rows += [(300000000, i, 60 * i, 1.0, 2.0) for i in range(9)] + [(400000000, 0, 0, 1.0, 2.0), (400000000, 1, 60, 9.0, 2.0)]
    df = fixes(spark, rows).withColumn("fault", clean.fault(F.col("mmsi"), F.col("lat"), F.col("lon"), 0.01))
    assert {r.mmsi: (r.n, r.counts) for r in runs.counted_names(df, ["mmsi"], "fault").collect()} == {200000000: (4, "null island:1,out of range:1,position missing:2"), 7: (1, "identity:1")}
    got = clean.tracks(df.drop("fault"), 0.01, 3, 10.0).orderBy("i").collect()
    assert [(r.mmsi, r.i, r.t) for r in got] == [(200000000, k, 60 * k) for k in range(5)]


def test_series_and_sets(spark):
    series = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 5, 2, 2, 9, 1, 3, 9, 1])], "k long, slot long, active long")
    assert [(r.place, r.slot) for r in activity.highest(series, 0.1, 2).orderBy("place").collect()] == [(1, 4), (2, 7)]
    one = activity.peak_spacing(series, 0.5).first()
    assert one.n_peaks == 3 and one.cv == 0.0 and activity.peak_spacing(series, 0.9).first().cv is None
    s = activity.summary(series).first()
    assert (s.n_slots, s.duration, s.most) == (9, 8, 9) and abs(s["mean"] - 33 / 9) < 1e-12
    line = spark.createDataFrame([(61, 1), (130, 2)], "slot long, active long")
    grid = activity.gridded_whole(line, 60).orderBy("slot").collect()
    assert (grid[0].slot, grid[-1].slot, sum(r.active for r in grid)) == (60, 179, 3) and activity.gridded_whole(line.limit(0), 60).count() == 0
    flags = spark.createDataFrame([(True, None), (None, None), (False, None)], "a boolean, b boolean").select(runs.any_of(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in flags.collect()] == [True, False, False]


def test_route_files(spark, tmp_path):
    text = '{"012345678": [["2024-01-01T00:00:10Z", 1.0, 2.0, 3.5, null], ["2024-01-01T00:00:00+02:00", 1.0, 2.0], ["2024-01-01T00:00:05", 1.0], ["bad", 1, 2], ["2024-01-01T00:00:07", "q", 2]], "2": []}'
    (tmp_path / "r.json").write_text(text)
    got = reports.read_routes(spark, str(tmp_path / "r.json")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [("012345678", 0, 1704067200, 1.0, 2.0, 0.0, 0.0), ("012345678", 1, 1704067210, 1.0, 2.0, 3.5, 0.0)]
    assert reports.read_routes(spark, str(tmp_path / "r.json"), 3).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    reports.write_csv(df, str(tmp_path / "c"))
    reports.write_json(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().y == "a" and spark.read.json(str(tmp_path / "j")).first().x == 1


def test_stream_of_activity(spark, tmp_path):
    for k, ts in enumerate(["2024-01-01 00:00:10", "2024-01-01 00:00:40", "2024-01-01 00:05:00", "2024-01-01 03:00:00"]):
        spark.createDataFrame([(1, ts)], "mmsi long, s string").selectExpr("mmsi", "cast(s AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for f, want in ((lambda s: live.active_by_minute(s, "10 minutes"), [1, 2]), (lambda s: live.sessions(s, "10 minutes", "10 minutes"), [3])):
        stream = spark.readStream.schema("mmsi long, ts timestamp").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.outputMode("append").format("memory").queryName("out").option("checkpointLocation", str(tmp_path / f"c{len(want)}")).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r.n for r in spark.table("out").collect()) == want
