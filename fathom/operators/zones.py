"""Crossings of segments, and DBSCAN on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.geo import EARTH_KM, crossing, haversine_km, unit_sphere
from fathom.plans.graph import components
from fathom.plans.tables import Scratch


#: Runs of a vessel that line ids have room for; a run beyond raises an error.
RUNS = 1_000_000


def line_id(mmsi: Column, run: Column) -> Column:
    over = F.raise_error(F.lit(f"a run's number is not below {RUNS}")).cast("long")
    return F.when(run >= RUNS, over).otherwise(mmsi.cast("long") * RUNS + run)


def jump_lines(found: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per run of found(mmsi, run, first, last; minutes), the vessel's last fix before it and first one after: line, mmsi, run, lat1, lon1, lat2, lon2. Runs that lack either are left out. Marks at both ends of each run are sorted among the fixes, in one pass over a vessel's track."""
    none = F.lit(None)
    f = fixes.where("lat IS NOT NULL AND lon IS NOT NULL").select("mmsi", "t", "i", none.cast("long").alias("run"), none.cast("boolean").alias("starts"), F.struct("lat", "lon").alias("place"))
    mark = lambda t, starts: found.select("mmsi", (t * 60).alias("t"), none.cast("long").alias("i"), F.col("run").cast("long").alias("run"), F.lit(starts).alias("starts"), none.cast("struct<lat: double, lon: double>").alias("place"))
    every = f.unionByName(mark(F.col("first"), True)).unionByName(mark(F.col("last") + 1, False))
    over = "OVER (PARTITION BY mmsi ORDER BY t, place IS NOT NULL, i)"
    every = every.withColumns({"before": F.expr(f"lag(place) IGNORE NULLS {over}"), "after": F.expr(f"lead(place) IGNORE NULLS {over}")})
    ends = every.where("starts IS NOT NULL").groupBy("mmsi", "run").agg(F.max(F.when(F.col("starts"), F.col("before"))).alias("a"), F.max(F.when(~F.col("starts"), F.col("after"))).alias("b"))
    ends = ends.where("a IS NOT NULL AND b IS NOT NULL")
    return ends.select(line_id(F.col("mmsi"), F.col("run")).alias("line"), "mmsi", "run", F.col("a.lat").alias("lat1"), F.col("a.lon").alias("lon1"), F.col("b.lat").alias("lat2"), F.col("b.lon").alias("lon2"))


def passed_cells(lines: DataFrame, cell: float) -> DataFrame:
    """lines with cy, cx: the cells (degrees) that each passes, one row a cell; at most its rows and columns together, and a few that it only touches."""
    col, pad = F.col, 1e-6
    x1, y1, x2, y2 = (col(c) / cell for c in ("lon1", "lat1", "lon2", "lat2"))
    low, high = F.least(x1, x2), F.greatest(x1, x2)
    out = lines.withColumn("cx", F.explode(F.sequence(F.floor(low - pad), F.floor(high + pad))))
    slope = (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))
    at = lambda x: y1 + (F.greatest(low, F.least(high, x)) - x1) * slope
    left, right = F.coalesce(at(col("cx") - pad), y1), F.coalesce(at(col("cx") + 1 + pad), y2)
    return out.withColumn("cy", F.explode(F.sequence(F.floor(F.least(left, right) - pad), F.floor(F.greatest(left, right) + pad))))


def crossings(lines: DataFrame, cell: float) -> DataFrame:
    """line1 < line2 of different vessels, and lat, lon where they cross. Lines meet in the cells (degrees) that they pass, and a pair counts in the cell of its crossing alone."""
    placed = passed_cells(lines, cell)
    one = placed.toDF(*[f"p_{c}" for c in placed.columns])
    two = placed.toDF(*[f"q_{c}" for c in placed.columns])
    col = F.col
    met = one.join(two, (col("p_cy") == col("q_cy")) & (col("p_cx") == col("q_cx")) & (col("p_line") < col("q_line")) & (col("p_mmsi") != col("q_mmsi")))
    x, y = crossing(*[col(f"{s}_{c}{n}") for s in "pq" for n in "12" for c in ("lon", "lat")])
    met = met.withColumn("lon", x).withColumn("lat", y).where((F.floor(col("lat") / cell) == col("p_cy")) & (F.floor(col("lon") / cell) == col("p_cx")))
    return met.select(col("p_line").alias("line1"), col("q_line").alias("line2"), col("p_mmsi").alias("mmsi1"), col("q_mmsi").alias("mmsi2"), "lat", "lon")


AXES = ("x", "y", "z")


def _around(cubes: DataFrame, side: float) -> DataFrame:
    """cubes with nx, ny, nz: the cubes at most two away in each direction that the unit sphere passes."""
    for c in AXES:
        cubes = cubes.withColumn(f"n{c}", F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)))
    from_centre = F.sqrt(sum((((F.col(f"n{c}") + 0.5) * side) ** 2 for c in AXES[1:]), ((F.col("nx") + 0.5) * side) ** 2))
    return cubes.where(F.abs(from_centre - 1) <= side)


def dbscan(points: DataFrame, eps_km: float, least: int, scratch: Scratch) -> DataFrame:
    """point, cluster (the smallest core point's id; null: noise) of points(point, lat, lon), point of any type that has an order.

    A point is core with at least so many points within eps_km, itself included;
    core points within eps_km of each other share a cluster; another point takes
    the smallest cluster within eps_km. Space is cut into cubes whose diagonal is
    eps, so poles and antimeridian need no care: all points of a cube are within
    eps of each other. So a cube of `least` points is all core, and other cubes have
    fewer points than that to compare with their surroundings; core points of a cube
    are one cluster, and two cubes are linked by the two points that lie farthest
    towards each other. Only for cubes whose clusters that leaves apart are the
    points within reach of the other cube compared. Equal positions are merged and
    weighted.
    """
    chord = 2 * math.sin(eps_km / EARTH_KM / 2)
    side = chord / math.sqrt(3) * (1 - 1e-9)
    col = F.col
    spots = points.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.min("point").alias("spot"), F.count(F.lit(1)).alias("weight"))
    at = dict(zip(("px", "py", "pz"), unit_sphere(col("lat"), col("lon"))))
    spots = scratch.save(spots.withColumns({k: v / side for k, v in at.items()}).withColumns({c: F.floor(f"p{c}") for c in AXES}), "spots")
    cubes = scratch.save(spots.groupBy(*AXES).agg(F.sum("weight").alias("held")), "cubes")
    full = spots.join(cubes.where(col("held") >= least), list(AXES), "left_semi").select("spot", "lat", "lon", *AXES, "px", "py", "pz")
    sparse = spots.join(cubes.where(col("held") < least), list(AXES), "left_semi")

    def near(few: DataFrame, many: DataFrame) -> DataFrame:
        """u of few with the rows of many within eps_km."""
        wide = _around(few.select(col("spot").alias("u"), col("lat").alias("lat1"), col("lon").alias("lon1"), *AXES), side)
        wide = wide.select("u", "lat1", "lon1", *[col(f"n{c}").alias(c) for c in AXES])
        return wide.join(many, list(AXES)).where(haversine_km(col("lat1"), col("lon1"), col("lat"), col("lon")) <= eps_km)

    reached = near(sparse, spots.select("lat", "lon", "weight", *AXES)).groupBy("u").agg(F.sum("weight").alias("n"))
    some = sparse.join(reached.where(col("n") >= least).select(col("u").alias("spot")), "spot", "left_semi")
    core = scratch.save(full.unionByName(some.select(*full.columns)), "core")
    # the cubes that have core points; the smallest of these names a cube
    hold = scratch.save(core.groupBy(*AXES).agg(F.min("spot").alias("cube")), "hold")
    pairs = _around(hold.select(*AXES, col("cube").alias("a")), side).join(hold.select(*[col(c).alias(f"n{c}") for c in AXES], col("cube").alias("b")), [f"n{c}" for c in AXES])
    pairs = scratch.save(pairs.where("a <> b").select("a", "b", *AXES, *[(col(f"n{c}") - col(c)).alias(f"d{c}") for c in AXES]), "pairs")
    ahead = sum((col(f"p{c}") * col(f"d{c}") for c in AXES[1:]), col("px") * col("dx"))
    edge = core.join(pairs, list(AXES)).groupBy("a", "b").agg(F.max_by(F.struct("lat", "lon"), F.struct(ahead.alias("k"), "lat", "lon")).alias("p"))
    edge = scratch.save(edge, "edge")
    met = edge.where("a < b").join(edge.select(col("a").alias("b"), col("b").alias("a"), col("p").alias("q")), ["a", "b"])
    links = scratch.save(met.where(haversine_km(col("p.lat"), col("p.lon"), col("q.lat"), col("q.lon")) <= eps_km).select("a", "b"), "links")
    roots = components(links, scratch, "one")
    rooted = scratch.save(hold.join(roots, col("cube") == col("node"), "left").select("cube", F.coalesce("root", "cube").alias("root")), "rooted")
    apart = pairs.join(rooted.toDF("a", "ra"), "a").join(rooted.toDF("b", "rb"), "b").where("ra <> rb").select("a", "b", *AXES, *[f"d{c}" for c in AXES])
    # of each cube's points, those within eps of the other cube's box
    away = lambda c: F.greatest(F.lit(0.0), col(c) + col(f"d{c}") - col(f"p{c}"), col(f"p{c}") - col(c) - col(f"d{c}") - 1)
    reach = math.sqrt(3) * (1 + 1e-6)
    facing = scratch.save(core.join(apart, list(AXES)).where(F.sqrt(sum((away(c) ** 2 for c in AXES[1:]), away("x") ** 2)) <= reach).select("a", "b", "lat", "lon"), "facing")
    two = facing.select(col("a").alias("b"), col("b").alias("a"), col("lat").alias("lat2"), col("lon").alias("lon2"))
    more = facing.where("a < b").join(two, ["a", "b"]).where(haversine_km(col("lat"), col("lon"), col("lat2"), col("lon2")) <= eps_km).select("a", "b").distinct()
    roots = components(scratch.save(links.unionByName(more), "all"), scratch, "two")
    named = hold.join(roots, col("cube") == col("node"), "left").select(*AXES, "cube", F.coalesce("root", "cube").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("cube").alias("cluster")), "root").select(*AXES, "cluster")
    named = scratch.save(core.join(named, list(AXES)).select(col("spot").alias("u"), "cluster", "lat", "lon", *AXES), "named")
    rest = sparse.join(named.select(col("u").alias("spot")), "spot", "left_anti")
    border = near(rest, named.select("lat", "lon", "cluster", *AXES)).groupBy("u").agg(F.min("cluster").alias("cluster"))
    every = scratch.save(named.select("u", "cluster").unionByName(border), "every")
    out = points.join(spots.select("lat", "lon", "spot"), ["lat", "lon"], "left").join(every, col("spot") == col("u"), "left")
    return out.select("point", "cluster")


def centre(points: DataFrame, by: str) -> DataFrame:
    """by, n, lat, lon: the mean position."""
    return points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def without_outliers(points: DataFrame, by: str, times: float, least: int) -> DataFrame:
    """points of groups of at least so many that lie within `times` the mean distance from their group's mean position; smaller groups stay whole."""
    mid = centre(points, by).toDF("_by", "_n", "_lat", "_lon")
    away = points.join(mid, F.col(by) == F.col("_by")).withColumn("_d", haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    mean = away.groupBy("_by").agg(F.avg("_d").alias("_m")).withColumnRenamed("_by", "_g")
    kept: Column = (F.col("_n") < least) | (F.col("_d") <= times * F.col("_m"))
    return away.join(mean, F.col(by) == F.col("_g")).where(kept).select(*points.columns)


def members(points: DataFrame, by: str) -> DataFrame:
    """by, mmsi: the vessels whose lines cross in each group of points(mmsi1, mmsi2), each once."""
    return points.select(by, F.explode(F.array("mmsi1", "mmsi2")).alias("mmsi")).distinct()


def not_among(vessels: DataFrame, others: DataFrame) -> DataFrame:
    """The vessels, each once, that others(mmsi) doesn't have."""
    return vessels.select("mmsi").distinct().join(others.select("mmsi"), "mmsi", "left_anti")
