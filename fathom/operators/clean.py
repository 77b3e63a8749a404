"""Validity, duplicates, thinning, filling, still vessels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.geo import haversine_km


def valid_position(lat: Column, lon: Column, null_island: float) -> Column:
    """Within range, not NaN, and not within null_island degrees of (0, 0). False for nulls."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon) & ~((F.abs(lat) < null_island) & (F.abs(lon) < null_island))
    return F.coalesce(ok, F.lit(False))


def valid_mmsi(mmsi: Column) -> Column:
    """Nine digits, not all zero."""
    return F.coalesce(mmsi.cast("string").rlike("^[0-9]{9}$") & (mmsi.cast("string") != "000000000"), F.lit(False))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """box: south, north, west, east; edges count."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def seen_in_box(fixes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """All fixes of the vessels that have one in the box."""
    return fixes.join(fixes.where(in_box(F.col("lat"), F.col("lon"), box)).select("mmsi").distinct(), "mmsi", "left_semi")


def first_of(fixes: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each group of keys; a row's columns travel as one struct, so groups combine before the shuffle."""
    names = [c for c in fixes.columns if c not in order]
    row = F.min_by(F.struct(*fixes.columns), F.struct(*order, *names))
    return fixes.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(row.alias("_r")).select("_r.*")


def thin(fixes: DataFrame, seconds: int) -> DataFrame:
    """The first fix of each vessel in each bin of so many seconds; 0 keeps all."""
    return first_of(fixes, [F.col("mmsi"), F.floor(F.col("t") / seconds)], ["t", "i"]) if seconds else fixes


def dedup_times(fixes: DataFrame) -> DataFrame:
    """The first fix, by place in the track, of each vessel and time."""
    return first_of(fixes, [F.col("mmsi"), F.col("t")], ["i"])


def dedup_positions(fixes: DataFrame) -> DataFrame:
    return fixes.dropDuplicates(["mmsi", "t", "lat", "lon"])


def filled(fixes: DataFrame, column: str, initial: float) -> DataFrame:
    """Nulls and NaNs take the vessel's last value before, or the initial one."""
    w = Window.partitionBy("mmsi").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(~F.isnan(column), F.col(column))
    return fixes.withColumn(column, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(initial)))


def reach(fixes: DataFrame) -> DataFrame:
    """mmsi, n, reach_km (the farthest from the first fix), extent_km (the diagonal of the bounding box): what tells still vessels from moving ones."""
    w = Window.partitionBy("mmsi").orderBy("t", "i")
    from_first = haversine_km(F.first("lat").over(w), F.first("lon").over(w), F.col("lat"), F.col("lon"))
    per = fixes.withColumn("d", from_first).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("reach_km"), *[f(c).alias(f"{c}{n}") for c in ("lat", "lon") for n, f in ((0, F.min), (1, F.max))])
    return per.select("mmsi", "n", "reach_km", haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")).alias("extent_km"))


def counters(fixes: DataFrame, null_island: float) -> DataFrame:
    """One row: rows, and how many are valid."""
    ok = valid_position(F.col("lat"), F.col("lon"), null_island)
    return fixes.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


def fault(mmsi: Column, lat: Column, lon: Column, null_island: float) -> Column:
    """What is wrong with a report, the first of: identity, position missing, out of range, null island; null if nothing is."""
    bad = F.when(~valid_mmsi(mmsi), "identity").when(F.coalesce(lat.isNull() | F.isnan(lat), F.lit(True)) | F.coalesce(lon.isNull() | F.isnan(lon), F.lit(True)), "position missing")
    return bad.when(~lat.between(-90, 90) | ~lon.between(-180, 180), "out of range").when(~valid_position(lat, lon, null_island), "null island")


def tracks(reports: DataFrame, null_island: float, least: int, reach_km: float) -> DataFrame:
    """Valid reports, each time and position of a vessel once, of vessels that have at least `least` valid reports before that and get reach_km away from their first; i is the place in time."""
    ok = reports.where(valid_mmsi(F.col("mmsi")) & valid_position(F.col("lat"), F.col("lon"), null_island))
    ok = ok.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("mmsi"))).where(F.col("_n") >= least).drop("_n")
    once = first_of(ok, [F.col(c) for c in ("mmsi", "t", "lat", "lon")], ["i"])
    w = Window.partitionBy("mmsi").orderBy("t", "i")
    away = haversine_km(F.first("lat").over(w), F.first("lon").over(w), F.col("lat"), F.col("lon"))
    far = F.max("_d").over(Window.partitionBy("mmsi"))
    placed = once.withColumn("_d", away).withColumn("_i", F.row_number().over(w) - 1).withColumn("_far", far).where(F.col("_far") >= reach_km)
    return placed.withColumn("i", F.col("_i").cast("long")).drop("_d", "_i", "_far")


def ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in this order, with place from 1 on; a top-k, so no more than k rows of a partition move."""
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def iso(t: Column) -> Column:
    """Epoch seconds as ISO 8601 text in UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
