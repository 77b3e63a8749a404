"""Where vessels are and how their positions spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.geo import haversine_km


def home(fixes: DataFrame, clean: Column, least: int) -> DataFrame:
    """mmsi, home_lat, home_lon: the median of the clean fixes if there are at least so many, else of all."""
    ok = F.coalesce(clean, F.lit(False))
    of = lambda c: F.when(F.count_if(ok) >= least, F.median(F.when(ok, F.col(c)))).otherwise(F.median(c)).alias(f"home_{c}")
    return fixes.groupBy("mmsi").agg(of("lat"), of("lon"))


def spread(fixes: DataFrame, homes: DataFrame, share: float, least: int) -> DataFrame:
    """mmsi, n, q_lat, q_lon (the quantile of the absolute distance from home in degrees), far_km, r2 (the largest eigenvalue's share of the positions' variance; null below `least` fixes or without spread)."""
    at = fixes.join(homes, "mmsi")
    far = haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))
    per = at.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile(F.abs(F.col(c) - F.col(f"home_{c}")), share).alias(f"q_{c}") for c in ("lat", "lon")], F.max(far).alias("far_km"),
        F.var_samp("lon").alias("vx"), F.var_samp("lat").alias("vy"), F.covar_samp("lon", "lat").alias("cxy"),
    )
    total = F.col("vx") + F.col("vy")
    top = total / 2 + F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow("cxy", 2))
    return per.withColumn("r2", F.when((F.col("n") >= least) & (total > 0), top / total)).drop("vx", "vy", "cxy")


def median_of_most(rows: DataFrame, by: str, value: str) -> DataFrame:
    """One row: n groups, and the median of their largest values."""
    return rows.groupBy(by).agg(F.max(value).alias("most")).agg(F.count("most").alias("n"), F.median("most").alias("median"))
