"""Vessel activity over a stream of fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_by_minute(stream: DataFrame, late: str, width: str = "1 minute") -> DataFrame:
    """at, mmsi, n: reports of each vessel per window of event time `ts`; reports later than the watermark are dropped, so state is bounded."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "mmsi").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("at"), "mmsi", "n")


def sessions(stream: DataFrame, late: str, gap: str) -> DataFrame:
    """first, last, mmsi, n: a vessel's reports joined over gaps of up to `gap`."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "mmsi").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("first", "last", "mmsi", "n")
