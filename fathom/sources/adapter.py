"""Fixes out of the star schema's events table, in SQL that Spark and other engines read alike.

A user is a vessel, its events its reports, a minute apart with one break of
three hours. Every third vessel jumps to and fro for a while.
"""

from pyspark.sql import DataFrame, SparkSession

FIXES_SQL = """
SELECT 200000000 + u AS mmsi, rn AS i, 1733184000 + 60 * (rn + CASE WHEN rn >= 50 THEN 180 ELSE 0 END + u % 7) AS t,
       55e0 + (u % 10) * 1e-2 + (CASE WHEN u % 2 = 0 THEN 4e-3 ELSE -4e-3 END) * rn + CASE WHEN hops AND u % 4 < 2 THEN 15e-1 ELSE 0e0 END AS lat,
       125e-1 + 4e0 * (CAST(floor(u / 60e0) AS BIGINT) % 3) + (u % 7) * 1e-2 + 4e-3 * rn + CASE WHEN hops AND u % 4 >= 2 THEN 15e-1 ELSE 0e0 END AS lon,
       CASE WHEN rn % 3 = 0 THEN NULL ELSE CAST(rn AS DOUBLE) END AS sog
FROM (SELECT u, rn, u % 3 = 0 AND rn BETWEEN 6 AND 44 AND rn % 2 = 0 AS hops
      FROM (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM {events}) AS numbered) AS marked
"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    out = spark.sql(FIXES_SQL, events=events)
    return out.selectExpr("CAST(mmsi AS BIGINT) AS mmsi", "CAST(i AS BIGINT) AS i", "CAST(t AS BIGINT) AS t", "lat", "lon", "sog")


#: Reports as they arrive: fixes, and beside every tenth of them one that is wrong in one of several ways, one that repeats it, and one of a vessel at the antimeridian.
REPORTS_SQL = """
SELECT mmsi, i, t, lat, lon, sog FROM ({fixes}) AS f0
UNION ALL SELECT CASE WHEN i % 10 = 4 THEN mmsi - 199000000 WHEN i % 10 = 6 THEN mmsi + 100000000 ELSE mmsi END AS mmsi, i + 1000000 AS i, t,
       CASE WHEN i % 10 = 1 THEN 91e0 WHEN i % 10 = 2 THEN NULL WHEN i % 10 = 3 THEN 1e-3 ELSE lat END AS lat,
       CASE WHEN i % 10 = 1 THEN 181e0 WHEN i % 10 = 3 THEN -1e-3 WHEN i % 10 <> 6 THEN lon WHEN lon + 1675e-1 > 180 THEN lon + 1675e-1 - 360 ELSE lon + 1675e-1 END AS lon, sog
FROM ({fixes}) AS f1 WHERE i % 10 BETWEEN 1 AND 6
"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    out = spark.sql(REPORTS_SQL.replace("{fixes}", FIXES_SQL), events=events)
    return out.selectExpr("CAST(mmsi AS BIGINT) AS mmsi", "CAST(i AS BIGINT) AS i", "CAST(t AS BIGINT) AS t", "lat", "lon", "sog")
