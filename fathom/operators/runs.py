"""Minutes and runs of flagged minutes, as gaps and islands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minutes(fixes: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """mmsi, minute (epoch minutes), n, and per flag the number of fixes that have it."""
    return fixes.groupBy("mmsi", F.floor(F.col("t") / 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def runs(flagged: DataFrame, max_gap: int) -> DataFrame:
    """mmsi, run, first, last, n_minutes: the flagged minutes (mmsi, minute) joined over gaps of up to max_gap minutes."""
    w = Window.partitionBy("mmsi").orderBy("minute")
    opens = F.coalesce(F.col("minute") - F.lag("minute").over(w) > max_gap, F.lit(True)).cast("int")
    out = flagged.withColumn("o", opens).withColumn("run", F.sum("o").over(w))
    return out.groupBy("mmsi", "run").agg(F.min("minute").alias("first"), F.max("minute").alias("last"), F.count(F.lit(1)).alias("n_minutes"))


def trailing(flagged: DataFrame, width: int) -> DataFrame:
    """flagged with `within`: how many of the vessel's flagged minutes lie in the last `width` minutes, this one included. No grid of minutes is made."""
    w = Window.partitionBy("mmsi").orderBy("minute").rangeBetween(1 - width, 0)
    return flagged.withColumn("within", F.count(F.lit(1)).over(w))


def run_stats(found: DataFrame, fixes: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """found with n_fixes and per flag the share of the run's fixes that have it, both ends included. A vessel's runs don't overlap, so one pass in the order of time gives each fix the run that began last."""
    named = fixes.select("mmsi", F.floor(F.col("t") / 60).alias("minute"), F.lit(None).cast("struct<run: bigint, first: bigint, last: bigint>").alias("r"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()])
    opens = found.select("mmsi", F.col("first").alias("minute"), F.struct(*[F.col(c).cast("long").alias(c) for c in ("run", "first", "last")]).alias("r"), *[F.lit(None).cast("boolean").alias(k) for k in flags])
    w = Window.partitionBy("mmsi").orderBy("minute", F.col("r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = opens.unionByName(named).withColumn("own", F.last("r", ignorenulls=True).over(w)).where("r IS NULL AND minute <= own.last")
    return inside.select("mmsi", "own.*", *flags).groupBy("mmsi", "run", "first", "last").agg(F.count(F.lit(1)).alias("n_fixes"), *[F.avg(F.col(k).cast("double")).alias(f"{k}_share") for k in flags])


def quorum(flagged: DataFrame, first: DataFrame, width: int, share: float) -> DataFrame:
    """The rows of trailing() whose window lies wholly within the vessel's track, of which first(mmsi, first) is the first minute, and has at least the share of its minutes flagged."""
    near = trailing(flagged, width).join(first, "mmsi")
    return near.where((F.col("minute") - F.col("first") >= width - 1) & (F.col("within") >= math.ceil(share * width))).select("mmsi", "minute", "within")


def any_of(*flags: Column) -> Column:
    """Whether any flag holds; a null flag doesn't."""
    out = F.lit(False)
    for flag in flags:
        out = out | F.coalesce(flag, F.lit(False))
    return out


def counted_names(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, n, counts: how often each name occurs in a group, as text `a:1,b:2` in the order of names; null names don't count."""
    per = rows.where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "n"))), lambda x: F.concat_ws(":", x[name], x["n"])), ",")
    return per.groupBy(*by).agg(F.sum("n").alias("n"), said.alias("counts"))
