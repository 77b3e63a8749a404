"""How many vessels are active when, and how regular that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timeline(spans: DataFrame, unit: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """slot, active: distinct vessels of spans(mmsi, first, last) in each unit, for each value of the columns `by`; units without any are absent."""
    slots = spans.select(*by, "mmsi", F.explode(F.sequence(F.floor(F.col("first") / unit), F.floor(F.col("last") / unit))).alias("slot"))
    return slots.groupBy(*by, "slot").agg(F.countDistinct("mmsi").alias("active"))


def span_counts(spans: DataFrame, unit: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """slot, active: how many spans(first, last) reach into each unit, whosever they are."""
    slots = spans.select(*by, F.explode(F.sequence(F.floor(F.col("first") / unit), F.floor(F.col("last") / unit))).alias("slot"))
    return slots.groupBy(*by, "slot").agg(F.count(F.lit(1)).alias("active"))


def gridded(line: DataFrame, first: int, last: int) -> DataFrame:
    """The timeline over all units from first to last, 0 where nobody is active."""
    grid = line.sparkSession.range(first, last + 1).toDF("slot")
    return grid.join(line, "slot", "left").select("slot", F.coalesce("active", F.lit(0)).cast("long").alias("active"))


def gridded_whole(line: DataFrame, unit: int) -> DataFrame:
    """The timeline over all slots of the whole units (of so many slots) that it reaches into: from the unit that holds its first slot to the end of the one that holds its last. An empty timeline has no grid."""
    ends = line.agg(F.floor(F.min("slot") / unit).alias("a"), F.floor(F.max("slot") / unit).alias("b")).where("a IS NOT NULL")
    grid = ends.select(F.explode(F.sequence(F.col("a") * unit, F.col("b") * unit + unit - 1)).alias("slot"))
    return grid.join(line, "slot", "left").select("slot", F.coalesce("active", F.lit(0)).cast("long").alias("active"))


def peak(line: DataFrame) -> DataFrame:
    """One row: the most active at once, the first time of that, the number of active units."""
    return line.agg(F.max("active").alias("peak"), F.max_by("slot", F.struct("active", -F.col("slot"))).alias("peak_at"), F.count_if(F.col("active") > 0).alias("n_active"))


def local_peaks(series: DataFrame, share: float) -> DataFrame:
    """The inner points of series(k, slot, active) that are no less than both neighbours and than the share of their key's maximum; gap: since the key's peak before."""
    w = Window.partitionBy("k").orderBy("slot")
    near = series.withColumns({"before": F.lag("active").over(w), "after": F.lead("active").over(w), "most": F.max("active").over(Window.partitionBy("k"))})
    top = near.where("active >= before AND active >= after").where(F.col("active") >= share * F.col("most"))
    return top.select("k", "slot", "active").withColumn("gap", F.col("slot") - F.lag("slot").over(w))


def variation(series: DataFrame, unit: int) -> DataFrame:
    """k, n_units, cv: of each key's maximum per unit, the population standard deviation over the mean; null for one unit alone."""
    top = series.groupBy("k", F.floor(F.col("slot") / unit).alias("u")).agg(F.max("active").alias("most"))
    return top.groupBy("k").agg(F.count(F.lit(1)).alias("n_units"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("most") / F.avg("most")).alias("cv"))


def peak_spacing(series: DataFrame, share: float) -> DataFrame:
    """k, n_peaks, cv: of the gaps between each key's local peaks, the population standard deviation over the mean; null below two gaps."""
    gaps = local_peaks(series, share).groupBy("k").agg(F.count(F.lit(1)).alias("n_peaks"), F.count("gap").alias("n"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv"))
    return gaps.select("k", "n_peaks", F.when(F.col("n") > 1, F.col("cv")).alias("cv"))


def highest(series: DataFrame, share: float, k: int) -> DataFrame:
    """k, place, slot, active: each key's k highest local peaks, the earlier of equal ones first."""
    w = Window.partitionBy("k").orderBy(F.desc("active"), "slot")
    return local_peaks(series, share).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("k", "place", "slot", "active")


def summary(series: DataFrame) -> DataFrame:
    """k, n_slots, duration (from first to last slot), most, mean of series(k, slot, active)."""
    return series.groupBy("k").agg(F.count(F.lit(1)).alias("n_slots"), (F.max("slot") - F.min("slot")).alias("duration"), F.max("active").alias("most"), F.avg("active").alias("mean"))
