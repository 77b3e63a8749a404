"""Intermediate tables in the cluster's shared folder, and broadcasts behind a check of size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a table may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; unset, as in tests, a temporary one becomes the checkpoint folder, on a local master only."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        set_to = spark.sparkContext.getCheckpointDir()
        if not set_to:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathom-"))
            set_to = spark.sparkContext.getCheckpointDir()
    return set_to.rstrip("/")


class Scratch:
    """Written tables of one run in the shared folder. They cut lineage and outlive lost executors; results read them, so they stay until sweep()."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/fathom/{label}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; without names, all of this run's."""
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(since: int = 0) -> None:
    """Delete all tables this process has made, or those of the runs after the first so many; for when their results are written."""
    while len(Scratch.made) > since:
        Scratch.made.pop().drop()


def small(df: DataFrame, row_bytes: int) -> bool:
    """Whether a written table is within the broadcast bounds; reads at most the bound plus one rows."""
    bound = min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes)
    return df.limit(bound + 1).count() <= bound


def checked(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its size allows that; else as it is, for a shuffled join that adaptive execution can split."""
    return F.broadcast(df) if small(df, row_bytes) else df


def within_bounds(df: DataFrame, row_bytes: Column) -> bool:
    """Whether a written table of unequal rows may be broadcast; row_bytes is summed over the table."""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()
    return n <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def weighed(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Like checked, for rows of unequal size: row_bytes, summed over the table, is what is held against the bounds."""
    return F.broadcast(df) if within_bounds(df, row_bytes) else df
