"""What the operators share: picking columns, reading tables, digests."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.plans.tables import Scratch, checked  # noqa: F401

#: The six ASCII white-space characters, as the contracts name them.
BLANKS = " \t\n\x0b\x0c\r"
#: Most rows and bytes of an Arrow batch; a longer text is a batch of its own.
BATCH, BATCH_BYTES = 1000, 4 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: What sessions had set before arrow_docs().
_before: dict[SparkSession, dict[str, str]] = {}


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, also where others differ from them by case alone or are repeated: the first exact name wins, then the first by case."""
    have = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(have))])
    low = [c.lower() for c in have]
    return flat.select(*[F.col(f"_{have.index(n) if n in have else low.index(n.lower())}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return take(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *columns)


def digest(*cols: Column) -> tuple[Column, Column]:
    """128 bits of hash as two longs, from two seeds."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)


def release() -> None:
    """Give freed memory back to the system: Spark reuses Python workers, and what one stage leaves allocated counts against the next."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_docs(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most BATCH rows and BATCH_BYTES from here on in its session: the default of 10,000 whole texts or 64 MB is more than a small executor's share. Plans read these settings when they run, so they hold until restore_batches()."""
    conf = df.sparkSession.conf
    held = {_ROWS: conf.get(_ROWS), _BYTES: conf.get(_BYTES, None)}
    for name, most in ((_ROWS, BATCH), (_BYTES, BATCH_BYTES)):
        if held[name] is not None and not 0 < int(held[name].rstrip("b")) <= most:
            _before.setdefault(df.sparkSession, held)
            conf.set(name, most)
    return df


def restore_batches(spark: SparkSession) -> None:
    """The session's own sizes of Arrow batches; for when all that arrow_docs() was called for has been written."""
    for name, value in _before.pop(spark, {}).items():
        if value is not None:
            spark.conf.set(name, value)
