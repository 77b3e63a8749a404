"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the
normalised text, an entry for each digest: the document that stays, its length
and how many rows had the digest. A batch is reduced to one row per digest
before anything is joined; a sort-merge anti-join with the index finds the
digests that it lacks, which are appended.

A batch is staged under its id and seen by others once commit() has marked it,
which is for after the caller's results are written. A batch that is run again
replaces what it had staged and doesn't meet its own entries, so it comes to the
same decisions; what a lost run staged is never seen. One writer at a time is
meant; digests that two writers add at once are merged when they are read.
compact() writes all entries anew as one sorted file per bucket.

Which row stays when the index knows the digest already: by default the one in
the index, and all of the batch's rows go. With `update`, the better of both by
the rule below; the batch then appends what it knows about digests seen before
as well, and ruled() says what holds for rows of earlier batches too.

Defined cases: null text counts as empty, and all empty texts are one
group; of equal texts the longest original stays, then the smallest doc_id
(a null doc_id after all others); repeated rows of one doc_id and text
carry the same decision; an empty table gives an empty result and
leaves the index as it was. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, take


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _best():
    """The least of these is the row that stays."""
    return F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id")


class DigestIndex:
    """Digests of the committed batches, at a path every executor can read."""

    COLUMNS = "digest BINARY, keep_id BIGINT, keep_chars INT, n BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """path: an absent folder starts an empty index; a filled one is taken up. buckets must stay the same for a path."""
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        said = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        spark.sql(f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{said}'")
        fs, root = self._file()
        fs.mkdirs(root)
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self) -> list[str]:
        """The batches that count: those with a mark, but for what a compaction's mark names as replaced."""
        fs, marks = self._file("_marks")
        found, gone = [], set()
        for status in fs.listStatus(marks) if fs.exists(marks) else []:
            if not (name := status.getPath().getName()).startswith("."):
                found.append(name)
                data = fs.open(status.getPath())
                gone.update(self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8").split())
                data.close()
        return sorted(set(found) - gone)

    def _mark(self, batch: str, replaced: list[str]) -> None:
        fs, path = self._file("_marks", batch)
        _, draft = self._file("_marks", f".{batch}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.writeBytes("\n".join(replaced))
        out.close()
        if not fs.rename(draft, path) and not fs.exists(path):
            raise OSError(f"the mark of batch {batch} could not be written")

    def read(self, but: str | None = None) -> DataFrame:
        """digest, keep_id, keep_chars, n of the committed batches other than `but`; rows lie by bucket, so merging them shuffles nothing."""
        entries = self.spark.table(self.name).where(F.col("batch").isin([b for b in self.committed() if b != but]))
        best = F.min(F.struct((-F.col("keep_chars")).alias("c"), F.col("keep_id").isNull().alias("x"), "keep_id"))
        merged = entries.groupBy("digest").agg(best.alias("best"), F.sum("n").alias("n"))
        return merged.select("digest", F.col("best.keep_id").alias("keep_id"), (-F.col("best.c")).alias("keep_chars"), "n")

    def stage(self, entries: DataFrame, batch: str) -> None:
        """Write a batch's entries, in place of any it had staged before. Nobody sees them until commit()."""
        rows = entries.select("digest", "keep_id", "keep_chars", "n", F.lit(batch).alias("batch"))
        self._drop(batch)
        rows.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def commit(self, batch: str) -> None:
        """From now on other batches meet this one's entries; to be called when its results are written. Twice is once."""
        self._mark(batch, [])

    def _drop(self, batch: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = '{batch}')")
        fs, path = self._file(f"batch={batch}")
        fs.delete(path, True)

    def compact(self) -> None:
        """All committed entries as one batch, sorted within its buckets. A run lost on the way leaves the index as it was."""
        old, name = self.committed(), f"compact-{uuid.uuid4().hex}"
        if len(old) > 1:
            self.stage(self.read(), name)
            self._mark(name, old)
            for batch in old:
                fs, path = self._file("_marks", batch)
                fs.delete(path, False)
                self._drop(batch)
            self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, chars of each row of docs (doc_id, text): all that moves from here on."""
    d = take(docs, "doc_id", "text")
    return d.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"), F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))


def arrive(rows: DataFrame, index: DigestIndex, batch: str, scratch: Scratch, update: bool = False) -> DataFrame:
    """Stage a batch's written rows of digests(); digest, group_size (rows of this batch), keep_id, keep_chars of its digests, keep_chars null where the row that stays is none of the batch's.

    A digest that a third of all rows share costs one row per task in the
    aggregation.
    """
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a batch id has letters, digits, - and _")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(_best()).alias("best"))
    groups = scratch.save(groups.select("digest", "n", F.col("best.doc_id").alias("keep_id"), (-F.col("best.c")).alias("keep_chars")), f"groups-{batch}")
    known = index.read(but=batch)
    fresh = groups.hint("merge").join(known.select("digest"), "digest", "left_anti")
    old = known.select("digest", F.col("keep_id").alias("old_id"), F.col("keep_chars").alias("old_chars"))
    seen = groups.hint("merge").join(old, "digest")
    index.stage(fresh.unionByName(seen.drop("old_id", "old_chars")) if update else fresh, batch)
    rank = lambda chars, key: F.struct(-F.col(chars), F.col(key).isNull(), F.col(key))
    stays = rank("old_chars", "old_id") <= rank("keep_chars", "keep_id") if update else F.lit(True)
    ruled = seen.select("digest", "n", F.when(stays, F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(~stays, F.col("keep_chars")).alias("keep_chars"))
    return scratch.save(fresh.unionByName(ruled).withColumnRenamed("n", "group_size"), f"ruled-{batch}")


def ruled(rows: DataFrame, by: DataFrame) -> DataFrame:
    """One row per row of digests(): doc_id, keep_id, group_size, kept, digest. by: written; both sides are plain exchanges, so adaptive execution splits the rows of a digest that many share."""
    out = rows.join(by, "digest")
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("chars").eqNullSafe(F.col("keep_chars"))).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, scratch: Scratch) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size (rows of this batch with the digest), kept, digest. The batch is staged; commit it when this is written."""
    rows = scratch.save(digests(docs), f"rows-{batch}")
    return ruled(rows, arrive(rows, index, batch, scratch))


#: The query's documents come to the index in so many batches, by a hash of doc_id.
ARRIVALS = 2


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in batches that go through one index one after another; the better of two equal texts stays whichever came first."""
    scratch = Scratch(spark, "op10")
    index = DigestIndex(spark, f"{scratch.root}/index")
    rows = scratch.save(digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), "rows")
    for k in range(ARRIVALS):
        arrive(rows.where(F.col("arrival") == k), index, f"arrival-{k}", scratch, update=True)
        index.commit(f"arrival-{k}")
    final = scratch.save(index.read().withColumnRenamed("n", "group_size"), "final")
    return ruled(rows, final).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS chars, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS h FROM d),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(chars) OVER w AS keep_chars, count(*) OVER (PARTITION BY h) AS group_size FROM n
      WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND chars = keep_chars AS kept, h AS text_sha256 FROM r
"""
