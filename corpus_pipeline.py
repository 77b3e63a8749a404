"""A corpus pipeline: the stages read documents one after another, each from the table its predecessor wrote.

Defined cases, stage by stage: a text that is null, or has no letters, has no
known language and goes with the first stage. Where a later stage meets one, it
stays: it has no lines, no near duplicates, no passages, and one empty
segmentation. A null doc_id is an id of its own, a null source a source of its
own, a null lang isn't learned. Rows repeated in all columns are pages each of
their source, and near_duplicates leaves one of them. Texts are processed whole,
whatever their length. Empty tables give empty tables. Columns beside those of
documents are left behind, also where their names differ by case alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate, lang_id, line_dedup, near_dedup, sampled_pieces
from fathom.llm.common import Scratch, checked, digest, restore_batches, take
from fathom.plans.tables import sweep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from these documents."""
    return lang_id.keep_known(take(docs, *COLUMNS), lang_id.train(lang_id.sample(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines, n_chars counted anew; one of boilerplate alone stays as it is, for the next stage."""
    out = line_dedup.dedup_lines(take(docs, *COLUMNS), "source", "text", Scratch(spark, "lines"), keep_emptied=True)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id, null ones last, among these of the least digest. Rows are nodes by doc_id and text, so null and repeated ids take part as well."""
    scratch, docs = Scratch(spark, "near"), take(docs, *COLUMNS)
    node = F.shiftright(F.xxhash64("doc_id", "text"), 1)
    a, b = digest(*[F.col(c) for c in COLUMNS], *[F.col(c).isNull() for c in COLUMNS])
    found = near_dedup.near_dedup(docs.select(node.alias("doc_id"), "text"), scratch)
    named = scratch.save(found.select(F.col("doc_id").alias("node"), "component_id").distinct(), "named")
    rows = docs.select(node.alias("node"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", a.alias("a"), b.alias("b")).alias("row"))
    rows = rows.groupBy("node", "row").agg(F.count(F.lit(1)).alias("n")).join(named, "node")
    rows = scratch.save(rows.select("component_id", "row", "n"), "rows")
    best = rows.groupBy("component_id").agg(F.min("row").alias("best"), F.sum("n").alias("all")).where("all > 1").select("component_id", "best")
    best = scratch.save(best, "best")
    gone = rows.join(checked(best, 64), "component_id").where("row <> best OR n > 1").select(F.col("row.a").alias("ga"), F.col("row.b").alias("gb"), (F.col("row") == F.col("best")).alias("again"))
    gone = scratch.save(gone, "gone")
    keyed = docs.withColumns({"a": a, "b": b})
    same = (F.col("a") == F.col("ga")) & (F.col("b") == F.col("gb"))
    once = keyed.join(checked(gone, 32), same, "left_anti").select(*COLUMNS)
    again = keyed.join(checked(gone.where("again"), 32), same, "left_semi").dropDuplicates(["a", "b"]).select(*COLUMNS)
    return once.unionByName(again)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_contaminated(take(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled segmentations."""
    return sampled_pieces.sampled_pieces(take(docs, *COLUMNS))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pieces", pieces)]
#: SQL expresses neither the classifier nor the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's tables are deleted when the next has been written; the last one's stay for the caller."""
    scratch, docs, before = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        made = len(Scratch.made)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        sweep(made)
        if before:
            scratch.drop(before)
        before = name
    restore_batches(spark)
    return docs
