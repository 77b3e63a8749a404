"""Sharding by extendible hashing.

A row's place is the leading bits of a 60-bit key hash. The directory is a
binary trie over those bits: a bucket over the byte limit splits on its next
bit, all others stay, until every bucket fits. Bytes are summed once per cell
of a fine prefix and the trie is cut out of those sums, so a level costs no
pass over the rows; cells that still hold too much are looked at alone, deeper.

Defined cases: null text has 0 bytes; a null key is a key of its own; a bucket
of one row cannot split and stays, marked oversized if it exceeds the limit;
rows of one equal key never part by it, so they go on by the hash of the whole
row, and rows equal in all columns, which are interchangeable, are counted and
dealt into pages of as many as fit; an empty table has no shards. Columns may
have any names; the added ones (shard, depth, shard_bytes, oversized) follow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, take

BITS = 60
#: Bits by which the first cells are finer than shards of the limit's size; levels of the trie that are summed at once.
FINER, LEVELS = 5, 6
#: Bytes of a shard in the query: small, so that tables of any size split to unequal depths.
LIMIT = 64 << 10


def hash60(*cols: Column) -> Column:
    """The first 60 bits of the MD5 of the columns as text."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _cell(deep: int) -> Column:
    return F.shiftright("h", BITS - deep)


def _nodes(cells: DataFrame, low: int, deep: int, scratch: Scratch, label: str) -> DataFrame:
    """base, depth, prefix, shard_bytes, shard_rows of the trie's nodes from depth low to deep; each few levels are summed from the highest of the levels below."""
    out, below = None, cells.select("base", F.col("cell").alias("prefix"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"))
    while True:
        high = max(low, deep - LEVELS)
        up = below.select("base", "prefix", "shard_bytes", "shard_rows", F.explode(F.sequence(F.lit(high), F.lit(deep))).alias("depth"))
        up = up.withColumn("prefix", F.expr(f"shiftright(prefix, {deep} - depth)"))
        nodes = up.groupBy("base", "depth", "prefix").agg(F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_rows").alias("shard_rows"))
        nodes = scratch.save(nodes, f"{label}levels{high}")
        own = nodes if out is None else nodes.where(F.col("depth") < deep)
        out = own if out is None else out.unionByName(own)
        if high == low:
            return out
        below, deep = nodes.where(F.col("depth") == high).drop("depth"), high


def _place(rows: DataFrame, limit: int, scratch: Scratch, label: str) -> tuple[DataFrame, DataFrame | None]:
    """rows(base, h, bytes, ...) with shard, depth, shard_bytes, shard_rows; and those, if any, that 60 bits of h don't part.

    A node's size never grows with depth, so a row's leaf is its shortest
    prefix that fits.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, deep, turn = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + FINER)), 0
    left, out = rows, None
    while True:
        cells = scratch.save(left.groupBy("base", _cell(deep).alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")), f"{label}cells{turn}")
        nodes = _nodes(cells, low, deep, scratch, f"{label}{turn}")
        at = cells.select("base", "cell", F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
        nodes = scratch.save(nodes.where(fits), f"{label}nodes{turn}")
        # short prefixes hold the most cells; those above all nodes that fit are not dealt out
        top = nodes.agg(F.min("depth")).first()[0]
        pairs = at.where(F.col("depth") >= F.lit(low if top is None else top)).join(nodes, ["base", "depth", "prefix"])
        leaf = pairs.groupBy("base", "cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf"))
        leaves = scratch.save(leaf.select("base", "cell", "leaf.*"), f"{label}leaves{turn}")
        big = scratch.save(cells.join(leaves, ["base", "cell"], "left_anti").select("base", "cell"), f"{label}big{turn}")
        keyed = left.withColumn("cell", _cell(deep))
        placed = keyed.join(checked(leaves, 64), ["base", "cell"]).drop("cell")
        out = placed if out is None else out.unionByName(placed)
        if big.isEmpty():
            break
        left = keyed.join(checked(big, 48), ["base", "cell"], "left_semi").drop("cell")
        low, deep, turn = deep + 1, min(BITS, deep + 8), turn + 1
    out = out.withColumn("shard", F.concat("base", F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END"))).drop("prefix")
    if deep < BITS:
        return out, None
    stuck = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    return out.where(~stuck), out.where(stuck)


def assign_shards(df: DataFrame, key: list[str], sized: list[str], limit: int, scratch: Scratch) -> DataFrame:
    """df's columns with the shard of each row. key: columns that are hashed; sized: columns whose UTF-8 bytes count."""
    names = df.columns
    low = [n.lower() for n in names]
    at = lambda n: F.col(f"c{names.index(n) if n in names else low.index(n.lower())}")
    own = [f"c{i}" for i in range(len(names))]
    rows = df.toDF(*own)
    size = sum((F.coalesce(F.octet_length(at(s).cast("string")), F.lit(0)) for s in sized), F.lit(0).cast("long"))
    rows = rows.select(*own, F.lit("").alias("base"), hash60(*[at(k) for k in key]).alias("h"), size.alias("bytes"))
    made = ["shard", "depth", "shard_bytes", "shard_rows"]
    out, stuck = _place(rows, limit, scratch, "key")
    out = out.select(*own, *made)
    if stuck is not None and not stuck.isEmpty():
        whole = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
        again = stuck.select(*own, F.concat("shard", F.lit("+")).alias("base"), hash60(whole).alias("h"), "bytes")
        parted, same = _place(again, limit, scratch, "row")
        out = out.unionByName(parted.select(*own, (F.col("depth") + BITS).alias("depth"), "shard", "shard_bytes", "shard_rows"))
        if same is not None and not same.isEmpty():
            out = out.unionByName(_pages(same, own, limit))
    over = F.col("shard_bytes") > limit
    return out.select(*[F.col(c).alias(n) for c, n in zip(own, names)], "shard", "depth", "shard_bytes", over.alias("oversized"))


def _pages(same: DataFrame, own: list[str], limit: int) -> DataFrame:
    """Rows equal in all columns, counted and made anew page by page; a page is one task's work at most."""
    counted = same.groupBy(*own, "shard", "bytes").agg(F.count(F.lit(1)).alias("n"))
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1)).cast("long")
    pages = counted.withColumn("fit", fit).withColumn("page", F.explode(F.expr("sequence(0L, (n - 1) div fit)")))
    pages = pages.repartition(F.xxhash64("shard", "page")).withColumn("k", F.expr("least(fit, n - page * fit)"))
    rows = pages.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    return rows.select(*own, F.concat("shard", F.lit("/"), F.col("page").cast("string")).alias("shard"), F.lit(2 * BITS).alias("depth"), (F.col("k") * F.col("bytes")).alias("shard_bytes"), F.col("k").alias("shard_rows"))


def directory(sharded: DataFrame) -> DataFrame:
    """The directory's leaves: shard (its hash prefix in bits), depth, shard_bytes, n_rows, oversized."""
    return sharded.groupBy("shard", "depth", "shard_bytes", "oversized").agg(F.count(F.lit(1)).alias("n_rows"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows together: hash-partitioned by shard, so that a shard is written by one task."""
    sharded.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = take(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return assign_shards(docs, ["doc_id"], ["text"], LIMIT, Scratch(spark, "op1")).drop("text")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null')), 1, 15))::BIGINT AS h FROM documents),
ups AS (SELECT depth, h >> ({BITS} - depth) AS prefix, doc_id, h, bytes FROM d, (SELECT unnest(generate_series(0, {BITS}))::INT AS depth)),
node AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS n FROM ups GROUP BY ALL),
leaf AS (SELECT ups.doc_id, ups.h, min(depth) AS depth FROM ups JOIN node USING (depth, prefix) WHERE shard_bytes <= {LIMIT} OR n = 1 OR depth = {BITS} GROUP BY ALL)
SELECT leaf.doc_id, CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(prefix), leaf.depth, '0') END AS shard, leaf.depth, shard_bytes, shard_bytes > {LIMIT} AS oversized
FROM leaf JOIN node ON node.depth = leaf.depth AND node.prefix = h >> ({BITS} - leaf.depth)
"""
