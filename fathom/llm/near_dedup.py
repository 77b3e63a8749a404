"""MinHash near-dedup with circulant permutations, banding and exact verification.

A document's set holds the hashes of its distinct five-word shingles, over the
lower-cased (A-Z) text and words as `[^\\x20\\x09-\\x0D]+`. Signatures are
circulant: one permutation scatters the set over a universe of 2^20 places, a
second one, shifted circularly by 0, 1, 2 ... places, gives each coordinate's
order, so all coordinates of a shingle are neighbours in one table.

Plan: equal sets become one class. Classes that share a band meet their bucket's
smallest member, and in crowded buckets a few members of what that joins; after
the components of those links, members outside a bucket's
largest component are compared with the others of the bucket, so every pair of a
bucket that isn't joined already is looked at. Those comparisons are of sketches,
one bit of each of 2048 circulant coordinates, inside the join and in the first
band a pair shares; only pairs whose sketches are close come out of it. A bucket
with more than HOT such members is not compared member by member: sets so similar
share one of their rarest shingles (the first quarter of each set, in any one order
of all shingles; here by how often they occur among the members), so its members meet by
those. Texts of one template that differ in more than a quarter then never meet.
Where a rare shingle is shared by too many in turn, its members alone are compared
in the bucket. Every
link is confirmed on full sets. Four rows in 32 bands miss a pair of similarity
0.75 with a probability of 5e-6, the sketches one with 3e-7 (five standard
deviations).

Defined cases: null or blank text has an empty set, links with nothing and is a
component of its own; fewer than five words make one shingle; rows with one
doc_id are one document that has the links of each; rows with a null doc_id and
one text are one document, whose component is null, and which is kept, if no doc_id
is reachable; doc_ids are below 2^62; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.plans.graph import components

from .common import Scratch, arrow_docs, checked, release, restore_batches, take

WORDS, BANDS, ROWS, UNIVERSE = 5, 32, 4, 1 << 20
K = BANDS * ROWS
#: Similarity in hundredths; bits of a sketch, and the most of them in which such a pair may differ: an eighth and five standard deviations.
PERCENT, BITS = 75, 2048
APART = int(BITS / 8 + 5 * (BITS * 7 / 64) ** 0.5)
#: Members of a bucket, or of a shingle, beside its largest component, beyond which they are not compared with all others at once; up to that, the work grows with the bucket's size alone. Parts of the hash range in which shingles are counted.
HOT, PARTS = 1024, 1 << 18
#: Pairs of a bucket from which on its members are compared with so many members of its largest component before all others.
CROWDED, HUBS = 20_000, 4
LONGS = [f"s{i}" for i in range(BITS // 64)]
NAMELESS = 1 << 62
SHARED = [f"b{i}" for i in range(BANDS)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def permutations(shifts: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the second one as a window of so many shifts at each place."""
    place = np.arange(UNIVERSE, dtype=np.uint64)
    first, second = (np.argsort(mix(place + np.uint64(s << 32)), kind="stable").astype(np.uint32) for s in (1, 2))
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: shifts - 1]]), shifts)


#: Odd multipliers of the words of a shingle; one more for its length.
ODD = mix(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, both touch ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64) * ODD[WORDS]
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * ODD[i]
    return np.unique(mix(total))


def signature(found: np.ndarray, shifts: int = K) -> np.ndarray:
    first, second = permutations(shifts)
    at, low, rows = first[(found >> np.uint64(44)).astype(np.int64)], None, max(1, (1 << 19) // shifts)
    for i in range(0, len(at), rows):
        part = second[at[i : i + rows]].min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """From (documents, K): (documents, BANDS) of 64-bit keys that differ from band to band."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * ODD[0] + np.zeros((len(signatures), 1), np.uint64)
    for i in range(ROWS):
        key = mix(key ^ rows[:, :, i]) + ODD[i]
    return key


SIGNED = "doc_id long, n int, d1 long, d2 long, bands array<long>"


def _sign(batches):
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), 1000):
            part = batch.slice(at, 1000)
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int32)
            sig = np.zeros((len(sets), K), np.uint32)
            ids = np.zeros((len(sets), 2), np.int64)
            for i in np.flatnonzero(n):
                sig[i] = signature(sets[i])
                ids[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.int64)
            keys = band_keys(sig).view(np.int64)
            ends = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(n), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                names=["doc_id", "n", "d1", "d2", "bands"],
            )
        release()


def _sets(batches):
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), 1000):
            part = batch.slice(at, 1000)
            sets = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *sets])
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "items"])
        release()


def _sketches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sets = [x for x in ((i, shingles(t)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())) if len(x[1])]
            low = np.stack([signature(x, BITS) for _, x in sets]) if sets else np.zeros((0, BITS), np.uint32)
            bits = np.packbits((low & 1).astype(bool), axis=1).view(np.int64)
            keys = band_keys(low[:, :K]).astype(np.uint32).view(np.int32)
            cols = [pa.array([i for i, _ in sets], pa.int64()), pa.array([len(x) for _, x in sets], pa.int32()), *[pa.array(c.copy()) for c in (*bits.T, *keys.T)]]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "n", *LONGS, *SHARED])
        release()


SKETCHED = ", ".join(["node long, n int", *[f"{c} long" for c in LONGS], *[f"{c} int" for c in SHARED]])


def _near(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b).cast("long") >= PERCENT * F.greatest(a, b).cast("long")


def verify(docs: DataFrame, pairs: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Of pairs(a, b) of doc_ids, those whose full sets are similar enough. Sets are made again from the texts of the documents concerned."""
    nodes = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{label}nodes")
    sets = docs.join(checked(nodes, 24), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "node long, items array<long>")
    sets = scratch.save(sets, f"{label}sets")
    one, two = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = pairs.join(one, "a").join(two, "b")
    same = F.size(F.array_intersect("x", "y"))
    links = both.select("a", "b", same.cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("t"))
    links = scratch.save(links.where(100 * F.col("i") >= PERCENT * (F.col("t") - F.col("i"))).select("a", "b").distinct(), f"{label}links")
    scratch.drop(f"{label}sets", f"{label}nodes")
    return links


def near_dedup(df: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = arrow_docs(take(df, "doc_id", "text"))
    # a null doc_id is replaced by a hash of the text, above all others
    named = F.when(F.col("doc_id") >= NAMELESS, F.raise_error(F.lit("a doc_id is 2^62 or more")).cast("long")).otherwise(F.col("doc_id"))
    docs = docs.withColumn("doc_id", F.coalesce(named, F.shiftrightunsigned(F.xxhash64("text"), 2) + NAMELESS))
    signed = scratch.save(docs.mapInArrow(_sign, SIGNED), "signed")
    full = signed.where("n > 0")
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"))
    classes = scratch.save(classes, "classes")
    first = full.join(classes.select("d1", "d2", F.col("node").alias("doc_id")), ["d1", "d2", "doc_id"])
    banded = first.select(F.posexplode("bands").alias("band", "key"), F.col("doc_id").alias("node"), "n")
    buckets = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.max("node").alias("most")).where("least.node < most")
    buckets = scratch.save(buckets.select("key", F.col("least.node").alias("a"), F.col("least.n").alias("m")), "buckets")
    members = scratch.save(banded.join(buckets, "key").select("key", "band", "node", "n", "a", "m"), "members")
    scratch.drop("buckets")
    pairs = members.where((F.col("node") != F.col("a")) & _near(F.col("n"), F.col("m"))).select("a", F.col("node").alias("b")).distinct()
    pairs = scratch.save(pairs, "pairs")
    links = verify(docs, pairs, scratch, "star")
    roots = components(links, scratch, "one")
    hubs = scratch.save(_hubs(members, roots).join(pairs, ["a", "b"], "left_anti"), "hubs")
    if not hubs.isEmpty():
        links = scratch.save(links.union(verify(docs, hubs, scratch, "hub")), "huball")
        roots, pairs = components(links, scratch, "hubbed"), pairs.union(hubs)
    others = scratch.save(_unmet(docs, members, roots, pairs, scratch), "unmet")
    if not others.isEmpty():
        roots = components(scratch.save(links.union(verify(docs, others, scratch, "rest")), "all"), scratch, "two")
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = roots.join(least, "root").select("node", "component_id")
    ruled = classes.join(named, "node", "left").select("d1", "d2", F.coalesce("component_id", "node").alias("component_id"))
    ruled = scratch.save(ruled.groupBy("d1", "d2").agg(F.min("component_id").alias("component_id")), "ruled")
    out = full.join(ruled, ["d1", "d2"]).select("doc_id", "n", "component_id").unionByName(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    named = [F.when(F.col(c) < NAMELESS, F.col(c)).alias(c) for c in ("doc_id", "component_id")]
    out = out.select(F.col("n").cast("long").alias("n_shingles"), *named)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _part_counts(batches):
    """How many of the batch's shingles fall in each part of the hash range."""
    for batch in batches:
        sets = [shingles(t) for t in batch.column(0).to_pylist()]
        part, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(64 - PARTS.bit_length() + 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(n)], names=["part", "n"])
        release()


def rarest(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many of a set's first items, in the order of the counts of their parts, that two sets which are similar enough share one."""
    order = np.lexsort((items, counts[(items >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)]))
    return items[order[: len(items) - (PERCENT * len(items) + 99) // 100 + 1]]


def _rare(docs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, n, item: the rarest shingles of the nodes' texts. The counts are PARTS numbers, whatever the input."""
    texts = docs.join(checked(nodes, 24), "doc_id", "left_semi").select("doc_id", "text")
    found = texts.select("text").mapInArrow(_part_counts, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(PARTS, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                rare = [rarest(x, shared.value) for x in sets]
                size = [len(x) for x in rare]
                node = np.repeat(np.array(part.column(0).to_pylist(), np.int64), size)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat([len(x) for x in sets], size).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.uint64), *rare]).view(np.int64))], names=["node", "n", "item"])
            release()

    return scratch.save(texts.mapInArrow(run, "node long, n int, item long").distinct(), "rare")


def _mixed(members: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """by, main (the root that most members of a group have) of groups of members(by, root) with several roots: those of at most HOT members beside the main one's, and the others."""
    sizes = members.groupBy(by, "root").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy(by).agg(F.max(F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("all")).where("roots > 1")
    main = main.select(by, F.col("main.root").alias("main"), (F.col("all") - F.col("main.c") > HOT).alias("hot"))
    return main.where("NOT hot").drop("hot"), main.where("hot").drop("hot")


def _hubs(members: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: in buckets with more than CROWDED pairs to look at, each member outside the largest component with a few members of that, chosen by hash: the least member may be a poor centre of a large group."""
    rooted = members.select("key", "node", "n").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), *[F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node", "n")).alias(f"h{i}") for i in range(HUBS)])
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "root", *[f"h{i}" for i in range(HUBS)])).alias("m"), F.sum("c").alias("all"))
    main = main.where((F.col("all") - F.col("m.c")) * F.col("all") > CROWDED)
    hubs = main.select("key", F.col("m.root").alias("main"), F.explode(F.array(*[f"m.h{i}" for i in range(HUBS)])).alias("hub"))
    met = rooted.join(hubs, "key").where((F.col("root") != F.col("main")) & _near(F.col("n"), F.col("hub.n")))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _apart(l: str, r: str) -> Column:
    return sum((F.bit_count(F.col(f"{l}.{c}").bitwiseXOR(F.col(f"{r}.{c}"))) for c in LONGS[1:]), F.bit_count(F.col(f"{l}.s0").bitwiseXOR(F.col(f"{r}.s0"))))


def _close(members: DataFrame, by: str, sketches: DataFrame, once: bool) -> DataFrame:
    """a, b: pairs of a group with different roots and close sketches, one of them beside the group's main root. once: members have a band, and a pair counts in the first band it shares."""
    col = F.col
    one, two = (x.join(sketches, ["node", "n"]).alias(k) for k, x in (("l", members.where("NOT in_main")), ("r", members)))
    met = (col(f"l.{by}") == col(f"r.{by}")) & (col("l.root") != col("r.root")) & (col("r.in_main") | (col("l.node") < col("r.node"))) & _near(col("l.n"), col("r.n")) & (_apart("l", "r") <= APART)
    if once:
        for i, c in enumerate(SHARED):  # an earlier band has them together already
            met = met & ((col("l.band") <= i) | (col(f"l.{c}") != col(f"r.{c}")))
    return one.join(two, met).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _unmet(docs: DataFrame, members: DataFrame, roots: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of a bucket that aren't joined yet, weren't compared and have close sketches: those outside its largest component against all of the bucket."""
    rooted = members.select("key", "band", "node", "n").join(roots, "node", "left").select("key", "band", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    cool, hot = _mixed(rooted, "key")
    main = scratch.save(cool.withColumn("hot", F.lit(False)).unionByName(hot.withColumn("hot", F.lit(True))), "main")
    live = scratch.save(rooted.join(main, "key").select("key", "band", "node", "n", "root", (F.col("root") == F.col("main")).alias("in_main"), "hot"), "live")
    nodes = scratch.save(live.select(F.col("node").alias("doc_id")).distinct(), "livenodes")
    sketches = docs.join(checked(nodes, 24), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sketches, SKETCHED)
    sketches = scratch.save(sketches.distinct(), "sketches")
    found = _close(live.where("NOT hot"), "key", sketches, True)
    hot = scratch.save(live.where("hot"), "hot")
    if not hot.isEmpty():
        known = scratch.save(hot.select("node", "n", "root").distinct(), "hotnodes")
        rare = _rare(docs, known.select(F.col("node").alias("doc_id")).distinct(), scratch).join(known, ["node", "n"])
        rare = scratch.save(rare.select("item", "node", "n", "root"), "rarerooted")
        few, many = _mixed(rare, "item")
        few = scratch.save(few, "few")
        met = scratch.save(rare.join(few, "item").select("item", "node", "n", "root", (F.col("root") == F.col("main")).alias("in_main")), "met")
        crowd = scratch.save(rare.join(scratch.save(many.select("item"), "many"), "item", "left_semi").select("node").distinct(), "crowd")
        found = found.unionByName(_close(met, "item", sketches, False)).unionByName(_close(hot.join(checked(crowd, 24), "node", "left_semi"), "key", sketches, True))
    return found.distinct().join(pairs, ["a", "b"], "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op2"))
    restore_batches(spark)  # what is left to run reads written tables alone
    return out


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
