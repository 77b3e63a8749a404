"""WARC fixity audit with Merkle trees.

Records are WARC/1.1 `resource` records, put by the SHA-256 of their key and URL into
files of about a given size and ordered there by a segment of that hash, then by
key. Offsets add up within segments and over the segments of a file, so no task
sorts a whole file. Per file, a tree is built over the ordered records: a leaf is the SHA-256 of a record with its offset range, a
node the SHA-256 of its children's ranges and hashes, `fanout` of them to a
node. An audit compares the roots of two replicas and goes down only below nodes
that differ. A change of length moves all later records of its file, so what it
reaches is matched by key and content: records of equal content are intact wherever
they lie, what is left of a key on both sides is corrupt, on one side missing or
extra.

Defined cases: null url and html are empty; a null key is a key of its own and
comes first; repeated rows are records each, their order among equals is that of
their bytes; a record that one replica lacks is missing or extra, with its range in
the other, and a record whose key is damaged is both; an empty table gives no files and no findings. Other columns are
ignored. WARC files may be plain or gzip, in one member or many, and header names
in any case; a record that is cut short, has no length or one that doesn't fit,
and bytes of a member that can't be unpacked, are a row that says so, and reading
goes on at the next record.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH, BATCH_BYTES, Scratch, arrow_docs, checked, take

FILE_BYTES, FANOUT, SEGMENTS = 64 << 20, 16, 256
NEVER = "1970-01-01T00:00:00Z"


def record(key: Column, url: Column, body: Column) -> Column:
    """The bytes of a record, as a string; its end is the blank line that parts records."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(f">\r\nWARC-Date: {NEVER}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def files_for(total: int, file_bytes: int = FILE_BYTES) -> int:
    return max(1, math.ceil(total / file_bytes))


def to_records(pages: DataFrame, n_files: int) -> DataFrame:
    """file, segment, key, data from pages (page_id, url, html)."""
    p = take(pages, "page_id", "url", "html")
    told = F.sha2(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" "), F.coalesce("url", F.lit(""))), 256)
    place = (F.conv(F.substring(told, 1, 8), 16, 10).cast("long") % (n_files * SEGMENTS)).cast("int")
    return p.select(F.floor(place / SEGMENTS).cast("int").alias("file"), (place % SEGMENTS).alias("segment"), F.col("page_id").alias("key"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("data"))


def leaves(records: DataFrame) -> DataFrame:
    """file, at (place in the file), key, start, stop (bytes), sha of the record, hash of it with its range. Only lengths and hashes are sorted, a segment at a time."""
    narrow = records.select("file", "segment", "key", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha"))
    total = narrow.groupBy("file", "segment").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    total = total.select("file", "segment", (F.sum("bytes").over(over) - F.col("bytes")).alias("bytes"), (F.sum("n").over(over) - F.col("n")).alias("n"))
    w = Window.partitionBy("file", "segment").orderBy("key", "sha")
    at = narrow.withColumn("i", F.row_number().over(w) - 1).withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.join(total, ["file", "segment"]).withColumn("stop", F.col("bytes") + F.col("upto")).withColumn("start", F.col("stop") - F.col("size"))
    return at.select("file", (F.col("n") + F.col("i")).alias("at"), "key", "start", "stop", "sha", F.sha2(F.concat_ws(":", "start", "stop", "sha"), 256).alias("hash"))


class Tree:
    """The levels of one replica's trees, from the leaves up, as written tables."""

    def __init__(self, records: DataFrame, scratch: Scratch, name: str, fanout: int = FANOUT):
        self.levels, self.fanout = [scratch.save(leaves(records), f"{name}0")], fanout
        most = self.levels[0].agg(F.max("at")).first()[0]
        while most:
            below, most = self.levels[-1], most // fanout
            child = F.struct("at", "start", "stop", "hash")
            node = below.groupBy("file", F.floor(F.col("at") / fanout).alias("at")).agg(F.sort_array(F.collect_list(child)).alias("c"), F.min("start").alias("start"), F.max("stop").alias("stop"))
            said = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["start"], x["stop"], x["hash"])), ",")
            self.levels.append(scratch.save(node.select("file", "at", "start", "stop", F.sha2(said, 256).alias("hash")), f"{name}{len(self.levels)}"))


def differing(one: Tree, two: Tree, scratch: Scratch) -> DataFrame:
    """file, at of the leaves that differ, and `sides` that have them (1, 2 or 3 for both). Files of different heights are compared from the lower tree's top level on."""
    top = min(len(one.levels), len(two.levels)) - 1
    suspects = None
    for level in range(top, -1, -1):
        sides = []
        for side, tree in ((1, one), (2, two)):
            nodes = tree.levels[level].select("file", "at", "start", "stop", "hash")
            if suspects is not None:
                up = F.floor(F.col("at") / one.fanout)
                nodes = nodes.withColumn("up", up).join(checked(suspects, 32), ["file", "up"], "left_semi").drop("up")
            sides.append(nodes.withColumn("side", F.lit(side)))
        both = sides[0].unionByName(sides[1])
        node = both.groupBy("file", "at").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.bit_or("side").alias("sides"))
        unlike = node.where("low <> high OR sides <> 3")
        found = scratch.save(unlike.select("file", "at", "sides"), f"unlike{level}")
        suspects = found.select("file", F.col("at").alias("up"))
    return found


def audit(one: Tree, two: Tree, scratch: Scratch) -> DataFrame:
    """file, at, key, start, stop of the first replica's record, or the second's where the first has none; status: corrupt, missing or extra in the second."""
    found = differing(one, two, scratch)
    reached = [t.levels[0].join(checked(found.where(f"sides & {k} > 0"), 48), ["file", "at"]).select("file", "at", "key", "start", "stop", "sha", F.lit(k).alias("side")) for k, t in ((1, one), (2, two))]
    reached = scratch.save(reached[0].unionByName(reached[1]), "reached")
    place = F.struct("at", "start", "stop")
    nth = F.row_number().over(Window.partitionBy("file", "key", "sha", "side").orderBy("at"))
    alone = reached.withColumn("nth", nth).groupBy("file", "key", "sha", "nth").agg(F.bit_or("side").alias("side"), F.min(place).alias("place")).where("side <> 3")
    nth = F.row_number().over(Window.partitionBy("file", "key", "side").orderBy("place"))
    side = lambda k: F.min(F.when(F.col("side") == k, F.col("place")))
    pair = alone.withColumn("nth", nth).groupBy("file", "key", "nth").agg(F.bit_or("side").alias("sides"), F.coalesce(side(1), side(2)).alias("place"))
    status = F.expr("CASE sides WHEN 3 THEN 'corrupt' WHEN 1 THEN 'missing' ELSE 'extra' END")
    return pair.select("file", "place.at", "key", "place.start", "place.stop", status.alias("status"))


def write_warc(records: DataFrame, path: str) -> None:
    """Files of whole records in leaf order, one folder per file number."""
    end = "\r\n\r\n"
    cut = records.select("file", "segment", "key", F.sha2("data", 256).alias("sha"), F.expr("substring(data, 1, char_length(data) - 4)").alias("value"))
    cut.repartition("file").sortWithinPartitions("file", "segment", "key", "sha").select("file", "value").write.partitionBy("file").option("lineSep", end).text(path)


@dataclass
class Record:
    """A record's place in its file (that of its member, if packed), header fields and body; error: what is wrong with it, else null."""

    start: int
    stop: int
    record_id: str | None
    url: str | None
    body: bytes | None
    error: str | None = None


def parse_warc(data: bytes | memoryview) -> Iterator[Record]:
    """The records of a file's bytes, plain or gzip, damaged ones too."""
    view = memoryview(data)
    if bytes(view[:2]) == b"\x1f\x8b":
        for start, stop, said, error in _members(view):
            for r in _records(said):
                yield Record(start, stop, r.record_id, r.url, r.body, r.error)
            if error:
                yield Record(start, stop, None, None, None, error)
    else:
        yield from _records(data if isinstance(data, bytes) else bytes(data))


def _members(view: memoryview) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(start, stop, unpacked bytes, error) of each gzip member; after damage, reading goes on at what looks like the next one."""
    at = 0
    while at < len(view):
        unpack, said, error, fed = zlib.decompressobj(31), [], None, at
        try:
            while not unpack.eof and fed < len(view):
                said.append(unpack.decompress(view[fed : fed + (1 << 20)]))
                fed += 1 << 20
            error = None if unpack.eof else "member is cut short"
        except zlib.error:
            error = "member can't be unpacked"
        stop = min(fed, len(view)) - len(unpack.unused_data) if unpack.eof else len(view)
        if error:
            found = bytes(view[at + 1 :]).find(b"\x1f\x8b\x08")
            stop = at + 1 + found if found >= 0 else len(view)
        yield at, stop, b"".join(said), error
        at = stop


def _records(data: bytes) -> Iterator[Record]:
    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        head = data[at : cut if cut >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size, error = fields.get("content-length", ""), None
        if not head[0].startswith("WARC/"):
            error = "no record starts here"
        elif cut < 0:
            error = "header is cut short"
        elif not (size.isascii() and size.isdigit()):
            error = "no length"
        else:
            stop = cut + 4 + int(size)
            if stop > len(data):
                error = "body is cut short"
            elif data[stop : stop + 4] != b"\r\n\r\n"[: max(0, len(data) - stop)] or data[stop + 4 : stop + 9] not in (b"", b"WARC/"):
                error = "length does not fit"
        if error:
            found = data.find(b"\r\n\r\nWARC/", at + 1)
            end, body = (len(data) if found < 0 else found + 4), None
        else:
            end, body = min(stop + 4, len(data)), data[cut + 4 : stop]
        yield Record(at, end, fields.get("warc-record-id"), fields.get("warc-target-uri"), body, error)
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, start, stop, record_id, url, body, error of all records of the WARC files under a folder. A file is read by one task, which holds its bytes; records come out in batches of bounded bytes."""
    schema = "path string, start long, stop long, record_id string, url string, body binary, error string"
    names = ["path", *(f.name for f in fields(Record))]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        for files in batches:
            for name, data in zip(files.column(0).to_pylist(), files.column(1)):
                rows, size = [], 0
                for r in parse_warc(memoryview(data.as_buffer())):
                    rows.append((name, r.start, r.stop, r.record_id, r.url, r.body, r.error))
                    size += len(r.body or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return arrow_docs(files.select("path", "content")).mapInArrow(run, schema)


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, with what an audit says of it against a damaged replica: of the records whose id's SHA-256 starts with 00 one character is changed, with 01 one is cut off, with 02 one is added, and those with 03 are missing."""
    scratch = Scratch(spark, "op7")
    pages = take(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    total = pages.agg(F.sum(F.octet_length("html").cast("long") + 300)).first()[0] or 0
    records = to_records(pages, files_for(total))
    kind = F.substring(F.sha2(F.col("key").cast("string"), 256), 1, 2)
    but = lambda n: F.expr(f"substring(data, 1, char_length(data) - {n})")
    changed = F.when(kind == "00", F.concat(but(5), F.lit("\x01\r\n\r\n"))).when(kind == "01", F.concat(but(5), F.lit("\r\n\r\n"))).when(kind == "02", F.concat(but(4), F.lit("\x01\r\n\r\n")))
    replica = records.where(~F.coalesce(kind == "03", F.lit(False))).withColumn("data", F.coalesce(changed, F.col("data")))
    one, two = Tree(records, scratch, "a"), Tree(replica, scratch, "b")
    found = scratch.save(audit(one, two, scratch), "found").where("status <> 'extra'").select("file", "at", "status")
    rows = one.levels[0].join(checked(found, 64), ["file", "at"], "left")
    return rows.select(F.col("key").alias("page_id"), "file", "start", "stop", "hash", F.coalesce("status", F.lit("intact")).alias("status"))


SQL = rf"""
WITH p AS (SELECT page_id, coalesce(page_id::VARCHAR, 'null') AS k, coalesce(url, '') AS u, coalesce(html, '') AS b FROM pages),
n AS (SELECT greatest(1, ceil(sum(strlen(b) + 300) / {FILE_BYTES}))::BIGINT AS files FROM p),
r AS (SELECT page_id, k, ('0x' || substr(sha256(k || ' ' || u), 1, 8))::BIGINT % (files * {SEGMENTS}) AS place,
      'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || k || '>' || chr(13) || chr(10) || 'WARC-Date: {NEVER}' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || regexp_replace(u, '[\r\n]', ' ', 'g') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(b) || chr(13) || chr(10) || chr(13) || chr(10)
      || b || chr(13) || chr(10) || chr(13) || chr(10) AS data FROM p, n),
s AS (SELECT page_id, k, (place // {SEGMENTS})::INT AS file, place % {SEGMENTS} AS segment, strlen(data) AS size, sha256(data) AS sha FROM r),
o AS (SELECT *, (sum(size) OVER (PARTITION BY file ORDER BY segment, page_id NULLS FIRST, sha ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM s)
SELECT page_id, file, stop - size AS start, stop, sha256((stop - size) || ':' || stop || ':' || sha) AS hash,
       CASE substr(sha256(k), 1, 2) WHEN '00' THEN 'corrupt' WHEN '01' THEN 'corrupt' WHEN '02' THEN 'corrupt' WHEN '03' THEN 'missing' ELSE 'intact' END AS status FROM o
"""
