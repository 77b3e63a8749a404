"""Position reports from CSV files of several layouts and from JSON route files.

CSV files are read as text and coerced, so that a bad value is null and never an
error. Header names are matched without case, surrounding blanks or '#', and by
the aliases of the public US and Danish layouts, in any order of columns.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators.clean import iso, valid_position

#: The column names of the public layouts.
ALIASES = {
    "mmsi": ("mmsi",),
    "ts": ("basedatetime", "base_date_time", "timestamp"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "sog": ("sog",),
    "cog": ("cog",),
    "vessel_type": ("vesseltype", "vessel_type", "ship type"),
}


def header_name(raw: str) -> str:
    return re.sub(r"\s+", " ", raw.replace("#", " ")).strip().lower()


def time_of(raw: Column, day_first: bool) -> Column:
    """Epoch seconds of a naive timestamp; an offset is dropped, not converted, and a fraction cut off."""
    bare = F.regexp_replace(F.trim(raw), r"(:\d\d)(\.\d+)?(Z|[+-]\d\d:?\d\d)?$", "$1")
    forms = ["dd/MM/yyyy HH:mm:ss"] if day_first else ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
    return F.coalesce(*[F.unix_seconds(F.try_to_timestamp(bare, F.lit(f))) for f in forms])


def canonical(raw: DataFrame, day_first: bool) -> DataFrame:
    """mmsi long, t long, lat, lon, sog, cog double, vessel_type string, from text columns under any of the layouts' names. Absent columns are null; without mmsi, ts, lat or lon it raises."""
    have = {header_name(c): i for i, c in reversed(list(enumerate(raw.columns)))}
    flat = raw.toDF(*[f"_{i}" for i in range(len(raw.columns))])
    found = {k: next((F.col(f"_{have[n]}") for n in names if n in have), None) for k, names in ALIASES.items()}
    if missing := [k for k in ("mmsi", "ts", "lat", "lon") if found[k] is None]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(raw.columns)}")
    number = lambda k: (F.lit(None) if found[k] is None else F.trim(found[k]).try_cast("double")).cast("double").alias(k)
    kind = F.lit(None).cast("string") if found["vessel_type"] is None else found["vessel_type"]
    return flat.select(F.trim(found["mmsi"]).try_cast("long").alias("mmsi"), time_of(found["ts"], day_first).alias("t"), number("lat"), number("lon"), number("sog"), number("cog"), kind.alias("vessel_type"))


def read_csv(spark: SparkSession, path: str | list[str], day_first: bool = False) -> DataFrame:
    """Plain, .gz and .zst files of one layout; folders and globs as Spark takes them."""
    return canonical(spark.read.option("header", True).option("inferSchema", False).csv(path), day_first)


class _Utf8(io.RawIOBase):
    """A stream's bytes, with what isn't UTF-8 replaced."""

    def __init__(self, raw):
        self.raw, self.decoder, self.held = raw, codecs.getincrementaldecoder("utf-8")("replace"), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            data = self.raw.read(1 << 20)
            self.held = self.decoder.decode(data, not data).encode()
            if not data:
                break
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


def read_zip(spark: SparkSession, path: str, day_first: bool = False) -> DataFrame:
    """The first .csv member of each .zip file, bytes that aren't UTF-8 replaced; one task reads one file, whose packed bytes it holds, a batch at a time."""
    names = list(ALIASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                    if member is None:
                        raise ValueError("a zip file holds no .csv member")
                    columns = pa.csv.open_csv(_Utf8(z.open(member))).schema.names
                    text = pa.csv.ConvertOptions(column_types={c: pa.string() for c in columns}, strings_can_be_null=True)
                    for rows in pa.csv.open_csv(_Utf8(z.open(member)), convert_options=text):
                        have = {header_name(c): i for i, c in reversed(list(enumerate(rows.schema.names)))}
                        at = [next((have[n] for n in ALIASES[k] if n in have), None) for k in names]
                        yield pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, pa.string()) if i is None else rows.column(i) for i in at], names=[ALIASES[k][0] for k in names])

    files = spark.read.format("binaryFile").load(path).select("content")
    return canonical(files.mapInArrow(run, ", ".join(f"`{ALIASES[k][0]}` string" for k in names)), day_first)


def read_routes(spark: SparkSession, path: str, least: int = 1, null_island: float | None = None) -> DataFrame:
    """mmsi string, i, t, lat, lon, speed, course from JSON files {mmsi: [[timestamp, lat, lon, speed, course], ...]}, also .gz.

    A point with fewer than three items, or a timestamp or coordinate that can't
    be read, is left out, with null_island also one whose position isn't valid;
    missing speeds and courses are 0; tracks of fewer than `least` points go. i is the place by time, then by place in the file.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<array<string>>>").alias("m"))
    points = raw.select(F.explode("m").alias("mmsi", "points")).select("mmsi", F.posexplode("points").alias("pos", "p"))
    item = lambda n: F.get("p", F.lit(n))
    number = lambda n: F.regexp_replace(item(n), '"', "").try_cast("double")
    points = points.where(F.size("p") >= 3).select("mmsi", "pos", time_of(item(0), False).alias("t"), number(1).alias("lat"), number(2).alias("lon"), F.coalesce(number(3), F.lit(0.0)).alias("speed"), F.coalesce(number(4), F.lit(0.0)).alias("course"))
    points = points.dropna(subset=["t", "lat", "lon"])
    if null_island is not None:
        points = points.where(valid_position(F.col("lat"), F.col("lon"), null_island))
    track = Window.partitionBy("mmsi")
    points = points.withColumn("n", F.count(F.lit(1)).over(track)).where(F.col("n") >= least)
    return points.withColumn("i", F.row_number().over(track.orderBy("t", "pos")) - 1).select("mmsi", "i", "t", "lat", "lon", "speed", "course")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Compressed JSON lines."""
    df.write.option("compression", "gzip").json(path)


def write_routes(fixes: DataFrame, path: str, n_files: int) -> None:
    """Route files of fixes(mmsi, i, t, lat, lon, sog): n_files compressed JSON texts, each in a folder of its own, a vessel whole in one; readers take a file as one row."""
    point = F.array(F.concat(F.lit('"'), iso(F.col("t")), F.lit('"')), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("lat", "lon", "sog")], F.lit("null"))
    said = F.concat(F.lit("["), F.array_join(point, ","), F.lit("]"))
    tracks = fixes.groupBy("mmsi").agg(F.sort_array(F.collect_list(F.struct("t", "i", said.alias("p")))).alias("ps"))
    entry = F.concat(F.lit('"'), F.col("mmsi").cast("string"), F.lit('": ['), F.array_join("ps.p", ", "), F.lit("]"))
    files = tracks.groupBy(F.pmod(F.xxhash64("mmsi"), F.lit(n_files)).alias("file")).agg(F.array_join(F.collect_list(entry), ",\n").alias("entries"))
    files.select("file", F.concat(F.lit("{"), "entries", F.lit("}")).alias("value")).write.partitionBy("file").option("compression", "gzip").text(path)
