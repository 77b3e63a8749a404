"""Line dedup by site-relative frequency.

Pages are grouped by host; a line's frequency is the share of the host's pages
that contain it, and lines above the boilerplate ratio are dropped from the
host's pages. A line is compared without the white space around it.

Defined cases: null text stays null and counts as a page of its host; a null
host is a host of its own; blank lines are never counted or dropped, and one
page counts a line once however often it repeats it; a line on fewer than
`min_pages` pages is never boilerplate, so small hosts keep theirs; repeated
rows are pages each; an empty table gives an empty result. All columns of the
input come back, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.plans.tables import weighed, within_bounds

from .common import Scratch, checked, digest, take

RATIO, MIN_PAGES = 0.05, 3


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, null where there is none; for tables that hold addresses instead of hosts."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int, scratch: Scratch) -> DataFrame:
    """pages(host, text): host, a, b (the digest of a line), of the lines that count as boilerplate. Per host at most its lines per page / ratio."""
    per = pages.select("host", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), _bare))).alias("line")).where("line <> ''")
    a, b = digest(F.col("line"))
    seen = per.groupBy("host", a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    total = scratch.save(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    seen = scratch.save(seen, "seen")
    total = total.withColumnRenamed("host", "h")
    common = seen.join(checked(total, 64), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.col("pages") * ratio)
    return scratch.save(common.select("host", "a", "b"), "common")


def dedup_lines(df: DataFrame, host: str, text: str, scratch: Scratch, ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_emptied: bool = False) -> DataFrame:
    """df with the text rewritten and n_lines, n_dropped added. keep_emptied: a page of boilerplate alone stays as it is.

    Boilerplate is some lines a host, whatever the number of pages. While its
    digests, gathered by host, are within the broadcast bounds, pages drop their
    lines where they are, and no text moves. With more hosts than that, the
    marked line numbers of a page go back to it by a digest of the row, so equal
    pages share one decision.
    """
    names = df.columns
    own = [f"c{i}" for i in range(len(names))]
    low = [n.lower() for n in names]
    at = lambda n: f"c{names.index(n) if n in names else low.index(n.lower())}"
    h, t = F.col(at(host)), F.col(at(text))
    flat = df.toDF(*own)
    common = boilerplate(flat.select(h.alias("host"), t.alias("text")), ratio, min_pages, scratch)
    by_host = scratch.save(common.groupBy(F.col("host").alias("of")).agg(F.collect_list("a").alias("firsts"), F.collect_list(F.struct("a", "b")).alias("marks")), "byhost")
    if within_bounds(by_host, 64 + 24 * F.size("marks")):
        marked = flat.join(F.broadcast(by_host), h.eqNullSafe(F.col("of")), "left")
        # the second half of a digest is made only for lines whose first is among the host's
        a, b = (lambda line, k=k: digest(_bare(line))[k] for k in (0, 1))
        dropped = lambda line: F.array_contains("firsts", a(line)) & (_bare(line) != "") & F.array_contains("marks", F.struct(a(line).alias("a"), b(line).alias("b")))
        left = F.when(F.col("marks").isNotNull(), F.filter(lines_of(t), lambda line: ~dropped(line))).otherwise(lines_of(t))
    else:
        marked = _numbered(flat, h, t, common, scratch)
        left = F.when(F.col("gone").isNotNull(), F.filter(lines_of(t), lambda _, i: ~F.array_contains("gone", i))).otherwise(lines_of(t))
    # as a variable of a lambda, what is left is worked out once for both
    found = F.transform(F.array(left), lambda x: F.struct(F.size(x).alias("size"), F.array_join(x, "\n").alias("text")))[0]
    out = marked.withColumn("left", found).withColumn("n", F.coalesce(F.size(lines_of(t)) - F.col("left.size"), F.lit(0)))
    out = out.withColumn("rest", F.when(F.col("n") > 0, F.col("left.text")).otherwise(t))
    if keep_emptied:
        empty = (F.col("n") > 0) & (_bare(F.regexp_replace("rest", "\n", "")) == "")
        out = out.withColumn("emptied", empty).withColumn("n", F.when(F.col("emptied"), 0).otherwise(F.col("n"))).withColumn("rest", F.when(F.col("emptied"), t).otherwise(F.col("rest")))
    cols = [(F.col("rest") if c == at(text) else F.col(c)).alias(n) for c, n in zip(own, names)]
    return out.select(*cols, F.coalesce(F.size(lines_of(t)), F.lit(0)).alias("n_lines"), F.col("n").alias("n_dropped"))


def _numbered(flat: DataFrame, h: Column, t: Column, common: DataFrame, scratch: Scratch) -> DataFrame:
    """flat with gone: the numbers of the lines that are boilerplate, null without any. Only digests of lines are joined with the boilerplate."""
    salt = digest(*[F.col(c) for c, kind in flat.dtypes if "map<" not in kind and kind != "variant"])
    lines = flat.select(h.alias("h"), *[c.alias(n) for c, n in zip(salt, ("p", "q"))], F.posexplode(F.transform(lines_of(t), _bare)).alias("i", "line")).where("line <> ''")
    a, b = digest(F.col("line"))
    lines = lines.select("h", "p", "q", "i", a.alias("la"), b.alias("lb"))
    hit = lines.join(checked(common, 48), F.col("h").eqNullSafe(F.col("host")) & (F.col("la") == F.col("a")) & (F.col("lb") == F.col("b")))
    drops = scratch.save(hit.groupBy("p", "q").agg(F.collect_set("i").alias("gone")), "drops")
    return flat.withColumn("p", salt[0]).withColumn("q", salt[1]).join(weighed(drops, 48 + 8 * F.size("gone")), ["p", "q"], "left")


def dedup_pages(pages: DataFrame, scratch: Scratch, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages(url, html, ...) without its hosts' boilerplate lines, n_lines and n_dropped added; a URL without a host belongs to the null host."""
    found = pages.columns
    hosted = pages.toDF(*[f"p{i}" for i in range(len(found))])
    low = [n.lower() for n in found]
    at = lambda n: f"p{found.index(n) if n in found else low.index(n)}"
    out = dedup_lines(hosted.withColumn("page_host", host_of(F.col(at("url")))), "page_host", at("html"), scratch, ratio, min_pages)
    return out.drop("page_host").toDF(*found, "n_lines", "n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = take(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")
    return dedup_lines(docs, "source", "text", Scratch(spark, "op3"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM d),
t AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
c AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM t WHERE line <> '' GROUP BY ALL),
h AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
b AS (SELECT c.source, line FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n >= {MIN_PAGES} AND n > pages * {RATIO}),
m AS (SELECT t.*, b.line IS NOT NULL AS gone FROM t LEFT JOIN b ON t.source IS NOT DISTINCT FROM b.source AND t.line = b.line),
r AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept, count(*) FILTER (WHERE gone)::INT AS n_dropped FROM m GROUP BY doc_id)
SELECT d.doc_id, d.source, CASE WHEN n_dropped > 0 THEN kept ELSE text END AS text, coalesce(len(ls), 0)::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped
FROM d LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id
"""
