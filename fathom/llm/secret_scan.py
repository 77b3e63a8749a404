r"""Secret scans with corpus-wide ownership frequency.

Regular expressions give candidate spans; positions come from the lengths of
the matches and of the gaps between them, so nothing leaves the JVM. The digest
of every candidate's value is counted over the whole corpus by distinct
repositories and owners: a value that several owners hold is a copied example,
one that a single owner holds is taken for live.

Fixed values: the three base kinds of the contract (assign, access, hex). Added
kinds: bearer, pat (prefixed access tokens) and pem (private key headers).

Defined cases: null text is empty; null repository or owner counts as one value
of its own; a document without candidates has zero counts and the digest of
the empty string; repeated rows are rows each, and count as one repository and
owner; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, digest, take

#: Kind, pattern, group that holds the value, least length of that group.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
    ("pat", r"(?:gh[pousr]_|glpat-|xox[abprs]-)[A-Za-z0-9_-]+", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
KINDS = BASE + ADDED
#: From so many distinct owners on, a value is a copied example.
OWNERS = 2


def _found(i: int) -> Column:
    """Spans of kind i from the arrays m (matches), g (gaps) and v (values); code points, end exclusive."""
    kind, _, _, least = KINDS[i]
    spans = f"""aggregate(zip_with(m{i}, slice(g{i}, 1, size(m{i})), (m, g) -> named_struct('m', char_length(m), 'g', char_length(g))),
        named_struct('at', 0, 's', cast(array() AS array<struct<start: int, end: int>>)),
        (acc, x) -> named_struct('at', acc.at + x.g + x.m, 's', concat(acc.s, array(named_struct('start', acc.at + x.g, 'end', acc.at + x.g + x.m)))), acc -> acc.s)"""
    return F.expr(f"filter(zip_with({spans}, v{i}, (s, v) -> named_struct('start', s.start, 'rank', {i}, 'end', s.end, 'kind', '{kind}', 'value', v)), s -> char_length(s.value) >= {least})")


def spans(df: DataFrame, text: str) -> DataFrame:
    """df with `spans`: array of (start, rank, end, kind, value) by start, then kind. Texts without any match skip the position work."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = []
    for i, (_, pattern, group, _) in enumerate(KINDS):
        p = F.lit(pattern)
        df = df.withColumn(f"m{i}", F.regexp_extract_all(t, p, F.lit(0)))
        df = df.withColumn(f"v{i}", F.when(F.size(f"m{i}") > 0, F.regexp_extract_all(t, p, F.lit(group))).otherwise(F.col(f"m{i}")) if group else F.col(f"m{i}"))
        df = df.withColumn(f"g{i}", F.when(F.size(f"m{i}") > 0, F.split(t, pattern, -1)).otherwise(F.col(f"m{i}")))
        found.append(_found(i))
    df = df.withColumn("spans", F.sort_array(F.concat(*found)))
    return df.drop(*[f"{c}{i}" for i in range(len(KINDS)) for c in "mvg"])


def ownership(found: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b (digest of a value), repos, owners, from found(repo, owner, spans). Copies within one repository are merged before they are shuffled by value."""
    each = found.where(F.size("spans") > 0).select("repo", "owner", F.explode("spans").alias("s"))
    a, b = digest(F.col("s.value"))
    once = each.select(a.alias("a"), b.alias("b"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner")).distinct()
    by_owner = once.groupBy("a", "b", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return scratch.save(by_owner.groupBy("a", "b").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners")), "values")


def scan(df: DataFrame, row_id: str, text: str, repo: str, owner: str, scratch: Scratch) -> DataFrame:
    """One row per row of df: its id, spans, and how many of them hold live-looking and copied values."""
    d = take(df, row_id, text, repo, owner).toDF("id", "text", "repo", "owner")
    rows = scratch.save(spans(d, "text").select("id", "repo", "owner", "spans"), "spans")
    values = ownership(rows, scratch)
    p, q = digest(F.col("id"), F.col("repo"), F.col("owner"), F.to_json("spans"))
    with_any = rows.where(F.size("spans") > 0).select(p.alias("p"), q.alias("q"), F.explode("spans").alias("s"))
    a, b = digest(F.col("s.value"))
    judged = with_any.select("p", "q", "s.start", "s.rank", a.alias("a"), b.alias("b")).join(values, ["a", "b"])
    copied = F.col("owners") >= OWNERS
    # repeated rows share p and q and hold the same spans
    ruled = judged.groupBy("p", "q", "start", "rank").agg(F.max(copied).alias("copied")).groupBy("p", "q").agg(F.count_if(~F.col("copied")).alias("n_live"), F.count_if("copied").alias("n_copied"))
    ruled = scratch.save(ruled, "ruled")
    out = rows.withColumn("p", p).withColumn("q", q).join(ruled, ["p", "q"], "left")
    return out.select("id", "spans", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner; the source's part in one language is its repository."""
    docs = take(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source", "lang")
    docs = docs.withColumn("repo", F.concat_ws("/", "source", "lang"))
    out = scan(docs, "doc_id", "text", "repo", "source", Scratch(spark, "op6"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.rank = {i})) AS bigint) AS n_{kind}") for i, (kind, *_) in enumerate(BASE)]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_copied")


def _sql() -> str:
    found = " UNION ALL ".join(
        f"""SELECT doc_id, source, repo, {i} AS rank, '{kind}' AS kind, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS k
        FROM (SELECT doc_id, source, repo, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d) WHERE len(m) > 0"""
        for i, (kind, raw, group, _) in enumerate(KINDS) for p in [raw.replace("'", "''")])
    least = " ".join(f"WHEN {i} THEN {n}" for i, (*_, n) in enumerate(KINDS))
    return f"""
WITH d AS (SELECT doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents), f AS ({found}),
p AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY k)::BIGINT AS stop FROM f),
s AS (SELECT *, kind || ':' || (stop - length(m)) || ':' || stop AS said FROM p WHERE length(v) >= CASE rank {least} END),
o AS (SELECT v, count(DISTINCT source) AS owners FROM s GROUP BY v),
r AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
      string_agg(said, ',' ORDER BY stop - length(m), rank) FILTER (WHERE rank < {len(BASE)}) AS base, string_agg(said, ',' ORDER BY stop - length(m), rank) AS spans,
      count(*) FILTER (WHERE owners < {OWNERS}) AS n_live, count(*) FILTER (WHERE owners >= {OWNERS}) AS n_copied FROM s JOIN o USING (v) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN r USING (doc_id)
"""


SQL = _sql()
