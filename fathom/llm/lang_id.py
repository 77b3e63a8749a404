"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text is the bytes of its lower-cased UTF-8 form, with ASCII characters other
than letters as blanks; its subwords are the runs of 2, 3 and 4 bytes, hashed
into a table of embeddings. Their mean feeds a linear softmax. Both layers learn
by stochastic gradient descent in numpy on a bounded sample; a temperature and a
rejection threshold are then set on calibration rows that were not fitted.

Once trained, embeddings and softmax are folded into one table of class scores
per subword, so prediction is a sum of table rows over the whole text.

Learned are only rows with a known language and crc32(doc_id as text) mod 5 not
0; of those, mod 5 = 1 calibrates. Bounds: `per_lang` rows of each language, those
of the least hash of doc_id and text, and of each a window of at most `window`
characters, at a place given by the row's hash; every language is learned, and the
same table gives the same model.

Defined cases: a null text or one without letters is `und` with score 0 and is
rejected; with nothing to learn from every text is `und`; a null doc_id is
neither learned nor held out; ties go to the language that sorts first; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_docs, digest, release, take


@dataclass(frozen=True)
class Config:
    """lost: share of rightly labelled calibration rows that the threshold may reject; it never exceeds `ceiling`."""

    per_lang: int = 1000
    window: int = 20_000
    buckets: int = 1 << 16
    dims: int = 16
    epochs: int = 4
    rate: float = 0.2
    lost: float = 0.001
    ceiling: float = 0.5


BLANK = bytes(b if b >= 128 or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))
LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (LETTER.search(text) is not None or any(map(str.isalpha, text)))


def subwords(data: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """For each size n, the bucket of the run that starts at each byte; the last n - 1 are missing."""
    shift = np.uint32(33 - buckets.bit_length())
    code, out = data.astype(np.uint32), []
    for n in (2, 3, 4):
        code = code[: len(data) - n + 1] | (data[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1)))
        out.append((n, ((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift))
    return out


def clean(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(BLANK) + b"  "


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x langs
    bias: np.ndarray
    threshold: float
    buckets: int

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Class index (-1: none) and calibrated probability of each text."""
        best, top = np.full(len(texts), -1), np.zeros(len(texts))
        able = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        i = 0
        while i < len(able):
            data, own, size = [], [], 0
            while i < len(able) and (not own or size < 1 << 19):
                data.append(clean(texts[able[i]]))
                own.append(able[i])
                size += len(data[-1])
                i += 1
            ends = np.cumsum([len(d) for d in data])
            starts = ends - [len(d) for d in data]
            flat = np.frombuffer(b"".join(data) + b"   ", np.uint8)
            total, count = np.zeros((len(own), len(self.langs))), np.zeros(len(own))
            for n, ids in subwords(flat, self.buckets):
                # runs across two texts are summed apart, and left out
                cut = np.stack([starts, ends - n + 1], 1).ravel()
                for c in range(len(self.langs)):
                    total[:, c] += np.add.reduceat(self.table[c][ids], cut, dtype=np.float64)[::2]
                count += ends - starts - n + 1
            logits = total / count[:, None] + self.bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            best[own], top[own] = p.argmax(1), p.max(1)
        return best, top


def _bag(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray] | None:
    ids = np.concatenate([x for _, x in subwords(np.frombuffer(clean(text), np.uint8), buckets)])
    found, n = np.unique(ids, return_counts=True)
    return found, (n / n.sum()).astype(np.float32)


def layers(fit: list[tuple[tuple[np.ndarray, np.ndarray], int]], langs: int, config: Config, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias, learned from bags of subwords and their classes."""
    emb = rng.normal(0, 1, (config.buckets, config.dims)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (config.dims, langs)).astype(np.float32), np.zeros(langs, np.float32)
    for epoch in range(config.epochs):
        rate = np.float32(config.rate * (1 - epoch / config.epochs))
        for i in rng.permutation(len(fit)):
            (ids, weight), y = fit[i]
            mean = weight @ emb[ids]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            # a step moves the mean by rate times its gradient, however many subwords share it
            emb[ids] -= (rate / (weight @ weight)) * weight[:, None] * back[None, :]
    return emb, out, bias


def train(rows: list[tuple[int, str, str]], config: Config = Config()) -> Model:
    """rows: (doc_id, text, lang). Whole rows, and a few words of each so that short texts are known too."""
    rng = np.random.Generator(np.random.PCG64(8))
    rows = sorted(r for r in rows if has_letter(r[1]))
    langs = sorted({r[2] for r in rows})
    if not langs:
        return Model([], np.zeros((0, config.buckets), np.float32), np.zeros(0), 1.0, config.buckets)
    fit, held = [], []
    for doc_id, text, lang in rows:
        holds = zlib.crc32(str(doc_id).encode()) % 5 == 1
        (held if holds else fit).append((_bag(text, config.buckets), langs.index(lang)))
        words = text.split()
        n = int(rng.integers(1, 13))
        at = int(rng.integers(0, max(1, len(words) - n)))
        if not holds and has_letter(part := " ".join(words[at : at + n])):
            fit.append((_bag(part, config.buckets), langs.index(lang)))
    emb, out, bias = layers(fit, len(langs), config, rng)
    table = (emb @ out).T.copy()
    held = held or fit
    logits = np.array([table[:, ids] @ weight + bias for (ids, weight), _ in held])
    y = np.array([y for _, y in held])

    def loss(t):
        z = logits * t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    heat = min(2.0 ** np.arange(-6, 3, 0.25), key=loss)
    z = logits * heat
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.max(1)[p.argmax(1) == y]
    threshold = min(config.ceiling, float(np.quantile(right, config.lost))) if len(right) else config.ceiling
    return Model(langs, (table * heat).astype(np.float32), bias * heat, threshold, config.buckets)


def _learnable(df: DataFrame) -> DataFrame:
    d = take(df, "doc_id", "text", "lang")
    return d.where("lang IS NOT NULL AND text IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0")


def sample(df: DataFrame, config: Config = Config()) -> list[tuple[int, str, str]]:
    """At most per_lang rows of each language, those of the least hash; equal rows count once. Whatever the order of the rows, the same ones are chosen."""
    rows = _learnable(df)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return []
    # half as many again as are wanted, so that ranking them by hash looks at few
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, int(min(1, (1.5 * config.per_lang + 100) / r.n) * (1 << 30)))])
    a, b = digest("doc_id", "text")
    chosen = rows.withColumns({"a": a, "b": b}).where(F.shiftrightunsigned("a", 34) < share[F.col("lang")])
    at = F.pmod(F.col("b"), F.greatest(F.char_length("text") - config.window, F.lit(0)) + 1) + 1
    chosen = chosen.select("lang", "a", "b", "doc_id", F.substring("text", at.cast("int"), F.lit(config.window)).alias("text"))
    chosen = chosen.groupBy("lang", "a", "b").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    # in order of the unsigned hash, of which the filter took the least
    ranked = chosen.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("a", 1), "a", "b")))
    found = ranked.where(F.col("place") <= config.per_lang).select("r.doc_id", "r.text", "lang").toArrow()
    return list(zip(*[found.column(i).to_pylist() for i in range(3)]))


PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(df: DataFrame, model: Model) -> DataFrame:
    """One row per row of df (doc_id, text). The model has a fixed size, langs x buckets floats."""
    docs = arrow_docs(take(df, "doc_id", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(at, 1000)
                best, top = model.scores(part.column(1).to_pylist())
                names = [model.langs[i] if i >= 0 else "und" for i in best]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(top), pa.array((best < 0) | (top < model.threshold))], names=["doc_id", "lang_pred", "score", "rejected"])
            release()

    return docs.mapInArrow(run, PREDICTED)


def keep_known(df: DataFrame, model: Model) -> DataFrame:
    """df's rows whose language isn't rejected, in one pass over the texts; df has a column text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    at, df = names.index("text"), df.toDF(*[f"_{i}" for i in range(len(names))])  # names may differ by case alone

    def run(batches):
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(i, 1000)
                best, top = shared.value.scores(part.column(at).to_pylist())
                yield part.filter(pa.array((best >= 0) & (top >= shared.value.threshold)))
            release()

    return arrow_docs(df).mapInArrow(run, df.schema).toDF(*names)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(sample(docs)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
