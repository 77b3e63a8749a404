r"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are lower-cased words `\w+`, in scripts without spaces (Chinese,
Japanese, Thai, Lao, Burmese, Khmer) single characters; the distance is the edit
distance of word sequences. The CGK random walk reads a window from its start; at step j
it writes the word under it and moves on if a random bit of (j, word) is set, so
that windows a few edits apart fall into step again and differ in few of the
written places. Each repetition has its own walk and its own sampled places;
windows that agree with an item in all of them are candidates, and a candidate
counts if the item's edit distance to some stretch of the text there is at most
`edits` of its length.

A walk never depends on what lies behind its window's end before it gets there,
so one walk from a start serves windows of all sizes; items are put into size
classes, each with its own places. Windows that by the q-gram lemma can't match
(an item of n words within d edits keeps n - 1 - 2d of its word pairs) are not
embedded; this loses no match.

Walks fall apart with length, most under deletions alone. So `build` measures for
each size class how many windows at the most edits of each kind its repetitions
find; from the first class on that misses the target recall, items are searched
for by counting instead: every stretch of an item's length that holds as many of
its word pairs as the q-gram lemma asks for is a candidate, which loses no match.

The benchmark is read in blocks of bounded words and bytes, each compared with
all texts, so it need not fit anywhere whole; a block's index is what is broadcast.
The walks' coins are hashes of step and word and made where they are tossed, for
the words at hand. An item is never split, so one that is larger than a block is a
block of its own.

Defined cases: a null or wordless text matches nothing; items of fewer than
`least` words are searched for without edits, null or wordless ones not at all;
repeated items and rows are items and rows each; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_docs, release, take
from .near_dedup import mix

#: Letters and marks of scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e80-\u0ecf\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u3005-\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD, ASCII = re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]"), re.compile(r"\w+")
#: Most pairs of a place and an item that are counted at once, as far as one item's length allows.
HITS = 1 << 21


def spans_of(text: str | None) -> Iterator[re.Match]:
    text = (text or "").lower()
    return (ASCII if text.isascii() else WORD).finditer(text)


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (ASCII if text.isascii() else WORD).findall(text)


@dataclass(frozen=True)
class Config:
    """edits: most edits, as a share of the item's words. agree: share of places in which a window that many edits away agrees (measured: tests). places: sampled places of a repetition. recall: target of the candidate search. least: words of the shortest item that may be edited. walked: words of the longest item that walks are tried for. block_words, block_bytes: of benchmark items and of their index, held at once."""

    edits: float = 0.2
    agree: float = 0.5
    places: int = 3
    recall: float = 0.99
    least: int = 5
    walked: int = 64
    block_words: int = 200_000
    block_bytes: int = 16 << 20

    @property
    def repetitions(self) -> int:
        return int(np.ceil(np.log(1 - self.recall) / np.log(1 - self.agree**self.places)))

    def most(self, n):
        """Edits allowed for items of n words."""
        d = np.where(np.asarray(n) < self.least, 0, np.floor(self.edits * np.asarray(n) + 1e-9)).astype(int)
        return d if isinstance(n, np.ndarray) else int(d)


def walk(words: np.ndarray, start: np.ndarray, stop: np.ndarray, steps: np.ndarray, bits: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """(repetitions, windows, places): the words written at the steps (repetitions, places; ascending) by each repetition's walk over words from each start; past stop it writes -1. bits: of coin_bits; own: which of its words each of words is, if not the one of that number."""
    own = words if own is None else own
    out = np.full((len(steps), len(start), steps.shape[1]), -1, np.int64)
    at, last, r = np.tile(start, (len(steps), 1)), len(words) - 1, np.arange(len(steps))[:, None]
    for j in range(int(steps.max()) + 1):
        here, over = np.minimum(at, last), at >= stop
        word = words[here]
        for k, place in zip(*np.nonzero(steps == j)):
            out[k, :, place] = np.where(over[k], -1, word[k])
        coin = (bits[j // 64, r, own[here]] >> np.uint64(j % 64)) & np.uint64(1)
        at += np.where(over, 0, coin.astype(np.int64))
    return out


def coin_bits(words: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """64 steps to a number: (lanes, repetitions, words)."""
    lane, r = np.arange(int(steps.max()) // 64 + 1, dtype=np.uint64), np.arange(len(steps), dtype=np.uint64)
    return mix(mix((lane[:, None] << np.uint64(32)) + r[None, :])[:, :, None] + words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def keys_of(written: np.ndarray) -> np.ndarray:
    key = np.zeros(written.shape[:-1], np.uint64)
    for k in range(written.shape[-1]):
        key = mix(key + written[..., k].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1))
    return key


@dataclass
class SizeClass:
    """Items of similar length: their places, and per repetition the sorted keys and whose they are."""

    high: int
    need: int
    steps: np.ndarray
    keys: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    config: Config
    vocabulary: dict[str, int]
    pairs: np.ndarray  # sorted codes of the items' word pairs
    owners: np.ndarray  # per pair, the bits of the classes that have it
    ids: list[int]
    words: list[np.ndarray]
    classes: list[SizeClass]
    counted: np.ndarray  # items searched for by counting
    first: np.ndarray  # per pair, where its counted items start in having; one more for the end
    having: np.ndarray


def places_of(low: int, config: Config) -> np.ndarray:
    """(repetitions, places): the steps at which the walks of the class of items from low words on are sampled."""
    rng = np.random.Generator(np.random.PCG64(low))
    return np.sort([rng.choice(max(config.places, int(1.6 * low)), config.places, replace=False) for _ in range(config.repetitions)])


@lru_cache(256)
def found_share(low: int, config: Config, trials: int = 400) -> float:
    """Share of windows at the most edits that the class from low words on finds, for its length and kind of edits (0 changed, 1 deleted, 2 inserted, 3 mixed words) with the least."""
    steps, rng, least = places_of(low, config), np.random.default_rng(low), 1.0
    for n in sorted({low, low * 5 // 4}):
        d = config.most(n)
        for kind in range(4):
            parts, at, new = [], [], 1
            for _ in range(trials):
                item = np.arange(new, new + n)
                kinds = np.full(n, -1)
                kinds[rng.choice(n, d, replace=False)] = kind if kind < 3 else rng.integers(0, 3, d)
                text = np.stack([np.where(kinds == 0, item + n, item), item + n], 1)[np.stack([kinds != 1, kinds == 2], 1)]
                parts += [item, text, np.arange(new + 2 * n, new + 4 * n)]
                at.append(len(text))
                new += 4 * n
            flat, size = np.concatenate(parts), 3 * n + np.array(at)
            item = np.cumsum(size) - size
            start = ((item + n)[:, None] + np.arange(d + 1)).ravel()
            bits = coin_bits(np.arange(new), steps)
            ours = keys_of(walk(flat, item, item + n, steps, bits))
            theirs = keys_of(walk(flat, start, np.repeat(item + size, d + 1), steps, bits))
            least = min(least, (theirs.reshape(len(steps), trials, d + 1) == ours[:, :, None]).any(axis=(0, 2)).mean())
            if least < config.recall:
                return least
    return least


def build(items: list[tuple[int, list[str]]], config: Config) -> Index:
    vocabulary: dict[str, int] = {}
    ids, words = [i for i, _ in items], [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
    wide = len(vocabulary) + 1
    codes = [w[:-1] * wide + w[1:] for w in words]
    pairs = np.unique(np.concatenate([np.empty(0, np.int64), *codes]))
    none = np.empty(0, np.int64)
    index = Index(config, vocabulary, pairs, np.zeros(len(pairs), np.uint64), ids, words, [], none, none, none)
    order = sorted((i for i in range(len(words)) if len(words[i]) >= config.least), key=lambda i: len(words[i]))
    while order and (low := len(words[order[0]])) <= config.walked and found_share(low, config) >= config.recall:
        own = [i for i in order if len(words[i]) <= low * 5 // 4]
        order = order[len(own) :]
        n = np.array([len(words[i]) for i in own])
        held = np.searchsorted(pairs, np.concatenate([codes[i] for i in own]))
        index.owners[held] |= np.uint64(1 << len(index.classes))
        flat, stops = np.concatenate([words[i] for i in own]), np.cumsum(n)
        steps = places_of(low, config)
        present, local = np.unique(flat, return_inverse=True)
        keys = keys_of(walk(flat, stops - n, stops, steps, coin_bits(present, steps), local))
        by = np.argsort(keys, axis=1, kind="stable")
        index.classes.append(SizeClass(int(n.max()), int((n - 1 - 2 * config.most(n)).min()), steps, np.take_along_axis(keys, by, 1), np.array(own, np.int32)[by]))
    index.counted = np.array(sorted([*order, *(i for i in range(len(words)) if len(words[i]) < config.least)]), np.int64)
    own = [np.unique(np.searchsorted(pairs, codes[i])) for i in index.counted]
    pair = np.concatenate([none, *own])
    by = np.argsort(pair, kind="stable")
    index.having = np.repeat(index.counted, [len(x) for x in own])[by]
    index.first = np.searchsorted(pair[by], np.arange(len(pairs) + 1))
    return index


def within(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to a stretch of the text, and the first such stretch that ends earliest: (distance, start, stop)."""

    def row(item, text, free):
        at = np.arange(len(text) + 1)
        now = np.zeros(len(text) + 1, np.int64) if free else at.copy()
        for i, w in enumerate(item):
            new = np.empty_like(now)
            new[0] = i + 1
            new[1:] = np.minimum(now[:-1] + (text != w), now[1:] + 1)
            now = np.minimum.accumulate(new - at) + at
        return now

    ends = row(item, text, True)
    stop = int(ends.argmin())
    back = row(item[::-1], text[:stop][::-1], False)
    return int(ends[stop]), stop - int(back.argmin()), stop


def counted(flat: np.ndarray, offsets: np.ndarray, known: np.ndarray, pair: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Like candidates, of the items searched for by counting. known: places in flat that hold a word pair of an item; pair: which."""
    if not len(index.counted):
        return
    n = np.array([len(w) for w in index.words])
    d = index.config.most(n)
    need = n - 1 - 2 * d
    for item in index.counted[need[index.counted] < 1]:  # nothing to count: a single word, or so many edits that no pair need be left
        if n[item] == 1 and d[item] == 0:
            start = np.flatnonzero(flat == index.words[item][0])
        else:
            start = np.concatenate([np.arange(a, b, n[item]) for a, b in zip(offsets[:-1], offsets[1:])])
        yield start, np.full(len(start), item)
    many = index.first[pair + 1] - index.first[pair]
    known, pair, many = known[many > 0], pair[many > 0], many[many > 0]
    total, reach, i = np.cumsum(many), int((n + d)[index.counted].max()), 0
    while i < len(known):
        j = max(i + 1, int(np.searchsorted(total, total[i] - many[i] + HITS, side="right")))
        k = int(np.searchsorted(known, known[j - 1] + reach))
        m = many[i:k]
        place = np.repeat(known[i:k], m)
        item = index.having[np.repeat(index.first[pair[i:k]] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        by = np.argsort(item, kind="stable")
        place, item = place[by], item[by]
        last = np.arange(len(item)) + np.maximum(need[item], 1) - 1
        full = np.flatnonzero((last < len(item)) & (need[item] > 0))
        last = last[full]
        text = np.searchsorted(offsets, place[full], side="right") - 1
        full = full[(item[last] == item[full]) & (place[last] - place[full] <= (n + d)[item[full]] - 2) & (place[last] < offsets[text + 1])]
        # up to 3 d words of the stretch lie before its first pair
        text = np.searchsorted(offsets, place[full], side="right") - 1
        yield np.maximum(place[full] - 3 * d[item[full]], offsets[text]), item[full]
        i = j


def candidates(flat: np.ndarray, offsets: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of windows in flat, and the places of the items they may match. offsets: of the texts in flat."""
    config, wide = index.config, len(index.vocabulary) + 1
    known = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0)) if len(index.pairs) else np.empty(0, np.int64)
    code = flat[known] * wide + flat[known + 1]
    at = np.minimum(np.searchsorted(index.pairs, code), len(index.pairs) - 1)
    same = index.pairs[at] == code
    known, at = known[same], at[same]
    owners = index.owners[at]
    yield from counted(flat, offsets, known, at, index)
    present, local = np.unique(flat, return_inverse=True)
    # a pair across two texts only lets more windows through
    for bit, c in enumerate(index.classes):
        hit = np.zeros(len(flat) + 1, np.int64)
        hit[known + 1] = (owners >> np.uint64(bit)) & np.uint64(1)
        total = np.cumsum(hit)
        span = c.high + config.most(c.high)
        start = np.arange(len(flat))
        start = start[total[np.minimum(start + span - 1, len(flat))] - total[:-1] >= c.need]
        stop = offsets[np.searchsorted(offsets, start, side="right")]
        bits = coin_bits(present, c.steps) if len(start) else None
        for i in range(0, len(start), 4096):
            part = start[i : i + 4096]
            keys = keys_of(walk(flat, part, stop[i : i + 4096], c.steps, bits, local))
            for key, own, items in zip(keys, c.keys, c.items):
                low, n = np.searchsorted(own, key, side="left"), np.searchsorted(own, key, side="right")
                n -= low
                if n.any():
                    whose = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield np.repeat(part, n), items[whose]


def matches(texts: list[str | None], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, first character, last one's end, distance) of the best stretch of each text and item within reach."""
    vocabulary = index.vocabulary
    words = [words_of(t) for t in texts]
    offsets = np.cumsum([0, *map(len, words)])
    flat = np.fromiter((vocabulary.get(w, 0) for ws in words for w in ws), np.int64, offsets[-1])
    if not len(flat) or not index.ids:
        return
    found = [np.stack(x, 1) for x in candidates(flat, offsets, index)]
    if not found:
        return
    pairs = np.unique(np.concatenate(found), axis=0)
    if not len(pairs):
        return
    start, item = pairs.T
    text = np.searchsorted(offsets, start, side="right") - 1
    by = np.lexsort((start, item, text))
    start, item, text = start[by], item[by], text[by]
    n = np.array([len(w) for w in index.words])[item]
    d = index.config.most(n)
    low, high = np.maximum(offsets[text], start - d), np.minimum(offsets[text + 1], start + np.maximum(2 * n + 2 * d, n + 4 * d))
    # stretches that overlap are looked at as one
    new = np.ones(len(start), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(new)) - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k, i, l, h, most in zip(*(x.tolist() for x in (text[heads], item[heads], low[heads], high[ends], d[heads]))):
        dist, a, b = within(index.words[i], flat[l:h])
        if dist <= most:
            best[k, i] = min(best.get((k, i), (dist, l + a, l + b)), (dist, l + a, l + b))
    for (k, item), (dist, a, b) in sorted(best.items()):
        spans = [m.span() for m in spans_of(texts[k])]
        yield int(k), index.ids[item], spans[a - offsets[k]][0], spans[b - 1 - offsets[k]][1], dist


FOUND = "doc_id long, item_id long, start int, stop int, distance int"


def index_bytes(words: list[str], config: Config) -> int:
    """At most so many bytes of an index are an item's: its keys in all repetitions; of each word the text in the vocabulary and its number, of each pair a code, its owners and who has it."""
    return 12 * config.repetitions + sum(len(w.encode()) for w in words) + 56 * len(words) + 100


def blocks(benchmark: DataFrame, config: Config) -> Iterator[list[tuple[int, list[str]]]]:
    """The benchmark's items in blocks; the driver holds one at a time."""
    block, n, size = [], 0, 0
    for row in take(benchmark, "item_id", "text").toLocalIterator():
        words = words_of(row.text)
        own = index_bytes(words, config)
        if block and (n + len(words) > config.block_words or size + own > config.block_bytes):
            yield block
            block, n, size = [], 0, 0
        if words:
            block.append((row.item_id, words))
            n, size = n + len(words), size + own
    if block:
        yield block


def contaminated(df: DataFrame, benchmark: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, item_id, start, stop (characters of the lower-cased text), distance, of each text and item within reach. No shuffle."""
    docs = arrow_docs(take(df, "doc_id", "text"))
    out = None
    for block in blocks(benchmark, config):
        shared = docs.sparkSession.sparkContext.broadcast(build(block, config))

        def search(batches, shared=shared):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    ids = part.column(0).to_pylist()
                    rows = [(ids[k], *rest) for k, *rest in matches(part.column(1).to_pylist(), shared.value)]
                    cols = list(zip(*rows)) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "start", "stop", "distance"])
                release()

        found = docs.mapInArrow(search, FOUND)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, config: Config = Config()) -> DataFrame:
    """df, which has a column text, without the rows that match; each row is judged where it is, whatever its doc_id."""
    names = df.columns
    at, df = names.index("text"), df.toDF(*[f"_{i}" for i in range(len(names))])  # names may differ by case alone
    for block in blocks(benchmark, config):
        shared = df.sparkSession.sparkContext.broadcast(build(block, config))

        def keep(batches, shared=shared):
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    part = batch.slice(i, 1000)
                    clean = np.ones(part.num_rows, bool)
                    clean[[k for k, *_ in matches(part.column(at).to_pylist(), shared.value)]] = False
                    yield part.filter(pa.array(clean))
                release()

        df = arrow_docs(df).mapInArrow(keep, df.schema)
    return df.toDF(*names)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
