"""Sampled SentencePiece segmentations: Gumbel top-k without replacement over the lattice.

The lattice of a text has an edge for every piece that fits at a place, and the
bytes of a character that no piece covers. A segmentation's probability is
proportional to the product of its pieces' weights, 1 / (rank + offset) to the
power `sharpness`, as a BPE vocabulary gives ranks instead of probabilities. The
k segmentations of greatest Gumbel-perturbed log-probability are a sample without
replacement. The search is A-star over partial segmentations: the exact mass of
what lies behind a place (summed backwards over the lattice) makes every node's
perturbed maximum known, following the maximum down emits one segmentation, and
what is left beside it at each step becomes a node whose perturbed maximum is a
Gumbel variable truncated at the one above. The (k+1)-th value is the threshold
of the inclusion scores.

A piece never reaches over the start of a run of spaces, nor over a character
that only occurs as a piece of its own; the lattice falls apart there, so places
are shared by all equal words of a batch, and steps are numpy operations over all
words at once. All random numbers are hashes of the row's key, the sample's
number, the word's and the step's: a row gives the same result in any batch.

Decoding gives the text back exactly, also where it holds the space mark U+2581
(coded in bytes) or other characters without a piece.

Defined cases: null and empty texts have one empty segmentation with score 0; a
text with fewer than k segmentations gives those, each with inclusion 1 (log 0);
a null key is a key of its own; repeated rows give the same samples each; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_docs, release, take
from .near_dedup import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SHARPNESS, OFFSET, CHUNK = 2, 1.0, 10.0, 1 << 20
MARK, LITERAL, ODD = 0x2581, 0x110000, np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Path:
    """An emitted segmentation: edge, place, word and log-probability of each step."""

    edge: np.ndarray
    place: np.ndarray
    word: np.ndarray
    logp: np.ndarray


@dataclass
class Words:
    """The words of a batch of texts: which distinct one each is, how many there are up to the end of each text, and the characters and lengths of the distinct ones."""

    kinds: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    size: np.ndarray


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and for every key the number of its own."""
    by = np.argsort(keys)
    held = keys.take(by)
    new = np.append(True, held[1:] != held[:-1])[: len(keys)]
    same = np.empty(len(keys), np.int64)
    same[by] = np.cumsum(new) - 1
    return by[new], same


class Table:
    """Ids by 64-bit keys: one probe for keys with a slot of their own, a sorted search for the few that share one."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        self.shift = np.uint64(64 - max(8, 5 + len(keys).bit_length()))
        self.slot = np.full(1 << int(64 - self.shift), -1, np.int32)
        at = self.place(keys)
        self.slot[at] = np.arange(len(keys))
        lost = np.flatnonzero(self.slot[at] != np.arange(len(keys)))
        lost = lost[np.argsort(keys[lost])]
        self.keys, self.ids, self.lost_keys, self.lost_ids = keys, ids, keys[lost], ids[lost]

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in keys that are known, and their ids."""
        slot = self.slot[self.place(keys)]
        at = np.flatnonzero(slot >= 0)
        slot = slot[at]
        same = self.keys[slot] == keys[at]
        known, ids = at[same], self.ids[slot[same]]
        if len(self.lost_keys):
            rest = at[~same]
            i = np.minimum(np.searchsorted(self.lost_keys, keys[rest]), len(self.lost_keys) - 1)
            same = self.lost_keys[i] == keys[rest]
            known, ids = np.concatenate([known, rest[same]]), np.concatenate([ids, self.lost_ids[i[same]]])
        return known, ids


class Vocabulary:
    """Pieces by length, their weights, and what each decodes to."""

    def __init__(self, proto: bytes, sharpness: float = SHARPNESS):
        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = m.get_piece_size()
        self.bytes_of, self.logw, by_length, together = [b""] * n, np.full(n, -np.inf), {}, set()
        self.byte_id = {}
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i)):
                by_length.setdefault(len(piece), []).append((piece, i))
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                self.logw[i] = -sharpness * np.log(min(-m.get_score(i), n) + OFFSET)
                if len(piece) > 1:
                    together.update(piece)
                if "▁" in piece.lstrip("▁"):
                    raise ValueError("pieces that reach over the start of a word are not supported")
        self.held = pa.array(self.bytes_of, pa.binary())
        self.byte_logw = -sharpness * np.log(n + OFFSET)
        self.tables = {}
        for size, found in by_length.items():
            codes = np.frombuffer("".join(p for p, _ in found).encode("utf-32-le"), np.uint32).reshape(-1, size)
            h = np.zeros(len(found), np.uint64)
            for k in range(size):
                h = h * ODD + codes[:, k].astype(np.uint64) + np.uint64(1)
            self.tables[size] = Table(h, np.array([i for _, i in found]))
        #: Of each character: 2 a space, 1 one that stands in pieces of several, 0 any other.
        self.kind = np.zeros(sys.maxunicode + 1, np.uint8)
        self.kind[[ord(c) for c in together - {"▁"}]] = 1
        self.kind[32] = 2

    def words(self, texts: list[str | None]) -> Words:
        """Each text, after a space, falls into words: a run of spaces with the run of characters of pieces behind it, such a run alone, or one other character."""
        said = [" " + t if t else "" for t in texts]
        flat = np.frombuffer("".join(said).encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(t) for t in said], dtype=np.int64)
        if not len(flat):
            return Words(np.empty(0, np.int64), stops, flat, stops[:0])
        kind = self.kind.take(flat)
        opens = kind == 0
        opens[1:] |= ((kind[1:] == 2) & (kind[:-1] != 2)) | ((kind[1:] == 1) & (kind[:-1] == 0))
        begins = np.append(0, stops[:-1])
        opens[begins[begins < len(flat)]] = True
        first = np.flatnonzero(opens)
        size = np.diff(np.append(first, len(flat)))
        inside = (np.arange(1, len(flat) + 1) - np.repeat(first, size)).astype(np.uint64)
        one, same = distinct(np.add.reduceat(mix(inside * ODD + flat), first))
        ends, first, size = np.searchsorted(first, stops), first[one], size[one]
        return Words(same, ends, flat.take(np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())), size)

    def pieces(self, edges: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of edges, and how many each edge has; an edge of -1 is its character in bytes."""
        bare, size = np.flatnonzero(edges < 0), np.ones(len(edges), np.int64)
        if not len(bare):
            return edges, size
        kinds, which = np.unique(chars[bare], return_inverse=True)
        coded = [[self.byte_id[b] for b in chr(MARK if c == LITERAL else c).encode()] for c in kinds.tolist()]
        size[bare] = np.array([len(x) for x in coded])[which]
        out = np.repeat(edges, size)
        out[out < 0] = list(chain.from_iterable(map(coded.__getitem__, which.tolist())))
        return out, size

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes that all ids decode to, one after another, and where those of the first n ids end, for each n of ends."""
        held = self.held.take(pa.array(ids))
        _, offsets, data = held.buffers()
        return memoryview(data or b"").cast("B"), np.frombuffer(offsets, np.int32)[ends]


class Lattice:
    """The places of all distinct words of a batch, ordered by the characters left to the word's end.

    What lies behind a place depends on the rest of its word alone, so equal
    rests, told by a 64-bit hash, are one place. Per place and edge: `edge`
    (piece id, -1 for the character in bytes), `next` (the place it leads to; the
    number of places at a word's end), `share` (of the mass behind the place) and
    `upto` (shares summed).
    """

    def __init__(self, words: Words, v: Vocabulary):
        size = words.size
        stop = np.cumsum(size)
        codes = words.codes.astype(np.uint64)
        codes = np.where(codes == MARK, np.uint64(LITERAL), np.where(codes == 32, np.uint64(MARK), codes))
        left = np.repeat(stop, size) - np.arange(len(codes))
        key = left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left  # short keys sort by counting
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        rest = np.zeros(len(codes) + 1, np.uint64)
        for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own = order[a:b]
            rest[own] = mix((rest[own + 1] if r else np.uint64(0)) * ODD + codes[own] + np.uint64(1))
        first, same = distinct(rest[:-1])
        by = np.argsort(key[first], kind="stable")
        first, number = first[by], np.empty(len(by), np.int32)
        number[by] = np.arange(len(by), dtype=np.int32)
        place, n = number[same], len(first)
        self.start, self.left, self.codes, self.end = place[stop - size], left[first], codes[first], n
        columns, count = [], np.zeros(n, np.int8)

        def add(here, length, ids, weight):
            col = count[here]
            count[here] = col + 1
            at = first[here] + length
            to = np.where(self.left[here] == length, n, place[np.minimum(at, len(place) - 1)]).astype(np.int32)
            while len(columns) <= int(col.max(initial=-1)):
                columns.append((np.full(n, -1, np.int32), np.full(n, n, np.int32), np.full(n, -np.inf)))
            for c, column in enumerate(columns):
                own = np.flatnonzero(col == c)
                column[0][here[own]], column[1][here[own]], column[2][here[own]] = ids[own], to[own], weight[own]

        h, here = np.zeros(n, np.uint64), np.arange(n)
        for k in range(1, max(v.tables) + 1):
            if k > 1:
                keep = self.left[here] >= k
                here, h = here[keep], h[keep]
            if not len(here):
                break
            h = h * ODD + codes[first[here] + k - 1] + np.uint64(1)
            if k in v.tables:
                known, ids = v.tables[k].find(h)
                add(here[known], k, ids, v.logw[ids])
            if k == 1:
                bare = np.flatnonzero(count == 0)
                c = self.codes[bare].astype(np.int64)
                c = np.where(c == LITERAL, MARK, c)
                add(bare, 1, np.full(len(bare), -1), v.byte_logw * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)))
        self.edge, self.next, self.share = (np.stack(x, 1) for x in zip(*columns))
        behind = np.zeros(n + 1)
        cuts = np.searchsorted(self.left, np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:]):
            x = self.share[a:b]
            x += behind[self.next[a:b]]
            top = x.max(1)
            x -= top[:, None]
            np.exp(x, out=x)
            total = x.sum(1)
            x /= total[:, None]
            behind[a:b] = top + np.log(total)
        self.mass = behind
        self.upto = np.cumsum(self.share, 1, dtype=np.float32)


def hashed(*parts) -> np.ndarray:
    h = np.uint64(0)
    for x in parts:
        h = mix((h ^ np.asarray(x).astype(np.uint64)) * ODD + np.uint64(1))
    return h


def uniform(base: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """From 2^-53 to 1 - 2^-53, the variable of this number that belongs to a hash."""
    return ((mix(base + np.asarray(number).astype(np.uint64) * ODD) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


#: log(-log(1 - 2^-53)): no Gumbel variable at phi exceeds phi by more than this below 0.
LEAST_LOG = float(np.log(-np.log1p(-(2.0**-53))))
#: Nodes beside a path are looked for first where it has lost up to so much log-probability.
REACH = 100.0


@dataclass
class Samples:
    """The segmentations of a batch of texts, text by text in the order of their perturbed values; the pieces of the n-th are ids[ends[n]:ends[n + 1]]."""

    text: np.ndarray
    number: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    logp: np.ndarray
    score: np.ndarray


class Sampler:
    def __init__(self, proto: bytes, samples: int = SAMPLES, sharpness: float = SHARPNESS):
        self.v, self.k = Vocabulary(proto, sharpness), samples

    def sample(self, keys: list, texts: list[str | None]) -> list[list[tuple[np.ndarray, float, float]]]:
        """Per text its segmentations in the order of their perturbed values: (piece ids, log-probability, log of the inclusion score)."""
        got, out = self.batch(keys, texts), [[] for _ in texts]
        for d, a, b, logp, score in zip(got.text.tolist(), got.ends[:-1], got.ends[1:], got.logp.tolist(), got.score.tolist()):
            out[d].append((got.ids[a:b], logp, score))
        return out

    def best(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text the piece ids of its most probable segmentation, the first by vocabulary order of several; no randomness."""
        words = self.v.words(texts)
        if not len(words.kinds):
            return [np.empty(0, np.int32) for _ in texts]
        lattice = Lattice(words, self.v)
        top, pick = np.zeros(lattice.end + 1), np.zeros(lattice.end, np.int64)
        cuts = np.searchsorted(lattice.left, np.arange(1, int(lattice.left.max()) + 2))
        for a, b in zip(cuts, cuts[1:]):
            with np.errstate(divide="ignore"):
                value = np.log(lattice.share[a:b]) + lattice.mass[a:b, None] + top[lattice.next[a:b]] - lattice.mass[lattice.next[a:b]]
            pick[a:b] = value.argmax(1)
            top[a:b] = value.max(1)
        coded = []
        for at in lattice.start.tolist():
            edges, places = [], []
            while at < lattice.end:
                edges.append(lattice.edge[at, pick[at]])
                places.append(at)
                at = int(lattice.next[at, pick[at]])
            coded.append(self.v.pieces(np.array(edges, np.int32), lattice.codes[places])[0])
        return [np.concatenate([np.empty(0, np.int32), *map(coded.__getitem__, own.tolist())]) for own in np.split(words.kinds, words.ends[:-1])]

    def batch(self, keys: list, texts: list[str | None]) -> Samples:
        words = self.v.words(texts)
        lattice = Lattice(words, self.v) if len(words.kinds) else None
        flat, ends, begins = words.kinds, words.ends, np.append(0, words.ends[:-1])[: len(texts)]
        seeds = np.array([xxhash.xxh3_64_intdigest(repr(k).encode()) for k in keys], np.uint64)
        heaps: list[list] = [[] for _ in texts]
        paths: list[list[Path]] = [[] for _ in texts]
        tops = -np.log(-np.log(uniform(hashed(seeds, 0), 7)))
        # a task: text, bound, first word, place in it (or -1 for its start), excluded edges, path before
        tasks = [(d, float(tops[d]), int(begins[d]), -1, (), None) for d in range(len(texts)) if begins[d] < ends[d]]
        for turn in range(self.k):
            if not tasks:
                break
            self._follow(turn, tasks, lattice, flat, ends, begins, seeds, heaps, paths)
            tasks = []
            for d, heap in enumerate(heaps):
                if turn + 1 < self.k and heap:
                    top, level, path, gone = heapq.heappop(heap)
                    p = paths[d][path]
                    tasks.append((d, -top, int(p.word[level]), int(p.place[level]), gone, (path, level)))
        text, number, logp, score, parts = [], [], [], [], []
        for d, found in enumerate(paths):
            bound = -heaps[d][0][0] if heaps[d] else -np.inf
            for n, p in enumerate(found or [None]):
                own = float(p.logp.sum()) if p else 0.0
                x = own - bound
                text.append(d)
                number.append(n)
                logp.append(own)
                score.append(0.0 if x > 30 or not p else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x)
                parts.append((p.edge, p.place) if p else (np.empty(0, np.int32), np.empty(0, np.int64)))
        if not text:
            return Samples(*[np.empty(0, np.int64)] * 3, np.zeros(1, np.int64), *[np.empty(0)] * 2)
        edge, place = (np.concatenate(x) for x in zip(*parts))
        ids, size = self.v.pieces(edge, lattice.codes[place] if lattice else place)
        upto = np.concatenate([[0], np.cumsum(size)])
        cuts = np.cumsum([0, *(len(e) for e, _ in parts)])
        return Samples(np.array(text), np.array(number), ids, upto[cuts], np.array(logp), np.array(score))

    def _follow(self, turn, tasks, lattice, flat, ends, begins, seeds, heaps, paths) -> None:
        """Follows each task's maximum to the end of its text; adds the path, and nodes for what lies beside it."""
        text = np.array([t[0] for t in tasks])
        first = np.array([t[2] for t in tasks])
        n = ends[text] - first
        task = np.repeat(np.arange(len(tasks)), n)
        lead = np.cumsum(n) - n
        word = np.arange(n.sum()) - np.repeat(lead, n) + np.repeat(first, n)
        at = lattice.start[flat[word]]
        inner = np.array([t[3] for t in tasks])
        at[lead] = np.where(inner >= 0, inner, at[lead])
        base = mix(hashed(seeds[text], turn + 1).take(task) + (word - begins[text].take(task)).astype(np.uint64) * ODD)
        wide = lattice.edge.shape[1]
        live, step, got = np.arange(len(at)), 0, []
        gone = [(int(i), e) for i, t in zip(lead, tasks) for e in t[4]]
        special = {}
        while len(live):
            here = at.take(live)
            u = np.minimum(uniform(base.take(live), 2 * lattice.left.take(here)), 1 - 2.0**-23).astype(np.float32)
            upto = lattice.upto.take(here, 0)
            pick = (upto <= (u * upto[:, -1])[:, None]).argmin(1)
            if step == 0 and gone:  # these steps choose among what is left
                rows, edges = np.array(gone).T
                some, row = np.unique(rows, return_inverse=True)
                rest = lattice.share[here[some]]
                rest[row, edges] = 0
                total = np.cumsum(rest, 1)
                pick[some] = (total <= u[some, None] * total[:, -1:]).sum(1)
                share = rest[np.arange(len(some)), pick[some]]
                rest[np.arange(len(some)), pick[some]] = 0
                special = {"step": some, "share": share, "beside": rest.sum(1)}
            got.append((live, pick, here))
            to = lattice.next.take(here * wide + pick)
            at[live] = to
            live, step = live[to < lattice.end], step + 1
        count = np.zeros(len(at), np.int64)
        for step, (which, *_) in enumerate(got):
            count[which] = step + 1
        offset = np.cumsum(count) - count
        pick, place = np.empty(count.sum(), np.int64), np.empty(count.sum(), np.int64)
        for step, (which, *cols) in enumerate(got):
            to = offset[which] + step
            pick[to], place[to] = cols
        del got
        which = np.repeat(np.arange(len(at)), count)
        share = lattice.share.take(place * wide + pick)
        if special:
            share[offset[special["step"]]] = special["share"]
        logp, edge, words = np.log(share), lattice.edge.take(place * wide + pick), word.take(which)
        before = np.zeros(len(tasks))
        for i, (d, *_, back) in enumerate(tasks):
            if back:
                before[i] = paths[d][back[0]].logp[: back[1]].sum()
        cut = np.append(offset[lead], len(which))
        # summed text by text, so that a row's figures don't depend on the rest of the batch
        upto = np.concatenate([np.cumsum(logp[a:b]) for a, b in zip(cut, cut[1:])]) - logp
        want = self.k + 1 - turn

        def beside(steps: np.ndarray) -> Iterator[tuple[int, int, float | None]]:
            """(task, step, perturbed maximum) of the best nodes beside the paths at these steps (ascending); without a maximum where steps of the task that are left out may have better ones."""
            owner = task.take(which.take(steps))
            off = 1 - share[steps]
            if special:
                at = np.minimum(np.searchsorted(steps, offset[special["step"]]), len(steps) - 1)
                same = steps[at] == offset[special["step"]]
                off[at[same]] = special["beside"][same]
            with np.errstate(divide="ignore", invalid="ignore"):
                phi = upto[steps] + before[owner] + np.log(off)
                level = np.where(off > 0, np.log(-np.log(uniform(base[which[steps]], 2 * lattice.left[place[steps]] + 1))) - phi, np.inf)
            for i in np.unique(owner).tolist():
                a, b = np.searchsorted(owner, [i, i + 1])
                best = np.argpartition(level[a:b], want - 1)[:want] if b - a > want else np.arange(b - a)
                # a step left out is REACH below the start; its Gumbel variable can't make up for that
                if b - a < cut[i + 1] - cut[i] and (len(best) < want or level[a + best].max() > REACH + LEAST_LOG - before[i]):
                    yield i, int(steps[a]), None
                else:
                    yield from ((i, int(steps[a + j]), -float(np.logaddexp(level[a + j], -tasks[i][1]))) for j in best if level[a + j] < np.inf)

        for i, (d, _, _, _, _, back) in enumerate(tasks):
            a, b = cut[i], cut[i + 1]
            new = [edge[a:b], place[a:b], words[a:b], logp[a:b]]
            if back:
                old = paths[d][back[0]]
                new = [np.concatenate([x[: back[1]], y]) for x, y in zip((old.edge, old.place, old.word, old.logp), new)]
            paths[d].append(Path(*new))
        near = list(beside(np.flatnonzero(upto >= -REACH)))
        far = [np.arange(cut[i], cut[i + 1]) for i, _, value in near if value is None]
        for i, j, value in chain(near, beside(np.concatenate(far)) if far else ()):
            if value is None:
                continue
            d, _, _, _, gone, back = tasks[i]
            held = (int(pick[j]),)
            heapq.heappush(heaps[d], (-value, (back[1] if back else 0) + j - int(cut[i]), len(paths[d]) - 1, (*gone, *held) if j == cut[i] else held))


PIECES = "doc_id long, sample int, ids array<int>, log_prob double, log_inclusion double, exact boolean"


def chunks(texts: list[str | None]):
    """Runs of rows of about CHUNK characters."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def sampled_pieces(df: DataFrame, model: str = MODEL, samples: int = SAMPLES) -> DataFrame:
    """doc_id, sample (from 0), ids, log_prob, log_inclusion, exact (decoding gives the text back). model: a file that the driver reads; its bytes, some 0.5 MB whatever the input, are broadcast."""
    docs = arrow_docs(take(df, "doc_id", "text"))
    with open(model, "rb") as file:
        proto = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        sampler = Sampler(proto.value, samples)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                got = sampler.batch(ids[a:b], texts[a:b])
                data, ends = sampler.v.decoded(got.ids, got.ends)
                said = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts[a:b]]
                exact = [data[i:j] == said[d] for d, i, j in zip(got.text.tolist(), ends.tolist(), ends[1:].tolist())]
                held = pa.ListArray.from_arrays(got.ends.astype(np.int32), got.ids.astype(np.int32))
                key = pa.array(ids[a:b], pa.int64()).take(pa.array(got.text))
                cols = [key, pa.array(got.number.astype(np.int32)), held, pa.array(got.logp), pa.array(got.score), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "sample", "ids", "log_prob", "log_inclusion", "exact"])
                del got, data, ends, said, exact, held, key, cols
            del ids, texts
            release()

    return docs.mapInArrow(run, PIECES)


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampled_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), said.alias("ids_sha256"), "log_prob", "log_inclusion", "exact")
