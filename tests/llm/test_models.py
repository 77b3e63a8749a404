"""Near-dedup, decontamination, WARC, language ID and sampled pieces, against brute force, round trips and held-out accuracy."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathom.llm import decontaminate, lang_id, near_dedup, sampled_pieces, warc_audit
from fathom.llm.common import Scratch
from fathom.plans.graph import components

from .helpers import clashing, corpus, frame

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {d: find(d) for d, _ in sets}, {d: len(s) for d, s in sets}


def chain_rows():
    """A chain of texts whose neighbours are near and whose ends are not, and many variants of one text."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = rng.sample(vocabulary, 200)
    rows = [(500 - i, " ".join(base[2 * i : 2 * i + 90]), None, None, None) for i in range(40)]
    hot = rng.sample(vocabulary, 120)
    for i in range(150):
        w = list(hot)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(w), None, None, None))
    return rows


@pytest.mark.parametrize("rows", [corpus(4, 90), chain_rows(), []], ids=["mixed", "chains", "empty"])
def test_near_dedup_matches_brute_force(spark, rows):
    got = near_dedup.near_dedup(clashing(frame(spark, rows)), Scratch(spark, "t")).collect()
    component, n = brute_components(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((r[0], n[r[0]], component[r[0]], component[r[0]] == r[0]) for r in rows)


def template_rows(share, n=60, size=100):
    """Texts of one template, each with words of its own at the end, and a few near copies of some."""
    rng, rows = random.Random(int(share * 100)), []
    core = [f"core{i}" for i in range(int(size * share))]
    for i in range(n):
        own = [f"own{i}x{j}" for j in range(size - len(core))]
        rows.append((i, " ".join(core + own), None, None, None))
        if i % 7 == 0:
            rows.append((1000 + i, " ".join([*core, *own[:-2], "changed"]), None, None, None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [0, 40, 10**9])
@pytest.mark.parametrize("rows", [corpus(4, 90), chain_rows(), template_rows(0.55), template_rows(0.7), template_rows(0.84)], ids=["mixed", "chains", "far", "middle", "close"])
def test_near_dedup_of_hot_buckets_matches_brute_force(spark, monkeypatch, rows, hot):
    """Whether a bucket's members meet one by one, by their rarest shingles, or both."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "CROWDED", hot)
    got = near_dedup.near_dedup(frame(spark, rows), Scratch(spark, "t")).collect()
    component, _ = brute_components(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(r[0], component[r[0]]) for r in rows}


def test_similar_sets_share_a_rare_item():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, near_dedup.PARTS)
    for n in (1, 2, 3, 4, 5, 17, 100, 333):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
            drop = rng.integers(0, len(x) // 4 + 1)
            y = rng.permutation(x)[drop:]
            if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y)):
                assert set(near_dedup.rarest(x, counts)) & set(near_dedup.rarest(np.sort(y), counts))


def test_near_dedup_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a b c d e f", None, None, None), (4, "A b  c d e f", None, None, None), (None, "alone in the world now", None, None, None), (None, None, None, None, None)]
    rows += [(None, long, None, None, None), (None, f"{long} more", None, None, None), (9, f"{long} more still", None, None, None), (None, "x y z " * 20, None, None, None), (None, "x y z " * 20 + "q", None, None, None)]
    got = near_dedup.near_dedup(frame(spark, rows), Scratch(spark, "t")).collect()
    want = [(None, 2, 4, False), (4, 2, 4, True), (None, 1, None, True), (None, 0, None, True), (None, 56, 9, False), (None, 57, 9, False), (9, 58, 9, True), (None, 3, None, True), (None, 4, None, True)]
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(want)


def test_near_dedup_says_no_to_ids_beyond_its_range(spark):
    with pytest.raises(Exception, match="2\\^62"):
        near_dedup.near_dedup(frame(spark, [(1 << 62, "a b c", None, None, None)]), Scratch(spark, "t")).collect()


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8):
        n = 3000
        both = int(2 * n * j / (1 + j))
        x = np.unique(rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64))
        a, b = x[:n], x[n - both :]
        same = np.mean([(near_dedup.signature(near_dedup.mix(a + np.uint64(s))) == near_dedup.signature(near_dedup.mix(b + np.uint64(s)))).mean() for s in range(20)])
        assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.03


def test_components_of_stars_and_chains(spark):
    rng, n = random.Random(2), 300
    ids = list(range(n))
    rng.shuffle(ids)
    pairs = list(zip(ids[:100], ids[1:100])) + [(i, i + 1) for i in range(400, 460)] + [(ids[150], x) for x in ids[151:250]]
    links = Scratch(spark, "t")
    df = links.save(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long"), "links")
    roots = {r.node: r.root for r in components(df, links, "c").collect()}
    groups = defaultdict(set)
    for k, v in roots.items():
        groups[v].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [set(ids[:100]), set(range(400, 461)), set(ids[150:250])]))


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        k, at = rng.randrange(3), rng.randrange(len(w))
        w[at : at + (k != 0)] = [] if k == 1 else [f"new{rng.randrange(999)}"]
    return w


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(150)] + ["the", "of", "and"] * 20
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for i in range(30)] + [(30, None), (31, ""), (32, "too short"), (0, None)]
    rows = []
    for d in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if d % 2:
            item = items[rng.randrange(30)][1].split()
            at = rng.randint(0, len(w))
            w[at:at] = edited(item, rng.randint(0, int(0.2 * len(item))), rng)
        rows.append((d, " ".join(w).upper() if d % 3 else ", ".join(w), None, None, None))
    rows += [(300, None, None, None, None), (301, "", None, None, None), (302, "!!", None, None, None)]
    config = decontaminate.Config(block_words=300)
    got = decontaminate.contaminated(clashing(frame(spark, rows)), spark.createDataFrame(items, "item_id long, text string"), config).collect()
    ids = defaultdict(lambda: len(ids) + 1)
    code = lambda t: np.array([ids[w] for w in re.findall(r"\w+", (t or "").lower())], np.int64)
    want = {}
    for i, t in items:
        item = code(t)
        for d, text, *_ in rows:
            dist = decontaminate.within(item, code(text))[0] if len(item) >= 5 else 99
            if dist <= config.most(len(item)):
                want[d, i] = dist
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    assert len(found) == len(got) and set(found) <= set(want)
    assert len(found) >= 0.99 * len(want) and len(want) > 90
    assert all(found[k] == want[k] for k in found)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        item = next(x[1] for x in items if x[0] == r.item_id)
        assert decontaminate.within(code(item), code(text[r.start : r.stop]))[0] == r.distance


def test_exact_passages_are_always_found(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"k{rng.randrange(500)}" for _ in range(rng.randint(5, 80)))) for i in range(50)]
    rows = [(i, f"some words {t} and an end", None, None, None) for i, t in items]
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} >= {(i, i, 0) for i, _ in items}


def test_places_agree_as_configured():
    """The share of CGK places in which windows at the most edits agree, on which the number of repetitions rests."""
    rng, config, share = random.Random(6), decontaminate.Config(), []
    for _ in range(200):
        n = rng.randint(10, 60)
        a = [str(rng.randrange(5000)) for _ in range(n)]
        b = edited(a, config.most(n), rng) + [str(rng.randrange(5000)) for _ in range(20)]
        ids = {w: i + 1 for i, w in enumerate({*a, *b})}
        flat = np.array([ids[w] for w in a + b])
        steps = np.tile(np.arange(int(1.6 * n)), (8, 1))
        out = decontaminate.walk(flat, np.array([0, n]), np.array([n, len(flat)]), steps, decontaminate.coin_bits(np.arange(len(ids) + 1), steps))
        share.append(np.mean([np.prod(rng.choices(list(x[0] == x[1]), k=3)) for x in out for _ in range(20)]))
    assert np.mean(share) > config.agree**config.places


def found_of(texts, items):
    index = decontaminate.build([(i, decontaminate.words_of(t)) for i, t in items], decontaminate.Config())
    return {(k, i): d for k, i, _, _, d in decontaminate.matches(texts, index)}


@pytest.mark.parametrize("n", [8, 15, 25, 59, 120, 200, 300, 500])
@pytest.mark.parametrize("kind", ["changed", "deleted", "inserted", "mixed"])
def test_long_items_are_found_at_the_most_edits_of_each_kind(n, kind):
    rng, most = random.Random(n), decontaminate.Config().most(n)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for i in range(60)]
    texts = []
    for _, item in items:
        w = item.split()
        for at in sorted(rng.sample(range(n), most), reverse=True):
            k = rng.choice(["changed", "deleted", "inserted"]) if kind == "mixed" else kind
            w[at : at + (k != "inserted")] = [] if k == "deleted" else [f"new{rng.randrange(999)}"]
        texts.append(" ".join([*(f"o{rng.randrange(99)}" for _ in range(rng.randint(0, 40))), *w, "and", "more"]))
    got = found_of(texts, items)
    assert sum((i, i) in got for i in range(60)) >= (59 if n <= 15 else 60)
    assert all(d <= most for d in got.values())


def test_counting_in_small_parts_finds_the_same(monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(30, 90)))) for i in range(20)]
    texts = [" ".join([*(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 200))), *edited(t.split(), len(t.split()) // 6, rng)]) for _, t in items] + [None, "w1"]
    whole = found_of(texts, items)
    assert {(i, i) for i in range(20)} <= set(whole)
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert found_of(texts, items) == whole


def test_short_items_and_scripts_without_spaces(spark):
    items = [(0, "one"), (1, "two words"), (2, "just four words here"), (3, "今天天气很好我们去公园"), (4, "吃饭"), (5, "ภาษาไทยไม่มีช่องว่าง"), (6, "!!"), (7, None)]
    texts = ["so One it is", "TWO, words", "two other words", "just four words", "x just four words here y", "他说今天天汽很好我们去公园吧", "一起吃饭吧", "吃的饭", "เขียนภาษาไทยไม่มีช่องว่างนะ", "one", None, "someone"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    want = {(0, 0), (9, 0), (1, 1), (4, 2), (5, 3), (6, 4), (8, 5)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    at = next(r for r in got if r.item_id == 4)
    assert texts[6][at.start : at.stop] == "吃饭" and {r.item_id: r.distance for r in got}[3] == 1
    kept = {r.doc_id for r in decontaminate.drop_contaminated(frame(spark, rows), benchmark).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want}
    alone = decontaminate.contaminated(frame(spark, rows), benchmark.where("item_id = 0")).collect()
    assert {r.doc_id for r in alone} == {0, 9}


@pytest.mark.parametrize("n,length", [(40, 4000), (200, 1000), (20_000, 5), (3000, 15)])
def test_the_index_of_a_block_is_bounded_in_bytes(spark, n, length):
    """What is broadcast stays within the block's bytes, whatever the items' length, and every block's items are found."""
    import pickle

    config = decontaminate.Config(block_bytes=4 << 20)
    rng = random.Random(length)
    items = [(i, " ".join(f"word{rng.randrange(500_000)}" for _ in range(length))) for i in range(n)]
    parts = list(decontaminate.blocks(spark.createDataFrame(items, "item_id long, text string"), config))
    assert sorted(i for block in parts for i, _ in block) == list(range(n))
    for block in parts:
        index = decontaminate.build(block, config)
        assert len(pickle.dumps(index)) < config.block_bytes
        own = [block[k] for k in (0, len(block) // 2, len(block) - 1)]
        texts = [" ".join(["x", *edited(words, config.most(len(words)) // 2, rng), "y"]) for _, words in own]
        assert {(k, i) for k, (i, _) in enumerate(own)} <= {(k, i) for k, i, *_ in decontaminate.matches(texts, index)}


def test_repeated_and_very_long_documents(spark):
    item = " ".join(f"k{i}" for i in range(30))
    filler = " ".join(f"f{i % 977}" for i in range(150_000))
    rows = [(1, f"{filler} {item} {filler}", None, None, None)] + [(2, item, None, None, None)] * 3 + [(None, item, None, None, None), (3, filler, None, None, None)]
    benchmark = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(frame(spark, rows), benchmark).collect())
    assert got == Counter({(1, 7, 0): 2, (2, 7, 0): 6, (None, 7, 0): 2})
    assert [r.doc_id for r in decontaminate.drop_contaminated(frame(spark, rows), benchmark).collect()] == [3]


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = frame(spark, corpus(5))
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.contaminated(docs.limit(0), some).count() == 0
    assert decontaminate.drop_contaminated(docs, some).count() == docs.count()


def test_dropping_takes_whole_rows_out(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"so {item} then", None, None, 1), (None, "clean", None, None, 2), (2, item.replace("five", "5"), None, None, 3), (2, None, None, None, 4)]
    items = spark.createDataFrame([(1, item), (2, "other words that nobody has ever used here")], "item_id long, text string")
    got = decontaminate.drop_contaminated(clashing(frame(spark, rows)), items, decontaminate.Config(block_words=5)).collect()
    assert {r.n_chars for r in got} == {2, 4}


def test_distance_of_a_stretch():
    a = np.array
    assert decontaminate.within(a([1, 2, 3]), a([9, 1, 2, 3, 9])) == (0, 1, 4)
    assert decontaminate.within(a([1, 2, 3, 4]), a([9, 1, 2, 7, 4])) == (1, 1, 5)
    assert decontaminate.within(a([1, 2, 3, 4]), a([1, 3, 4, 9])) == (1, 0, 3)


PAGES = [(i, f"http://h{i % 3}/{i}", f"<p>é{i}</p>\r\n\r\n" * (i % 5), 1) for i in range(300)] + [(None, None, None, 1), (5, "http://h2/5", "", 1), (5, "http://h2/5", "", 1)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, HTML int")


def test_warc_files_come_back(spark, tmp_path):
    records = warc_audit.to_records(pages(spark), 3)
    warc_audit.write_warc(records, str(tmp_path / "w"))
    got = warc_audit.read_warc(spark, str(tmp_path / "w")).collect()
    assert Counter((r.url, bytes(r.body).decode()) for r in got) == Counter((u or "", h or "") for _, u, h, _ in PAGES)
    spans = {(r.file, r.start, r.stop) for r in warc_audit.leaves(records).collect()}
    assert {(int(re.search(r"file=(\d+)", r.path)[1]), r.start, r.stop) for r in got} == spans


def warc(*records):
    return [f"WARC/1.1\r\nwarc-record-id: <{i}>\r\nCONTENT-LENGTH: {len(b)}\r\nWARC-Target-URI:u{i}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(records)]


def read_back(data):
    return [(r.record_id, r.body, r.error) for r in warc_audit.parse_warc(data)]


def test_warc_headers_in_any_case_and_gzip_members():
    import gzip

    parts = warc(b"one", b"", b"\r\n\r\nWARC/", b"\xff" * 3000)
    want = [(f"<{i}>", b, None) for i, b in enumerate([b"one", b"", b"\r\n\r\nWARC/", b"\xff" * 3000])]
    assert read_back(b"".join(parts)) == want and read_back(gzip.compress(b"".join(parts))) == want
    packed = [gzip.compress(p) for p in parts]
    assert read_back(b"".join(packed)) == want
    ends = np.cumsum([len(p) for p in packed])
    assert [(r.start, r.stop) for r in warc_audit.parse_warc(b"".join(packed))] == list(zip([0, *ends[:-1].tolist()], ends.tolist()))
    assert [r.url for r in warc_audit.parse_warc(b"".join(parts))] == ["u0", "u1", "u2", "u3"] and not read_back(b"")


def test_damaged_warc_records_are_rows_and_reading_goes_on():
    import gzip

    a, b, c = warc(b"first", b"second body", b"third")
    assert read_back(a + b + c[:-7]) == [("<0>", b"first", None), ("<1>", b"second body", None), ("<2>", None, "body is cut short")]
    assert read_back(a + c[:20]) == [("<0>", b"first", None), (None, None, "header is cut short")]
    assert read_back(a + b.replace(b": 11", b": 7") + c) == [("<0>", b"first", None), ("<1>", None, "length does not fit"), ("<2>", b"third", None)]
    assert read_back(a + b.replace(b": 11", b": x") + c)[1:] == [("<1>", None, "no length"), ("<2>", b"third", None)]
    assert read_back(b"junk\r\n\r\n" + a) == [(None, None, "no record starts here"), ("<0>", b"first", None)]
    assert read_back(a[:-4]) == [("<0>", b"first", None)]
    packed = [gzip.compress(p) for p in (a, b, c)]
    hurt = packed[1][:14] + b"\x00\xff\x00" + packed[1][17:]
    got = read_back(packed[0] + hurt + packed[2])
    assert got[0] == ("<0>", b"first", None) and got[-1] == ("<2>", b"third", None) and any(e for *_, e in got[1:-1])
    got = read_back(packed[0] + packed[1][:-15])
    assert got[0] == ("<0>", b"first", None) and got[-1][2] == "member is cut short"


def test_warc_files_are_read_in_batches_of_bounded_bytes(spark, tmp_path, monkeypatch):
    import gzip

    (tmp_path / "a.warc").write_bytes(b"".join(warc(*[bytes([65 + i % 20]) * 300_000 for i in range(40)])))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in warc(b"x", b"y")) + b"\x1f\x8b broken")
    got = warc_audit.read_warc(spark, str(tmp_path)).collect()
    assert sum(len(r.body) for r in got if r.body and r.path.endswith("a.warc")) == 12_000_000
    assert [(r.body and bytes(r.body), r.error is None) for r in got if r.path.endswith("gz")] == [(b"x", True), (b"y", True), (None, False)]


def test_trees_equal_ones_made_by_hashlib(spark):
    import hashlib

    scratch, sha = Scratch(spark, "t"), lambda x: hashlib.sha256(x.encode()).hexdigest()
    records = warc_audit.to_records(pages(spark), 2)
    tree = warc_audit.Tree(records, scratch, "a", 4)
    files = defaultdict(list)
    for r in records.collect():
        files[r.file].append((r.segment, -1 if r.key is None else r.key, sha(r.data), len(r.data.encode())))
    roots = {}
    for file, rows in files.items():
        at, nodes = 0, []
        for *_, told, size in sorted(rows):
            nodes.append((at, at + size, sha(f"{at}:{at + size}:{told}")))
            at += size
        while len(nodes) > 1:
            groups = [nodes[i : i + 4] for i in range(0, len(nodes), 4)]
            nodes = [(g[0][0], g[-1][1], sha(",".join(f"{a}:{b}:{h}" for a, b, h in g))) for g in groups]
        roots[file] = nodes[0]
    heights = {f: int(np.ceil(np.log(len(rows)) / np.log(4) - 1e-9)) for f, rows in files.items()}
    assert {f: tuple(tree.levels[heights[f]].where(f"file = {f}").select("start", "stop", "hash").first()) for f in files} == roots


@pytest.mark.parametrize("hurt", ["false", "key = 17", "key % 7 = 0", "true"])
def test_audit_finds_exactly_the_changed_records(spark, hurt):
    scratch = Scratch(spark, "t")
    records = warc_audit.to_records(pages(spark).where("page_id <> 5"), 3)
    other = records.selectExpr("file", "segment", "key", f"CASE WHEN {hurt} THEN concat(substring(data, 1, 9), 'X', substring(data, 11)) ELSE data END AS data")
    one, two = (warc_audit.Tree(r, scratch, n, 4) for r, n in ((records, "a"), (other, "b")))
    got = warc_audit.audit(one, two, scratch).collect()
    assert {r.key for r in got} == {r.key for r in records.where(hurt).collect()} and all(r.status == "corrupt" for r in got)


def test_audit_of_missing_records_and_empty_tables(spark):
    scratch = Scratch(spark, "t")
    records = warc_audit.to_records(pages(spark), 1)
    last = warc_audit.leaves(records).orderBy("at", ascending=False).first()
    one, two = warc_audit.Tree(records, scratch, "a", 4), warc_audit.Tree(records.where(f"key <> {last.key}"), scratch, "b", 4)
    got = warc_audit.audit(one, two, scratch).collect()
    assert {(r.at, r.status) for r in got if r.at == last.at} == {(last.at, "missing")}
    none = [warc_audit.Tree(records.limit(0), scratch, n) for n in "cd"]
    assert not warc_audit.audit(*none, scratch).collect()


def test_audit_locates_changes_of_length_and_records_amid_a_file(spark):
    scratch = Scratch(spark, "t")
    records = warc_audit.to_records(pages(spark), 2)
    data = "CASE WHEN key = 17 THEN concat(data, 'X') WHEN key = 40 THEN substring(data, 1, 60) ELSE data END AS data"
    other = records.where("key IS NULL OR key NOT IN (100, 101)").selectExpr("file", "segment", "key", data)
    other = other.unionByName(records.where("key = 50").selectExpr("file", "segment", "1000 AS key", "data"))
    one, two = (warc_audit.Tree(r, scratch, n, 4) for r, n in ((records, "a"), (other, "b")))
    got = warc_audit.audit(one, two, scratch).collect()
    assert sorted((r.key, r.status) for r in got) == [(17, "corrupt"), (40, "corrupt"), (100, "missing"), (101, "missing"), (1000, "extra")]
    at = {(r.file, r.at, r.start, r.stop) for r in got if r.status != "extra"}
    assert at == {(r.file, r.at, r.start, r.stop) for r in one.levels[0].where("key IN (17, 40, 100, 101)").collect()}


@needs_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out and lang_id.has_letter(r.text)]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.05 and all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(i, t, l, None, None) for i, (t, l) in enumerate([("the cat and the hat", "en"), ("der hund und die katze", "de")] * 60)]
    rows += [(None, "the", "en", None, None), (200, None, "en", None, None), (201, "123 !", "xx", None, None), (202, "", None, None, None), (203, "Ω", None, None, None), (204, "the hat " * 30000, None, None, None)]
    df = clashing(frame(spark, rows))
    model = lang_id.train(lang_id.sample(df))
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r for r in lang_id.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 200, 201, 202, 204)] == ["en", "de", "und", "und", "und", "en"] and got[203].lang_pred in ("de", "en")
    assert got[200].score == 0 and got[200].rejected and not got[0].rejected
    assert {r[0] for r in lang_id.keep_known(df, model).collect()} == {d for d, r in got.items() if not r.rejected}
    none = lang_id.train(lang_id.sample(df.limit(0)))
    assert {r.lang_pred for r in lang_id.predict(df, none).collect()} == {"und"} and lang_id.predict(df.limit(0), model).count() == 0


def test_language_scores_do_not_depend_on_the_batch():
    rows = [(i, f"{w} {w}a{w} more {w}", w) for i, w in enumerate(["ab", "xy"] * 40)]
    model = lang_id.train(rows)
    texts = ["ab ab", "x", None, "xyxy ab", "y" * 2000]
    alone = [model.scores([t]) for t in texts]
    best, top = model.scores(texts)
    assert [a[0][0] for a in alone] == best.tolist() and np.allclose([a[1][0] for a in alone], top, atol=1e-12)


def test_language_never_learns_from_held_out_rows(spark):
    import zlib

    rows = [(i, f"text {i}", "en", None, None) for i in range(100)]
    assert {r[0] for r in lang_id.sample(frame(spark, rows))} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5}


def test_language_scores_equal_a_plain_network():
    """Embed every subword, average, softmax: subword by subword, without the folded table."""
    config = lang_id.Config(buckets=1 << 10, dims=4, epochs=2)
    rows = [(i, f"{w} {w}a{w} more {w}", w) for i, w in enumerate(["ab", "xy", "élan"] * 30)]
    model = lang_id.train(rows, config)
    rng = np.random.Generator(np.random.PCG64(8))
    bags, langs = [], sorted({r[2] for r in rows})

    def buckets(text):
        data, out = lang_id.clean(text), []
        for n in (2, 3, 4):
            for at in range(len(data) - n + 1):
                code = int.from_bytes(data[at : at + n], "little")
                out.append(((code + n) * 0x9E3779B1 & 0xFFFFFFFF) >> (33 - config.buckets.bit_length()))
        return out

    def bag(text):
        found = Counter(buckets(text))
        ids = sorted(found)
        return np.array(ids), np.array([found[i] for i in ids], np.float64) / sum(found.values())

    import zlib

    for i, text, lang in sorted(rows):
        learns, words = zlib.crc32(str(i).encode()) % 5 != 1, text.split()
        n = int(rng.integers(1, 13))
        at = int(rng.integers(0, max(1, len(words) - n)))
        if learns:
            bags += [(bag(x), langs.index(lang)) for x in (text, " ".join(words[at : at + n]))]
    emb, out, bias = lang_id.layers([((i, w.astype(np.float32)), y) for (i, w), y in bags], len(langs), config, rng)
    for text in ["ab aba", "xyx", "Élan more", "b", "ab xy élan"]:
        mean = np.mean([emb[i] for i in buckets(text)], axis=0)
        z = mean @ out + bias
        heats = [np.exp(z * t) / np.exp(z * t).sum() for t in 2.0 ** np.arange(-6, 3, 0.25)]
        best, top = model.scores([text])
        assert any(p.argmax() == best[0] and abs(p.max() - top[0]) < 1e-4 for p in heats)


def test_the_same_table_gives_the_same_model(spark):
    """Whatever the order and the parts of the rows, also with ids that repeat often, and with more languages than are common."""
    rng = random.Random(3)
    rows = [(i % 40, f"word{i % 7} {'ab' * (i % 5)} text", f"l{i % 3}", None, None) for i in range(900)] + [(5, "same text", "l0", None, None)] * 500
    rows += [(1000 + i, f"only {i}", f"rare{i}", None, None) for i in range(60)]
    config, got = lang_id.Config(per_lang=20, buckets=1 << 8, dims=2, epochs=1), []
    for parts in (1, 5):
        rng.shuffle(rows)
        chosen = sorted(lang_id.sample(frame(spark, rows).repartition(parts), config))
        got.append((chosen, lang_id.train(chosen, config)))
    assert got[0][0] == got[1][0] and (got[0][1].table == got[1][1].table).all()
    assert max(Counter(r[2] for r in got[0][0]).values()) <= 20 and len(set(got[0][0])) == len(got[0][0])
    assert sum(lang.startswith("rare") for lang in got[0][1].langs) > 35


needs_model = pytest.mark.skipif(not os.path.exists(sampled_pieces.MODEL), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def proto():
    with open(sampled_pieces.MODEL, "rb") as file:
        return file.read()


def segmentations(text, v):
    """All segmentations of a short text, with their weights: brute force over pieces of the whole string."""
    codes = "▁" + text.replace("▁", "\0").replace(" ", "▁")
    pieces = {}
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sampled_pieces.MODEL)
    for i in range(m.get_piece_size()):
        if v.logw[i] > -np.inf:
            pieces[m.id_to_piece(i)] = i
    out = []

    def go(at, ids, logw):
        if at == len(codes):
            out.append((tuple(ids), logw))
            return
        for stop in range(at + 1, min(len(codes), at + 16) + 1):
            if (i := pieces.get(codes[at:stop])) is not None:
                go(stop, [*ids, i], logw + v.logw[i])
        if codes[at] not in pieces:
            data = codes[at].replace("\0", "▁").encode()
            go(at + 1, [*ids, *[v.byte_id[b] for b in data]], logw + len(data) * v.byte_logw)

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {ids: w - total for ids, w in out}


@needs_model
@pytest.mark.parametrize("text", ["the", "a b", "1é▁", "ab 12", " x"])
def test_samples_follow_the_exact_distribution(proto, text):
    sampler = sampled_pieces.Sampler(proto, 3)
    exact = segmentations(text, sampler.v)
    first, n = Counter(), 4000
    second = Counter()
    for found in sampler.sample(list(range(n)), [text] * n):
        ids = [tuple(map(int, x[0])) for x in found]
        assert len(set(ids)) == len(ids) == min(3, len(exact))
        assert all(abs(x[1] - exact[i]) < 1e-9 and x[2] <= 0 for x, i in zip(found, ids))
        first[ids[0]] += 1
        second[ids[1] if len(ids) > 1 else None] += 1
    for ids, logp in exact.items():
        p = np.exp(logp)
        assert abs(first[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
        after = sum(np.exp(o) * p / (1 - np.exp(o)) for i, o in exact.items() if i != ids)
        assert abs(second[ids] / n - after) < 5 * np.sqrt(after * (1 - after) / n) + 1e-3 or len(exact) == 1


@needs_model
def test_inclusion_scores_are_unbiased(proto):
    """Horvitz-Thompson: the sum of p / inclusion over a sample estimates 1."""
    sampler = sampled_pieces.Sampler(proto, 4)
    total = [sum(np.exp(logp - score) for _, logp, score in found) for found in sampler.sample(list(range(3000)), ["then"] * 3000)]
    assert abs(np.mean(total) - 1) < 0.05


@needs_model
def test_pieces_decode_to_the_text(spark, proto):
    import sentencepiece

    texts = [None, "", " ", "   lead", "trail  ", "a\nb\tc\r", "▁x ▁▁", "日本語 😀 \x00", "z" * 3000, "the cat " * 400, "é" * 50, "1234567890.,!?", "́﻿ "]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "no key", None, None, None), (3, texts[3], None, None, None)]
    got = sampled_pieces.sampled_pieces(clashing(frame(spark, rows)), samples=3).collect()
    assert all(r.exact for r in got) and {r.doc_id for r in got} == {*range(len(texts)), None}
    m = sentencepiece.SentencePieceProcessor(model_proto=proto)
    for r in got:
        if r.doc_id not in (None, 6):
            assert m.decode(list(r.ids)) == (texts[r.doc_id] or "")
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.sample, tuple(r.ids), r.log_prob, r.log_inclusion))
    assert by[0] == by[1][:0] + [(0, (), 0.0, 0.0)] and len(by[3]) == 6 and len(set(by[3])) == 3
    assert len({x[1] for x in by[9]}) == 3
    again = sampled_pieces.sampled_pieces(frame(spark, rows[5:10]), samples=3).collect()
    assert all((r.sample, tuple(r.ids), r.log_prob, r.log_inclusion) in by[r.doc_id] for r in again)
    assert sampled_pieces.sampled_pieces(frame(spark, [])).count() == 0


@needs_model
def test_nodes_left_out_at_first_change_nothing(proto, monkeypatch):
    """Steps far below a path's start are looked at only where they could matter; looking at all of them gives the same samples."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc de\n é▁") for _ in range(rng.choice([0, 3, 50, 900]))) for _ in range(60)] + [None]
    sampler, got = sampled_pieces.Sampler(proto, 4), []
    for reach in (100.0, 1e9, 3.0):
        monkeypatch.setattr(sampled_pieces, "REACH", reach)
        got.append([[(tuple(map(int, ids)), *figures) for ids, *figures in found] for found in sampler.sample(list(range(61)), texts)])
    assert got[0] == got[1] == got[2]


@needs_model
def test_best_segmentation_is_the_most_probable(proto):
    sampler = sampled_pieces.Sampler(proto)
    texts = ["the", "a b", "1é▁", "ab 12", " x", "", None, "then a cat"]
    for text, ids in zip(texts, sampler.best(texts)):
        assert sampler.v.decode(ids) == (text or "")
        if text:
            exact = segmentations(text, sampler.v)
            assert exact[tuple(map(int, ids))] >= max(exact.values()) - 1e-9
