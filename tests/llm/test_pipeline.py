"""The pipeline's stages on their own inputs, and its result against plain Python for the stages that allow it."""

import os

import pytest

import corpus_pipeline as p

from .helpers import DOCS, clashing
from .test_models import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = seen[name][1]
        if name != p.STAGES[-1][0]:
            assert docs.schema.simpleString() == seen["language"][0].schema.simpleString()
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = (list(x.select("doc_id", "text").toPandas().itertuples(index=False, name=None)) for x in seen["near_duplicates"])
    component, _ = brute_components(before)
    assert {d for d, _ in after} == {d for d, c in component.items() if d == c}
    assert len(after) < len(before)
    assert ids(seen["pieces"][1]) == ids(seen["pieces"][0])
    assert len(ids(seen["language"][1])) > 0.97 * len(ids(seen["language"][0]))
    leaked = {r.doc_id for r in __import__("fathom.llm.decontaminate").llm.decontaminate.op5_decontaminate(spark, SF).collect()}
    assert not leaked & ids(seen["benchmark"][1])


def test_run_gives_what_the_stages_give(spark):
    out = p.run(spark, SF)
    assert out.where("NOT exact").count() == 0 and out.count() > 0


def test_stages_stand_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_one_row_of_each_group_whatever_its_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    near = lambda k: text(k) + " more"
    rows = [(1, text("a"), "en", "s", 1), (None, text("a"), "en", "s", 1), (None, near("a"), "en", "s", 1), (2, near("a"), "en", "s", 1)]
    rows += [(None, text("b"), "en", "s", 1)] * 3 + [(None, text("b"), "de", "s", 1), (None, near("b"), "en", "s", 1)]
    rows += [(3, text("c"), "en", "s", 1)] * 3 + [(3, text("c"), "de", "s", 1)] + [(4, text("d"), "en", "s", 1), (4, text("e"), "en", "s", 1), (5, text("e"), None, "s", 1)]
    rows += [(6, None, "en", "s", None), (7, None, "en", "s", None), (8, "", "en", "s", None), (None, None, "en", "s", None), (None, None, "en", "s", None)]
    got = [tuple(r) for r in p.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).collect()]
    assert set(got) <= set(rows) and len(got) == len(set(got))
    kept = sorted(((r[0] or 0, (r[1] or "-")[:1]) for r in got))
    assert kept == [(0, "-"), (0, "b"), (1, "a"), (3, "c"), (4, "d"), (4, "e"), (6, "-"), (7, "-"), (8, "-")]


def test_text_copied_over_a_source_survives_once(spark):
    """Copies of one text on over 5 % of a source keep its lines, for near-dedup to leave one; near copies lose the shared lines and keep their own."""
    copied = "\n".join(" ".join(f"line{i}w{j}" for j in range(12)) for i in range(6))
    plain = [(i, " ".join(f"d{i}w{j}" for j in range(40)), "en", "s", 1) for i in range(100)]
    whole = [(1000 + i, copied, "en", "s", 1) for i in range(8)]
    close = [(2000 + i, f"{copied}\nown{i} words here that no other has", "en", "s", 1) for i in range(4)]
    docs = p.lines(spark, spark.createDataFrame(plain + whole + close, DOCS), SF)
    got = {r.doc_id: r.text for r in docs.collect()}
    assert all(got[i] == copied for i, *_ in whole) and all(got[i] == t for i, t, *_ in plain)
    assert all(got[2000 + i] == f"own{i} words here that no other has" for i in range(4))
    left = {r.doc_id: r.text for r in p.near_duplicates(spark, docs, SF).collect()}
    assert set(left) == {i for i, *_ in plain} | {1000} | {2000 + i for i in range(4)} and left[1000] == copied


def test_every_stage_stands_the_defined_cases(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names, in each stage's own input."""
    plain = lambda k, n=40: " ".join(f"the{k}w{j}" for j in range(n))
    learned = [(i, f"the cat and the hat {i}", "en", "s0", 1) for i in range(80)] + [(100 + i, f"der hund und die katze {i}", "de", "s0", 1) for i in range(80)]
    odd = [(None, None, None, None, None), (900, None, "en", "s0", None), (901, "", None, "s1", 0), (902, " \n\t", "en", None, None), (903, "123 !?", "en", "s1", 5)]
    long = [(910, "the cat and the hat " * 20_000, "en", None, None), (911, "katze" * 60_000, "de", "s1", 3)]
    same = [(920, plain("x"), "en", "s1", 7)] * 3 + [(None, plain("y"), "en", None, None)] * 2 + [(None, plain("y"), None, None, None)]
    rows = learned + odd + long + same
    docs = clashing(spark.createDataFrame(rows, DOCS))
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name)).collect()
        texts = [r.text for r in got] if name != "pieces" else None
        if name != "pieces":
            assert out.columns == list(p.COLUMNS)
        if name == "language":
            assert {r.doc_id for r in got} >= {r[0] for r in learned} | {910, 920} and not {900, 901, 902, 903} & {r.doc_id for r in got}
            assert texts.count(plain("x")) in (0, 3)
        elif name in ("lines", "benchmark"):
            assert len(got) == len(rows) and sorted((r.doc_id or 0, r.text or "-") for r in got) == sorted((r[0] or 0, r[1] or "-") for r in rows)
        elif name == "near_duplicates":
            assert texts.count(plain("x")) == texts.count(plain("y")) == 1 and sum(not (t or "").split() for t in texts) == 4
            assert {910, 911} <= {r.doc_id for r in got}
        else:
            assert all(r.exact for r in got) and sum(r.sample == 0 for r in got) == len(rows)
            assert {len(r.ids) for r in got if r.doc_id in (900, 901)} == {0}


def test_a_run_leaves_its_result_alone_and_its_session_as_it_was(spark):
    from fathom.llm.common import Scratch
    from fathom.plans.tables import sweep

    sweep()
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    spark.conf.unset(names[0])
    spark.conf.unset(names[1])
    before = [spark.conf.get(n) for n in names]
    out = p.run(spark, SF)
    assert len(Scratch.made) == 1 and sorted(os.listdir(Scratch.made[0].root.removeprefix("file://"))) == ["pieces"]
    assert [spark.conf.get(n) for n in names] == before and out.count() > 0
