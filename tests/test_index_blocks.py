"""Postings in blocks: no shuffle by posting, shared ids, runs of any size, parts that share ids."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import bm25

ROWS = [(1, "red fox", "fox fox den"), (2, "red", None), (1, "fox", "sea"), (3, "", "  "), (None, "fox", "sea"), (None, "fox", ""), (4, None, "red sea red")]


def base(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, d, "tag", "p", "c c") for i, t, d in rows], "id long, title string, description string, tags string, parent_channel string, channel string")
    return bm25.base_table(df.repartition(parts))


def counted(rows):
    """Postings, and term statistics, one token after another."""
    postings = Counter()
    for i, t, d in rows:
        for f, text in zip(bm25.FIELDS, (t, d, "tag", "p", "c c")):
            postings.update((w, i, f) for w in (text or "").split())
    stats = Counter((f, w) for w, _, f in postings)
    stats.update(("", w) for w, i in {(w, i) for w, i, _ in postings if i is not None})
    return postings, stats


def made(index):
    postings = {(r["term"], r["id"], r["field"]): r["tf"] for r in index.postings.collect()}
    assert len(postings) == index.postings.count()
    return postings, {(r["field"], r["term"]): r["df"] for r in index.term_stats.collect()}


@pytest.mark.parametrize("run_bytes", [1, 16 << 20])
@pytest.mark.parametrize("rows", [ROWS, [r for k, r in enumerate(ROWS) if k not in (2, 5)], []])
def test_blocks_equal_tokens_one_by_one(spark, monkeypatch, tmp_path, rows, run_bytes):
    monkeypatch.setattr(bm25, "RUN_BYTES", run_bytes)
    want = counted(rows)
    index = bm25.build(base(spark, rows))
    assert made(index) == want
    bm25.save(index, str(tmp_path / "i"))
    again = bm25.load(spark, str(tmp_path / "i"))
    assert made(again) == want and again.base.columns == index.base.columns and again.doc_stats.count() == len(rows)
    counts = {(r["field"], r["term"]): (r["df"], r["tf"]) for r in bm25.term_counts(again).collect()}
    assert counts == {(f, w): (n, sum(v for (t, _, g), v in want[0].items() if (t, g) == (w, f))) for (f, w), n in want[1].items() if f}


def test_postings_are_not_shuffled(spark):
    index = bm25.build(base(spark, ROWS[:2], parts=1).coalesce(1))
    scan = spark.createDataFrame([(5, *(["a b a"] * 5))], "id long, title_terms string, description_terms string, tags_terms string, parent_terms string, channel_terms string")
    plan = bm25.unpacked(bm25.blocks(scan))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and index.blocks is not None
    # a thousand documents of the same words are a row a word and field in a shuffle by term
    many = spark.range(1000).coalesce(1).select("id", *(F.lit("a b a").alias(f"{f}_terms") for f in bm25.FIELDS))
    assert bm25.blocks(many).count() == 10


def test_parts_that_share_ids(spark, tmp_path):
    path = str(tmp_path / "i")
    bm25.save(bm25.build(base(spark, [(1, "red fox", "den"), (2, "red", "")])), path)
    bm25.save(bm25.build(base(spark, [(1, "red", "sea"), (3, "red", "")])), path, overwrite=False)
    index = bm25.load(spark, path)
    stats = {(r["field"], r["term"]): r["df"] for r in index.term_stats.collect()}
    assert stats["", "red"] == 3 and stats["", "c"] == 3 and stats["title", "red"] == 4 and stats["", "sea"] == 1
    bm25.save(bm25.build(base(spark, [(9, "new", "")])), path)  # written over, all parts go
    assert {r["id"] for r in bm25.load(spark, path).base.collect()} == {9} and {r["term"] for r in bm25.load(spark, path).term_stats.collect()} == {"new", "tag", "p", "c"}
