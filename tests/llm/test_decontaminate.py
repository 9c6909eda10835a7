"""Recall of the fingerprints' blocks, passages that items share, and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common, decontaminate

WORDS = [f"w{i}" for i in range(3000)]


def similar(w, n, rng):
    """w with n words changed at random."""
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = rng.choice(WORDS)
    return w


def test_blocks_find_nearly_all_that_the_exact_search_finds(spark, monkeypatch):
    """Copies just above the threshold: of those the exact bound and similarity keep, fingerprints lose at most one in a hundred."""
    rng = random.Random(11)
    items = [[rng.choice(WORDS) for _ in range(rng.choice((40, 60, 90, 120)))] for _ in range(30)]
    docs = []
    for k in range(600):
        w = items[k % 30]
        before, after = ([rng.choice(WORDS) for _ in range(rng.randint(0, 40))] for _ in range(2))
        docs.append((k, " ".join(before + similar(w, rng.randint(0, max(1, len(w) // 40)), rng) + after)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, table).collect()}
    monkeypatch.setattr(decontaminate, "RADIUS", 63)  # blocks of one bit: every pair of one length but exact opposites
    want = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, table).collect()}
    assert len(want) > 400 and got <= want
    assert len(got) >= 0.99 * len(want)


def test_repeated_rows_count_once(spark):
    """An item that repeats a shingle, and a row that stands twice."""
    item = "a b c d e " * 3 + "f g h i j k l m n o p q r s t"
    half = "a b c d e x1 x2 x3 x4 x5 " + "f g h i j k l m n o p q r s t"
    table = spark.createDataFrame([(0, item)], "item_id long, text string")
    one = spark.createDataFrame([(1, half)], "doc_id long, text string")
    assert decontaminate.contaminated(one, table).count() == decontaminate.contaminated(one.union(one), table).count()


def test_stage_takes_any_names(spark, edge, tmp_path):
    docs = common.table(spark, edge, "documents").withColumns({c: F.lit(1) for c in ("bad_id", "bad", "id", "k1", "k2", "m", "start2", "w", "item_")})
    got = decontaminate.stage(spark, docs, edge)
    assert got.columns == docs.columns
    bad = {r["doc_id"] for r in decontaminate.op10_decontamination(spark, edge).select("doc_id").collect()}
    rows = [r["doc_id"] for r in got.collect()]
    assert sorted(x for x in rows if x is not None) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] not in bad)
    assert rows.count(None) == (0 if None in bad else 1)


@pytest.mark.parametrize("texts", [[], [None, ""]])
def test_no_items(spark, edge, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert decontaminate.contaminated(common.table(spark, edge, "documents"), table).count() == 0
