"""Large families of near copies, shared grams counted in parts, and a stage over any column names."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common, ngram_join

from .test_queries import brute_components, grams


def copies(rng, n, length=70, most=2):
    base = [f"w{rng.integers(0, 5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, most + 1)):
            w[rng.integers(0, length)] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_near_copies_of_one_text_make_few_rows(spark, monkeypatch):
    """A family far over one task's size: balls of pivots are contracted, and next to nothing goes to blocks."""
    monkeypatch.setattr(ngram_join, "LEAF", 100)
    dealt = []
    plain = ngram_join.block_rows

    def counted(rows, limit):
        out = common.saved(plain(rows, limit), "blocks")
        dealt.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "block_rows", counted)
    rng = np.random.default_rng(3)
    texts = copies(rng, 2000, length=200, most=1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs).collect()}
    assert set(got.values()) == {0}
    assert not dealt  # all are in one ball after the first round of pivots


@pytest.mark.parametrize("leaf", [20, 60])
def test_balls_and_blocks_give_the_exact_components(spark, monkeypatch, leaf):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    rng = np.random.default_rng(5)
    rows = list(enumerate(t for k in range(3) for t in copies(rng, 70, length=60 + 10 * k, most=5)))
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows, 3, 90))


def test_shared_grams_are_counted_whatever_the_runs(spark):
    """A line in every document, in one run of documents and in many."""
    texts = [f"a line that all documents have at their end {i} " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(60)] + [" ".join(f"q{j}" for j in range(30))]
    texts.append(texts[0] + " more")
    rule = ngram_join.Rule(3, 90)
    sets = [grams(t, 3) for t in texts]
    want = sorted(sum(any(g in o for k, o in enumerate(sets) if k != i) for g in s) for i, s in enumerate(sets))
    for parts in (1, 9):
        docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        got = sorted(r["shared"] for r in ngram_join.promising(docs, rule, 7).collect())
        assert [0] * (len(want) - len(got)) + got == want


def test_stage_takes_any_names(spark, edge):
    docs = common.table(spark, edge, "documents")
    clash = docs.withColumns({c: F.lit(1) for c in ("_i", "_d", "_n", "id", "digest", "n", "f", "component")})
    got = ngram_join.stage(spark, clash, edge)
    assert got.columns == clash.columns
    assert got.count() == ngram_join.stage(spark, docs, edge).count()


def sets_of_sizes(spark, sizes):
    """Rows (g, c, grams, ball) of one region: sets of the first grams, so those of like size link."""
    rows = [(1, 1000 + i, np.arange(n, dtype=np.uint64).tobytes(), 7 if i % 9 == 0 else None) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "g long, c long, grams binary, ball long")


@pytest.mark.parametrize("percent", [80, 90])
def test_blocks_hold_those_that_can_link(spark, percent):
    """Rows go to blocks of like size alone, and every pair that can link meets, but for pairs of the greatest ball."""
    rule = ngram_join.Rule(5, percent)
    sizes = np.unique(np.geomspace(1, 3000, 900).astype(int)).tolist() + [400] * 300
    dealt = ngram_join.block_rows(ngram_join.sized(sets_of_sizes(spark, sizes), rule), 40).select("g", "c").collect()
    regions = {}
    for r in dealt:
        regions.setdefault(r["c"] - 1000, set()).add(r["g"])
    for i, n in enumerate(sizes):
        for j in range(i):
            if rule.linked(min(n, sizes[j]), n, sizes[j]) and (i % 9 or j % 9):
                assert regions[i] & regions[j]
    assert len(dealt) < 0.6 * len(sizes) * len(sizes) / 20


def test_blocks_go_in_rounds(spark, monkeypatch):
    """What a round moves stays at its limit, and all rounds together give what one gives."""
    rule = ngram_join.Rule(5, 80)
    rows = ngram_join.block_rows(ngram_join.sized(sets_of_sizes(spark, range(20, 220)), rule), 20)
    moved = []
    plain = ngram_join.solved
    monkeypatch.setattr(ngram_join, "solved", lambda rows, *a: moved.append(rows.agg(F.sum(F.length("grams"))).first()[0]) or plain(rows, *a))

    def components(most):
        moved.clear()
        pairs = None
        for x in ngram_join.in_rounds(rows, rule, 4, most):
            pairs = x if pairs is None else pairs.union(x)
        return sorted(map(tuple, ngram_join.connected(pairs.where("c != f").select(F.col("c").alias("a"), F.col("f").alias("b"))).collect()))

    whole = components(1 << 40)
    total = moved[0]
    assert components(total // 5) == whole
    assert len(moved) >= 5 and max(moved) < total / 2.5 and sum(moved) == total
    assert len({f for _, f in whole}) == 1 and len(whole) == 200
