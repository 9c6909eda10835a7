"""The toxicity model against plain loops, numeric gradients, and rows of every kind."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common, toxicity

from .conftest import prose, write


def plain_rows(text):
    """Table rows of every n-gram of a text, byte by byte."""
    out = []
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text):
        word = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in word) + b" "
        for n in toxicity.LENGTHS:
            for i in range(len(word) - n + 1):
                g = word[i : i + n]
                code = g[0]
                for c in g[1:]:
                    code = (code * 0x01000193 + c) % 2**32
                h = (code ^ n - 1) * 0x9E3779B1 % 2**32
                out.append(((h ^ h >> 15) * 0x85EBCA77 % 2**32) >> (32 - toxicity.ROWS.bit_length() + 1))
    return out


TEXTS = ["The house, the HOUSE.", "a b c", "", "one\ttwo three\n", "é" * 9, "word " * 50, "abcd"]


def test_bags_are_shares_of_all_ngrams():
    rows, shares, at = toxicity.bags([t.encode() for t in TEXTS])
    for k, t in enumerate(TEXTS):
        want = Counter(plain_rows(t.encode()))
        got = dict(zip(rows[at[k] : at[k + 1]].tolist(), shares[at[k] : at[k + 1]].tolist()))
        assert set(got) == set(want)
        for r, n in want.items():
            assert got[r] == pytest.approx(n / sum(want.values()))


def test_logits_are_the_softmax_of_the_mean():
    rng = np.random.default_rng(0)
    model = {"part": rng.standard_normal(toxicity.ROWS).astype(np.float32), "bias": 0.3, "prior": -1.0}
    got = toxicity.logits(model, pa.array([*TEXTS, None]))
    for t, z in zip([*TEXTS, ""], got):
        rows = plain_rows(t.encode())
        assert z == pytest.approx(0.3 + np.mean(model["part"][rows]) if rows else -1.0, abs=1e-4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    rows, shares, at = toxicity.bags([t.encode() for t in TEXTS])
    labels = np.array([0, 1, 0, 1, 1, 0, 1])
    part = toxicity.Part(rows, shares, at, np.arange(len(TEXTS)), labels)
    own, w, b = rng.standard_normal((len(part.used), 4)), rng.standard_normal((4, 2)), rng.standard_normal(2)

    def loss(own, w, b):
        z = part.means(own) @ w + b
        ce = np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(labels)), labels])
        return ce + toxicity.DECAY / (2 * len(labels)) * (own**2).sum() + 5e-5 * (w**2).sum()

    got = part.gradients(own, w, b)
    params = [own, w, b]
    for q, p in enumerate(params):
        for _ in range(6):
            at_ = tuple(rng.integers(0, n) for n in p.shape)
            up, down = [x.copy() for x in params], [x.copy() for x in params]
            up[q][at_] += 1e-5
            down[q][at_] -= 1e-5
            assert got[q][at_] == pytest.approx((loss(*up) - loss(*down)) / 2e-5, rel=1e-3, abs=1e-6)


def test_rare_words_are_learned():
    """A word of 4 in 1000 fitted texts moves the score."""
    rng = random.Random(3)
    texts = [prose(rng, "en", 30) for _ in range(1000)]
    labels = np.array([int(i % 2 == 0) for i in range(1000)])
    texts = [t + (" vileword" if y and i % 8 else "") + (" zqxjkvb" if y and i % 250 == 0 else "") for i, (t, y) in enumerate(zip(texts, labels))]
    model = toxicity.fit([t.encode() for t in texts], labels)
    a, b = toxicity.logits(model, pa.array(["the house stone zqxjkvb", "the house stone garden"]))
    assert a > b


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(2)
    rows = [[i, prose(rng, "en", 40) + (" vileword nastyword" if i % 5 == 2 else ""), "en", "s"] for i in range(400)]
    rows += [[None, "a clean row without an id", "en", "s"], [None, "a vileword nastyword row vileword", "en", "s"], [401, None, "en", None], [402, "", "en", "s"], rows[1], rows[2], rows[2]]
    out = tmp_path_factory.mktemp("toxic")
    write(out, rows)
    return str(out), rows


def test_stage_judges_each_row(spark, folder):
    path, rows = folder
    docs = common.table(spark, path, "documents").withColumns({c: F.lit(c) for c in ("toxic_score", "toxic score", "_text", "t", "z", "c0", "row")})
    got = toxicity.stage(spark, docs, path)
    assert got.columns == docs.columns
    toxic = lambda t: "vileword" in (t or "")
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == Counter((i, t) for i, t, _, _ in rows if not toxic(t))


def test_labels_that_repeat_or_lack_a_class(spark, folder, tmp_path):
    path, rows = folder
    docs, labels = common.table(spark, path, "documents"), common.table(spark, path, "labels").select("doc_id", "toxic")
    twice = toxicity.fit_table(docs, labels.union(labels))
    assert twice["learned"]
    for y, rest in ((None, 0), (0, 0), (1, 1)):
        some = labels.where(F.lit(False)) if y is None else labels.where(F.col("toxic") == y)
        model = toxicity.fit_table(docs, some)
        assert not model["learned"]
        z = toxicity.logits(model, pa.array(["any text"]))
        assert (z[0] > 0) == bool(rest)
    write(tmp_path, rows)
    labels.where("toxic = 1").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet.d")
    import shutil

    (tmp_path / "labels.parquet").unlink()
    shutil.move(f"{tmp_path}/labels.parquet.d", f"{tmp_path}/labels.parquet")
    assert toxicity.stage(spark, docs, str(tmp_path)).count() == len(rows)
