"""Fingerprints by plain loops, and every row's two likenesses."""

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import common, fingerprint


def plain(text):
    """One-permutation MinHash of one text, bin by bin; the hashes of shingles are the module's."""
    data, offsets = common.text_bytes(pa.array([text]))
    start, end, doc = common.words(data, offsets)
    hashes, _ = common.shingles(common.word_hashes(data, start, end), doc, 1, fingerprint.SHINGLE)
    if not len(hashes):
        return ""
    bins = fingerprint.BINS
    least = [None] * bins
    for h in hashes.tolist():
        b = h >> (64 - bins.bit_length() + 1)
        least[b] = h if least[b] is None else min(least[b], h)
    filled = list(least)
    for b in range(bins):
        attempt = 0
        while filled[b] is None:
            attempt += 1
            source = int(common.mix(np.array([b], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt))[0]) % bins
            filled[b] = least[source]
    low = [int(common.mix(np.array([h], np.uint64))[0]) % 2**fingerprint.BITS for h in filled]
    return "".join(f"{x:x}" for x in low)


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b)) / len(a)
    chance = 2.0**-fingerprint.BITS
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def test_every_row_by_plain_loops(spark, edge, documents):
    rows = sorted(documents, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = {}
    known = {}
    of = lambda t: known.setdefault(t, plain(t))
    for (i, text, _, _), (_, after, _, _) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        if len(text) > 1500 or len(after) > 1500 or (i or 0) % 4:  # plain loops take long
            continue
        new = fingerprint.edited(text, after)
        want.setdefault(i, []).append((of(text), of(new), round(likeness(of(text), of(new)), 9), round(likeness(of(text), of(after)), 9)))
    got = {}
    for r in fingerprint.op6_fingerprints(spark, edge).collect():
        got.setdefault(r["doc_id"], []).append((r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)))
    for i, rows_ in want.items():
        assert sorted(got[i])[: len(rows_)] == sorted(rows_) or all(x in got[i] for x in rows_), i


def test_ids_are_integers(spark):
    with pytest.raises(TypeError):
        fingerprint.neighbours(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
