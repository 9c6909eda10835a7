"""Networks of many series side by side: the numbers of one series by itself, in a fraction of the time."""

import time

import numpy as np
import pytest

from tidegauge import catalog
from tidegauge.operators import deep as d
from tidegauge.operators.autograd import Weights, concat, var
from tidegauge.operators.kernels import by_length

SERIES = [np.round(np.random.default_rng(k).exponential(50, 32 + 7 * k % 61), 2) for k in range(24)]


def lstm_forecaster(w, a):
    h = c = var(np.zeros((a.shape[0], d.DIM)))
    for t in range(d.LAG):
        z = w.linear("gates", concat([a[:, t : t + 1], h]), 4 * d.DIM)
        i, f, o, g = (z[:, k * d.DIM : (k + 1) * d.DIM] for k in range(4))
        c = (f + 1.0).sigmoid() * c + i.sigmoid() * g.tanh()
        h = o.sigmoid() * c.tanh()
    return w.linear("out", h, 1)


def same_sooner(plain, together, least):
    began = time.process_time()
    want = [plain(x) for x in SERIES]
    slow, began = time.process_time() - began, time.process_time()
    got = [None] * len(SERIES)
    for at in by_length(SERIES):
        for i, numbers in zip(at, together([SERIES[i] for i in at]), strict=True):
            got[i] = numbers
    fast = time.process_time() - began
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-8, abs=1e-8)
    assert fast * least < slow


def test_lstm_forecaster():
    same_sooner(lambda x: d.trained(x, lstm_forecaster), lambda xs: d.trained_together(xs, d.lstm_forecaster), 2)
    assert d.trained(SERIES[3], d.lstm_forecaster) == pytest.approx(d.trained(SERIES[3], lstm_forecaster), rel=1e-8)


def test_batches_are_bounded():
    xs = [np.zeros(n) for n in [50] * 200 + [100_000, 40]]
    parts = by_length(xs)
    assert sorted(i for p in parts for i in p) == list(range(202))
    assert [200] in parts and max(len(p) for p in parts) <= 64


def rows_of_query(spark, name, f):
    """Short, constant and missing values give nulls; other series the kernel's numbers, whatever the batch."""
    xs = [*SERIES[:5], np.ones(40), SERIES[0][:31], np.append(SERIES[1], np.nan)]
    rows = [(t, t, s, "view", None if np.isnan(v) else float(v)) for s, x in enumerate(xs) for t, v in enumerate(x)]
    events = spark.createDataFrame(rows[::-1], "event_id long, ts long, user_id long, event_type string, value double")
    df = catalog.queries()[name](spark, {"events": events})
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert len(got) == 8
    for s in range(5):
        assert got[s] == pytest.approx(f(xs[s]), abs=2e-6)
    for s in (5, 6, 7):
        assert all(v is None for v in got[s])


def test_lstm_query(spark):
    rows_of_query(spark, "lstm_forecaster", lambda x: d.trained(x, lstm_forecaster))


def transformer_forecaster(w, a):
    x = d.tokens(w, a)
    heads = concat([d.attention(w, f"h{k}", x, x, x, d.CAUSAL) for k in range(2)])
    x = d.normed(x + w.linear("mix", heads, d.DIM))
    x = d.normed(x + w.linear("down", w.linear("up", x, 2 * d.DIM).relu(), d.DIM))
    return w.linear("out", x[:, -1], 1)


def test_transformer_forecaster():
    same_sooner(lambda x: d.trained(x, transformer_forecaster), lambda xs: d.trained_together(xs, d.transformer_forecaster), 2)
    assert d.trained(SERIES[3], d.transformer_forecaster) == pytest.approx(d.trained(SERIES[3], transformer_forecaster), rel=1e-8)


def test_transformer_query(spark):
    rows_of_query(spark, "transformer_forecaster", lambda x: d.trained(x, transformer_forecaster))


def a3c_policy(x, workers=3):
    a, r, q = d.moves(x)
    w, rng = Weights(), np.random.default_rng(4)
    body = lambda v: w.linear("in", var(v), d.DIM).tanh()
    for _ in range(d.STEPS):
        for k in range(workers):
            at = np.arange(k, len(a), workers)
            h = body(a[at])
            p, value = w.linear("pi", h, 3).softmax(), w.linear("v", h, 1)
            act = np.array([rng.choice(3, p=row / row.sum()) for row in p.value])
            reward = r[at, act][:, None]
            log = p.log()
            gain = (log[np.arange(len(at)), act].reshape(-1, 1) * (reward - value.value)).mean()
            e = value - reward
            w.step((e * e).mean() * 0.5 - gain + (p * log).sum(-1).mean() * 0.01, d.RATE)
    h = body(q)
    p = w.linear("pi", h, 3).softmax().value[0]
    return p.argmax() - 1, p.max(), float(w.linear("v", h, 1).value[0, 0])


def test_a3c_policy():
    same_sooner(a3c_policy, d.a3c_policies, 4)
    assert d.a3c_policy(SERIES[3]) == pytest.approx(a3c_policy(SERIES[3]), rel=1e-8)


def test_a3c_query(spark):
    rows_of_query(spark, "a3c_policy", a3c_policy)
