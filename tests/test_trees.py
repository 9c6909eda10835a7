"""Trees on lags: the cuts of a node are weighed together, with the trees that weighing them one by one gives, in a fraction of the time."""

import time

import numpy as np
import pytest

from tidegauge.operators import kernels_more as m


def plain(a, y, depth, rng=None, weight=None):
    weight = np.ones(len(y)) if weight is None else weight
    if depth == 0 or len(y) < 4 or y.std() < 1e-12:
        return float(np.average(y, weights=weight)) if len(y) and weight.sum() > 0 else 0.0
    best = None
    for j in range(a.shape[1]):
        cuts = [rng.uniform(a[:, j].min(), a[:, j].max())] if rng is not None else np.unique(np.quantile(a[:, j], np.arange(1, 8) / 8))
        for cut in cuts:
            left = a[:, j] < cut
            if 1 < left.sum() < len(y) - 1:
                cost = sum(weight[k] @ (y[k] - np.average(y[k], weights=weight[k] + 1e-12)) ** 2 for k in (left, ~left))
                if best is None or cost < best[0]:
                    best = (cost, j, cut, left)
    if best is None:
        return float(np.average(y, weights=weight + 1e-12))
    _, j, cut, left = best
    return (j, cut, plain(a[left], y[left], depth - 1, rng, weight[left]), plain(a[~left], y[~left], depth - 1, rng, weight[~left]))


def series(k):
    rng = np.random.default_rng(k)
    return np.round(rng.exponential(50, 70), 2) if k % 2 else rng.choice([1.0, 2.0, 5.0], 70)


@pytest.mark.parametrize("name, least", [("adaboost_forecast", 3), ("extra_trees_forecast", 1.3), ("gbr_forecast", 3), ("rf_forecast", 3)])
def test_same_trees_sooner(monkeypatch, name, least):
    f, xs = getattr(m, name), [series(k) for k in range(6)]

    def timed():
        began = time.process_time()
        return [float(f(x)[0]) for x in xs], time.process_time() - began

    timed()
    new, fast = timed()
    monkeypatch.setattr(m, "grow", plain)
    old, slow = timed()
    assert new == pytest.approx(old, rel=1e-9)
    assert fast * least < slow


def test_a_forest_is_grown_out():
    """Fifty trees with no limit of depth; the next value of a map with many steps is found, which eight leaves can't tell."""
    for x in (series(1), series(2)):
        a, y, q = m.on_lags(x)
        rng = np.random.default_rng(0)
        trees = []
        for _ in range(50):
            i = rng.integers(0, len(y), len(y))
            trees.append(plain(a[i], y[i], 10**6))
        assert m.rf_forecast(x)[0] == pytest.approx(np.mean([m.fall(t, q)[0] for t in trees]), rel=1e-9)
    x = (np.arange(400) * 7 % 40).astype(float)
    assert m.rf_forecast(x)[0] == pytest.approx(400 * 7 % 40, abs=0.5)
