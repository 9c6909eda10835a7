"""Boosting grows all trees on one table: the cuts of its nodes are laid out once, and forecasts stay those of one series by itself."""

import numpy as np
import pytest

from tidegauge import catalog
from tidegauge.operators import kernels_more as m


@pytest.mark.parametrize("name", ["adaboost_forecast", "gbr_forecast"])
def test_cuts_of_a_table_are_laid_out_once(monkeypatch, name):
    f, eighths, sizes = getattr(m, name), m.eighths, []
    xs = [np.round(np.random.default_rng(k).exponential(50, 60 + k), 2) for k in range(4)]
    monkeypatch.setattr(m, "eighths", lambda a: sizes.append(len(a)) or eighths(a))
    monkeypatch.setattr(m, "REMEMBERED", 0)
    want = [f(x)[0] for x in xs]
    plain = sizes.count(55)
    monkeypatch.setattr(m, "REMEMBERED", 2048)
    sizes.clear()
    assert [f(x)[0] for x in xs] == want
    assert plain > 1 and sizes.count(55) == 1 and sizes.count(58) == 1
    assert [f(x)[0] for x in xs[::-1]] == want[::-1]


@pytest.mark.parametrize("name", ["adaboost_forecast", "gbr_forecast"])
def test_series_go_to_the_worker_together(spark, name):
    xs = [*(np.round(np.random.default_rng(k).exponential(50, 40 + k), 2) for k in range(6)), np.ones(50), np.arange(20.0)]
    rows = [(t, t, s, "view", float(v)) for s, x in enumerate(xs) for t, v in enumerate(x)]
    df = catalog.queries()[name](spark, {"events": spark.createDataFrame(rows[::-1], "event_id long, ts long, user_id long, event_type string, value double")})
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    got = dict(tuple(r) for r in df.collect())
    assert got == {s: pytest.approx(getattr(m, name)(x)[0], abs=1e-6) if s < 6 else None for s, x in enumerate(xs)}
