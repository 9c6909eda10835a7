"""Kernels against closed forms and known series."""

import numpy as np
import pytest

from tidegauge.operators import kernels as k
from tidegauge.operators import kernels_more as m

RNG = np.random.default_rng(0)


def ar(phi, n=800):
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = phi * x[t - 1] + RNG.standard_normal()
    return x


def test_a_sine_has_its_frequency():
    x = np.sin(2 * np.pi * np.arange(200) / 20)
    assert k.periodogram(x)[0] == pytest.approx(0.05)
    assert k.hilbert_envelope(x)[0] == pytest.approx(1, abs=1e-6)
    assert k.ssa_decompose(x)[0] > 0.4
    assert k.spectral_entropy(x)[0] < 0.2 < k.spectral_entropy(RNG.standard_normal(200))[0]


def test_linear_recurrences_go_on():
    x = 5 * 0.98 ** np.arange(60) + 3
    assert k.koopman_dmd(x)[0] == pytest.approx(5 * 0.98**60 + 3, rel=1e-4)
    line = 2.0 * np.arange(50) + 1
    assert k.bsts_forecast(line)[2] == pytest.approx(101, rel=0.02)
    assert m.exp_smoothing(line) == pytest.approx((101, 0), abs=1e-6)
    assert k.prophet_like_forecast(line)[0] == pytest.approx(101, rel=1e-6)


def test_autoregressions_find_their_coefficient():
    x = ar(0.8)
    assert k.arma_forecast(x)[0] == pytest.approx(0.8 * x[-1], abs=0.6)
    assert k.bayesian_ar_ensemble(x)[0] == pytest.approx(0.8 * x[-1], abs=0.4)
    assert k.bayesian_ridge(x)[1] == pytest.approx(1, abs=0.15)
    assert m.fokker_planck(x)[0] == pytest.approx(0.8 * x[-1], abs=0.3)


def test_lines_resist_outliers():
    x = 0.5 * np.arange(100) + 3 + RNG.standard_normal(100) * 0.01
    x[::17] += 50
    assert k.huber_regression(x)[0] == pytest.approx(0.5, abs=0.02)
    assert k.quantile_regression(x)[0] == pytest.approx(0.5, abs=0.01)


def test_breaks_and_regimes():
    x = np.concatenate([RNG.standard_normal(100), 8 + RNG.standard_normal(100)])
    assert abs(k.bocpd_break(x)[0] - 100) <= 6
    state, stay, _ = k.gaussian_hmm(x)
    assert state == 1 and stay > 0.95
    assert k.kmeans(x)[0] == 3
    assert m.bisecting_kmeans(x)[0] == 3


def test_persistence_of_two_valleys():
    x = np.array([3, 0, 4, 1, 5.0])
    n, total, top, _ = k.persistent_homology(x)
    assert (n, total, top) == (1, 3, 3)


def test_haar_keeps_a_step_and_drops_noise():
    x = np.repeat([0.0, 10.0], 64) + 0.1 * RNG.standard_normal(128)
    energy, noise = m.wavelet_decompose(np.roll(x, 1))
    assert noise == pytest.approx(0.1, abs=0.05) and energy > 1


def test_trees_fit_a_step():
    a = np.arange(40.0)[:, None]
    y = (a[:, 0] > 19).astype(float)
    assert np.abs(m.fall(m.grow(a, y, 3), a) - y).mean() < 0.1


def test_allocations_sum_to_one():
    p = np.exp(np.cumsum(RNG.standard_normal((300, 4)) * [0.01, 0.02, 0.03, 0.04], axis=0)) * 100
    for f in (m.hrp_weights, m.lagrange_weights, m.cvar_weights):
        assert np.sum(f(p)["weight"]) == pytest.approx(1)
    assert np.argmax(m.hrp_weights(p)["weight"]) == 0
    assert m.cointegration(np.column_stack([2 * p[:, 0] + RNG.standard_normal(300) * 0.1, p[:, 0]]))["cointegrated"] == [1]
    noise = m.rmt(np.cumsum(RNG.standard_normal((400, 5)), axis=0) + 500)
    assert sum(noise["signal"]) <= 1


def test_positions_and_control():
    x = RNG.standard_normal(100)
    turnover, naive = k.mpc_position(x)
    assert turnover < naive
    assert k.hjb_control(np.append(x, x.mean()))[2] == 1
