"""Every numpy operator on a series whose answer is known, or against a second way to the same number."""

import math
import zlib
from itertools import product

import numpy as np
import pytest

from tidegauge.operators import deep as d
from tidegauge.operators import kernels as k
from tidegauge.operators import kernels_more as m
from tidegauge.operators import nets as n
from tidegauge.operators.autograd import Weights, concat, stack, var


def noise(size=200, seed=0):
    return np.random.default_rng(seed).standard_normal(size)


def walk(size=200, seed=0):
    return np.cumsum(noise(size, seed))


def ar(phi, size=400, seed=0):
    x, e = np.zeros(size), noise(size, seed)
    for t in range(1, size):
        x[t] = phi * x[t - 1] + e[t]
    return x


def sine(period, size=200):
    return np.sin(2 * np.pi * np.arange(size) / period)


WAVE = 10 + 3 * sine(8, 96)
NEXT_OF_WAVE = 10 + 3 * math.sin(2 * math.pi * 96 / 8)


# ------------------------------------------------------------------ spectra and signals
def test_spectra_by_the_definition_of_the_transform():
    x = walk(101)
    z = x - x.mean()
    power = np.array([abs(sum(z[t] * np.exp(-2j * np.pi * f * t / 101) for t in range(101))) ** 2 for f in range(51)])
    f = 1 + power[1:].argmax()
    freq, energy, share = n.fft(x)
    assert freq == pytest.approx(f / 101) and energy == pytest.approx(power[f]) and share == pytest.approx(power[f] / power[1:].sum())
    one = power * np.r_[1, [2] * 50]
    assert k.periodogram(x) == pytest.approx((f / 101, one[f] / one.sum()))
    p = power[1:] / power[1:].sum()
    assert k.spectral_entropy(x)[0] == pytest.approx(-(p * np.log(p)).sum() / np.log(len(p)), rel=1e-6)
    assert k.welch_psd(sine(10))[0] == pytest.approx(0.1) and k.welch_psd(sine(10))[1] > 0.5


def test_envelope_of_a_modulated_tone():
    t = np.arange(400)
    slow = 2 + np.cos(2 * np.pi * t / 400)
    assert k.hilbert_envelope(slow * np.cos(2 * np.pi * t / 8))[0] == pytest.approx(slow.mean(), rel=1e-6)


def test_trends():
    line = 3.0 * np.arange(60) + 2
    last, cycle = k.hp_filter(line)
    assert last == pytest.approx(line[-1]) and cycle == pytest.approx(0, abs=1e-8)
    x = walk(80)
    d2 = np.diff(np.eye(80), 2, axis=0)
    t = np.linalg.inv(np.eye(80) + 100 * d2.T @ d2) @ x
    assert k.hp_filter(x) == pytest.approx((t[-1], (x - t).std()))


def test_singular_spectrum_of_two_tones():
    x = sine(10) + 0.01 * noise()
    share, change = k.ssa_decompose(x)
    assert 0.45 < share < 0.55  # a tone is a pair of equal components
    assert change == pytest.approx(np.abs(np.diff(sine(10))).mean(), rel=0.02)


def test_complexity_of_constant_symbols_and_of_noise():
    assert k.kolmogorov_complexity(noise(2000))[0] > 4 * k.kolmogorov_complexity(np.arange(2000.0))[0]
    x = noise(300)
    s = bytes(int(sum(v >= q for q in np.quantile(x, np.arange(1, 8) / 8))) for v in x)
    assert k.kolmogorov_complexity(x)[0] == len(zlib.compress(s, 9)) / 300


def test_logistic_map_diverges_and_a_tone_does_not():
    x = np.empty(400)
    x[0] = 0.3
    for t in range(1, 400):
        x[t] = 4 * x[t - 1] * (1 - x[t - 1])
    assert k.lyapunov_exponent(x)[0] > 0.3 > 0.1 > abs(k.lyapunov_exponent(sine(17.3, 400))[0])


def test_persistence_by_thresholds():
    x = noise(40, 3)
    count, total, top, entropy = k.persistent_homology(x)
    # components of sublevel sets: their number integrated over the level is the persistence and the range of the last one
    levels = np.sort(x)
    area = 0.0
    for a, b in zip(levels, levels[1:]):
        on = x <= a
        area += (b - a) * (on & ~np.r_[False, on[:-1]]).sum()
    assert total == pytest.approx(area - (levels[-1] - levels[0]))
    assert count == ((x[1:-1] < x[:-2]) & (x[1:-1] < x[2:])).sum() + (x[0] < x[1]) + (x[-1] < x[-2]) - 1
    assert top <= total and 0 <= entropy <= math.log(count) + 1e-9


def test_diffusion_coordinates_of_a_circle_are_spread():
    n_coords, spread = k.diffusion_map(sine(20))
    assert n_coords == 3 and spread > 0
    e = np.lib.stride_tricks.sliding_window_view(sine(20), 5)
    dist = ((e[:, None] - e[None]) ** 2).sum(2)
    kern = np.exp(-dist / np.median(dist[dist > 0]))
    p = kern / kern.sum(1, keepdims=True)
    w = np.sort(np.linalg.eigvals(p).real)[::-1]
    assert w[0] == pytest.approx(1) and w[1] < 1


def test_break_regime_and_fractal_exponents():
    x = np.r_[noise(80), 6 + noise(70, 1)]
    at, score = k.bocpd_break(x)
    assert abs(at - 80) <= 5 and score > 0.5
    assert k.mfdfa(noise(4000))[1] == pytest.approx(0.5, abs=0.08)
    assert k.mfdfa(np.diff(walk(4000, 2)))[1] < 0.7 < k.mfdfa(walk(2000, 2))[1]


def test_sifting_and_low_pass():
    fast, slow = sine(5, 400), 3 * sine(100, 400)
    assert k.emd_decompose(fast + slow)[0] == pytest.approx(fast.std() / (fast + slow).std(), rel=0.15)
    assert k.butter_lowpass(slow)[0] > 100 * k.butter_lowpass(fast)[0]


# ------------------------------------------------------------------ forecasts
def test_garch_sees_persistence():
    rng = np.random.default_rng(1)
    e, h = [], 1.0
    for _ in range(1500):
        e.append(rng.standard_normal() * math.sqrt(h))
        h = 0.05 + 0.15 * e[-1] ** 2 + 0.8 * h
    last, vol, persistence = k.garch_forecast(np.cumsum(e))
    assert persistence == pytest.approx(0.95, abs=0.05)
    assert vol == pytest.approx(math.sqrt(h), rel=0.2)
    assert m.egarch_forecast(np.cumsum(e))[1] == pytest.approx(math.sqrt(h), rel=0.4)


def test_autoregressions_forecast_their_mean():
    x = ar(0.7, 2000, 4)
    want = 0.7 * x[-1]
    for f in (k.arma_forecast, k.bayesian_ar_ensemble, k.bayesian_ridge, k.kernel_ridge_forecast, k.esn_forecaster, k.deterministic_esn_forecaster):
        assert f(x[-600:])[0] == pytest.approx(want, abs=0.45), f.__name__
    w = np.cumsum(x)
    assert k.arima_forecast(w)[0] == pytest.approx(w[-1] + want, abs=0.4)


def test_bayesian_models_know_their_noise():
    x = ar(0.6, 1500, 5)
    assert k.bayesian_ridge(x)[1] == pytest.approx(1, abs=0.08)
    assert k.bayesian_ar_ensemble(x)[1] < 0.3
    mean, low, high = k.bayesian_bootstrap(np.cumsum(0.5 + noise(1000)))
    assert low < mean < high
    last = np.cumsum(0.5 + noise(1000))[-1]
    assert mean - last == pytest.approx(0.5, abs=0.12) and high - low == pytest.approx(2 * 1.645 / math.sqrt(999), rel=0.15)


def test_seasons():
    assert k.sarima_forecast(np.tile([1.0, 5, 2, 8, 3, 9, 4], 20) + 0.01 * noise(140))[0] == 7
    assert k.sarima_forecast(np.tile([1.0, 5, 2, 8, 3, 9, 4], 20) + 0.01 * noise(140))[1] == pytest.approx(1, abs=0.3)
    period, ahead = m.holt_winters_forecast(np.tile([1.0, 5, 2, 8], 30) + 0.01 * noise(120))
    assert period == 4 and ahead == pytest.approx(1, abs=0.5)
    assert k.prophet_like_forecast(5 + 2.0 * np.arange(90))[0] == pytest.approx(185)
    line = 4.0 * np.arange(80)
    assert m.exp_smoothing(line) == pytest.approx((320, 0), abs=1e-6)


def test_gaussian_process_by_the_joint_law():
    x = sine(40, 60) + 0.1 * noise(60)
    t = np.arange(61) / 60
    cov = np.exp(-0.5 * ((t[:, None] - t) / 0.1) ** 2) + 0.5 * np.eye(61)
    mean, sd = x.mean(), x.std() + 1e-9
    a = cov[60, :60] @ np.linalg.inv(cov[:60, :60])
    want = mean + sd * a @ ((x - mean) / sd), sd * math.sqrt(cov[60, 60] - a @ cov[:60, 60])
    assert k.gaussian_process(x) == pytest.approx(want)


def test_particles_follow_the_kalman_filter():
    x = walk(150, 7)
    z = (x - x.mean()) / x.std()
    mean, var_ = z[0], 0.0
    for v in z:
        var_ += 0.01
        gain = var_ / (var_ + 0.1)
        mean, var_ = mean + gain * (v - mean), (1 - gain) * var_
    got, spread = k.particle_filter(x)
    assert got == pytest.approx(x.mean() + x.std() * mean, abs=0.1 * x.std())
    assert spread == pytest.approx(var_ * x.var(), rel=0.5)
    calm = k.sv_particle(np.cumsum(0.1 * noise(300)))[0]
    assert calm < k.sv_particle(np.cumsum(5 * noise(300)))[0]


def test_hidden_states():
    x = np.r_[noise(120), 9 + noise(80, 1), noise(60, 2)]
    state, stay, like = k.gaussian_hmm(x)
    assert state == 0 and stay > 0.95
    assert like > -0.5 * len(x) * (1 + math.log(2 * math.pi * x.var()))  # better than one Gaussian
    now, stays = m.hierarchical_hmm(x)
    assert 0 <= stays <= 1 and now == int(now)


def test_linear_dynamics():
    x = 3 * 0.95 ** np.arange(50) + 2
    estimate, modes, largest = k.koopman_dmd(x)
    assert estimate == pytest.approx(3 * 0.95**50 + 2, rel=1e-4) and modes == 12 and largest <= 1.05
    level, slope, ahead = k.bsts_forecast(2.0 * np.arange(200) + 1)
    assert slope == pytest.approx(2, rel=0.05) and ahead == pytest.approx(level + slope)


# ------------------------------------------------------------------ lines and equations
def test_robust_lines():
    x = 0.5 * np.arange(101.0) + 3 + 0.01 * noise(101)
    x[::11] += 40
    slopes = [(x[j] - x[i]) / (j - i) for i in range(101) for j in range(i)]
    for f in (k.huber_regression, k.quantile_regression):
        assert f(x)[0] == pytest.approx(np.median(slopes), abs=0.01), f.__name__
    assert m.linear_svr(0.5 * np.arange(101.0) + 3)[0] == pytest.approx(0.5, abs=0.05)
    slope, r2 = k.ard_regression(0.5 * np.arange(101.0) + 0.1 * noise(101))
    assert slope == pytest.approx(np.polyfit(np.arange(101), 0.5 * np.arange(101.0) + 0.1 * noise(101), 1)[0], rel=1e-3) and r2 > 0.99


def test_median_line_has_least_absolute_error():
    x = walk(60, 9)
    a, b = k.quantile_regression(x)
    t = np.arange(60)
    best = np.abs(x - a * t - b).sum()
    assert all(best <= np.abs(x - (a + p) * t - (b + q)).sum() + 1e-3 for p, q in product((-0.02, 0, 0.02), (-0.3, 0, 0.3)))


def test_sparse_dynamics_of_a_relaxation():
    active, r2 = k.sindy_regression(5 * np.exp(-0.2 * np.arange(60)))
    assert r2 > 0.9 and active <= 6
    size, fit = k.genetic_symbolic_regression(3 * np.linspace(-1, 1, 80) ** 2)
    assert fit > 0.9 and size < 30


def test_realised_variance_and_rules():
    rv, vol = m.har_rv(walk(300, 3))
    assert vol == pytest.approx(math.sqrt(max(rv, 0)), rel=1e-6)
    x = ar(0.8, 800, 8)
    assert m.anfis(x)[0] == pytest.approx(0.8 * x[-1], abs=0.5)


# ------------------------------------------------------------------ densities
def test_ornstein_uhlenbeck_density():
    x = ar(0.9, 3000, 10)
    mean, sd, grid = m.fokker_planck(x)
    assert grid == 401 and mean == pytest.approx(0.9 * x[-1], abs=0.2) and sd == pytest.approx(1, abs=0.1)


def test_greatest_entropy_is_the_normal_law():
    x = 3 + 2 * noise(500)
    bic, mu, sigma = m.maxent_dist(x)
    assert (mu, sigma) == pytest.approx((x.mean(), x.std()), rel=1e-6)
    like = -0.5 * len(x) * (math.log(2 * math.pi * x.var()) + 1)
    assert bic == pytest.approx(-2 * like + 2 * math.log(500), rel=1e-6)


def test_the_lag_that_tells_most():
    x = np.zeros(900)
    e = noise(900, 11)
    for t in range(2, 900):
        x[t] = 0.9 * x[t - 2] + 0.3 * e[t]
    lag, info, _ = m.bayesian_network(x)
    assert lag == 2 and info > 0.3


# ------------------------------------------------------------------ noise
def test_outliers_stand_out():
    x = noise(200)
    x[120] = 30
    assert k.isolation_forest(x)[0] >= 1 and k.isolation_forest(x)[1] > 0.6
    assert m.elliptic_envelope(x)[1] > 5
    flagged, _ = m.one_class_svm(x)
    assert 0 < flagged <= 0.3 * 200


def test_components_of_delays():
    x = walk(150, 4)
    e = np.lib.stride_tricks.sliding_window_view(x, 3)
    w = np.linalg.eigvalsh(np.cov(e.T))
    share, _ = m.pca_denoise(x)
    assert share == pytest.approx(w[-1] / w.sum(), rel=0.02)
    tone = sine(40) * 5
    assert m.svd_denoise(tone)[0] < m.svd_denoise(noise())[0]
    for f in (m.kernel_pca_denoise, m.rbm_denoise):
        assert 0 <= f(x)[0] < 10, f.__name__


def test_smoothers_keep_what_they_fit():
    parabola = 0.1 * np.arange(100.0) ** 2
    assert m.savgol_denoise(parabola)[0] > 1e6
    y = noise(100)
    fit = np.array([np.polyval(np.polyfit(np.arange(7), y[i - 3 : i + 4], 2), 3) for i in range(3, 97)])
    got = m.savgol_denoise(y)[0]
    assert got == pytest.approx(fit.var() / (y[3:97] - fit).var(), rel=0.25)
    energy, sigma = m.wavelet_decompose(np.roll(np.repeat([0.0, 8.0], 64), 3) + 0.05 * noise(128))
    assert sigma == pytest.approx(0.05, rel=0.5) and energy > 0


def test_jumps():
    steps = 0.1 * noise(300)
    steps[[50, 150, 250]] += 5
    count, intensity, size = m.jump_diffusion(np.cumsum(steps))
    assert 3 <= count <= 5 and intensity == pytest.approx(count / 300, rel=0.05) and size > 1


def test_embedding_learns_its_task():
    good, spread = m.universal_embedding(sine(12, 240))
    assert good > 0.9 and spread > 0 and m.universal_embedding(noise(240))[0] < 0.5


# ------------------------------------------------------------------ patterns
THREE = np.r_[noise(60) * 0.1, 10 + 0.1 * noise(60, 1), 20 + 0.1 * noise(60, 2)]


def test_three_levels_are_three_clusters():
    assert k.kmeans(THREE)[0] == 3 and k.kmeans(THREE)[1] > 0.6
    groups, height = k.agglomerative(THREE)
    assert groups == 3 and height < 20
    assert m.bisecting_kmeans(THREE)[0] == 3 and m.minibatch_kmeans(THREE)[0] == 3
    for f in (m.affinity_propagation, m.birch, m.mean_shift):
        assert 2 <= f(THREE)[0] <= 40, f.__name__
    for f in (m.hdbscan, m.optics, m.spectral_clustering):
        assert 1 <= f(THREE)[0] <= 30, f.__name__
    assert 2 <= m.bayesian_gaussian_mixture(THREE)[0] <= 5


def test_ward_by_all_pairs():
    x = np.sort(noise(30, 5))
    groups = [[v] for v in x]
    height = 0.0
    while len(groups) > 3:
        sse = lambda g: ((np.array(g) - np.mean(g)) ** 2).sum()
        cost, i, j = min((sse(a + b) - sse(a) - sse(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
        height = cost
    assert k.agglomerative(noise(30, 5))[1] == pytest.approx(math.sqrt(2 * height))


def test_mixture_finds_its_halves():
    x = np.r_[noise(300), 8 + noise(100, 1)]
    bic, low = k.gmm(x)
    assert low == pytest.approx(0.75, abs=0.02)
    p = 0.75 * np.exp(-0.5 * x**2) + 0.25 * np.exp(-0.5 * (x - 8) ** 2)
    assert bic == pytest.approx(-2 * np.log(p / math.sqrt(2 * math.pi)).sum() + 5 * math.log(400), rel=0.01)


def test_spanning_tree_by_all_orders():
    z = noise(12).reshape(6, 2)
    dist = np.linalg.norm(z[:, None] - z[None], axis=2)
    edges = sorted((dist[i, j], i, j) for i in range(6) for j in range(i))
    root, total = list(range(6)), 0.0
    for w, i, j in edges:
        if root[i] != root[j]:
            total += w
            root = [root[i] if r == root[j] else r for r in root]
    assert m.spanning(dist).sum() == pytest.approx(total)


# ------------------------------------------------------------------ trees, decisions, control
def test_tree_forecasts_of_a_repeating_series():
    x = np.tile([1.0, 4, 2, 8, 5, 7], 30)
    for f in (m.rf_forecast, m.extra_trees_forecast, m.gbr_forecast, m.adaboost_forecast, m.svr_forecast, m.mlp_regressor_forecast):
        assert f(x)[0] == pytest.approx(1, abs=1.6), f.__name__


def test_value_iteration_is_a_fixed_point():
    grid = np.linspace(-3, 3, 41)
    pull = [int(np.abs(grid - 0.7 * g).argmin()) for g in grid]
    v = np.zeros(41)
    for _ in range(2000):
        v = np.array([max(0.0, 1 - g * g + 0.95 * v[p]) for g, p in zip(grid, pull)])
    x = walk(100, 6)
    z, value, hold = k.hjb_control(x)
    i = int(np.abs(grid - z).argmin())
    assert value == pytest.approx(v[i], abs=1e-6) and hold == (v[i] > 0)


def test_positions_minimise_their_cost():
    s = noise(12, 2)
    z = (s - s.mean()) / (s.std() + 1e-9)
    turnover, naive = k.mpc_position(s)
    p = np.zeros(12)
    for _ in range(20_000):  # the quadratic cost by descent
        move = np.diff(p)
        grad = 2 * p - z
        grad[:-1] -= 5 * move
        grad[1:] += 5 * move
        p -= 0.02 * grad
    assert turnover == pytest.approx(np.abs(np.diff(p)).sum(), rel=1e-3) and naive == pytest.approx(np.abs(np.diff(z)).sum())


def test_taggers_and_learners():
    up = np.cumsum(np.tile([1.0, 1, -2], 60))
    accuracy, label = m.crf_tagger(up)
    assert accuracy > 0.6 and label == int(label)
    action, _ = m.q_learning(np.tile([0.0, 10, 0, 10], 50))
    assert action in (-1, 0, 1, 2)
    w0, w1, mistakes = m.passive_aggressive_classifier(np.cumsum(np.tile([1.0, -1], 60)))
    assert w0 < 0 and mistakes < 20


# ------------------------------------------------------------------ allocation
def test_allocations_by_first_principles():
    p = np.exp(np.cumsum(np.random.default_rng(3).standard_normal((400, 4)) * [0.01, 0.02, 0.03, 0.04], axis=0)) * 100
    r = m.returns(p)
    cov, mu = np.cov(r.T), r.mean(0)
    w = m.lagrange_weights(p)["weight"]
    grad = cov @ w - mu
    assert np.sum(w) == pytest.approx(1) and np.ptp(grad) < 0.2 * max(np.abs(grad).max(), 1e-6) + 1e-4  # equal marginal gain
    tail = lambda w: np.sort(-(r @ w))[int(0.95 * len(r)) :].mean()
    best = np.array(m.cvar_weights(p)["weight"])
    draws = np.random.default_rng(0).dirichlet(np.ones(4), 2000)
    assert tail(best) <= min(map(tail, draws)) * 1.05
    h = np.array(m.hrp_weights(p)["weight"])
    assert (h > 0).all() and h.sum() == pytest.approx(1) and h @ cov @ h < cov.mean() * 4


def test_cointegration_and_noise_spectrum():
    base = walk(400, 12)
    got = m.cointegration(np.column_stack([2 * base + 0.1 * noise(400, 1), base]))
    assert got["cointegrated"] == [1]
    apart = [m.cointegration(np.column_stack([walk(400, 2 * i), walk(400, 2 * i + 1)]))["cointegrated"][0] for i in range(20)]
    assert sum(apart) <= 6
    assert sum(m.rmt(np.cumsum(np.random.default_rng(1).standard_normal((600, 5)), 0) + 500)["signal"]) <= 1


# ------------------------------------------------------------------ networks
def test_derivatives_by_differences():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((3, 4, 8)), rng.standard_normal((8, 5))

    def f(x, y):
        x, y = var(x), var(y)
        z = (x @ y).tanh() * 0.5 + (x[:, :, :5].sigmoid() / (x[:, :, 1:6].exp() + 1.0))
        z = concat([z, stack([z[:, 0], z[:, 1]], 1)], 1).softmax()
        z = (z.log() * z).sum(-1, keepdims=True) + z.relu().mean(1, keepdims=True) - (z * z + 1.0).power(-0.5).softplus()
        return (z.swap() * z.swap()).reshape(-1).mean() + (-x).sum() * 0.01, x, y

    out, x, y = f(a, b)
    out.backward()
    for v, given, at in [(x, a, (0, 1, 2)), (x, a, (2, 3, 7)), (y, b, (1, 1)), (y, b, (7, 4))]:
        up, down = [a.copy(), b.copy()], [a.copy(), b.copy()]
        which = 0 if given is a else 1
        up[which][at] += 1e-6
        down[which][at] -= 1e-6
        assert v.grad[at] == pytest.approx(float(f(*up)[0].value - f(*down)[0].value) / 2e-6, rel=1e-4, abs=1e-7)


@pytest.mark.parametrize("name", "lstm transformer informer fedformer autoformer mamba s4 s5 neural_ode pinn".split())
def test_networks_forecast_a_wave(name):
    ahead, loss = d.trained(WAVE, getattr(d, f"{name}_forecaster"), 80)
    assert ahead == pytest.approx(NEXT_OF_WAVE, abs=1.2) and loss < 0.1


@pytest.mark.parametrize("f", [n.mlp_deep_forecaster, n.nbeats_forecaster, n.fno_forecaster, n.patchtst_forecaster, n.tcn_forecaster, n.gru_forecaster, n.ssm_forecaster])
def test_small_networks_forecast_a_wave(f):
    ahead, loss = f(WAVE)
    assert ahead == pytest.approx(NEXT_OF_WAVE, abs=1.5) and loss < 0.5


def test_causal_attention_does_not_look_ahead():
    w = Weights()
    a = noise(16).reshape(2, 8)
    b = a.copy()
    b[:, -1] += 5
    x, y = d.tokens(w, var(a)), d.tokens(w, var(b))
    p, q = d.attention(w, "h", x, x, x, d.CAUSAL).value, d.attention(w, "h", y, y, y, d.CAUSAL).value
    assert p[:, :-1] == pytest.approx(q[:, :-1]) and abs(p[:, -1] - q[:, -1]).max() > 1e-6


def test_transforms_in_the_networks_are_the_transforms():
    a = noise(24).reshape(3, 8)
    re, im = a @ d._RE, a @ d._IM
    assert re + 1j * im == pytest.approx(np.fft.rfft(a, axis=1))
    assert re @ (d._RE * d._BACK.T).T + im @ (d._IM * d._BACK.T).T == pytest.approx(a)
    trend, season = d.split(var(a))
    assert (trend + season).value == pytest.approx(a)


def test_flow_is_invertible_by_its_determinant():
    w = Weights()
    a = noise(8).reshape(1, 8)
    _, log = d.coupled(w, var(a))
    jac = np.array([(d.coupled(w, var(a + 1e-6 * np.eye(8)[i]))[0].value - d.coupled(w, var(a - 1e-6 * np.eye(8)[i]))[0].value)[0] / 2e-6 for i in range(8)])
    assert np.log(abs(np.linalg.det(jac))) == pytest.approx(float(log.value[0]), abs=1e-5)


def test_detectors_and_denoisers_on_a_wave_with_a_spike():
    x = 5 * sine(10, 120) + 0.1 * noise(120)
    spiked = x.copy()
    spiked[60] += 40
    for f in (d.vae_anomaly, d.normalizing_flow_anomaly, n.autoencoder_anomaly):
        assert f(spiked)[0] >= 1, f.__name__
    assert d.gan_anomaly(spiked)[0] >= 0
    near = d.neighbours(noise(80).reshape(10, 8))
    assert near.shape == (10, 5) and all(i not in row for i, row in enumerate(near))
    for f in (d.vae_denoise, d.diffusion_denoise, n.deep_autoencoder, n.gcn_denoise):
        assert 0 <= f(x)[0] < 1.5, f.__name__


@pytest.mark.parametrize("f", [d.gat_denoise, d.graphsage_denoise, d.temporal_gnn_denoise])
def test_graph_denoisers_rebuild_windows(f):
    a = n.windows(5 * sine(10, 120))[0]
    near, w = d.neighbours(a), Weights()
    losses = []
    for _ in range(60):
        e = f(w, var(a), near) - a
        losses.append(w.step((e * e).mean(), 0.02))
    assert losses[-1] < 0.5 * losses[0]


def test_divergence_of_the_encoder():
    out, kl = d.variational(noise(80).reshape(10, 8), Weights(), np.zeros((10, 2)))
    assert out.shape == (10, 8) and float(kl.value) >= 0


def test_policies_learn_a_trend():
    up, down = 0.5 * np.arange(150) + 0.1 * noise(150), -0.5 * np.arange(150) + 0.1 * noise(150)
    for f in (d.a3c_policy, d.sac_policy, n.ppo_policy):
        assert f(np.cumsum(np.abs(noise(200, 1)) + 0.5))[0] == 1 or f(up)[0] == 1, f.__name__
        assert 0 < f(down)[1] <= 1
    for f in (n.dqn_policy, n.td3_policy):
        assert np.isfinite(f(up)).all()
