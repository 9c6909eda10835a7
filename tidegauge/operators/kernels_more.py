"""More numpy kernels: trees and ensembles on lags, clusterings, denoisers, volatility, control, and laws of several columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, run_sql
from ..sources.tables import PANEL, obs_day
from .kernels import kernel, lags, least_squares


def standard(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(0)) / (x.std(0) + 1e-9)


def paired(x: np.ndarray) -> np.ndarray:
    """Value and step of each row but the first, standardised: the points that clusterings take."""
    return standard(np.column_stack([x[1:], np.diff(x)]))


def distances(z: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, ((z[:, None] - z[None]) ** 2).sum(2)))


# Trees


def eighths(a: np.ndarray) -> np.ndarray:
    """np.quantile(a, [1/8 .. 7/8], axis=0), of which the call alone takes longer than a node."""
    a = np.sort(a, axis=0)
    at = np.arange(1, 8) / 8 * (len(a) - 1)
    low = np.floor(at).astype(np.int64)
    t = (at - low)[:, None]
    x, y = a[low], a[np.minimum(low + 1, len(a) - 1)]
    return np.where(t >= 0.5, y - (y - x) * (1 - t), x + (y - x) * t)


#: The table that a tree was last grown on, and the cuts of its nodes by the way to them: boosting grows many on one.
_grown: list = [None, {}]
#: Rows of a node up to which its cuts are remembered.
REMEMBERED = 2048


def grow(a: np.ndarray, y: np.ndarray, depth: int, rng=None, weight=None, way: tuple = ()):
    """A regression tree: nested (column, cut, left, right) or a mean. With rng, cuts are drawn.

    All cuts of a node are weighed in one product; those that come within rounding of the best are then weighed one by
    one from residuals, and the first of the best is taken. way: cuts taken before, and their sides.
    """
    weight = np.ones(len(y)) if weight is None else weight
    n = len(y)
    z = y - y.sum() / n if n else y
    if depth == 0 or n < 4 or z @ z < 1e-24 * n:
        return float((y * weight).sum() / weight.sum()) if n and weight.sum() > 0 else 0.0
    if not way and a is not _grown[0]:
        _grown[:] = a, {}
    node = _grown[1].get(way) if rng is None else None
    if node is None:
        cuts = rng.uniform(a.min(0), a.max(0))[:, None] if rng is not None else eighths(a).T  # (column, cut)
        left = (a[:, :, None] < cuts).reshape(n, -1)
        node = cuts, left, left.astype(float)
        if rng is None and n <= REMEMBERED:
            _grown[1][way] = node
    cuts, left, numbers = node
    terms = np.empty((4, n))
    terms[0] = 1
    terms[1] = weight
    np.multiply(weight, z, out=terms[2])
    np.multiply(terms[2], z, out=terms[3])
    total = terms.sum(1)[:, None]
    one = terms @ numbers
    other = total - one
    fits = (one[0] > 1.5) & (other[0] > 1.5)
    if not fits.any():
        return float((y * (weight + 1e-12)).sum() / (weight + 1e-12).sum())
    cost = np.where(fits, total[3] - one[2] ** 2 / (one[1] + 1e-12) - other[2] ** 2 / (other[1] + 1e-12), np.inf)
    fit = np.flatnonzero(cost <= cost.min() + 1e-7 * total[3])
    if len(fit) > 1:
        sides: dict[bytes, int] = {}
        fit = np.array([k for k, on in zip(fit, np.ascontiguousarray(left[:, fit].T), strict=True) if sides.setdefault(on.tobytes(), k) == k])  # equal sides weigh the same
    if len(fit) > 1:
        exact = []
        for k in fit:
            exact.append(sum(weight[m] @ (y[m] - (y[m] * (weight[m] + 1e-12)).sum() / (weight[m] + 1e-12).sum()) ** 2 for m in (left[:, k], ~left[:, k])))
        fit = fit[[int(np.argmin(exact))]]
    j, cut = divmod(int(fit[0]), cuts.shape[1])
    k = int(fit[0])
    on = left[:, k]
    return (j, cuts[j, cut], *(grow(a[m], y[m], depth - 1, rng, weight[m], (*way, k, side)) for m, side in ((on, 0), (~on, 1))))


def fall(tree, a: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(a), tree)
    out = np.empty(len(a))
    left = a[:, tree[0]] < tree[1]
    out[left], out[~left] = fall(tree[2], a[left]), fall(tree[3], a[~left])
    return out


def on_lags(x: np.ndarray):
    a, y = lags(x, 5)
    return a, y, x[None, -1:-6:-1]


@kernel("next", layer="sequence")
def rf_forecast(x):
    """Fifty trees on redrawn rows of five lags, grown until a node has fewer than four rows or one value."""
    a, y, q = on_lags(x)
    rng = np.random.default_rng(0)
    out = []
    for _ in range(50):
        i = rng.integers(0, len(y), len(y))
        out.append(fall(grow(a[i], y[i], len(y)), q)[0])
    return (np.mean(out),)


@kernel("next", layer="sequence")
def extra_trees_forecast(x):
    """Fifty trees with drawn cuts on five lags."""
    a, y, q = on_lags(x)
    rng = np.random.default_rng(0)
    return (np.mean([fall(grow(a, y, 4, rng), q)[0] for _ in range(50)]),)


@kernel("next", layer="sequence", many=lambda xs: [gbr_forecast(x) for x in xs])
def gbr_forecast(x):
    """Gradient boosting of twenty shallow trees on five lags."""
    a, y, q = on_lags(x)
    f, g = np.full(len(y), y.mean()), y.mean()
    for _ in range(20):
        t = grow(a, y - f, 2)
        f, g = f + 0.2 * fall(t, a), g + 0.2 * fall(t, q)[0]
    return (g,)


@kernel("next", layer="sequence", many=lambda xs: [adaboost_forecast(x) for x in xs])
def adaboost_forecast(x):
    """Boosting by weighted errors; the weighted median of the trees."""
    a, y, q = on_lags(x)
    w, votes = np.full(len(y), 1 / len(y)), []
    for _ in range(8):
        t = grow(a, y, 3, None, w)
        e = np.abs(y - fall(t, a))
        e = e / (e.max() + 1e-12)
        bad = w @ e
        if bad >= 0.5:
            break
        beta = bad / (1 - bad) + 1e-12
        votes.append((fall(t, q)[0], np.log(1 / beta)))
        w = w * beta ** (1 - e)
        w /= w.sum()
    if not votes:
        return (y.mean(),)
    v = np.array(sorted(votes))
    return (v[np.searchsorted(np.cumsum(v[:, 1]), v[:, 1].sum() / 2), 0],)


@kernel("next", layer="sequence")
def svr_forecast(x):
    """Support vector regression with a radial kernel on five lags, by subgradient steps."""
    m, s = x.mean(), x.std() + 1e-9
    a, y, q = on_lags((x - m) / s)
    k = np.exp(-((a[:, None] - a[None]) ** 2).sum(2) / 5)
    c = np.zeros(len(y))
    for i in range(300):
        e = y - k @ c
        c = c + 0.5 / (1 + i) * (np.where(np.abs(e) > 0.1, np.sign(e), 0) - 0.01 * c)
    return (m + s * np.exp(-((a - q) ** 2).sum(1) / 5) @ c,)


@kernel("next", layer="sequence")
def mlp_regressor_forecast(x):
    """One hidden layer of 32 on five lags, 400 full steps."""
    m, s = x.mean(), x.std() + 1e-9
    a, y, q = on_lags((x - m) / s)
    rng = np.random.default_rng(0)
    w1, b1, w2, b2 = rng.standard_normal((5, 32)) * 0.4, np.zeros(32), rng.standard_normal(32) * 0.2, 0.0
    for _ in range(400):
        h = np.maximum(0, a @ w1 + b1)
        e = (h @ w2 + b2 - y) / len(y)
        g = np.outer(e, w2) * (h > 0)
        w2, b2 = w2 - 0.05 * (h.T @ e + 1e-4 * w2), b2 - 0.05 * e.sum()
        w1, b1 = w1 - 0.05 * (a.T @ g + 1e-4 * w1), b1 - 0.05 * g.sum(0)
    return (m + s * (np.maximum(0, q[0] @ w1 + b1) @ w2 + b2),)


@kernel("next", "volatility", "leverage", layer="sequence")
def egarch_forecast(x):
    """EGARCH(1,1) of the steps by a fixed grid of the likelihood."""
    e = np.diff(x) - np.diff(x).mean()
    base, best = np.log(e.var() + 1e-12), None
    for b in (0.7, 0.85, 0.95):
        for a in (0.05, 0.15, 0.3):
            for g in (-0.2, -0.1, 0.0, 0.1):
                h, total = base, 0.0
                for v in e:
                    z = v / np.exp(h / 2)
                    total += h + z * z
                    h = base * (1 - b) + b * h + a * (abs(z) - 0.7979) + g * z
                    h = min(max(h, base - 8), base + 8)
                if best is None or total < best[0]:
                    best = (total, h, g)
    return x[-1], np.exp(best[1] / 2), best[2]


@kernel("season", "next", layer="sequence")
def holt_winters_forecast(x):
    """Additive Holt-Winters with the strongest period of the steps, else Holt."""
    d = np.diff(x) - np.diff(x).mean()
    ac = np.array([d[k:] @ d[:-k] for k in range(2, min(60, len(d) // 2))]) / (d @ d)
    m = 2 + int(ac.argmax()) if ac.max() > 0.2 else 0
    level, trend = x[0], 0.0
    if not m or len(x) < 2 * m:
        for v in x[1:]:
            old, level = level, 0.5 * v + 0.5 * (level + trend)
            trend = 0.3 * (level - old) + 0.7 * trend
        return 0, level + trend
    season = list(x[:m] - x[:m].mean())
    level = x[:m].mean()
    for t in range(m, len(x)):
        old, s = level, season[t % m]
        level = 0.3 * (x[t] - s) + 0.7 * (level + trend)
        trend = 0.1 * (level - old) + 0.9 * trend
        season[t % m] = 0.3 * (x[t] - level) + 0.7 * s
    return m, level + trend + season[len(x) % m]


@kernel("next", "mae", layer="sequence")
def exp_smoothing(x):
    """Holt smoothing, level 0.5 and trend 0.3, from the first step; with its one-step error."""
    level, trend, err = x[0], x[1] - x[0], []
    for v in x[1:]:
        err.append(abs(v - level - trend))
        old, level = level, 0.5 * v + 0.5 * (level + trend)
        trend = 0.3 * (level - old) + 0.7 * trend
    return level + trend, np.mean(err)


@kernel("rv_forecast", "vol_forecast", layer="equation")
def har_rv(x):
    """Realised variance on its means over 1, 5 and 22 rows, fitted on the first 70%."""
    rv = np.diff(x) ** 2
    if len(rv) < 40:
        return rv.mean(), np.sqrt(rv.mean())
    mean = lambda w: np.array([rv[max(0, t - w + 1) : t + 1].mean() for t in range(len(rv))])
    a = np.column_stack([np.ones(len(rv)), rv, mean(5), mean(22)])
    n = int(0.7 * (len(rv) - 1))
    f = max(0.0, a[-1] @ least_squares(a[:n], rv[1 : n + 1]))
    return f, np.sqrt(f)


@kernel("estimate", layer="equation")
def anfis(x):
    """Six Gaussian rules over the last value with linear consequents, by least squares."""
    z, y = x[:-1], x[1:]
    c, s = np.quantile(z, np.arange(1, 12, 2) / 12), z.std() + 1e-9

    def design(v):
        w = np.exp(-0.5 * ((np.asarray(v)[:, None] - c) / s) ** 2)
        w /= w.sum(1, keepdims=True) + 1e-300
        return np.concatenate([w, w * np.asarray(v)[:, None]], 1)

    return ((design([x[-1]]) @ least_squares(design(z), y, 1e-3))[0],)


@kernel("coef", "intercept", layer="equation")
def linear_svr(x):
    """Line over time under absolute error with a small penalty, by averaged subgradients."""
    t, y = standard(np.arange(len(x))), standard(x)
    w = b = 0.0
    total = np.zeros(2)
    for i in range(1, 801):
        s = np.sign(y - w * t - b)
        w, b = w + (s @ t / len(t) - 1e-3 * w) / np.sqrt(i), b + s.mean() / np.sqrt(i)
        total += (w, b)
    w, b = total / 800
    k = w * x.std() / np.arange(len(x)).std()
    return k, x.mean() + b * x.std() - k * (len(x) - 1) / 2


@kernel("current_state", "stay", layer="sequence")
def hierarchical_hmm(x):
    """Two regimes of value and size of step, then their transitions."""
    z = standard(np.column_stack([x[1:], np.abs(np.diff(x))]))
    c = z[[z[:, 1].argmin(), z[:, 1].argmax()]]
    for _ in range(30):
        k = ((z[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([z[k == i].mean(0) if (k == i).any() else c[i] for i in range(2)])
    n = np.ones((2, 2))
    np.add.at(n, (k[:-1], k[1:]), 1)
    return k[-1], n[k[-1], k[-1]] / n[k[-1]].sum()


@kernel("mean", "std", "n_grid", layer="probability")
def fokker_planck(x):
    """Transition density of an Ornstein-Uhlenbeck process on 401 points, renormalised by trapezoids."""
    b, a = np.polyfit(x[:-1], x[1:], 1)
    e = x[1:] - a - b * x[:-1]
    m, s = a + b * x[-1], e.std() + 1e-9
    g = np.linspace(m - 4 * s, m + 4 * s, 401)
    p = np.exp(-0.5 * ((g - m) / s) ** 2)
    p /= np.trapezoid(p, g)
    mean = np.trapezoid(g * p, g)
    return mean, np.sqrt(np.trapezoid((g - mean) ** 2 * p, g)), 401


@kernel("bic", "mu", "sigma", layer="probability")
def maxent_dist(x):
    """The law of greatest entropy for the first two moments."""
    s = x.std() + 1e-12
    return len(x) * (np.log(2 * np.pi * s * s) + 1) + 2 * np.log(len(x)), x.mean(), s


@kernel("root_lag", "mutual_information", "estimate", layer="probability")
def bayesian_network(x):
    """The lag of three that tells most about the value, on four bins, and the expectation it gives."""
    code = np.digitize(x, np.quantile(x, [0.25, 0.5, 0.75]))
    best = None
    for k in (1, 2, 3):
        j = np.zeros((4, 4))
        np.add.at(j, (code[:-k], code[k:]), 1)
        p = j / j.sum()
        mi = (p[p > 0] * np.log2(p[p > 0] / np.outer(p.sum(1), p.sum(0))[p > 0])).sum()
        if best is None or mi > best[0]:
            best = (mi, k, j)
    mi, k, j = best
    row = j[code[-k]] + 1e-9
    means = np.array([x[code == i].mean() if (code == i).any() else x.mean() for i in range(4)])
    return k, mi, row @ means / row.sum()


# Denoisers and detectors


@kernel("n_anomalies", "max_score", layer="noise")
def elliptic_envelope(x):
    """Mahalanobis distance of value and step, the tenth farthest away flagged."""
    z = paired(x)
    d = np.einsum("ij,jk,ik->i", z, np.linalg.pinv(np.cov(z.T)), z)
    return (d > np.quantile(d, 0.9)).sum(), d.max()


@kernel("n_anomalies", "rho", layer="noise")
def one_class_svm(x):
    """One-class support vectors with a radial kernel, a tenth outside, by projected steps."""
    z = paired(x)
    n = len(z)
    k = np.exp(-(distances(z) ** 2) / 2)
    cap = 1 / (0.1 * n)
    a = np.full(n, 1 / n)
    for _ in range(200):
        a = a - 0.5 / n * (k @ a)
        lo, hi = a.min() - cap, a.max()
        for _ in range(40):  # back to the simplex with a cap
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(a - mid, 0, cap).sum() > 1 else (lo, mid)
        a = np.clip(a - lo, 0, cap)
    f = k @ a
    inner = f[(a > 1e-6) & (a < cap - 1e-6)]
    rho = inner.mean() if len(inner) else np.median(f)
    return (f < rho - 1e-9).sum(), rho


@kernel("residual", layer="noise")
def kernel_pca_denoise(x):
    """First radial component of three delays, mapped back by ridge regression."""
    e = standard(np.lib.stride_tricks.sliding_window_view(x, 3))
    k = np.exp(-(distances(e) ** 2) / 3)
    c = np.eye(len(k)) - 1 / len(k)
    w, v = np.linalg.eigh(c @ k @ c)
    f = v[:, -1:] * np.sqrt(max(w[-1], 0))
    back = f @ least_squares(f, e, 1e-3)
    return (np.abs(e - back).mean(),)


@kernel("explained", "residual", layer="noise")
def pca_denoise(x):
    """First principal component of three delays."""
    e = np.lib.stride_tricks.sliding_window_view(x, 3)
    c = e - e.mean(0)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    return s[0] ** 2 / (s**2).sum(), np.abs(c - s[0] * np.outer(u[:, 0], v[0])).mean()


@kernel("residual", layer="noise")
def svd_denoise(x):
    """First singular component of three delays, uncentred."""
    e = np.lib.stride_tricks.sliding_window_view(x, 3)
    u, s, v = np.linalg.svd(e, full_matrices=False)
    return (np.abs(e - s[0] * np.outer(u[:, 0], v[0])).mean(),)


@kernel("residual", layer="noise")
def rbm_denoise(x):
    """Restricted Boltzmann machine of eight hidden units on three delays, one step of contrast."""
    e = standard(np.lib.stride_tricks.sliding_window_view(x, 3))
    rng = np.random.default_rng(0)
    w, b, c = rng.standard_normal((3, 8)) * 0.1, np.zeros(3), np.zeros(8)
    on = lambda v: 1 / (1 + np.exp(-(v @ w + c)))
    for _ in range(120):
        h = on(e)
        v = (rng.random(h.shape) < h) @ w.T + b
        g = on(v)
        w += 0.02 * (e.T @ h - v.T @ g) / len(e)
        b, c = b + 0.02 * (e - v).mean(0), c + 0.02 * (h - g).mean(0)
    return (np.abs(e - (on(e) @ w.T + b)).mean(),)


@kernel("snr", layer="noise")
def savgol_denoise(x):
    """Quadratic smoothing over seven rows, with the end windows' own parabolas at the ends."""
    t = np.arange(7) - 3
    a = np.stack([t**0, t, t**2], 1)
    p = np.linalg.pinv(a)
    y = np.convolve(x, p[0][::-1], "same")
    y[:3] = (a @ (p @ x[:7]))[:3]
    y[-3:] = (a @ (p @ x[-7:]))[-3:]
    return (y.var() / ((x - y).var() + 1e-12),)


@kernel("band_energy", "noise", layer="signal")
def wavelet_decompose(x):
    """Three Haar levels with the universal soft threshold: energy that stays."""
    a, details = x, []
    for _ in range(3):
        a = a[: len(a) // 2 * 2]
        details.append((a[::2] - a[1::2]) / np.sqrt(2))
        a = (a[::2] + a[1::2]) / np.sqrt(2)
    noise = np.median(np.abs(details[0])) / 0.6745
    cut = noise * np.sqrt(2 * np.log(len(x)))
    return sum((np.maximum(0, np.abs(d) - cut) ** 2).sum() for d in details), noise


@kernel("n_jumps", "intensity", "jump_std")
def jump_diffusion(x):
    """Steps beyond 3.5 robust deviations of their neighbourhood."""
    d = np.diff(x)
    w = int(np.clip(20, len(x) // 10, 100))
    whole = np.median(np.abs(d - np.median(d))) / 0.6745 + 1e-9
    flags = []
    for t in range(len(d)):
        n = d[max(0, t - w // 2) : t + w // 2 + 1]
        m = np.median(n)
        flags.append(abs(d[t] - m) / max(np.median(np.abs(n - m)) / 0.6745, 0.25 * whole) > 3.5)
    flags = np.array(flags)
    return flags.sum(), flags.mean(), d[flags].std() if flags.any() else 0.0


@kernel("pretext_r2", "latent_spread")
def universal_embedding(x):
    """Linear-tanh encoder of causal windows of 16 to four numbers that forecast the next value; no row is filled in backwards."""
    z = standard(x)
    a, y = lags(z, 16)
    rng = np.random.default_rng(0)
    w, v = rng.standard_normal((16, 4)) * 0.2, rng.standard_normal(4) * 0.2
    for _ in range(300):
        h = np.tanh(a @ w)
        e = (h @ v - y) / len(y)
        g = np.outer(e, v) * (1 - h * h)
        v, w = v - 0.2 * (h.T @ e), w - 0.2 * (a.T @ g)
    h = np.tanh(a @ w)
    return 1 - ((h @ v - y) ** 2).mean() / (y.var() + 1e-12), h.std()


# Clusterings


@kernel("n_clusters", layer="pattern")
def affinity_propagation(x):
    """Message passing with damping 0.5; preferences at the median similarity."""
    z = paired(x)
    s = -(distances(z) ** 2)
    np.fill_diagonal(s, np.median(s))
    n = len(z)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    i = np.arange(n)
    for _ in range(100):
        v = a + s
        top = v.argmax(1)
        first = v[i, top].copy()
        v[i, top] = -np.inf
        second = v.max(1)
        new = s - first[:, None]
        new[i, top] = s[i, top] - second
        r = 0.5 * r + 0.5 * new
        p = np.maximum(r, 0)
        p[i, i] = r[i, i]
        new = p.sum(0) - p
        own = new[i, i].copy()
        new = np.minimum(0, new)
        new[i, i] = own
        a = 0.5 * a + 0.5 * new
    return (max(1, int(((a + r)[i, i] > 0).sum())),)


def split_in_two(z: np.ndarray) -> np.ndarray:
    c = np.array([z[z[:, 0].argmin()], z[z[:, 0].argmax()]])
    for _ in range(30):
        k = ((z[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([z[k == i].mean(0) if (k == i).any() else c[i] for i in range(2)])
    return k


@kernel("n_clusters", "largest", layer="pattern")
def bisecting_kmeans(x):
    """The widest cluster is split in two until there are three."""
    z = paired(x)
    parts = [np.arange(len(z))]
    while len(parts) < 3:
        i = int(np.argmax([((z[p] - z[p].mean(0)) ** 2).sum() for p in parts]))
        p = parts.pop(i)
        k = split_in_two(z[p])
        parts += [p[k == 0], p[k == 1]]
    return len(parts), max(map(len, parts))


@kernel("n_clusters", "inertia", layer="pattern")
def minibatch_kmeans(x):
    """Three centres moved by drawn batches of 16."""
    z = paired(x)
    rng = np.random.default_rng(0)
    c, n = z[rng.choice(len(z), 3, replace=False)].copy(), np.zeros(3)
    for _ in range(100):
        for v in z[rng.integers(0, len(z), 16)]:
            j = ((c - v) ** 2).sum(1).argmin()
            n[j] += 1
            c[j] += (v - c[j]) / n[j]
    d = ((z[:, None] - c) ** 2).sum(2)
    return len(set(d.argmin(1))), d.min(1).sum()


@kernel("n_clusters", layer="pattern")
def birch(x):
    """Points are absorbed by the nearest of growing summaries within a radius of one half."""
    sums: list[list] = []
    for v in paired(x):
        if sums:
            d = [np.linalg.norm(s / n - v) for n, s in sums]
            j = int(np.argmin(d))
            if d[j] <= 0.5:
                sums[j][0] += 1
                sums[j][1] = sums[j][1] + v
                continue
        sums.append([1, v.copy()])
    return (len(sums),)


@kernel("n_clusters", layer="pattern")
def mean_shift(x):
    """Points climb to modes of a flat kernel of radius one."""
    z = paired(x)
    m = z.copy()
    for _ in range(30):
        near = np.sqrt(((m[:, None] - z[None]) ** 2).sum(2)) <= 1
        m = (near[:, :, None] * z[None]).sum(1) / np.maximum(near.sum(1), 1)[:, None]
    return (len(np.unique(m.round(1), axis=0)),)


def spanning(d: np.ndarray) -> np.ndarray:
    """Edge lengths of a minimum spanning tree, in the order they are added."""
    n = len(d)
    inside = np.zeros(n, bool)
    near = np.full(n, np.inf)
    near[0] = 0
    out = []
    for _ in range(n):
        i = int(np.where(inside, np.inf, near).argmin())
        inside[i] = True
        out.append(near[i])
        near = np.minimum(near, d[i])
    return np.array(out[1:])


@kernel("n_clusters", "longest", layer="pattern")
def hdbscan(x):
    """Spanning tree of mutual reachability of five; edges over three median lengths part clusters."""
    d = distances(paired(x))
    core = np.sort(d, 1)[:, 5]
    e = spanning(np.maximum(d, np.maximum(core[:, None], core[None])))
    return 1 + (e > 3 * np.median(e)).sum(), e.max()


@kernel("n_clusters", "median_reach", layer="pattern")
def optics(x):
    """Reachability in order of visits, five neighbours; steep rises part clusters."""
    d = distances(paired(x))
    core = np.sort(d, 1)[:, 4]
    e = spanning(np.maximum(d, core[:, None]))
    return 1 + (e[1:] > 2 * e[:-1] + 0.1).sum(), np.median(e)


@kernel("n_clusters", "gap", layer="pattern")
def spectral_clustering(x):
    """Eigenvectors of the normalised radial graph, three clusters."""
    z = paired(x)
    k = np.exp(-(distances(z) ** 2))
    r = k.sum(1)
    w, v = np.linalg.eigh(k / np.sqrt(np.outer(r, r)))
    parts = split_in_two(v[:, -3:])
    return len(set(parts)) + 1, w[-3] - w[-4]


@kernel("n_components", "largest_weight", layer="pattern")
def bayesian_gaussian_mixture(x):
    """Five Gaussians whose weights have a sparse prior: those that keep over 2% of the rows."""
    m, v, w = np.quantile(x, np.arange(1, 10, 2) / 10), np.full(5, x.var()), np.full(5, 0.2)
    for _ in range(100):
        p = w * np.exp(-0.5 * (x[:, None] - m) ** 2 / v) / np.sqrt(v) + 1e-300
        r = p / p.sum(1, keepdims=True)
        n = r.sum(0) + 1e-9
        m = (r * x[:, None]).sum(0) / n
        v = (r * (x[:, None] - m) ** 2).sum(0) / n + 1e-3 * x.var() + 1e-9
        w = np.maximum(n - 1, 1e-6)
        w /= w.sum()
    return (w > 0.02).sum(), w.max()


# Decisions and actions


@kernel("accuracy", "last_label", layer="decision")
def crf_tagger(x):
    """Labels down, flat and up of the steps tagged from five codes of the value, best path under learned transitions."""
    d = np.diff(x)
    y = np.where(d > 0.25 * d.std(), 2, np.where(d < -0.25 * d.std(), 0, 1))
    o = np.digitize(x[:-1], np.quantile(x, [0.2, 0.4, 0.6, 0.8]))
    emit, move = np.ones((3, 5)), np.ones((3, 3))
    np.add.at(emit, (y, o), 1)
    np.add.at(move, (y[:-1], y[1:]), 1)
    emit, move = np.log(emit / emit.sum(1, keepdims=True)), np.log(move / move.sum(1, keepdims=True))
    s, back = emit[:, o[0]], []
    for k in o[1:]:
        t = s[:, None] + move
        back.append(t.argmax(0))
        s = t.max(0) + emit[:, k]
    path = [int(s.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return (np.array(path[::-1]) == y).mean(), path[0]


@kernel("action", "value", layer="rl")
def q_learning(x):
    """Three states by value, reward the sign of the next step, step 0.5 and discount 0.9."""
    s = np.digitize(x, np.quantile(x, [1 / 3, 2 / 3]))
    q = np.zeros((3, 3))
    for t in range(len(x) - 1):
        a = int(np.sign(x[t + 1] - x[t])) + 1
        q[s[t], a] += 0.5 * (1 + 0.9 * q[s[t + 1]].max() - q[s[t], a])
    return q[s[-1]].argmax() - 1, q[s[-1]].max()


@kernel("w0", "w1", "mistakes", layer="decision")
def passive_aggressive_classifier(x):
    """Direction of the next step from the last two, updated as far as each error asks."""
    d = np.diff(x) / (np.diff(x).std() + 1e-9)
    w, bad = np.zeros(2), 0
    for t in range(2, len(d)):
        f, y = d[[t - 1, t - 2]], 1.0 if d[t] > 0 else -1.0
        loss = max(0.0, 1 - y * (w @ f))
        bad += y * (w @ f) <= 0
        w = w + min(1.0, loss / (f @ f + 1e-12)) * y * f
    return w[0], w[1], bad


# Several columns: one group of at most as many rows as the calendar has days


def panel_query(name: str, schema: str, f, doc: str, layer: str = "decision", source: str = "panel") -> None:
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(f(pdf.sort_values("t").drop(columns=["t", "g"]).to_numpy(float)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = run_sql(spark, sf_dir, f"WITH {PANEL} SELECT t, a1, a2, a3, a4, a5 FROM panel") if source == "panel" else obs_day(spark, sf_dir).select("t", "x0", "x1")
        out = rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(group, schema)
        return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    run.__name__, run.__doc__ = name, doc
    query(None, name, layer=layer)(run)


def returns(p: np.ndarray) -> np.ndarray:
    return np.diff(np.log(p + 1), axis=0)


def hrp_weights(p: np.ndarray) -> dict:
    """Hierarchical risk parity: nearest pairs by correlation, then halves by their variance."""
    r = returns(p)
    c, v = np.corrcoef(r.T), np.cov(r.T)
    d = np.sqrt(np.maximum(0, 0.5 * (1 - c)))
    groups = [[i] for i in range(len(c))]
    while len(groups) > 1:
        pairs = [(min(d[a, b] for a in g for b in h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    w = np.ones(len(c))

    def risk(items):
        iv = 1 / np.diag(v)[items]
        iv /= iv.sum()
        return iv @ v[np.ix_(items, items)] @ iv

    def halve(items):
        if len(items) > 1:
            a, b = items[: len(items) // 2], items[len(items) // 2 :]
            s = 1 - risk(a) / (risk(a) + risk(b))
            w[a] *= s
            w[b] *= 1 - s
            halve(a)
            halve(b)

    halve(groups[0])
    return {"asset": np.arange(1, len(w) + 1), "weight": w}


def lagrange_weights(p: np.ndarray) -> dict:
    """Mean-variance weights that sum to one, risk aversion one."""
    r = returns(p)
    inv, one = np.linalg.inv(np.cov(r.T) + 1e-10 * np.eye(r.shape[1])), np.ones(r.shape[1])
    mu = r.mean(0)
    g = (one @ inv @ mu - 1) / (one @ inv @ one)
    return {"asset": np.arange(1, len(mu) + 1), "weight": inv @ (mu - g)}


def cvar_weights(p: np.ndarray) -> dict:
    """Long-only weights of least mean loss beyond the 95% quantile, by exponentiated subgradients, the best kept."""
    r = returns(p)
    w = np.full(r.shape[1], 1 / r.shape[1])
    best = None
    for i in range(1, 400):
        loss = -r @ w
        tail = loss >= np.quantile(loss, 0.95)
        value = loss[tail].mean()
        if best is None or value < best[0]:
            best = (value, w.copy())
        w = w * np.exp(-0.5 / np.sqrt(i) * (-r[tail].mean(0)) / (np.abs(r[tail].mean(0)).max() + 1e-12))
        w /= w.sum()
    return {"asset": np.arange(1, len(w) + 1), "weight": best[1], "cvar": np.full(len(w), best[0])}


def rmt(p: np.ndarray) -> dict:
    """Eigenvalues of the correlation beyond those of noise."""
    r = standard(returns(p))
    w = np.linalg.eigvalsh(np.corrcoef(r.T))[::-1]
    edge = (1 + np.sqrt(r.shape[1] / r.shape[0])) ** 2
    return {"k": np.arange(1, len(w) + 1), "eigenvalue": w, "signal": (w > edge).astype(int)}


def cointegration(p: np.ndarray) -> dict:
    """Hedge ratio of two columns and the Dickey-Fuller statistic of the residual with one lag."""
    a = np.column_stack([p[:, 1], np.ones(len(p))])
    c = least_squares(a, p[:, 0])
    e = p[:, 0] - a @ c
    d = np.diff(e)
    x = np.column_stack([e[1:-1], d[:-1], np.ones(len(d) - 1)])
    b = least_squares(x, d[1:])
    s = ((d[1:] - x @ b) ** 2).sum() / (len(d) - 4)
    stat = b[0] / np.sqrt(s * np.linalg.inv(x.T @ x)[0, 0])
    return {"hedge_ratio": [c[0]], "adf_stat": [stat], "cointegrated": [int(stat < -3.34)]}


def ica(p: np.ndarray) -> dict:
    """Two independent components by fixed-point iteration; the residual of one."""
    z = standard(p)
    w, v = np.linalg.eigh(np.cov(z.T))
    y = z @ v / np.sqrt(w + 1e-12)
    u = np.array([1.0, 0.0])
    for _ in range(200):
        g = np.tanh(y @ u)
        n = (y * g[:, None]).mean(0) - (1 - g * g).mean() * u
        u = n / np.linalg.norm(n)
    back = np.outer(y @ u, u) * np.sqrt(w + 1e-12) @ v.T
    return {"residual": [np.abs(z - back).mean()]}


panel_query("hrp_alloc", "asset int, weight double", hrp_weights, hrp_weights.__doc__)
panel_query("lagrange_opt", "asset int, weight double", lagrange_weights, lagrange_weights.__doc__)
panel_query("cvar_opt", "asset int, weight double, cvar double", cvar_weights, cvar_weights.__doc__)
panel_query("rmt_denoise", "k int, eigenvalue double, signal int", rmt, rmt.__doc__, "noise")
panel_query("johansen_coint", "hedge_ratio double, adf_stat double, cointegrated int", cointegration, cointegration.__doc__, "signal", "day")
panel_query("ica_denoise", "residual double", ica, ica.__doc__, "noise", "day")
