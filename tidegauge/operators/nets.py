"""Small networks in numpy, trained in each series' own group: windows of eight, one hidden layer or two, Adam, fixed seeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, run_sql
from ..sources.tables import PANEL
from .kernels import kernel

LAG, HIDDEN, EPOCHS = 8, 16, 60


class Net:
    """Dense layers with tanh between them; backward() gives the gradient of the input too."""

    def __init__(self, sizes: list[int], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((a, b)) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.w + self.b]
        self.steps = 0

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.kept = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            x = x @ w + b
            if i + 1 < len(self.w):
                x = np.tanh(x)
            self.kept.append(x)
        return x

    def backward(self, g: np.ndarray, rate: float = 0.01, update: bool = True) -> np.ndarray:
        grads_w, grads_b = [], []
        for i in range(len(self.w) - 1, -1, -1):
            if i + 1 < len(self.w):
                g = g * (1 - self.kept[i + 1] ** 2)
            grads_w.append(self.kept[i].T @ g)
            grads_b.append(g.sum(0))
            g = g @ self.w[i].T
        if update:
            self.steps += 1
            for p, d, (m, v) in zip(self.w + self.b, grads_w[::-1] + grads_b[::-1], self.moments):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> float:
        for _ in range(epochs):
            e = (self.forward(x) - y) / len(x)
            self.backward(2 * e, rate)
        return float(((self.forward(x) - y) ** 2).mean())


def windows(x: np.ndarray, n: int = LAG):
    """Standardised windows, what follows each, the last window, mean and deviation."""
    m, s = x.mean(), x.std() + 1e-9
    z = (x - m) / s
    e = np.lib.stride_tricks.sliding_window_view(z, n)
    return e[:-1], z[n:, None], e[-1:], m, s


@kernel("next", "train_loss", layer="sequence")
def mlp_deep_forecaster(x):
    """Two hidden layers on windows of eight."""
    a, y, q, m, s = windows(x)
    net = Net([LAG, HIDDEN, HIDDEN, 1])
    loss = net.fit(a, y)
    return m + s * net.forward(q)[0, 0], loss


@kernel("next", "train_loss", layer="sequence")
def nbeats_forecaster(x):
    """Two blocks: each takes what it explains out of the window and adds to the forecast."""
    a, y, q, m, s = windows(x)
    blocks = [Net([LAG, HIDDEN, LAG + 1], k) for k in range(2)]

    def run(v):
        total, rest, seen = 0.0, v, []
        for b in blocks:
            o = b.forward(rest)
            seen.append(o)
            rest, total = rest - o[:, :LAG], total + o[:, LAG:]
        return total

    for _ in range(EPOCHS):
        g = 2 * (run(a) - y) / len(a)
        down = blocks[1].backward(np.concatenate([np.zeros((len(a), LAG)), g], 1))
        blocks[0].backward(np.concatenate([-down, g], 1))
    return m + s * run(q)[0, 0], float(((run(a) - y) ** 2).mean())


@kernel("next", "train_loss", layer="sequence")
def fno_forecaster(x):
    """The window's Fourier modes through a hidden layer."""
    a, y, q, m, s = windows(x)

    def modes(v):
        f = np.fft.rfft(v, axis=1) / np.sqrt(LAG)
        return np.concatenate([f.real, f.imag], 1)

    net = Net([2 * (LAG // 2 + 1), HIDDEN, 1])
    loss = net.fit(modes(a), y)
    return m + s * net.forward(modes(q))[0, 0], loss


@kernel("next", "train_loss", layer="sequence")
def patchtst_forecaster(x):
    """Patches of two share one hidden layer; a second reads all of them."""
    a, y, q, m, s = windows(x)
    patch, head = Net([2, 4, 4], 1), Net([LAG // 2 * 4, HIDDEN, 1], 2)

    def run(v):
        return head.forward(patch.forward(v.reshape(-1, 2)).reshape(len(v), -1))

    for _ in range(EPOCHS):
        g = head.backward(2 * (run(a) - y) / len(a))
        patch.backward(g.reshape(-1, 4))
    return m + s * run(q)[0, 0], float(((run(a) - y) ** 2).mean())


@kernel("next", "train_loss", layer="sequence")
def tcn_forecaster(x):
    """Two dilated causal convolutions, of steps one and two, and a linear head."""
    a, y, q, m, s = windows(x)
    first, second, head = Net([2, 8, 8], 1), Net([16, 8, 8], 2), Net([8 * 3, 1], 3)

    def run(v):
        one = first.forward(np.stack([v[:, :-1], v[:, 1:]], -1).reshape(-1, 2)).reshape(len(v), LAG - 1, 8)
        two = second.forward(np.concatenate([one[:, :-2], one[:, 2:]], -1).reshape(-1, 16)).reshape(len(v), LAG - 3, 8)
        return head.forward(two[:, -3:].reshape(len(v), -1))

    for _ in range(EPOCHS):
        g = head.backward(2 * (run(a) - y) / len(a)).reshape(len(a), 3, 8)
        two = np.zeros((len(a), LAG - 3, 8))
        two[:, -3:] = g
        g = second.backward(two.reshape(-1, 8)).reshape(len(a), LAG - 3, 16)
        one = np.zeros((len(a), LAG - 1, 8))
        one[:, :-2] += g[..., :8]
        one[:, 2:] += g[..., 8:]
        first.backward(one.reshape(-1, 8))
    return m + s * run(q)[0, 0], float(((run(a) - y) ** 2).mean())


class Cell:
    """A gated recurrent layer with a linear head, trained through time."""

    def __init__(self, hidden: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.n = hidden
        self.p = [rng.standard_normal((1 + hidden, hidden)) * 0.3, rng.standard_normal((1 + hidden, hidden)) * 0.3, rng.standard_normal((hidden, 1)) * 0.3, np.zeros(hidden) + 1.0, np.zeros(hidden), np.zeros(1)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.p]
        self.steps = 0

    def forward(self, a: np.ndarray) -> np.ndarray:
        h = np.zeros((len(a), self.n))
        self.kept = []
        for t in range(a.shape[1]):
            v = np.concatenate([a[:, t : t + 1], h], 1)
            z, c = 1 / (1 + np.exp(-(v @ self.p[0] + self.p[3]))), np.tanh(v @ self.p[1] + self.p[4])
            self.kept.append((v, z, c, h))
            h = z * h + (1 - z) * c
        self.h = h
        return h @ self.p[2] + self.p[5]

    def backward(self, g: np.ndarray, rate: float = 0.02) -> None:
        d = [np.zeros_like(p) for p in self.p]
        d[2], d[5] = self.h.T @ g, g.sum(0)
        dh = g @ self.p[2].T
        for v, z, c, h in reversed(self.kept):
            dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            d[0] += v.T @ dz
            d[1] += v.T @ dc
            d[3] += dz.sum(0)
            d[4] += dc.sum(0)
            dh = dh * z + (dz @ self.p[0].T + dc @ self.p[1].T)[:, 1:]
        self.steps += 1
        for p, q, (m, s) in zip(self.p, d, self.moments):
            m += 0.1 * (q - m)
            s += 0.001 * (q * q - s)
            p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)


@kernel("next", "train_loss", layer="sequence")
def gru_forecaster(x):
    """A gated recurrent layer over windows of eight."""
    a, y, q, m, s = windows(x)
    net = Cell()
    for _ in range(EPOCHS):
        net.backward(2 * (net.forward(a) - y) / len(a))
    return m + s * net.forward(q)[0, 0], float(((net.forward(a) - y) ** 2).mean())


@kernel("next", "train_loss", layer="sequence")
def ssm_forecaster(x):
    """Diagonal linear recurrences with fixed decays, a skip, and a trained readout."""
    a, y, q, m, s = windows(x)
    decay = np.exp(-np.exp(np.linspace(-3, 1, HIDDEN)))
    taps = decay[:, None] ** np.arange(LAG - 1, -1, -1)
    f = lambda v: np.column_stack([v @ taps.T, v[:, -1], np.ones(len(v))])
    w = np.linalg.solve(f(a).T @ f(a) + 0.1 * np.eye(HIDDEN + 2), f(a).T @ y)
    return m + s * (f(q) @ w)[0, 0], float(((f(a) @ w - y) ** 2).mean())


@kernel("n_anomalies", "threshold", layer="noise")
def autoencoder_anomaly(x):
    """Windows through a bottleneck of two: errors beyond their 0.95 quantile."""
    a = windows(x)[0]
    net = Net([LAG, 8, 2, 8, LAG])
    net.fit(a, a, 120)
    e = ((net.forward(a) - a) ** 2).mean(1)
    return (e > np.quantile(e, 0.95)).sum(), np.quantile(e, 0.95)


@kernel("residual", layer="noise")
def deep_autoencoder(x):
    """Mean error of windows through a bottleneck of two."""
    a = windows(x)[0]
    net = Net([LAG, 8, 2, 8, LAG])
    return (net.fit(a, a, 120),)


@kernel("residual", layer="noise")
def gcn_denoise(x):
    """Two rounds of means over the five nearest windows, with trained maps back to the window."""
    a = windows(x)[0]
    d = ((a[:, None] - a[None]) ** 2).sum(2)
    near = np.argsort(d, 1)[:, :6]
    mean = lambda v: v[near].mean(1)
    net = Net([LAG, 8, LAG])
    net.fit(mean(mean(a)), a, 100)
    return (float(np.abs(net.forward(mean(mean(a))) - a).mean()),)


def _moves(x: np.ndarray):
    """Windows of six, the direction of the next step, the last window."""
    a, _, q, _, _ = windows(x, 6)
    d = np.sign(np.diff(x))[5:]
    return a[: len(d)], d[: len(a)], q


@kernel("action", "q_sell", "q_hold", "q_buy", layer="rl")
def dqn_policy(x):
    """Values of selling, holding and buying, regressed on the reward of the next step."""
    a, d, q = _moves(x)
    net = Net([6, HIDDEN, 3])
    net.fit(a, np.outer(d, [-1, 0, 1]), EPOCHS)
    v = net.forward(q)[0]
    return v.argmax() - 1, *v


@kernel("action", "q_best", layer="rl")
def td3_policy(x):
    """The lesser of two such networks."""
    a, d, q = _moves(x)
    nets = [Net([6, HIDDEN, 3], k) for k in (1, 2)]
    for n in nets:
        n.fit(a, np.outer(d, [-1, 0, 1]), EPOCHS)
    v = np.minimum(*[n.forward(q)[0] for n in nets])
    return v.argmax() - 1, v.max()


def _policy(x: np.ndarray, entropy: float, baseline: bool):
    a, d, q = _moves(x)
    net = Net([6, HIDDEN, 3])
    reward = np.outer(d, [-1.0, 0.0, 1.0])
    for _ in range(EPOCHS):
        z = net.forward(a)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gain = reward - (p * reward).sum(1, keepdims=True) * baseline
        goal = p * (gain - (p * gain).sum(1, keepdims=True)) - entropy * p * (np.log(p + 1e-12) - (p * np.log(p + 1e-12)).sum(1, keepdims=True))
        net.backward(-goal / len(a))
    z = net.forward(q)[0]
    p = np.exp(z - z.max())
    return p / p.sum()


@kernel("action", "probability", layer="rl")
def ppo_policy(x):
    """Softmax policy by its expected gain over a baseline; nothing is clipped."""
    p = _policy(x, 0.0, True)
    return p.argmax() - 1, p.max()


@kernel("dominant_freq", "energy", "confidence")
def fft(x):
    """Strongest frequency of the demeaned series by the fast transform."""
    s = np.abs(np.fft.rfft(x - x.mean()))
    k = 1 + s[1:].argmax()
    return k / len(x), s[k] ** 2, s[k] ** 2 / (s[1:] ** 2).sum()


@query(None, layer="rl")
def random_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arm drawn evenly, with a seed."""
    arms = run_sql(spark, sf_dir, f"WITH {PANEL} SELECT count(*) AS n FROM panel")
    arm = int(np.random.default_rng(0).integers(1, 6))
    return arms.select(F.lit(arm).alias("arm"), F.lit(0.2).alias("confidence"))
