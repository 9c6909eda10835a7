"""Sequence networks over windows of eight, trained in each series' own group: recurrent, attention, state space, differential
equations, graphs, flows, adversarial and variational models, and policies with critics. Fixed seeds; derivatives by autograd."""

from __future__ import annotations

import numpy as np

from .autograd import Many, V, Weights, concat, stack, var
from .kernels import kernel
from .nets import LAG, windows

DIM, STEPS, RATE = 8, 40, 0.02


def trained(x: np.ndarray, model, steps: int = STEPS) -> tuple[float, float]:
    """(next value, last loss) of a model(weights, windows) -> (n, 1) fitted on a series' windows."""
    a, y, q, m, s = windows(x)
    w = Weights()
    for _ in range(steps):
        e = model(w, var(a)) - y
        loss = w.step((e * e).mean(), RATE)
    return m + s * float(model(w, var(q)).value[0, 0]), loss


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of the same columns under one axis, with zeros below the shorter; and each row's share in its array's mean."""
    longest = max(map(len, rows))
    out, share = np.zeros((len(rows), longest, *rows[0].shape[1:])), np.zeros((len(rows), longest, 1))
    for i, r in enumerate(rows):
        out[i, : len(r)], share[i, : len(r)] = r, 1 / len(r)
    return out, share


def trained_together(xs: list[np.ndarray], model, steps: int = STEPS) -> list[tuple[float, float]]:
    """trained() of each series, by one network a series side by side: rows that fill up weigh nothing."""
    parts = [windows(x) for x in xs]
    (a, share), (y, _) = padded([p[0] for p in parts]), padded([p[1] for p in parts])
    w = Many(len(xs))
    for _ in range(steps):
        e = model(w, var(a)) - y
        each = e * e * share
        w.step(each.sum(), RATE)
    ahead = model(w, var(np.stack([p[2] for p in parts]))).value[:, 0, 0]
    return [(p[3] + p[4] * float(v), float(loss)) for p, v, loss in zip(parts, ahead, each.value.sum((1, 2)), strict=True)]


def forecaster(f=None, together: bool = False):
    """Registers a model as the forecast of the next value; together: one that takes windows of many series, (series, n, LAG), too."""
    if f is None:
        return lambda f: forecaster(f, together)

    def run(x):
        return trained(x, f)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    kernel("next", "train_loss", name=f.__name__, layer="sequence", cost="high", many=(lambda xs: trained_together(xs, f)) if together else None)(run)
    return f


def normed(x: V) -> V:
    c = x - x.mean(-1, keepdims=True)
    return c * ((c * c).mean(-1, keepdims=True) + 1e-5).power(-0.5)


#: Positions of tokens.
PLACE = np.sin(np.arange(LAG)[:, None] / 10.0 ** (np.arange(DIM) / DIM) + np.pi / 2 * (np.arange(DIM) % 2))


def tokens(w: Weights, a: V) -> V:
    """Windows as tokens with positions: (n, LAG, DIM)."""
    return a.reshape(a.shape[0], LAG, 1) @ w("embed", 1, DIM) + PLACE


def gated(a: V, w: V, b: V) -> V:
    """The last state of a recurrence with gates for what comes in, stays and goes out, w (1 + DIM, 4 DIM) and b: one step of
    derivatives for all of time. Arrays are (.., numbers, windows) inside, so that a gate is one piece of memory."""
    n, m = a.shape[-2], a.shape[:-2]
    both = np.concatenate([w.value, b.value.reshape(*m, 1, 4 * DIM)], -2)  # value, state, 1
    x = np.moveaxis(a.value, -1, 0)  # (LAG, .., n)
    h, c, kept = np.zeros((*m, DIM, n)), np.zeros((*m, DIM, n)), []
    gates = np.swapaxes(both, -1, -2)
    for t in range(LAG):
        seen = np.empty((*m, DIM + 2, n))
        seen[..., 0, :], seen[..., 1:-1, :], seen[..., -1, :] = x[t], h, 1.0
        z = gates @ seen
        z[..., DIM : 2 * DIM, :] += 1.0
        on = z[..., : 3 * DIM, :]
        np.clip(on, -60, 60, out=on)
        np.negative(on, out=on)
        np.exp(on, out=on)
        on += 1
        np.reciprocal(on, out=on)
        g = z[..., 3 * DIM :, :]
        np.tanh(g, out=g)
        before, c = c, z[..., DIM : 2 * DIM, :] * c + z[..., :DIM, :] * g
        squashed = np.tanh(c)
        h = z[..., 2 * DIM : 3 * DIM, :] * squashed
        kept.append((seen, z, before, squashed))

    def back(grad):
        dh, dc = np.swapaxes(grad, -1, -2), 0.0
        dw, da = 0.0, np.empty_like(x)
        for t in range(LAG - 1, -1, -1):
            seen, z, before, squashed = kept[t]
            i, f, o, g = (z[..., k * DIM : (k + 1) * DIM, :] for k in range(4))
            dc = dc + dh * o * (1 - squashed * squashed)
            dz = np.empty_like(z)
            dz[..., :DIM, :] = dc * g
            dz[..., DIM : 2 * DIM, :] = dc * before
            dz[..., 2 * DIM : 3 * DIM, :] = dh * squashed
            dz[..., 3 * DIM :, :] = dc * i * (1 - g * g)
            on = z[..., : 3 * DIM, :]
            dz[..., : 3 * DIM, :] *= on * (1 - on)
            dw = dw + seen @ np.swapaxes(dz, -1, -2)
            down = both[..., :-1, :] @ dz
            da[t], dh = down[..., 0, :], down[..., 1:, :]
            dc = dc * f
        return np.moveaxis(da, 0, -1), dw[..., :-1, :], dw[..., -1:, :].reshape(b.shape)

    return V(np.swapaxes(h, -1, -2), (a, w, b), back)


@forecaster(together=True)
def lstm_forecaster(w, a):
    """Long short-term memory: gates for what comes in, stays and goes out."""
    return w.linear("out", gated(a, w("gates.w", 1 + DIM, 4 * DIM), w("gates.b", 4 * DIM, scale=0.0)), 1)


def attention(w, name, q, k, v, mask=None):
    z = w.linear(f"{name}.q", q, DIM) @ w.linear(f"{name}.k", k, DIM).swap() * DIM**-0.5
    if mask is not None:
        z = z + mask
    return z.softmax() @ w.linear(f"{name}.v", v, DIM)


CAUSAL = np.where(np.tri(LAG) > 0, 0.0, -1e9)


@forecaster(together=True)
def transformer_forecaster(w, a):
    """Two heads of causal attention, a feed-forward layer, residuals with layer norms; the last token speaks.

    Only the last token reaches the output, and it sees all: the other queries are not computed. Tokens are a value times the
    embedding, plus the position, so keys and scores come from these without a row for each token.
    """
    place = var(PLACE)
    embed = w("embed", 1, DIM)
    x = a[..., -1:] @ embed + place[-1:]
    heads = []
    for k in range(2):
        q = w.linear(f"h{k}.q", x, DIM)
        key, at_key = embed @ w(f"h{k}.k.w", DIM, DIM), w.linear(f"h{k}.k", place, DIM)
        value, at_value = embed @ w(f"h{k}.v.w", DIM, DIM), w.linear(f"h{k}.v", place, DIM)
        share = ((a * (q @ key.swap()) + q @ at_key.swap()) * DIM**-0.5).softmax()
        heads.append((share * a).sum(-1, keepdims=True) @ value + share @ at_value)
    x = normed(x + w.linear("mix", concat(heads), DIM))
    x = normed(x + w.linear("down", w.linear("up", x, 2 * DIM).relu(), DIM))
    return w.linear("out", x, 1)


@forecaster
def informer_forecaster(w, a):
    """Sparse attention: the four queries whose scores stand out most attend, the others take the mean; then tokens are halved by their pairwise greatest."""
    x = tokens(w, a)
    q, k, v = (w.linear(f"a.{n}", x, DIM) for n in "qkv")
    z = q @ k.swap() * DIM**-0.5
    measure = z.value.max(-1) - z.value.mean(-1)
    on = (np.argsort(np.argsort(-measure, 1), 1) < 4)[:, :, None].astype(float)
    x = normed(x + on * (z.softmax() @ v) + (1 - on) * v.mean(1, keepdims=True))
    pairs = x.reshape(x.shape[0], LAG // 2, 2, DIM)
    first = (pairs.value[:, :, :1] >= pairs.value[:, :, 1:]).astype(float)
    x = pairs[:, :, 0] * first[:, :, 0] + pairs[:, :, 1] * (1 - first[:, :, 0])
    return w.linear("out", normed(x).reshape(x.shape[0], LAG // 2 * DIM), 1)


#: Discrete Fourier transform of a window as matrices, and back.
_F = np.exp(-2j * np.pi * np.outer(np.arange(LAG), np.arange(LAG // 2 + 1)) / LAG)
_RE, _IM = _F.real, _F.imag
_BACK = np.where(np.isin(np.arange(LAG // 2 + 1), (0, LAG // 2)), 1.0, 2.0)[:, None] / LAG
_MEAN3 = np.array([[1.0 / min(3, i + 2, LAG + 1 - i) if abs(i - j) <= 1 else 0.0 for i in range(LAG)] for j in range(LAG)])


def split(a: V) -> tuple[V, V]:
    """(trend, season): a moving mean of three and what is left."""
    trend = a @ _MEAN3
    return trend, a - trend


@forecaster
def fedformer_forecaster(w, a):
    """Trend and season apart; the season's modes are mixed by learned complex weights in the frequency domain."""
    trend, season = split(a)
    re, im = season @ _RE, season @ _IM
    wr, wi = w("re", LAG // 2 + 1, start=np.ones(LAG // 2 + 1)), w("im", LAG // 2 + 1, scale=0.1)
    re, im = re * wr - im * wi, re * wi + im * wr
    back = re @ (_RE * _BACK.T).T + im @ (_IM * _BACK.T).T
    return w.linear("trend", trend, 1) + w.linear("season", back.tanh(), 1)


def autocorrelated(w: Weights, season: V) -> V:
    """The season rolled by the three delays of greatest autocorrelation, weighed by their softmax."""
    re, im = season @ _RE, season @ _IM
    power = re * re + im * im
    corr = power @ (_RE * _BACK.T).T * (1.0 / LAG)
    lags = np.argsort(-corr.value[:, 1:].mean(0))[:3] + 1
    weight = corr[:, lags].softmax()
    out = 0.0
    for i, lag in enumerate(lags):
        out = season[:, (np.arange(LAG) + lag) % LAG] * weight[:, i : i + 1] + out
    return out


@forecaster
def autoformer_forecaster(w, a):
    """Trend and season apart; the season is rolled by its strongest delays of autocorrelation."""
    trend, season = split(a)
    return w.linear("trend", trend, 1) + w.linear("season", autocorrelated(w, season), 1) + w.linear("rest", season, 1)


@forecaster
def mamba_forecaster(w, a):
    """Selective state space: step, input and output maps depend on the input; a scan over the window; a gate."""
    late = stack([a[:, np.maximum(np.arange(LAG) - k, 0)] for k in range(3)], 2)
    x = w.linear("embed", late, DIM)  # a short convolution
    decay = -(w("a", DIM, start=np.log(np.arange(1, DIM + 1.0)))).exp()
    h = var(np.zeros((a.shape[0], DIM)))
    for t in range(LAG):
        u = x[:, t]
        dt = w.linear("dt", u, DIM).softplus()
        h = h * (dt * decay).exp() + dt * w.linear("b", u, DIM) * u
        y = h * w.linear("c", u, DIM)
    gate = w.linear("gate", x[:, -1], DIM)
    return w.linear("out", (y + x[:, -1] * w("d", DIM, start=np.ones(DIM))) * gate * gate.sigmoid(), 1)


def hippo(n: int = DIM) -> np.ndarray:
    """The matrix that keeps a signal's Legendre coefficients."""
    k = np.sqrt(2 * np.arange(n) + 1)
    return -(np.tril(np.outer(k, k), -1) + np.diag(np.arange(n) + 1.0))


@forecaster
def s4_forecaster(w, a):
    """Structured state space: the Legendre matrix by a bilinear step, as a convolution with a learned output and a skip."""
    step = 1.0 / LAG
    left = np.linalg.inv(np.eye(DIM) - step / 2 * hippo())
    bar, inp = left @ (np.eye(DIM) + step / 2 * hippo()), left @ np.sqrt(2 * np.arange(DIM) + 1) * step
    taps = np.stack([np.linalg.matrix_power(bar, LAG - 1 - t) @ inp for t in range(LAG)])  # state after the window
    h = a @ taps
    return w.linear("out", concat([h, h.tanh(), a[:, -1:]]), 1)


@forecaster
def s5_forecaster(w, a):
    """Diagonal complex state space with learned decays and frequencies, all channels in one state."""
    age = np.arange(LAG - 1, -1, -1.0)[:, None]
    decay = (var(age) * (w("decay", DIM, start=np.linspace(-3, 0, DIM))).exp() * -1.0).exp()
    turn = var(age) * w("turn", DIM, start=np.pi * np.arange(DIM) / DIM)
    cos = V(np.cos(turn.value), (turn,), lambda g: (-g * np.sin(turn.value),))
    sin = V(np.sin(turn.value), (turn,), lambda g: (g * np.cos(turn.value),))
    re, im = a @ (decay * cos), a @ (decay * sin)
    return w.linear("out", concat([re, im, a[:, -1:]]), 1)


@forecaster
def neural_ode_forecaster(w, a):
    """A hidden state that a network drives, four Runge-Kutta steps ahead."""
    h = w.linear("in", a, DIM).tanh()
    drive = lambda z: w.linear("f2", w.linear("f1", z, DIM).tanh(), DIM).tanh()
    for _ in range(4):
        k1 = drive(h)
        k2 = drive(h + k1 * 0.125)
        k3 = drive(h + k2 * 0.125)
        k4 = drive(h + k3 * 0.25)
        h = h + (k1 + 2 * k2 + 2 * k3 + k4) * (0.25 / 6)
    return w.linear("out", h, 1)


@forecaster
def pinn_forecaster(w, a):
    """A forecast bound to a damped oscillator x'' + c x' + k x = 0 whose constants are learned with it: the law's residual at the forecast is part of what the net sees."""
    y = w.linear("out", w.linear("in", a, DIM).tanh(), 1)
    c, k = w("c", 1, scale=0.0), w("k", 1, scale=0.0)
    law = a[:, -1:] * (2.0 - c - k) - a[:, -2:-1] * (1.0 - c)
    share = w("share", 1, scale=0.0).sigmoid()
    return y * share + law * (1.0 - share)


def neighbours(a: np.ndarray, k: int = 5) -> np.ndarray:
    """The k windows nearest to each, by blocks of rows."""
    out = []
    for i in range(0, len(a), 512):
        d = ((a[i : i + 512, None] - a[None]) ** 2).sum(2)
        d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        out.append(np.argsort(d, 1, kind="stable")[:, : min(k, len(a) - 1)])
    return np.concatenate(out)


def denoiser(f):
    """Registers a model(weights, windows, neighbours) -> windows rebuilt; the result is the mean change."""

    def run(x):
        a = windows(x)[0]
        near = neighbours(a)
        w = Weights()
        for _ in range(STEPS):
            e = f(w, var(a), near) - a
            w.step((e * e).mean(), RATE)
        return (float(np.abs(f(w, var(a), near).value - a).mean()),)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    kernel("residual", name=f.__name__, layer="noise", cost="high")(run)
    return f


@denoiser
def gat_denoise(w, a, near):
    """Graph attention over the five nearest windows: learned scores of both ends, leaky, softmax."""
    h = w.linear("in", a, DIM)
    score = (h @ w("own", DIM, 1))[:, None] + (h @ w("other", DIM, 1))[near]
    score = score.relu() - (-score).relu() * 0.2
    return w.linear("out", (h[near] * score.softmax(1)).sum(1).tanh(), LAG)


@denoiser
def graphsage_denoise(w, a, near):
    """Own features beside the mean of the five nearest windows, normed, and back."""
    h = w.linear("mix", concat([a, a[near].mean(1)]), DIM).relu()
    h = h * ((h * h).sum(-1, keepdims=True) + 1e-6).power(-0.5)
    return w.linear("out", h, LAG)


@denoiser
def temporal_gnn_denoise(w, a, near):
    """Messages along time (the windows before and after) and along likeness (the nearest), gated."""
    n = a.shape[0]
    before, after = a[np.maximum(np.arange(n) - 1, 0)], a[np.minimum(np.arange(n) + 1, n - 1)]
    time, like = w.linear("time", concat([before, after]), DIM).tanh(), w.linear("like", a[near].mean(1), DIM).tanh()
    gate = w.linear("gate", concat([time, like]), DIM).sigmoid()
    return w.linear("out", time * gate + like * (1.0 - gate), LAG)


def beyond(e: np.ndarray) -> tuple[float, float]:
    """(how many errors are over three robust deviations, that threshold)."""
    cut = np.median(e) + 3 * 1.4826 * np.median(np.abs(e - np.median(e)))
    return float((e > cut).sum()), float(cut)


def coupled(w: Weights, a: V) -> tuple[V, V]:
    """Three affine couplings: (latent, log of the determinant)."""
    half, log = LAG // 2, 0.0
    for k in range(3):
        x, y = (a[:, :half], a[:, half:]) if k % 2 == 0 else (a[:, half:], a[:, :half])
        h = w.linear(f"{k}.in", x, DIM).tanh()
        s = w.linear(f"{k}.s", h, half).tanh()
        y = y * s.exp() + w.linear(f"{k}.t", h, half)
        a = concat([x, y]) if k % 2 == 0 else concat([y, x])
        log = s.sum(-1) + log
    return a, log


@kernel("n_anomalies", "threshold", layer="noise", cost="high")
def normalizing_flow_anomaly(x):
    """Affine couplings that make windows normal; the least likely windows stand out."""
    a, w = windows(x)[0], Weights()

    def surprise():
        z, log = coupled(w, var(a))
        return (z * z).sum(-1) * 0.5 - log

    for _ in range(STEPS):
        w.step(surprise().mean(), RATE)
    return beyond(surprise().value)


@kernel("n_anomalies", "threshold", layer="noise", cost="high")
def gan_anomaly(x):
    """Generator and discriminator in turn; windows that the discriminator holds least real stand out."""
    a, w, rng = windows(x)[0], Weights(), np.random.default_rng(1)
    judge = lambda v: w.linear("d.out", w.linear("d.in", v, DIM).tanh(), 1)
    make = lambda z: w.linear("g.out", w.linear("g.in", var(z), DIM).tanh(), LAG)
    for _ in range(STEPS):
        z = rng.standard_normal((len(a), 4))
        w.step((-judge(var(a))).softplus().mean() + judge(make(z)).softplus().mean(), RATE, "d.")
        w.step((-judge(make(z))).softplus().mean(), RATE, "g.")
    return beyond(-judge(var(a)).value.ravel())


def variational(a: np.ndarray, w: Weights, noise: np.ndarray) -> tuple[V, V]:
    """(rebuilt windows, divergence from the standard normal law) of an encoder with mean and variance of two numbers."""
    h = w.linear("in", var(a), DIM).tanh()
    mean, log = w.linear("mean", h, 2), w.linear("log", h, 2)
    z = mean + (log * 0.5).exp() * noise
    kl = ((mean * mean + log.exp() - log - 1.0) * 0.5).sum(-1).mean()
    return w.linear("out", w.linear("up", z, DIM).tanh(), LAG), kl


def vae(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, windows rebuilt from the mean) of a trained variational autoencoder."""
    a, w, rng = windows(x)[0], Weights(), np.random.default_rng(2)
    for _ in range(2 * STEPS):
        out, kl = variational(a, w, rng.standard_normal((len(a), 2)))
        w.step(((out - a) * (out - a)).sum(-1).mean() + kl * 0.1, RATE)
    return a, variational(a, w, np.zeros((len(a), 2)))[0].value


@kernel("residual", layer="noise", cost="high")
def vae_denoise(x):
    """Variational autoencoder, mean and variance learned: the mean squared change of windows."""
    a, b = vae(x)
    return (float(((a - b) ** 2).mean()),)


@kernel("n_anomalies", "threshold", layer="noise", cost="high")
def vae_anomaly(x):
    """Windows that a variational autoencoder rebuilds worst."""
    a, b = vae(x)
    return beyond(((a - b) ** 2).mean(1))


@kernel("residual", layer="noise", cost="high")
def diffusion_denoise(x, levels: int = 10, start: int = 3):
    """A network learns the noise of ten levels of a linear schedule; windows go a few levels up and are brought down again."""
    a, w, rng = windows(x)[0], Weights(), np.random.default_rng(3)
    beta = np.linspace(1e-3, 0.2, levels)
    keep = np.cumprod(1 - beta)
    guess = lambda v, t: w.linear("out", w.linear("in", concat([var(v), var(np.stack([t / levels, np.sin(t), np.cos(t)], 1))]), 2 * DIM).tanh(), LAG)
    for _ in range(2 * STEPS):
        t, e = rng.integers(0, levels, len(a)), rng.standard_normal(a.shape)
        d = guess(np.sqrt(keep[t])[:, None] * a + np.sqrt(1 - keep[t])[:, None] * e, t) - e
        w.step((d * d).mean(), RATE)
    v = np.sqrt(keep[start]) * a
    for t in range(start, -1, -1):
        e = guess(v, np.full(len(a), t)).value
        v = (v - beta[t] / np.sqrt(1 - keep[t]) * e) / np.sqrt(1 - beta[t])
    return (float(np.abs(v - a).mean()),)


def moves(x: np.ndarray):
    """Windows, and the reward of each of three positions (-1, 0, 1) over the step after: the step in its deviation, less a cost of moving."""
    a, _, q, _, _ = windows(x)
    step = np.diff(x)[LAG - 1 :]
    step = step / (step.std() + 1e-9)
    return a, np.outer(step, [-1, 0, 1]) - 0.01 * np.abs([-1, 0, 1]), q


def a3c_policies(xs: list[np.ndarray], workers: int = 3) -> list[tuple[float, float, float]]:
    """a3c_policy() of each series, by one network a series side by side: rows that fill up weigh nothing."""
    parts = [moves(x) for x in xs]
    w, draws = Many(len(xs)), {n: np.random.default_rng(4) for n in {len(p[0]) for p in parts}}  # series of a length draw alike
    body = lambda v: w.linear("in", var(v), DIM).tanh()
    turns = [(padded([p[0][k::workers] for p in parts]), padded([p[1][k::workers] for p in parts])[0]) for k in range(workers)]
    for _ in range(STEPS):
        for k, ((a, share), r) in enumerate(turns):
            drawn = {n: rng.random((len(range(k, n, workers)), 1)) for n, rng in draws.items()}
            h = body(a)
            p, value = w.linear("pi", h, 3).softmax(), w.linear("v", h, 1)
            odds = np.cumsum(p.value / p.value.sum(-1, keepdims=True), -1)
            act = odds / odds[..., -1:] <= padded([drawn[len(part[0])] for part in parts])[0]  # as rng.choice draws, for all rows
            act = act.sum(-1, keepdims=True) == np.arange(3)
            reward = (r * act).sum(-1, keepdims=True)
            log = p.log()
            gain = log * (act * (reward - value.value))
            e = value - reward
            w.step(((e * e * 0.5 - gain.sum(-1, keepdims=True) + (p * log).sum(-1, keepdims=True) * 0.01) * share).sum(), RATE)
    h = body(np.stack([p[2] for p in parts]))
    p, value = w.linear("pi", h, 3).softmax().value[:, 0], w.linear("v", h, 1).value[:, 0, 0]
    return list(zip((p.argmax(1) - 1).tolist(), p.max(1).tolist(), value.tolist(), strict=True))


@kernel("action", "probability", "value", layer="rl", cost="high", many=a3c_policies)
def a3c_policy(x, workers: int = 3):
    """Actor and critic of one body: three workers with windows of their own in turn, advantages over the critic's value, entropy."""
    return a3c_policies([x], workers)[0]


@kernel("action", "probability", "value", layer="rl", cost="high")
def sac_policy(x, alpha: float = 0.1):
    """Soft actor and critics: two critics of every position, the policy follows their lower value and its entropy."""
    a, r, q = moves(x)
    w = Weights()
    critic = lambda k, v: w.linear(f"q{k}.out", w.linear(f"q{k}.in", var(v), DIM).tanh(), 3)
    policy = lambda v: w.linear("pi.out", w.linear("pi.in", var(v), DIM).tanh(), 3).softmax()
    for _ in range(STEPS):
        for k in range(2):
            e = critic(k, a) - r
            w.step((e * e).mean(), RATE, f"q{k}.")
        low = np.minimum(critic(0, a).value, critic(1, a).value)
        p = policy(a)
        w.step((p * (p.log() * alpha - low)).sum(-1).mean(), RATE, "pi.")
    p = policy(q).value[0]
    low = np.minimum(critic(0, q).value, critic(1, q).value)[0]
    return p.argmax() - 1, p.max(), float(p @ (low - alpha * np.log(p + 1e-12)))
