"""Operators that no SQL form has: numpy kernels, one call a series, through applyInPandas.

A series is one group, in order; groups are bounded by the length of a series.
Each kernel takes a float array (T,) and returns named numbers; the belief table
has one row a series, with the numbers as columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.tables import OBS_EVENTS, obs_events


#: Rows that a series needs for its windows, lags and periods.
SHORTEST = 32


#: Spectrum of each series by the definition of the transform.
_POWER = "z AS (SELECT series_id, t, x0 - avg(x0) OVER (PARTITION BY series_id) AS z, count(*) OVER (PARTITION BY series_id) AS n FROM o), f AS (SELECT series_id, n, k, power(sum(z * cos(2 * pi() * k * t / n)), 2) + power(sum(z * sin(2 * pi() * k * t / n)), 2) AS p FROM (SELECT series_id, n, t, z, unnest(generate_series(0, n // 2)) AS k FROM z) q GROUP BY series_id, n, k)"
_G = np.linspace(-4, 4, 401)
#: Deviation of the standard normal law on 401 points from -4 to 4, by trapezoids.
_CUT = float(np.sqrt(np.trapezoid(_G**2 * np.exp(-0.5 * _G**2), _G) / np.trapezoid(np.exp(-0.5 * _G**2), _G)))
#: For DuckDB: further tables over o (series that a kernel takes), and the last select.
SQL = {
    "periodogram": (_POWER + ", d AS (SELECT series_id, n, k, CASE WHEN k >= 1 AND k < (n + 1) // 2 THEN 2 * p ELSE p END AS p FROM f)", "SELECT series_id, max_by(k, p) FILTER (k > 0) / max(n) AS dominant_freq, max(p) FILTER (k > 0) / sum(p) AS confidence FROM d GROUP BY series_id"),
    "spectral_entropy": (_POWER + ", d AS (SELECT series_id, greatest(p / sum(p) OVER (PARTITION BY series_id), 1e-300) AS q FROM f WHERE k > 0)", "SELECT series_id, -sum(q * ln(q)) / ln(count(*)) AS entropy FROM d GROUP BY series_id"),
    "maxent_dist": ("g AS (SELECT series_id, count(*) AS n, avg(x0) AS mu, stddev_pop(x0) + 1e-12 AS sigma FROM o GROUP BY series_id)", "SELECT series_id, n * (ln(2 * pi() * sigma * sigma) + 1) + 2 * ln(n) AS bic, mu, sigma FROM g"),
    "exp_smoothing": ("h(series_id, t, l, b, e) AS (SELECT a.series_id, a.t, a.x0, c.x0 - a.x0, cast(0 AS double) FROM o a JOIN o c ON a.series_id = c.series_id AND a.t = 0 AND c.t = 1 UNION ALL SELECT o.series_id, o.t, 0.5 * o.x0 + 0.5 * (h.l + h.b), 0.3 * (0.5 * o.x0 + 0.5 * (h.l + h.b) - h.l) + 0.7 * h.b, h.e + abs(o.x0 - h.l - h.b) FROM h JOIN o ON o.series_id = h.series_id AND o.t = h.t + 1)", "SELECT series_id, max_by(l + b, t) AS next, max_by(e, t) / max(t) AS mae FROM h GROUP BY series_id"),
    "fokker_planck": (f"g AS (SELECT series_id, t, x0, lag(x0) OVER (PARTITION BY series_id ORDER BY t) AS p FROM o), c AS (SELECT series_id, regr_slope(x0, p) AS b, regr_intercept(x0, p) AS a, max_by(x0, t) AS last FROM g WHERE p IS NOT NULL GROUP BY series_id), s AS (SELECT g.series_id, stddev_pop(x0 - a - b * p) + 1e-9 AS s FROM g JOIN c ON g.series_id = c.series_id WHERE p IS NOT NULL GROUP BY g.series_id)", f"SELECT c.series_id, a + b * last AS mean, s * {_CUT} AS std, 401 AS n_grid FROM c JOIN s ON c.series_id = s.series_id"),
    "jump_diffusion": ("d AS (SELECT series_id, t - 1 AS i, x0 - lag(x0) OVER (PARTITION BY series_id ORDER BY t) AS d, least(100, greatest(20, count(*) OVER (PARTITION BY series_id) // 10)) // 2 AS half FROM o), e AS (SELECT * FROM d WHERE d IS NOT NULL), m0 AS (SELECT series_id, median(d) AS m FROM e GROUP BY series_id), w0 AS (SELECT e.series_id, median(abs(d - m)) / 0.6745 + 1e-9 AS whole FROM e JOIN m0 ON e.series_id = m0.series_id GROUP BY e.series_id), n AS (SELECT a.series_id, a.i, any_value(a.d) AS d, median(b.d) AS m, list(b.d) AS near FROM e a JOIN e b ON a.series_id = b.series_id AND b.i BETWEEN a.i - a.half AND a.i + a.half GROUP BY a.series_id, a.i), f AS (SELECT n.series_id, d, abs(d - m) / greatest(list_median(list_transform(near, lambda v: abs(v - m))) / 0.6745, 0.25 * whole) > 3.5 AS jump FROM n JOIN w0 ON n.series_id = w0.series_id)", "SELECT series_id, count_if(jump) AS n_jumps, avg(CASE WHEN jump THEN 1.0 ELSE 0.0 END) AS intensity, coalesce(stddev_pop(d) FILTER (jump), 0) AS jump_std FROM f GROUP BY series_id"),
    "bayesian_network": ("q AS (SELECT series_id, quantile_cont(x0, 0.25) AS a, quantile_cont(x0, 0.5) AS b, quantile_cont(x0, 0.75) AS c, avg(x0) AS mean, max(t) AS last FROM o GROUP BY series_id), s AS (SELECT o.series_id, t, x0, last, mean, (x0 >= a)::INT + (x0 >= b)::INT + (x0 >= c)::INT AS code FROM o JOIN q ON o.series_id = q.series_id), j AS (SELECT x.series_id, k, x.code AS u, y.code AS v, count(*) AS n FROM s x CROSS JOIN (VALUES (1), (2), (3)) l(k) JOIN s y ON x.series_id = y.series_id AND y.t = x.t + k GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id, k) AS p, sum(n) OVER (PARTITION BY series_id, k, u) / sum(n) OVER (PARTITION BY series_id, k) AS pu, sum(n) OVER (PARTITION BY series_id, k, v) / sum(n) OVER (PARTITION BY series_id, k) AS pv FROM j), mi AS (SELECT series_id, k, sum(p * log2(p / (pu * pv))) AS mi FROM p GROUP BY series_id, k), top AS (SELECT series_id, min_by(k, -round(mi, 12) * 10 + k * 1e-13) AS k, max(mi) AS mi FROM mi GROUP BY series_id), means AS (SELECT series_id, code, avg(x0) AS m FROM s GROUP BY series_id, code), now AS (SELECT top.series_id, top.k, mi, s.code, s.mean FROM top JOIN s ON s.series_id = top.series_id AND s.t = s.last - top.k + 1), e AS (SELECT now.series_id, now.k, now.mi, coalesce(j.n, 0) + 1e-9 AS n, coalesce(means.m, now.mean) AS m FROM now CROSS JOIN (VALUES (0), (1), (2), (3)) c(v) LEFT JOIN j ON j.series_id = now.series_id AND j.k = now.k AND j.u = now.code AND j.v = c.v LEFT JOIN means ON means.series_id = now.series_id AND means.code = c.v)", "SELECT series_id, max(k) AS root_lag, max(mi) AS mutual_information, sum(n * m) / sum(n) AS estimate FROM e GROUP BY series_id"),
    "hilbert_envelope": ("n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM o), f AS (SELECT series_id, n, k, sum(x0 * cos(2 * pi() * k * t / n)) AS re, -sum(x0 * sin(2 * pi() * k * t / n)) AS im FROM (SELECT *, unnest(generate_series(0, n // 2)) AS k FROM n) q GROUP BY series_id, n, k), h AS (SELECT *, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS h FROM f), a AS (SELECT n.series_id, n.t, sum(h * (re * cos(2 * pi() * k * t / n.n) - im * sin(2 * pi() * k * t / n.n))) / max(n.n) AS u, sum(h * (re * sin(2 * pi() * k * t / n.n) + im * cos(2 * pi() * k * t / n.n))) / max(n.n) AS v FROM n JOIN h ON n.series_id = h.series_id GROUP BY n.series_id, n.t)", "SELECT series_id, avg(sqrt(u * u + v * v)) AS mean_envelope FROM a GROUP BY series_id"),
    "mfdfa": ("y AS (SELECT series_id, t, count(*) OVER (PARTITION BY series_id) AS n, sum(x0 - m) OVER (PARTITION BY series_id ORDER BY t) AS y FROM (SELECT *, avg(x0) OVER (PARTITION BY series_id) AS m FROM o) q), w AS (SELECT series_id, s, t // s AS i, greatest(0, regr_syy(y, t % s) - coalesce(power(regr_sxy(y, t % s), 2) / regr_sxx(y, t % s), 0)) / s + 1e-12 AS v FROM y CROSS JOIN (VALUES (8), (11), (16), (22), (32)) z(s) WHERE n >= 2 * s AND t // s < n // s GROUP BY series_id, s, t // s), f AS (SELECT series_id, s, power(avg(power(v, -1)), -0.5) AS low, power(avg(v), 0.5) AS high FROM w GROUP BY series_id, s), g AS (SELECT series_id, regr_slope(ln(low), ln(s)) AS a, regr_slope(ln(high), ln(s)) AS b FROM f GROUP BY series_id)", "SELECT series_id, abs(a - b) AS multifractal_width, b AS hurst_q2 FROM g"),
    "lyapunov_exponent": ("e AS (SELECT * FROM (SELECT series_id, t, x0 AS a, lead(x0, 1) OVER w AS b, lead(x0, 2) OVER w AS c, count(*) OVER (PARTITION BY series_id) - 2 AS m FROM o WINDOW w AS (PARTITION BY series_id ORDER BY t)) q WHERE c IS NOT NULL), p AS (SELECT x.series_id, x.t AS i, y.t AS j, sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2) + power(x.c - y.c, 2)) AS d, x.m FROM e x JOIN e y ON x.series_id = y.series_id), near AS (SELECT series_id, i, min_by(j, d + j * 1e-13) AS j, min(d) AS d FROM p WHERE i < m - 5 AND j < m - 5 AND abs(i - j) > 2 GROUP BY series_id, i)", "SELECT near.series_id, avg(ln(greatest(p.d, 1e-12) / greatest(near.d, 1e-12)) / k) AS lyapunov FROM near CROSS JOIN (VALUES (1), (2), (3), (4), (5)) z(k) JOIN p ON p.series_id = near.series_id AND p.i = near.i + k AND p.j = near.j + k GROUP BY near.series_id"),
    "passive_aggressive_classifier": ("d AS (SELECT series_id, t - 1 AS i, x0 - lag(x0) OVER (PARTITION BY series_id ORDER BY t) AS d FROM o), e AS (SELECT series_id, i, d / (stddev_pop(d) OVER (PARTITION BY series_id) + 1e-9) AS d FROM d WHERE d IS NOT NULL), g AS (SELECT series_id, i, lag(d, 1) OVER w AS f, lag(d, 2) OVER w AS h, CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE -1.0 END AS y FROM e WINDOW w AS (PARTITION BY series_id ORDER BY i)), r(series_id, i, w0, w1, bad) AS (SELECT series_id, i, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT FROM g WHERE i = 1 UNION ALL SELECT g.series_id, g.i, w0 + least(1.0, greatest(0.0, 1 - y * (w0 * f + w1 * h)) / (f * f + h * h + 1e-12)) * y * f, w1 + least(1.0, greatest(0.0, 1 - y * (w0 * f + w1 * h)) / (f * f + h * h + 1e-12)) * y * h, bad + (y * (w0 * f + w1 * h) <= 0)::BIGINT FROM r JOIN g ON g.series_id = r.series_id AND g.i = r.i + 1)", "SELECT series_id, max_by(w0, i) AS w0, max_by(w1, i) AS w1, max_by(bad, i) AS mistakes FROM r GROUP BY series_id"),
    "ard_regression": ("c AS (SELECT series_id, count(*) AS n, avg(t) AS mt, avg(x0) AS mx FROM o GROUP BY series_id), g AS (SELECT o.series_id, max(n) AS n, sum(power(t - mt, 2)) AS tt, sum((t - mt) * (x0 - mx)) AS ty, sum(power(x0 - mx, 2)) AS yy FROM o JOIN c ON o.series_id = c.series_id GROUP BY o.series_id), r(series_id, k, a, b, m) AS (SELECT series_id, 0, 1.0::DOUBLE, 1 / (yy / n + 1e-12), 0.0::DOUBLE FROM g UNION ALL SELECT u.series_id, u.k + 1, u.w / (u.m * u.m + 1e-12), (u.n - u.w) / (u.yy - 2 * u.m * u.ty + u.m * u.m * u.tt + 1e-12), u.m FROM (SELECT r.series_id, r.k, g.n, g.tt, g.ty, g.yy, 1 - r.a / (r.a + r.b * g.tt) AS w, r.b * g.ty / (r.a + r.b * g.tt) AS m FROM r JOIN g ON r.series_id = g.series_id WHERE r.k < 100) u)", "SELECT r.series_id, m AS coef, 1 - (yy - 2 * m * ty + m * m * tt) / (yy + 1e-12) AS r2 FROM r JOIN g ON r.series_id = g.series_id WHERE k = 100"),
    "bsts_forecast": ("d AS (SELECT series_id, t, x0, x0 - lag(x0) OVER (PARTITION BY series_id ORDER BY t) AS d FROM o), c AS (SELECT series_id, greatest(var_pop(x0), 1e-3) AS r, greatest(var_pop(d) / 6, 1e-3) AS q FROM d GROUP BY series_id), f(series_id, t, a, b, p, u, w) AS (SELECT o.series_id, o.t, x0, 0.0::DOUBLE, r, 0.0::DOUBLE, r FROM o JOIN c ON o.series_id = c.series_id WHERE t = 0 UNION ALL SELECT z.series_id, z.t, z.a + z.b + z.p / (z.p + z.r) * (z.x0 - z.a - z.b), z.b + z.u / (z.p + z.r) * (z.x0 - z.a - z.b), z.p - z.p * z.p / (z.p + z.r), z.u - z.p * z.u / (z.p + z.r), z.w - z.u * z.u / (z.p + z.r) FROM (SELECT o.series_id, o.t, o.x0, f.a, f.b, f.p + 2 * f.u + f.w + c.q AS p, f.u + f.w AS u, f.w + 1e-5 AS w, c.r FROM f JOIN o ON o.series_id = f.series_id AND o.t = f.t + 1 JOIN c ON c.series_id = f.series_id) z)", "SELECT series_id, max_by(a, t) AS level, max_by(b, t) AS slope, max_by(a + b, t) AS estimate FROM f GROUP BY series_id"),
    "elliptic_envelope": ("d AS (SELECT series_id, t, x0 AS v, x0 - lag(x0) OVER (PARTITION BY series_id ORDER BY t) AS s FROM o), z AS (SELECT series_id, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-9) AS a, (s - avg(s) OVER w) / (stddev_pop(s) OVER w + 1e-9) AS b FROM d WHERE s IS NOT NULL WINDOW w AS (PARTITION BY series_id)), c AS (SELECT series_id, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM z GROUP BY series_id), m AS (SELECT z.series_id, (a * a * bb - 2 * a * b * ab + b * b * aa) / (aa * bb - ab * ab) AS m FROM z JOIN c ON z.series_id = c.series_id), q AS (SELECT series_id, quantile_cont(m, 0.9) AS q FROM m GROUP BY series_id)", "SELECT m.series_id, count_if(m > q) AS n_anomalies, max(m) AS max_score FROM m JOIN q ON m.series_id = q.series_id GROUP BY m.series_id"),
}


def _oracle(body: tuple[str, str], names: tuple[str, ...]) -> str:
    return f"WITH RECURSIVE {OBS_EVENTS}, ids AS (SELECT series_id, count(*) >= {SHORTEST} AND min(x0) < max(x0) AS fit FROM obs GROUP BY series_id), o AS (SELECT obs.* FROM obs JOIN ids ON obs.series_id = ids.series_id AND fit), {body[0]}, out AS ({body[1]}) SELECT ids.series_id, {', '.join(f'round(out.{n}, 6) AS {n}' for n in names)} FROM ids LEFT JOIN out ON ids.series_id = out.series_id"


#: Series and rows that a kernel of many series takes at once; a longer series is taken by itself.
TOGETHER, ROWS_TOGETHER = 64, 4096


def fit(x: np.ndarray) -> bool:
    return len(x) >= SHORTEST and x.min() < x.max()


def by_length(xs: list[np.ndarray]) -> list[list[int]]:
    """Places of series, those of like length together, as many as a kernel of many series takes at once."""
    out: list[list[int]] = []
    for i in sorted(range(len(xs)), key=lambda i: len(xs[i])):
        if out and len(out[-1]) < TOGETHER and (len(out[-1]) + 1) * len(xs[i]) <= ROWS_TOGETHER:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def kernel(*names: str, name: str | None = None, layer: str = "signal", many: Callable | None = None, **about):
    """Registers f(x) -> numbers as a query over all series.

    A series shorter than SHORTEST rows, a constant one, and one whose equations are singular give nulls; any other
    error is one of the kernel, and stops the query. many: f of a list of series, whose numbers are those of f for
    each; it is given series of like length.
    """

    def add(f: Callable):
        schema = "series_id bigint, " + ", ".join(f"{n} double" for n in names)

        def group(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values("t")["x0"].to_numpy(float)
            out = [None] * len(names)
            if fit(x):
                try:
                    out = [float(v) for v in f(x)]
                except np.linalg.LinAlgError:
                    pass
            return pd.DataFrame([[pdf["series_id"].iloc[0], *out]], columns=["series_id", *names])

        def groups(batches):
            for b in batches:
                values, ends = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(pc.list_value_length(b.column("x")).to_numpy())
                xs = np.split(values, ends[:-1])
                out: list = [(None,) * len(names)] * len(xs)
                some = [i for i, x in enumerate(xs) if fit(x)]
                for at in by_length([xs[i] for i in some]):
                    for i, got in zip(at, many([xs[some[i]] for i in at]), strict=True):
                        out[some[i]] = tuple(float(v) for v in got)
                yield pa.RecordBatch.from_arrays([b.column("series_id"), *[pa.array(c, pa.float64()) for c in zip(*out, strict=True)]], ["series_id", *names])

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            obs = obs_events(spark, sf_dir)
            if many is None:
                out = obs.groupBy("series_id").applyInPandas(group, schema)
            else:
                in_order = F.sort_array(F.collect_list(F.struct("t", F.col("x0").cast("double").alias("x0"))))
                out = obs.groupBy("series_id").agg(in_order["x0"].alias("x")).mapInArrow(groups, schema)
            return out.select("series_id", *[F.round(n, 6).alias(n) for n in names])

        run.__name__, run.__doc__ = name or f.__name__, f.__doc__
        body = SQL.get(run.__name__)
        query(body and _oracle(body, names), run.__name__, layer=layer, **about)(run)
        return f

    return add


def lags(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x[t-1], ..., x[t-p]) and x[t]."""
    return np.stack([x[p - k - 1 : len(x) - k - 1] for k in range(p)], 1), x[p:]


def least_squares(a: np.ndarray, y: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    if ridge:
        return np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ y)
    return np.linalg.lstsq(a, y, rcond=None)[0]


@kernel("top_component_energy", "mean_abs_change")
def ssa_decompose(x):
    """Singular spectrum analysis: window 20, rank 3, diagonal averages."""
    w = min(20, len(x) // 2)
    a = np.lib.stride_tricks.sliding_window_view(x, w).T
    u, s, v = np.linalg.svd(a, full_matrices=False)
    low = (u[:, :3] * s[:3]) @ v[:3]
    flat = np.add.outer(np.arange(a.shape[0]), np.arange(a.shape[1])).ravel()
    y = np.bincount(flat, low.ravel()) / np.bincount(flat)
    return s[0] ** 2 / (s**2).sum(), np.abs(np.diff(y)).mean()


@kernel("mean_envelope")
def hilbert_envelope(x):
    """Mean of the size of the analytic signal."""
    f = np.fft.fft(x)
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return (np.abs(np.fft.ifft(f * h)).mean(),)


@kernel("dominant_freq", "confidence")
def periodogram(x):
    """Strongest frequency of the one-sided periodogram and its share."""
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2
    p[1 : (len(x) + 1) // 2] *= 2
    k = 1 + p[1:].argmax()
    return k / len(x), p[k] / p.sum()


@kernel("dominant_freq", "concentration")
def welch_psd(x):
    """Welch's spectrum: Hann windows with half overlap, constant detrend."""
    n = min(len(x), max(8, len(x) // 4))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[:: max(1, n - n // 2)]
    p = (np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * w)) ** 2).mean(0)
    p[1 : (n + 1) // 2] *= 2
    k = 1 + p[1:].argmax()
    return k / n, p[k] / p.sum()


@kernel("entropy")
def spectral_entropy(x):
    """Entropy of the normalised periodogram above frequency 0, out of the greatest."""
    p = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
    p = np.maximum(p / p.sum(), 1e-300)
    return (-(p * np.log(p)).sum() / np.log(len(p)),)


@kernel("trend_last", "cycle_std")
def hp_filter(x):
    """Hodrick-Prescott trend, lambda 100."""
    d = np.diff(np.eye(len(x)), 2, axis=0)
    t = np.linalg.solve(np.eye(len(x)) + 100 * d.T @ d, x)
    return t[-1], (x - t).std()


@kernel("compressibility")
def kolmogorov_complexity(x):
    """Length of the compressed bytes of eight quantile symbols, out of their number."""
    s = np.digitize(x, np.quantile(x, np.arange(1, 8) / 8)).astype(np.uint8).tobytes()
    return (len(zlib.compress(s, 9)) / len(s),)


@kernel("lyapunov")
def lyapunov_exponent(x):
    """Mean log divergence of nearest neighbours in three delays over five steps."""
    e = np.lib.stride_tricks.sliding_window_view(x, 3)
    d = np.linalg.norm(e[:, None] - e[None], axis=2)
    i = np.arange(len(e))
    d[np.abs(i[:, None] - i[None]) <= 2] = np.inf
    usable = len(e) - 5
    near = d[:usable, :usable].argmin(1)
    k = np.arange(1, 6)
    now = np.maximum(d[np.arange(usable), near], 1e-12)
    later = np.stack([np.maximum(np.linalg.norm(e[np.arange(usable) + s] - e[near + s], axis=1), 1e-12) for s in k])
    return ((np.log(later / now) / k[:, None]).mean(),)


@kernel("n_features", "total_persistence", "max_persistence", "persistence_entropy")
def persistent_homology(x):
    """Persistence of sublevel components by the elder rule."""
    root, birth, out = {}, {}, []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.argsort(x, kind="stable"):
        root[i], birth[i] = i, x[i]
        for j in (i - 1, i + 1):
            if j in root:
                a, b = find(i), find(j)
                if a != b:
                    if birth[a] < birth[b]:
                        a, b = b, a
                    if x[i] > birth[a]:
                        out.append(x[i] - birth[a])
                    root[a] = b
    p = np.array(out)
    q = p / p.sum()
    return len(p), p.sum(), p.max(), -(q * np.log(q)).sum()


@kernel("n_coords", "first_coordinate_spread")
def diffusion_map(x):
    """Spread of the first diffusion coordinate of five delays."""
    e = np.lib.stride_tricks.sliding_window_view(x, 5)
    d = ((e[:, None] - e[None]) ** 2).sum(2)
    k = np.exp(-d / np.median(d[d > 0]))
    r = k.sum(1)
    w, v = np.linalg.eigh(k / np.sqrt(np.outer(r, r)))
    c = v[:, -2] / np.sqrt(r) * w[-2]
    return 3, c.std()


@kernel("break_at", "score")
def bocpd_break(x):
    """Bayesian online changepoints, hazard 1/100: the greatest drop of the expected run length."""
    m0, s2 = x.mean(), x.var() + 1e-12
    p, m, k = np.ones(1), np.array([m0]), np.array([1.0])
    expected, drops = 0.0, []
    for v in x:
        var = s2 * (1 + 1 / k)
        like = np.exp(-0.5 * (v - m) ** 2 / var) / np.sqrt(var)
        grow, change = p * like * 0.99, (p * like).sum() * 0.01
        p = np.concatenate([[change], grow])
        p /= p.sum() + 1e-300
        m, k = np.concatenate([[m0], (k * m + v) / (k + 1)]), np.concatenate([[1.0], k + 1])
        now = (p * np.arange(len(p))).sum()
        drops.append(max(0.0, expected + 1 - now) / (expected + 1))
        expected = now
    i = int(np.argmax(drops))
    return i, drops[i]


@kernel("next", "volatility", "persistence", layer="sequence")
def garch_forecast(x):
    """GARCH(1,1) of the steps by a search over a fixed grid of the likelihood."""
    e = np.diff(x) - np.diff(x).mean()
    v = e.var()
    best = None
    for a in np.linspace(0.02, 0.4, 20):
        for b in np.linspace(0.4, 0.97, 20):
            if a + b < 0.995:
                h, w, total = v, v * (1 - a - b), 0.0
                for z in e:
                    total += np.log(h) + z * z / h
                    h = w + a * z * z + b * h
                if best is None or total < best[0]:
                    best = (total, h, a + b)
    return x[-1], np.sqrt(best[1]), best[2]


@kernel("next", layer="sequence")
def arma_forecast(x, p=2, q=2):
    """ARMA(2,2) in two stages: a long autoregression gives the innovations."""
    m = x.mean()
    z = x - m
    long = min(10, len(z) // 3)
    a, y = lags(z, long)
    e = np.concatenate([np.zeros(long), y - a @ least_squares(a, y)])
    k = max(p, q)
    design = np.concatenate([np.stack([z[k - i - 1 : len(z) - i - 1] for i in range(p)], 1), np.stack([e[k - i - 1 : len(z) - i - 1] for i in range(q)], 1)], 1)
    c = least_squares(design, z[k:])
    return (m + c[:p] @ z[-1 : -p - 1 : -1] + c[p:] @ e[-1 : -q - 1 : -1],)


@kernel("next", layer="sequence")
def arima_forecast(x):
    """The same on the steps, added to the last value."""
    return (x[-1] + arma_forecast(np.diff(x))[0],)


@kernel("period", "next", layer="sequence")
def sarima_forecast(x):
    """Seasonal difference at the strongest period of the steps' autocorrelation, then ARMA."""
    d = np.diff(x) - np.diff(x).mean()
    ac = np.array([d[k:] @ d[:-k] for k in range(2, min(60, len(d) // 2))]) / (d @ d)
    m = 2 + int(ac.argmax())
    if ac.max() <= 0.2 or len(x) < 3 * m:
        return 1, arima_forecast(x)[0]
    return m, x[-m] + arma_forecast(x[m:] - x[:-m], 2, 1)[0]


@kernel("next", "std", layer="sequence")
def bayesian_ar_ensemble(x):
    """Autoregressions of order 1 to 5, weighed by their information criteria."""
    out = []
    for p in range(1, 6):
        a, y = lags(x, p)
        a = np.column_stack([np.ones(len(a)), a])
        c = least_squares(a, y)
        s = ((y - a @ c) ** 2).mean()
        out.append((len(y) * np.log(s) + (p + 1) * np.log(len(y)), c[0] + c[1:] @ x[-1 : -p - 1 : -1]))
    bic, f = np.array(out).T
    w = np.exp(-0.5 * (bic - bic.min()))
    w /= w.sum()
    m = w @ f
    return m, np.sqrt(w @ (f - m) ** 2)


@kernel("next", layer="sequence")
def esn_forecaster(x, weights=None):
    """Echo state network: 64 leaky units, spectral radius 0.9, ridge readout."""
    rng = np.random.default_rng(0)
    n = 64
    w = rng.standard_normal((n, n)) if weights is None else weights
    w = w * 0.9 / np.abs(np.linalg.eigvals(w)).max()
    inp = rng.uniform(-0.5, 0.5, n)
    z = (x - x.mean()) / (x.std() + 1e-9)
    s, states = np.zeros(n), []
    for v in z:
        s = 0.7 * s + 0.3 * np.tanh(w @ s + inp * v)
        states.append(s)
    a = np.column_stack([np.ones(len(z)), states])
    wash = min(10, len(z) // 4)
    c = least_squares(a[wash:-1], z[wash + 1 :], 1e-3)
    return (a[-1] @ c * (x.std() + 1e-9) + x.mean(),)


@kernel("next", layer="sequence")
def deterministic_esn_forecaster(x):
    """The same with weights of a logistic map instead of draws."""
    v, out = 0.137, []
    for _ in range(64 * 64):
        v = 3.99 * v * (1 - v)
        out.append(v - 0.5)
    return esn_forecaster(x, np.array(out).reshape(64, 64))


@kernel("next", layer="sequence")
def kernel_ridge_forecast(x):
    """Kernel ridge regression on five lags, radial kernel."""
    m, s = x.mean(), x.std() + 1e-9
    a, y = lags((x - m) / s, 5)
    q = ((x - m) / s)[-1:-6:-1]
    k = np.exp(-((a[:, None] - a[None]) ** 2).sum(2) / 5)
    return (m + s * np.exp(-((a - q) ** 2).sum(1) / 5) @ np.linalg.solve(k + np.eye(len(k)), y),)


@kernel("next", "std", layer="probability")
def gaussian_process(x):
    """Gaussian process over time, radial kernel of a tenth of the series and white noise."""
    m, s = x.mean(), x.std() + 1e-9
    t = np.arange(len(x)) / len(x)
    k = np.exp(-0.5 * ((t[:, None] - t[None]) / 0.1) ** 2)
    c = k + 0.5 * np.eye(len(x))
    q = np.exp(-0.5 * ((1 - t) / 0.1) ** 2)
    return m + s * q @ np.linalg.solve(c, (x - m) / s), s * np.sqrt(max(0.0, 1.5 - q @ np.linalg.solve(c, q)))


@kernel("next", "std", layer="probability")
def bayesian_ridge(x):
    """Ridge regression on three lags whose two precisions maximise the evidence."""
    a, y = lags(x, 3)
    ma, my = a.mean(0), y.mean()
    a, y = a - ma, y - my
    alpha, beta = 1.0, 1 / (y.var() + 1e-12)
    w, g = np.linalg.eigh(a.T @ a)
    for _ in range(50):
        cov = g @ np.diag(1 / (alpha + beta * w)) @ g.T
        mean = beta * cov @ a.T @ y
        gamma = (beta * w / (alpha + beta * w)).sum()
        alpha, beta = gamma / (mean @ mean + 1e-12), (len(y) - gamma) / (((y - a @ mean) ** 2).sum() + 1e-12)
    q = x[-1:-4:-1] - ma
    return my + q @ mean, np.sqrt(1 / beta + q @ cov @ q)


@kernel("mean", "ci_low", "ci_high", layer="probability")
def bayesian_bootstrap(x):
    """Mean step of 1000 redraws, added to the last value."""
    d = np.diff(x)
    m = d[np.random.default_rng(0).integers(0, len(d), (1000, len(d)))].mean(1)
    return x[-1] + m.mean(), x[-1] + np.quantile(m, 0.05), x[-1] + np.quantile(m, 0.95)


def _resampled(rng, w):
    return np.minimum(np.searchsorted(np.cumsum(w), (np.arange(len(w)) + rng.random()) / len(w)), len(w) - 1)


@kernel("estimate", "variance", layer="probability")
def particle_filter(x):
    """Random walk of the standardised level by 300 particles, systematic resampling."""
    rng = np.random.default_rng(0)
    m, s = x.mean(), x.std() + 1e-9
    p, w = np.full(300, (x[0] - m) / s), np.full(300, 1 / 300)
    for v in (x - m) / s:
        p = p + rng.normal(0, 0.1, 300)
        w = w * np.exp(-0.5 * (v - p) ** 2 / 0.1) + 1e-300
        w /= w.sum()
        if 1 / (w**2).sum() < 150:
            p, w = p[_resampled(rng, w)], np.full(300, 1 / 300)
    e = w @ p
    return m + s * e, s * s * (w @ (p - e) ** 2)


@kernel("vol_forecast", "phi", layer="probability")
def sv_particle(x):
    """Stochastic volatility: log variance as an autoregression, filtered by 400 particles."""
    d = np.diff(x)
    d = d - d.mean()
    y = np.log(d * d + 1e-12)
    c = np.cov(y[1:], y[:-1])[0, 1] / (y.var() + 1e-12)
    phi, mu = float(np.clip(c * 2, 0.1, 0.98)), y.mean() + 1.27
    eta = np.sqrt(max(0.01, (y.var() - 4.93) * (1 - phi * phi)))
    rng = np.random.default_rng(0)
    h = mu + rng.standard_normal(400) * eta
    for v in d:
        h = mu + phi * (h - mu) + eta * rng.standard_normal(400)
        w = np.exp(-0.5 * (h + v * v * np.exp(-h)))
        w = (w + 1e-300) / (w + 1e-300).sum()
        h = h[_resampled(rng, w)]
    return np.exp(0.5 * (mu + phi * (h - mu))).mean(), phi


@kernel("current_state", "stay", "log_likelihood", layer="sequence")
def gaussian_hmm(x):
    """Two-state Gaussian hidden Markov model by 15 rounds of Baum-Welch, started from halves by value."""
    m = np.array([x[x <= np.median(x)].mean(), x[x > np.median(x)].mean()])
    v, a, pi = np.full(2, x.var()), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5])
    for _ in range(15):
        b = np.exp(-0.5 * (x[:, None] - m) ** 2 / v) / np.sqrt(2 * np.pi * v) + 1e-300
        f, c = np.zeros((len(x), 2)), np.zeros(len(x))
        for t in range(len(x)):
            f[t] = (pi if t == 0 else f[t - 1] @ a) * b[t]
            c[t] = f[t].sum()
            f[t] /= c[t]
        r = np.ones((len(x), 2))
        for t in range(len(x) - 2, -1, -1):
            r[t] = a @ (b[t + 1] * r[t + 1]) / c[t + 1]
        g = f * r
        g /= g.sum(1, keepdims=True)
        xi = (f[:-1, :, None] * a * (b[1:] * r[1:])[:, None] / c[1:, None, None]).sum(0) + 1e-3
        a, pi = xi / xi.sum(1, keepdims=True), g[0] + 1e-3
        pi /= pi.sum()
        m = (g * x[:, None]).sum(0) / g.sum(0)
        v = (g * (x[:, None] - m) ** 2).sum(0) / g.sum(0) + 1e-2
    k = int(f[-1].argmax())
    return k, a[k, k], np.log(c).sum()


@kernel("estimate", "n_modes", "largest", layer="equation")
def koopman_dmd(x):
    """Linear operator on twelve delays by least squares: next value and the size of its modes."""
    e = np.lib.stride_tricks.sliding_window_view(x, 12)
    k = least_squares(e[:-1], e[1:])
    w = np.linalg.eigvals(k)
    return (e[-1] @ k)[-1], len(w), np.abs(w).max()


@kernel("level", "slope", "estimate", layer="equation")
def bsts_forecast(x):
    """Local linear trend by a Kalman filter with variances from the steps."""
    r, q1, q2 = max(x.var(), 1e-3), max(np.diff(x).var() / 6, 1e-3), 1e-5
    s, p = np.array([x[0], 0.0]), np.eye(2) * r
    f = np.array([[1.0, 1.0], [0.0, 1.0]])
    for v in x[1:]:
        s, p = f @ s, f @ p @ f.T + np.diag([q1, q2])
        k = p[:, 0] / (p[0, 0] + r)
        s, p = s + k * (v - s[0]), p - np.outer(k, p[0])
    return s[0], s[1], s.sum()


@kernel("coef", "intercept", layer="equation")
def huber_regression(x):
    """Line over time by iterated weights, threshold 1.35 of the scale."""
    a = np.column_stack([np.arange(len(x)), np.ones(len(x))])
    c = least_squares(a, x)
    for _ in range(50):
        e = x - a @ c
        s = np.median(np.abs(e)) / 0.6745 + 1e-9
        w = np.minimum(1, 1.35 * s / (np.abs(e) + 1e-12))
        c = np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ x)
    return c


@kernel("coef", "intercept", layer="equation")
def quantile_regression(x):
    """Median line over time by iterated weights."""
    a = np.column_stack([np.arange(len(x)), np.ones(len(x))])
    c = least_squares(a, x)
    for _ in range(200):
        w = 1 / np.maximum(np.abs(x - a @ c), 1e-6)
        c = np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ x)
    return c


@kernel("coef", "r2", layer="equation")
def ard_regression(x):
    """Line over time whose precision of weight and noise maximise the evidence."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    y = x - x.mean()
    alpha, beta = 1.0, 1 / (y.var() + 1e-12)
    for _ in range(100):
        s = 1 / (alpha + beta * (t @ t))
        m = beta * s * (t @ y)
        g = 1 - alpha * s
        alpha, beta = g / (m * m + 1e-12), (len(y) - g) / (((y - m * t) ** 2).sum() + 1e-12)
    return m, 1 - ((y - m * t) ** 2).sum() / (y @ y + 1e-12)


@kernel("n_active", "r2", layer="equation")
def sindy_regression(x):
    """Sparse dynamics: thresholded least squares of the derivative on six functions."""
    z = (x - x.mean()) / (x.std() + 1e-9)
    d = np.gradient(z)
    a = np.stack([np.ones(len(z)), z, z**2, z**3, np.sin(z), np.cos(z)], 1)
    on = np.ones(6, bool)
    for _ in range(10):
        c = np.zeros(6)
        c[on] = least_squares(a[:, on], d)
        on = np.abs(c) >= 0.05
        if not on.any():
            break
    return on.sum(), 1 - ((d - a @ np.where(on, c, 0)) ** 2).sum() / (((d - d.mean()) ** 2).sum() + 1e-12)


@kernel("next", layer="sequence")
def prophet_like_forecast(x):
    """Line with a bend at the middle and three Fourier pairs over time."""
    n = len(x)

    def row(t):
        t = np.asarray(t, float)
        return np.stack([np.ones_like(t), t, np.maximum(0, t - n // 2), *[f(2 * np.pi * k * t / n) for k in (1, 2, 3) for f in (np.sin, np.cos)]], -1)

    return (row(n) @ least_squares(row(np.arange(n)), x),)


@kernel("n_clusters", "silhouette", layer="pattern")
def kmeans(x):
    """Three clusters of value and step, started far apart."""
    z = np.column_stack([x[1:], np.diff(x)])
    z = (z - z.mean(0)) / (z.std(0) + 1e-9)
    c = [z[0]]
    for _ in range(2):
        c.append(z[np.min([((z - p) ** 2).sum(1) for p in c], 0).argmax()])
    c = np.array(c)
    for _ in range(50):
        k = ((z[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([z[k == i].mean(0) if (k == i).any() else c[i] for i in range(3)])
    d = np.linalg.norm(z[:, None] - z[None], axis=2)
    s = []
    for i in range(len(z)):
        own = (k == k[i]).sum()
        inner = d[i][k == k[i]].sum() / max(1, own - 1)
        outer = min(d[i][k == j].mean() for j in range(3) if j != k[i] and (k == j).any())
        s.append(0.0 if own == 1 else (outer - inner) / max(inner, outer))
    return len(set(k)), np.mean(s)


@kernel("bic", "weight_low", layer="pattern")
def gmm(x):
    """Mixture of two Gaussians by 50 rounds of expectation and maximisation."""
    m, v, w = np.quantile(x, [0.25, 0.75]), np.full(2, x.var()), np.full(2, 0.5)
    for _ in range(50):
        p = w * np.exp(-0.5 * (x[:, None] - m) ** 2 / v) / np.sqrt(2 * np.pi * v) + 1e-300
        r = p / p.sum(1, keepdims=True)
        n = r.sum(0)
        m, w = (r * x[:, None]).sum(0) / n, n / len(x)
        v = (r * (x[:, None] - m) ** 2).sum(0) / n + 1e-6
    return -2 * np.log(p.sum(1)).sum() + 5 * np.log(len(x)), w[0]


@kernel("n_clusters", "last_height", layer="pattern")
def agglomerative(x):
    """Ward linkage of the values to three clusters; in one dimension only neighbours merge."""
    groups = [(1, v) for v in np.sort(x)]
    height = 0.0
    while len(groups) > 3:
        cost = [a[0] * b[0] / (a[0] + b[0]) * (b[1] - a[1]) ** 2 for a, b in zip(groups, groups[1:])]
        i = int(np.argmin(cost))
        (n, a), (k, b) = groups[i], groups[i + 1]
        groups[i : i + 2] = [(n + k, (n * a + k * b) / (n + k))]
        height = cost[i]
    return len(groups), np.sqrt(2 * height)


@kernel("n_anomalies", "max_score", layer="noise")
def isolation_forest(x):
    """Mean path length over 50 random trees of value and step."""
    z = np.column_stack([x[1:], np.diff(x)])
    rng = np.random.default_rng(0)
    n = min(len(z), 64)
    limit = int(np.ceil(np.log2(n)))
    expected = lambda k: 0.0 if k < 2 else 2 * (np.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k
    depth = np.zeros(len(z))

    def walk(sample, rows, level):
        if level >= limit or len(sample) < 2 or not len(rows):
            depth[rows] += level + expected(len(sample))
            return
        j = rng.integers(0, 2)
        lo, hi = sample[:, j].min(), sample[:, j].max()
        cut = rng.uniform(lo, hi)
        left = z[rows, j] < cut
        walk(sample[sample[:, j] < cut], rows[left], level + 1)
        walk(sample[sample[:, j] >= cut], rows[~left], level + 1)

    for _ in range(50):
        walk(z[rng.choice(len(z), n, replace=False)], np.arange(len(z)), 0)
    s = 2 ** (-depth / 50 / expected(n))
    return (s > 0.6).sum(), s.max()


@kernel("residual", layer="noise")
def emd_decompose(x):
    """First mode by ten siftings with linear envelopes: its share of the deviation."""
    h, t = x - x.mean(), np.arange(len(x))
    for _ in range(10):
        up = np.flatnonzero((h[1:-1] >= h[:-2]) & (h[1:-1] > h[2:])) + 1
        down = np.flatnonzero((h[1:-1] <= h[:-2]) & (h[1:-1] < h[2:])) + 1
        if len(up) < 2 or len(down) < 2:
            break
        h = h - (np.interp(t, up, h[up]) + np.interp(t, down, h[down])) / 2
    return (h.std() / (x.std() + 1e-12),)


@kernel("snr", layer="noise")
def butter_lowpass(x):
    """Third-order Butterworth low pass at a fifth of Nyquist, forward and back, in the frequency domain."""
    n = len(x)
    ext = np.concatenate([2 * x[0] - x[:0:-1], x, 2 * x[-1] - x[-2::-1]])
    f = np.fft.rfftfreq(len(ext))
    y = np.fft.irfft(np.fft.rfft(ext) / (1 + (np.tan(np.pi * np.minimum(f, 0.4999)) / np.tan(np.pi * 0.1)) ** 6), len(ext))[n - 1 : 2 * n - 1]
    return (y.var() / ((x - y).var() + 1e-12),)


@kernel("multifractal_width", "hurst_q2")
def mfdfa(x):
    """Fluctuations about lines in windows of 8 to 32: slopes for the moments -2 and 2."""
    y = np.cumsum(x - x.mean())
    scales = [s for s in (8, 11, 16, 22, 32) if len(x) >= 2 * s]
    out = []
    for q in (-2, 2):
        f = []
        for s in scales:
            w = y[: len(y) // s * s].reshape(-1, s)
            a = np.column_stack([np.arange(s), np.ones(s)])
            e = w.T - a @ np.linalg.lstsq(a, w.T, rcond=None)[0]
            f.append((((e**2).mean(0) + 1e-12) ** (q / 2)).mean() ** (1 / q))
        out.append(np.polyfit(np.log(scales), np.log(f), 1)[0])
    return abs(out[0] - out[1]), out[1]


@kernel("complexity", "r2", layer="equation")
def genetic_symbolic_regression(x):
    """Expression trees over time, 14 generations of 40 with tournaments, crossover and mutation."""
    rng = np.random.default_rng(0)
    t = np.linspace(-1, 1, len(x))
    y = (x - x.mean()) / (x.std() + 1e-9)
    ops = {"+": np.add, "-": np.subtract, "*": np.multiply, "sin": np.sin, "cos": np.cos}

    def tree(depth):
        if depth == 0 or rng.random() < 0.25:
            return "t" if rng.random() < 0.6 else float(rng.normal())
        op = str(rng.choice(list(ops)))
        return (op, tree(depth - 1)) if op in ("sin", "cos") else (op, tree(depth - 1), tree(depth - 1))

    def value(e):
        return t if isinstance(e, str) else np.full(len(t), e) if isinstance(e, float) else ops[e[0]](*[value(a) for a in e[1:]])

    size = lambda e: 1 + sum(size(a) for a in e[1:]) if isinstance(e, tuple) else 1

    def fitness(e):
        v = value(e)
        if v.std() < 1e-9:
            return -0.005 * size(e)
        return np.corrcoef(v, y)[0, 1] ** 2 - 0.005 * size(e)

    def change(e, other, depth=3):
        if not isinstance(e, tuple) or rng.random() < 0.3:
            return other
        i = rng.integers(1, len(e))
        return (*e[:i], change(e[i], other, depth - 1), *e[i + 1 :])

    pool = [tree(3) for _ in range(40)]
    for _ in range(14):
        scores = [fitness(e) for e in pool]
        pick = lambda: pool[max(rng.integers(0, 40, 3), key=lambda i: scores[i])]
        new = [pool[int(np.argmax(scores))]]
        while len(new) < 40:
            e = change(pick(), pick() if rng.random() < 0.7 else tree(2))
            new.append(e if size(e) < 30 else tree(3))
        pool = new
    best = max(pool, key=fitness)
    return size(best), fitness(best) + 0.005 * size(best)


@kernel("z", "value", "hold", layer="decision")
def hjb_control(x):
    """Value iteration over 41 levels of the last standard score: hold at a cost or leave."""
    grid = np.linspace(-3, 3, 41)
    pull = np.abs(grid[:, None] * 0.7 - grid[None]).argmin(1)
    v = np.zeros(41)
    for _ in range(500):
        v = np.maximum(0.0, 1 - grid**2 + 0.95 * v[pull])
    z = (x[-1] - x.mean()) / (x.std() + 1e-9)
    i = np.abs(grid - z).argmin()
    return z, v[i], v[i] > 0


@kernel("turnover", "naive_turnover", layer="decision")
def mpc_position(x):
    """Positions that trade a standardised signal against the cost of moving."""
    s = (x - x.mean()) / (x.std() + 1e-9)
    n = len(s)
    lap = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    lap[0, 0] = lap[-1, -1] = 1
    p = np.clip(np.linalg.solve(2 * np.eye(n) + 5 * lap, s), -5, 5)
    return np.abs(np.diff(p)).sum(), np.abs(np.diff(s)).sum()
