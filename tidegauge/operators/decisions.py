"""Decisions and actions: one belief a series, or one for the table where columns are arms or assets."""

from __future__ import annotations

from ..catalog import sql_query
from ..sources.tables import OBS_DIFF, OBS_EVENTS, PANEL
from .forecasts import r


def decide(name: str, sql: str, doc: str, source: str = OBS_EVENTS, layer: str = "decision") -> None:
    sql_query(name, f"WITH {source}{sql}", doc, layer=layer)


decide("threshold_policy", f", z AS (SELECT series_id, (max_by(x0, t) - avg(x0)) / (stddev_pop(x0) + 1e-9) AS z FROM obs GROUP BY series_id) SELECT series_id, CASE WHEN z > 1 THEN 'buy' WHEN z < -1 THEN 'sell' ELSE 'hold' END AS action, {r('z', 'z')}, {r('tanh(abs(z))', 'confidence')} FROM z", "Buys if the last value is a deviation above the mean, sells below.")
decide("sign_vote", f", v AS (SELECT series_id, avg(sign(dx)) AS v FROM d WHERE dx IS NOT NULL GROUP BY series_id) SELECT series_id, CASE WHEN v > 0 THEN 'buy' WHEN v < 0 THEN 'sell' ELSE 'hold' END AS action, {r('v', 'vote')}, {r('abs(v)', 'confidence')} FROM v", "Mean sign of the steps.", OBS_DIFF)
decide("log_utility", f", k AS (SELECT series_id, greatest(-1, least(1, avg(dx) / (var_samp(dx) + 1e-12))) AS f FROM d WHERE dx IS NOT NULL GROUP BY series_id) SELECT series_id, CASE WHEN f > 1e-3 THEN 'long' WHEN f < -1e-3 THEN 'short' ELSE 'flat' END AS action, {r('f', 'fraction')} FROM k", "Kelly fraction of the steps, between -1 and 1.", OBS_DIFF)
decide("merton_fraction", f" SELECT series_id, {r('avg(dx) / (3 * var_samp(dx) + 1e-12)', 'fraction')} FROM d WHERE dx IS NOT NULL GROUP BY series_id", "Merton's fraction for a risk aversion of 3.", OBS_DIFF)
decide("almgren_exec", f", k AS (SELECT series_id, acosh(1 + 0.5e-6 * var_pop(dx)) AS k FROM d WHERE dx IS NOT NULL GROUP BY series_id), f AS (SELECT series_id, k, CASE WHEN k < 1e-9 THEN 0.1 ELSE 1 - sinh(9 * k) / sinh(10 * k) END AS f FROM k) SELECT series_id, round(k, 6) AS kappa, round(f, 6) AS execution_fraction, CASE WHEN f > 0.15 THEN 'urgent' ELSE 'patient' END AS action FROM f", "First slice of an optimal execution over ten steps.", OBS_DIFF)
decide("bs_pricing", ", p AS (SELECT series_id, greatest(max_by(x0, t), 1e-9) AS s, greatest(stddev_pop(CASE WHEN t >= n - 20 THEN coalesce(dx, 0) END) / greatest(max_by(x0, t), 1e-9), 1e-9) AS v FROM d GROUP BY series_id), c AS (SELECT *, v / 2 AS d1, 1 / (1 + 0.2316419 * (v / 2)) AS k FROM p), n AS (SELECT *, 1 - exp(-d1 * d1 / 2) / sqrt(2 * pi()) * (0.319381530 * k - 0.356563782 * k * k + 1.781477937 * power(k, 3) - 1.821255978 * power(k, 4) + 1.330274429 * power(k, 5)) AS cdf FROM c) SELECT series_id, " + r("s * (2 * cdf - 1)", "atm_call", 4) + ", " + r("cdf", "delta", 5) + ", " + r("s * exp(-d1 * d1 / 2) / sqrt(2 * pi())", "vega", 4) + " FROM n", "At-the-money call without interest over one period; the normal law by a polynomial.", OBS_DIFF)
_ARMS = ", ".join(f"SELECT {i} AS arm, a{i} AS x, t FROM panel" for i in range(1, 6)).replace(", SELECT", " UNION ALL SELECT")
_VALUES = f", arms AS ({_ARMS}), m AS (SELECT arm, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM arms GROUP BY arm), z AS (SELECT *, (m - avg(m) OVER ()) / (stddev_pop(m) OVER () + 1e-12) AS z FROM m)"
decide("ucb_bandit", _VALUES + f" SELECT max_by(arm, m) AS arm, {r('max(m) + sqrt(2 * ln(max(n) * count(*)) / max(n))', 'ucb', 3)} FROM m", "Greatest mean plus the bonus that all arms share.", PANEL, "rl")
decide("discounted_ucb", _VALUES + f", w AS (SELECT arm, sum(power(0.95, n - 1 - t) * x) / sum(power(0.95, n - 1 - t)) AS v FROM arms CROSS JOIN (SELECT count(*) AS n FROM panel) c GROUP BY arm) SELECT arm, {r('v', 'value', 3)} FROM w", "Means with weights that fade by 0.95 a step.", PANEL, "rl")
decide("softmax_policy", _VALUES + f" SELECT arm, {r('exp(z - max(z) OVER ()) / sum(exp(z)) OVER () * exp(max(z) OVER ())', 'probability')} FROM z", "Softmax of standardised means.", PANEL, "rl")
decide("gradient_bandit", _VALUES + f" SELECT max_by(arm, z) AS arm, {r('max(exp(z)) / sum(exp(z))', 'confidence')} FROM z", "Greatest preference over the mean.", PANEL, "rl")
decide("exp3_bandit", _VALUES + f", w AS (SELECT arm, exp(0.1 * (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER () + 1e-12)) AS w FROM m) SELECT arm, {r('0.9 * w / sum(w) OVER () + 0.1 / 5', 'probability')} FROM w", "Exponential weights of scaled means with a tenth of even exploration.", PANEL, "rl")
decide("epsilon_greedy_bandit", _VALUES + f" SELECT arm, {r('CASE WHEN rank() OVER (ORDER BY m DESC) = 1 THEN 0.9 + 0.02 ELSE 0.02 END', 'probability')} FROM m", "Choice probabilities of the greedy arm and of even exploration at 0.1.", PANEL, "rl")
decide("thompson_bandit", _VALUES + f" SELECT arm, {r('m', 'posterior_mean', 3)}, {r('s / sqrt(n)', 'posterior_std', 3)} FROM m", "Normal posteriors that the arms are drawn from.", PANEL, "rl")
decide("merton_alloc", _VALUES + f", f AS (SELECT arm, greatest(0, m / (3 * s * s + 1e-12)) AS f FROM m) SELECT arm, {r('f / sum(f) OVER ()', 'weight')} FROM f", "Long-only tilt by Merton's fractions.", PANEL)
decide("inverse_variance_alloc", _VALUES + f" SELECT arm, {r('(1 / (s * s)) / sum(1 / (s * s)) OVER ()', 'weight')} FROM m", "Weights by inverse variance.", PANEL)
decide("covariance_matrix", ", c AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_samp(a{i}, a{j}) AS cov, corr(a{i}, a{j}) AS cor FROM panel" for i in range(1, 6) for j in range(i, 6)) + ") SELECT i, j, round(cov, 0) AS cov, round(cor, 6) AS cor, round(sqrt(greatest(0, (1 - cor) / 2)), 6) AS distance FROM c", "Covariances, correlations and their distances, that allocations start from.", PANEL)
