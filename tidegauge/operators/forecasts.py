"""Forecasts and laws of a sequence: one belief a series, from aggregates and closed forms."""

from __future__ import annotations

from ..catalog import sql_query
from ..sources.tables import OBS_DAY, OBS_DIFF, OBS_EVENTS


def forecast(name: str, sql: str, doc: str, source: str = OBS_DIFF, layer: str = "sequence") -> None:
    sql_query(name, f"WITH {source}{sql}", doc, layer=layer)


def r(expression: str, name: str, places: int = 6) -> str:
    """A rounded column. The small addend makes halves of the last place go up in every engine."""
    return f"round({expression} + 3e-10, {places}) AS {name}"


forecast("naive_mean_forecast", f", m AS (SELECT series_id, avg(x0) AS m FROM obs GROUP BY series_id) SELECT o.series_id, {r('max(m)', 'estimate')}, {r('1 / (1 + avg(abs(x0 - m)))', 'confidence')} FROM obs o JOIN m ON o.series_id = m.series_id GROUP BY o.series_id", "The mean.")
forecast("persistence_forecast", f" SELECT series_id, {r('max_by(x0, t)', 'estimate')}, {r('1 / (1 + avg(abs(dx)))', 'confidence')} FROM d GROUP BY series_id", "The last value.")
forecast("drift_forecast", f", g AS (SELECT series_id, max_by(x0, t) AS l, (max_by(x0, t) - min_by(x0, t)) / (count(*) - 1) AS b FROM obs GROUP BY series_id HAVING count(*) > 1) SELECT d.series_id, {r('max(l + b)', 'estimate')}, {r('1 / (1 + avg(abs(dx - b)))', 'confidence')} FROM d JOIN g ON d.series_id = g.series_id GROUP BY d.series_id", "The last value and the mean step.")
forecast("momentum_kinematics", f", g AS (SELECT series_id, t, x0, dx, lag(dx) OVER (PARTITION BY series_id ORDER BY t) AS dp FROM d) SELECT series_id, {r('max_by(x0 + coalesce(2 * dx - dp, 0), t)', 'estimate')}, {r('max_by(coalesce(dx, 0), t)', 'velocity')}, {r('max_by(coalesce(dx - dp, 0), t)', 'acceleration')} FROM g GROUP BY series_id", "Constant acceleration; fewer than three rows persist.")
forecast("quantile_forecaster", f" SELECT series_id, {r('max_by(x0, t) + @pct(dx, 0.1)', 'q10')}, {r('max_by(x0, t) + @pct(dx, 0.5)', 'q50')}, {r('max_by(x0, t) + @pct(dx, 0.9)', 'q90')}, {r('stddev_pop(dx)', 'std')} FROM d GROUP BY series_id HAVING count(dx) >= 10", "Quantiles of the steps around the last value.")
forecast("chebyshev_bound", f" SELECT series_id, {r('max_by(x0, t)', 'estimate')}, {r('max_by(x0, t) - 3 * stddev_samp(x0)', 'lower')}, {r('max_by(x0, t) + 3 * stddev_samp(x0)', 'upper')}, {r('1 - 1 / 9.0', 'guarantee')} FROM obs GROUP BY series_id", "An interval of three deviations with Chebyshev's guarantee.", layer="probability")
forecast("bayes_update", f" SELECT series_id, {r('avg(x0)', 'posterior_mean')}, {r('var_samp(x0) / (count(*) + 1)', 'posterior_var')}, {r('sqrt(var_samp(x0) / (count(*) + 1))', 'posterior_std')} FROM obs GROUP BY series_id", "Normal posterior whose prior is the sample's own mean and variance.", layer="probability")
forecast("gbm_baseline", f", g AS (SELECT series_id, t, x0, dx, CASE WHEN x0 > 0 AND px > 0 THEN ln(x0 / px) END AS lr FROM d) SELECT series_id, {r('CASE WHEN min(x0) > 0 THEN max_by(x0, t) * exp(avg(lr) + var_samp(lr) / 2) ELSE max_by(x0, t) + avg(dx) END', 'estimate')}, {r('CASE WHEN min(x0) > 0 THEN avg(lr) ELSE avg(dx) END', 'mu')}, {r('CASE WHEN min(x0) > 0 THEN stddev_samp(lr) ELSE stddev_samp(dx) END', 'sigma')} FROM g GROUP BY series_id", "Geometric Brownian motion of a positive series, else the mean step.")
forecast("langevin_sampler", f", g AS (SELECT series_id, regr_slope(x0, px) AS b, regr_intercept(x0, px) AS a, max_by(x0, t) AS l, max(n) AS n, regr_syy(x0, px) - regr_slope(x0, px) * regr_sxy(x0, px) AS ss FROM d GROUP BY series_id HAVING max(n) >= 8) SELECT series_id, {r('a + b * l', 'estimate')}, {r('CASE WHEN b > 0 AND b < 1 THEN -ln(b) ELSE 0 END', 'gamma')}, {r('a / (1 - b)', 'mu')}, {r('CASE WHEN b > 0 AND b < 1 THEN ln(2) / -ln(b) ELSE 0 END', 'half_life')}, {r('sqrt(ss / (n - 3))', 'sigma')} FROM g", "Ornstein-Uhlenbeck process from the regression on the previous value.")
forecast("fokker_planck_moments", f", g AS (SELECT series_id, regr_slope(x0, px) AS b, regr_intercept(x0, px) AS a, max_by(x0, t) AS l, count(px) AS n, regr_syy(x0, px) - regr_slope(x0, px) * regr_sxy(x0, px) AS ss FROM d GROUP BY series_id) SELECT series_id, {r('a + b * l', 'mean')}, {r('ss / (n - 2)', 'variance')}, {r('sqrt(ss / (n - 2))', 'std')} FROM g", "Mean and variance of the transition density from the last value.", layer="probability")
forecast("heston_vol", f", v AS (SELECT series_id, t, dx * dx AS v, lag(dx * dx) OVER (PARTITION BY series_id ORDER BY t) AS pv FROM d), g AS (SELECT series_id, avg(v) AS theta, corr(v, pv) AS phi, max_by(v, t) AS l FROM v WHERE v IS NOT NULL GROUP BY series_id) SELECT series_id, {r('theta', 'theta', 4)}, {r('phi', 'phi')}, {r('CASE WHEN phi > 0 THEN -ln(phi) ELSE 0 END', 'kappa')}, {r('greatest(0, theta + phi * (l - theta))', 'next_variance', 4)} FROM g", "Mean reversion of the squared steps.", layer="equation")
forecast("conformal_forecaster", f", f AS (SELECT series_id, regr_slope(x0, px) AS b, regr_intercept(x0, px) AS a FROM d WHERE t < n / 2 GROUP BY series_id HAVING count(px) >= 5), e AS (SELECT d.series_id, @pct(CASE WHEN t >= n / 2 THEN abs(x0 - a - b * px) END, 0.9) AS q, max_by(a + b * x0, t) AS p FROM d JOIN f ON d.series_id = f.series_id GROUP BY d.series_id) SELECT series_id, {r('p', 'estimate')}, {r('p - q', 'lower')}, {r('p + q', 'upper')} FROM e", "Autoregression on the first half with the 0.9 quantile of the second half's errors.", layer="probability")
forecast("linear_regression", f" SELECT series_id, {r('regr_slope(x0, t)', 'coef')}, {r('regr_intercept(x0, t)', 'intercept')}, {r('greatest(0, coalesce(regr_r2(x0, t), 0))', 'r2')} FROM obs GROUP BY series_id", "Least-squares line over time.", layer="equation")
for _name, _slope, _doc in (
    ("ridge_regression", "regr_sxy(x0, t) / (regr_sxx(x0, t) + 1)", "Ridge line, alpha 1."),
    ("lasso_regression", "sign(regr_sxy(x0, t)) * greatest(abs(regr_sxy(x0, t)) / count(*) - 0.1, 0) / (regr_sxx(x0, t) / count(*))", "Lasso line, alpha 0.1, by soft threshold."),
    ("lasso_lars_regression", "sign(regr_sxy(x0, t)) * greatest(abs(regr_sxy(x0, t)) / count(*) - 0.01, 0) / (regr_sxx(x0, t) / count(*))", "Lasso line, alpha 0.01."),
    ("elasticnet_regression", "sign(regr_sxy(x0, t)) * greatest(abs(regr_sxy(x0, t)) / count(*) - 0.05, 0) / (regr_sxx(x0, t) / count(*) + 0.05)", "Elastic net line, alpha 0.1, half of each penalty."),
    ("lars_regression", "regr_slope(x0, t)", "Least angle regression; with one feature the least-squares line."),
    ("omp_regression", "regr_slope(x0, t)", "Orthogonal matching pursuit; with one feature the least-squares line."),
):
    forecast(_name, f", g AS (SELECT series_id, {_slope} AS b, avg(x0) AS my, avg(t) AS mt FROM obs GROUP BY series_id) SELECT series_id, {r('b', 'coef')}, {r('my - b * mt', 'intercept')} FROM g", _doc, OBS_EVENTS, "equation")
forecast("theil_sen_regression", f", p AS (SELECT a.series_id, median((b.x0 - a.x0) / (b.t - a.t)) AS s FROM obs a JOIN obs b ON a.series_id = b.series_id AND a.t < b.t GROUP BY a.series_id) SELECT o.series_id, {r('max(s)', 'coef')}, {r('median(x0 - s * t)', 'intercept')} FROM obs o JOIN p ON o.series_id = p.series_id GROUP BY o.series_id", "Median of the slopes of all pairs inside a series.", OBS_EVENTS, "equation")
forecast("polynomial_regression", f", c AS (SELECT series_id, t - avg(t) OVER (PARTITION BY series_id) AS u, x0 FROM obs), s AS (SELECT series_id, count(*) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(x0) AS y0, sum(u * x0) AS y1, sum(u * u * x0) AS y2 FROM c GROUP BY series_id), q AS (SELECT *, s4 - s2 * s2 / n - s3 * s3 / s2 AS den, y2 - y0 * s2 / n - y1 * s3 / s2 AS num FROM s) SELECT series_id, {r('num / den', 'quadratic')}, {r('(y1 - s3 * num / den) / s2', 'slope_at_mean')} FROM q", "Parabola over time about the mean time.", OBS_EVENTS, "equation")
forecast("kyle_impact", f", f AS (SELECT series_id, t, x1 AS flow, x0 - lag(x0) OVER (PARTITION BY series_id ORDER BY t) AS dp FROM obs) SELECT series_id, {r('regr_slope(dp, flow)', 'lambda', 3)}, {r('regr_r2(dp, flow)', 'r2')} FROM f WHERE dp IS NOT NULL GROUP BY series_id", "Price change on flow; the first row has none.", OBS_DAY, "equation")
forecast("grey_gm11", f", a AS (SELECT series_id, t, x0, sum(x0) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - x0 / 2 AS z FROM obs), f AS (SELECT series_id, -regr_slope(x0, z) AS a, regr_intercept(x0, z) AS b FROM a WHERE t > 0 GROUP BY series_id), o AS (SELECT series_id, min_by(x0, t) AS x, count(*) AS n FROM obs GROUP BY series_id HAVING min(x0) > 0) SELECT f.series_id, {r('a', 'a')}, {r('b', 'b', 4)}, {r('(x - b / a) * exp(-a * n) * (1 - exp(a))', 'estimate', 4)} FROM f JOIN o ON f.series_id = o.series_id", "Grey model of positive series.", OBS_EVENTS, "equation")
forecast("knn_forecast", f", l AS (SELECT series_id, t, x0, lag(x0, 1) OVER w AS a, lag(x0, 2) OVER w AS b, lag(x0, 3) OVER w AS c FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), q AS (SELECT series_id, max_by(x0, t) AS a, max_by(a, t) AS b, max_by(b, t) AS c FROM l GROUP BY series_id), k AS (SELECT l.series_id, l.x0, row_number() OVER (PARTITION BY l.series_id ORDER BY (l.a - q.a) * (l.a - q.a) + (l.b - q.b) * (l.b - q.b) + (l.c - q.c) * (l.c - q.c), l.t) AS k FROM l JOIN q ON l.series_id = q.series_id WHERE l.c IS NOT NULL) SELECT series_id, {r('avg(x0)', 'estimate')} FROM k WHERE k <= 3 GROUP BY series_id", "Mean successor of the three most like windows of three.", OBS_EVENTS)
forecast("autoregressive", f", l AS (SELECT series_id, t, x0 AS y, lag(x0, 1) OVER w AS a, lag(x0, 2) OVER w AS b FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), g AS (SELECT series_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM l WHERE b IS NOT NULL GROUP BY series_id), e AS (SELECT series_id, max_by(y, t) AS la, max_by(a, t) AS lb FROM l GROUP BY series_id) SELECT g.series_id, {r('(ay * bb - by_ * ab) / (aa * bb - ab * ab)', 'phi1')}, {r('(by_ * aa - ay * ab) / (aa * bb - ab * ab)', 'phi2')}, {r('((ay * bb - by_ * ab) * la + (by_ * aa - ay * ab) * lb) / (aa * bb - ab * ab)', 'estimate')} FROM g JOIN e ON g.series_id = e.series_id", "Autoregression of order 2 without intercept, by normal equations.", OBS_EVENTS)
forecast("ridge_forecast", f", l AS (SELECT series_id, t, x0 AS y, lag(x0, 1) OVER w AS a, lag(x0, 2) OVER w AS b FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), g AS (SELECT series_id, regr_sxx(y, a) + 1 AS aa, covar_pop(a, b) * count(*) AS ab, regr_sxx(y, b) + 1 AS bb, regr_sxy(y, a) AS ay, regr_sxy(y, b) AS by_, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM l WHERE b IS NOT NULL GROUP BY series_id), c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM g), e AS (SELECT series_id, max_by(y, t) AS la, max_by(a, t) AS lb FROM l GROUP BY series_id) SELECT c.series_id, {r('my + p * (la - ma) + q * (lb - mb)', 'estimate')} FROM c JOIN e ON c.series_id = e.series_id", "Ridge regression on two lags with intercept, alpha 1.", OBS_EVENTS)
forecast("var_forecast", f", l AS (SELECT series_id, t, x0, x1, lag(x0) OVER w AS a, lag(x1) OVER w AS b FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), g AS (SELECT series_id, regr_sxx(x0, a) AS aa, covar_pop(a, b) * count(*) AS ab, regr_sxx(x0, b) AS bb, regr_sxy(x0, a) AS ay, regr_sxy(x0, b) AS by_, regr_sxy(x1, a) AS az, regr_sxy(x1, b) AS bz, avg(x0) AS m0, avg(x1) AS m1, avg(a) AS ma, avg(b) AS mb FROM l WHERE a IS NOT NULL GROUP BY series_id), e AS (SELECT series_id, max_by(x0, t) AS la, max_by(x1, t) AS lb FROM obs GROUP BY series_id) SELECT g.series_id, {r('m0 + ((ay * bb - by_ * ab) * (la - ma) + (by_ * aa - ay * ab) * (lb - mb)) / (aa * bb - ab * ab)', 'next0', 2)}, {r('m1 + ((az * bb - bz * ab) * (la - ma) + (bz * aa - az * ab) * (lb - mb)) / (aa * bb - ab * ab)', 'next1', 4)} FROM g JOIN e ON g.series_id = e.series_id", "Vector autoregression of order 1 of two columns.", OBS_DAY)
forecast("har_components", f", v AS (SELECT series_id, t, dx * dx AS rv FROM d WHERE dx IS NOT NULL), h AS (SELECT series_id, t, rv, avg(rv) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS week, avg(rv) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS month FROM v) SELECT series_id, t, {r('sqrt(rv)', 'vol')}, {r('sqrt(week)', 'vol_week')}, {r('sqrt(month)', 'vol_month')} FROM h", "Roots of the realised variance and of its means over 5 and 22 rows, the regressors of a heterogeneous autoregression.", OBS_DIFF, "equation")
forecast("symbolic_regression", f", f AS (SELECT series_id, x0 AS y, t + 1 AS u FROM obs), u AS (SELECT series_id, 'linear' AS form, y, cast(u AS double) AS v FROM f UNION ALL SELECT series_id, 'log' AS form, y, ln(u) AS v FROM f UNION ALL SELECT series_id, 'sqrt' AS form, y, sqrt(u) AS v FROM f), s AS (SELECT series_id, form, count(*) AS n, regr_slope(y, v) AS b, regr_intercept(y, v) AS a, regr_syy(y, v) - regr_slope(y, v) * regr_sxy(y, v) AS ssr FROM u GROUP BY series_id, form), b AS (SELECT *, n * ln(ssr / n + 1e-12) + 2 * ln(n) AS bic FROM s) SELECT series_id, min_by(form, bic) AS form, {r('min(bic)', 'bic', 4)}, {r('min_by(b, bic)', 'coef', 4)} FROM b GROUP BY series_id", "The best of three templates by information criterion.", OBS_EVENTS, "equation")
forecast("seasonal_naive_forecast", f", c AS (SELECT series_id, t, x0 - avg(x0) OVER (PARTITION BY series_id) AS x FROM obs), a AS (SELECT p.series_id, q.t - p.t AS k, sum(p.x * q.x) AS ac FROM c p JOIN c q ON p.series_id = q.series_id AND q.t - p.t BETWEEN 0 AND 30 GROUP BY p.series_id, q.t - p.t), l AS (SELECT series_id, k, ac, lag(ac) OVER w AS before, lead(ac) OVER w AS after FROM a WINDOW w AS (PARTITION BY series_id ORDER BY k)), p AS (SELECT series_id, min(k) AS k FROM l WHERE k >= 2 AND ac > before AND ac > after GROUP BY series_id), m AS (SELECT series_id, max(t) AS last FROM obs GROUP BY series_id) SELECT m.series_id, coalesce(p.k, 1) AS period, {r('o.x0', 'estimate')} FROM m LEFT JOIN p ON m.series_id = p.series_id JOIN obs o ON o.series_id = m.series_id AND o.t = m.last + 1 - coalesce(p.k, 1)", "The value one period before, by the first peak of the autocorrelation.", OBS_EVENTS)
