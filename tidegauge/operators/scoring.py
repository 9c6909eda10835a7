"""Proper scores and calibration of predictive ensembles.

The ensemble of a row is the value before it plus each of the ten steps before
that, so it depends on the past alone.
"""

from __future__ import annotations

from ..catalog import sql_query
from ..sources.tables import OBS_DIFF
from .forecasts import r

ENS = OBS_DIFF + """, ens AS (SELECT a.series_id, a.t, a.x0 AS y, a.px AS p, a.px + b.dx AS s, row_number() OVER (PARTITION BY a.series_id, a.t ORDER BY a.px + b.dx, b.t) AS k, count(*) OVER (PARTITION BY a.series_id, a.t) AS m
FROM d a JOIN d b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 10 AND a.t - 1 AND b.dx IS NOT NULL WHERE a.t > 10)"""
CRPS = ENS + ", c AS (SELECT series_id, t, max(y) AS y, max(p) AS p, avg(abs(s - y)) - sum((2 * k - m - 1) * s) / (max(m) * max(m)) AS crps, abs(max(y) - max(p)) AS base FROM ens GROUP BY series_id, t)"


def score(name: str, sql: str, doc: str, source: str = CRPS) -> None:
    sql_query(name, f"WITH {source}{sql}", doc, layer="scoring")


score("crps_ensemble", f" SELECT series_id, t, {r('crps', 'crps')} FROM c", "Continuous ranked probability score of each row, by the sorted identity.")
score("crps_skill_score", f" SELECT series_id, {r('1 - avg(crps) / (avg(base) + 1e-12)', 'crps_skill')}, {r('avg(crps)', 'mean_crps')} FROM c GROUP BY series_id", "Skill against persistence.")
score("crps_outcome_series", f" SELECT series_id, t, {r('base - crps', 'outcome')} FROM c", "Gain over persistence of each row.")
score("pinball_loss", f", q AS (SELECT series_id, t, max(y) AS y, @pct(s, 0.1) AS a, @pct(s, 0.5) AS b, @pct(s, 0.9) AS c FROM ens GROUP BY series_id, t) SELECT series_id, {r('avg(greatest(0.1 * (y - a), -0.9 * (y - a)))', 'q10')}, {r('avg(greatest(0.5 * (y - b), -0.5 * (y - b)))', 'q50')}, {r('avg(greatest(0.9 * (y - c), -0.1 * (y - c)))', 'q90')} FROM q GROUP BY series_id", "Quantile losses at three levels.", ENS)
score("crps_from_quantiles", f", q AS (SELECT series_id, t, max(y) AS y, @pct(s, 0.1) AS a, @pct(s, 0.5) AS b, @pct(s, 0.9) AS c FROM ens GROUP BY series_id, t) SELECT series_id, {r('2 * avg(greatest(0.1 * (y - a), -0.9 * (y - a)) + greatest(0.5 * (y - b), -0.5 * (y - b)) + greatest(0.9 * (y - c), -0.1 * (y - c))) / 3', 'crps')} FROM q GROUP BY series_id", "Twice the mean quantile loss.", ENS)
_P = ", p AS (SELECT series_id, t, avg(CASE WHEN s > p THEN 1.0 ELSE 0.0 END) AS p, CASE WHEN max(y) > max(p) THEN 1 ELSE 0 END AS y FROM ens GROUP BY series_id, t)"
score("brier_score", _P + f" SELECT series_id, {r('avg((p - y) * (p - y))', 'brier')} FROM p GROUP BY series_id", "Squared error of the share of the ensemble that rises.", ENS)
score("log_loss", _P + f" SELECT series_id, {r('avg(-ln(CASE WHEN y = 1 THEN greatest(p, 1e-12) ELSE greatest(1 - p, 1e-12) END))', 'log_loss', 5)} FROM p GROUP BY series_id", "Clipped cross entropy of the same.", ENS)
_PIT = ", v AS (SELECT series_id, t, avg(CASE WHEN s <= y THEN 1.0 ELSE 0.0 END) AS pit FROM ens GROUP BY series_id, t)"
score("pit_values_ensemble", _PIT + f" SELECT series_id, t, {r('pit', 'pit')} FROM v", "Share of the ensemble at or below what came.", ENS)
score("pit_calibration_error", _PIT + f", k AS (SELECT series_id, pit, row_number() OVER (PARTITION BY series_id ORDER BY pit, t) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM v) SELECT series_id, {r('max(abs(i / n - pit))', 'ks')}, {r('avg(abs(i / n - pit))', 'mae')}, CASE WHEN max(abs(i / n - pit)) < 1.36 / sqrt(max(n)) THEN 1 ELSE 0 END AS calibrated, {r('max(greatest(abs(i / n - pit), abs((i - 1) / n - pit)))', 'ks_both')} FROM k GROUP BY series_id", "Distance of the shares from even, from the upper steps alone and from both.", ENS)
score("risk_signals", f", q AS (SELECT series_id, max(t) AS t FROM ens GROUP BY series_id), e AS (SELECT ens.series_id, s - p AS g FROM ens JOIN q ON ens.series_id = q.series_id AND ens.t = q.t), v AS (SELECT series_id, @pct(g, 0.05) AS v FROM e GROUP BY series_id) SELECT e.series_id, {r('stddev_pop(g)', 'pred_vol')}, {r('-max(v)', 'var_95')}, {r('-avg(CASE WHEN g <= v THEN g END)', 'es_95')}, {r('avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END)', 'prob_up')}, {r('least(3, 0.01 / (stddev_pop(g) + 1e-12))', 'vol_target')} FROM e JOIN v ON e.series_id = v.series_id GROUP BY e.series_id", "Risk of the last ensemble.", ENS)
score("evaluate_vol_forecast", f", v AS (SELECT series_id, t, stddev_pop(s) AS v, max(y) - max(p) AS move FROM ens GROUP BY series_id, t) SELECT series_id, {r('corr(v, abs(move))', 'corr')}, {r('avg(ln(v * v + 1e-12) + move * move / (v * v + 1e-12))', 'qlike', 4)} FROM v GROUP BY series_id", "Correlation with the size of moves, and quasi-likelihood.", ENS)
score("baseline_band", f", b AS (SELECT series_id, t, px AS point, stddev_pop(dx) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM d) SELECT series_id, t, {r('point', 'point')}, {r('s', 'std')} FROM b WHERE s IS NOT NULL", "Persistence with the deviation of all earlier steps.", OBS_DIFF)
score("belief_to_samples", f", g AS (SELECT series_id, t, avg(s) AS m, stddev_pop(s) AS sd FROM ens GROUP BY series_id, t) SELECT series_id, t, {r('m - 1.2815515655446004 * sd', 's10')}, {r('m', 's50')}, {r('m + 1.2815515655446004 * sd', 's90')} FROM g", "Quantile grid of the normal law with the ensemble's moments.", ENS)
_QUANTILES = ", q AS (SELECT series_id, t, max(y) AS y, @pct(s, 0.1) AS a, @pct(s, 0.5) AS b, @pct(s, 0.9) AS c FROM ens GROUP BY series_id, t)"
score("pit_values_quantile", _QUANTILES + f" SELECT series_id, t, {r('CASE WHEN y < a THEN 0 WHEN y > c THEN 1 WHEN y <= b THEN 0.1 + 0.4 * coalesce((y - a) / nullif(b - a, 0), 1) ELSE 0.5 + 0.4 * coalesce((y - b) / nullif(c - b, 0), 1) END', 'pit')} FROM q", "The distribution that three quantiles draw, read off at what came; 0 below the lowest and 1 above the highest.", ENS)
_CARD = CRPS + ", v AS (SELECT series_id, t, avg(CASE WHEN s <= y THEN 1.0 ELSE 0.0 END) AS pit FROM ens GROUP BY series_id, t), k AS (SELECT series_id, pit, row_number() OVER (PARTITION BY series_id ORDER BY pit, t) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM v), ks AS (SELECT series_id, max(abs(i / n - pit)) AS ks, max(n) AS n FROM k GROUP BY series_id), s AS (SELECT series_id, avg(crps) AS crps, avg(base) AS base, avg(base - crps) AS gain FROM c GROUP BY series_id)"
score("score_distribution", f" SELECT s.series_id, ks.n, {r('crps', 'mean_crps')}, {r('base', 'baseline_crps')}, {r('1 - crps / (base + 1e-12)', 'crps_skill')}, {r('gain', 'mean_outcome')}, {r('ks', 'calib_ks')}, CASE WHEN ks < 1.36 / sqrt(n) THEN 1 ELSE 0 END AS calibrated FROM s JOIN ks ON s.series_id = ks.series_id", "The whole scorecard of an ensemble: score, skill, gain and calibration.", _CARD)
