"""Layers of evaluation of outcome series: significance, deflation by the number of trials, fading scores, Pareto selection, admission.

The normal law has no function in SQL: its distribution is a rational approximation of the complementary error function
(relative error 1.2e-7), its quantile Acklam's (1.2e-9).
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import dialect, query, run_sql, sql_query
from ..operators.evaluation import _PSR, OUT
from ..operators.neighbours import skyline

EULER = 0.5772156649015329
# Coefficients of the two approximations.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _number(v: float) -> str:
    return f"cast('{v!r}' AS double)"


def _horner(values, x: str) -> str:
    text = _number(values[0])
    for v in values[1:]:
        text = f"({text} * {x} + {_number(v)})"
    return text


def cdf_step(z: str) -> str:
    """SQL of the variable that norm_cdf's polynomial is in; a column of its own, as it is used ten times."""
    return f"(1 / (1 + 0.5 * abs({z}) / {_number(math.sqrt(2))}))"


def norm_cdf(z: str, t: str) -> str:
    """SQL of the standard normal distribution at column z, with t = cdf_step(z)."""
    tail = f"({t} * exp(-{z} * {z} / 2 + {_horner(ERFC[::-1], t)}) / 2)"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_ppf(p: str) -> str:
    """SQL of the standard normal quantile at p, between 0 and 1."""
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    side = lambda x: f"({_horner(PPF_C, x)} / ({_horner(PPF_D, x)} * {x} + 1))"
    middle = f"({_horner(PPF_A, r)} * {q} / ({_horner(PPF_B, r)} * {r} + 1))"
    return f"(CASE WHEN {p} < 0.02425 THEN {side(low)} WHEN {p} > 0.97575 THEN -{side(high)} ELSE {middle} END)"


def expected_max_sharpe(n_trials: int, var_sr: float) -> float:
    """The greatest Sharpe ratio to expect of n_trials without skill, whose ratios have variance var_sr."""
    if n_trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return math.sqrt(max(0.0, var_sr)) * ((1 - EULER) * inv(1 - 1 / n_trials) + EULER * inv(1 - 1 / (n_trials * math.e)))


def max_sharpe_sql(n: str, var: str) -> str:
    p, q = norm_ppf(f"(1 - 1.0 / {n})"), norm_ppf(f"(1 - 1.0 / ({n} * {_number(math.e)}))")
    return f"(CASE WHEN {n} <= 1 THEN 0.0 ELSE sqrt(greatest(0.0, {var})) * ({_number(1 - EULER)} * {p} + {_number(EULER)} * {q}) END)"


sql_query("expected_max_sharpe", f"WITH v AS (SELECT * FROM (VALUES (1), (2), (5), (10), (100), (1000), (100000)) x(n)) SELECT n, round({max_sharpe_sql('n', '0.04')}, 6) AS expected FROM v", "The deflation benchmark by number of trials, for ratios of variance 0.04.", layer="evaluation")
_RATIO = _PSR + ", z AS (SELECT series_id, n, sr, g3, g4, sqrt(greatest(1e-12, 1 - g3 * sr + (g4 - 1) / 4 * sr * sr)) AS s, (1 + 0.5 * sr * sr) / n AS v, (SELECT count(*) FROM k) AS trials FROM k WHERE n >= 3), z0 AS (SELECT *, " + max_sharpe_sql("trials", "v") + " AS bar FROM z), z1 AS (SELECT *, sr * sqrt(n - 1) / s AS z1, (sr - bar) * sqrt(n - 1) / s AS z2 FROM z0), z2 AS (SELECT *, " + cdf_step("z1") + " AS t1, " + cdf_step("z2") + " AS t2 FROM z1)"
sql_query("probabilistic_sharpe_ratio", f"WITH {OUT}{_RATIO} SELECT series_id, round({norm_cdf('z1', 't1')}, 5) AS psr FROM z2", "Probability that the true ratio is above 0.", layer="evaluation")
sql_query("deflated_sharpe_ratio", f"WITH {OUT}{_RATIO} SELECT series_id, trials, round(bar, 6) AS benchmark, round({norm_cdf('z2', 't2')}, 5) AS dsr FROM z2", "The same against the greatest ratio to expect of as many trials as there are series; the ratio's variance is its estimator's.", layer="evaluation")

#: Per series: all figures of an evaluation. passed: enough rows and both probabilities at least 0.95.
REPORT = OUT + _RATIO + f""", y AS (SELECT series_id, sr, n, {norm_cdf('z1', 't1')} AS psr, {norm_cdf('z2', 't2')} AS dsr, CASE WHEN sr > 0 THEN 1 + s * s * power(1.6448536269514722 / sr, 2) END AS trl FROM z2),
cu AS (SELECT series_id, t, o, sum(o) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, max(t) OVER (PARTITION BY series_id) - t AS age FROM u),
pk AS (SELECT *, max(c) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS dd FROM cu),
ag AS (SELECT series_id, avg(o) AS mean, -max(dd) AS neg_drawdown, regr_r2(c, t) AS stability, sum(power(0.95, age) * o) / sum(power(0.95, age)) + sqrt(2 * ln(greatest(2, 1 + sum(power(0.95, age)))) / sum(power(0.95, age))) AS ucb FROM pk GROUP BY series_id),
report AS (SELECT y.series_id, n AS n_obs, sr AS sharpe, psr, dsr, trl AS min_trl, ucb, mean, neg_drawdown, greatest(0.0, coalesce(stability, 0.0)) AS stability, CASE WHEN psr >= 0.95 AND dsr >= 0.95 THEN 1 ELSE 0 END AS passed FROM y JOIN ag ON y.series_id = ag.series_id)"""
_ROUNDED = "series_id, n_obs, round(sharpe, 6) AS sharpe, round(psr, 5) AS psr, round(dsr, 5) AS dsr, round(min_trl, 3) AS min_trl, round(ucb, 6) AS ucb, round(mean, 6) AS mean, round(neg_drawdown, 6) AS neg_drawdown, round(stability, 6) AS stability, passed"
sql_query("evaluate_outcomes", f"WITH {REPORT} SELECT {_ROUNDED} FROM report", "The evaluation report of every series' outcomes.", layer="evaluation")
GOALS = ["mean", "sharpe", "neg_drawdown", "stability"]
_WORSE = " AND ".join(f"round(q.{g}, 6) >= round(p.{g}, 6)" for g in GOALS) + " AND (" + " OR ".join(f"round(q.{g}, 6) > round(p.{g}, 6)" for g in GOALS) + ")"


def select(reports: DataFrame, anchors: DataFrame | None = None, pbo: float | None = None, pbo_limit: float = 0.5) -> DataFrame:
    """(series_id, admitted): the Pareto front of reports by GOALS, and who is admitted: passed, sane on every anchor, and no overfit selection.

    anchors: (series_id, anchored). pbo: the probability of backtest overfitting of the whole selection.
    """
    front = skyline(reports, "series_id", GOALS).select("series_id")
    rows = reports.join(front, "series_id", "left_semi").select("series_id", (F.col("passed") == 1).alias("ok"))
    if anchors is not None:
        rows = rows.join(anchors.select("series_id", "anchored"), "series_id", "left").select("series_id", (F.col("ok") & (F.coalesce("anchored", F.lit(0)) == 1)).alias("ok"))
    fit = pbo is None or math.isnan(pbo) or pbo <= pbo_limit
    return rows.select("series_id", (F.col("ok") & F.lit(fit)).cast("int").alias("admitted"))


@query(
    f"WITH {dialect(REPORT, spark=False)}, an AS (SELECT series_id, CASE WHEN min(m) >= 0 THEN 1 ELSE 0 END AS anchored FROM (SELECT series_id, floor(t / 20) AS e, avg(o) AS m FROM u GROUP BY series_id, floor(t / 20)) q GROUP BY series_id) SELECT p.series_id, CASE WHEN passed = 1 AND anchored = 1 THEN 1 ELSE 0 END AS admitted FROM report p JOIN an ON p.series_id = an.series_id WHERE NOT EXISTS (SELECT 1 FROM report q WHERE {_WORSE})",
    layer="evaluation",
)
def evaluator_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front of all series by mean, ratio, drawdown and steadiness, and who of it is admitted."""
    reports = run_sql(spark, sf_dir, dialect(f"WITH {REPORT} SELECT {_ROUNDED} FROM report", spark=True))
    anchors = run_sql(spark, sf_dir, dialect(f"WITH {OUT}, a AS (SELECT series_id, floor(t / 20) AS episode, avg(o) AS m FROM u GROUP BY series_id, floor(t / 20)) SELECT series_id, CASE WHEN min(m) >= 0 THEN 1 ELSE 0 END AS anchored FROM a GROUP BY series_id", spark=True))
    return select(reports, anchors)


def evaluate(outcomes: DataFrame, n_trials: int | None = None) -> DataFrame:
    """Reports of outcome series (series_id, t, o) of one's own; n_trials: their number, unless more were tried."""
    outcomes.select("series_id", "t", F.col("o").cast("double").alias("o")).createOrReplaceTempView("tidegauge_outcomes")
    sql = REPORT.replace(OUT, "u AS (SELECT * FROM tidegauge_outcomes)", 1)
    if n_trials is not None:
        sql = sql.replace("(SELECT count(*) FROM k) AS trials", f"{int(n_trials)} AS trials")
    return outcomes.sparkSession.sql(dialect(f"WITH {sql} SELECT * FROM report", spark=True))


def walk_forward(obs: DataFrame, candidate, n_splits: int = 5, embargo: float = 0.02, min_train: int = 10) -> DataFrame:
    """(series_id, t, o): outcomes of candidate(history, tests) over purged expanding folds.

    candidate gets two tables (series_id, fold, t, x0): each fold's training rows and its test rows, and gives
    (series_id, fold, t, o). Training rows end an embargo before the tests, so they can't know them.
    """
    n = F.count("*").over(Window.partitionBy("series_id"))
    rows = obs.withColumn("n", n)
    fold = F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold")
    rows = rows.select("*", fold)
    start = F.floor(F.col("fold") * F.col("n") / (n_splits + 1))
    stop = F.floor((F.col("fold") + 1) * F.col("n") / (n_splits + 1))
    train_end = start - F.round(F.col("n") * embargo)
    rows = rows.where(train_end >= min_train)
    history = rows.where(F.col("t") < train_end).select("series_id", "fold", "t", "x0")
    tests = rows.where((F.col("t") >= start) & (F.col("t") < stop)).select("series_id", "fold", "t", "x0")
    return candidate(history, tests).select("series_id", "t", "o")


def directional(history: DataFrame, tests: DataFrame) -> DataFrame:
    """The candidate that bets on the sign of the mean step of its history; its outcome is the bet times the step."""
    step = lambda df: df.withColumn("dx", F.col("x0") - F.lag("x0").over(Window.partitionBy("series_id", "fold").orderBy("t"))).where("dx IS NOT NULL")
    bet = step(history).groupBy("series_id", "fold").agg(F.signum(F.avg("dx")).alias("bet"))
    return step(tests).join(bet, ["series_id", "fold"]).select("series_id", "fold", "t", (F.col("dx") * F.col("bet")).alias("o"))
