"""Walk-forward evaluation: outcomes of a direction rule, their quality, selection, search and leaderboards.

An outcome is the next step times the sign of the last one, over its scale: a
rule that uses the past alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, sql_query
from ..sources.tables import OBS_DIFF, PANEL
from .forecasts import r

OUT = OBS_DIFF + ", o AS (SELECT series_id, t, dx * sign(lag(dx) OVER (PARTITION BY series_id ORDER BY t)) / 100 AS o, n FROM d), u AS (SELECT * FROM o WHERE o IS NOT NULL)"


def evaluate(name: str, sql: str, doc: str, source: str = OUT) -> None:
    sql_query(name, f"WITH {source}{sql}", doc, layer="evaluation")


evaluate("sharpe", f" SELECT series_id, {r('avg(o) / (stddev_samp(o) + 1e-12)', 'sharpe')} FROM u GROUP BY series_id", "Mean over deviation of the outcomes.")
evaluate("max_drawdown", f", c AS (SELECT series_id, t, sum(o) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM u), p AS (SELECT series_id, max(c) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS dd FROM c) SELECT series_id, {r('max(dd)', 'max_drawdown')} FROM p GROUP BY series_id", "Greatest fall of the running sum from its peak.")
evaluate("stability", f", c AS (SELECT series_id, t, sum(o) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM u) SELECT series_id, {r('regr_r2(c, t)', 'stability')} FROM c GROUP BY series_id", "How straight the running sum is.")
_PSR = ", m AS (SELECT series_id, avg(o) AS m, stddev_samp(o) + 1e-12 AS s, count(*) AS n FROM u GROUP BY series_id), k AS (SELECT u.series_id, max(m.m / m.s) AS sr, max(m.n) AS n, avg(power((o - m.m) / m.s, 3)) AS g3, avg(power((o - m.m) / m.s, 4)) AS g4 FROM u JOIN m ON u.series_id = m.series_id GROUP BY u.series_id)"
evaluate("probabilistic_sharpe_z", _PSR + f" SELECT series_id, {r('sr * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - g3 * sr + (g4 - 1) / 4 * sr * sr))', 'z')} FROM k", "The statistic whose normal probability is the probabilistic Sharpe ratio; moments over n, deviation over n - 1.")
evaluate("min_track_record_length", _PSR + f" SELECT series_id, {r('1 + (1 - g3 * sr + (g4 - 1) / 4 * sr * sr) * power(1.6448536269514722 / sr, 2)', 'min_trl', 3)} FROM k WHERE sr > 0", "Observations needed to trust the ratio at 0.95; none for ratios of 0 or less.")
evaluate("discounted_ucb_score", f", a AS (SELECT series_id, o, max(t) OVER (PARTITION BY series_id) - t AS age FROM u) SELECT series_id, {r('sum(power(0.95, age) * o) / sum(power(0.95, age)) + 2 / sqrt(sum(power(0.95, age)))', 'score')} FROM a GROUP BY series_id", "Fading mean with its bonus.")
evaluate("sliding_window_ucb_score", f", a AS (SELECT series_id, o, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS k FROM u) SELECT series_id, {r('avg(o) + 2 / sqrt(count(*))', 'score')} FROM a WHERE k <= 50 GROUP BY series_id", "Mean of the last 50 with its bonus.")
evaluate("anchor_check", f", a AS (SELECT series_id, floor(t / 20) AS episode, avg(o) AS m FROM u GROUP BY series_id, floor(t / 20)) SELECT series_id, count(*) AS episodes, CASE WHEN min(m) >= 0 THEN 1 ELSE 0 END AS anchored FROM a GROUP BY series_id", "Whether each episode's mean keeps the floor.")
evaluate("purged_walk_forward_splits", f", b AS (SELECT series_id, t, least(5, floor(t * 6 / n)) AS block, n FROM d), f AS (SELECT series_id, block, min(t) AS a, max(t) AS z, max(n) AS n FROM b GROUP BY series_id, block) SELECT series_id, cast(block AS bigint) AS fold, 0 AS train_start, cast(a - ceil(0.02 * n) AS bigint) AS train_stop, a AS test_start, z + 1 AS test_stop FROM f WHERE block >= 1 AND a - ceil(0.02 * n) >= 10", "Expanding training ranges, an embargo, and test blocks.", OBS_DIFF)
evaluate("walk_forward_outcomes", ", b AS (SELECT series_id, t, o, least(5, floor(t * 6 / n)) AS fold FROM u)" + f" SELECT series_id, cast(fold AS bigint) AS fold, count(*) AS n, {r('avg(o)', 'mean')}, {r('stddev_samp(o)', 'std')} FROM b WHERE fold >= 1 GROUP BY series_id, fold", "Outcomes by test block.")
evaluate("node_oof", f", e AS (SELECT series_id, t, x0, avg(x0) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM obs) SELECT series_id, t, {r('f', 'forecast')}, {r('x0 - f', 'error')} FROM e WHERE t >= 20", "Out-of-sample forecasts of the mean node from all earlier rows.", OBS_DIFF)
_STACK = ", e AS (SELECT series_id, t, x0, px, avg(x0) OVER w AS f1, px AS f2, px + avg(dx) OVER w AS f3 FROM d WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), l AS (SELECT series_id, t, x0, f1, f2, f3, avg(abs(x0 - f1)) OVER w AS m1, avg(abs(x0 - f2)) OVER w AS m2, avg(abs(x0 - f3)) OVER w AS m3 FROM e WHERE f3 IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), x AS (SELECT *, 1 / (m1 + 1e-6) AS w1, 1 / (m2 + 1e-6) AS w2, 1 / (m3 + 1e-6) AS w3 FROM l WHERE m3 IS NOT NULL AND t >= 20)"
evaluate("stacked_mixture", _STACK + f" SELECT series_id, t, {r('(w1 * f1 + w2 * f2 + w3 * f3) / (w1 + w2 + w3)', 'point')}, {r('w1 / (w1 + w2 + w3)', 'weight_mean')} FROM x", "Mixture of three nodes weighed by their past errors alone.", OBS_DIFF)
evaluate("stacked_score", _STACK + f" SELECT series_id, {r('avg(abs(x0 - (w1 * f1 + w2 * f2 + w3 * f3) / (w1 + w2 + w3)))', 'mae')}, {r('avg(abs(x0 - f2))', 'mae_persistence')}, {r('1 - avg(abs(x0 - (w1 * f1 + w2 * f2 + w3 * f3) / (w1 + w2 + w3))) / avg(abs(x0 - f2))', 'skill')} FROM x GROUP BY series_id", "Mixture against persistence.", OBS_DIFF)
evaluate("stacked_gated", _STACK.replace(", x AS", ", g AS (SELECT series_id, t, stddev_pop(dx) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS v, stddev_pop(dx) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS vv FROM d), x AS") + f" SELECT x.series_id, x.t, CASE WHEN v > vv THEN 'rough' ELSE 'calm' END AS regime, {r('CASE WHEN v > vv THEN f1 ELSE (w2 * f2 + w3 * f3) / (w2 + w3) END', 'point')} FROM x JOIN g ON x.series_id = g.series_id AND x.t = g.t", "Nodes by the volatility regime of the rows before the one forecast.", OBS_DIFF)
evaluate("hyperband_rungs", ", g AS (SELECT series_id, avg(CASE WHEN t < 20 THEN o END) AS s1, avg(CASE WHEN t < 40 THEN o END) AS s2, avg(o) AS s3 FROM u GROUP BY series_id), a AS (SELECT *, row_number() OVER (ORDER BY s1 DESC, series_id) AS k1, count(*) OVER () AS n FROM g), b AS (SELECT *, row_number() OVER (ORDER BY s2 DESC, series_id) AS k2 FROM a WHERE k1 <= ceil(n / 3.0)) SELECT series_id, k1 AS rank1, k2 AS rank2, " + r("s3", "score") + " FROM b WHERE k2 <= ceil(n / 9.0)", "Successive halving of candidates: a third go on at each rung, by scores over more rows.")
evaluate("leaderboard_top", f", s AS (SELECT series_id, avg(o) / (stddev_samp(o) + 1e-12) AS s, series_id % 20 AS spec FROM u GROUP BY series_id), b AS (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY s DESC, series_id) AS k FROM s) SELECT series_id, spec, {r('s', 'skill')} FROM b WHERE k = 1 ORDER BY s DESC, series_id LIMIT 10", "The ten best trials, the best of each specification.")
evaluate("leaderboard_summary", f", s AS (SELECT series_id, avg(o) / (stddev_samp(o) + 1e-12) AS s, series_id % 20 AS spec FROM u GROUP BY series_id) SELECT count(*) AS n, count(DISTINCT spec) AS specs, cast(count_if(s > 0) AS bigint) AS positive, {r('max(s)', 'best')}, max_by(series_id, s) AS best_id FROM s", "Counts and the best of all trials.")
evaluate("edge_score", f", s AS (SELECT series_id, avg(o) AS s FROM u GROUP BY series_id), e AS (SELECT series_id % 5 AS a, (series_id + 1) % 5 AS b, s FROM s UNION ALL SELECT (series_id + 1) % 5 AS a, (series_id + 3) % 5 AS b, s FROM s) SELECT a, b, count(*) AS pathways, {r('avg(s)', 'mean_score')}, {r('max(s)', 'max_score')} FROM e GROUP BY a, b", "Mean and greatest score of the pathways that hold an edge.")
evaluate("capstone_holdout", f", s AS (SELECT series_id, avg(CASE WHEN t < 0.7 * n THEN o END) AS history, avg(CASE WHEN t >= 0.7 * n THEN o END) AS holdout, stddev_samp(CASE WHEN t >= 0.7 * n THEN o END) AS sd, count_if(t >= 0.7 * n) AS k FROM u GROUP BY series_id) SELECT series_id, {r('history', 'history')}, {r('holdout', 'holdout')}, CASE WHEN holdout > 0 AND holdout * sqrt(k) / (sd + 1e-12) > 1.645 THEN 'PASS' WHEN holdout > 0 THEN 'WEAK' ELSE 'FAIL' END AS verdict FROM s", "Chosen on history, judged on what came after.")
_BLOCKS = PANEL + ", arms AS (" + " UNION ALL ".join(f"SELECT {i} AS s, t, a{i} AS x FROM panel" for i in range(1, 6)) + "), b AS (SELECT s, least(7, floor(t * 8 / (SELECT count(*) FROM panel))) AS blk, avg(x) AS m FROM arms GROUP BY s, least(7, floor(t * 8 / (SELECT count(*) FROM panel))))"


@query(
    f"WITH {_BLOCKS}, c AS (SELECT unnest(generate_series(0, 255)) AS c), h AS (SELECT c FROM c WHERE bit_count(c::INTEGER) = 4), "
    "p AS (SELECT h.c, b.s, avg(CASE WHEN (h.c >> blk::INTEGER) & 1 = 1 THEN m END) AS i, avg(CASE WHEN (h.c >> blk::INTEGER) & 1 = 0 THEN m END) AS o FROM h CROSS JOIN b GROUP BY h.c, b.s), "
    "k AS (SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY i DESC, s) AS ri, row_number() OVER (PARTITION BY c ORDER BY o, s) AS ro FROM p) SELECT count(*) AS splits, round(avg(CASE WHEN ro / 6.0 <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo FROM k WHERE ri = 1",
    layer="evaluation",
)
def cscv_pbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of backtest overfitting: over all 70 halves of 8 blocks, how often the in-sample best is below the middle outside."""
    from pyspark.sql import Window

    from ..catalog import run_sql

    b = run_sql(spark, sf_dir, f"WITH {_BLOCKS} SELECT s, cast(blk AS int) AS blk, m FROM b")
    halves = spark.range(256).select(F.col("id").alias("c")).where(F.bit_count("c") == 4)
    inside = F.shiftright(F.col("c"), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("blk"))) != 0
    p = halves.join(F.broadcast(b)).groupBy("c", "s").agg(F.avg(F.when(inside, F.col("m"))).alias("i"), F.avg(F.when(~inside, F.col("m"))).alias("o"))  # 8 blocks of 5 arms
    k = p.select("c", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("i"), "s")).alias("ri"), F.row_number().over(Window.partitionBy("c").orderBy("o", "s")).alias("ro"))
    return k.where("ri = 1").agg(F.count("*").alias("splits"), F.round(F.avg(F.when(F.col("ro") / 6.0 <= 0.5, 1.0).otherwise(0.0)), 6).alias("pbo"))
