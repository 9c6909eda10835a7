"""Recursions along a sequence, as folds over the ordered array of a series: exact, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.tables import OBS_EVENTS, obs_events

_V = f"WITH RECURSIVE {OBS_EVENTS}"


def ordered(obs: DataFrame, column: str = "x0") -> DataFrame:
    """(series_id, v): the values of each series in order."""
    rows = obs.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", column))).alias("v"))
    return rows.select("series_id", F.transform("v", lambda e: e[column]).alias("v"))


def state(**fields: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in fields.items()])


def fold(v: Column, start: Column, step) -> Column:
    return F.aggregate(F.slice(v, 2, F.size(v)), start, step)


def _recursive(init: str, step: str, names: str, final: str) -> str:
    """SQL of a fold: one row of state a series, joined with the next row again and again."""
    return f"{_V}, f({names}, series_id, t) AS (SELECT {init}, series_id, t FROM obs WHERE t = 0 UNION ALL SELECT {step}, o.series_id, o.t FROM f JOIN obs o ON o.series_id = f.series_id AND o.t = f.t + 1) {final}"


_LAST = "WHERE t = (SELECT max(t) FROM obs z WHERE z.series_id = f.series_id)"


@query(_recursive("x0", "0.3 * o.x0 + 0.7 * f.s", "s", "SELECT series_id, t, round(s, 6) AS y FROM f"), layer="signal", transformer=True)
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted mean, alpha 0.3, at every row. What came 120 rows ago weighs less than a double can tell, so a row folds its last 120."""
    held = F.collect_list("x0").over(Window.partitionBy("series_id").orderBy("t").rowsBetween(-120, 0))
    rows = obs_events(spark, sf_dir).withColumn("v", held)
    return rows.select("series_id", "t", F.round(fold(F.col("v"), F.col("v")[0], lambda a, x: 0.3 * x + 0.7 * a), 6).alias("y"))


@query(_recursive("x0, cast(0 AS double)", "0.5 * o.x0 + 0.5 * (f.l + f.b), 0.3 * (0.5 * o.x0 + 0.5 * (f.l + f.b) - f.l) + 0.7 * f.b", "l, b", f"SELECT series_id, round(l + b, 6) AS estimate, round(l, 6) AS level, round(b, 6) AS trend FROM f {_LAST}"), layer="sequence")
def holt_linear_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and trend smoothing, alpha 0.5 and beta 0.3, from a flat start."""
    s = ordered(obs_events(spark, sf_dir))

    def step(a, x):
        level = 0.5 * x + 0.5 * (a["l"] + a["b"])
        return state(l=level, b=0.3 * (level - a["l"]) + 0.7 * a["b"])

    s = s.withColumn("s", fold(F.col("v"), state(l=F.col("v")[0], b=F.lit(0.0)), step))
    return s.select("series_id", F.round(F.col("s.l") + F.col("s.b"), 6).alias("estimate"), F.round("s.l", 6).alias("level"), F.round("s.b", 6).alias("trend"))


@query(_recursive("x0", "0.3 * o.x0 + 0.7 * f.s", "s", f", g AS (SELECT series_id, regr_intercept(x0, t) + regr_slope(x0, t) * count(*) AS l FROM obs GROUP BY series_id) SELECT f.series_id, round(0.5 * s + 0.5 * l, 6) AS estimate FROM f JOIN g ON f.series_id = g.series_id {_LAST}"), layer="sequence")
def theta_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the line's extrapolation, half the smoothed level."""
    obs = obs_events(spark, sf_dir)
    s = ordered(obs).select("series_id", fold(F.col("v"), F.col("v")[0], lambda a, x: 0.3 * x + 0.7 * a).alias("s"))
    line = obs.groupBy("series_id").agg((F.regr_intercept("x0", "t") + F.regr_slope("x0", "t") * F.count("*")).alias("l"))
    return s.join(line, "series_id").select("series_id", F.round(0.5 * F.col("s") + 0.5 * F.col("l"), 6).alias("estimate"))


@query(_recursive("cast(0 AS double), x0", "CASE WHEN f.t = 0 THEN power(o.x0 - f.p, 2) ELSE 0.94 * f.v + 0.06 * power(o.x0 - f.p, 2) END, o.x0", "v, p", f"SELECT series_id, round(v, 4) AS variance, round(sqrt(v), 5) AS volatility FROM f {_LAST}"), layer="sequence")
def ewma_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the steps with weights that fade by 0.94."""
    s = ordered(obs_events(spark, sf_dir))

    def step(a, x):
        d = (x - a["p"]) * (x - a["p"])
        return state(v=F.when(a["i"] == 0, d).otherwise(0.94 * a["v"] + 0.06 * d), p=x, i=a["i"] + 1)

    s = s.withColumn("s", fold(F.col("v"), state(v=F.lit(0.0), p=F.col("v")[0], i=F.lit(0.0)), step))
    return s.select("series_id", F.round("s.v", 4).alias("variance"), F.round(F.sqrt("s.v"), 5).alias("volatility"))


def kalman(v: Column, q: float = 1e-3, noise: float = 0.1) -> Column:
    """Constant-velocity filter: position, speed and covariance after the last row; the first row is updated too."""

    def step(a, x):
        p1, p2 = a["a"] + a["b"], a["b"]
        s11, s12, s22 = a["p"] + 2 * a["c"] + a["d"] + q, a["c"] + a["d"], a["d"] + q
        k1, k2 = s11 / (s11 + noise), s12 / (s11 + noise)
        return state(a=p1 + k1 * (x - p1), b=p2 + k2 * (x - p1), p=(1 - k1) * s11, c=(1 - k1) * s12, d=s22 - k2 * s12)

    return F.aggregate(v, state(a=v[0], b=F.lit(0.0), p=F.lit(1.0), c=F.lit(0.0), d=F.lit(1.0)), step)


_K = "(f.p + 2 * f.c + f.d + 1e-3)"
_KS = f"f.a + f.b + {_K} / ({_K} + 0.1) * (o.x0 - f.a - f.b), f.b + (f.c + f.d) / ({_K} + 0.1) * (o.x0 - f.a - f.b), (1 - {_K} / ({_K} + 0.1)) * {_K}, (1 - {_K} / ({_K} + 0.1)) * (f.c + f.d), f.d + 1e-3 - (f.c + f.d) * (f.c + f.d) / ({_K} + 0.1)"


@query(f"{_V}, f(a, b, p, c, d, series_id, t) AS (SELECT x0, cast(0 AS double), cast(1 AS double), cast(0 AS double), cast(1 AS double), series_id, cast(-1 AS bigint) FROM obs WHERE t = 0 UNION ALL SELECT {_KS}, o.series_id, o.t FROM f JOIN obs o ON o.series_id = f.series_id AND o.t = f.t + 1) SELECT series_id, round(a + b, 5) AS estimate, round(p + 2 * c + d + 1e-3, 6) AS variance FROM f {_LAST}", layer="probability")
def kalman_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next value and its variance under constant velocity."""
    s = ordered(obs_events(spark, sf_dir)).withColumn("s", kalman(F.col("v")))
    return s.select("series_id", F.round(F.col("s.a") + F.col("s.b"), 5).alias("estimate"), F.round(F.col("s.p") + 2 * F.col("s.c") + F.col("s.d") + 1e-3, 6).alias("variance"))


@query(_recursive("1500 + 0 * x0", "f.r + 24 * ((CASE WHEN o.x0 > 100 THEN 1.0 ELSE 0.0 END) - 1 / (1 + power(10, (1500 - f.r) / 400)))", "r", f"SELECT series_id, round(r, 4) AS rating FROM f {_LAST}"), layer="service")
def elo_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating after games against an even opponent, step 24; a value over 100 is a win."""
    s = ordered(obs_events(spark, sf_dir))
    step = lambda a, x: a + 24 * (F.when(x > 100, 1.0).otherwise(0.0) - 1 / (1 + F.pow(F.lit(10.0), (1500 - a) / 400)))
    return s.select("series_id", F.round(fold(F.col("v"), F.lit(1500.0), step), 4).alias("rating"))


@query(_recursive("cast(0 AS double), cast(0 AS double), cast(0 AS double), x0", "CASE WHEN f.p > 150 THEN f.q0 + 0 ELSE CASE WHEN f.p < 50 THEN f.q0 + 0.5 * (sign(o.x0 - f.p) - f.q0) ELSE f.q0 END END, CASE WHEN f.p BETWEEN 50 AND 150 THEN f.q1 + 0.5 * (sign(o.x0 - f.p) - f.q1) ELSE f.q1 END, CASE WHEN f.p > 150 THEN f.q2 + 0.5 * (sign(o.x0 - f.p) - f.q2) ELSE f.q2 END, o.x0", "q0, q1, q2, p", f"SELECT series_id, round(q0 + 0.0, 6) AS low, round(q1 + 0.0, 6) AS middle, round(q2 + 0.0, 6) AS high, CASE WHEN (CASE WHEN p < 50 THEN q0 WHEN p <= 150 THEN q1 ELSE q2 END) > 0 THEN 'buy' WHEN (CASE WHEN p < 50 THEN q0 WHEN p <= 150 THEN q1 ELSE q2 END) < 0 THEN 'sell' ELSE 'hold' END AS action FROM f {_LAST}"), layer="rl")
def tabular_q_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of holding in three states (by level), learned along the sequence with step 0.5."""
    s = ordered(obs_events(spark, sf_dir))

    def step(a, x):
        reward = F.signum(x - a["p"])
        move = lambda q, on: F.when(on, a[q] + 0.5 * (reward - a[q])).otherwise(a[q])
        return state(q0=move("q0", a["p"] < 50), q1=move("q1", a["p"].between(50, 150)), q2=move("q2", a["p"] > 150), p=x)

    s = s.withColumn("s", fold(F.col("v"), state(q0=F.lit(0.0), q1=F.lit(0.0), q2=F.lit(0.0), p=F.col("v")[0]), step))
    now = F.when(F.col("s.p") < 50, F.col("s.q0")).when(F.col("s.p") <= 150, F.col("s.q1")).otherwise(F.col("s.q2"))
    cols = [F.round(F.col(f"s.{q}") + 0.0, 6).alias(name) for q, name in (("q0", "low"), ("q1", "middle"), ("q2", "high"))]
    return s.select("series_id", *cols, F.when(now > 0, "buy").when(now < 0, "sell").otherwise("hold").alias("action"))
