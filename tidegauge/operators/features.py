"""Column features of a sequence, all from window functions over one partitioning by series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.tables import OBS_EVENTS, obs_events


def by():
    return Window.partitionBy("series_id").orderBy("t")


def shift(k: int):
    """The value k rows before, or the first value."""
    return F.coalesce(F.lag("x0", k).over(by()), F.first("x0").over(by().rowsBetween(Window.unboundedPreceding, 0)))


_L = ", ".join(f"coalesce(lag(x0, {k}) OVER v, first_value(x0) OVER v) AS lag{k}" for k in (1, 2, 3, 5, 10))


@query(f"""WITH {OBS_EVENTS}, l AS (SELECT *, {_L}, avg(x0) OVER (v ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5, avg(x0) OVER (v ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20, stddev_pop(x0) OVER (v ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s10 FROM obs WINDOW v AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t, round(lag1, 6) AS lag1, round(lag2, 6) AS lag2, round(lag3, 6) AS lag3, round(lag5, 6) AS lag5, round(x0 - lag1 + 3e-10, 6) AS step, round(CASE WHEN x0 > 0 AND lag1 > 0 THEN ln(x0 / lag1) ELSE 0 END + 3e-10, 6) AS log_return, round(m5 + 3e-10, 6) AS roll_mean_5, round(m20 + 3e-10, 6) AS roll_mean_20, round(s10 + 3e-10, 6) AS roll_std_10, round(x0 - lag10 + 3e-10, 6) AS momentum_10 FROM l""")
def feature_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, steps, rolling moments and momentum of every row, by one shuffle and one sort."""
    mean = lambda n: F.avg("x0").over(by().rowsBetween(1 - n, 0))
    x, one = F.col("x0"), shift(1)
    up = lambda c: F.round(c + F.lit(3e-10), 6)
    cols = {f"lag{k}": F.round(shift(k), 6) for k in (1, 2, 3, 5)}
    cols |= {"step": up(x - one), "log_return": up(F.when((x > 0) & (one > 0), F.log(x / one)).otherwise(0.0)), "roll_mean_5": up(mean(5)), "roll_mean_20": up(mean(20)), "roll_std_10": up(F.stddev_pop("x0").over(by().rowsBetween(-9, 0))), "momentum_10": up(x - shift(10))}
    return obs_events(spark, sf_dir).select("series_id", "t", *[c.alias(k) for k, c in cols.items()])


@query(f"""WITH {OBS_EVENTS}, w AS (SELECT *, avg(x0) OVER v AS m, stddev_pop(x0) OVER v AS s FROM obs
WINDOW v AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT series_id, t, round(CASE WHEN s > 1e-9 THEN (x0 - m) / s ELSE 0.0 END, 6) AS z FROM w""")
def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each value from its trailing mean over 20 rows, in trailing standard deviations."""
    w = by().rowsBetween(-19, 0)
    m, s = F.avg("x0").over(w), F.stddev_pop("x0").over(w)
    return obs_events(spark, sf_dir).select("series_id", "t", F.round(F.when(s > 1e-9, (F.col("x0") - m) / s).otherwise(0.0), 6).alias("z"))
