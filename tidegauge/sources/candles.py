"""Open, high, low, close and volume by day from single trades, their checks and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import dialect, query, run_sql, sql_query
from .tables import OBS_EVENTS, obs_events

CANDLES = """trades AS (SELECT l_shipdate AS day, l_orderkey, l_linenumber, cast(l_extendedprice AS double) AS p, cast(l_quantity AS double) AS q FROM lineitem),
candles AS (SELECT day, min_by(p, l_orderkey * 10 + l_linenumber) AS open, max(p) AS high, min(p) AS low, max_by(p, l_orderkey * 10 + l_linenumber) AS close, sum(q) AS volume FROM trades GROUP BY day)"""

sql_query("candles_day", f"WITH {CANDLES} SELECT day, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, round(volume, 2) AS volume FROM candles", "Candles by day, trades in order of their keys.", layer="adapter")
sql_query("candle_checks", f"WITH {CANDLES} SELECT count(*) AS n, cast(count_if(open <= 0 OR close <= 0) AS bigint) AS bad_price, cast(count_if(volume < 0) AS bigint) AS bad_volume, cast(count_if(high < greatest(open, close) OR low > least(open, close)) AS bigint) AS bad_range FROM candles", "Candles that break the rules of a candle.", layer="adapter")
ORDER, LEAST = 0.4, 1e-4


def weights(d: float = ORDER, least: float = LEAST, most: int = 100_000) -> list[float]:
    """Weights of fractional differencing of order d, newest first, until one is below least in size."""
    if d < 0 or least <= 0:
        raise ValueError("order and threshold are positive")
    w = [1.0]
    while len(w) < most:
        k = len(w)
        following = -w[-1] * (d - k + 1) / k
        if abs(following) < least:
            break
        w.append(following)
    return w


def frac_differenced(rows: DataFrame, column: str, by: list[str], order: str, d: float = ORDER, least: float = LEAST) -> Column:
    """The weighted sum over as many rows as there are weights; null until the window is full."""
    w = weights(d, least)
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(-(len(w) - 1), 0) if by else Window.orderBy(order).rowsBetween(-(len(w) - 1), 0)
    held = F.collect_list(F.col(column).cast("double")).over(window)  # oldest first
    total = F.aggregate(F.zip_with(held, F.array(*[F.lit(v) for v in w[::-1]]), lambda x, v: x * v), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(held) == len(w), total)


def _sql_weights(least: float) -> str:
    return f"w(k, w) AS (SELECT 0, cast(1 AS double) UNION ALL SELECT k + 1, -w * (0.4 - k) / (k + 1) FROM w WHERE abs(w * (0.4 - k) / (k + 1)) >= {least})"


@query(f"WITH RECURSIVE {_sql_weights(LEAST)} SELECT k, round(w, 9) AS w FROM w", layer="adapter")
def frac_diff_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of fractional differencing of order 0.4, down to 1e-4."""
    return spark.createDataFrame(list(enumerate(weights())), "k int, w double").withColumn("w", F.round("w", 9))


#: Series of events are shorter than the window of LEAST; theirs ends at this weight.
LEAST_OF_EVENTS = 0.01


@query(f"WITH RECURSIVE {_sql_weights(LEAST_OF_EVENTS)}, {OBS_EVENTS} SELECT o.series_id, o.t, round(sum(w.w * p.x0) + 0.0, 6) AS y FROM obs o CROSS JOIN w JOIN obs p ON p.series_id = o.series_id AND p.t = o.t - w.k WHERE o.t >= (SELECT max(k) FROM w) GROUP BY o.series_id, o.t", layer="adapter")
def frac_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional differencing of order 0.4 with all weights of 0.01 or more; rows before the window is full are left out."""
    obs = obs_events(spark, sf_dir)
    return obs.select("series_id", "t", F.round(frac_differenced(obs, "x0", ["series_id"], "t", least=LEAST_OF_EVENTS) + 0.0, 6).alias("y")).where("y IS NOT NULL")


@query(
    f"WITH RECURSIVE {_sql_weights(LEAST)}, {dialect(CANDLES, spark=False)}, n AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM candles), fd AS (SELECT o.i, sum(w.w * ln(p.close)) AS f FROM n o CROSS JOIN w JOIN n p ON p.i = o.i - w.k GROUP BY o.i HAVING count(*) = (SELECT count(*) FROM w)), "
    "f AS (SELECT day, fd.f, ln(close / lag(close) OVER (ORDER BY day)) AS log_return, (high - low) / close AS hl_range, ln(1 + volume) AS log_volume, ln(1 + volume) - lag(ln(1 + volume)) OVER (ORDER BY day) AS log_volume_change, close FROM n LEFT JOIN fd ON n.i = fd.i) SELECT day, round(f, 5) AS fracdiff_log_close, round(log_return, 6) AS log_return, round(hl_range, 6) AS hl_range, round(log_volume, 6) AS log_volume, round(log_volume_change, 6) AS log_volume_change, round(close, 2) AS close FROM f WHERE log_return IS NOT NULL",
    layer="adapter",
)
def candle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six feature columns of candles without the first day; the calendar bounds the rows."""
    c = run_sql(spark, sf_dir, dialect(f"WITH {CANDLES} SELECT * FROM candles", spark=True)).withColumn("lc", F.log("close")).withColumn("log_volume", F.log1p("volume"))
    before = Window.orderBy("day")
    c = c.withColumns({"fracdiff_log_close": frac_differenced(c, "lc", [], "day"), "log_return": F.col("lc") - F.lag("lc").over(before), "log_volume_change": F.col("log_volume") - F.lag("log_volume").over(before)})
    c = c.withColumn("hl_range", (F.col("high") - F.col("low")) / F.col("close")).where("log_return IS NOT NULL")
    return c.select("day", F.round("fracdiff_log_close", 5).alias("fracdiff_log_close"), *[F.round(x, 6).alias(x) for x in ("log_return", "hl_range", "log_volume", "log_volume_change")], F.round("close", 2).alias("close"))


sql_query("crypto_sweep", f"WITH {CANDLES}, m AS (SELECT date_trunc('month', day) AS month, avg(close) AS c, stddev_samp(close) AS s, count(*) AS n FROM candles GROUP BY date_trunc('month', day)) SELECT count(*) AS months, cast(count_if(s > 0) AS bigint) AS moving, round(median(s / c), 6) AS median_ratio FROM m", "Medians and counts over months.", layer="adapter")
