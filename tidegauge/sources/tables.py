"""The given tables, and the keyed sequences defined on them: obs(series_id, t, x0 [, x1 ...]), t from 0 without gaps.

The SQL forms are common table expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str | Mapping[str, DataFrame], name: str) -> DataFrame:
    """A table of a folder, or of a mapping of names to DataFrames: so every query runs over rows of one's own."""
    return sf_dir[name] if isinstance(sf_dir, Mapping) else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_events(obs: DataFrame) -> DataFrame:
    """obs (series_id, t, x0) as the events table that sequences are read from."""
    return obs.select(F.col("t").cast("long").alias("event_id"), F.timestamp_seconds("t").alias("ts"), F.col("series_id").cast("long").alias("user_id"), F.lit("value").alias("event_type"), F.col("x0").cast("double").alias("value"))


def as_tables(obs: DataFrame) -> dict[str, DataFrame]:
    """The tables that sequences are read from, out of obs (series_id, t, x0[, x1]).

    Operators on one daily series see the sum of all series by t; those on a cross-section see the first five series as
    its assets.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("t").cast("int"))
    second = F.col("x1") if "x1" in obs.columns else F.abs("x0")
    trades = obs.select(day.alias("l_shipdate"), F.col("series_id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("x0").alias("l_extendedprice"), second.alias("l_quantity"))
    first = obs.select("series_id").distinct().orderBy("series_id").limit(5)
    rank = first.select("series_id", F.row_number().over(Window.orderBy("series_id")).alias("k"))  # five rows
    orders = obs.join(F.broadcast(rank), "series_id").select(day.alias("o_orderdate"), F.concat(F.col("k").cast("string"), F.lit("-ASSET")).alias("o_orderpriority"), F.col("x0").alias("o_totalprice"))
    return {"events": as_events(obs), "lineitem": trades, "orders": orders}


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user: the values of the user's events in time order."""
    w = Window.partitionBy("series_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), "ts", "event_id", F.col("value").alias("x0")).withColumn("t", F.row_number().over(w) - 1).select("series_id", "t", "x0")


def obs_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of days: revenue and quantity shipped. As many rows as the calendar has days, at any scale."""
    days = table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.sum("l_extendedprice").cast("double").alias("x0"), F.sum("l_quantity").cast("double").alias("x1"))
    return days.select(F.lit(0).cast("long").alias("series_id"), (F.row_number().over(Window.orderBy("l_shipdate")) - 1).alias("t"), "x0", "x1")


OBS_EVENTS = "obs AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x0 FROM events)"
OBS_DAY = "obs AS (SELECT cast(0 AS bigint) AS series_id, row_number() OVER (ORDER BY l_shipdate) - 1 AS t, x0, x1 FROM (SELECT l_shipdate, cast(sum(l_extendedprice) AS double) AS x0, cast(sum(l_quantity) AS double) AS x1 FROM lineitem GROUP BY l_shipdate) d)"
#: The first of these with the previous value, the difference and the series' length.
OBS_DIFF = OBS_EVENTS + ", d AS (SELECT *, x0 - lag(x0) OVER (PARTITION BY series_id ORDER BY t) AS dx, lag(x0) OVER (PARTITION BY series_id ORDER BY t) AS px, count(*) OVER (PARTITION BY series_id) AS n FROM obs)"
#: Cross-section of 5 assets: daily order value by priority.
PANEL = "panel AS (SELECT row_number() OVER (ORDER BY o_orderdate) - 1 AS t, a1, a2, a3, a4, a5 FROM (SELECT o_orderdate, " + ", ".join(f"cast(sum(CASE WHEN o_orderpriority LIKE '{i}%' THEN o_totalprice ELSE 0 END) AS double) AS a{i}" for i in range(1, 6)) + " FROM orders GROUP BY o_orderdate) q)"
