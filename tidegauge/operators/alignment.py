"""As-of alignment of irregular sources on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.tables import table

_GRID = """src AS (SELECT ts, event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase')),
lim AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM src GROUP BY event_type) z),
grid AS (SELECT unnest(generate_series(date_trunc('hour', lo) + INTERVAL 1 HOUR, hi, INTERVAL 1 HOUR)) AS ts FROM lim)"""


def grid_of(sources: DataFrame) -> DataFrame:
    """Hours from the latest first row to the earliest last row of the sources."""
    lim = sources.groupBy("event_type").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return lim.select(F.explode(F.sequence(F.date_trunc("hour", "lo") + F.expr("INTERVAL 1 HOUR"), "hi", F.expr("INTERVAL 1 HOUR"))).alias("ts"))


def as_of(grid: DataFrame, source: DataFrame, value: str, bucket: str = "day") -> DataFrame:
    """(ts, value): the last value of source at or before each grid row.

    Source and grid are dealt by time bucket, not gathered in one task: within a bucket the last value carries on, and
    each bucket's last value, of which there are few, carries over to the next ones.
    """
    rows = source.select("ts", F.col("event_id").alias("id"), F.col(value).alias("v"), F.lit(0).alias("g")).unionByName(grid.select("ts", F.lit(None).cast("long").alias("id"), F.lit(None).cast(source.schema[value].dataType).alias("v"), F.lit(1).alias("g")))
    rows = rows.withColumn("b", F.date_trunc(bucket, "ts"))
    inside = Window.partitionBy("b").orderBy("ts", "g", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last("v", ignorenulls=True).over(inside)).where("g = 1")
    ends = source.withColumn("b", F.date_trunc(bucket, "ts")).groupBy("b").agg(F.max_by(value, F.struct("ts", "event_id")).alias("end"))
    buckets = rows.select("b").distinct().join(ends, "b", "full")
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.withColumn("carry", F.last("end", ignorenulls=True).over(before)).select("b", "carry")
    return rows.join(carry, "b").select("ts", F.coalesce("own", "carry").alias("v"))


@query(f"WITH {_GRID} SELECT g.ts, round(c.value, 6) AS click, round(p.value, 6) AS purchase FROM grid g ASOF LEFT JOIN (SELECT * FROM src WHERE event_type = 'click') c ON g.ts >= c.ts ASOF LEFT JOIN (SELECT * FROM src WHERE event_type = 'purchase') p ON g.ts >= p.ts", layer="adapter")
def align_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources as of each hour of their common time."""
    src = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    grid = grid_of(src)
    a = as_of(grid, src.where("event_type = 'click'"), "value").withColumnRenamed("v", "click")
    b = as_of(grid, src.where("event_type = 'purchase'"), "value").withColumnRenamed("v", "purchase")
    return a.join(b, "ts").select("ts", F.round("click", 6).alias("click"), F.round("purchase", 6).alias("purchase"))


@query(f"""WITH {_GRID}, c AS (SELECT * FROM src WHERE event_type = 'click'), a AS (SELECT g.ts, c.ts AS t0, c.value AS v0 FROM grid g ASOF LEFT JOIN c ON g.ts >= c.ts), b AS (SELECT g.ts, c.ts AS t1, c.value AS v1 FROM grid g ASOF LEFT JOIN c ON g.ts <= c.ts)
SELECT a.ts, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(a.ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 5) AS click FROM a JOIN b ON a.ts = b.ts""", layer="adapter")
def align_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source interpolated at each hour between the rows around it."""
    src = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    click = src.where("event_type = 'click'")
    grid = grid_of(src)
    # each stretch between two rows meets the hours in it: as many rows as there are hours
    day = F.date_trunc("day", "ts")
    w = Window.partitionBy("b").orderBy("ts", "event_id")
    rows = click.withColumn("b", day)
    firsts = rows.groupBy("b").agg(F.min(F.struct("ts", "event_id", "value")).alias("f"))
    firsts = firsts.withColumn("nf", F.lead("f").over(Window.orderBy("b"))).select("b", "nf")  # a row a day
    rows = rows.withColumn("n", F.lead(F.struct("ts", "event_id", "value")).over(w)).join(firsts, "b").withColumn("n", F.coalesce("n", "nf"))
    hour = F.date_trunc("hour", "ts")
    first = F.when(hour == F.col("ts"), hour).otherwise(hour + F.expr("INTERVAL 1 HOUR"))
    hours = rows.where(F.col("n").isNotNull()).withColumn("first", first).where("first < n.ts OR first = ts").withColumn("hour", F.explode(F.sequence("first", "n.ts", F.expr("INTERVAL 1 HOUR")))).where("hour < n.ts OR hour = ts")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    value = F.when(F.col("hour") == F.col("ts"), F.col("value")).otherwise(F.col("value") + (F.col("n.value") - F.col("value")) * (us(F.col("hour")) - us(F.col("ts"))) / (us(F.col("n.ts")) - us(F.col("ts"))))
    return grid.join(hours.select(F.col("hour").alias("ts"), value.alias("v")), "ts").select("ts", F.round("v", 5).alias("click"))
