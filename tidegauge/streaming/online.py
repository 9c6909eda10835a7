"""Online forms of operators: event-time windows with a watermark, and running state by series.

Late rows count until the watermark has passed their window; then they are
dropped. State lives in the checkpoint of the stream, so a restart goes on where
it ended.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from ..catalog import query
from ..sources.tables import table


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one in local mode alone."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tidegauge-")
    return f"{top.rstrip('/')}/streams/{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that the stream has so far, as a table: Parquet files that the batches write, and no row on the driver."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)
    how = "overwrite" if mode == "complete" else "append"
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode(how).parquet(f"{path}/rows")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    except AnalysisException:  # an empty stream has no batch
        return spark.createDataFrame([], stream.schema)


def windowed_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("v", 4).alias("total"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", layer="streaming")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type from the stream, once all has arrived."""
    return run_once(windowed_counts(events_stream(spark, sf_dir)), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT user_id AS series_id, count(*) AS n, round(max(value), 4) AS largest FROM events GROUP BY user_id", layer="streaming")
def stream_running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and largest value by user from running state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, float("-inf"))
        for pdf in batches:
            n, top = n + len(pdf), max(top, float(pdf["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"series_id": [key[0]], "n": [n], "largest": [top]})

    rows = events_stream(spark, sf_dir).groupBy("user_id").applyInPandasWithState(step, "series_id bigint, n bigint, largest double", "n bigint, largest double", "update", GroupStateTimeout.NoTimeout)
    out = run_once(rows, "update")
    return out.groupBy("series_id").agg(F.max("n").alias("n"), F.round(F.max("largest"), 4).alias("largest"))
