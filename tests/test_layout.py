"""The entry points, strict registration, and pathways."""

import pytest

import __spark_entry__ as entry
from tidegauge import catalog
from tidegauge.plans import pipelines


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_name_is_registered_once():
    catalog.queries()
    with pytest.raises(ValueError, match="duplicate"):
        catalog.query(name="difference")(lambda spark, folder: None)


def test_pathways_go_forward(spark):
    from tidegauge.sources.tables import obs_events

    with pytest.raises(ValueError, match="forward"):
        pipelines.connect(obs_events(spark, "/root/testdata/sf0.001"), ["mean_forecast", "difference"])
    assert pipelines.route(0, set(), False) == "difference"
    assert pipelines.route(6, set(), True) is None


def test_the_gate_reads_the_past_alone(spark):
    """A change of one value changes no forecast at or before its row."""
    from pyspark.sql import functions as F

    from tidegauge.sources.tables import table

    folder = "/root/testdata/sf0.001"
    events = table(spark, folder, "events").where("user_id < 3")
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    changed = events.join(last.withColumn("hit", F.lit(1)), ["user_id", "ts"], "left").withColumn("value", F.when(F.col("hit") == 1, 99999.0).otherwise(F.col("value"))).drop("hit").select(*events.columns)
    out = []
    sql = catalog.dialect(catalog.oracle_sql()["stacked_gated"].replace("quantile_cont", "percentile"), spark=True)
    for rows in (events, changed):
        rows.createOrReplaceTempView("events")
        out.append(sorted(map(tuple, spark.sql(sql).collect())))
    assert out[0] == out[1] and out[0]
