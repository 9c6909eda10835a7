"""Pathways: operators in a chain over all series at once, each hop a row of beliefs; routing and search of chains.

A pathway is a fold of DataFrame transforms, so Catalyst sees the whole chain as
one plan: transformers rewrite column x0, the others add belief rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.tables import OBS_EVENTS, obs_events


def by():
    return Window.partitionBy("series_id").orderBy("t")


def whole():
    return Window.partitionBy("series_id")


def difference(obs: DataFrame) -> DataFrame:
    return obs.withColumn("x0", F.coalesce(F.col("x0") - F.lag("x0").over(by()), F.lit(0.0)))


def zscore(obs: DataFrame) -> DataFrame:
    return obs.withColumn("x0", (F.col("x0") - F.avg("x0").over(whole())) / (F.stddev_pop("x0").over(whole()) + 1e-9))


def anomaly_share(obs: DataFrame) -> DataFrame:
    z = F.abs(F.col("x0") - F.avg("x0").over(whole())) / (F.stddev_pop("x0").over(whole()) + 1e-9)
    share = obs.withColumn("z", z).groupBy("series_id").agg(F.avg((F.col("z") > 3).cast("double")).alias("share"))
    return share.select("series_id", F.lit("anomaly").alias("type"), F.col("share").alias("value"), F.least(F.lit(1.0), 3 * F.col("share")).alias("confidence"))


def mean_forecast(obs: DataFrame) -> DataFrame:
    return obs.groupBy("series_id").agg(F.avg("x0").alias("value"), (1 / (1 + F.stddev_pop("x0"))).alias("confidence")).select("series_id", F.lit("forecast").alias("type"), "value", "confidence")


def threshold_decision(obs: DataFrame) -> DataFrame:
    g = obs.groupBy("series_id").agg(((F.max_by("x0", "t") - F.avg("x0")) / (F.stddev_pop("x0") + 1e-9)).alias("z"))
    return g.select("series_id", F.lit("decision").alias("type"), F.when(F.col("z") > 1, 1.0).when(F.col("z") < -1, -1.0).otherwise(0.0).alias("value"), F.tanh(F.abs("z")).alias("confidence"))


#: name -> (transformer?, function, layer)
NODES: dict[str, tuple[bool, Callable, int]] = {"difference": (True, difference, 0), "zscore": (True, zscore, 0), "anomaly_share": (False, anomaly_share, 1), "mean_forecast": (False, mean_forecast, 3), "threshold_decision": (False, threshold_decision, 6)}


def connect(obs: DataFrame, pathway: list[str]) -> DataFrame:
    """Belief rows (series_id, step, node, type, value, confidence) of a pathway; layers may not go back."""
    layers = [NODES[n][2] for n in pathway]
    if layers != sorted(layers):
        raise ValueError("a pathway goes forward through the layers")
    hops = None
    for step, name in enumerate(pathway):
        rewrites, f, _ = NODES[name]
        if rewrites:
            obs = f(obs)
            rows = obs.groupBy("series_id").agg(F.avg(F.abs("x0")).alias("value")).select("series_id", F.lit("signal").alias("type"), "value", F.lit(0.5).alias("confidence"))
        else:
            rows = f(obs)
        rows = rows.select("series_id", F.lit(step).alias("step"), F.lit(name).alias("node"), "type", "value", "confidence")
        hops = rows if hops is None else hops.unionByName(rows)
    return hops


_PATH = f"""WITH {OBS_EVENTS}, a AS (SELECT series_id, t, coalesce(x0 - lag(x0) OVER (PARTITION BY series_id ORDER BY t), 0) AS x FROM obs), z AS (SELECT series_id, t, x, abs(x - avg(x) OVER (PARTITION BY series_id)) / (stddev_pop(x) OVER (PARTITION BY series_id) + 1e-9) AS z FROM a), g AS (SELECT series_id, avg(abs(x)) AS m, avg(CASE WHEN z > 3 THEN 1.0 ELSE 0.0 END) AS share, avg(x) AS mean, stddev_pop(x) AS sd, (max_by(x, t) - avg(x)) / (stddev_pop(x) + 1e-9) AS d FROM z GROUP BY series_id)
SELECT series_id, 0 AS step, 'difference' AS node, 'signal' AS type, round(m, 6) AS value, 0.5 AS confidence FROM g UNION ALL SELECT series_id, 1, 'anomaly_share', 'anomaly', round(share, 6), round(least(1, 3 * share), 6) FROM g
UNION ALL SELECT series_id, 2, 'mean_forecast', 'forecast', round(mean + 0.0, 6), round(1 / (1 + sd), 6) FROM g UNION ALL SELECT series_id, 3, 'threshold_decision', 'decision', CASE WHEN d > 1 THEN 1.0 WHEN d < -1 THEN -1.0 ELSE 0.0 END, round(tanh(abs(d)), 6) FROM g"""


@query(_PATH, layer="pipeline")
def connector_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default pathway over every series: its hops."""
    hops = connect(obs_events(spark, sf_dir), ["difference", "anomaly_share", "mean_forecast", "threshold_decision"])
    return hops.withColumn("value", F.round(F.col("value") + 0.0, 6)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH p AS ({_PATH}) SELECT series_id, node, value FROM p WHERE step = 3", layer="pipeline")
def pathway_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last belief of type decision of each series."""
    hops = connect(obs_events(spark, sf_dir), ["difference", "anomaly_share", "mean_forecast", "threshold_decision"]).where("type = 'decision'")
    return hops.groupBy("series_id").agg(F.max_by("node", "step").alias("node"), F.max_by("value", "step").alias("value"))


def route(layer: int, used: set[str], terminal: bool) -> str | None:
    """The next node of a heuristic route: the first unused one, by layer and name, that does not go back and jumps two layers at most; None at the end."""
    if terminal:
        return None
    legal = [(NODES[n][2], n) for n in NODES if n not in used and NODES[n][2] >= layer and (NODES[n][2] - layer <= 2 or NODES[n][2] >= 6)]
    return min(legal)[1] if legal else None


@query(None, layer="pipeline")
def routed_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of the route that the heuristic takes, of eight at most."""
    path: list[str] = []
    while len(path) < 8:
        n = route(NODES[path[-1]][2] if path else 0, set(path), bool(path) and NODES[path[-1]][2] >= 6)
        if n is None:
            break
        path.append(n)
    return connect(obs_events(spark, sf_dir), path)


_ERRORS = ", ".join(f"avg(x0) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS f{w}" for w in range(2, 13))
_EACH = " UNION ALL ".join(f"SELECT {w} AS w, avg(abs(x0 - f{w})) AS mae FROM f WHERE t >= 12" for w in range(2, 13))


@query(f'WITH {OBS_EVENTS}, f AS (SELECT series_id, t, x0, {_ERRORS} FROM obs), e AS ({_EACH}) SELECT w AS "window", mae, row_number() OVER (ORDER BY mae, w) AS rank FROM e', layer="pipeline")
def dag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every specification of lag windows as rows of one job: the error of trailing means of 2 to 12, ranked."""
    obs = obs_events(spark, sf_dir)
    errors = [F.avg(F.abs(F.col("x0") - F.col(f"f{w}"))).alias(f"e{w}") for w in range(2, 13)]
    for w in range(2, 13):
        obs = obs.withColumn(f"f{w}", F.avg("x0").over(by().rowsBetween(-w, -1)))
    g = obs.where("t >= 12").agg(*errors)
    rows = g.select(F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"e{w}").alias("mae")) for w in range(2, 13)])).alias("r")).select("r.*")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("mae", "window")))  # eleven rows
