"""Operators on pairs of rows: clusters, neighbours, recurrence. Pairs stay inside a series or meet a fixed set of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, sql_query
from ..sources.tables import OBS_EVENTS, obs_events, table

sql_query("dbscan_core", f"""WITH {OBS_EVENTS}, s AS (SELECT series_id, t, (x0 - avg(x0) OVER (PARTITION BY series_id)) / (stddev_pop(x0) OVER (PARTITION BY series_id) + 1e-9) AS z FROM obs)
SELECT a.series_id, a.t, count(*) AS neighbours, CASE WHEN count(*) >= 4 THEN 1 ELSE 0 END AS core FROM s a JOIN s b ON a.series_id = b.series_id AND abs(a.z - b.z) <= 0.8 GROUP BY a.series_id, a.t""", "Rows with at least 4 of the series within 0.8 deviations, themselves included.", layer="pattern")

sql_query("dbscan", f"""WITH {OBS_EVENTS}, s AS (SELECT series_id, t, (x0 - avg(x0) OVER (PARTITION BY series_id)) / (stddev_pop(x0) OVER (PARTITION BY series_id) + 1e-9) AS z FROM obs),
c AS (SELECT a.series_id, a.t, max(a.z) AS z FROM s a JOIN s b ON a.series_id = b.series_id AND abs(a.z - b.z) <= 0.8 GROUP BY a.series_id, a.t HAVING count(*) >= 4),
g AS (SELECT series_id, t, z, CASE WHEN z - lag(z) OVER (PARTITION BY series_id ORDER BY z, t) <= 0.8 THEN 0 ELSE 1 END AS new FROM c),
k AS (SELECT series_id, t, z, sum(new) OVER (PARTITION BY series_id ORDER BY z, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS label FROM g),
r AS (SELECT s.series_id, s.t, coalesce(min(k.label), -1) AS label FROM s LEFT JOIN k ON s.series_id = k.series_id AND abs(s.z - k.z) <= 0.8 GROUP BY s.series_id, s.t)
SELECT series_id, t, cast(label AS bigint) AS label FROM r""", "Density clusters of one column: core rows chain along the sorted values, so components need no iteration; -1 is noise.", layer="pattern")

sql_query("hopfield_denoise", f"""WITH {OBS_EVENTS}, s AS (SELECT series_id, t, x0, (x0 - avg(x0) OVER (PARTITION BY series_id)) / (stddev_pop(x0) OVER (PARTITION BY series_id) + 1e-9) AS z FROM obs)
SELECT a.series_id, a.t, round(sum(exp(2 * a.z * b.z - 2 * abs(a.z) * 10) * b.x0) / sum(exp(2 * a.z * b.z - 2 * abs(a.z) * 10)) + 0.0, 6) AS y FROM s a JOIN s b ON a.series_id = b.series_id GROUP BY a.series_id, a.t""", "Softmax recall of the series' own rows, sharpness 2.", layer="noise", transformer=True)

def skyline(rows: DataFrame, key: str, goals: list[str]) -> DataFrame:
    """Rows that no other row is at least as good as in every goal (all to be great) and better in one.

    Each task keeps the front of its rows, and one task the front of those; a row that is off a part's front is off the
    whole one. Nothing is paired, and only fronts move.
    """
    rows = rows.select(key, *goals)

    def front(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            x = held[goals].to_numpy(float)
            order = np.lexsort(tuple(-x[:, j] for j in reversed(range(x.shape[1]))))  # a row is beaten by earlier ones alone
            kept: list[int] = []
            best = np.zeros((0, x.shape[1]))
            for i in order:
                if not len(best) or not ((best >= x[i]).all(1) & (best > x[i]).any(1)).any():
                    kept.append(int(i))
                    best = np.vstack([best, x[i]])
            held = held.iloc[sorted(kept)]
        if held is not None:
            yield held

    return rows.mapInPandas(front, rows.schema).repartition(1).mapInPandas(front, rows.schema)


def _goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs_events(spark, sf_dir).groupBy("series_id").agg(F.avg("x0").alias("gain"), (-F.stddev_pop("x0")).alias("calm"))


@query(
    f"""WITH {OBS_EVENTS}, o AS (SELECT series_id, avg(x0) AS a, -stddev_pop(x0) AS b FROM obs GROUP BY series_id),
d AS (SELECT p.series_id FROM o p JOIN o q ON q.a >= p.a AND q.b >= p.b AND (q.a > p.a OR q.b > p.b) GROUP BY p.series_id)
SELECT o.series_id, round(a, 6) AS gain, round(b, 6) AS calm FROM o LEFT JOIN d ON o.series_id = d.series_id WHERE d.series_id IS NULL""",
    layer="evaluation",
)
def nondominated_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pareto front of two objectives over strategies; the SQL compares all pairs."""
    return skyline(_goals(spark, sf_dir), "series_id", ["gain", "calm"]).select("series_id", F.round("gain", 6).alias("gain"), F.round("calm", 6).alias("calm"))


_FRONTS = 4


@query(
    f"""WITH {OBS_EVENTS}, o0 AS (SELECT series_id, avg(x0) AS a, -stddev_pop(x0) AS b FROM obs GROUP BY series_id),
"""
    + ",\n".join(f"f{i} AS (SELECT p.* FROM o{i} p WHERE NOT EXISTS (SELECT 1 FROM o{i} q WHERE q.a >= p.a AND q.b >= p.b AND (q.a > p.a OR q.b > p.b))), o{i + 1} AS (SELECT o{i}.* FROM o{i} ANTI JOIN f{i} ON o{i}.series_id = f{i}.series_id)" for i in range(_FRONTS))
    + " "
    + " UNION ALL ".join(f"SELECT series_id, {i} AS front FROM f{i}" for i in range(_FRONTS)),
    layer="evaluation",
)
def nondominated_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four fronts: each is the front of what those before it leave."""
    return fronts(_goals(spark, sf_dir), "series_id", ["gain", "calm"], _FRONTS)


def fronts(rows: DataFrame, key: str, goals: list[str], most: int) -> DataFrame:
    """(key, front) of the first `most` fronts, from 0."""
    out, rest = None, rows.select(key, *goals)
    for i in range(most):
        front = skyline(rest, key, goals).select(key)
        step = front.withColumn("front", F.lit(i))
        out = step if out is None else out.union(step)
        rest = rest.join(front, key, "left_anti")
    return out


@query(
    f"""WITH {OBS_EVENTS}, o AS (SELECT series_id, avg(x0) AS a, -stddev_pop(x0) AS b FROM obs GROUP BY series_id),
m AS (SELECT *, max(b) OVER (ORDER BY a DESC, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM o)
SELECT series_id, round(a, 6) AS gain, round(b, 6) AS calm FROM m WHERE best IS NULL OR b > best""",
    layer="evaluation",
)
def skyline_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pareto front of two objectives over strategies, by fronts of parts."""
    return skyline(_goals(spark, sf_dir), "series_id", ["gain", "calm"]).select("series_id", F.round("gain", 6).alias("gain"), F.round("calm", 6).alias("calm"))


#: Queries that go to all executors at once (8 bytes a number; 50 MB at 64 dimensions); more go in rounds.
ROUND_QUERIES = 100_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, vec_id, rank, score): the k rows of vectors (vec_id, embedding) nearest to each row of queries, by cosine or distance.

    Exact. A round takes a block of queries to every task, which keeps the best k of its own rows for each in numpy;
    the best of all tasks meet in one aggregate. So a query gives k rows a task, whatever the number of vectors, and no
    pair of rows is ever a row. Equal scores (cosines to nine digits, distances to six) are ranked by id; by distance, no row is its own neighbour.
    """
    spark = vectors.sparkSession
    n = queries.count()
    rounds = max(1, -(-n // ROUND_QUERIES))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(rounds))
    out = None
    for r in range(rounds):
        block = queries.where(part == r).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
        ids = np.array(block.column(0).to_pylist(), np.int64)
        u = np.array(block.column(1).to_pylist(), float).reshape(len(ids), -1)
        shared = spark.sparkContext.broadcast((ids, u))

        def best(batches, shared=shared):
            ids, u = shared.value
            scores, found = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64)
            norm = np.sqrt((u * u).sum(1))
            for b in batches:
                e = np.stack(b["embedding"].to_numpy()).astype(float)
                own = b["vec_id"].to_numpy(np.int64)
                for i in range(0, len(ids), 512):
                    q, qi = u[i : i + 512], ids[i : i + 512]
                    dots = q @ e.T
                    s = -dots / (norm[i : i + 512, None] * np.sqrt((e * e).sum(1))) if metric == "cosine" else np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (e * e).sum(1) - 2 * dots))
                    s = np.where(qi[:, None] == own, np.inf, np.round(s, 6)) if metric != "cosine" else np.round(s, 9)
                    s, f = np.concatenate([scores[i : i + 512], s], 1), np.concatenate([found[i : i + 512], np.broadcast_to(own, s.shape)], 1)
                    order = np.lexsort((f, s), axis=1)[:, :k]
                    scores[i : i + 512], found[i : i + 512] = np.take_along_axis(s, order, 1), np.take_along_axis(f, order, 1)
            at = np.isfinite(scores).ravel()
            if at.any():
                yield pd.DataFrame({"query_id": np.repeat(ids, k)[at], "vec_id": found.ravel()[at], "s": scores.ravel()[at]})

        step = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(best, "query_id bigint, vec_id bigint, s double")
        out = step if out is None else out.union(step)
    top = F.slice(F.array_sort(F.collect_list(F.struct("s", "vec_id"))), 1, k)
    rows = out.groupBy("query_id").agg(top.alias("top")).select("query_id", F.posexplode("top").alias("rank", "x"))
    score = -F.col("x.s") if metric == "cosine" else F.col("x.s")
    return rows.select("query_id", "x.vec_id", (F.col("rank") + 1).alias("rank"), score.alias("score"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS c FROM v q CROSS JOIN v WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(c, 5) AS cosine FROM k WHERE rank <= 5""",
    layer="knowledge",
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of greatest cosine for every vector whose id is divisible by 20, against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", "rank", F.round("score", 5).alias("cosine"))


@query(
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), c AS (SELECT label, j, avg(v) AS m FROM x GROUP BY label, j),
d AS (SELECT x.vec_id, c.label, sum((v - m) * (v - m)) AS d FROM x JOIN c ON x.j = c.j GROUP BY x.vec_id, c.label)
SELECT vec_id, min_by(label, d) AS prediction, round(sqrt(min(d)), 4) AS distance FROM d GROUP BY vec_id""",
    layer="decision",
)
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class whose mean vector is nearest. Means are one row for all classes, and vectors meet it where they are read."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    c = e.select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("m"))
    c = c.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("m"))
    c = c.agg(F.collect_list(F.struct("label", F.transform("m", lambda x: x["m"]).alias("m"))).alias("classes"))  # a row, as long as there are classes
    d = lambda m: F.aggregate(F.zip_with("v", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    best = F.array_min(F.transform("classes", lambda k: F.struct(d(k["m"]).alias("d"), k["label"].alias("label"))))
    rows = e.join(F.broadcast(c)).withColumn("best", best)  # one row
    return rows.select("vec_id", F.col("best.label").alias("prediction"), F.round(F.sqrt("best.d"), 4).alias("distance"))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 6), b.vec_id) AS k FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 20 = 0),
c AS (SELECT vec_id, label, count(*) AS n FROM p WHERE k <= 5 GROUP BY vec_id, label)
SELECT vec_id, min_by(label, -n * 1000 + label) AS prediction, max(n) / 5 AS share FROM c GROUP BY vec_id""",
    layer="decision",
)
def knn_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote of the 5 nearest of all vectors for every twentieth vector."""
    e = table(spark, sf_dir, "embeddings")
    near = nearest(e, e.where("vec_id % 20 = 0"), 5, "distance")
    votes = near.join(e.select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy(F.col("query_id").alias("vec_id")).agg(F.min_by("label", -F.col("n") * 1000 + F.col("label")).alias("prediction"), (F.max("n") / 5).alias("share"))
