"""Keyed stores in Parquet folders: leaderboard, reputation of pathways, vectors, features, knowledge.

A store is a folder in a place that driver and executors share. Writes append files; a reader takes the latest row of a
key, so writers never rewrite what others read, and a lost executor costs a retry.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .functions.text import chunk_text


class Table:
    """Rows of one schema in a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def append(self, rows: Iterable[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), self.schema)
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:  # no row yet
            return self.spark.createDataFrame([], self.schema)

    def latest(self, *key: str, by: str = "ts") -> DataFrame:
        """The newest row of each key, by an aggregate with a partial one before it."""
        rows = self.read()
        rest = F.struct(*[F.col(c) for c in rows.columns])
        return rows.groupBy(*key).agg(F.max_by(rest, by).alias("r")).select("r.*")


class Leaderboard:
    """Trials of a search. Metrics: crps_skill and dsr (high is good), mean_crps (low is)."""

    SCHEMA = "id string, ts double, spec_sig string, spec string, dataset_id string, n_nodes int, combiner string, n_eval bigint, mean_crps double, baseline_crps double, crps_skill double, calib_ks double, calibrated boolean, dsr double, notes string"
    METRICS = {"crps_skill": True, "dsr": True, "mean_crps": False}

    def __init__(self, spark: SparkSession, path: str):
        self.table = Table(spark, path, self.SCHEMA)

    def record(self, spec, score: dict, dataset_id: str = "default", dsr: float | None = None, notes: str = "") -> str:
        key = uuid.uuid4().hex
        number = lambda k: None if score.get(k) is None else float(score[k])
        self.table.append([(key, time.time(), spec.signature(), json.dumps(spec.to_dict()), dataset_id, spec.n_nodes, spec.combiner, int(score.get("n", 0)), number("mean_crps"), number("baseline_crps"), number("crps_skill"), number("calib_ks"), bool(score.get("calibrated", False)), dsr, notes)])
        return key

    def _rows(self, dataset_id: str | None) -> DataFrame:
        rows = self.table.read()
        return rows if dataset_id is None else rows.where(F.col("dataset_id") == dataset_id)

    def top(self, k: int = 10, metric: str = "crps_skill", dataset_id: str | None = None, dedupe: bool = True) -> DataFrame:
        """The k best trials, of each specification the best alone; trials without the metric have no place."""
        if metric not in self.METRICS:
            raise ValueError(f"unknown metric {metric!r}; known: {sorted(self.METRICS)}")
        rows = self._rows(dataset_id).where(F.col(metric).isNotNull() & ~F.isnan(metric))
        good = F.col(metric) if self.METRICS[metric] else -F.col(metric)
        if dedupe:
            rows = rows.groupBy("spec_sig").agg(F.max_by(F.struct(*rows.columns), F.struct(good, F.col("id"))).alias("r")).select("r.*")
        return rows.orderBy(good.desc(), "id").limit(k)

    def best(self, metric: str = "crps_skill", dataset_id: str | None = None) -> dict | None:
        r = self.top(1, metric, dataset_id).first()
        return r.asDict() if r else None

    def get(self, key: str) -> dict | None:
        r = self.table.read().where(F.col("id") == key).first()
        return r.asDict() if r else None

    def count(self) -> int:
        return self.table.read().count()

    def summary(self, dataset_id: str | None = None) -> dict:
        r = self._rows(dataset_id).agg(F.count("*").alias("n_runs"), F.count_distinct("spec_sig").alias("n_specs"), F.count_if(F.col("crps_skill") > 0).alias("n_beat_baseline"), F.count_if(F.col("dsr") >= 0.95).alias("n_dsr_significant"), F.max("crps_skill").alias("best_skill"), F.max_by("combiner", "crps_skill").alias("best_combiner")).first()
        return r.asDict()


def fading_score(outcomes, gamma: float = 0.95, c: float = 2.0) -> float:
    """Mean of outcomes with weights that fade by gamma, and a bonus that falls with their weight."""
    import math

    x = [float(v) for v in outcomes]
    if not x:
        return 0.0
    w = [gamma ** (len(x) - 1 - i) for i in range(len(x))]
    total = sum(w)
    return sum(a * b for a, b in zip(w, x)) / total + math.sqrt(c * math.log(max(2.0, total + 1)) / total)


class PathwayReputation:
    """What is known of pathways and their edges, by regime."""

    SCHEMA = "regime string, pathway array<string>, score double, mean_outcome double, report string, ts double"

    def __init__(self, spark: SparkSession, path: str, gamma: float = 0.95):
        self.table, self.gamma = Table(spark, path, self.SCHEMA), gamma

    def record(self, pathway, outcomes=None, report: dict | None = None, regime: str = "all") -> dict:
        if outcomes is not None and len(outcomes):
            score, mean = fading_score(outcomes, self.gamma), float(sum(outcomes)) / len(outcomes)
        else:
            score, mean = float((report or {}).get("ucb", 0.0)), float((report or {}).get("sharpe", 0.0))
        self.table.append([(regime, list(pathway), score, mean, None if report is None else json.dumps(report), time.time())])
        return {"pathway": list(pathway), "score": score, "mean_outcome": mean}

    def stats(self, regime: str = "all") -> DataFrame:
        """(pathway, uses, score, mean_outcome, report): the last record of each pathway and how many there are."""
        rows = self.table.read().where(F.col("regime") == regime)
        return rows.groupBy("pathway").agg(F.count("*").alias("uses"), F.max_by("score", "ts").alias("score"), F.max_by("mean_outcome", "ts").alias("mean_outcome"), F.max_by("report", "ts").alias("report"))

    def pathway_score(self, pathway, regime: str = "all") -> float:
        r = self.stats(regime).where(F.col("pathway") == F.array(*[F.lit(p) for p in pathway])).first()
        return r["score"] if r else 0.0

    def edges(self, regime: str = "all") -> DataFrame:
        """(a, b, pathways, mean_score, max_score)."""
        return edges_of(self.stats(regime))

    def edge_score(self, a: str, b: str, regime: str = "all") -> float | None:
        r = self.edges(regime).where((F.col("a") == a) & (F.col("b") == b)).first()
        return r["mean_score"] if r else None

    def leaderboard(self, regime: str = "all", top: int = 20) -> DataFrame:
        return self.stats(regime).orderBy(F.desc("score"), "pathway").limit(top)

    def known_regimes(self) -> list[str]:
        return sorted(r["regime"] for r in self.table.read().select("regime").distinct().collect())

    def to_dict(self, regime: str = "all", top: int = 20) -> dict:
        rows = [r.asDict() for r in self.leaderboard(regime, top).collect()]
        return {"regime": regime, "n_pathways": len(rows), "leaderboard": rows, "edges": {f"{r['a']}->{r['b']}": round(r["max_score"], 4) for r in self.edges(regime).collect()}}


def edges_of(stats: DataFrame) -> DataFrame:
    """(a, b, pathways, mean_score, max_score) of pathways (pathway, score); an edge counts once a pathway."""
    pairs = F.array_distinct(F.arrays_zip(F.slice("pathway", 1, F.greatest(F.size("pathway") - 1, F.lit(0))).alias("a"), F.slice("pathway", 2, F.size("pathway")).alias("b")))
    rows = stats.select("score", F.explode(pairs).alias("e"))
    return rows.groupBy(F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.count("*").alias("pathways"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))


def embedded(text: Column, dim: int = 512) -> Column:
    """Array of dim numbers of length one: words (letters, digits, underscores) counted in hashed buckets; all 0 without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    bucket = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = F.aggregate(F.array_distinct(bucket), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")), lambda m, b: F.map_concat(m, F.create_map(b, F.size(F.filter(bucket, lambda x: x == b)).cast("double"))))
    norm = F.sqrt(F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(counts, i) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


class VectorStore:
    """Passages with vectors of length one; a passage of a known id takes the old one's place."""

    SCHEMA = "id string, text string, source string, metadata string, vector array<double>, ts double"

    def __init__(self, spark: SparkSession, path: str):
        self.table = Table(spark, path, self.SCHEMA)

    def add(self, passages: DataFrame) -> None:
        """passages: (id, text, source, vector[, metadata])."""
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        vector = F.when(norm > 0, F.transform("vector", lambda x: x / norm)).otherwise(F.col("vector"))
        more = F.col("metadata") if "metadata" in passages.columns else F.lit(None).cast("string")
        self.table.append(passages.select("id", "text", "source", more.alias("metadata"), vector.alias("vector"), F.lit(time.time()).alias("ts")))

    def passages(self) -> DataFrame:
        return self.table.latest("id")

    def __len__(self) -> int:
        return self.table.read().select("id").distinct().count()

    def search(self, vector: list[float], k: int = 5, where: Column | None = None) -> DataFrame:
        """(id, text, source, metadata, score): the k of greatest cosine; the filter comes before the limit."""
        rows = self.passages()
        rows = rows if where is None else rows.where(where)
        size = sum(v * v for v in vector) ** 0.5 or 1.0
        q = F.array(*[F.lit(v / size) for v in vector])
        score = F.aggregate(F.zip_with("vector", q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return rows.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k).select("id", "text", "source", "metadata", "score")

    def save(self, path: str) -> str:
        self.passages().write.mode("overwrite").parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorStore:
        return cls(spark, path)


class FeatureStore:
    """Features of a table by a signature of both; computed once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def key(rows: DataFrame, factory) -> str:
        """From the factory's name and code and the table's rows, in any order: a sum and an xor of row hashes."""
        h = F.xxhash64(*[F.col(c) for c in rows.columns])
        r = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")).first()
        code = getattr(factory, "__code__", None)
        return hashlib.blake2b(f"{rows.columns}{r['n']}{r['x']}{r['s']}{getattr(factory, '__qualname__', factory)}{code.co_code.hex() if code else ''}{code.co_consts if code else ''}".encode(), digest_size=8).hexdigest()

    def get(self, key: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{key}")
        except AnalysisException:
            return None

    def get_or_compute(self, rows: DataFrame, factory) -> DataFrame:
        key = self.key(rows, factory)
        hit = self.get(key)
        if hit is None:
            factory(rows).write.mode("overwrite").parquet(f"{self.path}/{key}")
            hit = self.get(key)
        return hit


class KnowledgeBase:
    """Texts in chunks with hashed vectors: ingest, retrieve, remember and recall."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 512):
        self.spark, self.dim, self.store = spark, dim, VectorStore(spark, path)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
        rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(source_col).alias("source"), F.posexplode(chunk_text(F.coalesce(F.col(text_col), F.lit("")))).alias("k", "text"))
        self.store.add(rows.select(F.concat_ws("#", "i", "k").alias("id"), "text", "source", embedded(F.col("text"), self.dim).alias("vector")))

    def _vector(self, text: str) -> list[float]:
        return self.spark.range(1).select(embedded(F.lit(text), self.dim).alias("v")).first()["v"]

    def retrieve(self, query: str, k: int = 5, source: str | None = None, source_prefix: str | None = None) -> DataFrame:
        where = F.lit(True)
        if source is not None:
            where = where & (F.col("source") == source)
        if source_prefix is not None:
            where = where & F.col("source").startswith(source_prefix)
        return self.store.search(self._vector(query), k, where)

    def remember(self, note: str, kind: str = "finding", metadata: dict | None = None) -> str:
        key = f"archival/{kind}/{uuid.uuid4().hex}"
        rows = self.spark.createDataFrame([(key, note, "archival", json.dumps((metadata or {}) | {"kind": kind}))], "id string, text string, source string, metadata string")
        self.store.add(rows.withColumn("vector", embedded(F.col("text"), self.dim)))
        return key

    def recall(self, query: str, k: int = 5) -> DataFrame:
        return self.retrieve(query, k, source_prefix="archival")

    def consolidate(self, min_answer: int = 50) -> int:
        """Copies remembered questions with long answers (`Q: .. A: ..`) to source consolidated_qa, each question once; gives how many are new."""
        rows = self.store.passages().where("source = 'archival' AND get_json_object(metadata, '$.kind') = 'chat_qa'")
        rows = rows.withColumn("q", F.regexp_extract("text", r"(?s)^Q:\s*(.*?)\s*A:", 1)).withColumn("a", F.regexp_extract("text", r"(?s)A:\s*(.*)$", 1))
        rows = rows.where((F.length("a") >= min_answer) & (F.col("q") != "")).withColumn("id", F.concat(F.lit("consolidated_qa#"), F.md5(F.lower(F.trim("q")).cast("binary"))))
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("ts"))).where("k = 1")
        known = self.store.passages().where("source = 'consolidated_qa'").select("id")
        new = rows.join(known, "id", "left_anti").select("id", "text", F.lit("consolidated_qa").alias("source"), "vector", "metadata")
        n = new.count()
        if n:
            self.store.add(new)
        return n
