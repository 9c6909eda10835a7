"""The bank: every sequence operator by name, with fit, predict, transform and process over any DataFrame of sequences.

A sequence table has columns series_id, t and x0; arrays, lists and single columns are taken too. An operator is
transductive: it learns from the rows it is given and has no state between calls. Supervised ones are fitted on
(vec_id, embedding, label) and predict the labels of other rows. What an operator says is a belief, a row a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .plans import beliefs
from .sources.tables import as_tables

#: Layers in the order in which a pathway goes through them.
LAYERS = ("signal", "noise", "pattern", "sequence", "probability", "equation", "decision", "rl")
FEATURE, PREDICT, TERMINAL = LAYERS[:3], LAYERS[3:6], LAYERS[6:]
#: Words in names of operators that take longer than a scan, and modules that train networks.
HEAVIER = ("gaussian_process", "hmm", "gmm", "bayesian", "arima", "prophet", "garch", "esn", "hawkes", "persistent_homology", "symbolic", "particle")
BELIEF_OF_LAYER = {"signal": "signal", "noise": "denoised", "pattern": "pattern", "sequence": "forecast", "probability": "forecast", "equation": "equation", "decision": "decision", "rl": "action"}
KEYS = ("series_id", "t", "vec_id")


def validate(x, spark: SparkSession | None = None) -> DataFrame:
    """A table (series_id, t, x0 ..) of finite numbers; arrays of one or two dimensions are one series. Raises ValueError otherwise."""
    if not isinstance(x, DataFrame):
        a = np.asarray(x, float)
        a = a.reshape(-1, 1) if a.ndim == 1 else a
        if a.ndim != 2 or not a.size:
            raise ValueError(f"a sequence is rows of numbers, not an array of shape {a.shape}")
        if not np.isfinite(a).all():
            raise ValueError("a sequence is finite")
        spark = spark or SparkSession.getActiveSession()
        return spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(a)], "series_id long, t long, " + ", ".join(f"x{k} double" for k in range(a.shape[1])))
    missing = {"series_id", "t", "x0"} - set(x.columns)
    if missing:
        raise ValueError(f"a sequence table lacks {sorted(missing)}")
    values = [c for c in x.columns if c.startswith("x") and c[1:].isdigit()]
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in values]
    got = x.agg(F.count("*").alias("n"), *bad).first()
    if not got["n"]:
        raise ValueError("the sequence table is empty")
    if any(got[c] for c in values):
        raise ValueError("a sequence is finite")
    return x


class Node:
    """One operator of the bank."""

    def __init__(self, node_type: str, name: str | None = None, **params):
        known = catalog.about()
        if node_type not in known or known[node_type].get("layer") not in LAYERS:
            raise KeyError(f"unknown operator {node_type!r}")
        self.node_type, self.name, self.params = node_type, name or node_type, params
        about = known[node_type]
        self.layer, self.is_transformer, self.requires_y, self.doc = about["layer"], bool(about.get("transformer")), bool(about.get("supervised")), about["doc"]
        self.fitted, self._model = False, None

    def __repr__(self) -> str:
        return f"<Node {self.name} layer={self.layer} fitted={self.fitted}>"

    def metadata(self) -> dict:
        return {"node_type": self.node_type, "layer": self.layer, "name": self.name, "requires_y": self.requires_y, "is_transformer": self.is_transformer, "cost": node_cost(self.node_type), "params": dict(self.params), "fitted": self.fitted}

    def fit(self, x, y: DataFrame | None = None) -> Node:
        """Supervised: x has (vec_id, embedding), y (vec_id, label). Others check the sequence."""
        if self.requires_y:
            if y is None:
                raise ValueError(f"{self.node_type} needs labels")
            from .operators.classifiers import MODELS

            self._model = MODELS[self.node_type](x.select("vec_id", "embedding").join(y.select("vec_id", "label"), "vec_id"))
        else:
            validate(x)
        self.fitted = True
        return self

    def result(self, x) -> DataFrame:
        """What the operator gives over x, with its own columns."""
        if self.requires_y:
            if not self.fitted:
                raise RuntimeError(f"{self.node_type} is not fitted")
            return self._model(x)
        x = validate(x)
        self.fitted = True
        return catalog.queries()[self.node_type](x.sparkSession, as_tables(x))

    def predict(self, x) -> DataFrame:
        """Beliefs: (series_id, belief), a row a series (or vector)."""
        return believed(self.result(x), self.node_type, self.name)

    def transform(self, x) -> DataFrame:
        """The sequence rewritten: (series_id, t, x0)."""
        if not self.is_transformer:
            raise NotImplementedError(f"{self.node_type} does not rewrite the sequence")
        return rewritten(self.result(x))

    def process(self, x, y: DataFrame | None = None) -> DataFrame:
        if not self.fitted:
            self.fit(x, y)
        return self.predict(x)


def numbers(rows: DataFrame) -> list[str]:
    """The columns of numbers that are no keys."""
    return [f.name for f in rows.schema.fields if f.name not in KEYS and f.dataType.simpleString().split("(")[0] in ("double", "float", "int", "bigint", "decimal", "smallint", "tinyint")]


def rewritten(rows: DataFrame) -> DataFrame:
    """(series_id, t, x0) from a transformer's rows: its first column of numbers; rows without a value are left out."""
    lead = numbers(rows)
    if "t" not in rows.columns or not lead:
        raise NotImplementedError("no sequence in the result")
    return rows.select("series_id", F.col("t").cast("long").alias("t"), F.col(lead[0]).cast("double").alias("x0")).where("x0 IS NOT NULL AND NOT isnan(x0)")


def believed(rows: DataFrame, node_type: str, source: str) -> DataFrame:
    """(series_id, belief): of rows with a time the last one speaks, of several without one the greatest."""
    key = next((c for c in ("series_id", "vec_id") if c in rows.columns), None)
    rows = rows if key else rows.withColumn("series_id", F.lit(0).cast("long"))
    key = key or "series_id"
    said = [c for c in rows.columns if c not in KEYS]
    packed = F.struct(*[F.col(c) for c in said])
    if "t" in rows.columns:
        rows = rows.groupBy(key).agg(F.max_by(packed, "t").alias("s"), F.count("*").alias("n"))
    else:
        rows = rows.groupBy(key).agg(F.max(packed).alias("s"), F.count("*").alias("n"))
    conf = F.col("s.confidence").cast("double") if "confidence" in said else F.lit(0.5)
    kind = BELIEF_OF_LAYER.get(catalog.about().get(node_type, {}).get("layer"), "signal")
    payload = {c: F.col(f"s.{c}") for c in said} | {"n_rows": F.col("n")}
    return rows.select(F.col(key).alias("series_id"), beliefs.belief(kind, source, conf, **payload).alias("belief"))


# ------------------------------------------------------------------ the bank
def all_node_types() -> list[str]:
    return sorted(k for k, v in catalog.about().items() if v.get("layer") in LAYERS)


def layers() -> list[str]:
    return sorted({catalog.about()[k]["layer"] for k in all_node_types()})


def by_layer(layer: str) -> list[str]:
    return [k for k in all_node_types() if catalog.about()[k]["layer"] == layer]


def create(node_type: str, **params) -> Node:
    return Node(node_type, **params)


def default_bank() -> list[Node]:
    """One of each operator, by layer and then name."""
    return [Node(k) for k in sorted(all_node_types(), key=lambda k: (LAYERS.index(catalog.about()[k]["layer"]), k))]


def node_cost(node_type: str) -> str:
    """low, med or high: high for trained networks, med for names in HEAVIER."""
    about = catalog.about().get(node_type, {})
    if about.get("cost"):
        return about["cost"]
    return "med" if any(w in node_type for w in HEAVIER) else "low"


def role(node_type: str) -> str:
    layer = catalog.about().get(node_type, {}).get("layer")
    return "feature" if layer in FEATURE else "predictor" if layer in PREDICT else "terminal" if layer in TERMINAL else "other"


def out_kind(node_type: str) -> str:
    about = catalog.about().get(node_type)
    if about is None:
        return "unknown"
    if about.get("transformer"):
        return "transform"
    return {"terminal": "terminal", "predictor": "predict"}.get(role(node_type), "feature")


def compatible(a: str, b: str) -> bool:
    """Whether b may follow a: forward through the layers, and nothing after a terminal. Unknown names are allowed."""
    known = catalog.about()
    if a not in known or b not in known:
        return True
    x, y = known[a].get("layer"), known[b].get("layer")
    if x in TERMINAL:
        return False
    return (LAYERS.index(y) if y in LAYERS else 99) >= (LAYERS.index(x) if x in LAYERS else 0)


def genome_card(node_type: str) -> dict:
    about = catalog.about().get(node_type, {})
    return {"node_type": node_type, "layer": about.get("layer"), "role": role(node_type), "out_kind": out_kind(node_type), "cost": node_cost(node_type), "is_transformer": bool(about.get("transformer"))}


# ------------------------------------------------------------------ projections
#: The payload keys that stand for a belief of each type, in order of preference.
PRIMARY = {"forecast": ("estimate", "next", "forecast", "point", "value"), "anomaly": ("fraction", "n_anomalies"), "equation": ("r2",), "regime": ("current_state",), "next_state": ("next_state",), "action": ("action",), "decision": ("action",), "denoised": ("residual",), "cluster": ("n_clusters",), "density": ("max_proba",), "pattern": ("n_patterns",), "spectral": ("dominant_freq",), "signal": ()}


def primary_scalar(b: Column) -> Column:
    """The number that stands for a belief: its type's own key, else the first finite number of its payload, else 0."""
    payload = b["payload"]
    value = lambda k: F.try_element_at(payload, F.lit(k)).try_cast("double")
    own = F.lit(None).cast("double")
    for kind, keys in PRIMARY.items():
        if keys:
            own = F.when(b["type"] == kind, F.coalesce(*[value(k) for k in keys])).otherwise(own)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rest = F.filter(F.transform(F.map_values(F.map_filter(payload, lambda k, _: k != "n_rows")), lambda v: v.try_cast("double")), finite)
    return F.coalesce(F.when(finite(own), own), F.try_element_at(rest, F.lit(1)), F.lit(0.0))


def belief_to_vector(b: Column) -> Column:
    """[primary scalar, confidence]."""
    return F.array(primary_scalar(b), b["confidence"])


def assert_projection_completeness() -> dict:
    """Every declared type has a projection: its own, or the first number."""
    missing = [k for k in beliefs.REQUIRED if k not in PRIMARY]
    return {"dedicated": sorted(set(beliefs.REQUIRED) & set(PRIMARY)), "fallback": missing}


# ------------------------------------------------------------------ pathways over the bank
def hops(x, pathway: list[str]) -> Iterator[tuple[str, DataFrame]]:
    """(operator, beliefs) of each step; transformers rewrite the sequence for the steps after them. Raises ValueError when the layers go back."""
    for a, b in zip(pathway, pathway[1:]):
        if not compatible(a, b):
            raise ValueError(f"{b} can't follow {a}: a pathway goes forward through the layers")
    x = validate(x)
    for name in pathway:
        node = create(name)
        rows = node.result(x)
        yield name, believed(rows, name, name)
        if node.is_transformer and "t" in rows.columns:
            x = rewritten(rows)


def run(x, pathway: list[str]) -> DataFrame:
    """(series_id, step, node, belief) of all hops."""
    out = None
    for step, (name, rows) in enumerate(hops(x, pathway)):
        rows = rows.select("series_id", F.lit(step).alias("step"), F.lit(name).alias("node"), "belief")
        out = rows if out is None else out.unionByName(rows)
    return out


def candidates(pathway: list[str], pool: list[str] | None = None, jump: int = 2) -> list[str]:
    """What may come next: unused operators of this layer or up to `jump` layers on (terminal layers always), by layer and name."""
    pool = pool or all_node_types()
    if not pathway:
        return [n for n in pool if catalog.about()[n]["layer"] == LAYERS[0]]
    here = LAYERS.index(catalog.about()[pathway[-1]]["layer"])
    if here >= LAYERS.index(TERMINAL[0]):
        return []
    at = lambda n: LAYERS.index(catalog.about()[n]["layer"])
    return sorted((n for n in pool if n not in pathway and at(n) >= here and (at(n) - here <= jump or LAYERS[at(n)] in TERMINAL)), key=lambda n: (at(n), n))


class HeuristicRouter:
    """Goes on to the next layer that has a candidate, and stops at a terminal one."""

    def choose(self, pathway: list[str], options: list[str]) -> str | None:
        if not options:
            return None
        here = LAYERS.index(catalog.about()[pathway[-1]]["layer"]) if pathway else -1
        later = [n for n in options if LAYERS.index(catalog.about()[n]["layer"]) > here]
        return (later or options)[0]


class ReputationRouter:
    """Takes the candidate whose edge from the last operator has the best score; unknown edges are left to the heuristic."""

    def __init__(self, reputation, regime: str = "all"):
        self.reputation, self.regime, self.fallback = reputation, regime, HeuristicRouter()

    def choose(self, pathway: list[str], options: list[str]) -> str | None:
        if not options:
            return None
        if pathway:
            scores = {n: self.reputation.edge_score(pathway[-1], n, self.regime) for n in options}
            known = {n: s for n, s in scores.items() if s is not None}
            if known:
                return max(sorted(known), key=known.get)
        return self.fallback.choose(pathway, options)


class LLMRouter:
    """Asks complete(prompt) -> text for the next operator as JSON ({"next": name}, or null to stop); the heuristic answers when it does not."""

    def __init__(self, complete):
        self.complete, self.fallback = complete, HeuristicRouter()

    def choose(self, pathway: list[str], options: list[str]) -> str | None:
        from .plans.search import extract_json

        if not options:
            return None
        got = extract_json(self.complete(f"Pathway so far: {pathway}. Candidates: {options}. Answer with JSON: {{\"next\": name or null}}."))
        if isinstance(got, dict) and "next" in got and (got["next"] is None or got["next"] in options):
            return got["next"]
        return self.fallback.choose(pathway, options)


def route(router, pool: list[str] | None = None, longest: int = 8) -> list[str]:
    """The pathway that a router takes through the bank."""
    path: list[str] = []
    while len(path) < longest:
        n = router.choose(path, candidates(path, pool))
        if n is None:
            break
        path.append(n)
    return path
