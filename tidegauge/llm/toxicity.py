"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Every word, with a border on each side, gives its byte n-grams of 4 to 7 (A-Z in
lower case); they are hashed to rows of an embedding table. A document's vector
is the mean over all its n-grams, and a linear softmax over the two classes reads
it. Table and softmax are trained jointly in numpy, so a misspelling that was
never seen shares most rows with the word it stands for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The fit takes about this many labelled texts of each class, chosen by a hash of their id.
SAMPLE_PER_CLASS = 3000
ROWS, DIM, LENGTHS, EPOCHS, BATCH, SCALE = 1 << 18, 4, (4, 5, 6, 7), 6, 64, 64.0
DECAY = 1e-2


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For each n-gram length (rows of the table, which of them count, first position of each document, positions)."""
    n_docs, n = len(offsets) - 1, len(data)
    lengths = np.diff(offsets)
    padded = np.full(n + n_docs + 6, 32, np.uint32)  # a border before and after each document
    padded[np.arange(n) + np.repeat(np.arange(1, n_docs + 1), lengths)] = common._LOWER[data]
    border = ~common._IS_WORD[padded.astype(np.uint8)]
    padded[border] = 32
    inner = np.concatenate([[0], np.cumsum(border, dtype=np.int32)])
    starts = offsets[:-1] + np.arange(n_docs)
    total = n + n_docs
    code = padded[:total] * np.uint32(0x01000193) + padded[1 : total + 1]
    for k in range(2, max(LENGTHS)):
        code = code * np.uint32(0x01000193) + padded[k : total + k]
        if k + 1 in LENGTHS:
            ok = inner[k : total + k] == inner[1 : total + 1]
            h = (code ^ np.uint32(k)) * np.uint32(0x9E3779B1)
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - ROWS.bit_length() + 1)).astype(np.int32), ok, starts, total


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, shares in the text's mean, offsets of texts) of the n-grams of all texts."""
    rows, shares, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [0]
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        got = np.sort(np.concatenate([r[ok] for r, ok, _, _ in subwords(data, np.array([0, len(data)]))]))
        first = np.flatnonzero(np.diff(got, prepend=-1))
        rows.append(got[first])
        shares.append((np.diff(first, append=len(got)) / max(1, len(got))).astype(np.float32))
        sizes.append(len(first))
    return np.concatenate(rows), np.concatenate(shares), np.cumsum(sizes)


class Part:
    """A batch: its entries in order of texts, with the table's rows numbered anew."""

    def __init__(self, rows: np.ndarray, shares: np.ndarray, at: np.ndarray, docs: np.ndarray, labels: np.ndarray):
        width = at[docs + 1] - at[docs]
        index = np.arange(width.sum()) + np.repeat(at[docs] - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        self.share, self.owner = shares[index] * np.float32(SCALE), np.repeat(np.arange(len(docs), dtype=np.int32), width)
        self.used, self.code = np.unique(rows[index], return_inverse=True)
        self.code = self.code.astype(np.int32)
        self.some = np.flatnonzero(width)
        self.starts = (np.cumsum(width) - width)[self.some]
        self.labels = labels[docs]

    def means(self, own: np.ndarray) -> np.ndarray:
        """The vector of each text, from the rows that the batch uses."""
        mean = np.zeros((len(self.labels), own.shape[1]), own.dtype)
        if len(self.some):
            mean[self.some] = np.add.reduceat(own.take(self.code, axis=0) * self.share[:, None], self.starts)
        return mean

    def gradients(self, own: np.ndarray, w: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy and its penalties, by the rows used, the softmax weights and its bias."""
        mean = self.means(own)
        logits = mean @ w + b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(self.labels)), self.labels] -= 1
        p /= len(self.labels)
        back = (p @ w.T).astype(own.dtype)
        grad = [np.bincount(self.code, column.take(self.owner) * self.share, minlength=len(self.used)) for column in np.ascontiguousarray(back.T)]
        return [np.stack(grad, 1).astype(own.dtype) + DECAY * own / len(self.labels), mean.T @ p + 1e-4 * w, p.sum(0)]


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> dict:
    """Trains table and softmax jointly by Adam. Returns each row's part of the logit, the bias, and whether both classes were there.

    Every n-gram that a text has is trained. Texts are dealt to batches once; their order changes with each epoch.
    Without texts of class 1 no text is toxic, and without texts of class 0 every one.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, int)
    if not len(texts) or labels.min() == labels.max():
        bias = 20.0 if len(texts) and labels[0] == 1 else -20.0
        return {"part": np.zeros(ROWS, np.float32), "bias": bias, "prior": bias, "learned": False}
    rows, shares, at = bags(texts)
    parts = [Part(rows, shares, at, docs, labels) for docs in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH))]
    e = (rng.standard_normal((ROWS, DIM)) * 0.01).astype(np.float32)
    seen = np.zeros(ROWS, bool)
    seen[rows] = True
    e[~seen] = 0
    w = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    params = [e, w, np.zeros(2, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
        for k in rng.permutation(len(parts)):
            part = parts[k]
            step += 1
            for q, ((m, v), g) in enumerate(zip(moments, part.gradients(e.take(part.used, axis=0), params[1], params[2]), strict=True)):
                here = part.used if q == 0 else np.arange(len(m))  # rows of the table move only when they are seen
                m[here] = first = np.float32(0.9) * m.take(here, axis=0) + np.float32(0.1) * g
                v[here] = second = np.float32(0.999) * v.take(here, axis=0) + np.float32(0.001) * g * g
                params[q][here] = params[q].take(here, axis=0) - np.float32(rate / (1 - 0.9**step)) * first / (np.sqrt(second / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    w, b = params[1:]
    return {"part": (e @ (w[:, 1] - w[:, 0]) * SCALE).astype(np.float32), "bias": float(b[1] - b[0]), "prior": float(np.log(labels.mean() / (1 - labels.mean()))), "learned": True}


def logits(model: dict, column: pa.Array) -> np.ndarray:
    """The log odds of class 1 for each text; those of the classes' shares where a text has no n-gram."""
    out = np.full(len(column), model["bias"])
    part = model["part"]
    for i, j, data, offsets in common.chunks(column):
        total, count = np.zeros(j - i), np.zeros(j - i)
        for rows, ok, starts, _ in subwords(data, offsets):
            value = part.take(rows)
            value *= ok
            total += np.add.reduceat(value, starts, dtype=np.float64)
            count += np.add.reduceat(ok, starts, dtype=np.int64)
        out[i:j] += total / np.maximum(count, 1)
        out[i:j][count == 0] = model["prior"]
    return out


def fit_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Fits on about per_class labelled texts of either class, by a hash of the id, and sets the bias right for all rows' shares."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return fit([], np.zeros(0))
    share = {y: min(1.0, per_class / c) for y, c in n.items()}
    pick = F.xxhash64("i").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    rows = rows.where(pick < F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(rows), "i").select("i", "t", "y")  # 2 * per_class rows in the mean

    def train(batches):
        texts, labels = [], []
        for b in batches:
            texts += [t.encode() for t in b.column(1).to_pylist()]
            labels += b.column(2).to_pylist()
        common.begin()
        model = fit(texts, np.array(labels, int))
        del texts, labels
        common.trim()
        names = ["part", "bias", "prior", "learned"]
        yield pa.RecordBatch.from_arrays([pa.array([model["part"].tobytes()], pa.binary()), *[pa.array([model[k]]) for k in names[1:]]], names)

    # one task trains on the bounded sample, so the driver holds the finished model alone
    got = rows.repartition(1).sortWithinPartitions("i", "y").mapInArrow(train, "part binary, bias double, prior double, learned boolean").collect()
    model = got[0].asDict() | {"part": np.frombuffer(got[0]["part"], np.float32)} if got else fit([], np.zeros(0))
    if model["learned"]:
        for k in ("bias", "prior"):
            model[k] += float(np.log(share[0] / share[1]))
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out_col: str = "toxic_score") -> DataFrame:
    """One row per row of docs: id, the columns in keep, toxic_score (0 to 1). Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = [c for c in [id_col, *(keep or [])] if c != text_col]
    wanted = list(dict.fromkeys(wanted)) + ([text_col] if text_col in (keep or []) else [])
    # positions for names, so that columns may have any
    read = docs.select(F.col(f"`{text_col}`").alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(wanted) if c != text_col])
    names = [f"c{k}" for k in range(len(wanted))] + ["z"]
    schema = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(wanted)) + ", z double"

    def run(batches):
        common.begin("toxicity")
        for b in batches:
            z = np.clip(logits(shared.value, b.column(0)), -500, 500)
            columns = [b.column(k) for k in range(1, b.num_columns)] + ([b.column(0)] if len(wanted) == b.num_columns else [])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-z)))], names)
        common.trim()

    return read.mapInArrow(run, schema).toDF(*wanted, out_col)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, by a model that never saw labels of those held out. Null texts score as empty ones."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit_table(docs, labels.where(~held_out()))
    out = score(docs, model).withColumnRenamed("toxic_score", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose score is 0.5 or more.

    Every row is judged by its own text, so null ids and repeated rows stay as they are; a null text is an empty one.
    Without labels of both classes nothing is known of toxic texts, and all stay. Columns may have any name.
    """
    model = fit_table(docs, common.table(spark, sf_dir, "labels"))
    if not model["learned"]:
        return docs
    out = "toxic score"
    while out in docs.columns:
        out += "_"
    return score(docs, model, keep=docs.columns, out_col=out).where(F.col(f"`{out}`") < 0.5).select(*[f"`{c}`" for c in docs.columns])


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
