"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of order 0 to 3 is counted on labelled
texts and then frozen. The next byte's probability in a context is count/(n+d)
for a byte seen there, and else the escape probability d/(n+d) times the shorter
context's, without the bytes seen (exclusion), with n bytes and d distinct ones
seen. A text's exact code length under a language is the sum of -log2 of its
bytes' probabilities; the shortest code wins.

Each tree has all contexts that its language's texts had, as a dense table of its
own. A byte's context is looked up once for all languages; scoring is then two
numpy gathers a byte and language, whatever the text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The fit takes about this many labelled texts of each language, chosen by a hash of their id.
SAMPLE_PER_LANGUAGE = 500


def fit(texts: list[bytes], langs: list[str]) -> dict:
    """Frozen trees of every language in langs: bits[language][context, symbol], and own[language] from contexts of any language to where the own one starts."""
    names = sorted(set(langs))
    seen = np.zeros(256, np.int64)
    for t in texts:
        seen += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    known = np.flatnonzero(seen)
    size = len(known) + 1  # the last symbol stands for all bytes that no text had
    symbol = np.full(256, size - 1, np.int32)
    symbol[known] = np.arange(size - 1)
    others = max(1, 256 - len(known))
    grams = {name: [] for name in names}
    for t, name in zip(texts, langs, strict=True):
        if t:
            grams[name].append(symbol[np.frombuffer(t, np.uint8)].astype(np.int64))
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # [order][language]: codes of context and symbol, counts
    for order in range(4):
        counts.append([])
        for name in names:
            codes = []
            for s in grams[name]:
                if len(s) > order:
                    code = s[order:].copy()
                    for back in range(1, order + 1):
                        code += s[order - back : len(s) - back] * size**back
                    codes.append(code)
            counts[-1].append(np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    nodes = [np.zeros(1, np.int64)] + [np.unique(np.concatenate([c // size for c, _ in counts[order]])) for order in (1, 2, 3)]
    base, index, shorter_node = 0, [], []
    for order in range(4):  # a context without a node falls to the shorter one
        here = np.tile(index[-1], size) if order else np.zeros(1, np.int32)
        shorter_node.append(here[nodes[order]])
        here[nodes[order]] = base + np.arange(len(nodes[order]))
        index.append(here)
        base += len(nodes[order])
    own, bits = [], []
    for k in range(len(names)):
        tables, places, contexts, first = [], [], None, 0
        for order in range(4):
            codes, weight = counts[order][k]
            shorter = contexts
            contexts = np.unique(codes // size) if order else np.zeros(1, np.int64)
            if order:
                up = tables[-1][np.searchsorted(shorter, contexts % size ** (order - 1))]
            else:
                up = np.full((1, size), 1 / 256)
                up[:, -1] = others / 256
            seen_here = np.zeros((len(contexts), size))
            seen_here[np.searchsorted(contexts, codes // size), codes % size] = weight
            n, d = seen_here.sum(1, keepdims=True), (seen_here > 0).sum(1, keepdims=True)
            rest = np.where(seen_here > 0, 0, up).sum(1, keepdims=True)
            escape = np.where(rest > 0, d / np.maximum(rest, 1e-300), 0)
            tables.append(np.where(n > 0, np.where(seen_here > 0, seen_here, escape * up) / np.maximum(n + d, 1), up))
            place = np.concatenate(places)[shorter_node[order]] if order else np.zeros(1, np.int64)
            place[np.searchsorted(nodes[order], contexts)] = (first + np.arange(len(contexts))) * size
            places.append(place)
            first += len(contexts)
        p = np.concatenate(tables)
        p[:, -1] /= others
        bits.append(-np.log2(np.maximum(p, 2.0**-60)).astype(np.float32).ravel())
        own.append(np.concatenate(places))
    return {"langs": names, "symbol": symbol, "size": size, "index": index, "own": own, "bits": bits}


def code_lengths(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each document under each language."""
    size, index, n_docs = model["size"], model["index"], len(offsets) - 1
    out = np.zeros((n_docs, len(model["langs"])))
    if not len(data):
        return out
    s = model["symbol"][data]
    code = np.zeros(len(s), np.int32)
    code[3:] = (s[:-3] * size + s[1:-2]) * size + s[2:-1]
    row = index[3][code]
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    row[starts] = index[0][0]
    at = starts[starts + 1 < ends] + 1
    row[at] = index[1][s[at - 1]]
    at = starts[starts + 2 < ends] + 2
    row[at] = index[2][s[at - 2] * size + s[at - 1]]
    filled = offsets[1:] > offsets[:-1]
    for k, (own, bits) in enumerate(zip(model["own"], model["bits"], strict=True)):
        out[filled, k] = np.add.reduceat(bits.take(own.take(row) + s), starts, dtype=np.float64)
    return out


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, posterior under equal priors, bits a byte) of each text; `und` and 0 without a letter or a model."""
    langs, score, per_byte = [], np.zeros(len(column)), np.zeros(len(column))
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    for i, j, data, offsets in common.chunks(column):
        letters = np.concatenate([[0], np.cumsum(ascii_letter[data])])
        letters = letters[offsets[1:]] - letters[offsets[:-1]]
        bits = code_lengths(model, data, offsets) if model["langs"] else np.zeros((j - i, 1))
        best = bits.argmin(1)
        low = bits.min(1)
        posterior = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
        for r in range(j - i):
            n = offsets[r + 1] - offsets[r]
            if not model["langs"] or not n or not (letters[r] or _has_letter(data[offsets[r] : offsets[r + 1]].tobytes())):
                langs.append("und")
                continue
            langs.append(model["langs"][best[r]])
            score[i + r], per_byte[i + r] = posterior[r], low[r] / n
    return langs, score, per_byte


def fit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Fits on about per_language rows of each language (rows with null text or language are left out).

    Rows are chosen by a hash of the id, so the same table gives the same model. One task receives about per_language
    texts of each language and fits; the driver receives the model.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    n = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not n:
        return {"langs": []}
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, per_language / v)) for k, v in n.items()], "l string, share double")
    pick = (F.xxhash64(F.coalesce("i", F.lit(""))).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))) < F.col("share")
    rows = rows.join(F.broadcast(shares), "l").where(pick).select("i", "t", "l")

    def train(batches):
        texts, langs = [], []
        for b in batches:
            texts += [t.encode() for t in b.column(1).to_pylist()]
            langs += b.column(2).to_pylist()
        if not texts:
            return
        model = fit(texts, langs)
        pieces = [("symbol", 0, model["symbol"])] + [(k, i, a) for k in ("index", "own", "bits") for i, a in enumerate(model[k])]
        pieces += [("size", 0, np.array([model["size"]], np.int64))] + [("langs", i, np.frombuffer(x.encode(), np.uint8)) for i, x in enumerate(model["langs"])]
        for k, i, a in pieces:
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i], pa.int32()), pa.array([str(a.dtype)]), pa.array([a.tobytes()], pa.binary())], ["k", "i", "kind", "value"])

    # one task fits on the bounded sample, so the driver holds the finished model alone
    got = rows.repartition(1).sortWithinPartitions("i", "l", "t").mapInArrow(train, "k string, i int, kind string, value binary").collect()
    if not got:
        return {"langs": []}
    parts: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["k"], r["i"])):
        parts.setdefault(r["k"], []).append(np.frombuffer(r["value"], r["kind"]))
    return {"langs": [a.tobytes().decode() for a in parts["langs"]], "symbol": parts["symbol"][0], "size": int(parts["size"][0][0]), "index": parts["index"], "own": parts["own"], "bits": parts["bits"]}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (0 to 1), bits_per_byte. Other columns of docs are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            langs, score, bits = predict(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], ["id", "lang_pred", "score", "bits_per_byte"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, bits_per_byte double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that never saw those held out.

    Null and empty texts and texts without a letter get `und` and score 0; a null doc_id counts as held out.
    """
    docs = common.table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(), F.lit(True))
    model = fit_table(docs.where(~out))
    return identify(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
