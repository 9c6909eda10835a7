"""Document fingerprints: one-permutation MinHash with optimal densification, packed.

Every word shingle is hashed once; the hash's high bits name one of BINS bins and
each bin keeps its smallest hash. An empty bin borrows from a full bin that a
second hash, of the bin's number and the attempt, finds the same way for every
document (optimal densification), so two documents agree in a bin with
probability of their Jaccard similarity. A fingerprint keeps BITS low bits a bin;
the chance agreement 2**-BITS is taken out of the estimate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, BINS, BITS = 5, 256, 4
_NONE = np.uint64(2**64 - 1)


def _densified(least: np.ndarray) -> np.ndarray:
    """Fills the empty bins of documents (rows) that have any full one."""
    bins = least.shape[1]
    empty = least == _NONE
    rows, cols = np.nonzero(empty & ~empty.all(1, keepdims=True))
    attempt = 0
    while len(rows):
        attempt += 1
        source = (common.mix(cols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = ~empty[rows, source]
        least[rows[ok], cols[ok]] = least[rows[ok], source[ok]]
        rows, cols = rows[~ok], cols[~ok]
    return least


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> list[str]:
    """Packed fingerprints as hexadecimal text, one of each document; empty for a document without words."""
    n = len(offsets) - 1
    start, end, doc = common.words(data, offsets)
    least = np.full(n * bins, _NONE)
    hashes, doc = common.shingles(common.word_hashes(data, start, end), doc, n, k)
    slot = doc * bins + (hashes >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    np.minimum.at(least, slot, hashes)
    least = _densified(least.reshape(n, bins))
    low = (common.mix(least) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits == 4:
        packed = low[:, ::2] << 4 | low[:, 1::2]
    else:
        packed = np.packbits((low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1, axis=None).reshape(n, -1)
    some = (least != _NONE).any(1)
    return [packed[i].tobytes().hex() if some[i] else "" for i in range(n)]


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; two empty ones are alike, an empty one is like no other."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    if bits == 4:
        d = x ^ y
        same = ((d >> 4 == 0).sum() + (d & 15 == 0).sum()) / (2 * len(d))
    else:
        same = (np.unpackbits(x ^ y).reshape(-1, bits).sum(1) == 0).mean()
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, j, data, offsets in common.chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fingerprints(data, offsets), pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


#: Rows in a run of neighbouring ids that one task reads in order.
RUN_ROWS = 20_000


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (run, ghost, id, text) such that in each run, by descending id, every row that is no ghost has its next document below it.

    The runs are ranges of ids. A run's highest row stands as a ghost at the end of the run above, and the highest of
    all at the end of the lowest, so texts move once and no window spans all rows. Null ids count as lowest. Ids are
    integers; others raise TypeError.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} is no integer")
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    n = ids.count()
    k = max(1, common.n_partitions(spark), n // RUN_ROWS)  # the driver holds a number a run
    ranges = ids.repartitionByRange(k, "i").groupBy(F.spark_partition_id().alias("p")).agg(F.max("i").alias("top"))
    tops = sorted({r["top"] if r["top"] is not None else -(2**63) for r in ranges.collect()}, reverse=True)
    if not tops:
        tops = [0]
    shown = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    # the run of an id is the first range whose top is not below it; tops are searched by halves
    spot = spark.sparkContext.broadcast(np.array(sorted(tops), np.int64))

    def run(batches):
        edges = spot.value
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(edges, keys, "left"), len(edges) - 1)
            top = np.flatnonzero(keys == edges[at])
            plain = pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.zeros(len(keys), bool)), *b.columns], ["run", "ghost", "key", "id", "text"])
            yield plain
            if len(top):
                above = (at[top] + 1) % len(edges)
                yield pa.RecordBatch.from_arrays([pa.array(above, pa.int64()), pa.array(np.ones(len(top), bool)), *[c.take(pa.array(top)) for c in b.columns]], ["run", "ghost", "key", "id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(shown.alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"run bigint, ghost boolean, key bigint, id {kind}, text string")


def edited(text: str, after: str) -> str:
    """text with its last half (rounded down) replaced by as many first characters of after, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    Equal ids are ordered by text, descending; a lone document is its own next. Null texts count as empty.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = neighbours(docs)
    parts = common.n_partitions(spark)
    # a ghost is the first of its own run: among rows of one key it must sort before none that comes later
    rows = rows.repartition(parts, "run").sortWithinPartitions(F.col("run"), F.col("ghost"), F.col("key").desc(), F.col("text").desc())

    def run(batches):
        held: list[tuple] = []  # (run, ghost, id, text) of the last row, whose next is still to come
        last_run = None
        done = False

        def out(rows):
            n = len(rows)
            texts = [r[1] for r in rows]
            new = [edited(r[1], r[2]) for r in rows]
            loose = [i for i in range(n) if i + 1 == n or rows[i + 1][1] is not rows[i][2]]  # the next row is no row of this batch
            both = pa.array(texts + new + [rows[i][2] for i in loose], pa.large_string())
            prints: list[str] = []
            for _, _, data, offsets in common.chunks(both):
                prints += fingerprints(data, offsets)
            own, changed, after = prints[:n], prints[n : 2 * n], prints[1:n] + [""]
            for i, p in zip(loose, prints[2 * n :], strict=True):
                after[i] = p
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array(own, pa.string()), pa.array(changed, pa.string()), pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64())], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            id_type = b.schema.field(3).type
            ready = []
            size = 0
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                for r, ghost, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if r != last_run:
                        last_run, done, held = r, False, []
                    if done:
                        continue  # of several ghosts the first is the next document
                    if held:
                        ready.append((held[0][0], held[0][1], text))
                        size += len(text)
                    if ghost:
                        done, held = True, []
                    else:
                        held = [(key, text)]
                if size > 1 << 19:
                    yield out(ready)
                    ready, size = [], 0
            if ready:
                yield out(ready)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


QUERIES = {"op6_fingerprints": op6_fingerprints}
ORACLE_SQL: dict[str, str] = {}
