"""Pieces that the operators of this subpackage share: tables, the shared folder, and numpy over Arrow texts."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes that separate words: space, and tab to carriage return.
SEPARATORS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_IS_WORD = np.ones(256, bool)
_IS_WORD[SEPARATORS] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


#: Rows of a batch that Python workers get at once, unless the session sets another number; the default of 10,000 can be
#: gigabytes of long texts.
BATCH_ROWS = "1000"


def bounded(spark: SparkSession) -> SparkSession:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; where that is unset, a temporary one in local mode alone."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tidegauge-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/tidegauge/{kind}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def eager_cleanup(spark: SparkSession) -> Iterator[None]:
    """A query that runs inside leaves no shuffle files behind. Else they stay until the driver happens to collect its garbage, which grows with the number of tasks and not with the size of the input."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def saved(df: DataFrame, kind: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, lost executors cost nothing, and shuffle files go at once. The files written go when the application ends."""
    bounded(df.sparkSession)
    path = shared_dir(df.sparkSession, kind)
    with eager_cleanup(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **more) -> DataFrame:
    """df's rows as one struct column `row`, beside the columns in more: no name of df meets one of an operator. `row.*` unpacks."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in more.items()])


def per_worker(key: tuple, make):
    """make()'s value, made once in each Python process; functions that travel by value have no lasting globals."""
    kept = sys.__dict__.setdefault("_tidegauge_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def begin(*kinds: str) -> None:
    """At the start of a task: lets go of what this Python process kept for other operators, and gives freed memory back."""
    kept = sys.__dict__.get("_tidegauge_kept", {})
    others = [k for k in kept if k[0] not in kinds]
    for k in others:
        del kept[k]
    if others or not kinds:
        trim()


def trim() -> None:
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc; memory then stays with the process
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about `limit` bytes; a longer text comes alone and whole."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make(size):
        base, inverse = np.full(size, _BASE, U), np.full(size, _INVERSE, U)
        base[0] = inverse[0] = 1
        return np.multiply.accumulate(base), np.multiply.accumulate(inverse)

    size = 1 << max(20, int(n).bit_length())
    if size > 1 << 20:
        return make(size)
    return per_worker(("powers", size), lambda: make(size))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word: runs of other bytes than SEPARATORS, never over a document's border."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z in lower case."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((_LOWER[data] if lower else data).astype(U) * power[: len(data)] + power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] ^ ((end - start).astype(U) << U(40)))


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of k words; a document of fewer words has the whole sequence as one, an empty one none."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    at = np.flatnonzero(np.arange(len(doc)) + k <= (first + count)[doc])
    out = np.full(len(at), U(k), U)
    for i in range(k):
        out = mix(out * U(0xD6E8FEB86659FD93) + hashes[at + i])
    few = np.flatnonzero((count > 0) & (count < k))
    if not len(few):
        return out, doc[at]
    short = count[few].astype(U)
    for i in range(k - 1):
        on = count[few] > i
        short[on] = mix(short[on] * U(0xD6E8FEB86659FD93) + hashes[first[few[on]] + i])
    hashes, docs = np.concatenate([out, short]), np.concatenate([doc[at], few])
    order = np.argsort(docs, kind="stable")
    return hashes[order], docs[order]


def in_groups(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted: (values, document, offsets of the documents)."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, doc, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int64)


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

