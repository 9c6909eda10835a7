"""Token ids in fixed-width bit packing.

A packed dataset is a table of blocks in the shared store, one shard for each
range of ids, blocks in order. A block holds whole documents, about BLOCK_IDS
ids: every id takes the vocabulary's minimum number of bits, little end first,
so id i of a block starts at bit i * bits, and numpy unpacks any slice of it
without reading the rest. A manifest gives each shard's first id, and with
block offsets and document ends in the rows that is random access by global id
position and by document.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import common

BLOCK_IDS = 1 << 16
#: Encoded pieces of text that a worker remembers at once.
REMEMBERED = 1_600_000
#: The same in the pipeline, where executors have run other stages before and hold more memory.
STAGE_REMEMBERED = 600_000
#: A run of these after a letter is a piece of its own to a byte-level pre-tokenizer (an apostrophe may begin an ending).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
REMEMBERED_MARKS = 10_000
#: Finds a character beyond the Latin letters, which are letters in every version of Unicode.
BEYOND = re.compile("[^\0-\u024f]").search


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (each below 2**bits, bits at most 32), bits bits each."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    out = []
    for i in range(0, len(ids), 1 << 17):  # a multiple of 8 ids ends on a byte
        part = ids[i : i + (1 << 17)]
        out.append(np.packbits((part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1 != 0, axis=None, bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, first: int = 0, n: int | None = None) -> np.ndarray:
    """Ids first to first + n of a payload; the bytes of no others are read. n is needed if the last byte is not full."""
    data = np.frombuffer(payload, np.uint8)
    if n is None:
        n = len(data) * 8 // bits - first
    if n <= 0:
        return np.zeros(0, np.uint32)
    if bits % 8 == 0:
        width = bits // 8
        out = np.zeros((n, 4), np.uint8)
        out[:, :width] = data[first * width : (first + n) * width].reshape(n, width)
        return out.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for i in range(0, n, 1 << 17):
        m = min(1 << 17, n - i)
        begin = (first + i) * bits
        raw = np.unpackbits(data[begin // 8 : -(-(begin + m * bits) // 8)], bitorder="little")[begin % 8 :][: m * bits]
        out[i : i + m] = raw.reshape(m, bits) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))
    return out


class Encoder:
    """Little-endian 32-bit ids of texts, by a vocabulary of the tokenizers library.

    For a byte-level vocabulary a text falls apart at each single space or line end between two other characters,
    as its pre-tokenizer always does there; pieces that come again are encoded once. Other texts and other kinds of
    vocabulary go through the library whole. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.falls_apart = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.known: dict[str, bytes] = {}

        # ids of tokens that begin with a space: in pieces joined by spaces, each begins a piece
        self.spaced = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.spaced[i] = token.startswith("\u0120")
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids if self.falls_apart else []
        self.falls_apart = self.falls_apart and len(self.line_end) == 1
        self.marks: dict[str, bytes] = {}
        # another for pieces of letters alone, which no pattern has to cut, and which come once: those seen are known here
        self.letters = self.tokenizer
        if self.falls_apart and hasattr(self.tokenizer.model, "_resize_cache"):
            self.letters = Tokenizer.from_file(path)
            self.letters.encode_special_tokens = True
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)])
            self.letters.model._resize_cache(0)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], by: str, tokenizer=None) -> list[bytes]:
        """Ids of each piece, a space before it included if by is one, from encoding all as one text."""
        if not pieces:
            return []
        text = by + by.join(pieces)
        ids = np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        if by == " ":
            start = np.flatnonzero(self.spaced[ids])
            end = np.append(start[1:], len(ids))
        else:
            start = np.flatnonzero(ids == self.line_end[0])
            end = np.append(start[1:], len(ids))
            start = start + 1
        if len(start) != len(pieces):
            return self.whole([by + p if by == " " else p for p in pieces])
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip((start * 4).tolist(), (end * 4).tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.falls_apart:
            return self.whole(texts)
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        get = known.get
        split, values, gaps, new, tails = [], [], [], {}, []
        for t in texts:
            pieces = ("\0" + t).replace("\n", " \n").split(" ")  # \0 marks the text's begin
            found = list(map(get, pieces)) if "\0" not in t else None  # one of its own: the library takes this text whole
            missing = [i for i, v in enumerate(found) if v is None] if found is not None and None in found else []
            for i in missing:
                p = pieces[i]
                rest = p[1:] if p[:1] in ("\0", "\n") else p
                if not rest or rest[0].isspace() or rest[-1].isspace():
                    found = None  # spaces in a row or at an end: the library takes this text whole
                    break
                if rest[-1] in MARKS:
                    start = p.rstrip(MARKS)
                    if start[-1:].isalpha():  # a run of marks after a letter has tokens of its own
                        tails.append((p, start))
                        p = start
                        if p in known:
                            continue
                new[p] = None
            split.append(pieces)
            values.append(found)
            gaps.append(missing)
        plain, letters, first = [], [], []
        for p in new:
            (letters if p.isalpha() else first if p[0] in "\0\n" else plain).append(p)
        if BEYOND("".join(letters)):  # letters here might be none to the library
            plain, letters = plain + letters, []
        new.update(zip(letters, self._joined(letters, " ", self.letters), strict=True))
        new.update(zip(plain, self._joined(plain, " "), strict=True))
        line_end = np.array(self.line_end, "<u4").tobytes()
        for p, ids in zip(first, self._joined([p[1:] for p in first], "\n"), strict=True):
            new[p] = ids if p[0] == "\0" else line_end + ids
        marks = self.marks
        for p, start in tails:
            run = p[len(start) :]
            if run not in marks:
                if len(marks) > REMEMBERED_MARKS:
                    marks.clear()
                marks[run] = self.whole([run])[0]
            new[p] = (known[start] if start in known else new[start]) + marks[run]
        out = []
        for t, pieces, found, missing in zip(texts, split, values, gaps, strict=True):
            if found is None:
                out.append(self.whole([t])[0])
                continue
            for i in missing:
                found[i] = new[pieces[i]]
            out.append(b"".join(found))
        known.update(new if max(map(len, new), default=0) < 40 else {p: ids for p, ids in new.items() if len(p) < 40})
        return out


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    return common.per_worker(("encoder", path, remembered), lambda: Encoder(path, remembered))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", order: list | None = None, remembered: int = REMEMBERED) -> int:
    """Writes docs' ids below path, in ascending order of id (null first; equal ids by text), and a manifest. Returns the bits of an id.

    order: other columns to sort by instead. A null text is an empty one; end_id is appended to each document.
    """
    spark = docs.sparkSession
    bits = bits_for(Encoder(vocabulary).vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    by = order or [F.col(id_col), F.col(text_col)]
    ranged = order or [F.col(id_col)]  # texts are no range keys: equal ids stay together and are sorted there

    def run(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        parts: list[bytes] = []
        ends: list[int] = []
        size = 0

        def row():
            payload = pack(np.frombuffer(b"".join(parts), "<u4"), bits)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([ends], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["shard", "block", "first", "n_ids", "ids", "ends", "payload"])

        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for b in batches:
            id_type = b.schema.field(0).type
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                for key, encoded in zip(part.column(0).to_pylist(), encoder(vocabulary, remembered)([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    encoded += end
                    parts.append(encoded)
                    ids.append(key)
                    size += len(encoded) // 4
                    ends.append(size)
                    if size >= BLOCK_IDS:
                        yield row()
                        first, block, size = first + size, block + 1, 0
                        ids, parts, ends = [], [], []
        if ids:
            yield row()

    sorted_docs = docs.repartitionByRange(common.n_partitions(spark), *ranged).sortWithinPartitions(*by).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = sorted_docs.mapInArrow(run, f"shard int, block int, first bigint, n_ids bigint, ids array<{kind}>, ends array<bigint>, payload binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    # one row a shard: as many as shuffle partitions, whatever the number of documents
    counts = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    start, rows = 0, []
    for r in counts:
        rows.append((r["shard"], start, bits))
        start += r["n"]
    spark.createDataFrame(rows, "shard int, start bigint, bits int").coalesce(1).write.parquet(f"{path}/manifest")
    return bits


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of a packed dataset: id, start (ids before it), n_tokens, ids_crc32 (of little-endian 32-bit ids)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    rows = blocks.join(F.broadcast(spark.read.parquet(f"{path}/manifest")), "shard").select("ids", "ends", (F.col("start") + F.col("first")).alias("start"), "n_ids", "bits", "payload")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, ends, start, n, bits, payload = (b.column(c)[k] for c in range(6))
                ends = np.array(ends.as_py(), np.int64)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                all_ids = unpack(payload.as_buffer(), bits.as_py(), 0, n.as_py()).astype("<u4")
                crc = [zlib.crc32(all_ids[i:j]) for i, j in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(begins + start.as_py()), pa.array(ends - begins), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def document_ids(spark: SparkSession, path: str, position: int, n: int) -> np.ndarray:
    """Random access: ids position to position + n of the whole dataset, from the blocks that hold them alone."""
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/manifest")), "shard").withColumn("at", F.col("start") + F.col("first"))
    got = blocks.where((F.col("at") < position + n) & (F.col("at") + F.col("n_ids") > position)).select("at", "n_ids", "bits", "payload").orderBy("at").collect()
    parts = [unpack(r["payload"], r["bits"], max(0, position - r["at"]), min(r["n_ids"], position + n - r["at"]) - max(0, position - r["at"])) for r in got]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and packs all documents, then reads the packed files back. An empty text is its end id alone."""
    path = common.shared_dir(spark, "packed")
    write(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path, common.default_vocabulary())
    return read(spark, path)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs docs in the order of their files and of the rows in them, as the stage before left them; a plain scan has that order."""
    path = common.shared_dir(spark, "packed")
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        order = [F.col("file"), F.col("row")]
    except AnalysisException:
        rows, order = docs.select("doc_id", "text"), None
    write(rows, path, common.default_vocabulary(), order=order, remembered=STAGE_REMEMBERED)
    return read(spark, path)


QUERIES = {"op3_token_packing": op3_token_packing}
ORACLE_SQL: dict[str, str] = {}
