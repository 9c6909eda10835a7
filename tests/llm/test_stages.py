"""Stages of the pipeline against brute force: repeated rows, null ids, columns of any name, and the order of the packed mix."""

import hashlib
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidegauge.llm import common, mixing, token_pack

from .test_queries import words


def queue(rows, share=1.5, epochs=2):
    """The mix of (doc_id, text, source) by the definition: a shuffle, a clock for each source, one order, one budget."""
    sized, seen = [], Counter()
    for i, t, s in rows:
        seen[i, t, s] += 1
        sized.append((i, t, s, len(words(t)), seen[i, t, s]))
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    size = {s: sum(r[3] for r in sized if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    budget, target, free = share * sum(size.values()), {}, set(sources)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > epochs * size[s]]
        target |= {s: float(epochs * size[s]) for s in over} if over else {s: weight[s] * level for s in free}
        free -= set(over) if over else free
    out = []
    for s in sources:
        own = [r for r in sized if r[2] == s]
        own.sort(key=lambda r: (int(hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}:{r[4]}".encode()).hexdigest()[:10], 16), r[3]))
        done = 0
        for e in range(epochs):
            for r in own:
                if r[3] and done < target[s]:
                    out.append(((done + r[3]) / target[s], e, r[0] is not None, r[0] or 0, r[3], r[:3]))
                done += r[3]
    out.sort(key=lambda x: x[:5])
    taken, spent = [], 0
    for *_, n, r in out:
        spent += n
        if spent > int(sum(target.values()) + 1e-6):
            break
        taken.append(r)
    return taken


def rows_of(rng):
    text = lambda n: " ".join(f"w{rng.integers(0, 99)}" for _ in range(n))
    rows = [(i, text(int(rng.integers(1, 40))), f"s{i % 4}" if i % 4 else None) for i in range(120)]
    rows += [rows[5]] * 3 + [rows[6]] + [(7, text(41), "s3"), (7, text(42), "s3"), (None, text(9), "s1"), (None, text(9), "s1"), (500, None, "s1"), (501, "", "s2"), (502, " \n", "s2")]
    null = (None, "the same row without an id, twice", "s2")
    return rows + [null, null]


def test_the_mix_is_the_queue(spark):
    rows = rows_of(np.random.default_rng(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("finish", "epoch", "d_", "size", "copies", "copy", "row", "digest", "i", "i_", "h", "target")})
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()]
    want = queue(rows)
    assert Counter(got) == Counter(want)
    total = sum(len(words(t)) for _, t, _ in rows)
    assert sum(len(words(t)) for _, t, _ in got) <= 1.5 * total
    clash = Counter(rows)
    assert all(n <= 2 * clash[r] for r, n in Counter(got).items())  # k equal rows come 2k times at the most


def test_slices_of_slices_give_the_same_mix(spark, monkeypatch):
    rows = rows_of(np.random.default_rng(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "EDGE_ROWS", 0)
    monkeypatch.setattr(mixing, "SLICES", 5)
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.stage(spark, docs, "").collect())
    assert got == Counter(queue(rows))


def test_the_packed_order_is_that_of_the_files(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(common.default_vocabulary())
    docs = spark.createDataFrame([(i * 7 % 40, f"text {i} of some words") for i in range(40)], "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    held = spark.read.parquet(str(tmp_path / "docs"))
    order = [r["doc_id"] for r in held.collect()]
    rows = sorted(token_pack.stage(spark, held, "").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == order
    text = {r["doc_id"]: r["text"] for r in held.collect()}
    for r in rows:
        ids = np.array(plain.encode(text[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_a_pipeline_of_nothing(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0


def test_saved_leaves_no_shuffle_files(spark):
    """What is written to the shared folder needs no shuffle files any more; they used to stay until the driver collected its garbage."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, was = shuffled(), spark.conf.get(key, None)
    rows = common.saved(spark.range(10_000).repartition(8, "id").groupBy((F.col("id") % 100).alias("k")).count(), "test")
    assert shuffled() <= old
    assert rows.count() == 100
    assert spark.conf.get(key, None) == was
