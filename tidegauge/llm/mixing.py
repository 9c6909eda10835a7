"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id. Each gets a virtual
finish time, the source's tokens up to and with it divided by the source's target
weight; a second pass over the source continues its clock. The mix is all
documents in order of finish time, cut where the total budget is spent, so every
source is near its target at the cut, and at any earlier point in proportion.

Running sums never gather a source in one task: rows fall into buckets of a
source's shuffle order, of about BUCKET_ROWS rows at any size of the input; sums
of buckets give each bucket's offset, and windows run inside single buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of sources in code-point order, repeated, as in the contract.
WEIGHTS = (5, 2, 1)
EPOCHS = 2
BUCKET_ROWS = 4000
SEED = 20240607


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; 0 for null."""
    separator = "[\\x20\\x09-\\x0D]"
    at_edge = lambda c: F.when(c.rlike(separator), 1).otherwise(0)
    pieces = F.size(F.split(text, separator + "+", -1))
    return F.when(text.rlike("[^\\x20\\x09-\\x0D]"), pieces - at_edge(F.substring(text, 1, 1)) - at_edge(F.substring(text, -1, 1))).otherwise(0).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the budget by weight, capped at epochs times a source's size.

    Sources are in code-point order, null last. In order of cap by weight, the sources above some level are capped and
    the rest share what is left by weight; that is where resharing the excess again and again ends.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(epochs)).withColumn("budget", F.sum("source_size").over(everything) * share)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("budget") - F.col("full")) / F.col("rest"))
    # the first source whose cap reaches its level ends the capped ones; its level is the one that all the rest get
    cut = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("full").alias("full"), F.col("level").alias("level")))).over(everything)
    rows = rows.withColumn("cut", cut)
    target = F.when(F.col("cut").isNull() | (F.col("cap") / F.col("w") < F.col("cut.level")), F.col("cap")).otherwise(F.col("w") * F.col("cut.level"))
    return rows.select("source", "source_size", target.alias("target"))


def finish_times(sized: DataFrame, goal: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds source_size, target and done (the source's tokens up to and with the row, in shuffled order) to (doc_id, source, size, copy, ...)."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("copy").cast("string"))
    rows = sized.withColumn("h", F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long"))  # 40 bits
    part = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BUCKET_ROWS)).cast("long")
    counts = sized.groupBy("source").agg(F.count("*").alias("n_rows"))
    info = counts.join(goal, F.expr("source <=> source_"), "inner").select("source_", "n_rows", "source_size", "target")
    # one row per source: small beside the documents, but not bounded, so the join is left to the optimiser
    rows = rows.join(info, F.expr("source <=> source_"), "left").drop("source_").withColumn("bucket", (F.col("h") * part / F.lit(float(1 << 40))).cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    offsets = sums.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), (F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("offset"))
    rows = rows.join(offsets, F.expr("source <=> source_ AND bucket = bucket_"), "left").drop("source_", "bucket_")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", *[c for c in ("digest",) if c in sized.columns], "copy").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("done", F.sum("size").over(inside) + F.col("offset")).drop("h", "bucket", "offset", "n_rows")


#: Slices of virtual time in which the budget's end is looked for, again and again inside the slice that has it, until
#: that has at most EDGE_ROWS rows. Those are ordered in one task.
SLICES, SPAN, EDGE_ROWS = 8192, 4.0, 200_000


def mix(sized: DataFrame, share: float = 1.5, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, size, copy, source_size, target, epoch, finish) of every copy that the mix takes, not yet sorted.

    sized: (doc_id, source, size, copy, and more columns, which stay); rows that are equal but for copy have different
    ones. Copies with finish time up to 1 would be each source's target exactly but for documents' borders; the cut is
    where the sizes in order of finish time reach the total budget.
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, epochs).withColumnRenamed("source", "source_")
    rows = common.saved(finish_times(sized, goal, epochs), "finish").where("size > 0 AND target > 0")
    copies = rows.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)]))).withColumn("finish", (F.col("done") + F.col("epoch") * F.col("source_size")) / F.col("target"))
    copies = copies.where((F.col("done") - F.col("size") + F.col("epoch") * F.col("source_size")) < F.col("target")).drop("done")  # a source's first copy past its target comes last at the most
    budget = rows.select("source", "target").distinct().agg(F.floor(F.sum("target") + 1e-6)).first()[0]
    spent, low, step, here, below = 0, 0.0, SPAN / SLICES, F.lit(True), F.lit(False)
    while budget is not None:
        slice_ = F.least(F.greatest(F.floor((F.col("finish") - low) / step), F.lit(0)), F.lit(SLICES)).cast("long")  # the last one has all the rest
        sums = copies.where(here).groupBy(slice_.alias("k")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()  # at most SLICES + 1 rows
        for r in sorted(sums):
            if spent + r["s"] > budget:
                break
            spent += r["s"]
        else:
            return copies.where(here | below)
        below, here = below | here & (slice_ < r["k"]), here & (slice_ == r["k"])
        low, step = low + r["k"] * step, step / SLICES
        if r["n"] <= EDGE_ROWS or r["k"] == SLICES or step < 1e-12:
            break
    order = Window.orderBy("finish", "epoch", "doc_id", "size", *[c for c in ("digest",) if c in sized.columns], "copy").rowsBetween(Window.unboundedPreceding, 0)
    edge = copies.where(here).withColumn("run", F.sum("size").over(order) + spent).where(F.col("run") <= F.lit(budget)).drop("run")
    return copies.where(below).unionByName(edge)


def counted(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size, more, copies, copy) of docs: equal rows are numbered from 1 where they are made, so many of them are no one task's work."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *more)
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    return common.saved(rows, "sizes").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Documents without words are taken 0 times; null texts have none.

    A source without words has target 0. Rows with the same doc_id, source and size are different documents, each with a
    place of its own in the queue. Null ids and sources take part.
    """
    docs = counted(common.table(spark, sf_dir, "documents")).drop("copies")
    goal = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    rows = docs.join(goal.withColumnRenamed("source", "source_"), F.expr("source <=> source_"), "left").drop("source_")
    taken = mix(docs).groupBy("doc_id", "source", "size", "copy").agg(F.sum("size").alias("taken"))
    taken = taken.select(F.col("doc_id").alias("d_"), F.col("source").alias("s_"), F.col("size").alias("n_"), F.col("copy").alias("c_"), "taken")
    rows = rows.join(taken, F.expr("doc_id <=> d_ AND source <=> s_ AND size = n_ AND copy = c_"), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of docs: a document taken twice comes twice, in the order of the mix within its files.

    Rows equal in all columns are copies of one document, each with a place of its own in the queue; rows with the same
    id and other columns are different documents. Null ids and sources take part; documents without words are not taken.
    Columns may have any name, and types that can be hashed.
    """
    keys = {"i": F.col("doc_id"), "s": F.col("source"), "g": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    sized = counted(docs, keys["g"].alias("digest"))
    taken = mix(sized).select(F.col("doc_id").alias("i_"), F.col("source").alias("s_"), F.col("digest").alias("g_"), "copies", "epoch", "finish")
    same = [F.col("i").eqNullSafe(F.col("i_")), F.col("s").eqNullSafe(F.col("s_")), F.col("g") == F.col("g_")]
    held = common.packed(docs, **keys)
    out = held.join(taken.where("copies = 1"), same).select("row", "finish", "epoch", "i_")
    repeated = sized.where("copies > 1 AND copy = 1")
    if not repeated.isEmpty():  # one of the equal rows stands for all of them
        repeated = repeated.select(F.col("doc_id").alias("i_"), F.col("source").alias("s_"), F.col("digest").alias("g_"))
        one = held.join(repeated, same, "left_semi").dropDuplicates(["i", "s", "g"])
        out = out.union(one.join(taken.where("copies > 1"), same).select("row", "finish", "epoch", "i_"))
    return out.repartitionByRange(common.n_partitions(spark), "finish").sortWithinPartitions("finish", "epoch", "i_").select("row.*")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL = {
    "op5_mixing": f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
l AS (SELECT a.cap / a.w AS ratio, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(c.cap) FILTER (c.cap / c.w < a.cap / a.w), 0)) / sum(c.w) FILTER (c.cap / c.w >= a.cap / a.w) AS level FROM w a CROSS JOIN w c GROUP BY a.source, a.cap, a.w),
cut AS (SELECT min_by(level, ratio) AS level FROM l WHERE ratio >= level),
goal AS (SELECT source, source_size, CASE WHEN level IS NULL OR cap / w < level THEN cap ELSE w * level END AS target FROM w CROSS JOIN cut),
q AS (SELECT g.*, source_size, target, CAST(sum(size) OVER (PARTITION BY g.source ORDER BY CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), 1, 10) AS BIGINT), doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done FROM g JOIN goal ON g.source IS NOT DISTINCT FROM goal.source),
c AS (SELECT q.*, e, CAST(done + e * source_size AS DOUBLE) / target AS finish FROM q CROSS JOIN (VALUES (0), (1)) v(e) WHERE size > 0 AND target > 0 AND done - size + e * source_size < target),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, e, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS run FROM c),
t AS (SELECT doc_id, source, size, copy, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE run <= (SELECT floor(sum(target) + 1e-6) FROM goal WHERE source_size > 0) GROUP BY doc_id, source, size, copy)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(taken, 0) AS taken FROM q LEFT JOIN t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.size = t.size AND q.copy = t.copy"""
}
