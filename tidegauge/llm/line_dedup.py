"""Line deduplication over overlapping windows of three lines.

Every run of three consecutive lines is hashed. A window that occurs again, in
the same document or in another, is kept where it stands first (by id, then
text, then position) and its later occurrences cover their lines; covered
positions of all windows merge, and those lines go. Texts of fewer lines have no
window and stay, and so do windows of three blank lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LINES = 3
#: Covered documents and lines up to which they are broadcast (some 100 bytes and 4 bytes each); more are shuffled.
BROADCAST_DOCUMENTS, BROADCAST_LINES = 300_000, 4_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """(id, digest, pos, k1, k2): two independent 64-bit hashes of each window. docs: (id, text)."""
    rows = docs.select("id", F.xxhash64("text").alias("digest"), lines_of(F.col("text")).alias("l"))
    at = F.when(F.size("l") >= LINES, F.sequence(F.lit(0), F.size("l") - LINES))
    rows = rows.select("id", "digest", "l", F.explode_outer(at).alias("pos")).where(F.col("pos").isNotNull())
    three = [F.get("l", F.col("pos") + i) for i in range(LINES)]
    blank = F.lit(True)
    for x in three:
        blank = blank & (F.trim(x) == "")
    return rows.where(~blank).select("id", "digest", "pos", F.xxhash64(F.lit(1), *three).alias("k1"), F.xxhash64(F.lit(2), *three).alias("k2"))


def later_windows(docs: DataFrame) -> DataFrame:
    """(id, digest, covered): the lines of each document that later occurrences cover, as an array of positions.

    First occurrences come from a partial aggregate, so a window of a third of all documents is one row a task; the
    join that brings them back can be split where it is skewed.
    """
    w = windows(docs)
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("digest").alias("digest"), F.col("pos").alias("pos"))
    first = w.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("k1", "k2", "first")
    later = w.join(first, ["k1", "k2"]).where(~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.digest") == F.col("digest")) & (F.col("first.pos") == F.col("pos"))))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + LINES - 1))))
    return later.groupBy("id", "digest").agg(covered.alias("covered"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, clean_text, n_lines, n_removed. A null text is an empty one.

    Rows with the same id and text are one document: none of them is a later occurrence of the other.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cover = common.saved(later_windows(docs), "covered").withColumnsRenamed({"id": "id_", "digest": "digest_"})
    size = cover.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("covered")), F.lit(0)).alias("lines")).first()
    if size["n"] <= BROADCAST_DOCUMENTS and size["lines"] <= BROADCAST_LINES:
        cover = F.broadcast(cover)
    rows = docs.join(cover, F.col("id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("digest_")), "left")
    rows = rows.withColumn("l", lines_of(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("covered"))
    clean = F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("l", i)), "\n"))
    return rows.select(F.col("id").alias(id_col), clean.alias("clean_text"), F.size("l").cast("long").alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, as its length and digest."""
    out = dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"), F.length("clean_text").cast("long").alias("n_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE_SQL = {
    "op2_line_dedup": """WITH all_rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM (SELECT DISTINCT doc_id, text FROM all_rows)),
p AS (SELECT doc_id, text, l, unnest(generate_series(0, len(l) - 3)) AS pos FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, text, pos, l[pos + 1] AS a, l[pos + 2] AS b, l[pos + 3] AS c FROM p),
k AS (SELECT doc_id, text, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, pos) AS k FROM w WHERE trim(a) != '' OR trim(b) != '' OR trim(c) != ''),
g AS (SELECT DISTINCT doc_id, text, pos + i AS line FROM k CROSS JOIN (VALUES (0), (1), (2)) v(i) WHERE k.k > 1),
x AS (SELECT doc_id, text, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos, len(l) AS n FROM d),
r AS (SELECT x.doc_id, x.text, x.n, x.pos, x.line, g.line IS NOT NULL AS gone FROM x LEFT JOIN g ON x.doc_id IS NOT DISTINCT FROM g.doc_id AND x.text = g.text AND x.pos = g.line),
t AS (SELECT doc_id, text, max(n) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean FROM r GROUP BY doc_id, text)
SELECT t.doc_id, n_lines, n_removed, length(clean) AS n_chars, sha256(clean) AS clean_sha256 FROM all_rows a JOIN t ON a.doc_id IS NOT DISTINCT FROM t.doc_id AND a.text = t.text"""
}
