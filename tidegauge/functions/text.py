"""Text, hash and vector functions over documents: chunks, hashed bags of words, questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, sql_query
from ..sources.tables import table


def chunk_text(text: Column, size: int = 400, overlap: int = 60) -> Column:
    """Array of windows of words; the last one ends at the text's end and may be short."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((n - size) / F.lit(size - overlap)) * (size - overlap)).cast("int"), F.lit(size - overlap)))
    return F.when(n > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))).otherwise(F.array().cast("array<string>"))


@query(
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != '') AS w FROM documents), s AS (SELECT doc_id, w, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 400 THEN [0] ELSE generate_series(0, CAST(ceil((len(w) - 400) / 340.0) * 340 AS BIGINT), 340) END) AS s FROM w)
SELECT doc_id, s // 340 AS chunk, len(w[s + 1 : s + 400]) AS n_words, md5(array_to_string(w[s + 1 : s + 400], ' ')) AS digest FROM s""",
    layer="knowledge",
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 400 words with 60 in common, of whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("chunk", "c"))
    return docs.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size(F.split("c", " ")).cast("long").alias("n_words"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents), b AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 4)) AS INTEGER) % 64 AS b, count(*) AS n FROM t GROUP BY 1, 2)
SELECT doc_id, b, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""",
    layer="encoder",
)
def hashing_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of words hashed to 64 buckets, at length one; only buckets with words."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    b = w.groupBy("doc_id", (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 4), 16, 10).cast("int") % 64).alias("b")).agg(F.count("*").alias("n"))
    return b.select("doc_id", "b", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id"))), 6).alias("weight"))


sql_query("agent_chat_sessions", "WITH m AS (SELECT conv_id, count(*) AS n, max(turn) AS last_turn, min_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS title FROM conversations GROUP BY conv_id) SELECT conv_id, n, last_turn, substr(title, 1, 40) AS title FROM m ORDER BY n DESC, conv_id LIMIT 100", "The hundred longest sessions with the first thing the user said.", layer="service")
sql_query("agent_chat_history", "SELECT conv_id, turn, role, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations", "The turns of every session, numbered.", layer="service")
sql_query("knowledge_stats", "SELECT source, count(*) AS passages, count(DISTINCT md5(text)) AS different FROM documents GROUP BY source", "Passages by source.", layer="knowledge")
sql_query("consolidate_qa", "WITH q AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND length(b.text) >= 50), k AS (SELECT *, row_number() OVER (PARTITION BY md5(lower(question)) ORDER BY conv_id, turn) AS k FROM q) SELECT conv_id, turn, length(question) AS n_question, length(answer) AS n_answer FROM k WHERE k = 1", "Questions with long answers, each question once by its hash.", layer="knowledge")
sql_query("vector_store_upsert", "WITH a AS (SELECT doc_id % 100 AS id, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id DESC) AS k FROM documents) SELECT id, doc_id, n_chars FROM a WHERE k = 1", "Upsert by id: the latest row of each id stays.", layer="knowledge")
sql_query("filter_then_limit", "WITH s AS (SELECT doc_id, n_chars FROM documents WHERE source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 5) SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM s", "Top five of one source: the filter comes before the limit.", layer="knowledge")
sql_query("supervised_profile", "SELECT l.quality, l.toxic, d.lang, count(*) AS n, round(avg(d.n_chars), 4) AS mean_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality, l.toxic, d.lang", "Labels by language.", layer="knowledge")
