"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions alone.

Words are runs of letters and digits in lower case; shingles are five words and
weigh by their rarity among the items. A window of an item's length is a near
copy if the weighted Jaccard similarity of the two multisets of shingles is at
least SIMILARITY.

1. Exact bound, whatever the item: the weight of a window's shingles that some
   item of that length has must reach SIMILARITY times the least total of those
   items. Documents, and then windows, below that are left out without loss.
2. Each window left and each item get a 64-bit SimHash. Cut in RADIUS + 1 blocks,
   two fingerprints within RADIUS bits agree in one block at least, so an equality
   join on (length, block, value) finds all pairs of window and item within RADIUS.
   These pairs are the candidates; there are no others.
3. Candidates are verified by the exact similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
#: Item shingles up to this number are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 500_000


def shingled(rows: DataFrame, keep: list[str], words: str = "w") -> DataFrame:
    """(keep, pos, s): the hash of each run of five words of the array column; fewer words are one shingle, none none."""
    # explode() would infer a filter on the array and so split each text twice
    at = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))))
    rows = rows.select(*keep, F.col(words).alias("_w"), F.explode_outer(at).alias("pos")).where(F.col("pos").isNotNull())
    return rows.select(*keep, "pos", F.xxhash64(*[F.get("_w", F.col("pos") + i) for i in range(SHINGLE)]).alias("s"))


def _words(docs: DataFrame, text_col: str, out: str = "w") -> DataFrame:
    """Adds the array of words: pieces between runs of other characters, without the empty first and last one."""
    docs = docs.withColumn("_p", F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]++", -1))
    skip = F.when(F.get("_p", F.lit(0)) == "", 1).otherwise(0)
    drop = F.when((F.size("_p") > 1) & (F.element_at("_p", -1) == ""), 1).otherwise(0)
    return docs.withColumn(out, F.when(skip + drop > 0, F.slice(F.col("_p"), skip + 1, F.greatest(F.size("_p") - skip - drop, F.lit(0)))).otherwise(F.col("_p"))).drop("_p")


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, n_words, s, count, weight) and (item, n_words, n_shingles, total and distinct_total weight) of items with words."""
    words = _words(items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), "text").withColumn("n_words", F.size("w"))
    grams = shingled(words, ["item", "n_words"]).groupBy("item", "n_words", "s").agg(F.count("*").alias("count"))
    grams = common.saved(grams, "grams")
    n = grams.select("item").distinct().count()
    rare = grams.groupBy("s").agg(F.count_distinct("item").alias("df")).select("s", (F.log(1 + F.lit(float(n)) / F.col("df")) / F.log(F.lit(1 + float(max(n, 1))))).alias("weight"))
    grams = common.saved(grams.join(rare, "s"), "weighted")
    totals = grams.groupBy("item", "n_words").agg(F.sum("count").alias("n_shingles"), F.sum(F.col("count") * F.col("weight")).alias("total"), F.sum("weight").alias("distinct_total"))
    return grams.select("item", "n_words", "s", "count", "weight"), common.saved(totals, "totals")


def simhash(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(keys, fingerprint, more aggregates) from rows (keys, s, weight, n): bit b is 1 if shingles with bit b, n times each, outweigh those without.

    Two counters of 32 bits share a long, so 32 sums make 64 bits; integer weights are 1 to 8.
    """
    mask = (1 << 32) + 1
    q = F.ceil(F.col("weight") * 8).cast("long") * F.col("n")
    sums = rows.groupBy(*keys).agg(F.sum(q).alias("_all"), *[F.sum(F.shiftrightunsigned("s", b).bitwiseAND(F.lit(mask)) * q).alias(f"_{b}") for b in range(32)], *more)
    out = F.lit(0).cast("long")
    for b in range(32):
        low = F.col(f"_{b}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("_all")
        high = F.shiftrightunsigned(f"_{b}", 32) * 2 > F.col("_all")
        out = out.bitwiseOR(F.when(low, F.lit(1 << b)).otherwise(F.lit(0)).cast("long")).bitwiseOR(F.when(high, F.shiftleft(F.lit(1).cast("long"), b + 32)).otherwise(F.lit(0)).cast("long"))
    return sums.select(*keys, out.alias("fingerprint"), *[c for c in sums.columns if c not in keys and not c.startswith("_")])


def blocks(fingerprint: Column) -> Column:
    """Array of (block, value): RADIUS + 1 runs of bits."""
    n = RADIUS + 1
    cut = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1)).alias("value")) for i in range(n)])


def short_items(words: DataFrame, grams: DataFrame, totals: DataFrame, key: list[str]) -> DataFrame | None:
    """(key, item, start, n_words) of items of fewer than SHINGLE words, by document windows of an item's own length; None without such items.

    Such an item is one shingle, so a window is equal to it (similarity 1, distance 0) or has nothing of it.
    """
    short = totals.where(F.col("n_words") < SHINGLE).select(F.col("item").alias("item_"), F.col("n_words").alias("k"))
    lengths = sorted(r["k"] for r in short.select("k").distinct().collect())
    if not lengths:
        return None
    items = grams.join(short, F.col("item").eqNullSafe(F.col("item_")) & (F.col("n_words") == F.col("k"))).select("item", "k", "s")
    found = None
    for k in lengths:
        at = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k))
        windows = words.select(*key, "w", F.explode_outer(at).alias("start")).where(F.col("start").isNotNull())
        windows = windows.select(*key, "start", F.xxhash64(*[F.get("w", F.col("start") + i) for i in range(k)]).alias("s"))
        hits = windows.join(F.broadcast(items.where(F.col("k") == k)) if items.count() <= BROADCAST_SHINGLES else items.where(F.col("k") == k), "s")
        hits = hits.groupBy(*key, "item").agg(F.min("start").alias("start"), F.first("k").alias("n_words"))
        found = hits if found is None else found.union(hits)
    return found


def _sums(hits: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, bound): the weight of the hits (keys, pos, weight) in each window of m shingles from start.

    Running sums over hits and window borders in one order; the difference of a window's two is its weight.
    """
    low = starts.select(*keys, F.col("start").alias("x"), F.lit(0).alias("turn"), F.lit(0.0).alias("weight"), "start", F.lit(-1.0).alias("sign"))
    high = starts.select(*keys, (F.col("start") + F.col("m") - 1).alias("x"), F.lit(2).alias("turn"), F.lit(0.0).alias("weight"), "start", F.lit(1.0).alias("sign"))
    rows = hits.select(*keys, F.col("pos").alias("x"), F.lit(1).alias("turn"), "weight", F.lit(None).cast("int").alias("start"), F.lit(0.0).alias("sign"))
    order = Window.partitionBy(*keys).orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.union(low).union(high).withColumn("sum", F.sum("weight").over(order)).where("start IS NOT NULL")
    return rows.groupBy(*keys, "start").agg(F.sum(F.col("sum") * F.col("sign")).alias("bound"))


#: A document's key: two hashes of its id and text, so that null and repeated ids need no care on the way.
KEY = ["k1", "k2"]
WINDOW = [*KEY, "m", "start"]


def keyed(docs: DataFrame) -> DataFrame:
    """Adds KEY to (id, text, ..)."""
    return docs.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(7), "id", "text")})


def candidate_windows(docs: DataFrame, grams: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows that some item of their length could match: (KEY, id) of their documents, and (WINDOW, fingerprint, own, bag).

    docs: (id, text, KEY). own is a window's weight; bag its shingles as (s, weight, n). Documents and windows move by
    KEY alone, a document once, as the array of its shingles.
    """
    rows = shingled(_words(docs, "text").select(*KEY, "w"), KEY)
    # with each shingle go the lengths of the items that have it: far fewer than items where a passage is in all of them
    lengths = totals.groupBy(F.col("n_shingles").alias("m")).agg(F.min("total").alias("least"), F.max(F.col("total") - F.col("distinct_total")).alias("slack"))
    known = grams.groupBy("s").agg(F.first("weight").alias("weight"), F.collect_set("m").alias("ms"))
    few = grams.select("s", "m").distinct().count() <= BROADCAST_SHINGLES
    sized = lambda df: F.broadcast(df) if few else df
    hits = rows.join(sized(known), "s").select(*KEY, "pos", "s", "weight", F.explode("ms").alias("m")).distinct()  # repeated rows are one document
    hits = common.saved(hits, "hits")
    # repeats can raise an item's total and not its distinct shingles, so the bound of a document uses distinct ones
    have = hits.select(*KEY, "m", "s", "weight").distinct().groupBy(*KEY, "m").agg(F.sum("weight").alias("have")).join(sized(lengths), "m")
    have = common.saved(have.where(F.col("have") >= SIMILARITY * F.col("least") - F.col("slack") - 1e-6).select(*KEY, "m", "least"), "pairs")
    own = _words(docs.join(have.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY), "text").where(F.size("w") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)))
    own = common.saved(own.select(*KEY, "id", F.transform(at, lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(SHINGLE)])).alias("ss")), "shingles")
    near = hits.join(have.join(own.select(*KEY, F.size("ss").alias("len")), KEY), [*KEY, "m"]).select(*KEY, "m", "pos", "weight", "least", "len")
    near = common.saved(near, "near")
    # A window that starts before its first shared shingle is no better than the one that starts at it: its intersection
    # is no larger, and what it has more of weighs 1, the most. So windows start at shared shingles.
    last = F.greatest(F.lit(0), F.col("len") - F.col("m")).cast("int")
    starts = near.select(*KEY, "m", "least", F.least("pos", last).alias("start")).distinct()
    windows = starts.join(_sums(near, starts, [*KEY, "m"]), WINDOW).where(F.col("bound") >= SIMILARITY * F.col("least") - 1e-6).select(*WINDOW)
    windows = common.saved(windows, "windows")
    # a merge join deals both sides by KEY, which the aggregates then need no more shuffle for
    full = windows.join(own.select(*KEY, "ss").hint("merge"), KEY).select(*WINDOW, F.explode(F.slice("ss", F.col("start") + 1, F.col("m").cast("int"))).alias("s"))
    full = full.join(sized(known.select("s", "weight")), "s", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    counts = full.groupBy(*WINDOW, "s").agg(F.first("weight").alias("weight"), F.count("*").alias("n"))
    prints = simhash(counts, WINDOW, F.sum(F.col("weight") * F.col("n")).alias("own"), F.collect_list(F.struct("s", "weight", "n")).alias("bag"))
    return own.select(*KEY, "id"), common.saved(prints, "prints")


def hamming_pairs(prints: DataFrame, grams: DataFrame) -> DataFrame:
    """(WINDOW, item, distance) of all windows and items of one length whose fingerprints are within RADIUS bits."""
    left = prints.select(*WINDOW, "fingerprint", F.explode(blocks(F.col("fingerprint"))).alias("b"))
    items = simhash(grams.withColumnRenamed("count", "n"), ["item", "m"])
    items = items.select("item", F.col("m").alias("m_"), F.col("fingerprint").alias("item_print"), F.explode(blocks(F.col("fingerprint"))).alias("c"))
    if grams.select("item").distinct().count() * (RADIUS + 1) <= BROADCAST_SHINGLES:
        items = F.broadcast(items)
    pairs = left.join(items, (F.col("m") == F.col("m_")) & (F.col("b.block") == F.col("c.block")) & (F.col("b.value") == F.col("c.value")))
    pairs = pairs.withColumn("distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))))
    return pairs.where(F.col("distance") <= RADIUS).select(*WINDOW, "item", "distance").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, start_word, n_words, similarity, distance): each row's best window for each item that it has a near copy of.

    The best window is the most similar of those that start at a shared shingle, of equal ones the first; start_word counts the document's words from 0. A
    document shorter than an item is one window. Items of fewer than five words are found word for word, also as
    passages. Items and documents without words match nothing. Ids may be null;
    rows with the same id are told apart by their texts, and equal rows give one result row.
    """
    grams, totals = item_shingles(items, item_id, item_text)
    sizes = totals.select(F.col("item").alias("item_"), F.col("n_words").alias("words_"), F.col("n_shingles").alias("m"))
    grams = common.saved(grams.join(sizes, F.col("item").eqNullSafe(F.col("item_")) & (F.col("n_words") == F.col("words_"))).select("item", "n_words", "s", "count", "weight", "m"), "sized")
    docs = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    long = grams.where(F.col("n_words") >= SHINGLE)
    few = long.count() <= BROADCAST_SHINGLES
    sized = lambda df: F.broadcast(df) if few else df
    ids, prints = candidate_windows(docs, long, totals.where(F.col("n_words") >= SHINGLE))
    pairs = common.saved(hamming_pairs(prints, long), "candidates")
    pairs = pairs.join(prints.select(*WINDOW, "own", "bag"), WINDOW)
    limit = long.select(F.col("item").alias("item_"), F.col("s").alias("s_"), F.col("count").alias("limit"))
    both = pairs.select(*WINDOW, "item", "distance", "own", F.explode("bag").alias("x"))
    both = both.join(sized(limit), F.col("item").eqNullSafe(F.col("item_")) & (F.col("x.s") == F.col("s_")))
    inter = both.groupBy(*WINDOW, "item", "distance", "own").agg(F.sum(F.col("x.weight") * F.least("x.n", "limit")).alias("inter"))
    found = inter.join(sized(totals.select(F.col("item").alias("item_"), "n_words", "total", F.col("n_shingles").alias("m_"))), F.col("item").eqNullSafe(F.col("item_")) & (F.col("m") == F.col("m_")))
    found = found.withColumn("similarity", F.col("inter") / (F.col("own") + F.col("total") - F.col("inter"))).where(F.col("similarity") >= SIMILARITY - 1e-12)
    best = found.groupBy(*KEY, "item").agg(F.min_by(F.struct("start", "n_words", "similarity", "distance"), F.struct(-F.round("similarity", 9), "start")).alias("x"))
    out = best.join(ids, KEY).select(F.col("id").alias(id_col), F.col("item").alias(item_id), F.col("x.start").alias("start_word"), F.col("x.n_words").alias("n_words"), F.round("x.similarity", 6).alias("similarity"), F.col("x.distance").alias("distance"))
    short = short_items(_words(docs, "text").select(*KEY, "id", "w"), grams, totals, [*KEY, "id"])
    if short is None:
        return out
    short = short.select(F.col("id").alias(id_col), F.col("item").alias(item_id), F.col("start").alias("start_word"), "n_words", F.lit(1.0).alias("similarity"), F.lit(0).alias("distance"))
    return out.union(short)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near copy of a benchmark item in a document: one row per document and item. Null texts have no words."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("distance")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a near copy of any benchmark item.

    Rows are judged by their own texts; all rows of an id that has a contaminated one go. Null ids are one id, null and
    empty texts stay, and so does everything if the benchmark is empty. Columns may have any name.
    """
    bad = contaminated(docs, common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("bad")).distinct()
    return common.packed(docs, id=F.col("doc_id")).join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti").select("row.*")


QUERIES = {"op10_decontamination": op10_decontamination}
#: The exact search over every window that starts at a shared shingle, without fingerprints.
ORACLE_SQL = {
    "op10_decontamination": r"""WITH i0 AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
i1 AS (SELECT item_id, len(w) AS n_words, w, unnest(generate_series(0, greatest(len(w) - 5, 0))) AS pos FROM i0 WHERE len(w) > 0),
ig AS (SELECT item_id, n_words, array_to_string(w[pos + 1 : pos + 5], ' ') AS s, count(*) AS c FROM i1 GROUP BY 1, 2, 3),
n AS (SELECT count(DISTINCT item_id) AS n FROM ig),
wt AS (SELECT s, ln(1 + n.n / count(DISTINCT item_id)) / ln(1 + n.n) AS weight FROM ig CROSS JOIN n GROUP BY s, n.n),
tot AS (SELECT item_id, n_words, CAST(sum(c) AS BIGINT) AS m, sum(c * weight) AS total FROM ig JOIN wt ON ig.s = wt.s GROUP BY item_id, n_words),
d0 AS (SELECT row_number() OVER () AS k, doc_id, w FROM (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents) q WHERE len(w) > 0),
d1 AS (SELECT k, doc_id, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n FROM d0),
d2 AS (SELECT *, lead(w0, 1) OVER v AS w1, lead(w0, 2) OVER v AS w2, lead(w0, 3) OVER v AS w3, lead(w0, 4) OVER v AS w4 FROM d1 WINDOW v AS (PARTITION BY k ORDER BY pos)),
ds AS (SELECT k, doc_id, pos, concat_ws(' ', w0, w1, w2, w3, w4) AS s, greatest(n - 4, 1) AS len FROM d2 WHERE pos <= greatest(n - 5, 0)),
st AS (SELECT DISTINCT ds.k, ds.doc_id, ig.item_id, ig.n_words, m, total, least(pos, greatest(0, len - m)) AS start FROM ds JOIN ig ON ds.s = ig.s JOIN tot ON ig.item_id IS NOT DISTINCT FROM tot.item_id AND ig.n_words = tot.n_words WHERE ig.n_words >= 5),
win AS (SELECT st.k, st.doc_id, st.item_id, st.n_words, total, start, ds.s, count(*) AS n FROM st JOIN ds ON st.k = ds.k AND ds.pos >= start AND ds.pos < start + m GROUP BY ALL),
sim AS (SELECT win.k, win.doc_id, win.item_id, win.n_words, start, total, sum(CASE WHEN ig.s IS NULL THEN 0 ELSE weight * least(n, c) END) AS inter, sum(n * coalesce(weight, 1)) AS own FROM win LEFT JOIN wt ON win.s = wt.s LEFT JOIN ig ON win.s = ig.s AND win.item_id IS NOT DISTINCT FROM ig.item_id AND win.n_words = ig.n_words GROUP BY ALL),
ok AS (SELECT *, inter / (own + total - inter) AS similarity FROM sim WHERE inter / (own + total - inter) >= 0.8 - 1e-12),
best AS (SELECT *, row_number() OVER (PARTITION BY k, item_id ORDER BY round(similarity, 9) DESC, start) AS r FROM ok),
sw AS (SELECT DISTINCT item_id, n_words, s FROM ig WHERE n_words < 5),
sd AS (SELECT k, doc_id, pos, 1 AS nw, w0 AS s FROM d2 UNION ALL SELECT k, doc_id, pos, 2, w0 || ' ' || w1 FROM d2 UNION ALL SELECT k, doc_id, pos, 3, w0 || ' ' || w1 || ' ' || w2 FROM d2 UNION ALL SELECT k, doc_id, pos, 4, w0 || ' ' || w1 || ' ' || w2 || ' ' || w3 FROM d2)
SELECT doc_id, item_id, start AS start_word, n_words, round(similarity, 6) AS similarity FROM best WHERE r = 1
UNION ALL SELECT doc_id, item_id, min(pos) AS start_word, n_words, CAST(1 AS DOUBLE) AS similarity FROM sd JOIN sw ON nw = n_words AND sd.s = sw.s GROUP BY k, doc_id, item_id, n_words"""
}
