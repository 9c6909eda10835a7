"""Frequent patterns of quantile symbols in sliding windows of four.

A window of four of five symbols has at most 15 item sets and 15 subsequences, so all of them are made where the window
is and counted by one aggregate with a partial count: no levels, no joins of windows, and at most 31 (item sets) or 780
(sequences) counters a series. The miners differ in how long a pattern they report.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import dialect, query, run_sql
from ..sources.tables import OBS_DIFF

K, WINDOW, TOP = 5, 4, 12
#: Symbols 0 to 4 of the steps by quantile edges of each series, windows of 4 symbols as rows, and the least support.
_EDGES = ", ".join(f"@pct(dx, {i / K}) AS e{i}" for i in range(1, K))
_CODE = " + ".join(f"CASE WHEN dx >= e{i} THEN 1 ELSE 0 END" for i in range(1, K))
SYMBOLS = OBS_DIFF + f", e AS (SELECT series_id, {_EDGES} FROM d WHERE dx IS NOT NULL GROUP BY series_id HAVING count(dx) >= 5), sym AS (SELECT d.series_id, d.t, {_CODE} AS s FROM d JOIN e ON d.series_id = e.series_id WHERE dx IS NOT NULL), w AS (SELECT series_id, t, s AS s1, lead(s, 1) OVER v AS s2, lead(s, 2) OVER v AS s3, lead(s, 3) OVER v AS s4 FROM sym WINDOW v AS (PARTITION BY series_id ORDER BY t)), tx AS (SELECT * FROM w WHERE s4 IS NOT NULL)"
_SUPPORT = ", sup AS (SELECT series_id, greatest(2, floor(0.15 * count(*))) AS least_support FROM tx GROUP BY series_id)"


def windows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, s1 .. s4) of the given events."""
    return run_sql(spark, sf_dir, dialect(f"WITH {SYMBOLS} SELECT series_id, t, s1, s2, s3, s4 FROM tx", spark=True))


def _frequent(rows: DataFrame, patterns) -> DataFrame:
    """(series_id, size, pattern, support) of patterns in enough windows; a counter for all windows goes along as pattern null."""
    every = F.concat(F.array(F.lit(None).cast("string")), patterns)
    n = rows.select("series_id", F.explode(every).alias("pattern")).groupBy("series_id", "pattern").agg(F.count("*").alias("support"))
    # at most 781 rows a series are left here
    n = n.groupBy("series_id").agg(F.max(F.when(F.col("pattern").isNull(), F.col("support"))).alias("n"), F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct("pattern", "support"))).alias("x"))
    n = n.select("series_id", F.greatest(F.lit(2), F.floor(F.col("n") * 0.15)).alias("least"), F.explode("x").alias("x")).where("x.support >= least")
    return n.select("series_id", F.length("x.pattern").alias("size"), F.col("x.pattern").alias("pattern"), F.col("x.support").alias("support"))


def itemsets(rows: DataFrame, longest: int = WINDOW) -> DataFrame:
    """Frequent item sets of windows (series_id, s1 .. s4): patterns are ascending digits. Sets are bit masks, and subsets those within a mask."""
    mask = F.lit(0)
    for i in range(1, WINDOW + 1):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1, cast(s{i} AS int))"))
    sets = [m for m in range(1, 1 << K) if m.bit_count() <= longest]
    names = F.array(*[F.struct(F.lit(m).alias("m"), F.lit("".join(str(i) for i in range(K) if m >> i & 1)).alias("name")) for m in sets])
    rows = rows.select("series_id", mask.alias("mask"))
    return _frequent(rows, F.transform(F.filter(names, lambda x: x["m"].bitwiseAND(F.col("mask")) == x["m"]), lambda x: x["name"]))


def sequences(rows: DataFrame, longest: int = WINDOW) -> DataFrame:
    """Frequent subsequences of windows (series_id, s1 .. s4), gaps allowed, each once a window."""
    picks = [c for n in range(1, longest + 1) for c in combinations(range(1, WINDOW + 1), n)]
    digits = [F.col(f"s{i}").cast("string") for i in range(1, WINDOW + 1)]
    return _frequent(rows, F.array_distinct(F.array(*[F.concat(*[digits[i - 1] for i in c]) for c in picks])))


def summary(patterns: DataFrame) -> DataFrame:
    """(series_id, n_patterns, support, longest, top, confidence): the twelve of most support, of equal ones the shorter and lower."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("k"), "size", "pattern")))
    rows = patterns.groupBy("series_id").agg(F.count("*").alias("n_patterns"), F.max("support").alias("support"), F.max("size").alias("longest"), F.slice(order, 1, TOP).alias("top"))
    top = F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["pattern"], -x["k"])), " ")
    return rows.select("series_id", "n_patterns", "support", "longest", top.alias("top"), F.least(F.lit(0.9), F.size("top") / 15.0).alias("confidence"))


#: For DuckDB, from the definition: every candidate against every window.
_SETS = "VALUES " + ", ".join("('{}', {}, [{}])".format("".join(c), n, ", ".join(c)) for n in range(1, WINDOW + 1) for c in combinations("01234", n))
_WORDS = "VALUES " + ", ".join("('{}', {}, '%{}%')".format("".join(c), n, "%".join(c)) for n in range(1, WINDOW + 1) for c in product("01234", repeat=n))
_BY_SET = f"WITH {dialect(SYMBOLS + _SUPPORT, spark=False)}, c(pattern, size, items) AS ({_SETS}), p AS (SELECT tx.series_id, size, pattern, count(*) AS support FROM tx JOIN c ON list_has_all([s1, s2, s3, s4], items) JOIN sup ON tx.series_id = sup.series_id GROUP BY tx.series_id, size, pattern HAVING count(*) >= max(least_support))"
_BY_WORD = f"WITH {dialect(SYMBOLS + _SUPPORT, spark=False)}, c(pattern, size, shape) AS ({_WORDS}), p AS (SELECT tx.series_id, size, pattern, count(*) AS support FROM tx JOIN c ON concat(s1, s2, s3, s4) LIKE shape JOIN sup ON tx.series_id = sup.series_id GROUP BY tx.series_id, size, pattern HAVING count(*) >= max(least_support))"
_ALL = " SELECT series_id, size, pattern, support FROM p WHERE "
_TOP = ", r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY support DESC, size, pattern) AS k FROM p WHERE {}) SELECT series_id, count(*) AS n_patterns, max(support) AS support, max(size) AS longest, string_agg(pattern || ':' || support, ' ' ORDER BY k) FILTER (k <= 12) AS top, least(0.9, least(12, count(*)) / 15.0) AS confidence FROM r GROUP BY series_id"

#: (query, item sets or sequences, least and greatest size, doc); a summary if its name ends in _patterns.
MINERS = [
    ("frequent_items", itemsets, 1, 1, "Frequent symbols."),
    ("apriori_pairs", itemsets, 2, 2, "Item sets of two that stand in enough windows."),
    ("fpgrowth_triples", itemsets, 3, 3, "Item sets of three."),
    ("frequent_itemsets", itemsets, 1, 4, "Item sets of every size."),
    ("prefixspan_pairs", sequences, 2, 2, "Subsequences of two symbols, gaps allowed, by the windows that hold them."),
    ("spade_pairs", sequences, 2, 2, "The same."),
    ("gsp_triples", sequences, 3, 3, "Subsequences of three symbols."),
    ("frequent_sequences", sequences, 1, 4, "Subsequences of every length."),
    ("apriori_patterns", itemsets, 1, 4, "Item sets of up to four, level by level in effect: how many, the greatest support, the longest and the top twelve."),
    ("eclat_patterns", itemsets, 1, 3, "Item sets of up to three, as id lists are met to that depth: how many, the greatest support, the longest and the top twelve."),
    ("fpgrowth_patterns", itemsets, 1, 4, "Item sets of up to four: how many, the greatest support, the longest and the top twelve."),
    ("prefixspan_patterns", sequences, 1, 4, "Subsequences of up to four: how many, the greatest support, the longest and the top twelve."),
    ("gsp_patterns", sequences, 1, 4, "Subsequences of up to four: how many, the greatest support, the longest and the top twelve."),
    ("spade_patterns", sequences, 1, 4, "Subsequences of up to four: how many, the greatest support, the longest and the top twelve."),
]


def _register(name: str, mine, least: int, most: int, doc: str) -> None:
    short = name.endswith("_patterns")
    bounds = f"size BETWEEN {least} AND {most}"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = mine(windows_of(spark, sf_dir), most).where(F.col("size") >= least)
        return summary(found) if short else found

    f.__name__, f.__doc__ = name, doc
    base = _BY_SET if mine is itemsets else _BY_WORD
    query(base + (_TOP.format(bounds) if short else _ALL + bounds), name, layer="pattern")(f)


for _m in MINERS:
    _register(*_m)


@query(
    f"{_BY_WORD}, l AS (SELECT series_id, max_by(s2 || '' || s3 || s4, t) AS context FROM tx GROUP BY series_id), a AS (SELECT l.series_id, CAST(right(pattern, 1) AS INTEGER) AS f, support FROM l JOIN p ON p.series_id = l.series_id AND size = 4 AND left(pattern, 3) = context), m AS (SELECT series_id, s, count(*) AS n FROM sym GROUP BY series_id, s), b AS (SELECT series_id, min_by(f, -support * 10 + f) AS f, max(support) AS support FROM a GROUP BY series_id), o AS (SELECT series_id, min_by(s, -n * 10 + s) AS s FROM m GROUP BY series_id) SELECT l.series_id, coalesce(f, s) AS predicted_next, coalesce(support, 0) AS support FROM l LEFT JOIN b ON l.series_id = b.series_id JOIN o ON l.series_id = o.series_id",
    layer="pattern",
)
def predicted_next_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What most often extends the last three symbols in a frequent sequence of four, else the most frequent symbol; of equal ones the lowest."""
    rows = windows_of(spark, sf_dir)
    digits = [F.col(f"s{i}").cast("string") for i in range(1, WINDOW + 1)]
    last = rows.groupBy("series_id").agg(F.max_by(F.concat(*digits[1:]), "t").alias("context"))
    longer = sequences(rows).where("size = 4").select("series_id", F.substring("pattern", 1, 3).alias("context"), F.substring("pattern", 4, 1).cast("int").alias("f"), "support")
    longer = longer.join(last, ["series_id", "context"]).groupBy("series_id").agg(F.min_by("f", -F.col("support") * 10 + F.col("f")).alias("f"), F.max("support").alias("support"))
    # each symbol stands first in one window, but for the last three, which the last window holds
    steps = F.when(F.lead("t").over(Window.partitionBy("series_id").orderBy("t")).isNull(), F.array("s1", "s2", "s3", "s4")).otherwise(F.array("s1"))
    usual = rows.withColumn("steps", steps).select("series_id", F.explode("steps").alias("s")).groupBy("series_id", "s").agg(F.count("*").alias("n")).groupBy("series_id").agg(F.min_by("s", -F.col("n") * 10 + F.col("s")).alias("s"))
    return usual.join(longer, "series_id", "left").select("series_id", F.coalesce("f", "s").alias("predicted_next"), F.coalesce("support", F.lit(0)).alias("support"))

