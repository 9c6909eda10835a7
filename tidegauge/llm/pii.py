"""Information-theoretic sanitisation of personal data, in DataFrame functions alone.

Direct identifiers (email, ip, card, phone) are found by patterns. They are the
protected entities. A term discloses an entity e that stands in the same documents as far as
the two share information: PMI(t; e) = log2(N * df(t, e) / (df(t) * df(e))) out of
the entity's own information IC(e) = log2(N / df(e)), with document counts over
the whole corpus. Terms with PMI / IC of at least DISCLOSURE, seen with the
entity in at least SUPPORT documents, become spans too. sanitise() generalises
identifiers to their kind and removes disclosing terms.

Patterns are those of the contract with possessive loops, and with starts only
where a run of their first characters starts or the last match ended: leftmost
matches are the same, and no text makes them slow or deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
SUPPORT, DISCLOSURE = 2, 0.9
#: Terms to be counted are broadcast up to this many; more are joined by a shuffle.
BROADCAST_TERMS = 100_000
BLOCK = 64
#: A noncharacter that stands for identifiers while terms are counted.
BLANK = "\uffff"


def _possible(text: Column, kind: str) -> Column:
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?+[0-9]){11}"), "phone": text.contains("+")}[kind]


def _valid(m: Column, kind: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15)


def located(df: DataFrame, text: str, patterns: dict[str, tuple[str, object, object]]) -> DataFrame:
    """Adds an array column for each name in patterns (pattern, whether text can match, which matches count).

    Entries are structs (start, end, value), in code points, end exclusive. Positions come from the lengths of matches
    and of the pieces between them, summed in blocks of BLOCK, so long lists stay well below quadratic time.
    """
    t = F.col(text)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def found(name):
        pattern, possible, _ = patterns[name]
        can = possible(t)
        return {f"{name}_m": F.when(can, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), f"{name}_p": F.when(can, F.split(t, pattern, -1))}

    def steps(name):
        m, p, valid = F.col(f"{name}_m"), F.col(f"{name}_p"), patterns[name][2]
        some = F.coalesce(F.size(m), F.lit(0)) > 0
        step = F.transform(m, lambda _, i: F.length(F.get(p, i)) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0)))
        return {f"{name}_s": F.when(some, step), f"{name}_i": F.when(some, F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: valid(F.get(m, i))))}

    def blocks(name):
        s = F.col(f"{name}_s")
        last = F.floor((F.size(s) - 1) / BLOCK).cast("int")
        return {f"{name}_b": F.when(F.size(f"{name}_i") > 0, F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(s, b * BLOCK + 1, BLOCK))))}

    def spans(name):
        m, s, b = F.col(f"{name}_m"), F.col(f"{name}_s"), F.col(f"{name}_b")

        def span(i):
            block = F.floor(i / BLOCK).cast("int")
            start = total(F.slice(b, 1, block)) + total(F.slice(s, block * BLOCK + 1, i - block * BLOCK + 1))
            return F.struct(start.alias("start"), (start + F.length(F.get(m, i))).alias("end"), F.get(m, i).alias("value"))

        none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
        return {name: F.coalesce(F.transform(F.when(F.size(f"{name}_i") > 0, F.col(f"{name}_i")), span), none)}

    for step in (found, steps, blocks, spans):  # each reads columns of the one before, so nothing is computed twice
        df = df.withColumns({k: v for name in patterns for k, v in step(name).items()})
    return df.drop(*[f"{n}_{x}" for n in patterns for x in "mpsib"])


def _tagged(spans: Column, i: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("k"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds spans: array of (start, k, kind, end, value) of direct identifiers, by start and then kind. Null texts have none."""
    df = located(docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit(""))), "_t", {f"_{k}": (PATTERNS[k], lambda t, k=k: _possible(t, k), lambda m, k=k: _valid(m, k)) for k in KINDS})
    parts = [_tagged(F.col(f"_{k}"), i, k) for i, k in enumerate(KINDS)]
    return df.withColumn("spans", F.array_sort(F.concat(*parts))).drop("_t", *[f"_{k}" for k in KINDS])


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(F.regexp_replace(s["value"], "[^0-9]", "")))


def _blanked(text: Column, spans: Column) -> Column:
    """The text without identifiers and without terms that overlap one."""
    plain = F.translate(text, BLANK, " ")
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.when(s["start"] > a["at"], F.substring(plain, a["at"] + 1, s["start"] - a["at"])).otherwise(""), F.lit(BLANK)).alias("out")),
    )
    return F.regexp_replace(F.concat(done["out"], F.substring(plain, done["at"] + 1, F.length(text))), rf"\p{{L}}*+{BLANK}\p{{L}}*+", " ")


def _held(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(key, keep, term): each term of each text once, in lower case."""
    terms = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), lambda x: F.lower(x)))
    return rows.select("key", *keep, F.explode_outer(terms).alias("term")).where(F.col("term").isNotNull())  # plain explode() would infer a filter and compute all terms once more


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """One row per row of docs: id, spans (direct identifiers), all_spans (with disclosing terms, kind `term`).

    A term and an entity are seen together in every document that has both, however far apart. A disclosing term is a
    span wherever it stands, in documents without the entity too, except inside identifiers. Ids may be null or repeat.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows of one key have the same text, and so the same terms
    texts = texts.withColumn("key", F.unhex(F.md5(F.concat(F.md5(F.col("text").cast("binary")), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))))
    rows = base_spans(texts).select("key", "id", "spans", F.array_distinct(F.transform("spans", _entity)).alias("entities"))
    rows = common.saved(rows, "pii")
    alone = rows.select(F.col("id").alias(id_col), "spans", F.col("spans").alias("all_spans"))
    n = rows.count()
    mentions = rows.where("size(entities) > 0").select("key", F.explode("entities").alias("entity"))
    # PMI / IC >= disclosure needs df_t <= both * (n / df_e) ^ (1 - disclosure), and both is at most df_e: terms in more documents are left out without loss
    most = F.col("df_e") * F.pow(F.lit(float(n)) / F.col("df_e"), F.lit(1 - disclosure)) * (1 + 1e-9)
    entities = mentions.groupBy("entity").agg(F.count("*").alias("df_e")).where((F.col("df_e") >= support) & (F.col("df_e") < n)).withColumn("most", most)
    entities = common.saved(entities, "entities")
    greatest = entities.agg(F.max("most")).first()[0]
    if greatest is None:
        return alone
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_TERMS else df
    counted = _held(texts, F.col("text")).groupBy("term").agg(F.count("*").alias("df_t")).where((F.col("df_t") >= support) & (F.col("df_t") <= greatest))
    counted = few(common.saved(counted, "counted"))
    reached = mentions.join(entities, "entity")
    rest = base_spans(texts).select("key", F.when(F.size("spans") > 0, _blanked(F.col("text"), F.col("spans"))).alias("rest"))  # found again: writing texts takes much memory
    seen = _held(rest, F.col("rest")).join(counted, "term").select("key", "term", "df_t").distinct()
    pairs = seen.join(reached, "key").where(F.col("df_t") <= F.col("most"))
    pairs = pairs.groupBy("entity", "term", "df_e", "df_t").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    ic = F.log2(F.lit(float(n)) / F.col("df_e"))
    own_share = 1 - F.log2(F.col("df_t") / F.col("both")) / ic
    flagged = common.saved(pairs.where(own_share >= disclosure).select("term").distinct(), "flagged")
    if flagged.isEmpty():
        return alone
    wanted = few(flagged)
    if wanted is flagged:
        holders = _held(texts, F.col("text")).join(wanted, "term", "left_semi").groupBy("key").agg(F.collect_set("term").alias("held"))
        hits = texts.select("key", "text").join(common.saved(holders, "holders"), "key")
    else:  # places are found where the texts are read, one term at a time, so that no text is shuffled
        hits = _held(texts, F.col("text"), "text").join(wanted, "term", "left_semi").withColumn("held", F.array("term"))
    hits = located(hits, "text", {"terms": (TERM, lambda t: F.lit(True), lambda m: F.array_contains("held", F.lower(m)))})
    hits = hits.select("key", F.explode_outer("terms").alias("x")).select("key", "x.start", "x.end").where(F.col("start") >= 0)
    extra = common.saved(hits.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("terms")), "terms")
    outside = F.filter("terms", lambda x: ~F.exists("spans", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])))
    outside = F.transform(outside, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("k"), F.lit("term").alias("kind"), x["end"].alias("end"), F.lit("").alias("value")))
    both = F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", outside)))
    return rows.select("key", "id", "spans").join(extra, "key", "left").select(F.col("id").alias(id_col), "spans", both.alias("all_spans"))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with identifiers generalised to [KIND] and disclosing terms removed to [TERM]; of overlapping spans the first counts."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))),
    )
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document. Null texts count as empty; equal positions are ordered as kinds are listed."""
    found = find(common.table(spark, sf_dir, "documents"))
    number = [_of_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *number, F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"))


QUERIES = {"op4_pii": op4_pii}
_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "term": r"\p{L}{3,}"}
_MATCHES = " UNION ALL ".join(f"SELECT rid, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM d" for k, (kind, pattern) in enumerate(_PLAIN.items()))
#: The same by plain patterns, with a row for each match.
ORACLE_SQL = {
    "op4_pii": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({_MATCHES}),
b AS (SELECT rid, k, kind, unnest(p) AS piece, unnest(m) AS v, generate_subscripts(p, 1) AS i FROM a WHERE len(m) > 0),
c AS (SELECT rid, k, kind, v, regexp_replace(v, '[^0-9]', '', 'g') AS digits, CAST(sum(length(piece) + coalesce(length(v), 0)) OVER (PARTITION BY rid, k ORDER BY i) AS BIGINT) - length(v) AS start FROM b),
e AS (SELECT *, start + length(v) AS stop FROM c WHERE v IS NOT NULL AND CASE kind WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr(digits, CAST(length(digits) - j + 1 AS BIGINT), 1) AS INTEGER) ELSE (2 * CAST(substr(digits, CAST(length(digits) - j + 1 AS BIGINT), 1) AS INTEGER)) // 10 + (2 * CAST(substr(digits, CAST(length(digits) - j + 1 AS BIGINT), 1) AS INTEGER)) % 10 END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
base AS (SELECT * FROM e WHERE kind != 'term'),
term AS (SELECT rid, lower(v) AS t, start, stop FROM e WHERE kind = 'term'),
ent AS (SELECT DISTINCT rid, kind || ':' || CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE digits END AS entity FROM base),
n AS (SELECT count(*) AS n FROM d),
dfe AS (SELECT entity, count(*) AS df_e FROM ent GROUP BY entity HAVING count(*) >= {SUPPORT} AND count(*) < (SELECT n FROM n)),
dft AS (SELECT t, count(DISTINCT rid) AS df_t FROM term GROUP BY t HAVING count(DISTINCT rid) >= {SUPPORT}),
rest AS (SELECT DISTINCT t.rid, t.t FROM term t WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = t.rid AND x.start <= t.stop AND x.stop >= t.start)),
pairs AS (SELECT ent.entity, rest.t, df_e, df_t, count(*) AS both_ FROM rest JOIN dft ON rest.t = dft.t JOIN ent ON rest.rid = ent.rid JOIN dfe ON ent.entity = dfe.entity GROUP BY ent.entity, rest.t, df_e, df_t HAVING count(*) >= {SUPPORT}),
flagged AS (SELECT DISTINCT t FROM pairs CROSS JOIN n WHERE 1 - log2(df_t / both_) / log2(n / df_e) >= {DISCLOSURE}),
extra AS (SELECT t.rid, 4 AS k, 'term' AS kind, t.start, t.stop FROM term t JOIN flagged f ON t.t = f.t WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = t.rid AND x.start < t.stop AND x.stop > t.start)),
spans AS (SELECT rid, k, kind, start, stop FROM base UNION ALL SELECT * FROM extra),
g AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 4) AS base_, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS all_ FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base_, '')) AS base_sha256, coalesce(all_, '') AS spans FROM d LEFT JOIN g ON d.rid = g.rid"""
}
