"""Source divergence audit: how far the word shares of a language's sources are apart, term by term and pair by pair.

Plain relational: matches of a pattern are exploded and counted a group, groups are crossed with their language's kept
vocabulary (terms that a group lacks count zero), and the table is joined with itself on language and term. Shares and
divergences are whole numbers, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # ASCII letters and all beyond ASCII
SAME_TERM = r"[A-Za-z\x{80}-\x{10FFFF}]++"  # the same matches, said so that they are found in a quarter of the time
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS = 3
TOP_TERMS = 200
PARTS = 256  # parts that a language's vocabulary is dealt over


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), three digits a step: exact while total is below 9.2 * 10^15."""
    rest, out = count + 1, F.lit(0).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        out = out * 1000 + div(rest * 1000, total)
        rest = (rest * 1000) % total
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most 10^9 + 1. A pair's sum is at most (10^9 + 1) * (10^9 + V), in 64 bits for V to 8 * 10^9."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs with it) of all terms that occur; each row of docs is a document."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(SAME_TERM), 0)
    rows = _named(docs).withColumn("terms", F.sort_array(words)).drop("text")
    # of equal neighbours in sorted order, the first stands for the document
    marked = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (~F.get("terms", i - 1).eqNullSafe(t)).cast("long").alias("first")))
    return rows.select("lang", "source", F.inline(marked)).groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))


def _on_all_parts(groups: DataFrame) -> DataFrame:
    return groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def _part(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")


def dense_shares(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups (g, lang, source, v: terms kept), (g, lang, term, count, p of the group, q of the language) of every group and kept term)."""
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"docs": F.sum("docs").over(of_term), "all": F.sum("n").over(of_term)})
    counts = materialize(counts.where(F.col("docs") >= least_docs).drop("docs"), "terms")
    vocabulary = materialize(counts.groupBy("lang", "term").agg(F.first("all").alias("all")), "vocabulary")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("of_lang"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("of_group"))
    groups = _named(docs).select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = materialize(groups.withColumn("g", F.monotonically_increasing_id()), "groups")  # written, so that the numbers stay
    numbered = counts.join(groups.select("lang", "source", "g"), ["lang", "source"]).select("g", "term", "n")
    # each language's vocabulary beside each of its groups: in parts, as a few languages may hold all rows
    crossed = _on_all_parts(groups.where("v > 0")).hint("merge").join(vocabulary.withColumn("part", _part("term")), ["lang", "part"])
    filled = crossed.join(numbered, ["g", "term"], "left").withColumn("count", F.coalesce("n", F.lit(0).cast("long")))
    p = share(F.col("count"), F.coalesce("of_group", F.lit(0).cast("long")) + F.col("v"))
    q = share(F.col("all"), F.col("of_lang") + F.col("v"))
    return groups.select("g", "lang", "source", "v"), materialize(filled.select("g", "lang", "term", "count", p.alias("p"), q.alias("q")), "shares")


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Ranked divergences: lang, source, part ('pair' or 'term'), item, value, rank (from 1).

    Part 'pair' has every other source of the language with the sum over all kept terms, 0 where none is kept; part 'term'
    the `top` kept terms that the group has more of than its language. A kept term is in `least_docs` documents of its language.
    Null text, lang and source are ''. Each row is a document, so a repeated row counts again; doc_id is not read. Ties go to the item
    that is first in UTF-8. Extra columns are not read; an empty table gives no rows.
    """
    groups, shares = dense_shares(docs, least_docs)
    name = groups.select("g", "lang", "source")
    one, other = (shares.select("lang", "term", F.col("g").alias(g), F.col("p").alias(p)) for g, p in (("g", "p"), ("h", "q")))
    both = one.hint("merge").join(other, ["lang", "term"]).where("g < h")
    sums = both.groupBy("g", "h").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("there"), F.sum(divergence(F.col("q"), F.col("p"))).alias("back"))
    ways = F.array(F.struct("g", "h", F.col("there").alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value")))
    pairs = sums.select(F.inline(ways)).join(name, "g").join(name.select(F.col("g").alias("h"), F.col("source").alias("item")), "h").select("lang", "source", "item", "value")
    bare = groups.where("v is null").select("lang", "source")
    none = bare.withColumn("part", _part("source")).hint("merge").join(_on_all_parts(bare.withColumnRenamed("source", "item")), ["lang", "part"]).where("source <> item")
    pairs = pairs.unionByName(none.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    terms = shares.where("count > 0 and p > q").select("g", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    # a limit of the rank cuts each task's rows before they are shuffled
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    pairs, terms = pairs.withColumn("rank", rank("lang", "source")), terms.withColumn("rank", rank("g")).where(F.col("rank") <= top).join(name, "g")
    rows = [r.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, r in (("pair", pairs), ("term", terms))]
    return rows[0].unionByName(rows[1])


SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n) AS n, sum(1) AS docs FROM (SELECT lang, source, id, term, count(*) AS n FROM (SELECT lang, source, row_number() OVER () AS id, terms FROM d), unnest(terms) AS u(term) GROUP BY ALL) GROUP BY ALL),
v AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM v GROUP BY ALL),
k AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS of_lang FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT lang, source, sum(n) AS n FROM k GROUP BY ALL),
p AS (SELECT k.lang, k.source, k.term, k.n, 1 + 1000000000::HUGEINT * (k.n + 1) // (s.n + l.v) AS p, 1 + 1000000000::HUGEINT * (k.of_lang + 1) // (l.n + l.v) AS q
      FROM k JOIN s ON s.lang = k.lang AND s.source = k.source JOIN l ON l.lang = k.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term))
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
