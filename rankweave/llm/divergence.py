"""How far the sources of a language differ in the words they use: plain relational counts, in built-in functions only.

Terms are the letter runs of a text, A-Z lower-cased. A language keeps the terms of at least `least` of its documents
(rows). Counts per (language, source, term) are crossed with the kept vocabulary of the language, so that a term that a
source lacks counts zero there, and become smoothed shares of one in a milliard, exact in whole numbers. The dense relation
is joined with itself on language and term; the part of every pair of sources is summed in the task that made it,
so no pair of a term is shuffled. Terms that a source overuses against its language are ranked by a window.

Cases: null text, lang and source are empty ones; repeated rows are documents of their own; a language without kept
terms gives pairs of value 0; ties go by the item's UTF-8 bytes; an empty table gives an empty result. Only the columns
named are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, beside, durable, stored

BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what no term holds
SCALE, LEAST, TOP = 1_000_000_000, 3, 200
SAFE = (1 << 63) // SCALE - 1  # counts whose product with SCALE is a long


def named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def matches(text: Column) -> Column:
    """The terms of a text, and empty strings where it begins or ends between terms; Spark splits many times faster than it extracts."""
    return F.split(F.translate(text, UPPER, LOWER), BREAK)


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, tf, df): occurrences, and documents that hold the term.

    Each document lists its terms twice, all of them and each once, so that one aggregation adds both up before its shuffle.
    """
    rows = docs.select(named(lang).alias("lang"), named(source).alias("source"), matches(named(text)).alias("w"))
    lists = F.array(F.struct(F.lit(1).cast("long").alias("every"), F.col("w").alias("w")), F.struct(F.lit(0).cast("long").alias("every"), F.array_distinct("w").alias("w")))
    terms = rows.select("lang", "source", F.explode(lists).alias("l")).select("lang", "source", "l.every", F.explode("l.w").alias("term"))
    return terms.where("term <> ''").groupBy("lang", "source", "term").agg(F.sum("every").alias("tf"), F.sum(1 - F.col("every")).alias("df"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact: in longs where they hold the product, else in decimals."""
    up, down = count + 1, total + terms
    wide = F.lit(SCALE).cast("decimal(18,0)") * up.cast("decimal(19,0)")
    div = lambda a, b: F.call_function("div", a, b)
    return 1 + F.when(up < SAFE, div(up * SCALE, down)).otherwise(div(wide, down.cast("decimal(19,0)")))


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def vocabulary(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, tf, held): each kept term with its count in the language and its sources' counts; a source occurs once in `held`."""
    one = counts.groupBy("lang", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "tf")).alias("held"))
    return one.where(F.col("df") >= least).drop("df")


def group_sizes(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, g, n, lang_n, terms) of every group of the table: a number for it, the kept counts of group and language, and kept terms."""
    groups = docs.select(named(lang).alias("lang"), named(source).alias("source")).distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("tf").alias("lang_n"))
    own = kept.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("tf").alias("n"))
    sized = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    numbered = sized.select("lang", "source", F.monotonically_increasing_id().alias("g"), zero("n"), zero("lang_n"), zero("terms"))
    return durable(numbered)


def dense_shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(h, lang, term, g, p): the share of every kept term in every group of its language, in which it may be missing."""
    spread = kept.select(F.xxhash64("lang", "term").alias("h"), "lang", "term", "held").repartition("h", "lang", "term")
    count = F.coalesce(F.element_at(F.map_from_entries("held"), F.col("source")), F.lit(0).cast("long"))
    dense = beside(spread, groups, ["lang"], "h").select("h", "lang", "term", "g", "n", "terms", count.alias("tf"))
    return dense.select("h", "lang", "term", "g", share(F.col("tf"), F.col("n"), F.col("terms")).alias("p"))


def source_pairs(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    keys = ["h", "lang", "term"]
    both = dense.join(dense.select(*keys, F.col("g").alias("g2"), F.col("p").alias("p2")), keys).where(F.col("g") < F.col("g2"))
    sums = both.groupBy("g", "g2").agg(F.sum(excess(F.col("p"), F.col("p2"))).alias("there"), F.sum(excess(F.col("p2"), F.col("p"))).alias("back"))
    ways = F.inline(F.array(F.struct(F.col("g").alias("a"), F.col("g2").alias("b"), F.col("there").alias("v")), F.struct(F.col("g2").alias("a"), F.col("g").alias("b"), F.col("back").alias("v"))))
    one, other = groups.select("lang", "source", F.col("g").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"))
    pairs = one.join(other, "lang").where(F.col("a") != F.col("b")).join(sums.select(ways), ["a", "b"], "left")
    return pairs.select("lang", "source", "item", F.coalesce("v", F.lit(0).cast("long")).alias("value"))


def overused_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms whose share in a group that holds them is above that in the language."""
    held = kept.select("lang", "term", F.col("tf").alias("all"), F.inline("held").alias("source", "tf"))
    sized = beside(held, groups, ["lang", "source"], "term")
    both = sized.select("lang", "source", F.col("term").alias("item"), share(F.col("tf"), F.col("n"), F.col("terms")).alias("p"), share(F.col("all"), F.col("lang_n"), F.col("terms")).alias("q"))
    return both.where("p > q").select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): sources that differ most from a source, and the terms that it overuses most."""
    kept = stored(vocabulary(term_counts(docs, lang, source, text), least))
    groups = group_sizes(docs, kept, lang, source)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [
        source_pairs(dense_shares(kept, groups), groups).withColumn("rank", rank).withColumn("part", F.lit("pair")),
        overused_terms(kept, groups).withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")),
    ]
    return reduce(DataFrame.unionByName, parts).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS a FROM (SELECT DISTINCT lang, source FROM d) g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p, 1 + (1000000000 * (a + 1)) // (sum(a) OVER w + count(*) OVER w) AS q
  FROM x WINDOW w AS (PARTITION BY lang, source)),
f AS (SELECT i.lang, i.source, j.source AS item, sum(((i.p - j.p) * (i.p - j.p)) // j.p) AS value FROM s i JOIN s j ON i.lang = j.lang AND i.term = j.term AND i.source <> j.source GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = o.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
