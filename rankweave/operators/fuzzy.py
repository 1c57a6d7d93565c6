"""Fuzzy joins of tokens or names to a vocabulary.

Candidates come from equal keys, never from all pairs: two strings within edit distance d share, of
the d + 1 parts that one is cut into, at least one part at a place shifted by d at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import vocab
from rankweave.functions.text import let


def _parts(term: Column, distance: int) -> Column:
    """Cuts of a vocabulary term: (length, part number, text)."""
    n, k = F.length(term), distance + 1
    start = lambda i: F.floor(n * i / k).cast("int")
    return F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(term, start(i) + 1, start(i + 1) - start(i)).alias("s")) for i in range(k)])


def _cuts(token: Column, n: Column, i: int, size: Column, at: Column) -> Column:
    return F.transform(at, lambda p: F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(token, p + 1, size).alias("s")))


def _probes(token: Column, distance: int) -> Column:
    """What a token must hold to be near a term of each length: every cut at every shift, once."""
    m, k = F.length(token), distance + 1

    def for_length(n: Column) -> Column:
        out = []
        for i in range(k):
            a = F.floor(n * i / k).cast("int")
            size = F.floor(n * (i + 1) / k).cast("int") - a
            at = F.sequence(F.greatest(a - distance, F.lit(0)), F.greatest(F.least(a + distance, m - size), F.greatest(a - distance, F.lit(0))))
            out.append(_cuts(token, n, i, size, at))
        return F.flatten(F.array(*out))

    lengths = F.sequence(F.greatest(m - distance, F.lit(1)), m + distance)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: for_length(n))))


def fuzzy_match(tokens: DataFrame, terms: DataFrame, distance: int = vocab.FUZZY_DISTANCE, ratio: float = vocab.FUZZY_RATIO, least: int = 3) -> DataFrame:
    """(token, term, dist): the nearest one-word term of each token of at least `least` letters, within the distance and ratio; ties by the terms' place.

    tokens(token), terms(term, place).
    """
    own = tokens.select("token").distinct().where(F.length("token") >= least)
    one = terms.where(~F.contains("term", F.lit(" ")))
    left = own.select("token", F.explode(_probes(F.col("token"), distance)).alias("k"))
    right = one.select("term", "place", F.explode(_parts(F.col("term"), distance)).alias("k"))
    pairs = left.join(right, "k").select("token", "term", "place").distinct()
    near = pairs.withColumn("dist", F.levenshtein("token", "term", distance)).where("dist >= 0")
    near = near.where(1.0 - F.col("dist") / F.greatest(F.length("token"), F.length("term")) >= ratio)
    best = near.groupBy("token").agg(F.min(F.struct("dist", "place", "term")).alias("m"))
    return best.select("token", "m.term", "m.dist")


def corrected(queries: DataFrame, terms: DataFrame, protected: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """(qid, corrected): each word that is neither protected nor known as its nearest term; capitals are restored."""
    words = queries.select(key, F.posexplode(F.split(text, " ")).alias("at", "word")).withColumn("token", F.lower("word"))
    skip = F.col("token").rlike(r"[^a-z]") | (F.length("token") < 4)
    open_ = words.where(~skip).join(protected.select(F.col("term").alias("token")), "token", "left_anti").join(terms.select(F.col("term").alias("token")), "token", "left_anti")
    found = fuzzy_match(open_, terms).select("token", F.col("term").alias("new"))
    out = words.join(found, "token", "left")
    same = F.when((F.upper("word") == F.col("word")) & (F.length("word") > 1), F.upper("new")).when(F.initcap("word") == F.col("word"), F.initcap("new")).otherwise(F.col("new"))
    one = F.coalesce(same, F.col("word"))
    return out.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", one.alias("w")))).alias("l")).select(key, F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("corrected"))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the usual table."""
    x, y = F.split(a, ""), F.split(b, "")
    start = F.array_repeat(F.lit(0), F.size(y) + 1)

    def row(last: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            return F.array_append(done, F.when(F.get(y, j - 1) == c, F.get(last, j - 1) + 1).otherwise(F.greatest(F.get(last, j), F.element_at(done, -1))))

        return F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(x, start, row), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 · longest common subsequence over the sum of lengths; 100 for two empty strings."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(200.0 * common_length(a, b) / both)


def _slack(both: Column, threshold: float) -> Column:
    """Characters that may be inserted or deleted between strings whose lengths add up to `both`."""
    return F.floor(both * (100 - threshold) / 100 + 1e-9).cast("int")


def canonical_match(names: DataFrame, canon: DataFrame, threshold: float = vocab.CANONICAL_RATIO) -> DataFrame:
    """(name, canonical, is_new): equal in lower case, else the best indel ratio of at least the threshold, else the name itself.

    canon(key, name): keys in lower case. With d the insertions and deletions that the ratio allows for two lengths, one of
    the d + 1 parts that a key is cut into stands in the name, moved by d at most; pairs are made by equal parts for
    each length that a partner may have, so none is lost. They pass `levenshtein` (never over d) before the ratio is
    worked out. Ties go to the smallest key.
    """
    own = names.select(F.trim("name").alias("name"), F.lower(F.trim("name")).alias("key")).distinct()
    keys = canon.groupBy("key").agg(F.min("name").alias("canonical"))
    exact = own.join(keys, "key")
    rest = own.join(keys.select("key"), "key", "left_anti")
    # Lengths whose ratio can reach the threshold at all: the shorter is at least t / (2 - t) of the longer.
    share = threshold / (200 - threshold)
    lengths = lambda n: F.sequence(F.greatest(F.ceil(n * share - 1e-9).cast("int"), F.lit(1)), F.greatest(F.floor(n / share + 1e-9).cast("int"), F.lit(1)))
    part = lambda m, n, i, s: F.struct(m.alias("m"), n.alias("n"), i.alias("i"), s.alias("s"))
    cut = lambda n, i, d: F.floor(n * i / (d + 1)).cast("int")

    def of_key(m: Column) -> Column:  # parts of a key of length n, for names of length m
        n = F.length("other")
        return let(_slack(n + m, threshold), lambda d: F.transform(F.sequence(F.lit(0), d), lambda i: part(m, n, i, F.substring("other", cut(n, i, d) + 1, cut(n, i + 1, d) - cut(n, i, d)))))

    def of_name(n: Column) -> Column:  # what a name of length m must hold for keys of length n
        m = F.length("key")

        def at(i: Column, d: Column) -> Column:
            size = cut(n, i + 1, d) - cut(n, i, d)
            first = F.greatest(cut(n, i, d) - d, F.lit(0))
            return F.transform(F.sequence(first, F.greatest(F.least(cut(n, i, d) + d, m - size), first)), lambda p: part(m, n, i, F.substring("key", p + 1, size)))

        return let(_slack(n + m, threshold), lambda d: F.flatten(F.transform(F.sequence(F.lit(0), d), lambda i: at(i, d))))

    left = rest.select("key", "name", F.explode(F.array_distinct(F.flatten(F.transform(lengths(F.length("key")), of_name)))).alias("k"))
    right = keys.select(F.col("key").alias("other"), "canonical").select("other", "canonical", F.explode(F.flatten(F.transform(lengths(F.length("other")), of_key))).alias("k"))
    pairs = left.join(right, "k").select("key", "name", "other", "canonical").distinct()
    near = pairs.where(F.levenshtein("key", "other") <= _slack(F.length("key") + F.length("other"), threshold))
    found = near.withColumn("r", indel_ratio(F.col("key"), F.col("other"))).where(F.col("r") >= threshold)
    best = found.groupBy("name").agg(F.min(F.struct((-F.col("r")).alias("less"), "other", "canonical")).alias("m")).select("name", F.col("m.canonical").alias("canonical"))
    matched = rest.join(best, "name", "left")
    return exact.select("name", "canonical", F.lit(False).alias("is_new")).unionByName(matched.select("name", F.coalesce("canonical", "name").alias("canonical"), F.col("canonical").isNull().alias("is_new")))


def disjoint(domains: DataFrame, subdomains: DataFrame, roles: DataFrame, skills: DataFrame) -> dict[str, DataFrame]:
    """Names known at a higher level leave the lower ones; all have a column `name`."""
    key = lambda df: df.select(F.lower(F.trim("name")).alias("_k")).distinct()
    out, above = {"domains": domains}, key(domains)
    for level, df in (("subdomains", subdomains), ("roles", roles), ("skills", skills)):
        out[level] = df.withColumn("_k", F.lower(F.trim("name"))).join(above, "_k", "left_anti").drop("_k")
        above = above.unionByName(key(df)).distinct()
    return out


def domain_value(column: Column, allowed: list[str]) -> Column:
    """The value in lower case where it is allowed, else null."""
    return F.when(F.lower(column).isin(*allowed), F.lower(column))


def with_aliases(matched: DataFrame) -> DataFrame:
    """(canonical, aliases): the names that were mapped to a canonical one."""
    alias = F.when(F.col("name") != F.col("canonical"), F.col("name"))
    return matched.groupBy("canonical").agg(F.sort_array(F.collect_set(alias)).alias("aliases"))
