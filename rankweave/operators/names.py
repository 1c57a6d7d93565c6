"""Which names hold a term as a part: an inverted index of q-grams, candidates by the rarest gram, verified.

Every name is listed under its different grams of `Q` characters, and under the shorter ones and the empty one that terms of
fewer characters ask for. A name that holds a term holds all of the term's grams, so the term's candidates are the
names under that one of its grams that the fewest names have; where a gram has no name, no name holds the term. Joins are by
equal grams only: nothing meets that does not share the term's rarest gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import small

Q = 3


def grams(text: Column, q: int) -> Column:
    """Different runs of q characters of a text, none where it is shorter; the empty run for q = 0."""
    if q == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.length(text) - (q - 1))
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def gram_index(names: DataFrame, name: str, fold: bool = True, q: int = Q) -> DataFrame:
    """(gram, name, low): names under their grams of 0 to q characters; `low` is what is searched. To be stored where many batches ask."""
    low = F.lower(name) if fold else F.col(name)
    rows = names.select(F.col(name).alias("name"), low.alias("low")).where("low is not null").distinct()
    return rows.select(F.explode(F.concat(*[grams(F.col("low"), i) for i in range(q + 1)])).alias("gram"), "name", "low")


def asked_grams(terms: DataFrame, term: str, fold: bool = True, q: int = Q) -> DataFrame:
    """(term, part, gram): the grams of q characters of each term, or the term itself where it is shorter."""
    part = F.lower(term) if fold else F.col(term)
    rows = terms.select(F.col(term).alias("term"), part.alias("part")).where("part is not null").distinct()
    return rows.select("term", "part", F.explode(F.when(F.length("part") < q, F.array("part")).otherwise(grams(F.col("part"), q))).alias("gram"))


def rarest(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(term, part, gram): of each term's grams the one that the fewest names have; terms with a gram that no name has are left out."""
    sizes = index.join(small(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    sized = asked.join(sizes, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = sized.groupBy("term", "part").agg(F.min(F.struct("n", "gram")).alias("m"))
    return best.where("m.n > 0").select("term", "part", F.col("m.gram").alias("gram"))


def holding(index: DataFrame, terms: DataFrame, term: str = "term", fold: bool = True, q: int = Q) -> DataFrame:
    """(term, name): the names of a gram_index() that hold each different term of `terms`."""
    chosen = rarest(asked_grams(terms, term, fold, q), index)
    return index.join(small(chosen), "gram").where(F.contains("low", F.col("part"))).select("term", "name")


def held_terms(names: DataFrame, name: str, terms: DataFrame, term: str = "term", fold: bool = True, q: int = Q) -> DataFrame:
    """Columns of `terms` with each of the names that hold the row's term; names without one, and terms without a name, go."""
    found = holding(gram_index(names, name, fold, q), terms, term, fold, q)
    return terms.join(found.withColumnRenamed("term", "_t"), F.col(term) == F.col("_t")).drop("_t").withColumnRenamed("name", name)
