"""A general dictionary counted from a corpus, and corrections from it by symmetric deletion.

Two words within an edit distance d have a string in common that each reaches by deleting d letters at most. So words of the dictionary are
listed under what they leave when letters are deleted, tokens ask with what they leave, and pairs that meet are verified by
`levenshtein`. Nearer words come first, then more frequent ones, then by name. Short tokens may be one letter off, longer ones two,
so no key has fewer than three letters, and keys that very many words share do not come up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, LONG = 4, 6  # letters of a token that is looked up, and of one that may be two letters off
WORD = r"[^a-z]+"  # what no word holds


def words(text: Column) -> Column:
    """Runs of a-z of a text in lower case, and empty strings at its ends."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), WORD)


def counted(docs: DataFrame, text: str, least: int = 1) -> DataFrame:
    """(word, n): words of some length and how many of the texts hold them, where at least `least` do."""
    held = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).where(F.length("word") >= LEAST - 1)
    return held.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _without(text: Column, at: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text)))


def _places(text: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))


def left_over(word: Column, two: Column) -> Column:
    """What a word leaves without up to one letter, or up to two where `two` holds; three letters at least."""
    one = F.transform(_places(word), lambda i: _without(word, i))
    more = F.when(two, F.flatten(F.transform(one, lambda w: F.transform(_places(w), lambda i: _without(w, i))))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(F.array(word), one, more)), lambda w: F.length(w) >= 3)


def index(dictionary: DataFrame) -> DataFrame:
    """(key, word, n): the dictionary by what its words leave. To be stored where many batches ask."""
    return dictionary.select(F.explode(left_over(F.col("word"), F.length("word") > LEAST)).alias("left"), "word", "n").select(F.xxhash64("left").alias("key"), "word", "n")


def reach(token: Column) -> Column:
    return F.when(F.length(token) < LONG, 1).otherwise(2)


def corrections(tokens: DataFrame, dictionary: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(token, word, dist, n): the best word for each different token (of a-z, LEAST letters or more) that is no word itself."""
    own = tokens.select("token").distinct().where((F.length("token") >= LEAST) & ~F.col("token").rlike(WORD))
    unknown = own.join(dictionary.select(F.col("word").alias("token")), "token", "left_anti")
    asked = unknown.select("token", F.explode(left_over(F.col("token"), F.length("token") >= LONG)).alias("left")).select("token", F.xxhash64("left").alias("key"))
    met = asked.join(index(dictionary) if listed is None else listed, "key").select("token", "word", "n").distinct()
    near = met.withColumn("dist", F.levenshtein("token", "word")).where(F.col("dist") <= reach(F.col("token")))
    best = near.groupBy("token").agg(F.min(F.struct("dist", (-F.col("n")).alias("less"), "word")).alias("m"))
    return best.select("token", "m.word", "m.dist", (-F.col("m.less")).alias("n"))
