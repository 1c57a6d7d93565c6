"""BM25 scoring of batches of queries by joins with postings.

Queries are rows (qid, term[, weight]); a repeated term counts again. The query side of each join is
aggregated to (qid, term, n); Spark broadcasts it where its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import vocab

from .index import term_stats
from .ranks import small


def query_terms(queries: DataFrame, tokens: Column, keys: list[str]) -> DataFrame:
    return queries.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float = vocab.K1, b: float = vocab.B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def wanted_terms(index: dict[str, DataFrame], terms: DataFrame) -> DataFrame:
    """Query terms with their idf; only they are counted, so the vocabulary as a whole is not."""
    asked = small(terms.select("term").distinct())
    return terms.join(term_stats(index["postings"].join(asked, "term", "left_semi"), index["corpus_stats"]), "term")


def _with_length(index: dict[str, DataFrame], hits: DataFrame) -> DataFrame:
    return hits if "dl" in hits.columns else hits.join(index["doc_stats"], "doc_id")


def bm25_parts(index: dict[str, DataFrame], terms: DataFrame, keys: list[str], k1: float = vocab.K1, b: float = vocab.B, delta: float = vocab.DELTA) -> DataFrame:
    """(keys, doc_id, term, part): what each query term adds to each document."""
    hits = _with_length(index, index["postings"].join(small(wanted_terms(index, terms)), "term")).crossJoin(F.broadcast(index["corpus_stats"].select("avgdl")))
    part = F.col("n") * F.col("idf") * (saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b) + delta)
    return hits.select(*keys, "doc_id", "term", part.alias("part"))


def bm25(index: dict[str, DataFrame], terms: DataFrame, keys: list[str], **how: float) -> DataFrame:
    """(keys, doc_id, score) of documents that hold a query term."""
    return bm25_parts(index, terms, keys, **how).groupBy(*keys, "doc_id").agg(F.sum("part").alias("score"))


def boosted_parts(index: dict[str, DataFrame], terms: DataFrame, boosts: DataFrame, core_terms: DataFrame, keys: list[str]) -> DataFrame:
    """As bm25_parts without delta: tf times the boost of (doc_id, term), idf times 1.5 for a query's core terms."""
    wanted = wanted_terms(index, terms).join(core_terms.select(*keys, "term", F.lit(True).alias("core")), [*keys, "term"], "left")
    asked = small(terms.select("term").distinct())
    hits = index["postings"].join(small(wanted), "term").join(boosts.join(asked, "term", "left_semi"), ["doc_id", "term"], "left")
    hits = _with_length(index, hits)
    hits = hits.crossJoin(F.broadcast(index["corpus_stats"].select(F.greatest("avgdl", F.lit(1.0)).alias("avgdl"))))
    tf = F.col("tf") * F.coalesce("boost", F.lit(1.0))
    up = F.when(F.col("core"), vocab.CORE_IDF).otherwise(1.0)
    part = F.col("n") * F.col("idf") * up * saturation(tf, F.col("dl"), F.col("avgdl"))
    return hits.select(*keys, "doc_id", "term", part.alias("part"))


def skill_boosts(top: DataFrame) -> DataFrame:
    """(doc_id, term, boost) from top_skills: 3 for words of core skills, 1.2 for those of secondary ones."""
    words = lambda names: F.flatten(F.transform(names, lambda s: F.concat(F.array(F.replace(s, F.lit(" "), F.lit("_"))), F.split(s, " "))))
    core = top.select("doc_id", F.explode(words("core_names")).alias("term"), F.lit(vocab.CORE_TF).alias("boost"))
    other = top.select("doc_id", F.explode(words("secondary_names")).alias("term"), F.lit(vocab.SECONDARY_TF).alias("boost"))
    return core.unionByName(other).groupBy("doc_id", "term").agg(F.max("boost").alias("boost"))


def strategy_weight(strategy: Column) -> Column:
    out = None
    for name, w in vocab.STRATEGY_WEIGHTS.items():
        out = F.when(strategy == name, w) if out is None else out.when(strategy == name, w)
    return out.otherwise(vocab.OTHER_STRATEGY)


def over_variants(parts: DataFrame) -> DataFrame:
    """(qid, doc_id, score 0..1, contributions) from parts (qid, strategy, ...): a weighted sum over variants, over its largest."""
    weighted = parts.withColumn("part", F.col("part") * strategy_weight(F.col("strategy")))
    terms = weighted.groupBy("qid", "doc_id", "term").agg(F.sum("part").alias("part"))
    sums = terms.groupBy("qid", "doc_id").agg(F.sum("part").alias("raw"), F.collect_list(F.struct("term", "part")).alias("parts"))
    most = sums.groupBy("qid").agg(F.max("raw").alias("most"))
    scaled = sums.join(most, "qid")
    over = F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)
    ranked = F.array_sort(F.filter(F.transform("parts", lambda p: F.struct((-F.round(p["part"] / over, 4)).alias("less"), p["term"].alias("term"))), lambda p: p["less"] < 0))
    return scaled.select("qid", "doc_id", (F.col("raw") / over).alias("score"), F.transform(ranked, lambda p: F.struct(p["term"].alias("term"), (-p["less"]).alias("contribution"))).alias("keywords"))


def top_k(scores: DataFrame, keys: list[str], k: int, score: str = "score") -> DataFrame:
    """The k best of each query with their rank; ties by id."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def positive(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.where(F.col(score) > 0)


def min_max(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 within each query; 1 where all are equal. Extremes are aggregated first, so no window gathers a query's rows."""
    ends = scores.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return scores.join(ends, keys).withColumn("normalised", scaled).drop("_lo", "_hi")


def matched_terms(post: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id, matched): query terms that a document holds, sorted."""
    return post.join(terms.select(*keys, "term").distinct(), "term").groupBy(*keys, "doc_id").agg(F.sort_array(F.collect_set("term")).alias("matched"))


def matched_skills(wanted: DataFrame, synonyms: DataFrame, post: DataFrame) -> DataFrame:
    """(qid, doc_id, wanted, skill, weight, via): a wanted skill that a profile has, else the first synonym that it has."""
    exact = wanted.select("qid", F.col("skill").alias("wanted"), "skill", F.lit(-1).alias("place"))
    other = wanted.select("qid", F.col("skill").alias("wanted")).join(synonyms.select(F.col("term").alias("wanted"), F.col("synonym").alias("skill"), "place"), "wanted").select("qid", "wanted", "skill", "place")
    hits = post.join(exact.unionByName(other), "skill")
    best = hits.groupBy("qid", "doc_id", "wanted").agg(F.min(F.struct("place", "skill", "weight")).alias("m"))
    return best.select("qid", "doc_id", "wanted", "m.skill", "m.weight", F.when(F.col("m.place") >= 0, F.concat(F.lit("synonym of '"), "wanted", F.lit("'"))).alias("via"))


def with_skills(scores: DataFrame, asked: DataFrame, post: DataFrame, score: str = "score") -> DataFrame:
    """Hits (qid, doc_id, score) with the asked skills (qid, skill) that each holds, the share of them, and the score scaled within its query."""
    n = asked.groupBy("qid").agg(F.count_distinct("skill").alias("_n"))
    held = asked.join(post.select("skill", "doc_id"), "skill").groupBy("qid", "doc_id").agg(F.sort_array(F.collect_set("skill")).alias("matched_skills"))
    out = min_max(scores, ["qid"], score).join(held, ["qid", "doc_id"], "left").join(n, "qid", "left")
    matched = F.coalesce("matched_skills", F.array().cast("array<string>"))
    share = F.round(F.size(matched) / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)), 3)
    return out.withColumn("matched_skills", matched).withColumn("skill_overlap", share).drop("_n")


def containing(docs: DataFrame, passages: DataFrame, grams: int = 4) -> DataFrame:
    """(qid, doc_id): texts (doc_id, text) that hold a passage (qid, p) word for word.

    The words within a passage, its first and last one aside, stand whole in a text that holds it, so texts meet
    passages by equal runs of `grams` words, and pairs are then verified. A passage with fewer inner words is looked
    for in every text; these are joined by themselves.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    run = lambda at: F.xxhash64(*[F.get("w", at + i) for i in range(grams)])
    asked = passages.withColumn("w", words(F.col("p")))
    enough = F.size("w") >= grams + 2
    keys = small(asked.where(enough).select("qid", "p", run(F.lit(1)).alias("h")))
    held = docs.withColumn("w", words(F.coalesce(F.col("text"), F.lit(""))))
    runs = held.select("doc_id", "text", "w", F.posexplode("w").alias("at", "_first")).where(F.col("at") + grams <= F.size("w"))
    met = runs.select("doc_id", "text", run(F.col("at")).alias("h")).join(keys, "h").where(F.contains("text", F.col("p"))).select("qid", "doc_id").distinct()
    short = small(asked.where(~enough).select("qid", "p"))
    return met.unionByName(docs.join(short, F.contains("text", F.col("p"))).select("qid", "doc_id"))
