"""Search from query texts to display rows, as one plan over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.functions import vocab
from rankweave.operators import dense, explain, fusion, graph, lexical, rerank, understand

from . import encoding
from .folders import removed, settled, written

QUERIES = [(1, "senior blue anvil with red bolt"), (2, "green bolt not blue anvil"), (3, "building with 3 years red anvil")]


def ask(spark: SparkSession, queries: DataFrame, profile: dict[str, DataFrame], limit: int = 30) -> DataFrame:
    """Ranked, explained candidates of each query (qid, text).

    profile holds index relations, `top` (top_skills), `has_skill`, `suitable`, `edges`, `profiles`,
    `skills` and `roles` (vocabularies), and optionally `vectors` and `query_vectors` for the dense signal.
    """
    parsed = settled(understand.parse(queries, profile["skills"], profile["roles"]))
    variants = settled(understand.without_negated(understand.expand(parsed), parsed))
    terms = lexical.query_terms(variants, T.bm25_tokens(F.col("query")), ["qid", "query", "strategy"])
    words = parsed.select("qid", F.explode("skills").alias("s")).select("qid", F.explode(F.split("s", " ")).alias("term")).distinct()
    parts = lexical.boosted_parts(profile, terms, lexical.skill_boosts(profile["top"]), words.crossJoin(F.broadcast(variants.select("query", "strategy").distinct())), ["qid", "query", "strategy"])
    lexical_ = lexical.over_variants(parts).withColumn("score", F.round("score", 6))
    if "vectors" in profile:
        asked = dense.weighted_query(dense.variant_weights(profile["query_vectors"]), ["qid"])
        similar = dense.scores(asked, profile["vectors"]).select("qid", "doc_id", dense.clipped(F.col("score")).alias("dense"))
        both = lexical_.withColumnRenamed("score", "bm25").join(similar, ["qid", "doc_id"], "full_outer").na.fill(0.0, ["bm25", "dense"])
        weights = {"bm25": vocab.ALPHA_BM25, "dense": vocab.ALPHA_DENSE}
    else:
        both, weights = lexical_.withColumnRenamed("score", "bm25").withColumn("dense", F.lit(0.0)), {"bm25": vocab.ALPHA_BM25}
    both = written(both)
    fused = fusion.reciprocal_ranks(both, weights).join(profile["top"], "doc_id", "left").join(profile["profiles"].select(F.col("cid").alias("doc_id"), "years"), "doc_id", "left")
    asked = parsed.select("qid", "skills", "negated", F.col("years").alias("wanted"), "band", "intent")
    fused = fused.join(asked, "qid")
    names = F.array_union(F.coalesce("core_names", F.array().cast("array<string>")), F.coalesce("secondary_names", F.array().cast("array<string>")))
    valid = ~fusion.has_negated(names, F.lit(""), F.col("negated")) & fusion.experienced(F.col("years"), F.col("wanted"), F.col("band"))
    fused = fused.withColumn("fused", fusion.boosted(F.col("rrf"), valid, fusion.core_hits(F.col("skills"), F.col("core_names"))))
    fused = written(fused.select("qid", "doc_id", "bm25", "dense", "fused", "core_names", "years"))
    hybrid = fusion.floored(fusion.gated(fused), limit)
    people = profile["profiles"].select(F.col("cid").alias("id"), "name", "roles")
    hybrid = hybrid.select("qid", F.col("doc_id").alias("id"), F.col("fused").alias("score"), F.col("core_names").alias("core_skills"), F.array().cast("array<string>").alias("matched_terms"), "years").join(people.drop("name"), "id", "left")

    listed = variants.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("ord", "query", "strategy"))).alias("l")).select("qid", F.transform("l", lambda v: F.struct(v["query"], v["strategy"])).alias("queries"))
    wanted = graph.collect_terms(parsed.select("qid", "skills", "role", "band", "negated").join(listed, "qid"))
    sides = profile["has_skill"], profile["suitable"]
    at, met = graph.gains(*sides, profile["edges"], settled(wanted), settled)
    conditions = parsed.select("qid", T.years(F.col("years")).alias("wanted"), "band", "negated")
    reached = graph.judged(graph.totals(*sides, at, met), profile["has_skill"], profile["profiles"], conditions)
    branch = reached.select("qid", F.col("cid").alias("id"), "score", "core_skills", F.array().cast("array<string>").alias("matched_terms"), "years", "roles")

    intents = parsed.select("qid", F.col("intent.primary").alias("intent"), F.col("intent.confidence").alias("confidence"), F.col("intent.modifiers").alias("modifiers"), "negated")
    hybrid, branch = settled(hybrid), written(branch)
    ranked = settled(rerank.reranked(rerank.pooled(hybrid, branch), intents, scale=True, limit=limit))
    # Every candidate is scored; single hits are only shown, so they are made for the rows that are.
    shown = ranked.where(F.col("source") != "hybrid_only").select("qid", F.col("id").alias("cid"))
    why = graph.scored(graph.hits_of(shown, *sides, at, met)).select("qid", F.col("cid").alias("id"), F.col("matched_terms").alias("_terms"), "reasons")
    ranked = ranked.join(why, ["qid", "id"], "left").withColumn("matched_terms", F.coalesce("_terms", "matched_terms")).drop("_terms")
    details = ranked.select("qid", "id", "reasons").join(people.select("id", "name"), "id", "left").withColumn("summary", F.lit(""))
    ranked = ranked.drop("reasons")
    out = settled(explain.display(ranked, details, intents.select("qid", "intent", "confidence").join(parsed.select("qid", "skills"), "qid")))
    removed(both, fused, branch)
    return out


def search(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed queries over the customers as candidates."""
    from .index_queries import _profile_index

    held = written(encoding.has_skill(spark, sf))
    relations, top = _profile_index(spark, sf, held, written)
    skills = held.select("cid", "skill")
    known = settled(skills.select(F.col("skill").alias("term"), F.col("skill").alias("canonical")).distinct())
    roles = settled(encoding.suitable(spark, sf).select(F.lower("role").alias("term"), F.lower("role").alias("canonical")).distinct())
    profile = relations | {"top": top, "has_skill": skills, "suitable": encoding.suitable(spark, sf), "edges": settled(encoding.edges(spark, sf, held)), "profiles": encoding.profiles(spark, sf), "skills": known, "roles": roles}
    out = ask(spark, spark.createDataFrame(QUERIES, "qid int, text string"), profile)
    removed(held, relations["postings"], top)
    return out.select("qid", "rank", "id", "title", F.round("rrf_score", 4).alias("score"), "source", F.array_join("skills", ",").alias("skills"), F.array_join("bullets", " / ").alias("bullets"), "intent_alignment")
