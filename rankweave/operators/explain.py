"""Display rows and explanation texts of ranked candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import text as T


def _strings() -> Column:
    return F.array().cast("array<string>")


def display(ranked: DataFrame, details: DataFrame, asked: DataFrame) -> DataFrame:
    """Ranked rows joined with details (qid, id, name, summary, reasons) and asked (qid, skills, intent, confidence).

    Ranked rows: qid, id, rank, scores, alpha, beta, modifier_delta, core_skills, matched_terms, roles, source.
    """
    out = ranked.drop("intent").join(details, ["qid", "id"], "left").join(asked.withColumnRenamed("skills", "_wanted"), "qid")
    name = F.coalesce(T.present(F.col("name")), F.concat(F.lit("Candidate "), F.col("id").cast("string")))
    roles = F.coalesce("roles", _strings())
    overlap = T.overlaps(F.col("core_skills"), F.col("_wanted"))
    reasons = F.transform(
        F.slice(F.filter(F.coalesce("reasons", F.array().cast("array<struct<query_term:string,matched_node:string,relationship:string,hops:int,score_delta:double>>")), lambda r: r["matched_node"].isNotNull()), 1, 6),
        lambda r: F.format_string("Matched '%s' → %s via %s (%d-hop, +%.3f)", r["query_term"], r["matched_node"], r["relationship"], r["hops"], r["score_delta"]),
    )
    fused = F.format_string("Fusion: α=%.2f·hybrid + β=%.2f·kg", "alpha", "beta")
    fused = F.when(F.col("modifier_delta") != 0, F.concat(fused, F.format_string("  (modifier Δ=%+.3f)", "modifier_delta"))).otherwise(fused)
    summary = F.concat(
        F.format_string("%s: final score %.3f (source: %s). ", name, F.round("final_score", 3), F.col("source")),
        F.when(F.size("matched_terms") > 0, F.format_string("%d search terms matched via graph. ", F.size("matched_terms"))).otherwise(""),
        F.when(F.size(overlap) > 0, F.format_string("%d core-skill overlaps with query. ", F.size(overlap))).otherwise(""),
    )
    return out.select(
        "qid",
        "id",
        "rank",
        F.when(F.size(roles) > 0, F.get(roles, F.lit(0))).otherwise(name).alias("title"),
        F.col("final_score").alias("rrf_score"),
        "source",
        F.substring(F.coalesce("summary", F.lit("")), 1, 500).alias("preview"),
        F.slice("core_skills", 1, 10).alias("skills"),
        summary.alias("summary"),
        F.concat(reasons, F.array(fused)).alias("bullets"),
        F.round(F.col("alpha") * 100).cast("int").alias("bm25_percent"),
        F.round(F.col("beta") * 100).cast("int").alias("semantic_percent"),
        F.col("hybrid_score").alias("bm25_raw"),
        F.col("kg_score").alias("semantic_cosine"),
        F.slice("matched_terms", 1, 8).alias("keyword_highlights"),
        F.slice(overlap, 1, 8).alias("skill_overlap"),
        F.format_string("Intent: %s (confidence %.2f). Retrieved via: %s.", F.coalesce("intent", F.lit("unknown")), F.coalesce("confidence", F.lit(0.0)), F.col("source")).alias("intent_alignment"),
    )


def stub(row_id: Column, score: Column, source: Column) -> Column:
    return F.format_string("Candidate %s: final score %.3f (source: %s). Click 'Why Selected' to generate a full AI explanation.", row_id.cast("string"), F.round(score, 3), source)


def share_tier(share: Column) -> Column:
    return F.when(share >= 0.65, "very strong").when(share >= 0.45, "strong").when(share >= 0.25, "moderate").otherwise("weak")


def score_tier(score: Column) -> Column:
    return F.when(score >= 0.80, "top-ranked").when(score >= 0.50, "highly ranked").when(score >= 0.25, "mid-ranked").otherwise("lower-ranked")


def narration(title: Column, hybrid: Column, graph: Column, overlap: Column, skills: Column) -> Column:
    """The text that needs no language service."""
    lead = F.when(hybrid >= graph, "keyword and lexical").otherwise("knowledge-graph and semantic")
    named = F.array_join(F.slice(F.when(F.size(overlap) > 0, overlap).otherwise(skills), 1, 4), ", ")
    return F.concat(
        F.coalesce(title, F.lit("this candidate")),
        F.lit(" was retrieved with "),
        lead,
        F.lit(" signals leading the match. "),
        F.when(named != "", F.concat(F.lit("Relevant skills include "), named, F.lit("."))).otherwise(""),
        F.lit(" The combined retrieval score places this candidate in the result set based on alignment with the search intent across both retrieval channels."),
    )


def narrate(rows: DataFrame, service: Callable[[dict], str] | None, fallback: Column, out: str = "explanation") -> DataFrame:
    """Texts by an injected service in Arrow batches; without one, or where it fails, the fallback."""
    if service is None:
        return rows.withColumn(out, fallback)
    held = rows.withColumn("_fallback", fallback)

    def run(batches):
        for batch in batches:
            texts = []
            for row in batch.to_dict("records"):
                try:
                    texts.append(service(row))
                except Exception:  # an outside service may fail in any way; the row keeps its fallback
                    texts.append(row["_fallback"])
            batch[out] = texts
            yield batch.drop(columns="_fallback")

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{out}` string"
    return held.mapInPandas(run, schema)
