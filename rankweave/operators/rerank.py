"""Merging of the two branches and intent-weighted re-ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import vocab

from .ranks import numbered, small


def tagged(hybrid: DataFrame, graph: DataFrame) -> DataFrame:
    """Full outer merge by (qid, id): score of the hybrid branch, else of the graph's, and where a row comes from."""
    h = hybrid.select("qid", "id", F.col("score").alias("_h"), F.lit(True).alias("_in_h"))
    k = graph.select("qid", "id", F.col("score").alias("_k"), F.lit(True).alias("_in_k"))
    both = h.join(k, ["qid", "id"], "full_outer")
    source = F.when(F.col("_in_h") & F.col("_in_k"), "both").when(F.col("_in_h"), "hybrid").otherwise("kg")
    return both.select("qid", "id", F.when(F.col("_in_h"), F.col("_h")).otherwise(F.col("_k")).alias("score"), source.alias("source"))


def branch_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("qid").agg(F.count_if(F.col("source") != "kg").alias("hybrid_n"), F.count_if(F.col("source") != "hybrid").alias("kg_n"), F.count_if(F.col("source") == "both").alias("overlap_n"))


def pooled(hybrid: DataFrame, graph: DataFrame) -> DataFrame:
    """One row a candidate with both scores (0 where missing); the graph's fields where they are not empty, terms united.

    Both sides: (qid, id, score, core_skills, matched_terms, years, roles).
    """
    fields = ["score", "core_skills", "matched_terms", "years", "roles"]
    h = hybrid.select("qid", "id", *[F.col(c).alias(f"h_{c}") for c in fields], F.lit(True).alias("in_h"))
    k = graph.select("qid", "id", *[F.col(c).alias(f"k_{c}") for c in fields], F.lit(True).alias("in_k"))
    none = F.array().cast("array<string>")
    richer = lambda c: F.when(F.size(F.coalesce(f"k_{c}", none)) > 0, F.col(f"k_{c}")).otherwise(F.coalesce(f"h_{c}", none))
    source = F.when(F.col("in_h") & F.col("in_k"), "both").when(F.col("in_h"), "hybrid_only").otherwise("kg_only")
    return h.join(k, ["qid", "id"], "full_outer").select(
        "qid",
        "id",
        F.coalesce("h_score", F.lit(0.0)).alias("hybrid_score"),
        F.coalesce("k_score", F.lit(0.0)).alias("kg_score"),
        richer("core_skills").alias("core_skills"),
        F.array_sort(F.array_union(F.coalesce("h_matched_terms", none), F.coalesce("k_matched_terms", none))).alias("matched_terms"),
        F.coalesce("k_years", "h_years").alias("years"),
        richer("roles").alias("roles"),
        source.alias("source"),
    )


def alpha(intent: Column, confidence: Column) -> Column:
    """Weight of the hybrid branch: the intent's, drawn towards one half as confidence falls."""
    base = F.lit(vocab.OTHER_ALPHA)
    for name, a in vocab.INTENT_ALPHA.items():
        base = F.when(intent == name, a).otherwise(base)
    return F.round(0.5 + (base - 0.5) * confidence, 6)


def _times(items: Column, name: str) -> Column:
    return F.size(F.filter(items, lambda m: m == name))


def adjustment(modifiers: Column, negated: Column, core_skills: Column) -> Column:
    """Bonuses of known modifiers, and a penalty for each negated skill within a core skill."""
    gain = F.lit(0.0)
    for name, bonus in vocab.MODIFIERS.items():
        gain = gain + bonus * _times(modifiers, name)
    met = F.filter(negated, lambda n: F.exists(core_skills, lambda s: F.contains(F.lower(s), n)))
    return gain + vocab.NEGATION_PENALTY * F.size(met)


def finals(pool: DataFrame, asked: DataFrame, scale: bool = False) -> DataFrame:
    """final = alpha·hybrid + beta·graph + adjustment, cut to 0..1, unrounded.

    asked(qid, intent, confidence, modifiers, negated). `scale` first brings each branch to 0..1 within
    its query, as graph scores have no bound of their own.
    """
    out = pool
    if scale:
        ends = pool.groupBy("qid").agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in ("hybrid_score", "kg_score") for f in (F.min, F.max)])
        out = pool.join(F.broadcast(ends), "qid")  # one row a query
        for c in ("hybrid_score", "kg_score"):
            lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
            out = out.withColumn(c, F.when(hi == lo, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((F.col(c) - lo) / (hi - lo)))
        out = out.drop(*[c for c in out.columns if c.startswith(("_min_", "_max_"))])
    out = out.join(small(asked), "qid").withColumn("alpha", alpha(F.col("intent"), F.col("confidence"))).withColumn("beta", F.round(1.0 - F.col("alpha"), 6))
    out = out.withColumn("modifier_delta", adjustment(F.col("modifiers"), F.col("negated"), F.col("core_skills")))
    raw = F.col("alpha") * F.col("hybrid_score") + F.col("beta") * F.col("kg_score") + F.col("modifier_delta")
    return out.withColumn("final_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def rounded(out: DataFrame) -> DataFrame:
    """Scores at four places, for display."""
    for c in ("final_score", "hybrid_score", "kg_score", "alpha", "beta", "modifier_delta"):
        out = out.withColumn(c, F.round(c, 4))
    return out.drop("modifiers", "negated", "confidence")


def reranked(pool: DataFrame, asked: DataFrame, scale: bool = False, limit: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """finals() with ranks by final score, ties by id, rounded.

    With a limit, Spark keeps that many rows a query in each task; without one every row is numbered in ranges of the
    order, so that no task sorts a whole query. `keep` may store the rows, which the numbering reads several times.
    """
    out = finals(pool, asked, scale)
    if limit is None:
        return rounded(numbered(keep(out), ["qid"], "final_score", "id", "rank"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("final_score"), "id"))
    return rounded(out.withColumn("rank", best).where(F.col("rank") <= limit))


def from_hybrid(raw: DataFrame) -> DataFrame:
    """The hybrid branch's nested rows (candidate_id, scores struct<primary, rrf>, ...) as flat candidates: both id names as text, the primary score unless it is empty."""
    cid = F.col("candidate_id").cast("string")
    first = F.col("scores.primary")
    score = F.when(first.isNotNull() & (first != 0), first).otherwise(F.col("scores.rrf"))
    return raw.select(cid.alias("id"), cid.alias("candidate_id"), score.alias("score"), *[c for c in raw.columns if c != "candidate_id"])


def from_graph(raw: DataFrame) -> DataFrame:
    """The graph branch's rows as candidates: text and list columns that are null are empty."""
    cid = F.col("candidate_id").cast("string")
    fill = {"string": F.lit(""), "array<string>": F.array().cast("array<string>")}
    rest = [F.coalesce(c, fill[t]).alias(c) if t in fill else F.col(c) for c, t in raw.dtypes if c != "candidate_id"]
    return raw.select(cid.alias("id"), cid.alias("candidate_id"), *rest)
