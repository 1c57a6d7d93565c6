"""Rank fusion, hard filters, gates and floors of the hybrid branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import vocab

from .ranks import numbered


def reciprocal_ranks(scores: DataFrame, weights: dict[str, float], k: int = vocab.RRF_K) -> DataFrame:
    """Adds rrf: the sum of w / (k + rank) over the score columns, ranks over all rows of a query, ties by id.

    Ranks come before any filter, as filtered rows keep their places. Rows are read several times, so `scores` should be stored.
    """
    out, total = scores, None
    for name, w in weights.items():
        out = numbered(out, ["qid"], name, "doc_id", f"rank_{name}")
        part = F.lit(w) / (k + F.col(f"rank_{name}"))
        total = part if total is None else total + part
    return out.withColumn("rrf", total)


def has_negated(names: Column, summary: Column, negated: Column) -> Column:
    """Whether a negated skill is among the names or within the summary."""
    return F.exists(negated, lambda n: F.array_contains(names, n) | F.contains(F.lower(F.coalesce(summary, F.lit(""))), n))


def has_negated_word(names: Column, words: Column, negated: Column) -> Column:
    """The same by whole words, so that java does not exclude javascript."""
    return F.exists(negated, lambda n: F.array_contains(names, n) | F.array_contains(words, n))


def experienced(years: Column, wanted: Column, band: Column) -> Column:
    """Enough years for the asked number (2.5 fewer are allowed) and band (1 fewer); unknown bands ask for none."""
    least = F.lit(0)
    for name, minimum in vocab.BAND_MINIMA.items():
        least = F.when(F.lower(band) == name, max(0, minimum - 1)).otherwise(least)
    have = F.coalesce(years, F.lit(0.0))
    enough = F.coalesce(have >= wanted.try_cast("double") - vocab.YEARS_SLACK, F.lit(True))
    return enough & (band.isNull() | (have >= least))


def core_hits(skills: Column, core: Column) -> Column:
    """How many of the asked skills, with repetition, are core skills."""
    return F.size(F.filter(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.array_contains(F.coalesce(core, F.array().cast("array<string>")), s)))


def boosted(rrf: Column, valid: Column, hits: Column) -> Column:
    return F.when(valid, rrf).otherwise(0.0) * (1.0 + vocab.CORE_HIT * hits)


def gate_passed(bm25: Column, dense: Column, best: Column) -> Column:
    """Enough words, or some words and a dense score near the query's best one."""
    gate = F.when(best > 0, best * vocab.DENSE_GATE).otherwise(vocab.DENSE_GATE_EMPTY)
    return (bm25 >= vocab.BM25_FLOOR) | ((dense >= gate) & (bm25 > 0))


def gated(scored: DataFrame, fused: str = "fused") -> DataFrame:
    """Zeroes the fused score of rows that pass no quality gate; the dense gate follows the query's best row, one row a query, so no join gathers a query's rows."""
    best = scored.groupBy("qid").agg(F.max("dense").alias("_best"))
    keep = gate_passed(F.col("bm25"), F.col("dense"), F.col("_best"))
    return scored.join(F.broadcast(best), "qid").withColumn(fused, F.when(keep, F.col(fused)).otherwise(0.0)).drop("_best")


def floored(scored: DataFrame, k: int, fused: str = "fused", positive: bool = True) -> DataFrame:
    """Rows of at least 0.35 of the query's best score, k at most, with their rank; `positive` leaves zero scores out."""
    top = scored.groupBy("qid").agg(F.max(fused).alias("_top"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(fused), "doc_id"))
    out = scored.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(top), "qid")
    out = out.where(F.col(fused) >= F.col("_top") * vocab.SCORE_FLOOR).drop("_top")
    return out.where(F.col(fused) > 0) if positive else out


def signals(core: Column, secondary: Column, bm25: Column, dense: Column, band: Column, years: Column) -> Column:
    """Reasons for a hit, as an array of sentences."""
    join = lambda a: F.array_join(a, ", ")
    return F.array_compact(
        F.array(
            F.when(F.size(core) > 0, F.concat(F.lit("Core skill match: "), join(core))),
            F.when(F.size(secondary) > 0, F.concat(F.lit("Secondary skill match: "), join(secondary))),
            F.when(bm25 > 0, F.format_string("Keyword relevance (BM25=%.3f)", bm25)),
            F.when(dense > 0.5, F.format_string("Semantic similarity (cos=%.3f)", dense)),
            F.when(band.isNotNull(), F.concat(F.lit("Experience band '"), band, F.lit("' — candidate has "), F.coalesce(years, F.lit(0.0)).cast("string"), F.lit(" yrs"))),
        )
    )


def why(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, F.array_join(reasons, " | ")).otherwise("General profile relevance")
