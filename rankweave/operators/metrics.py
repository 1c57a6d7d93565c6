"""Retrieval metrics over ranked results and relevance judgements, and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, p_at_k, r_at_k, ap, rr, ndcg) for each query with a relevant document.

    results(qid, doc_id, rank), relevant(qid, doc_id).
    """
    hits = results.where(F.col("rank") <= k).join(relevant.distinct(), ["qid", "doc_id"])
    ranks = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.col("rank").cast("long"))).alias("r"))
    total = relevant.distinct().groupBy("qid").agg(F.count("*").alias("n"))
    both = total.join(ranks, "qid", "left").withColumn("r", F.coalesce("r", F.array().cast("array<bigint>")))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ap = add(F.transform("r", lambda x, i: (i + 1) / x)) / F.least("n", F.lit(k))
    gain = add(F.transform("r", lambda x: 1 / F.log2(x + 1)))
    ideal = add(F.transform(F.sequence(F.lit(1), F.least("n", F.lit(k).cast("long"))), lambda x: 1 / F.log2(x + 1)))
    return both.select("qid", (F.size("r") / k).alias("p_at_k"), (F.size("r") / F.col("n")).alias("r_at_k"), ap.alias("ap"), F.coalesce(1 / F.get("r", F.lit(0)), F.lit(0.0)).alias("rr"), (gain / ideal).alias("ndcg"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("p_at_k", "r_at_k", "ap", "rr", "ndcg")])


def accuracy(rows: DataFrame, expected: str, got: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg((F.col(expected) == F.col(got)).cast("int")).alias("accuracy"))
