"""The best documents by BM25 without scoring every posting: postings in blocks with their largest impact, and pruning by block maxima.

An impact is what a posting adds for one unit of its term's weight (n * idf), so it is known before any query. The index numbers the
documents in order of id, cuts them into ranges of `RANGE`, and keeps a block for each range and term: its postings, and the largest impact
among them. A batch of queries then

1. adds up each range's maxima over the terms of a query, reading no posting: no document of the range scores more;
2. opens the `k` ranges of the largest sums; the k-th best score in them bounds the k-th best score of all from below; then
   those of the next `GROW * k` that reach the bound, which raises it;
3. opens the other ranges whose sum reaches the bound. All blocks of an open range are scored, so scores are exact.

Nothing that could reach the k-th place is left out: bounds are compared with a margin (`MARGIN`) that covers the rounding of scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import vocab

from .index import idf
from .lexical import saturation
from .ranks import MOST_ROWS, small

RANGE, GROW = 4, 8
MARGIN = 2e-6
EACH = 1 << 20  # postings that a task puts into blocks


def _plain(df: DataFrame) -> DataFrame:
    return df


def with_impact(post: DataFrame, corpus: DataFrame, k1: float = vocab.K1, b: float = vocab.B, delta: float = vocab.DELTA) -> DataFrame:
    """Adds u, the impact, to postings (doc_id, term, tf, dl)."""
    rows = post.crossJoin(F.broadcast(corpus.select("avgdl")))
    return rows.withColumn("u", saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b) + delta).drop("avgdl")


def range_blocks(impacts: DataFrame, size: int = RANGE, store: Callable[[DataFrame], DataFrame] = _plain, each: int = EACH) -> DataFrame:
    """(range, term, n, most, rows array<struct<doc_id, u>>) of postings (doc_id, term, u). To be stored; bounds read its first four columns only.

    Postings are dealt by range, about `each` to a task: as plain rows they take less to move than as lists, and all blocks of a
    range lie together, so sums over them are nearly complete before they move.
    """
    own = impacts.groupBy("doc_id").agg(F.count("*").alias("_n")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # Numbers of a task's rows follow each other, so a range lies in one task, and its last ranges may be shorter.
    numbered = store(own.withColumn("range", F.call_function("div", F.monotonically_increasing_id(), F.lit(size))))
    total = numbered.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    held = impacts.join(numbered.drop("_n"), "doc_id").repartition(1 + total // each, "range")
    return held.groupBy("range", "term").agg(F.count("*").alias("n"), F.max("u").alias("most"), F.collect_list(F.struct("doc_id", "u")).alias("rows"))


def wanted(blocks: DataFrame, terms: DataFrame, keys: list[str], documents: int) -> DataFrame:
    """(keys, term, w): the weight of each query term that some document holds."""
    asked = small(terms.select("term").distinct())
    counts = blocks.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    return terms.join(counts, "term").select(*keys, "term", (F.col("n") * idf(F.lit(documents), F.col("df"))).alias("w"))


def range_bounds(blocks: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, range, upper): what a document of the range can score at most."""
    return blocks.select("range", "term", "most").join(small(asked), "term").groupBy(*keys, "range").agg(F.sum(F.col("w") * F.col("most")).alias("upper"))


def opened(blocks: DataFrame, asked: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id, score, scored) of all documents of the given ranges (keys, range), and how many postings each score took.

    Few ranges go to the blocks; for many, only blocks of asked terms move, and where they are not too many, only those of such ranges.
    """
    pairs = small(ranges.select(*keys, "range").join(small(asked), keys))
    held = blocks.select("range", "term", "rows").join(small(asked.select("term").distinct()), "term", "left_semi")
    own = ranges.select("range").distinct()
    held = held.join(F.broadcast(own), "range", "left_semi") if own.count() <= MOST_ROWS else held
    parts = pairs.join(held, ["range", "term"]).select(*keys, "w", F.inline("rows"))
    return parts.groupBy(*keys, "doc_id").agg(F.sum(F.col("w") * F.col("u")).alias("score"), F.count("*").alias("scored"))


def top_k(blocks: DataFrame, terms: DataFrame, keys: list[str], k: int, documents: int, store: Callable[[DataFrame], DataFrame] = _plain) -> DataFrame:
    """(keys, doc_id, score, scored): documents of the opened ranges, among them the k best of every query and all that tie with the last.

    `blocks` should be stored; terms(keys, term, n). `store` keeps what several steps read.
    """
    asked = store(wanted(blocks, terms, keys, documents))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("upper"), "range"))
    bounds = store(range_bounds(blocks, asked, keys).withColumn("place", place))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score")))
    found, last = None, 0
    for most in (k, (1 + GROW) * k, None):
        ranges = bounds.where(F.col("place") > last) if most is None else bounds.where((F.col("place") > last) & (F.col("place") <= most))
        if found is not None:
            kth = found.withColumn("_p", best).where(F.col("_p") <= k).groupBy(*keys).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("bound"))
            ranges = ranges.join(small(store(kth)), keys).where(F.col("upper") >= F.col("bound") - MARGIN)
        part = store(opened(blocks, asked, store(ranges.select(*keys, "range")), keys))
        found, last = part if found is None else found.unionByName(part), most
    return found
