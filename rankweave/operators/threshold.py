"""Fusion of a lexical and a dense ranking by a threshold algorithm: the best fused rows, without a row for every pair.

Both rankings are read to a depth only. A document that neither has sent has larger ranks than the depth in both, which bounds its fused score;
once the k-th best fused score of the documents seen lies above that bound, no other can enter, else the depth grows. Ranks
of seen documents are exact: a pass over each ranking counts, batch by batch where the rows lie, how many rows come before each of them,
so what leaves a task is one number for each seen document.

Only documents that a query's words meet can pass the gate (their lexical score is over 0), so the seen ones without any are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from rankweave.functions import vocab

from . import dense
from .fusion import reciprocal_ranks
from .ranks import small

GROW = 4
MOST_SEEN = 200_000  # seen documents of a batch of queries that are counted by the threshold algorithm; deeper ones rank all pairs


class Before:
    """Counts, for the candidates of each query, the rows that precede them by falling score, then rising id."""

    def __init__(self, candidates: dict[object, tuple[np.ndarray, np.ndarray]]):
        self.candidates = candidates
        self.counts = {q: np.zeros(len(ids), np.int64) for q, (ids, _) in candidates.items()}

    def add(self, query: object, ids: np.ndarray, scores: np.ndarray) -> None:
        own, at = self.candidates[query]
        n = len(own)
        # Candidates come before an equal row, which is the same document.
        order = np.lexsort((np.repeat([0, 1], [n, len(ids)]), np.concatenate([own, ids]), -np.concatenate([at, scores])))
        mine = order < n
        self.counts[query][order[mine]] += np.cumsum(~mine)[mine]

    def rows(self, names: pa.Schema) -> pa.RecordBatch:
        columns = [[], [], []]
        for q, (ids, _) in self.candidates.items():
            for c, values in zip(columns, ([q] * len(ids), ids.tolist(), self.counts[q].tolist())):
                c += values
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, names)], schema=names)


def _collected(seen: DataFrame, score: str) -> dict[object, tuple[np.ndarray, np.ndarray]]:
    """Seen documents by query; at most MOST_SEEN of them."""
    held = seen.select("qid", "doc_id", score).toArrow().to_pandas()
    return {q: (g["doc_id"].to_numpy(), g[score].to_numpy(float)) for q, g in held.groupby("qid")}


def _kinds(like: DataFrame) -> tuple[StructType, pa.Schema]:
    kind = StructType([like.schema["qid"], like.schema["doc_id"], StructField("before", LongType())])
    return kind, to_arrow_schema(kind)


def _places(counted: DataFrame, name: str) -> DataFrame:
    return counted.groupBy("qid", "doc_id").agg((F.sum("before") + 1).alias(name))


def places_among(rows: DataFrame, seen: DataFrame, score: str, name: str) -> DataFrame:
    """(qid, doc_id, name): the rank of each seen document among all rows (qid, doc_id, score) of its query."""
    kind, arrow = _kinds(seen)
    shared = rows.sparkSession.sparkContext.broadcast(_collected(seen, score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = Before(shared.value)
        for batch in batches:
            qids, ids, scores = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for q in set(qids.tolist()) & shared.value.keys():
                at = qids == q
                before.add(q, ids[at], scores[at].astype(float))
        yield before.rows(arrow)

    return _places(rows.select("qid", "doc_id", score).mapInArrow(run, kind), name)


def places_by_product(queries: DataFrame, vectors: DataFrame, seen: DataFrame, score: str, name: str, places: int) -> DataFrame:
    """The same among all vectors by their rounded, clipped product with the query; products stay in their task."""
    kind, arrow = _kinds(seen)
    out = None
    for names, matrix in dense.blocks(queries.select("qid", "qvec"), "qvec"):
        qids = names.column(0).to_pylist()
        found = _collected(seen.where(F.col("qid").isin(qids)), score)
        shared = vectors.sparkSession.sparkContext.broadcast(({q: matrix[i] for i, q in enumerate(qids)}, found))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=matrix.shape[1]) -> Iterator[pa.RecordBatch]:
            asked, found = shared.value
            before = Before(found)
            for batch in batches:
                ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                for q in found:
                    before.add(q, ids, np.round(np.clip(rows @ asked[q], 0.0, 1.0), places))
            yield before.rows(arrow)

        part = vectors.where(F.size("vec") == matrix.shape[1]).select("doc_id", "vec").mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return _places(out, name)


def seen_at(depth: int, queries: DataFrame, vectors: DataFrame, hits: DataFrame, places: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, doc_id, bm25, dense): documents among the first `depth` of either ranking that a query's words meet."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25"), "doc_id"))
    lexical = hits.withColumn("_p", place).where(F.col("_p") <= depth).select("qid", "doc_id")
    near = dense.top_k(queries, vectors, depth, places=places, clip=True).select("qid", "doc_id")
    pairs = store(hits.join(small(lexical.unionByName(near).distinct()), ["qid", "doc_id"], "left_semi").select("qid", "doc_id", "bm25"))
    products = dense.scores(queries, vectors.join(small(pairs.select("doc_id").distinct()), "doc_id", "left_semi"))
    return store(pairs.join(products, ["qid", "doc_id"]).select("qid", "doc_id", "bm25", F.round(dense.clipped(F.col("score")), places).alias("dense")))


def fused_top(queries: DataFrame, vectors: DataFrame, hits: DataFrame, k: int, adjust: Callable[[DataFrame], DataFrame], most: float, weights: dict[str, float] | None = None, places: int = 6, store: Callable[[DataFrame], DataFrame] = lambda df: df, depth: int | None = None) -> DataFrame:
    """Rows (qid, doc_id, bm25, dense, rank_bm25, rank_dense, rrf, fused) that hold the k best by `fused` of each query, fused > 0.

    queries(qid, qvec), vectors(doc_id, vec), hits(qid, doc_id, bm25 > 0) of documents that have a vector, stored. `adjust` adds `fused`, at most
    `most` times rrf, and may use the query's best dense score as _best; it works row by row.
    """
    weights = weights or {"bm25": vocab.ALPHA_BM25, "dense": vocab.ALPHA_DENSE}
    longest = hits.groupBy("qid").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    best = store(dense.top_k(queries, vectors, 1, places=places, clip=True).select("qid", F.col("score").alias("_best")))
    depth = depth or k
    while True:
        seen = seen_at(depth, queries, vectors, hits, places, store)
        if seen.count() > MOST_SEEN:
            every = dense.scores(queries, vectors).select("qid", "doc_id", F.round(dense.clipped(F.col("score")), places).alias("dense")).join(hits, ["qid", "doc_id"], "left").na.fill(0.0, ["bm25"])
            return adjust(reciprocal_ranks(store(every), weights).join(best, "qid")).where("bm25 > 0 and fused > 0").drop("_best")
        ranked = seen.join(places_among(hits, seen, "bm25", "rank_bm25"), ["qid", "doc_id"]).join(places_by_product(queries, vectors, seen, "dense", "rank_dense", places), ["qid", "doc_id"])
        rrf = F.lit(weights["bm25"]) / (vocab.RRF_K + F.col("rank_bm25")) + F.lit(weights["dense"]) / (vocab.RRF_K + F.col("rank_dense"))
        found = store(adjust(ranked.withColumn("rrf", rrf).join(best, "qid")).drop("_best").where("fused > 0"))
        if depth >= longest:
            return found
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("fused")))
        kth = found.withColumn("_p", place).where(F.col("_p") == k).select("qid", F.col("fused").alias("_k"))
        unseen = most * sum(weights.values()) / (vocab.RRF_K + depth + 1)
        open_ = hits.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > depth).join(kth, "qid", "left").where(F.coalesce("_k", F.lit(0.0)) <= unseen + 1e-9)
        if open_.isEmpty():
            return found
        depth *= GROW
