"""Connected components of a link table, on executors only.

Each round lets every node point at the smallest neighbour (large-star) and then joins a node's
smaller neighbours to the smallest of them (small-star), until nothing changes. A task first
replaces the links that it holds by a spanning forest, so rounds start from few links. Rounds are
cut with durable checkpoints, so a lost executor costs at most one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) for the links a-b; nodes that are their own least are left out."""
    nodes, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook larger roots to smaller, then halve paths
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy()))
        if len(a) > 1 << 20:
            a, b = forest(a, b)
            if len(a) > 1 << 19:  # still many trees: pass them on, the rounds below join them
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
    if len(a):
        a, b = forest(a, b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, least) for every node of `links` (a long, b long) that has a smaller node in its component."""
    now = durable(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_local, "a long, b long"))
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large-star: the larger neighbours of a node go to the least of the node and its neighbours.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small-star: a node and its smaller neighbours go to the least of them.
        low = large.where("a > b")
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = durable(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
