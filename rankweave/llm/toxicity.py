"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are the character n-grams of `ORDERS` lengths (A-Z lower-cased, runs of other ASCII characters
read as one blank) that occur in a text, once each, hashed to 2**BITS slots. From a labelled sample,
r = log of the ratio of the smoothed shares of toxic and other texts that hold an n-gram. Every n-gram
whose ratio lies more than `MERIT` standard errors from zero is kept, however many these are, and a
logistic regression is fitted on presence times r, as a sparse matrix. Its threshold is moved so that a
score of 0.3 is where F1 is best on left-out folds.

Training: at most about `sample` labelled rows, half of each class (the documented bound); what reaches
the driver is a fixed number of count vectors and, for each row, the kept n-grams that it holds, of
which there are at most 2**BITS whatever the texts' lengths.

Defined cases: a null or empty text has no n-grams and gets the score of the intercept; without
both labels in the training rows every score is 0; rows with several labels train with each of them;
repeated rows get equal scores. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bounded_batches, hash_fraction, slices, text_buffers

BITS, ORDERS = 20, (4, 5, 6)
SAMPLE, THRESHOLD = 6000, 0.3
MERIT = 1.0  # standard errors
GATHER = 8  # tasks that count n-grams of the sample
#: Letters and characters beyond ASCII stand for themselves, anything else is a blank.
FOLDED = LOWER_BYTES.copy()
FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 32


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters, each as the number that its UTF-8 bytes spell, and the texts' offsets in them."""
    wide = data.astype(np.uint32)
    if not len(data) or data.max() < 128:
        return wide, offsets
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(lead)
    size = np.diff(np.append(at, len(data)))
    out = wide[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] = out[more] << np.uint32(8) | wide[at[more] + k]
    return out, np.concatenate(([0], np.cumsum(lead)))[offsets]


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of folded texts, each text between two blanks, with runs of blanks made one."""
    data, offsets = characters(data, offsets)
    n = len(offsets) - 1
    padded = np.insert(np.where(data < 128, FOLDED[data & 127], data), np.concatenate((offsets[:-1], offsets[1:])), 32) if n else np.zeros(0, np.uint32)
    at = offsets + 2 * np.arange(n + 1)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    keep[at[:-1]] = True
    return padded[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def slots(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashed n-gram that starts at each character, and whether it lies within its text."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    h = np.zeros(len(data), np.uint32)
    for k in range(max(ORDERS)):
        h = h[: max(0, len(data) - k)] * np.uint32(0x01000193) + data[k:]
        if k + 1 in ORDERS:
            x = h ^ (h >> np.uint32(15))
            x = (x + np.uint32(k)) * np.uint32(0x85EBCA6B)
            yield x >> np.uint32(32 - BITS), left[: len(h)] > k


def presence_pairs(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each n-gram with wanted[slot], once a text."""
    data, offsets = fold(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64) << BITS, np.diff(offsets))
    found = []
    for slot, inside in slots(data, offsets):
        use = np.flatnonzero(wanted[slot] & inside)
        found.append(owner[use] | slot[use])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


class Sparse:
    """Rows' features, each with its column's scale, and a last column of ones, as a sparse matrix held once by row and once by column."""

    def __init__(self, features: list[np.ndarray], scale: np.ndarray):
        n, self.scale = len(features), np.append(scale, 1.0)
        size = np.array([len(f) + 1 for f in features])
        self.starts = np.cumsum(size) - size
        self.columns = np.concatenate([x for f in features for x in (f, [len(scale)])]).astype(np.int32)
        self.rows = np.repeat(np.arange(n, dtype=np.int32), size)[np.argsort(self.columns, kind="stable")]
        held = np.bincount(self.columns, minlength=len(self.scale))
        self.used = np.flatnonzero(held)
        self.column_starts = (np.cumsum(held) - held)[self.used]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat((w * self.scale)[self.columns], self.starts)

    def sums(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.scale))
        out[self.used] = np.add.reduceat(r[self.rows], self.column_starts)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        return self.sums(r) * self.scale


def logistic(x: Sparse, y: np.ndarray, use: np.ndarray, l2: float, start: np.ndarray | None = None, tolerance: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept, of the rows in `use`, by Newton steps whose systems conjugate gradients solve, scaled by the diagonal.

    The fit ends where the gradient has fallen to `tolerance` of what it is at zero weights.
    """
    w = np.zeros(len(x.scale)) if start is None else start.copy()
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        p = sigmoid(x.times(w))
        grad = x.back(use * (p - y)) + penalty * w
        curve = use * np.maximum(p * (1 - p), 1e-6)
        diagonal = x.sums(curve) * x.scale**2 + penalty
        return grad, curve, diagonal, float(np.sqrt(grad @ grad))

    first = slopes(np.zeros_like(w))[-1]
    for _ in range(60):
        rest, curve, diagonal, steep = slopes(w)
        if steep <= tolerance * first:
            break
        step = np.zeros_like(w)
        way = rest / diagonal
        size = rest @ way
        least = size * 1e-2
        for _ in range(50):
            if size <= least or size == 0:
                break
            hw = x.back(curve * x.times(way)) + penalty * way
            a = size / (way @ hw)
            step += a * way
            rest = rest - a * hw
            scaled = rest / diagonal
            new = rest @ scaled
            way, size = scaled + new / size * way, new
        w -= step
    return w


def sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability where weighted F1 is largest."""
    order = np.argsort(-p)
    hit, all_ = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (y * weight).sum())
    k = int(f1.argmax())
    after = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + after) / 2, 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, merit: float = MERIT) -> dict | None:
    """Fit on labelled rows: `labels` holds (key, label), already cut down to what may be learnt from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    given = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    counts = {r[0]: r[1] for r in given.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, sample / 2 / counts[1])).otherwise(min(1.0, sample / 2 / counts[0]))
    # The sample is bounded, so it may be broadcast to the texts, which then do not move; both sides of the join are bounded by it.
    picked = given.where(hash_fraction(F.col("k"), 303) < share)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(picked), "k").select("k", "y", "text").repartition(GATHER)
    every = np.ones(1 << BITS, bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((2, 1 << BITS), np.uint32), [0, 0]
        for batch in batches:
            data, at = text_buffers(batch.column(2))
            y = np.array(batch.column(1).to_pylist())
            for a, b in slices(at, 1 << 20):
                owner, slot = presence_pairs(data[at[a] : at[b]], at[a : b + 1] - at[a], every)
                for c in (0, 1):
                    df[c] += np.bincount(slot[y[a + owner] == c], minlength=1 << BITS).astype(np.uint32)
            n = [n[0] + int((y == 0).sum()), n[1] + int((y == 1).sum())]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["n0", "n1", "df"])

    df, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in rows.mapInArrow(count, "n0 long, n1 long, df binary").toLocalIterator():
        df += np.frombuffer(r["df"], np.uint32).reshape(2, -1)
        n += r["n0"], r["n1"]
    if not n.all():
        return None
    ratio = np.log((df[1] + 1) / (n[1] + 2)) - np.log((df[0] + 1) / (n[0] + 2))
    seen = df.sum(0)
    spread = np.sqrt(1 / (df[1] + 1) + 1 / (df[0] + 1))
    chosen = np.flatnonzero((seen >= max(3, 0.002 * n.sum())) & (np.abs(ratio) > merit * spread))
    if not len(chosen):
        return None
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(2))
            out = []
            for a, b in slices(at, 1 << 20):
                owner, slot = presence_pairs(data[at[a] : at[b]], at[a : b + 1] - at[a], wanted)
                out += [x.astype(np.int32).tobytes() for x in np.split(np.searchsorted(chosen, slot), np.searchsorted(owner, np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(out, pa.binary())], ["k", "y", "x"])

    found = sorted((r[0], r[1], bytes(r[2])) for r in rows.mapInArrow(held, "k string, y int, x binary").collect())
    y = np.array([r[1] for r in found], float)
    x = Sparse([np.frombuffer(r[2], np.int32) for r in found], ratio[chosen])
    weight = np.where(y == 1, counts[1] / n[1], counts[0] / n[0])
    best = (np.inf, 1.0, 0.5, None)
    fold_of = np.arange(len(y)) % 3
    fits: list[np.ndarray | None] = [None] * 3  # a fold's fit starts from that of the penalty before, and the whole fit from the folds' mean
    for l2 in (10.0, 1.0):
        p = np.zeros(len(y))
        for f in range(3):
            test = fold_of == f
            fits[f] = logistic(x, y, (~test).astype(float), l2, fits[f])
            p[test] = sigmoid(x.times(fits[f]))[test]
        loss = -(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum()
        if loss < best[0]:
            best = loss, l2, best_threshold(p, y, weight), np.mean(fits, axis=0)
    w = logistic(x, y, np.ones(len(y)), best[1], best[3])
    table = np.zeros(1 << BITS, np.float32)
    table[chosen] = w[:-1] * ratio[chosen]
    move = np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(best[2] / (1 - best[2]))
    return {"table": table, "wanted": table != 0, "bias": float(w[-1] + move)}


def score_documents(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row; no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            score = np.zeros(len(batch.column(1)))
            if own is not None:
                for a, b in slices(at, 1 << 20):
                    owner, slot = presence_pairs(data[at[a] : at[b]], at[a : b + 1] - at[a], own["wanted"])
                    raw = np.bincount(owner, own["table"][slot], b - a) + own["bias"]
                    score[a:b] = sigmoid(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [key, "score", "predicted"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
