"""Language identification with string kernels.

A text's features are the byte n-grams of 1 to 4 bytes that occur in it, once each (a blended
spectrum of presences), hashed to `DIMENSIONS`; digits and A-Z are folded. The kernel of two texts
is the number of n-grams that they share over the root of the product of their numbers. `landmarks`
training texts give the Nyström approximation; one-versus-rest ridge regression on its features
gives a matrix from landmarks to languages. A batch of texts is scored by two matrix products.

Training: about `sample` rows (a documented bound), spread evenly over the languages by a hash of
the id; their packed features, a fixed number of bytes a row, are all that reaches the driver.

Defined cases: a null text or one without a letter gets `und` and score 0; with nothing to learn
from, every text does. Ties between languages go to the first by name. Repeated rows get equal
results. Long texts are read whole: those over `PART` bytes in parts, lest they fill all slots, and
their score is the mean of their parts', each weighted by its number of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import LOWER_BYTES, bounded_batches, hash_fraction, slices, text_buffers

DIMENSIONS, ORDERS = 8192, 4
SAMPLE, LANDMARKS, RIDGE, SHARPNESS = 3000, 160, 0.05, 4.0
PART = 1 << 15  # bytes of a text that are scored at once
#: How bytes are read: A-Z as a-z, digits as one.
FOLDED = LOWER_BYTES.copy()
FOLDED[48:58] = 48
STEP = np.uint32(0x9E3779B1)
HAS_LETTER = regex.compile(r"\p{L}")
HAS_ASCII_LETTER = regex.compile(r"[A-Za-z]")


def presences(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, DIMENSIONS) uint8: which hashed n-grams occur in each text."""
    n = len(offsets) - 1
    out = np.zeros(n * DIMENSIONS, np.uint8)
    if len(data):
        size = np.diff(offsets)
        base = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, size)
        left = np.repeat(offsets[1:], size) - np.arange(len(data))  # bytes to the end of the text
        h = np.zeros(len(data), np.uint32)
        folded = FOLDED[data].astype(np.uint32)
        for k in range(ORDERS):
            h = h[: len(data) - k] * np.uint32(257) + folded[k:] + np.uint32(1)
            slot = base[: len(h)] + ((h * STEP) >> np.uint32(19))
            out[slot[left[: len(h)] > k] if k else slot] = 1
    return out.reshape(n, DIMENSIONS)


def fit(rows: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict | None:
    """Landmark features, and the matrix from kernel values to one score a language."""
    if not len(rows):
        return None
    names = sorted(set(langs))
    target = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    seen: dict[str, int] = {}
    rank = []
    for x in langs:  # landmarks take turns between the languages
        rank.append(seen.get(x, 0))
        seen[x] = rank[-1] + 1
    order = np.lexsort((np.arange(len(langs)), rank))
    chosen = rows[order[:landmarks]].astype(np.float32)
    chosen /= np.sqrt(np.maximum(chosen.sum(1, keepdims=True), 1))
    x = rows.astype(np.float32)
    kernel = (x @ chosen.T / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))).astype(np.float64)
    value, vector = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    share = 1.0 / np.array([langs.count(name) for name in names])  # languages weigh alike
    weight = (share[[names.index(x) for x in langs]] * len(langs) / len(names))[:, None]
    gram = phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, phi.T @ (target * weight))
    return {"landmarks": chosen, "matrix": (root @ solved[:-1]).astype(np.float32), "bias": solved[-1].astype(np.float32), "names": names}


def scores(model: dict, rows: np.ndarray) -> np.ndarray:
    """Softmax over the one-versus-rest values of presence rows."""
    x = rows.astype(np.float32)
    kernel = x @ model["landmarks"].T / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    raw = SHARPNESS * (kernel @ model["matrix"] + model["bias"])
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def long_scores(model: dict, data: np.ndarray) -> np.ndarray:
    """Scores of one text in parts, which overlap so that each n-gram is in one."""
    out, total = np.zeros(len(model["names"])), 0.0
    for a in range(0, len(data), PART):
        part = data[a : a + PART + ORDERS - 1]
        row = presences(part, np.array([0, len(part)]))
        weight = float(row.sum())
        out, total = out + weight * scores(model, row)[0], total + weight
    return out / total


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", usable: Column | None = None, sample: int = SAMPLE) -> dict | None:
    """Fit on rows of `docs` where `usable` holds and lang and text are not null: about `sample`, a share of each language by a hash of the id."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if usable is None else usable))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang).cast("string")).count().collect()}
    if not counts:
        return None
    each = sample / len(counts)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            packed = [row.tobytes() for a, b in slices(at, 1 << 20) for row in np.packbits(presences(data[at[a] : at[b]], at[a : b + 1] - at[a]), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["h", "lang", "bits"])

    h = hash_fraction(F.col(key), 101)
    picked = rows.select(h.alias("h"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("h") < share[F.col("lang")])
    found = sorted(picked.mapInArrow(run, "h double, lang string, bits binary").collect())
    bits = np.frombuffer(b"".join(bytes(r[2]) for r in found), np.uint8).reshape(len(found), -1)
    return fit(np.unpackbits(bits, axis=1), [r[1] for r in found])


def identify(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row; no shuffle."""
    found = identified(docs.select(F.struct(key).alias("own"), F.col(text).alias("text")), model)
    return found.select(F.col(f"own.`{key}`"), "lang_pred", "score")


def identified(rows: DataFrame, model: dict | None, field: str | None = None) -> DataFrame:
    """(own, lang_pred, score) of rows (own struct, text): what `own` holds is carried along, whatever its fields' names.

    The text may be a field of `own`; then it moves once.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = rows.schema["own"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            col = batch.column(0).field(field) if field else batch.column(1)
            data, at = text_buffers(col)
            names, best = [], []
            for a, b in slices(at, 1 << 19):
                for c in range(a, b, 128):
                    d = min(b, c + 128)
                    part = data[at[c] : at[d]]
                    here = [False] * (d - c)
                    if own is not None:
                        here = [lettered(t.as_py()) for t in col[c:d]]
                        size = np.diff(at[c : d + 1])
                        if size.max() <= PART:
                            s = scores(own, presences(part, at[c : d + 1] - at[c]))
                        else:
                            s = np.empty((d - c, len(own["names"])), np.float32)
                            short = size <= PART
                            ends = np.concatenate(([0], np.cumsum(size[short])))
                            s[short] = scores(own, presences(part[np.repeat(short, size)], ends))
                            for i in np.flatnonzero(~short):
                                s[i] = long_scores(own, data[at[c + i] : at[c + i + 1]])
                        top = s.argmax(1)
                        names += [own["names"][k] if ok else "und" for k, ok in zip(top, here)]
                        best += [float(v) if ok else 0.0 for v, ok in zip(s.max(1), here)]
                    else:
                        names += ["und"] * (d - c)
                        best += [0.0] * (d - c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())], ["own", "lang_pred", "score"])

    out = StructType([StructField("own", kind), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.select("own", *([] if field else ["text"])).mapInArrow(run, out)


def lettered(text: str | None) -> bool:
    return text is not None and bool(HAS_ASCII_LETTER.search(text) or HAS_LETTER.search(text))
