"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines that are not empty). Each paragraph is hashed
to one wide vector, and a fingerprint is the sum of the vectors:

* `LATTICE` lanes, drawn from SHAKE-128 of the paragraph, are added modulo 2**32. They decide
  equality, whatever the order of the paragraphs.
* `SKETCH` lanes hold signed counts of the paragraph's three-word shingles, added modulo 2**32.
  The cosine of two such vectors estimates the cosine of the shingle counts, so it is a likeness. A text
  of Spark has under 2**31 bytes and so fewer shingles than half the modulus: no lane of a text wraps.

Both parts are groups, so a paragraph is inserted by adding its vector and deleted by subtracting it.

Defined cases: a null text counts as empty; the empty multiset has the zero vector; two empty
texts have likeness 1, an empty and another text 0. Repeated rows are rows of their own, ordered
by (id, text); of rows with one id the first by text counts as the next document. Ids are whole
numbers; others raise an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Rolling, bounded_batches, mixed, partitions

LATTICE, SKETCH = 32, 128
SEED = 11
LEAST_KEY = -(1 << 63)
_rolling: list[Rolling] = []


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


def paragraph_vectors(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, LATTICE) uint32 and (n, SKETCH) int32 vectors of n paragraphs."""
    if not _rolling:
        _rolling.append(Rolling(SEED))
    coded = [p.encode() for p in parts]
    lattice = np.frombuffer(b"".join(hashlib.shake_128(p).digest(4 * LATTICE) for p in coded), "<u4").reshape(-1, LATTICE)
    data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    sketch = np.zeros((len(parts), SKETCH), np.int32)
    inner = np.concatenate(([False], data > 32, [False]))
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return lattice, sketch
    owner = np.searchsorted(np.cumsum([len(p) + 1 for p in coded]), start, side="right")
    # A shingle ends two words on, or at the paragraph's last word where the paragraph has fewer than three.
    first = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
    last = np.repeat(np.concatenate((first[1:], [len(owner)])) - 1, np.diff(np.concatenate((first, [len(owner)]))))
    begin = np.repeat(first, np.diff(np.concatenate((first, [len(owner)]))))
    at = np.arange(len(owner))
    keep = (at + 2 <= last) | (at == begin)
    at, stop = at[keep], np.minimum(at + 2, last)[keep]
    h = mixed(_rolling[0].between(_rolling[0].prefix(data), start[at], end[stop]))
    lane = owner[at] * SKETCH + (h >> np.uint64(40)).astype(np.int64) % SKETCH
    sign = (h & np.uint64(1)).astype(np.float64) * 2 - 1
    return lattice, np.bincount(lane, sign, len(parts) * SKETCH).astype(np.int32).reshape(-1, SKETCH)


class Fingerprint:
    """A sum of paragraph vectors; + and - combine, insert and delete."""

    def __init__(self, lattice: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.lattice = np.zeros(LATTICE, np.uint32) if lattice is None else lattice
        self.sketch = np.zeros(SKETCH, np.int32) if sketch is None else sketch.astype(np.int32)

    @classmethod
    def of(cls, text: str | None, most: int = 4096) -> Fingerprint:
        out, parts = cls(), paragraphs(text or "")
        for i in range(0, len(parts), most):
            a, b = paragraph_vectors(parts[i : i + most])
            out += cls(a.sum(0, dtype=np.uint32), b.sum(0))
        return out

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lattice + other.lattice, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lattice - other.lattice, self.sketch - other.sketch)

    def text(self) -> str:
        return base64.b64encode(self.lattice.astype("<u4").tobytes() + self.sketch.astype("<i4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Cosine of sketch rows, cut to 0..1; 1 where the lattice lanes agree (`same`)."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.where(same, 1.0, np.clip(np.divide((a * b).sum(1), norm, out=np.zeros(len(a)), where=norm > 0), 0, 1))


def fingerprint_texts(texts: list[str], budget: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Lattice and sketch lanes of many texts; a paragraph that several of them share is hashed once."""
    lattice, sketch = np.zeros((len(texts), LATTICE), np.uint32), np.zeros((len(texts), SKETCH), np.int32)
    first = 0
    while first < len(texts):
        size, last = 0, first
        while last < len(texts) and (last == first or size + len(texts[last]) <= budget):
            size += len(texts[last])
            last += 1
        if size > budget:
            one = Fingerprint.of(texts[first])
            lattice[first], sketch[first] = one.lattice, one.sketch
        else:
            known: dict[str, int] = {}
            use, owner = [], []
            for i in range(first, last):
                for p in paragraphs(texts[i]):
                    use.append(known.setdefault(p, len(known)))
                    owner.append(i - first)
            if use:
                a, b = paragraph_vectors(list(known))
                for k in range(0, len(use), 1 << 14):
                    u, o = np.array(use[k : k + (1 << 14)]), np.array(owner[k : k + (1 << 14)])
                    cut = np.concatenate(([0], np.flatnonzero(o[1:] != o[:-1]) + 1))
                    rows = first + o[cut]
                    lattice[rows] += np.add.reduceat(a[u], cut, axis=0, dtype=np.uint32)
                    sketch[rows] += np.add.reduceat(b[u], cut, axis=0).astype(np.int32)
        first = last
    return lattice, sketch


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Deal documents into ranges of ascending ids: (key, text, guest), one range a partition, sorted.

    The first rows of each range also travel to the range before it as guests, sorted last there, so
    each task sees the document that follows its own last one. What the driver holds is the range
    bounds and first ids: two numbers a partition.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key}: ids must be whole numbers, as the next document is the next id")
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST_KEY)).alias("_k"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(1, partitions(spark))
    cuts = own.agg(F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5])).first()[0] or []
    cuts = np.unique(np.array(cuts if n > 1 else [], np.int64))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    heads = sorted((r["b"], r["k"]) for r in own.select("_k").groupBy(bucket("_k").alias("b")).agg(F.min("_k").alias("k")).collect())
    full, least = np.array([b for b, _ in heads], np.int32), np.array([k for _, k in heads], np.int64)

    @F.pandas_udf("array<int>")
    def to(k: pd.Series) -> pd.Series:
        k = k.to_numpy()
        own_bucket = np.searchsorted(cuts, k, side="right")
        at = np.searchsorted(full, own_bucket)
        is_head = least[at] == k
        return pd.Series([[int(b), int(full[i - 1])] if h else [int(b)] for b, i, h in zip(own_bucket, at, is_head)])

    dealt = own.select("_k", "key", "text", F.posexplode(to("_k")).alias("guest", "bucket"))
    return dealt.repartitionById(max(1, len(cuts) + 1), "bucket").sortWithinPartitions("guest", "_k", "text").select("key", "text", "guest")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Texts move once, into id ranges; Python streams a sorted range and keeps one row back.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(keys: list, texts: list[str], following: str) -> pa.RecordBatch:
        changed = [edited(t, u) for t, u in zip(texts, [*texts[1:], following])]
        n = len(texts)
        lattice, sketch = fingerprint_texts([*texts, following, *changed])
        nxt, mine, new = slice(1, n + 1), slice(0, n), slice(n + 1, None)
        code = lambda part: [base64.b64encode(a.tobytes() + b.tobytes()).decode() for a, b in zip(lattice[part].astype("<u4"), sketch[part].astype("<i4"))]
        like = lambda part: likeness(sketch[mine], sketch[part], (lattice[mine] == lattice[part]).all(1))
        values = [keys, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], code(mine), code(new), like(new), like(nxt)]
        return pa.RecordBatch.from_arrays([pa.array(keys, keys_type[0]), *map(pa.array, values[1:])], names)

    keys_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            keys_type[:] = [batch.schema.field("key").type]
            keys, texts, guest = (batch.column(i).to_pylist() for i in range(3))
            own = sum(1 for g in guest if not g)
            if not own:
                if held is not None and guest:
                    yield rows([held[0]], [held[1]], texts[0])
                    held = None
                continue
            keys, texts, ahead = keys[:own], texts[:own], texts[own] if own < len(texts) else None
            if held is not None:
                keys.insert(0, held[0])
                texts.insert(0, held[1])
            if ahead is None:
                held = keys.pop(), texts.pop()
                ahead = held[1]
            else:
                held = None
            if keys:
                yield rows(keys, texts, ahead)

    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).mapInArrow(run, schema)
