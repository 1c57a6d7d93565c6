"""SimHash near-duplicates with pigeonring filtering.

A text's words (A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`) give shingles of `width` words; each is hashed
with XXH64 (seed 42); bit b of the fingerprint is set if it is set in over half of the hashes.
Fingerprints with at most `radius` differing bits are linked, and components of links are classes.

Candidates come from the pigeonring: with the 64 bits on a ring of `SEGMENTS` segments, some start
has, for every length l, at most l * radius / SEGMENTS differences in the l segments from it. Its
first two segments are then equal, and of the next three at most one differs by at most one bit; so
the fingerprints agree in four whole segments, which is the key that is joined (24 keys each).
Pairs under a key must pass the whole chain from its start before the Hamming distance is taken.

Only different fingerprints are compared, so copies cost nothing. Under a key, a task links what it
holds block by block and passes on a spanning forest, never all pairs; keys with over `BLOCK`
fingerprints are dealt to several tasks, one for each pair of blocks.

Defined cases: no words (null, empty, blank) give fingerprint zero, linked like any other; fewer
words than `width` are one shingle; repeats count; repeated rows are rows of one class; the class is
named by its least id, null only if all its ids are null. Long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded_batches, durable
from .components import components, forest

SEGMENTS, RADIUS, BLOCK = 8, 3, 2048
WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWERED = str.maketrans(UPPER, LOWER)
#: Segments of each key, its start first: the two after the start, and two of the three beyond.
KEYS = [(s, tuple((s + d) % SEGMENTS for d in (0, 1, *two))) for s in range(SEGMENTS) for two in combinations((2, 3, 4), 2)]


def fingerprint(text: str | None, width: int = 3) -> int:
    words = WORDS.findall((text or "").translate(LOWERED) if not (text or "").isascii() else text.lower()) if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [" ".join(words)]
    else:
        shingles = list(map(" ".join, zip(*(words[i:] for i in range(width)))))
    hash_ = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(shingles)
    for i in range(0, n, 1 << 14):
        h = np.array([hash_(s, 42) for s in shingles[i : i + (1 << 14)]], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp) of every row, fp as a signed 64-bit number; no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def _segment(fps: np.ndarray, s: int) -> np.ndarray:
    return (fps >> np.uint64(56 - 8 * s)) & np.uint64(255)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        keys = []
        for i, (_, parts) in enumerate(KEYS):
            k = np.full(len(fps), i, np.uint64)
            for s in parts:
                k = (k << np.uint64(8)) | _segment(fps, s)
            keys.append(k.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fps.view(np.int64), len(KEYS)))], ["key", "fp"])


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether pairs pass every prefix of the chain from `start`, and then the Hamming check."""
    x = a ^ b
    total = np.zeros(len(x), np.int64)
    alive = np.arange(len(x))
    for l in range(SEGMENTS):
        shift = (56 - 8 * ((start[alive] + l) % SEGMENTS)).astype(np.uint64)
        total[alive] += np.bitwise_count((x[alive] >> shift) & np.uint64(255))
        alive = alive[total[alive] * SEGMENTS <= (l + 1) * radius]
    ok = np.zeros(len(x), bool)
    ok[alive] = np.bitwise_count(x[alive]) <= radius
    return ok


def link_groups(group: np.ndarray, key: np.ndarray, side: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups (equal, adjacent `group` values): pairs of sides 0 and 1, or all where a group has side 0 only."""
    out_a, out_b = [], []
    start = np.array([s for s, _ in KEYS])[(key.view(np.uint64) >> np.uint64(32)).astype(np.int64)]
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((cut, [len(group)])))
    within = np.arange(len(group)) - np.repeat(cut, size)
    whole = np.repeat(np.maximum.reduceat(side, cut) == 0, size)
    left = np.repeat(size, size) - within - 1
    far = 1
    rows = np.flatnonzero(left >= 1)
    while len(rows):  # partners 1, 2, 3, ... rows on, for all groups at once
        other = rows + far
        use = whole[rows] | (side[rows] != side[other])
        r, o = rows[use], other[use]
        ok = linked(fps[r], fps[o], start[r])
        out_a.append(fps[r[ok]])
        out_b.append(fps[o[ok]])
        if sum(map(len, out_a)) > 1 << 19:
            a, b = forest(np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64))
            out_a, out_b = [a.view(np.uint64)], [b.view(np.uint64)]
        far += 1
        rows = rows[left[rows] >= far]
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, cell, side, fp) rows to links; a group that a batch cuts is held back."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(4)])
        rows += batch.num_rows
        if rows < 1 << 16:
            continue
        now = [np.concatenate(x) for x in zip(*held)]
        other = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        held, rows = [[x[last:] for x in now]], 0
        if last:
            yield _links(*(x[:last] for x in now))
    if held and sum(len(x[0]) for x in held):
        yield _links(*(np.concatenate(x) for x in zip(*held)))


def _links(key: np.ndarray, cell: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
    a, b = link_groups(group, key, side, fp.view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints that join all within the radius into the right components."""
    keyed = fps.select("fp").distinct().mapInArrow(_keyed, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(sizes, "key")
    # A key with over `block` fingerprints is cut into blocks; each pair of blocks is a cell of its own.
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct((F.least(c, F.col("mine")) * F.col("blocks") + F.greatest(c, F.col("mine"))).alias("cell"), F.when(c < F.col("mine"), 1).otherwise(0).alias("side")))
    )
    dealt = rows.withColumn("blocks", blocks).withColumn("mine", mine).select("key", "fp", F.inline(cells))
    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "side").select("key", "cell", "side", "fp").mapInArrow(_link, "a long, b long")


def _classed(rows: DataFrame, own: Column) -> DataFrame:
    """(fp, own, least) of every fingerprint: the least `own` of its rows, and its class."""
    class_of = components(links(rows)).withColumnRenamed("node", "fp")
    return rows.groupBy("fp").agg(F.min(own).alias("own")).join(class_of, "fp", "left").withColumn("least", F.coalesce("least", "fp"))


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, row, copies) of one document of each class: the least id that is not null, then the least text hash.

    Classes are told apart by their fingerprints, so texts that share an id, or have none, stay classes of their
    own. `copies` counts the rows of that id and text.
    """
    keyed = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("row")).alias("_own"), text)
    rows = durable(fingerprints(keyed, "_own", text, width))
    kept = _classed(rows, F.col("_own")).groupBy("least").agg(F.min("own").alias("own"))
    copies = rows.groupBy(F.col("_own").alias("own")).agg(F.count("*").alias("copies"))
    return kept.join(copies, "own").select("own.key", "own.row", "copies")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) of every row."""
    rows = durable(fingerprints(docs, key, text, width))
    groups = _classed(rows, F.col(key))
    named = groups.groupBy("least").agg(F.min("own").alias("component_id"))
    of_fp = durable(groups.join(named, "least").select("fp", "component_id"))
    return rows.join(of_fp, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
