"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `window` bytes, and only as far as it takes to know
which are equal there: passes go from the most significant digit down, each digit is a hash, and a
group of one leaves after each pass. What is left in a group at the full depth is a repeated window.

To keep rows few, passes run on ranges of suffixes instead of single ones. The first digit of a
suffix is the least (by hash) of the `GRAM`-byte strings in its window, an anchor that all equal
windows share at the same place, so neighbouring suffixes with one anchor form one range:

* pass 1: ranges with one anchor. An anchor that occurs once ends its range. Where the range's
  whole bytes occur again, all its windows do.
* pass 2: the undecided ranges in blocks of `STEP` windows, counted from the anchor. The digit is the
  bytes that all windows of a block hold; a block whose whole bytes occur again is repeated.
* pass 3: the windows of the blocks that are still undecided, at full depth.

This gives the groups of the sort of single suffixes. Each digit is a function of the window alone (its anchor and the
anchor's place; the part that its block shares; all its bytes), and each fixes the one before, so groups are only
split further from pass to pass, and equal windows are never parted: that is the order of the digits from the
most significant one down. A row stands for a run of suffixes with one digit. It leaves early in two cases, both of which
settle every suffix of the run: its digit occurs once (no window of it can repeat), or all bytes that the run's windows
hold occur again as a whole (then each of its windows does). Groups are compared for equality only, as their
order among themselves has no part in the result.

Digits are compared by 64-bit polynomial hashes, two independent ones for a decision to remove.
Counts are aggregated before rows meet, so a string in a third of all texts is no hot group.

Every pass scans the texts where they lie and finds the ranges anew, and emits those that may still
matter: first those whose anchor occurs again, then those left open. Counts on what was emitted decide.
Which these are is told in one of two ways, with equal results and, but for a few false positives, equal rows:

* as many keys as a Bloom filter of 2**`most_bits` bits holds at 32 bits a key (4 million) are broadcast as one, so hashes
  and places move, and texts only once, to meet their spans at the end;
* more of them (some gigabytes of text on) are joined. Keys that occur again meet the emitted rows by key before these are
  written, salted where one is hot. Open ranges are gathered to their text, whose own ranges bound the list, and only
  texts that have some move to meet them. No filter fills up, nothing that grows with the data is broadcast, and a pass writes
  rows for what is open alone, at any size.

Defined cases: null counts as empty; texts shorter than the window keep all bytes; matches never
cross texts; a string that overlaps itself counts; repeated rows are texts of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Filter, fits
from .common import Rolling, bounded_batches, durable, mixed, text_buffers, whole

WINDOW, GRAM, STEP = 400, 64, 16
CHUNK = 1 << 20  # windows of a long text that are anchored at once
MOST_BITS = 27  # of a filter
SALTS = 4
PLACE = np.uint64((1 << 24) - 1)
COLUMNS = ["core", "outer", "id", "_k", "row", "lo", "hi"]
ROWS = "core long, outer long, id long, _k long, row long, lo int, hi int"
_hashes: list[Rolling] = []


def hashes() -> list[Rolling]:
    if not _hashes:
        _hashes.extend((Rolling(5), Rolling(6)))
    return _hashes


def anchored(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """Ranges lo..hi of window starts that share an anchor, the anchors' places and hashes, and the ranges' whole-byte hashes."""
    count = len(data) - window + 1
    if count <= 0:
        return None
    one, two = hashes()
    p, q = one.prefix(data), two.prefix(data)
    found = []
    for base in range(0, count, CHUNK):
        n = min(CHUNK, count - base)
        width = window - gram + 1
        starts = np.arange(base, base + n + width - 1)
        h = mixed(one.between(p, starts, starts + gram))
        packed = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(h) // width)
        grid = np.full(rows * width, np.uint64(2**64 - 1))
        grid[: len(h)] = packed
        grid = grid.reshape(rows, width)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[:n], left[width - 1 : width - 1 + n])
        lo = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        hi = np.concatenate((lo[1:], [n])) - 1
        at = (least[lo] & PLACE).astype(np.int64)
        found.append((lo + base, hi + base, at + base, h[at]))
    lo, hi, at, core = (np.concatenate(x) for x in zip(*found))
    return lo, hi, at, core, mixed(two.between(q, lo, hi + window))


def blocks(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, core: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Pass 2: blocks of STEP windows that meet the ranges, each once; returns lo, hi, core, outer."""
    one, two = hashes()
    p, q = one.prefix(data), two.prefix(data)
    first, last = (at - hi) // STEP, (at - lo) // STEP
    size = last - first + 1
    at, core = np.repeat(at, size), np.repeat(core, size)
    t = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    _, once = np.unique(at * 1024 + t, return_index=True)
    at, core, t = at[once], core[once], t[once]
    near = at - STEP * t  # the block's last start; its first is STEP - 1 before
    lo, hi = np.maximum(near - STEP + 1, 0), np.minimum(near, len(data) - window)
    digit = mixed(one.between(p, near, near - STEP + 1 + window) + core + t.astype(np.uint64))
    return lo, hi, digit, mixed(two.between(q, lo, hi + window) + (hi - lo).astype(np.uint64))


def windows(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Pass 3: single windows, each once; returns lo, hi, core, outer."""
    one, two = hashes()
    p, q = one.prefix(data), two.prefix(data)
    size = hi - lo + 1
    at = np.unique(np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum()))
    return at, at, mixed(one.between(p, at, at + window)), mixed(two.between(q, at, at + window))


def range_ids(key: int, row: int, depth: int, lo: np.ndarray, core: np.ndarray) -> np.ndarray:
    seed = np.array([key, row], np.int64).view(np.uint64)
    base = mixed(mixed(seed[:1]) + seed[1:] + np.uint64(depth))
    return mixed(base + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + core)


class Listed:
    """The same question as to a filter, answered by the list of keys itself."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return np.isin(keys.view(np.int64), self.keys)


def ranges(data: np.ndarray, key: int, row: int, depth: int, filters: list[Filter | Listed | None], window: int = WINDOW) -> tuple[np.ndarray, ...] | None:
    """(core, outer, id, lo, hi) of a text's ranges at a depth; filters are those of the anchors, of the open ranges above, and of windows that occur again. None lets all through."""
    got = anchored(data, window)
    if got is None:
        return None
    lo, hi, at, core, outer = got
    if filters and filters[0] is not None:
        use = filters[0].holds(core)
        lo, hi, at, core, outer = lo[use], hi[use], at[use], core[use], outer[use]
    ids = range_ids(key, row, 1, lo, core)
    if depth > 1 and len(lo):
        use = filters[1].holds(ids)
        if not use.any():
            return None
        lo, hi, core, outer = blocks(data, lo[use], hi[use], at[use], core[use], window)
        ids = range_ids(key, row, 2, lo, core)
    if depth > 2 and len(lo):
        use = filters[2].holds(ids)
        if not use.any():
            return None
        lo, hi, core, outer = windows(data, lo[use], hi[use], window)
        if len(filters) > 3 and filters[3] is not None:
            use = filters[3].holds(core)
            lo, hi, core, outer = lo[use], hi[use], core[use], outer[use]
        ids = range_ids(key, row, 3, lo, core)
    return (core, outer, ids, lo, hi) if len(lo) else None


def keep_bytes(data: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside the spans lo..end, how many went, and in how many runs."""
    if not len(lo):
        return data.tobytes(), 0, 0
    edge = np.bincount(lo, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
    return data[~gone].tobytes(), int(gone.sum()), runs


def _decided(rows: DataFrame) -> DataFrame:
    """Rows whose core occurs again, with `same`: whether core and outer do, and `open`: whether the next pass needs the row.

    It needs what is not `same`, and one row of each class that is, as a witness for the others.
    """
    salted = lambda column: F.pmod(F.col(column), F.lit(SALTS))
    salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))
    # Classes are counted before rows meet them; with the salt both sides of each join move, so Spark may split what is hot.
    classes = rows.groupBy("core", "outer").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    totals = classes.groupBy("core").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("core", (F.col("kinds") > 1).alias("differ"), salts.alias("salt"))
    marked = classes.withColumn("salt", salted("outer")).join(totals, ["core", "salt"]).select("core", "outer", F.when(F.col("n") > 1, F.col("first")).alias("first"), "differ", salts.alias("salt"))
    both = rows.withColumn("salt", salted("id")).join(marked, ["core", "outer", "salt"])
    same = F.col("first").isNotNull()
    return both.select(*COLUMNS, same.alias("same"), (F.col("differ") & (~same | (F.col("first") == F.col("id")))).alias("open"))


def _by_text(levels: list[DataFrame]) -> DataFrame:
    """(_k, row, open): for each text with open ranges at the last level, the lists of its open ids at each level."""
    rows = levels[0].withColumn("level", F.lit(0))
    for i, level in enumerate(levels[1:], 1):
        rows = rows.unionByName(level.withColumn("level", F.lit(i)))
    lists = [F.collect_set(F.when(F.col("level") == i, F.col("id"))) for i in range(len(levels))]
    return rows.groupBy("_k", "row").agg(F.array(*lists).alias("open")).where(F.size(F.element_at("open", -1)) > 0)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """(_k, row, lo, hi): ranges of window starts, by key and text hash, whose windows all occur again."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(whole(F.col(key), docs.schema[key].dataType.simpleString()).alias("_k"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))

    def emit(depth: int, filters: list[Filter | None], only_cores: bool = False) -> DataFrame:
        texts_of = opened[-1][1] if opened else None
        by_text = any(f is None for f in filters[1:3])
        source = own.join(_by_text([rows for rows, _ in opened]), ["_k", "row"]).select("_k", "row", "text", "open") if by_text else own
        shared = spark.sparkContext.broadcast((filters, None if by_text else texts_of))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = text_buffers(batch.column(2))
                out: list[list[np.ndarray]] = [[] for _ in COLUMNS]
                own_filters, open_texts = shared.value
                keys, rows = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for i in np.flatnonzero(open_texts.holds(rows)) if open_texts is not None else range(len(rows)):
                    k, row = keys[i], int(rows[i])
                    use = own_filters
                    if by_text:
                        lists = [Listed(x.values.to_numpy()) for x in batch.column(3)[i].values]
                        use = [None, *lists, *own_filters[3:]]
                    got = ranges(data[at[i] : at[i + 1]], k, row, depth, use, window)
                    if got is None:
                        continue
                    core, outer, ids, lo, hi = got
                    if only_cores:
                        out[0].append(core.view(np.int64))
                        continue
                    for o, x in zip(out, (core.view(np.int64), outer.view(np.int64), ids.view(np.int64), np.full(len(lo), k, np.int64), np.full(len(lo), row, np.int64), lo.astype(np.int32), hi.astype(np.int32))):
                        o.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out if o], COLUMNS[:1] if only_cores else COLUMNS)

        return source.mapInArrow(run, "core long" if only_cores else ROWS)

    def repeated(depth: int, filters: list[Filter | None]) -> DataFrame:
        """Rows of a depth whose core occurs again; adds the filter of these cores, or None where they are joined."""
        again = durable(emit(depth, filters, True).groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
        count = again.count()
        filters.append(Filter(again, "core", count, most_bits) if fits(count, most_bits) else None)
        rows = emit(depth, filters)
        if filters[-1] is not None:
            return durable(rows)
        copies = again.select("core", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"))
        return durable(rows.withColumn("salt", F.pmod("id", F.lit(SALTS))).join(copies, ["core", "salt"], "left_semi").drop("salt"))

    def add_open(decided: DataFrame) -> None:
        """The open ranges, as a filter with one of the texts that hold some, or as a table to be joined."""
        rows = decided.where("open").select("_k", "row", "id")
        count = rows.count()
        room = fits(count, most_bits)
        filters.append(Filter(rows, "id", count, most_bits) if room else None)
        opened.append((rows, Filter(rows, "row", count, most_bits) if room else None))

    opened: list[tuple[DataFrame, Filter | None]] = []
    filters: list[Filter | None] = []
    first = durable(_decided(repeated(1, filters)))
    add_open(first)
    second = durable(_decided(durable(emit(2, filters))))
    add_open(second)
    third = _decided(repeated(3, filters))
    columns = ["_k", "row", "lo", "hi"]
    return first.where("same").select(*columns).unionByName(second.where("same").select(*columns)).unionByName(third.where("same").select(*columns))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept binary) of every row."""
    spans = repeated_spans(docs, key, text, window, most_bits).groupBy("_k", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).select(F.col("_k").alias("_j"), F.col("row").alias("_row"), F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(whole(F.col(key), docs.schema[key].dataType.simpleString()).alias("_k"), F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("row"))
    joined = own.join(spans, (F.col("_k") == F.col("_j")) & (F.col("row") == F.col("_row")), "left").select("key", "text", "lo", "hi")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            out = []
            for i, (lo, hi) in enumerate(zip(batch.column(2), batch.column(3))):
                part = data[at[i] : at[i + 1]]
                none = np.zeros(0, np.int64)
                kept, gone, runs = keep_bytes(part, lo.values.to_numpy() if lo.is_valid else none, hi.values.to_numpy() + window if hi.is_valid else none)
                out.append((len(part), gone, runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            n, gone, runs, sha, kept = zip(*out) if out else ([],) * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return joined.mapInArrow(finish, schema)
