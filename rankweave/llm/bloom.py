"""Blocked Bloom filters of bounded size over 64-bit keys.

A key picks one 64-bit word by its low bits and two bits in it by its high bits. A filter of 2**bits
bits is a table of at most 2**(bits - 6) words, so it may be broadcast whatever the data's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_for(keys: int, most_bits: int, per_key: int = 32) -> int:
    return min(most_bits, max(12, (per_key * keys).bit_length()))


def fits(keys: int, most_bits: int, per_key: int = 32) -> bool:
    """Whether a filter of 2**most_bits bits holds the keys at full strength."""
    return per_key * keys <= 1 << most_bits


def word_of(key: Column, bits: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (bits - 6)) - 1))


def mask_of(key: Column) -> Column:
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, by).bitwiseAND(F.lit(63)).cast("int"))
    return bit(52).bitwiseOR(bit(58))


def words(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """The filter as (word, hits)."""
    return keys.groupBy(word_of(F.col(column), bits).alias("word")).agg(F.bit_or(mask_of(F.col(column))).alias("hits"))


def tested(rows: DataFrame, side: DataFrame, bits: int, key: str, out: str) -> DataFrame:
    """Adds `out`: whether the filter `side` (a broadcast of words()) may hold the key column; null keys are not held."""
    named = side.select(F.col("word").alias("_bw"), F.col("hits").alias("_bh"))
    hit = F.coalesce(F.col("_bh").bitwiseAND(mask_of(F.col(key))) == mask_of(F.col(key)), F.lit(False))
    return rows.join(F.broadcast(named), word_of(F.col(key), bits) == F.col("_bw"), "left").withColumn(out, hit).drop("_bw", "_bh")


def marked(rows: DataFrame, keys: DataFrame, column: str, tests: dict[str, str], most_bits: int, filler: Column) -> DataFrame:
    """Adds, for each (key column, out) of `tests`, whether `keys` may hold the key; null keys are not held.

    `keys` has different values. Where they fit a filter of 2**most_bits bits at 32 bits a key, the filter is
    broadcast and rows stay where they are; more of them are joined by key, exactly. `filler`, a hash of the
    row, then stands for null keys, lest they meet in one task.
    """
    count = keys.count()
    bits = size_for(count, most_bits)
    if 32 * count <= 1 << bits:
        side = words(keys, column, bits)
        for key, out in tests.items():
            rows = tested(rows, side, bits, key, out)
        return rows
    for key, out in tests.items():
        side = keys.select(F.col(column).alias("_bk"), F.lit(True).alias("_bt"))
        held = F.coalesce(F.col("_bt"), F.lit(False)) & F.col(key).isNotNull()
        rows = rows.join(side, F.coalesce(F.col(key), filler) == F.col("_bk"), "left").withColumn(out, held).drop("_bk", "_bt")
    return rows


class Filter:
    """The same filter as an array, for Python workers."""

    def __init__(self, keys: DataFrame, column: str, count: int, most_bits: int):
        bits = size_for(count, most_bits)
        self.table = np.zeros(1 << (bits - 6), np.uint64)
        found = words(keys, column, bits).toArrow()
        self.table[found.column("word").to_numpy()] = found.column("hits").to_numpy().view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        mask = (np.uint64(1) << ((keys >> np.uint64(52)) & np.uint64(63))) | (np.uint64(1) << (keys >> np.uint64(58)))
        return (self.table[(keys & np.uint64(len(self.table) - 1)).astype(np.int64)] & mask) == mask
