"""Exact deduplication with two passes over a Bloom filter, in built-in functions only.

Pass 1 hashes every text to `hashes` cells of a filter of 2**bits cells and keeps the cells that
more than one row hits. Pass 2 tests every row against these cells. A row with a cell of its own is
unique for certain and passes straight through; only rows whose cells are all hit again shuffle by
their full digest. False positives cost a shuffled row, never a wrong group.

The filter is cut into slices of at most 2**most_bits cells, 8 to 16 cells a row: a row belongs to one slice, by
other bits of its digest. Digests are stored by slice, and slices are tested one after the other, each in a job of its own
against its own cells, whose outcome is stored. So what is broadcast at a time has a fixed bound (HASHES tables of
2**most_bits / 32 words), however many slices there are, and the filter prunes as well at any size.

Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equal texts
the row with the largest id stays; a null id is smaller than any other. Of repeated rows with the
same id, all carry the id that stays, so `kept` holds for each of them; group_size counts rows.
Ties, empty and long texts need no special case; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, ascii_lower, durable, stored

MOST_BITS, HASHES, WORD = 27, 2, 5  # cells of a slice, cells a row, cells a word
SALTS = 4  # parts of a group of copies in the join; Spark splits them further where they are large


def _cell(digest: Column, i: int, bits: int) -> Column:
    """The i-th cell of a digest: its own slice of the SHA-256."""
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1))


def _tested(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Rows of a slice with _t0, _t1, ...: whether each of their cells is hit again."""
    for i in range(HASHES):
        cell = _cell(F.col("text_sha256"), i, bits)
        side = words.select(F.col("word").alias(f"_w{i}"), F.col("hits").alias(f"_h{i}"))
        rows = rows.join(F.broadcast(side), F.shiftright(cell, WORD) == F.col(f"_w{i}"), "left")
        rows = rows.withColumn(f"_t{i}", F.coalesce(F.expr(f"getbit(_h{i}, cast(conv(substring(text_sha256, {1 + 8 * i}, 8), 16, 10) as bigint) & {(1 << WORD) - 1})") == 1, F.lit(False)))
    return rows


def tested_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> tuple[DataFrame, Column]:
    """Digests with the outcome of each cell's test, and whether a row may have an equal."""
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)
    rows = durable(docs.select(F.col(key), digest.alias("text_sha256")))
    count = rows.count()
    bits = max(WORD + 1, min(most_bits, max(10, (16 * count).bit_length())))
    slices = max(1, -(-16 * count // (2 << bits)))
    if slices > 1:
        rows = stored(rows.withColumn("_slice", F.pmod(F.conv(F.substring("text_sha256", 1 + 8 * HASHES, 8), 16, 10).cast("long"), F.lit(slices)).cast("int")), by="_slice")
    else:
        rows = rows.withColumn("_slice", F.lit(0))

    cells = rows.select("_slice", F.explode(F.array(*[_cell(F.col("text_sha256"), i, bits) for i in range(HASHES)])).alias("cell"))
    again = cells.groupBy("_slice", "cell").agg(F.count("*").alias("n")).where("n > 1")
    words = again.groupBy("_slice", F.shiftright("cell", WORD).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(cell & {(1 << WORD) - 1} as int))")).alias("hits"))
    if slices > 1:
        words = stored(words, by="_slice")
        parts = (_tested(rows.where(F.col("_slice") == i), words.where(F.col("_slice") == i), bits) for i in range(slices))
        tested = appended(parts)
    else:
        tested = _tested(rows, words, bits)
    maybe = F.lit(True)
    for i in range(HASHES):
        maybe = maybe & F.col(f"_t{i}")
    return tested, maybe


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row."""
    tested, maybe = tested_rows(docs, key, text, most_bits)
    alone = tested.where(~maybe).select(key, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # Groups are counted before they meet their rows; the salt keeps both sides of the join apart, so that large groups can be split.
    shared = tested.where(maybe).select(key, "text_sha256", F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("_salt"))
    groups = shared.groupBy("text_sha256").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = shared.join(groups, ["text_sha256", "_salt"]).select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(joined)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
