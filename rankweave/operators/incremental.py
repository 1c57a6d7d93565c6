"""Change detection by row hashes, and incremental maintenance of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str], length: int | None = None, separator: str = "|") -> Column:
    """SHA-256 of the columns in order of their names, null as empty; `length` cuts the hex digits."""
    joined = F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns)])
    full = F.sha2(joined, 256)
    return F.substring(full, 1, length) if length else full


def ledger(rows: DataFrame, key: str, columns: list[str], length: int | None = None) -> DataFrame:
    """(id, hash) of every row."""
    return rows.select(F.col(key).alias("id"), row_hash(columns, length).alias("hash"))


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): new, deleted, changed or unchanged, by one full outer join of two ledgers."""
    a = old.select("id", F.col("hash").alias("_a"))
    b = new.select("id", F.col("hash").alias("_b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "changed").otherwise("unchanged")
    return a.join(b, "id", "full_outer").select("id", change.alias("change"))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row that is the same for any order of the rows: their number and sums of parts of their hashes."""
    h = F.md5(row_hash(columns))
    part = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")
    return rows.agg(F.count("*").alias("n"), F.sum(part(0)).alias("a"), F.sum(part(1)).alias("b"))


def new_keys(incoming: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return incoming.join(known.select(key), key, "left_anti")


def deleted_keys(incoming: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return known.join(incoming.select(key), key, "left_anti")


def apply_delta(old: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """A relation without rows of changed or deleted ids, with the fresh rows of new and changed ones."""
    gone = changes.where(F.col("change").isin("changed", "deleted")).select(F.col("id").alias(key))
    return old.join(gone, key, "left_anti").unionByName(fresh)


def adjust_term_stats(df: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(term, df) after postings went and came, from the delta alone; terms without documents go."""
    change = removed.groupBy("term").agg((-F.count("*")).alias("d")).unionByName(added.groupBy("term").agg(F.count("*").alias("d")))
    moved = change.groupBy("term").agg(F.sum("d").alias("d"))
    out = df.join(moved, "term", "full_outer").select("term", (F.coalesce("df", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("long").alias("df"))
    return out.where("df > 0")


def touched(incoming: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Incoming rows that are new or changed."""
    return incoming.join(changes.where(F.col("change").isin("new", "changed")).select(F.col("id").alias(key)), key, "left_semi")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` under other keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def removed(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def get_many(store: DataFrame, wanted: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """A store's rows for each wanted key; what is missing or null has its default."""
    return wanted.select(key).join(store, key, "left").na.fill(defaults)
