"""Change detection by a Merkle tree of bucket hashes, so that only what differs is read.

A snapshot's ledger (id, hash) is stored in folders, one a bucket of its ids, with a leaf for each bucket: the number of its rows and sums of
parts of their hashes, the same whatever their order. Inner nodes hash `FAN` children each, up to the root. Two trees are walked down
from their roots through nodes that differ; only the buckets found there are read from either ledger and joined. Leaves are few (`buckets`),
so the walk is over a bounded table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .incremental import classify, ledger

BUCKETS, FAN = 4096, 16


def write_tree(rows: DataFrame, key: str, columns: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Store the ledger of a snapshot by bucket, and its tree."""
    spark = rows.sparkSession
    held = ledger(rows, key, columns).withColumn("bucket", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(buckets)).cast("int"))
    held.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/ledger")
    stored = spark.read.schema(held.schema).parquet(f"{path}/ledger")
    h = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "hash"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long"))
    leaves = stored.groupBy("bucket").agg(F.count("*").alias("n"), *[part(i).alias(f"s{i}") for i in range(4)])
    leaf = leaves.select(F.col("bucket").alias("node"), "n", F.sha2(F.concat_ws("|", "n", *[f"s{i}" for i in range(4)]), 256).alias("hash"))
    leaf.coalesce(1).write.parquet(f"{path}/tree/level=0")
    level, width = 0, buckets
    while width > 1:
        below = spark.read.parquet(f"{path}/tree/level={level}").select("node", "n", "hash")
        above = below.groupBy(F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda s: F.concat_ws(":", s["node"], s["hash"])), "|"), 256).alias("hash"))
        level, width = level + 1, -(-width // FAN)
        above.coalesce(1).write.parquet(f"{path}/tree/level={level}")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(level, node, n, hash)"""
    return spark.read.schema("node int, n long, hash string, level int").parquet(f"{path}/tree").select("level", "node", "n", "hash")


def differing(spark: SparkSession, old: str, new: str) -> list[int]:
    """Buckets whose leaves differ, found from the roots down; children are compared only where their parents differ."""
    a, b = tree(spark, old), tree(spark, new)
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    if None in tops:  # an empty snapshot has no nodes
        return sorted(r["node"] for r in a.unionByName(b).where("level = 0").select("node").collect())
    top = max(tops)
    nodes: list[int] | None = None
    for level in range(top, -1, -1):
        pick = lambda df, name: df.where((F.col("level") == level) & (F.lit(True) if nodes is None else F.floor(F.col("node") / FAN).isin(nodes))).select("node", F.col("hash").alias(name))  # noqa: B023, E731
        both = pick(a, "x").join(pick(b, "y"), "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
        nodes = sorted(r["node"] for r in both.select("node").collect())  # at most the buckets
        if not nodes:
            return []
    return nodes


def read_buckets(spark: SparkSession, path: str, buckets: list[int], id_type: str) -> DataFrame:
    """(id, hash) of some buckets; the others' folders are not opened."""
    return spark.read.schema(f"id {id_type}, hash string, bucket int").parquet(f"{path}/ledger").where(F.col("bucket").isin(buckets)).select("id", "hash")


def changes(spark: SparkSession, old: str, new: str, id_type: str = "long") -> DataFrame:
    """(id, change) of the ids that are new, deleted or changed."""
    found = differing(spark, old, new)
    return classify(read_buckets(spark, old, found, id_type), read_buckets(spark, new, found, id_type)).where("change <> 'unchanged'")
