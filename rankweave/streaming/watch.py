"""Change-driven maintenance with Structured Streaming: files that arrive in a folder are applied as snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankweave.operators import incremental
from rankweave.sources import io

LEDGER = "id string, hash string, at timestamp, batch long"
COMPACT = 16  # parts of a ledger before it is written anew


def ledger(spark: SparkSession, state: str) -> DataFrame:
    """The last known hash of each id."""
    if not io.manifest(spark, state):
        return spark.createDataFrame([], LEDGER)
    parts = io.load_index(spark, state)["ledger"]
    return parts.groupBy("id").agg(F.max_by(F.struct("hash", "at", "batch"), F.struct("batch", "at")).alias("m")).select("id", "m.*")


def upsert_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    key: str,
    columns: list[str],
    state: str,
    checkpoint: str,
    apply: Callable[[DataFrame, DataFrame], None],
    order: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Watch a folder of Parquet files of rows to upsert.

    Each micro-batch, which gathers all files saved since the last, keeps the latest row of each key (by `order`,
    then by a hash of the row), compares hashes with the ledger under `state`, hands (changes, rows to apply) to
    `apply`, and adds the changed hashes to the ledger; after `COMPACT` batches the ledger is written anew. A
    batch that is run again finds its hashes equal and changes nothing.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        place = F.struct(*([F.col(order)] if order else []), F.xxhash64(*df.columns))
        latest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), place).alias("own")).select("own.*")
        known = ledger(spark, state)
        now = incremental.ledger(latest, key, columns).select(F.col("id").cast("string").alias("id"), "hash")
        # A batch holds upserts only, so ids that it lacks stay as they are.
        changes = incremental.classify(known.select("id", "hash").join(now.select("id"), "id", "left_semi"), now)
        changed = changes.where("change in ('new', 'changed')").select("id")
        apply(changes, latest.join(changed, latest[key].cast("string") == changed["id"], "left_semi"))
        moved = now.join(changed, "id", "left_semi").withColumn("at", F.current_timestamp()).withColumn("batch", F.lit(number).cast("long"))
        last = io.manifest(spark, state)
        if last and len(last["relations"]["ledger"]) < COMPACT:
            io.save_index({}, state, {"batch": number}, append={"ledger": moved})
        else:
            io.save_index({"ledger": known.join(changed, "id", "left_anti").unionByName(moved)}, state, {"batch": number})

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sync_snapshot(spark: SparkSession, snapshot: DataFrame, key: str, columns: list[str], state: str, apply: Callable[[DataFrame, DataFrame], None]) -> DataFrame:
    """Apply a whole snapshot: as a batch of the stream, but ids that it lacks are deleted. Returns the changes."""
    known = ledger(spark, state)
    now = incremental.ledger(snapshot, key, columns).select(F.col("id").cast("string").alias("id"), "hash")
    changes = incremental.classify(known.select("id", "hash"), now)
    ids = changes.where("change in ('new', 'changed')").select("id")
    apply(changes, snapshot.join(ids, snapshot[key].cast("string") == ids["id"], "left_semi"))
    io.save_index({"ledger": now.withColumn("at", F.current_timestamp()).withColumn("batch", F.lit(0).cast("long"))}, state)
    return changes
