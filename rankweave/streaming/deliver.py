"""Delivery of changed rows to a sink that may fail row by row: retries with doubled delay, a quarantine, and replay without repeats.

Each micro-batch takes the new rows and the waiting ones that are due, hands them to `send` where they lie, and records an outcome for
each. Failed rows wait `delay`, then twice as long, and so on; after `tries` failures a row goes to the quarantine with its last error.
A newer row of a key replaces its waiting one, with all its tries before it, and takes it out of the quarantine.

Outcomes are written first, then published in one manifest with the batch's number: a batch that runs again after a crash
finds either its manifest, and does nothing, or its outcomes, and sends nothing twice; only rows whose outcomes were not yet written
are sent again, so `send` should accept a repeated row.

State, as versions under one folder: `done` (key, row, attempt, at), `waiting` (key, row, attempt, due, error) and
`quarantine` (key, row, attempt, at, error).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rankweave.sources import io

TRIES, DELAY = 3, 5.0
BETWEEN = 1_000_000_000  # numbers from one batch of a stream to the next, for batches of waiting rows only
KINDS = {"done": "attempt int, at double", "waiting": "attempt int, due double, error string", "quarantine": "attempt int, at double, error string"}


def relations(spark: SparkSession, state: str, row: str) -> dict[str, DataFrame]:
    """State by name; `row` is the DDL of a row."""
    schemas = {name: f"key string, row struct<{row}>, {rest}" for name, rest in KINDS.items()}
    if not io.manifest(spark, state):
        return {name: spark.createDataFrame([], s) for name, s in schemas.items()}
    return io.load_index(spark, state, schemas)


def attempted(rows: DataFrame, send: Callable[[dict, int], None]) -> DataFrame:
    """Adds `error`, null where `send(row, attempt)` did not fail. Rows are sent in their tasks, one by one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = []
            for row, attempt in zip(frame["row"], frame["attempt"]):
                try:
                    send(row if isinstance(row, dict) else row.asDict(), int(attempt))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 a row's failure is its outcome
                    errors.append(f"{type(error).__name__}: {error}")
            yield frame.assign(error=pd.Series(errors, dtype=object, index=frame.index))

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, error string")


def step(spark: SparkSession, fresh: DataFrame | None, number: int, row: str, key: str, state: str, send: Callable[[dict, int], None], now: float, tries: int = TRIES, delay: float = DELAY, order: str | None = None) -> bool:
    """One batch; returns whether rows are left waiting. `number` rises from batch to batch, and a number that is done changes nothing."""
    now, last = float(now), io.manifest(spark, state)
    held = relations(spark, state, row)
    if last and last["info"]["batch"] >= number:
        return not held["waiting"].isEmpty()
    path = f"{state}/outcomes-{number}"
    names = StructType.fromDDL(row).names
    if not io.exists(spark, f"{path}/_SUCCESS"):
        due = held["waiting"].where(F.col("due") <= now).select("key", "row", "attempt", F.lit(False).alias("fresh"))
        if fresh is not None:
            place = F.struct(*([F.col(order)] if order else []), F.xxhash64(*names))
            new = fresh.groupBy(F.col(key).cast("string").alias("key")).agg(F.max_by(F.struct(*names), place).alias("row"))
            due = due.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "row", F.lit(0).alias("attempt"), F.lit(True).alias("fresh")))
        attempted(due.withColumn("attempt", F.col("attempt") + 1), send).write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    ok, failed = out.where("error is null"), out.where("error is not null")
    again, over = failed.where(F.col("attempt") < tries), failed.where(F.col("attempt") >= tries)
    waits = again.select("key", "row", "attempt", (F.lit(now) + delay * F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("due"), "error")
    waiting = held["waiting"].join(out.select("key"), "key", "left_anti").unionByName(waits)
    kept = held["quarantine"].join(out.select("key"), "key", "left_anti").unionByName(over.select("key", "row", "attempt", F.lit(now).alias("at"), "error"))
    done = ok.select("key", "row", "attempt", F.lit(now).alias("at"))
    if last:
        io.save_index({"waiting": waiting, "quarantine": kept}, state, {"batch": number}, append={"done": done})
    else:
        io.save_index({"waiting": waiting, "quarantine": kept, "done": done}, state, {"batch": number})
    return not io.load_index(spark, state)["waiting"].isEmpty()


def delivered(spark: SparkSession, state: str, row: str) -> DataFrame:
    """The last delivered row of each key, with the attempt that did it."""
    best = relations(spark, state, row)["done"].groupBy("key").agg(F.max_by(F.struct("row", "attempt"), F.struct("at", F.xxhash64("row"))).alias("m"))
    return best.select("key", "m.row.*", "m.attempt")


def deliver_stream(spark: SparkSession, source: str, row: str, key: str, state: str, checkpoint: str, send: Callable[[dict, int], None], tries: int = TRIES, delay: float = DELAY, order: str | None = None, clock: Callable[[], float] = time.time) -> StreamingQuery:
    """Deliver the rows of files that arrive in a folder; what waits is tried again with the batch that finds it due."""

    def batch(df: DataFrame, number: int) -> None:
        step(df.sparkSession, df, number * BETWEEN, row, key, state, send, clock(), tries, delay, order)

    rows = spark.readStream.schema(row).parquet(source)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, row: str, key: str, state: str, send: Callable[[dict, int], None], tries: int = TRIES, delay: float = DELAY, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
    """Try what waits, each row when it is due, until nothing waits."""
    while True:
        first = relations(spark, state, row)["waiting"].agg(F.min("due").alias("due")).first()["due"]
        if first is None:
            return
        if first > clock():
            sleep(first - clock())
        step(spark, None, io.manifest(spark, state)["info"]["batch"] + 1, row, key, state, send, max(clock(), first), tries, delay)
