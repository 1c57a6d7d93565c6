"""Pieces shared by the training-data operators.

Every operator takes a DataFrame and the names of its key and text columns, and
touches no other column; where it keeps them, they travel in one struct, so extra
columns with clashing names are harmless.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Characters whose lower case may differ, other than A-Z; unassigned ones are included because libraries disagree on them.
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]"

#: Byte table that lower-cases A-Z only.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() has a fast path, so it serves wherever it changes nothing more."""
    only_ascii = F.octet_length(col) == F.length(col)
    return F.when(only_ascii | ~col.rlike(OTHER_UPPER), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once a row; Spark would else repeat it wherever, and in lambdas as often as, it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Keep Arrow batches small, by rows and by bytes, so that long texts do not add up in a Python worker.

    The session's settings are lowered where they are larger, as they are read when the plan runs.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for durable data (spark.checkpoint.dir); a temporary one only where none is set and all is one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write Parquet in the shared folder, one folder a value of `by` where given, and read it again."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(parts: Iterable[DataFrame]) -> DataFrame:
    """Write tables of one schema one after the other, each by a job of its own, and read them as one."""
    path = None
    for df in parts:
        path = path or f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of stored() once nothing reads them any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/stored-", 1)[0] + "/stored-" + f.rsplit("/stored-", 1)[1].split("/")[0] for f in df.inputFiles() if "/stored-" in f}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder.

    spark.checkpoint.dir is read from the session. Files go when the table does, where the
    session sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def weighed(side: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text of a side, by a job; a side that is used again should be stored first."""
    texts = [F.octet_length(f"`{f.name}`") for f in side.schema if f.dataType.simpleString() in ("string", "binary")]
    size = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0).cast("long"))
    found = side.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return found["n"], found["b"]


def small(side: DataFrame, rows: int = 1 << 18, size: int = 32 << 20) -> bool:
    """Whether a side is few enough rows and bytes to be broadcast, by counting it."""
    n, b = weighed(side)
    return n <= rows and b <= size


def beside(rows: DataFrame, side: DataFrame, keys: list[str], tie: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """Rows with a side's columns: broadcast where the counted side is small, else copied to `salts` keys, so that no group meets in one task."""
    if small(side):
        return rows.join(F.broadcast(side), keys, how)
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int")).join(copies, [*keys, "_salt"], how).drop("_salt")


def train_split(key: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(key.cast("string")), F.lit(0)) % 4 != 2


def hash_fraction(key: Column, seed: int) -> Column:
    """A deterministic number in [0, 1) for a row, for bounded samples that a rerun repeats."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def whole(key: Column, kind: str) -> Column:
    """A key as a 64-bit number: itself where it is one, else its hash; null is the least."""
    number = key.cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    return F.when(key.isNull(), F.lit(-(1 << 63))).otherwise(number)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets, without a copy; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges whose bytes stay near `most`; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any substring of a byte string, from one prefix pass.

    A random 64-bit value stands for each byte and the base is odd, so that it has an inverse.
    """

    def __init__(self, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.values = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(draw.integers(1 << 40, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            full = np.full(n, self.base & (2**64 - 1), np.uint64)
            full[0] = 1
            self.powers = np.multiply.accumulate(full)
            full[1:] = np.uint64(self.inverse)
            self.inverses = np.multiply.accumulate(full)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverses[start]
