"""Where queries that write may put their files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """The session's shared folder (spark.checkpoint.dir), or one set earlier; a temporary one only where neither exists and all is one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rankweave-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Work a small, much used relation out once, by a reliable checkpoint in the shared folder."""
    working_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """As settled(), for rows dealt by a key that Spark goes on to know: later groups of that key don't move. An adaptive plan doesn't tell how its rows are dealt, so this one is planned without."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return settled(df)
    finally:
        conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """Work a large relation out once, as Parquet in the shared folder. It is read back far faster than a checkpoint, and by column; how its rows were dealt is lost."""
    path = f"{working_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete the files of written() once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/written-" in f}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
