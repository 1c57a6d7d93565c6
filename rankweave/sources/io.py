"""Sources and sinks: tables, CSV, JSON, reference lists, versioned index folders, ledgers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions import text as X
from rankweave.functions.schema import PROFILE


@dataclass(frozen=True)
class Locations:
    """Where an engine instance keeps its data."""

    index: str
    profiles: str

    @classmethod
    def of(cls, settings: Mapping[str, str], home: str) -> Locations:
        """From settings INDEX_DIR and PROFILES_PATH, else below a home folder."""
        return cls(settings.get("INDEX_DIR") or f"{home}/index", settings.get("PROFILES_PATH") or f"{home}/profiles")


def settings_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a file of NAME=value lines; comments and other lines are left out, the last of a name counts."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.ltrim(F.col("value"), F.lit("\ufeff")), r"\r?\n")).alias("at", "line"))
    line = F.trim("line")
    own = lines.where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("="))).select("at", F.trim(F.substring_index(line, "=", 1)).alias("name"), F.trim(F.substring(line, F.instr(line, "=") + 1, F.length(line))).alias("value"))
    return own.groupBy("name").agg(F.max_by("value", "at").alias("value"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str = PROFILE) -> DataFrame:
    """A CSV with a header under a given schema; rows without any value and without an id are left out."""
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"').na.drop(how="all")
    return rows.withColumn("id", X.normal_id(F.col("id"))).where(F.col("id").isNotNull()) if "id" in rows.columns else rows


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet relation, or an empty one of the schema where the folder does not exist."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def reference_list(spark: SparkSession, path: str, pattern: str = r"^\*\s+(.+)$") -> DataFrame:
    """(name): distinct items of a text list, one a line."""
    found = F.regexp_extract(F.trim("value"), pattern, 1)
    return spark.read.text(path).select(F.trim(found).alias("name")).where("name <> ''").distinct()


def reference_headings(spark: SparkSession, path: str, level: str = "##") -> DataFrame:
    """(name): distinct headings of exactly a level; a closing count of skills is cut."""
    line = F.trim("value")
    name = F.trim(F.regexp_replace(F.trim(F.substring(line, F.lit(len(level) + 2), F.length(line))), r"\s*\(\d+\s+skills\)\s*-?$", ""))
    rows = spark.read.text(path).where(F.startswith(line, F.lit(level + " ")))
    return rows.select(name.alias("name")).where("name <> ''").distinct()


def reference_skills(spark: SparkSession, path: str) -> DataFrame:
    """(name): distinct bullet items of two characters or more; a closing (…) is cut."""
    line = F.trim("value")
    name = F.trim(F.regexp_replace(F.trim(F.substring(line, F.lit(3), F.length(line))), r"\s*\([^)]*\)\s*$", ""))
    return spark.read.text(path).where(F.startswith(line, F.lit("* "))).select(name.alias("name")).where(F.length("name") >= 2).distinct()


def canonical_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """(kind, key, name) of all lists, keys in lower case; of names with one key the smallest."""
    out = None
    for kind, df in lists.items():
        part = df.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min(F.trim("name")).alias("name")).select(F.lit(kind).alias("kind"), "key", "name")
        out = part if out is None else out.unionByName(part)
    return out


def append_new(found: DataFrame, known: DataFrame, path: str) -> None:
    """Append names whose key is not known."""
    new = found.select(F.lower(F.trim("name")).alias("key"), F.trim("name").alias("name")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    new.select(F.concat(F.lit("* "), "name").alias("value")).write.mode("append").text(path)


def _written(spark: SparkSession, path: str, body: str) -> bool:
    """A new small file that appears whole or, where one of that name is there already, not at all."""
    fs, where = _files(spark, path)
    temporary = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    stream = fs.create(temporary, True)
    stream.write(bytearray(body.encode()))
    stream.close()
    done = not fs.exists(where) and fs.rename(temporary, where)
    if not done:
        fs.delete(temporary, False)
    return done


def save_index(relations: dict[str, DataFrame], path: str, info: dict | None = None, append: dict[str, DataFrame] | None = None, kind: str = "parquet") -> int:
    """Write all relations as a new version, then publish its manifest; readers see the old or the new version whole.

    Manifests carry their version in their names and are never replaced; the last one counts. `append` adds
    rows to relations of the version before without writing those again.
    """
    spark = next(iter((relations or append).values())).sparkSession
    old = manifest(spark, path) or {"version": 0, "relations": {}}
    version = old["version"] + 1
    folder = f"v{version}-{uuid.uuid4().hex[:8]}"
    held = {}
    for name, df in (relations | (append or {})).items():
        df.write.format(kind).option("header", True).save(f"{path}/{folder}/{name}")
        held[name] = (old["relations"].get(name, []) if append and name in append else []) + [folder]
    kept = {n: f for n, f in old["relations"].items() if append and n not in held}
    if not _written(spark, f"{path}/manifest-{version:010d}.json", json.dumps({"version": version, "relations": kept | held, "kind": kind, "info": info or {}})):
        raise OSError(f"{path}: version {version} has been published by another writer")
    return version


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The last published manifest."""
    fs, where = _files(spark, f"{path}/manifest-*.json")
    found = sorted(str(f.getPath().toString()) for f in (fs.globStatus(where) or []))
    return json.loads(spark.read.text(found[-1], wholetext=True).first()[0]) if found else None


def load_index(spark: SparkSession, path: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Relations of the published version; those that it lacks are empty, where a schema is given."""
    found = manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path}: no index")
    def read(name: str, folders: list[str]) -> DataFrame:
        paths = [f"{path}/{folder}/{name}" for folder in folders]
        return spark.read.parquet(*paths) if found["kind"] == "parquet" else spark.read.csv(paths, header=True, schema=(schemas or {})[name])

    out = {name: read(name, folders) for name, folders in found["relations"].items()}
    return out | {name: spark.createDataFrame([], s) for name, s in (schemas or {}).items() if name not in out}


def lookup(rows: DataFrame, metadata: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with their metadata."""
    return rows.join(metadata, key, "left")
