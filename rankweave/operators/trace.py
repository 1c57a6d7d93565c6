"""Stage traces, isolated branches, request checks and cached answers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .ranks import numbered

#: The answer to an empty query, and the bounds of a result's length.
EMPTY_QUERY, LEAST_LIMIT, USUAL_LIMIT, MOST_LIMIT = "query is required", 1, 10, 100


class Trace:
    """Rows and milliseconds of stages. Rows are counted while a stage's plan runs, without a job of their own."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, Observation, list[float]]] = []

    def stage(self, name: str, build: Callable[[], DataFrame], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stage's result, as `run` stores it."""
        seen, start = Observation(name), time.perf_counter()
        out = run(build().observe(seen, F.count(F.lit(1)).alias("rows")))
        self.stages.append((name, seen, [round((time.perf_counter() - start) * 1000, 1)]))
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """(stage, rows, ms)"""
        return spark.createDataFrame([(n, int(o.get["rows"]), ms[0]) for n, o, ms in self.stages], "stage string, rows long, ms double")


def isolated(build: Callable[[], DataFrame], empty: DataFrame, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str | None]:
    """A branch's rows, or none and the error where its plan or its run fails, so that the other branch still answers."""
    try:
        return run(build()), None
    except Exception as e:  # whatever a branch fails by, the search goes on without it
        return empty, f"{type(e).__name__}: {e}".split("\n")[0]


def checked(requests: DataFrame, text: str = "text", limit: str = "k") -> DataFrame:
    """Adds `refused` (a reason, else null) and `limit` within its bounds."""
    reason = F.when(F.coalesce(F.col(text), F.lit("")).rlike(r"\A\s*\z"), EMPTY_QUERY)
    within = F.greatest(F.lit(LEAST_LIMIT), F.least(F.lit(MOST_LIMIT), F.coalesce(F.col(limit).cast("int"), F.lit(USUAL_LIMIT))))
    return requests.withColumn("refused", reason).withColumn("limit", within)


def cache_key(text: Column) -> Column:
    return F.md5(F.trim(F.lower(text)))


def answered(queries: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], capacity: int) -> tuple[DataFrame, DataFrame]:
    """Answers (qid, key, answer, hit) of queries (qid, text, at), and the cache (key, answer, at) after them.

    Each new text is worked out once: compute takes (key, text) and gives (key, answer). Entries keep their first
    time; beyond `capacity` the oldest go, ties by key. A repeat within the batch is a hit.
    """
    asked = queries.withColumn("key", cache_key(F.col("text")))
    new = asked.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by("text", "at").alias("text"), F.min("at").alias("at"))
    found = compute(new.select("key", "text")).join(new.select("key", "at"), "key").select("key", "answer", "at")
    known = cache.select("key", "answer", "at").unionByName(found)
    first = new.select("key", F.col("at").alias("_first"))
    out = asked.join(known.select("key", "answer"), "key").join(first, "key", "left").withColumn("hit", F.coalesce(F.col("at") > F.col("_first"), F.lit(True)))
    ranked = numbered(known.withColumn("_g", F.lit(0)), ["_g"], "at", "key", "_n")
    return out.select("qid", "key", "answer", "hit"), ranked.where(F.col("_n") <= capacity).drop("_g", "_n")


def hit_rate(answers: DataFrame) -> DataFrame:
    hits = F.count_if("hit")
    return answers.agg(hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(hits / F.count("*"), F.lit(0.0)).alias("rate"))
