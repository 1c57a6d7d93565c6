"""Row numbers over all rows of a group, without gathering the group in one task.

A plain window sorts a group's rows in one task, which is right where only the first k are wanted (Spark
then limits each task to its own k), but not where every row needs its number. Here a group's order is cut
by marks from a sample of fixed size; the rows between two marks are sorted and counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS, EACH = 64, 16  # marks of a group, sampled rows a mark
MOST_ROWS = 1 << 18  # of a side that is broadcast
SALTS = 16


def small(side: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The side with a broadcast hint where its counted rows are few; else as it is, for Spark to decide."""
    return F.broadcast(side) if side.count() <= most else side


def spread(rows: DataFrame, side: DataFrame, keys: list[str], tie: str, most: int = MOST_ROWS) -> DataFrame:
    """Rows with a small side's columns; where it is too large to broadcast, it is copied `SALTS` times, so that no group meets in one task."""
    if side.count() <= most:
        return rows.join(F.broadcast(side), keys)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def below(marks: Column, place: Column, most: int = CUTS * EACH) -> Column:
    """How many of the sorted marks are less than the place, in halved steps and not by a look at each; beyond twice `most` marks, that bound."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.reduce(halves, F.lit(0), lambda n, h: F.when(F.coalesce(F.get(marks, n + h - 1) < place, F.lit(False)), n + h).otherwise(n))


def numbered(rows: DataFrame, keys: list[str], score: str, tie: str, out: str, cuts: int = CUTS, most: int = MOST_ROWS) -> DataFrame:
    """Adds `out`: 1, 2, ... within `keys` by falling score, then rising tie. `rows` is read several times, so it should be stored.

    The sample of marks goes by a hash of the tie, so a task that runs again finds the same marks.
    """
    place: Column = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    chance = F.pmod(F.xxhash64(tie, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sampled = spread(rows.select(*keys, tie, place.alias("_p")), sizes, keys, tie, most).where(chance < cuts * EACH / F.col("_n"))
    listed = sampled.groupBy(*keys).agg(F.sort_array(F.collect_list("_p")).alias("_m"))
    every = F.transform(F.sequence(F.lit(1), F.size("_m"), F.lit(EACH)), lambda i: F.get("_m", i - 1))
    marks = sizes.select(*keys).join(listed, keys, "left").select(*keys, F.when(F.size("_m") > 0, every).otherwise(F.array().cast(listed.schema["_m"].dataType)).alias("_c"))
    placed = spread(rows, marks, keys, tie, most).withColumn("_b", below(F.col("_c"), place, cuts * EACH)).drop("_c")
    before = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_k"))
    so_far = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = before.select(*keys, "_b", F.coalesce(so_far, F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(F.desc(score), tie))
    held = placed.withColumn("_r", local)
    return spread(held, offsets, [*keys, "_b"], tie, most).withColumn(out, (F.col("_o") + F.col("_r")).cast("int")).drop("_b", "_o", "_r")
