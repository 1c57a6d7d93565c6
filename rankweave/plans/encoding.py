"""Views of the driver's tables as profiles and a property graph.

A customer is a candidate; a part's name that they bought in quantities of 40 and more is a skill,
with a level by the largest quantity; a part's type is a role that the skill belongs to; the three
most frequent companions of a skill are its relations; the market segment is the role that a customer
suits; the span of their orders is their experience. SQL is the same encoding for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import index
from rankweave.sources.io import table

LEVEL_STEPS = [(50, 2.0, "Expert"), (48, 1.7, "Advanced"), (46, 1.5, "Proficient"), (44, 1.2, "Competent"), (42, 1.0, "Intermediate")]
LOWEST = (0.5, "Beginner")


def has_skill(spark: SparkSession, sf: str) -> DataFrame:
    """(cid, skill, weight, level)"""
    lines = table(spark, sf, "lineitem").where("l_quantity >= 40").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    bought = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    best = bought.groupBy(F.col("o_custkey").alias("cid"), F.col("p_name").alias("skill")).agg(F.max("l_quantity").alias("q"))
    weight, level = F.lit(LOWEST[0]), F.lit(LOWEST[1])
    for least, w, name in reversed(LEVEL_STEPS):
        weight, level = F.when(F.col("q") >= least, w).otherwise(weight), F.when(F.col("q") >= least, name).otherwise(level)
    return best.select("cid", "skill", weight.alias("weight"), level.alias("level"))


def cells(spark: SparkSession, sf: str, held: DataFrame | None = None) -> DataFrame:
    """(cid, cell): skills as text such as `blue anvil (Expert), red bolt (Basic)`."""
    item = F.concat("skill", F.lit(" ("), "level", F.lit(")"))
    return (has_skill(spark, sf) if held is None else held).groupBy("cid").agg(F.array_join(F.sort_array(F.collect_list(item)), ", ").alias("cell"))


def skill_rows(spark: SparkSession, sf: str, held: DataFrame | None = None) -> DataFrame:
    return (has_skill(spark, sf) if held is None else held).select(F.col("cid").alias("doc_id"), "skill", "weight")


def edges(spark: SparkSession, sf: str, held: DataFrame | None = None) -> DataFrame:
    """(edge_id, type, src, dst)"""
    near = index.related(index.cooccurrence(skill_rows(spark, sf, held)), 3).select("src", "dst")
    belongs = table(spark, sf, "part").select(F.col("p_name").alias("src"), F.col("p_type").alias("dst")).distinct()
    one = lambda df, mark, kind: df.select(F.concat(F.lit(mark), "src", F.lit(">"), "dst").alias("edge_id"), F.lit(kind).alias("type"), "src", "dst")
    return one(near, "R:", "RELATED_TO").unionByName(one(belongs, "B:", "BELONGS_TO"))


def suitable(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("cid"), F.col("c_mktsegment").alias("role"))


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """(cid, name, years, roles)"""
    span = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cid")).agg((F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")) / 365.25).alias("years"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("cid"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("roles")).join(span, "cid", "left")


HAS_SKILL_SQL = """hs AS (
  SELECT o_custkey AS cid, p_name AS skill, max(l_quantity) AS q,
    CAST(CASE WHEN max(l_quantity) >= 50 THEN 2.0 WHEN max(l_quantity) >= 48 THEN 1.7 WHEN max(l_quantity) >= 46 THEN 1.5
         WHEN max(l_quantity) >= 44 THEN 1.2 WHEN max(l_quantity) >= 42 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS weight,
    CASE WHEN max(l_quantity) >= 50 THEN 'Expert' WHEN max(l_quantity) >= 48 THEN 'Advanced' WHEN max(l_quantity) >= 46 THEN 'Proficient'
         WHEN max(l_quantity) >= 44 THEN 'Competent' WHEN max(l_quantity) >= 42 THEN 'Intermediate' ELSE 'Beginner' END AS level
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_quantity >= 40 GROUP BY o_custkey, p_name)"""
EDGES_SQL = """co AS (SELECT a.skill AS s1, b.skill AS s2, count(*) AS w FROM hs a JOIN hs b ON a.cid = b.cid AND a.skill <> b.skill GROUP BY a.skill, b.skill),
rel AS (SELECT s1 AS src, s2 AS dst FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY w DESC, s2) AS rn FROM co) WHERE rn <= 3),
edges AS (
  SELECT 'R:' || src || '>' || dst AS edge_id, 'RELATED_TO' AS type, src, dst FROM rel
  UNION ALL SELECT DISTINCT 'B:' || p_name || '>' || p_type, 'BELONGS_TO', p_name, p_type FROM part)"""
PROFILES_SQL = """prof AS (
  SELECT c_custkey AS cid, c_name AS name, c_mktsegment AS role, y.years
  FROM customer LEFT JOIN (SELECT o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / CAST(365.25 AS DOUBLE) AS years FROM orders GROUP BY o_custkey) y ON c_custkey = o_custkey)"""
