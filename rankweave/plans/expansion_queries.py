"""Queries of vocabularies, aliases, variants and service answers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import vocab
from rankweave.operators import fuzzy, understand
from rankweave.sources.io import table

from . import encoding
from .encoding import HAS_SKILL_SQL
from .folders import settled
from .sql import quote, values

#: Aliases of words of part types, one of which gives another's name.
NAME_ALIASES = {"economy": "cheap good", "good": "fine", "standard": "usual", "promo": "offered", "large": "big"}


def vocabulary_union(spark: SparkSession, sf: str) -> DataFrame:
    """Words of part names, part types, brands and nations in one dictionary; the first list that has a term names its kind."""
    parts = table(spark, sf, "part")
    lists = [("word", parts.select(F.explode(F.split("p_name", " ")).alias("term"))), ("name", parts.select(F.col("p_name").alias("term"))), ("type", parts.select(F.col("p_type").alias("term"))), ("brand", parts.select(F.col("p_brand").alias("term")))]
    lists += [("nation", table(spark, sf, "nation").select(F.col("n_name").alias("term")).unionByName(parts.select(F.upper("p_name").alias("term"))))]
    return understand.dictionary(lists)


VOCABULARY_SQL = """WITH e AS (SELECT unnest(string_split(p_name, ' ')) AS term, 0 AS place, 'word' AS kind FROM part UNION ALL SELECT p_name, 1, 'name' FROM part UNION ALL SELECT p_type, 2, 'type' FROM part
  UNION ALL SELECT p_brand, 3, 'brand' FROM part UNION ALL SELECT n_name, 4, 'nation' FROM nation UNION ALL SELECT upper(p_name), 4, 'nation' FROM part)
SELECT lower(trim(term)) AS term, arg_min(kind, place) AS kind FROM e WHERE trim(term) <> '' GROUP BY 1"""


def parse_people(spark: SparkSession, sf: str) -> DataFrame:
    """One query text a customer, parsed with the skills and roles of the tables as vocabularies."""
    held = settled(encoding.has_skill(spark, sf))
    listed = held.groupBy("cid").agg(F.array_join(F.sort_array(F.collect_list("skill")), ", ").alias("l"))
    texts = listed.join(encoding.suitable(spark, sf), "cid").select(F.col("cid").alias("qid"), F.concat(F.lit("Senior people who know "), "l", F.lit(" for "), F.initcap("role"), F.lit(" with 7 years")).alias("text"))
    same = lambda df, c: df.select(F.lower(c).alias("term"), F.lower(c).alias("canonical")).distinct()
    kinds = {"shelter": ["building"], "goods": ["furniture", "machinery"], "transport": ["automobile"]}
    p = understand.parse(texts, same(held, "skill"), same(encoding.suitable(spark, sf), "role"), kinds)
    return p.select("qid", F.array_join("skills", ",").alias("skills"), "role", "domain", "years", F.size("negated").alias("negated"))


PARSE_PEOPLE_SQL = f"""WITH {HAS_SKILL_SQL} SELECT cid AS qid, string_agg(skill, ',' ORDER BY skill) AS skills, lower(any_value(c_mktsegment)) AS role,
  CASE lower(any_value(c_mktsegment)) WHEN 'building' THEN 'shelter' WHEN 'furniture' THEN 'goods' WHEN 'machinery' THEN 'goods' WHEN 'automobile' THEN 'transport' END AS domain, '7' AS years, CAST(0 AS INTEGER) AS negated
FROM hs JOIN customer ON cid = c_custkey GROUP BY cid"""


def alias_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases in texts of part types and names, longer ones first; what one gives, a later one may change again."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Need "), "p_type", F.lit(", "), "p_name", F.lit("; good economyx")).alias("t"))
    return parts.select("p_partkey", understand.replace_aliases(F.col("t"), NAME_ALIASES).alias("text"))


def _aliased(expr: str) -> str:
    for name in sorted(NAME_ALIASES, key=lambda a: (-len(a.split()), -len(a), a)):
        expr = f"regexp_replace({expr}, '\\b{name}\\b', {quote(NAME_ALIASES[name])}, 'gi')"
    return expr


ALIAS_SQL = "SELECT p_partkey, " + _aliased("'Need ' || p_type || ', ' || p_name || '; good economyx'") + " AS text FROM part"


def negated_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Each skill of a customer as a variant; those with a negated word go, and a query without any left stands for itself."""
    held = settled(encoding.has_skill(spark, sf))
    variants = held.select(F.col("cid").alias("qid"), F.lit(2).alias("ord"), F.col("skill").alias("query"), F.lit("synonym").alias("strategy"))
    parsed = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("text"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("e"))).otherwise(F.array(F.lit("anvil"), F.lit("ge"))).alias("negated"))
    return understand.without_negated(variants, parsed)


NEGATED_SQL = f"""WITH {HAS_SKILL_SQL}, k AS (SELECT cid, skill FROM hs WHERE CASE WHEN cid % 3 = 0 THEN NOT contains(skill, 'e') ELSE NOT contains(skill, 'anvil') AND NOT contains(skill, 'ge') END)
SELECT cid AS qid, CAST(2 AS INTEGER) AS ord, skill AS query, 'synonym' AS strategy FROM k UNION ALL SELECT c_custkey, 1, lower(c_name), 'original' FROM customer WHERE c_custkey NOT IN (SELECT cid FROM k)"""


def _people(spark: SparkSession, sf: str, skills: list[str]) -> DataFrame:
    """Parsed queries, one a customer, each with one of the given skills."""
    people = table(spark, sf, "customer")
    skill = F.get(F.array(*map(F.lit, skills)), (F.col("c_custkey") % len(skills)).cast("int"))
    rows = people.select(F.col("c_custkey").alias("qid"), skill.alias("s"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).alias("role"), F.when(F.col("c_custkey") % 5 == 0, F.lit("senior")).alias("band"))
    return rows.select("qid", F.concat(F.lit("need "), "s", F.lit(" people")).alias("text"), F.array("s").alias("skills"), "role", "band")


RELATED, ALIASED = sorted(vocab.RELATIONS), sorted(vocab.SKILL_ALIASES)


def relation_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences from the fixed relations of skills."""
    return understand.relation_variants(_people(spark, sf, RELATED))


RELATION_SQL = f"""WITH {values("r", "i, skill, a, b, c", [(i, s, *(list(vocab.RELATIONS[s][:3]) + [None, None])[:3]) for i, s in enumerate(RELATED)])},
p AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS role, r.* FROM customer JOIN r ON c_custkey % {len(RELATED)} = i)
SELECT qid, CAST(200 AS INTEGER) AS place, 'candidate skilled in ' || concat_ws(', ', skill, a, b, c) AS query, 'kg_static' AS strategy FROM p
UNION ALL SELECT qid, 201, role || ' with ' || skill || ' and ' || a || ' experience', 'kg_static' FROM p WHERE role IS NOT NULL AND a IS NOT NULL"""


def synonym_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a skill replaced by its first two aliases."""
    return understand.synonym_variants(_people(spark, sf, ALIASED))


SYNONYM_VARIANTS_SQL = f"""WITH {values("r", "i, n, skill, alias", [(i, n, s, a) for i, s in enumerate(ALIASED) for n, a in enumerate(vocab.SKILL_ALIASES[s][:2])])}
SELECT c_custkey AS qid, CAST(100 + n AS INTEGER) AS place, 'need ' || alias || ' people' AS query, 'synonym' AS strategy FROM customer JOIN r ON c_custkey % {len(ALIASED)} = i WHERE alias <> skill"""


def skill_variants(spark: SparkSession, sf: str) -> DataFrame:
    """One query a skill, where no service decomposes queries."""
    return understand.skill_variants(_people(spark, sf, RELATED))


SKILL_VARIANTS_SQL = f"""WITH {values("r", "i, skill", list(enumerate(RELATED)))} SELECT c_custkey AS qid, CAST(250 AS INTEGER) AS place, trim(skill || ' developer ' || CASE WHEN c_custkey % 5 = 0 THEN 'senior' ELSE '' END) AS query, 'decomposition' AS strategy
FROM customer JOIN r ON c_custkey % {len(RELATED)} = i"""


def variants_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Standard variants of each customer, then related ones; a repeated one keeps its first place."""
    top = encoding.has_skill(spark, sf).groupBy("cid").agg(F.sort_array(F.collect_list("skill")).alias("standard"))
    rows = top.select("cid", "standard", F.when(F.col("cid") % 3 > 0, F.array(F.get("standard", F.lit(0)), F.lit("more"))).alias("related"))
    return rows.select("cid", F.array_join(understand.concatenated(F.col("standard"), F.col("related")), ",").alias("variants"))


CONCAT_SQL = f"""WITH {HAS_SKILL_SQL} SELECT cid, string_agg(skill, ',' ORDER BY skill) || CASE WHEN cid % 3 > 0 THEN ',more' ELSE '' END AS variants FROM hs GROUP BY cid"""


def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """The exclusion filter of each customer; empty parts are null."""
    k = F.col("c_custkey")
    own = understand.exclusions(F.when(k % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")), F.when(k % 3 == 0, F.lit("remote")))
    return table(spark, sf, "customer").select("c_custkey", own.alias("e")).select("c_custkey", F.array_join("e.must_not_skills", ",").alias("skills"), F.col("e.must_not_location").alias("location"))


EXCLUSIONS_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS skills, CASE WHEN c_custkey % 3 = 0 THEN 'remote' END AS location FROM customer"


def service_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of JSON answers, some in code fences, some broken, with a default."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 10 == 1, F.lit("sorry")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.coalesce(understand.answers(text, "k int")["k"], F.lit(-1)).alias("k"))


ANSWERS_SQL = "SELECT event_id, CASE WHEN event_id % 3 > 0 AND event_id % 10 = 1 THEN -1 ELSE coalesce(CAST(json_extract(props, '$.k') AS INTEGER), -1) END AS k FROM events"


def canonical_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Part names in capitals, in the plural and with a letter too few, mapped to the names themselves and gathered as their aliases."""
    parts = table(spark, sf, "part").select("p_name").distinct()
    met = parts.select(F.explode(F.array(F.upper("p_name"), F.concat("p_name", F.lit("s")), F.concat("p_name", F.lit(" zz qq ww")))).alias("name"))
    found = fuzzy.canonical_match(met, parts.select(F.lower("p_name").alias("key"), F.col("p_name").alias("name")))
    return fuzzy.with_aliases(found).select("canonical", F.array_join("aliases", ",").alias("aliases"))


CANONICAL_ALIASES_SQL = """SELECT DISTINCT p_name AS canonical, upper(p_name) || ',' || p_name || 's' AS aliases FROM part UNION ALL SELECT DISTINCT p_name || ' zz qq ww', '' FROM part"""


def query_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of part names and types that are known skills."""
    from rankweave.functions import text as T

    parts = table(spark, sf, "part")
    known = parts.where("p_partkey % 2 = 0").select(F.explode(F.split("p_name", " ")).alias("skill"))
    asked = parts.select(F.col("p_partkey").alias("qid"), F.concat(F.upper("p_name"), F.lit(" "), "p_type").alias("text"))
    return understand.query_skills(asked, known, lambda c: T.bm25_tokens(c), [T.canonical_skill, T.normal_token])


QUERY_SKILLS_SQL = """WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS skill FROM part WHERE p_partkey % 2 = 0)
SELECT DISTINCT p_partkey AS qid, t AS skill FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS t FROM part) JOIN k ON k.skill = t"""

QUERIES = {
    "vocabulary_union": (vocabulary_union, VOCABULARY_SQL),
    "parse_people": (parse_people, PARSE_PEOPLE_SQL),
    "alias_replace": (alias_replace, ALIAS_SQL),
    "negated_variants": (negated_variants, NEGATED_SQL),
    "relation_variants": (relation_variants, RELATION_SQL),
    "synonym_variants": (synonym_variants, SYNONYM_VARIANTS_SQL),
    "skill_variants": (skill_variants, SKILL_VARIANTS_SQL),
    "variants_concat": (variants_concat, CONCAT_SQL),
    "exclusions": (exclusions, EXCLUSIONS_SQL),
    "service_answers": (service_answers, ANSWERS_SQL),
    "canonical_aliases": (canonical_aliases, CANONICAL_ALIASES_SQL),
    "query_skills": (query_skills, QUERY_SKILLS_SQL),
}
