"""Text rules on cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import schema, vocab
from rankweave.functions import text as T
from rankweave.operators import fuzzy, graph, understand
from rankweave.plans.text_queries import QUERY_TEXTS

PARSED = [
    (1, "python", "", "python developer", "senior", "5", None, None, "experience_filter"),
    (2, "java", "python", None, "senior", None, None, None, "experience_filter"),
    (3, "react", "", None, None, None, None, "bangalore", "multi_skill"),
    (4, "", "aws", "data scientist", None, None, "fintech", None, "domain_search"),
    (5, "machine learning", "", None, None, None, None, None, "ranking"),
    (6, "docker,kubernetes", "", None, None, None, None, None, "multi_skill"),
    (7, "django", "", None, None, None, None, None, "comparative"),
    (8, "", "", "frontend developer", "entry", None, "healthtech", None, "experience_filter"),
    (9, "", "", None, "executive", "12", None, None, "experience_filter"),
    (10, "devops", "", "devops engineer", None, None, None, None, "availability"),
    (11, "", "", "data analyst", None, None, None, "pune", "role_search"),
    (12, "", "", None, None, None, None, None, "unknown"),
    (13, "", "", None, "entry", "2", None, None, "multi_skill"),
]

NEGATION_CASES = [(1, "python but not java", ["python", "java"]), (2, "no sql, without spring boot", ["sql", "spring", "boot"]), (3, "java avoid javascript", ["java", "javascript"]), (4, "prefer not aws or gcp", ["aws", "gcp"]), (5, "nothing here", ["here"])]
NEGATED = {1: ["java"], 2: ["sql", "spring", "boot"], 3: ["javascript"], 4: ["aws"], 5: []}

PARAGRAPHS = [(1, "It’s “fine” – really…"), (2, "em—dash and â\u0080\u0099 mojibake"), (3, "plain"), (4, None)]

LISTS = [(1, "Cloud (AWS, GCP), SQL (Basic)"), (2, "a, b ,, c (x)"), (3, None), (4, "one")]

COLLECT = [(1, ["Python", "sql"], "Data Engineer", "senior", ["sql"], [("python and spark, senior engineer", "original"), ("related kafka.", "kg_static")]), (2, None, None, "odd", None, [("find go", "original")])]
COLLECTED = [(1, "python", "skill"), (1, "data engineer", "role"), (1, "senior", "role"), (1, "lead", "role"), (1, "principal", "role"), (1, "staff", "role"), (1, "architect", "role"), (1, "spark", "skill"), (1, "related", "domain"), (1, "kafka", "domain"), (2, "odd", "role"), (2, "find", "skill")]


def test_parse(spark):
    queries = spark.createDataFrame(QUERY_TEXTS, "qid int, text string")
    p = understand.parse(queries, understand.vocabulary(spark, vocab.SKILLS, vocab.SKILL_ALIASES), understand.vocabulary(spark, vocab.ROLES))
    got = p.select("qid", F.array_join(F.array_sort("skills"), ","), F.array_join("negated", ","), "role", "band", "years", "domain", "place", "intent.primary")
    assert sorted(map(tuple, got.collect())) == PARSED


def test_negated(spark):
    rows = spark.createDataFrame(NEGATION_CASES, "qid int, text string, skills array<string>")
    assert {r["qid"]: r["n"] for r in rows.select("qid", understand.negated(F.col("text"), F.col("skills")).alias("n")).collect()} == NEGATED


def test_typography(spark):
    rows = spark.createDataFrame(PARAGRAPHS, "id int, t string").select("id", T.clean_typography(F.col("t")).alias("c"))
    assert dict(map(tuple, rows.collect())) == {1: "It's \"fine\" - really...", 2: "em-dash and ' mojibake", 3: "plain", 4: None}


def test_lists(spark):
    rows = spark.createDataFrame(LISTS, "id int, t string").select("id", T.paren_list(F.col("t")).alias("items"), T.string_list(F.col("t")).alias("plain"))
    want = {1: (["Cloud", "SQL"], ["Cloud (AWS", "GCP)", "SQL (Basic)"]), 2: (["a", "b", "c"], ["a", "b", "c (x)"]), 3: ([], []), 4: (["one"], ["one"])}
    assert {r["id"]: (r["items"], r["plain"]) for r in rows.collect()} == want


def test_graph_terms(spark):
    rows = spark.createDataFrame(COLLECT, "qid int, skills array<string>, role string, band string, negated array<string>, queries array<struct<query:string,strategy:string>>")
    assert sorted(map(tuple, graph.collect_terms(rows).collect())) == sorted(COLLECTED)


def test_spelling(spark):
    rows = spark.createDataFrame([(1, "Pythn and dockr"), (2, "KUBERNETS expert 5 years"), (3, "plain talk")], "qid int, text string")
    terms = spark.createDataFrame([(t, i) for i, t in enumerate(t for t in vocab.SKILLS if " " not in t)], "term string, place int")
    protected = spark.createDataFrame([("expert",), ("years",), ("plain",), ("talk",)], "term string")
    assert dict(map(tuple, fuzzy.corrected(rows, terms, protected).collect())) == {1: "Python and docker", 2: "KUBERNETES expert 5 years", 3: "plain talk"}


def test_canonical_names(spark):
    names = ["machine learning engineerin", "CLOUD INFRASTRUCTURE", "Cloud Infrastructures", "Quantum Baking", "data platforms", "Machine Learning Engineering "]
    canon = ["Machine Learning Engineering", "Cloud Infrastructure", "Data Platform"]
    found = fuzzy.canonical_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n.lower(), n) for n in canon], "key string, name string"))
    assert {r["name"]: (r["canonical"], r["is_new"]) for r in found.collect()} == {n.strip(): (canon[i], False) if i is not None else (n, True) for n, i in zip(names, (0, 1, 1, None, 2, 0))}


def test_fields(spark):
    found = schema.discover(schema.PROFILE)
    assert (found.key, found.name, found.numeric, found.summary, found.skill, found.role, found.text) == ("id", "name", ["years_of_experience"], ["skill_summary"], ["core_skills", "secondary_skills", "soft_skills"], ["potential_roles"], [])


def test_synonyms(spark):
    rows = {(r["term"], r["canonical"], r["synonym"]) for r in understand.synonym_table(spark).collect()}
    assert rows == {(t, g[0], s) for g in vocab.SYNONYMS for t in g for s in g if s != t}
