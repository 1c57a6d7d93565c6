"""Queries of text functions, skill cells, query understanding and fuzzy joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import schema, vocab
from rankweave.functions import text as T
from rankweave.operators import dictionary, fuzzy, understand
from rankweave.sources.io import table

from . import encoding
from .folders import settled
from .sql import ABBR, canonical_skill, lookup, quote, values

CELLS = [
    (1, "Python (Expert), SQL (Proficient), Docker (Beginner)"),
    (2, "Go, Rust; C"),
    (3, "Docker, Python (Expert)"),
    (4, ""),
    (5, None),
    (6, "React.js (advanced), Power BI tools (Basic), ML engineer (unheard of)"),
    (7, "node js|TypeScript|K8s"),
]
SKILL_NAMES = ["React.js", "ML engineer", "python programming", " Power-BI ", "Node JS", "data science", "SQL skills", "ci/cd", "Kubernetes certification", "k8s", "'docker'", "deep  learning framework", "tf tool", "programming"]
QUERY_TEXTS = [
    (1, "find a python developer with 5+ years"),
    (2, "senior java engineer not python"),
    (3, "React and Node developers in Bangalore"),
    (4, "fintech data scientist without aws"),
    (5, "best machine learning people, remote only"),
    (6, "who knows k8s and docker"),
    (7, "compare django vs fastapi"),
    (8, "entry-level frontend developer, healthcare background"),
    (9, "director of engineering 12 years"),
    (10, "available devops engineer avoid jenkins"),
    (11, "hire a data analyst from Pune"),
    (12, "plain words"),
    (13, "full-stack polyglot, 0-2 years"),
]
#: How often an offer is turned down in made-up texts, one for each trigger of a negation.
TURNS = [" not ", " no ", " without ", " excluding ", " avoid ", " non-", " except ", " prefer not "]



def _rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def _asks(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, text): each customer's question, one of the fixed texts with their segment and a number of years."""
    fixed = _rows(spark, [(i - 1, t) for i, t in QUERY_TEXTS], "_q int, text string")
    people = table(spark, sf, "customer").withColumn("_q", (F.col("c_custkey") % len(QUERY_TEXTS)).cast("int")).join(F.broadcast(fixed), "_q")
    return people.select(F.col("c_custkey").alias("qid"), F.concat("text", F.lit(" in "), F.lower("c_mktsegment"), F.lit(", about "), (F.col("c_custkey") % 23).cast("string"), F.lit(" years")).alias("text"))


ASKS_SQL = f"""{values("q", "qid, text", QUERY_TEXTS)},
asks AS (SELECT c_custkey AS qid, q.text || ' in ' || lower(c_mktsegment) || ', about ' || CAST(c_custkey % 23 AS VARCHAR) || ' years' AS text FROM customer JOIN q ON q.qid = 1 + c_custkey % {len(QUERY_TEXTS)})"""
#: Runs of 1 to 4 words of each question.
GRAMS_SQL = r"""ws AS (SELECT qid, lower(text) AS low, list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#./-]*'), lambda w: rtrim(w, './-')) AS w FROM asks),
grams AS (SELECT DISTINCT qid, array_to_string(list_slice(w, i, i + k - 1), ' ') AS term FROM (SELECT qid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, range(1, 5) r(k)))"""


def _spans_sql(source: str) -> str:
    """CTE spans(qid, a, b): what each first match of a negation trigger covers in `low` of `source`."""
    return f"""{values("negs", "pattern, scope", vocab.NEGATIONS)},
heads AS (SELECT qid, low, scope, length(regexp_split_to_array(low, pattern)[1]) AS a, length(regexp_extract(low, pattern)) AS n FROM {source}, negs WHERE regexp_matches(low, pattern)),
spans AS (SELECT qid, a, a + n + length(array_to_string(list_slice(regexp_split_to_array(trim(substr(low, a + n + 1)), '\\s+'), 1, scope), ' ')) AS b FROM heads)"""


def skill_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Skill cells of all profiles, and of fixed cases with negative ids, parsed and merged by the largest weight."""
    cells = encoding.cells(spark, sf).select(F.col("cid").cast("long").alias("id"), "cell").unionByName(_rows(spark, [(-i, c) for i, c in CELLS], "id long, cell string"))
    return cells.select("id", F.inline(T.skill_cell(F.col("cell")))).groupBy("id", "skill").agg(F.max("weight").alias("weight"), F.sum(T.skill_copies(F.col("weight"))).alias("copies"))


SKILL_PARSE_SQL = (
    "WITH "
    + encoding.HAS_SKILL_SQL
    + ",\n"
    + values("fixed", "id, cell", [(-i, c) for i, c in CELLS])
    + r""",
cells AS (SELECT CAST(cid AS BIGINT) AS id, string_agg(skill || ' (' || level || ')', ', ' ORDER BY skill || ' (' || level || ')') AS cell FROM hs GROUP BY cid
          UNION ALL SELECT id, cell FROM fixed),
both_ AS (SELECT id, coalesce(cell, '') AS cell, regexp_extract_all(coalesce(cell, ''), '([^,(]+?)\s*\(\s*([^)]+?)\s*\)', 1) AS n,
                 regexp_extract_all(coalesce(cell, ''), '([^,(]+?)\s*\(\s*([^)]+?)\s*\)', 2) AS l FROM cells),
pairs AS (SELECT id, unnest(n) AS name, lower(trim(unnest(l))) AS lev FROM both_),
"""
    + "plain AS (SELECT id, unnest(regexp_split_to_array(cell, '[,;|]+')) AS name, NULL AS lev FROM both_ WHERE len(n) = 0),\n"
    + "every_ AS (SELECT id, name, lev FROM pairs UNION ALL SELECT id, name, lev FROM plain),\n"
    + canonical_skill("every_", "name", "id, lev", "canon")
    + f"""
SELECT id, skill, max(weight) AS weight, CAST(sum(greatest(1, CAST(round_even(2 * weight, 0) AS INTEGER))) AS BIGINT) AS copies
FROM (SELECT id, skill, CAST({lookup("lev", vocab.PROFICIENCY, "1.0")} AS DOUBLE) AS weight FROM canon WHERE skill <> '') GROUP BY id, skill"""
)


def skill_normalize(spark: SparkSession, sf: str) -> DataFrame:
    names = _rows(spark, [(i, n) for i, n in enumerate(SKILL_NAMES)], "id int, name string")
    parts = table(spark, sf, "part").select((F.col("p_partkey") + 1000).cast("int").alias("id"), F.concat("p_name", F.lit(" Technologies")).alias("name"))
    return names.unionByName(parts).select("id", T.canonical_skill(F.col("name")).alias("skill"), T.normal_text(F.col("name")).alias("text"), T.normal_token(F.col("name")).alias("token"))


SKILL_NORMALIZE_SQL = (
    "WITH "
    + ABBR
    + ",\n"
    + values("fixed", "id, name", list(enumerate(SKILL_NAMES)))
    + """,
names AS (SELECT CAST(id AS INTEGER) AS id, name FROM fixed UNION ALL SELECT CAST(p_partkey + 1000 AS INTEGER), p_name || ' Technologies' FROM part),
"""
    + canonical_skill("names", "name", "id, name", "canon")
    + f""",
words AS (SELECT id, unnest(regexp_split_to_array(lower(name), '\\s+')) AS w, generate_subscripts(regexp_split_to_array(lower(name), '\\s+'), 1) AS pos FROM names),
texts AS (SELECT id, string_agg(w, ' ' ORDER BY pos) FILTER (WHERE w <> '') AS text FROM (SELECT id, pos, {lookup("regexp_replace(w, '[^a-z0-9+#]', '', 'g')", vocab.ABBREVIATIONS)} AS w FROM words) GROUP BY id)
SELECT canon.id, skill, coalesce(text, '') AS text, {lookup("lower(trim(name))", vocab.ABBREVIATIONS)} AS token FROM canon JOIN texts ON canon.id = texts.id"""
)


def _typeset(text: Column) -> Column:
    return F.concat(F.replace(F.replace(text, F.lit(" a"), F.lit(" “a")), F.lit("e "), F.lit("e’ – ")), F.lit(" â\u0080\u0099…"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations with typographic characters put in, and cleaned of them again."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", _typeset(F.col("text")).alias("t"))
    return turns.select("conv_id", "turn", T.clean_typography(F.col("t")).alias("clean"), F.size(T.simple_tokens(F.col("t"))).alias("words"))


def _replaced(expr: str) -> str:
    for a, b in vocab.TYPOGRAPHY.items():
        expr = f"replace({expr}, {quote(a)}, {quote(b)})"
    return expr


CLEAN_TEXT_SQL = f"""WITH p AS (SELECT conv_id, turn, replace(replace(text, ' a', ' “a'), 'e ', 'e’ – ') || ' â\u0080\u0099…' AS t FROM conversations)
SELECT conv_id, turn, {_replaced("t")} AS clean,
       CAST(len(list_filter(string_split(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1)) AS INTEGER) AS words FROM p"""


def paren_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of part names, types and brands, in part in parentheses; every tenth is null."""
    cell = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(", "), "p_type", F.lit("), "), "p_type", F.lit(" (x), , "), "p_brand")
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, cell).alias("t"))
    return rows.select("p_partkey", F.array_join(T.paren_list(F.col("t")), "|").alias("items"), F.array_join(T.string_list(F.col("t")), "|").alias("plain"))


PAREN_LISTS_SQL = """WITH r AS (SELECT *, CASE WHEN p_partkey % 10 <> 0 THEN p_name || ' (' || p_brand || ', ' || p_type || '), ' || p_type || ' (x), , ' || p_brand END AS t FROM part)
SELECT p_partkey, CASE WHEN t IS NULL THEN '' ELSE concat_ws('|', p_name, p_type, p_brand) END AS items,
  coalesce(array_to_string(list_filter(list_transform(string_split(t, ','), lambda s: trim(s)), lambda s: s <> ''), '|'), '') AS plain FROM r"""


def simple_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.simple_tokens(F.col("text"))).cast("long").alias("n"))


SIMPLE_TOKENS_SQL = """SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1)) AS BIGINT) AS n FROM documents"""


def semantic_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text that an encoder reads: summary, skills, roles, years."""
    rows = encoding.cells(spark, sf).join(encoding.profiles(spark, sf), "cid")
    parts = F.concat_ws(
        " ",
        T.present(F.col("name")),
        F.concat(F.lit("Skills: "), "cell", F.lit(".")),
        F.concat(F.lit("Suitable for roles: "), F.array_join("roles", ", "), F.lit(".")),
        F.when(F.col("years") > 0, F.concat(F.floor("years").cast("string"), F.lit(" years of experience."))),
    )
    return rows.select("cid", parts.alias("semantic_text"))


SEMANTIC_TEXT_SQL = f"""WITH {encoding.HAS_SKILL_SQL}, {encoding.PROFILES_SQL},
cells AS (SELECT cid, string_agg(skill || ' (' || level || ')', ', ' ORDER BY skill || ' (' || level || ')') AS cell FROM hs GROUP BY cid)
SELECT cells.cid, concat_ws(' ', name, 'Skills: ' || cell || '.', 'Suitable for roles: ' || role || '.',
       CASE WHEN years > 0 THEN CAST(CAST(floor(years) AS BIGINT) AS VARCHAR) || ' years of experience.' END) AS semantic_text
FROM cells JOIN prof ON cells.cid = prof.cid"""


def experience_band(spark: SparkSession, sf: str) -> DataFrame:
    return _asks(spark, sf).select("qid", understand.band(F.col("text")).alias("band"))


EXPERIENCE_BAND_SQL = f"""WITH {ASKS_SQL} SELECT qid, CASE {" ".join(f"WHEN {' OR '.join(f'regexp_matches(lower(text), {quote(p)})' for p in ps)} THEN {quote(b)}" for b, ps in vocab.BANDS.items())} END AS band FROM asks"""


def years_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _asks(spark, sf).select("qid", understand.years_asked(F.col("text")).alias("years"), T.years(understand.years_asked(F.col("text"))).alias("value"))


YEARS_EXTRACT_SQL = rf"""WITH {ASKS_SQL} SELECT qid, nullif(regexp_extract(lower(text), '(\d+)\s*\+?\s*years?', 1), '') AS years,
CAST(nullif(regexp_extract(lower(text), '(\d+)\s*\+?\s*years?', 1), '') AS DOUBLE) AS value FROM asks"""


def intent_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _asks(spark, sf).select("qid", F.array_join(understand.rules_matched(F.col("text")), ",").alias("rules"))


INTENT_RULES_SQL = f"""WITH {ASKS_SQL} SELECT qid, concat_ws(',', {", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches(lower(text), {quote(p)})' for p in ps)} THEN {quote(n)} END" for n, ps in vocab.RULES)}) AS rules FROM asks"""


def _parsed(spark: SparkSession, queries: DataFrame) -> DataFrame:
    return settled(understand.parse(queries, understand.vocabulary(spark, vocab.SKILLS, vocab.SKILL_ALIASES), understand.vocabulary(spark, vocab.ROLES)))


def parse_query(spark: SparkSession, sf: str) -> DataFrame:
    p = _parsed(spark, _asks(spark, sf))
    return p.select("qid", F.array_join(F.array_sort("skills"), ",").alias("skills"), F.array_join("negated", ",").alias("negated"), "role", "band", "years", "domain", "place", F.col("intent.primary").alias("intent"))


def _first_sql(terms: dict) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {quote(x)})' for x in [name, *more])} THEN {quote(name)}" for name, more in terms.items()) + " END"


_KNOWN = {t: t for t in vocab.SKILLS} | {x: name for name, more in vocab.SKILL_ALIASES.items() for x in [name, *more]}
_RULES = ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches(low, {quote(p)})' for p in ps)} THEN {quote(n)} END" for n, ps in vocab.RULES)
PARSE_QUERY_SQL = f"""WITH {ASKS_SQL}, {GRAMS_SQL}, {_spans_sql("ws")}, {values("known", "term, name", _KNOWN.items())}, {values("roles", "term", [(r,) for r in vocab.ROLES])},
held AS (SELECT qid, name, min((-len(string_split(term, ' ')), term)) AS place FROM grams JOIN known USING (term) GROUP BY qid, name),
marked AS (SELECT qid, name, place, EXISTS (SELECT 1 FROM spans s WHERE s.qid = h.qid AND instr(low, name) > 0 AND instr(low, name) - 1 BETWEEN s.a AND s.b) AS neg FROM held h JOIN ws USING (qid)),
skills AS (SELECT qid, string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT neg) AS skills, count(*) FILTER (WHERE NOT neg) AS n, string_agg(name, ',' ORDER BY place) FILTER (WHERE neg) AS negated FROM marked GROUP BY qid),
role AS (SELECT qid, arg_min(term, (-len(string_split(term, ' ')), term)) AS role FROM grams JOIN roles USING (term) GROUP BY qid),
one AS (SELECT qid, coalesce(skills, '') AS skills, coalesce(n, 0) AS n, coalesce(negated, '') AS negated, role,
  CASE {" ".join(f"WHEN {' OR '.join(f'regexp_matches(low, {quote(p)})' for p in ps)} THEN {quote(b)}" for b, ps in vocab.BANDS.items())} END AS band,
  nullif(regexp_extract(low, '{vocab.YEARS}', 1), '') AS years, {_first_sql(vocab.DOMAINS)} AS domain, {_first_sql({p: [] for p in vocab.PLACES})} AS place, list_filter([{_RULES}], lambda r: r IS NOT NULL) AS rules
  FROM ws LEFT JOIN skills USING (qid) LEFT JOIN role USING (qid))
SELECT qid, skills, negated, role, band, years, domain, place, CASE WHEN n >= 2 THEN 'multi_skill' WHEN band IS NOT NULL AND (n >= 1 OR role IS NOT NULL) THEN 'experience_filter' WHEN domain IS NOT NULL AND band IS NULL AND n <= 1 THEN 'domain_search'
  ELSE coalesce(list_filter(rules, lambda r: negated = '' OR r <> 'skill_search')[1], 'unknown') END AS intent FROM one"""


def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    """All admitted variants of the customers' questions: original, synonyms, relations, templates."""
    parsed = _parsed(spark, _asks(spark, sf))
    return understand.without_negated(understand.expand(parsed), parsed)


def synonym_expand(spark: SparkSession, sf: str) -> DataFrame:
    """The other names of every term of a question that has some."""
    grams = _asks(spark, sf).select("qid", F.explode(understand.ngrams(F.col("text"))).alias("term"))
    return grams.join(F.broadcast(understand.synonym_table(spark)), "term").select("qid", "term", "canonical", "synonym", "place")


SYNONYM_ROWS = [(t, g[0], s, i) for g in vocab.SYNONYMS for t in g for i, s in enumerate(x for x in g if x != t)]
SYNONYM_SQL = f"WITH {ASKS_SQL}, {GRAMS_SQL}, {values('r', 'term, canonical, synonym, place', SYNONYM_ROWS)} SELECT qid, term, canonical, synonym, CAST(place AS INTEGER) AS place FROM grams JOIN r USING (term)"


def template_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Templates of two intents filled with the words of each part's name and, for every other part, its type as the role."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), F.concat(F.lit("query "), F.col("p_partkey").cast("string")).alias("text"), F.split("p_name", " ").alias("skills"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).alias("role"))
    none = F.lit(None).cast("string")
    parsed = rows.select("*", none.alias("band"), none.alias("years"), none.alias("domain"), none.alias("place"), F.struct(F.lit("skill_search").alias("primary"), F.array(F.lit("role_search")).alias("modifiers")).alias("intent"))
    return understand.admitted(understand.template_variants(parsed)).select("qid", "ord", "query", "strategy")


TEMPLATE_SQL = f"""WITH c AS (SELECT p_partkey AS qid, p_name AS skills, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END AS role FROM part), {values("t", "place, tpl", [(i, t) for i, t in enumerate(vocab.TEMPLATES["skill_search"][:2] + vocab.TEMPLATES["role_search"][:2])])},
f AS (SELECT qid, place, lower(trim(replace(replace(tpl, '{{skills}}', skills), '{{role}}', coalesce(role, '')))) AS query FROM c, t)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY place, query) AS INTEGER) AS ord, query, 'template' AS strategy FROM f WHERE length(query) > 3"""


def negation_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Which of a part's words, type and brand a negation covers, with each trigger in turn."""
    turn = F.element_at(F.array(*map(F.lit, TURNS)), (F.col("p_partkey") % len(TURNS)).cast("int") + 1)
    words = F.split("p_name", " ")
    skills = F.array(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.lower("p_type"), F.lower("p_brand"))
    text = F.concat(F.lit("find "), F.get(words, F.lit(0)), turn, F.get(words, F.lit(1)), F.lit(" "), F.lower("p_type"), F.lit(" and "), F.lower("p_brand"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), text.alias("text"), skills.alias("skills"))
    return rows.select("qid", F.array_join(understand.negated(F.col("text"), F.col("skills")), ",").alias("negated"))


NEGATION_SPANS_SQL = f"""WITH src AS (SELECT p_partkey AS qid, string_split(p_name, ' ') AS w, lower(p_type) AS t, lower(p_brand) AS b, ([{", ".join(map(quote, TURNS))}])[p_partkey % {len(TURNS)} + 1] AS turn FROM part),
said AS (SELECT qid, 'find ' || w[1] || turn || w[2] || ' ' || t || ' and ' || b AS low, [w[1], w[2], t, b] AS skills FROM src), {_spans_sql("said")},
cov AS (SELECT qid, list((a, b)) AS l FROM spans GROUP BY qid)
SELECT qid, array_to_string(list_filter(skills, lambda s: instr(low, s) > 0 AND len(list_filter(coalesce(l, []), lambda p: instr(low, s) - 1 >= p[1] AND instr(low, s) - 1 <= p[2])) > 0), ',') AS negated FROM said LEFT JOIN cov USING (qid)"""


def typos(spark: SparkSession, sf: str) -> DataFrame:
    """(token): words of part names with one deterministic typo each, and the words themselves."""
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    bent = F.array(F.col("w"), F.concat(F.substring("w", F.lit(2), F.length("w")), F.lit("")), F.concat(F.substring("w", F.lit(1), F.length("w") - 1), F.lit("x")), F.concat(F.substring("w", 1, 2), F.lit("q"), F.substring("w", F.lit(3), F.length("w"))))
    return words.select(F.explode(bent).alias("token")).distinct()


def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest word of part names for each token; ties go to the word of the smallest part."""
    words = table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term")).groupBy("term").agg(F.min("p_partkey").alias("place"))
    return fuzzy.fuzzy_match(typos(spark, sf), words)


FUZZY_SQL = """WITH w AS (SELECT term, min(p_partkey) AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) GROUP BY term),
t AS (SELECT DISTINCT unnest([term, substr(term, 2), substr(term, 1, length(term) - 1) || 'x', substr(term, 1, 2) || 'q' || substr(term, 3)]) AS token FROM w),
p AS (SELECT token, term, place, levenshtein(token, term) AS dist FROM t, w WHERE length(token) >= 3 AND levenshtein(token, term) <= 2)
SELECT token, term, CAST(dist AS INTEGER) AS dist FROM p WHERE 1 - dist / CAST(greatest(length(token), length(term)) AS DOUBLE) >= CAST(0.7 AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY token ORDER BY dist, place, term) = 1"""


BENT = ["w", "substr(w, 2)", "substr(w, 1, length(w) - 1) || 'x'", "substr(w, 1, 2) || 'q' || substr(w, 3)"]
TAIL = " expert with 5 years"


def spell_correct(spark: SparkSession, sf: str) -> DataFrame:
    """A word of each part's name, bent in one of four ways and in one of three cases, corrected to the words of all names."""
    words = table(spark, sf, "part").select("p_partkey", F.get(F.split("p_name", " "), (F.col("p_partkey") % 2).cast("int")).alias("w"))
    bent = F.when(F.col("p_partkey") % 4 == 0, F.expr(BENT[0])).when(F.col("p_partkey") % 4 == 1, F.expr(BENT[1])).when(F.col("p_partkey") % 4 == 2, F.expr(BENT[2])).otherwise(F.expr(BENT[3]))
    cased = F.when(F.col("p_partkey") % 3 == 0, bent).when(F.col("p_partkey") % 3 == 1, F.upper(bent)).otherwise(F.initcap(bent))
    rows = words.select(F.col("p_partkey").alias("qid"), F.concat(cased, F.lit(TAIL)).alias("text"))
    terms = table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term")).groupBy("term").agg(F.min("p_partkey").alias("place"))
    return fuzzy.corrected(rows, terms, _rows(spark, [("expert",), ("with",), ("years",)], "term string"))


SPELL_SQL = f"""WITH v AS (SELECT term, min(p_partkey) AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) GROUP BY term),
b AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {BENT[0]} WHEN 1 THEN {BENT[1]} WHEN 2 THEN {BENT[2]} ELSE {BENT[3]} END AS token FROM (SELECT p_partkey, string_split(p_name, ' ')[p_partkey % 2 + 1] AS w FROM part)),
t AS (SELECT DISTINCT token FROM b WHERE length(token) >= 4 AND token NOT IN (SELECT term FROM v)),
f AS (SELECT token, term FROM (SELECT token, term, place, levenshtein(token, term) AS dist FROM t, v) WHERE dist <= 2 AND 1 - dist / CAST(greatest(length(token), length(term)) AS DOUBLE) >= CAST(0.7 AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY token ORDER BY dist, place, term) = 1)
SELECT p_partkey AS qid, CASE p_partkey % 3 WHEN 0 THEN coalesce(term, token) WHEN 1 THEN upper(coalesce(term, token)) ELSE upper(substr(coalesce(term, token), 1, 1)) || substr(coalesce(term, token), 2) END || {quote(TAIL)} AS corrected FROM b LEFT JOIN f USING (token)"""


COMMON = 5  # documents that hold a word of the dictionary


def dictionary_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark passages, each with one of three slips, corrected by the words of the documents."""
    known = dictionary.counted(table(spark, sf, "documents"), "text", COMMON)
    held = table(spark, sf, "benchmark").select(F.explode(dictionary.words(F.col("text"))).alias("w")).where(F.length("w") >= dictionary.LEAST).distinct()
    slip = F.when(F.length("w") % 3 == 0, F.expr("substr(w, 1, 1) || substr(w, 3)")).when(F.length("w") % 3 == 1, F.expr("substr(w, 1, 2) || 'q' || substr(w, 4)")).otherwise(F.expr("substr(w, 1, 2) || 'zx' || substr(w, 3)"))
    return dictionary.corrections(held.select(slip.alias("token")), settled(known))


DICTIONARY_SQL = f"""WITH d AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'))) AS word FROM documents) WHERE length(word) >= {dictionary.LEAST - 1} GROUP BY word HAVING count(*) >= {COMMON}),
w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS w FROM benchmark),
t AS (SELECT DISTINCT CASE length(w) % 3 WHEN 0 THEN substr(w, 1, 1) || substr(w, 3) WHEN 1 THEN substr(w, 1, 2) || 'q' || substr(w, 4) ELSE substr(w, 1, 2) || 'zx' || substr(w, 3) END AS token FROM w WHERE length(w) >= {dictionary.LEAST}),
p AS (SELECT token, word, n, levenshtein(token, word) AS dist FROM t JOIN d ON abs(length(token) - length(word)) <= 2 WHERE length(token) >= {dictionary.LEAST} AND token NOT IN (SELECT word FROM d))
SELECT token, word, CAST(dist AS INTEGER) AS dist, n FROM p WHERE dist <= CASE WHEN length(token) < {dictionary.LONG} THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY token ORDER BY dist, n DESC, word) = 1"""


def canonical_match(spark: SparkSession, sf: str) -> DataFrame:
    """Part names in capitals, with a blank, or short of a letter, and names of nations, against the part names."""
    parts = table(spark, sf, "part").select("p_name").distinct()
    forms = F.explode(F.array(F.upper("p_name"), F.concat("p_name", F.lit(" ")), F.expr("substr(p_name, 1, length(p_name) - 1)")))
    names = parts.select(forms.alias("name")).unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("name")))
    return fuzzy.canonical_match(names, parts.select(F.lower("p_name").alias("key"), F.col("p_name").alias("name")))


#: A name short of one of n letters has the ratio 200 * (n - 1) / (2 * n - 1); no two part names are nearer to it.
CANONICAL_SQL = f"""WITH p AS (SELECT DISTINCT p_name FROM part)
SELECT upper(p_name) AS name, p_name AS canonical, false AS is_new FROM p UNION SELECT p_name, p_name, false FROM p
UNION SELECT substr(p_name, 1, length(p_name) - 1), CASE WHEN 200 * (length(p_name) - 1) / (2 * length(p_name) - 1)::DOUBLE >= {vocab.CANONICAL_RATIO} THEN p_name ELSE substr(p_name, 1, length(p_name) - 1) END, 200 * (length(p_name) - 1) / (2 * length(p_name) - 1)::DOUBLE < {vocab.CANONICAL_RATIO} FROM p
UNION SELECT n_name, n_name, true FROM nation"""


def disjoint_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, brands and part types as four levels of names; names known above leave a level."""
    one = lambda t, c: table(spark, sf, t).select(F.col(c).alias("name")).distinct()
    extra = _rows(spark, [("ASIA ",), ("Shared",)], "name string")
    levels = fuzzy.disjoint(one("region", "r_name"), one("nation", "n_name").unionByName(extra), one("part", "p_brand").unionByName(extra), one("part", "p_type").unionByName(extra))
    out = None
    for level, df in levels.items():
        part = df.select(F.lit(level).alias("level"), "name")
        out = part if out is None else out.unionByName(part)
    return out


DISJOINT_SQL = """WITH x(name) AS (VALUES ('ASIA '), ('Shared')),
d AS (SELECT DISTINCT r_name AS name FROM region), s AS (SELECT DISTINCT n_name AS name FROM nation UNION ALL SELECT name FROM x),
r AS (SELECT DISTINCT p_brand AS name FROM part UNION ALL SELECT name FROM x), k AS (SELECT DISTINCT p_type AS name FROM part UNION ALL SELECT name FROM x),
kd AS (SELECT lower(trim(name)) AS k FROM d), ks AS (SELECT k FROM kd UNION SELECT lower(trim(name)) FROM s), kr AS (SELECT k FROM ks UNION SELECT lower(trim(name)) FROM r)
SELECT 'domains' AS level, name FROM d UNION ALL SELECT 'subdomains', name FROM s WHERE lower(trim(name)) NOT IN (SELECT k FROM kd)
UNION ALL SELECT 'roles', name FROM r WHERE lower(trim(name)) NOT IN (SELECT k FROM ks) UNION ALL SELECT 'skills', name FROM k WHERE lower(trim(name)) NOT IN (SELECT k FROM kr)"""


def entity_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of orders as a level, an importance, a skill type and a seniority; values outside their domains are null."""
    k = F.col("o_orderkey") % 4
    level = F.when(F.col("o_orderstatus") == "F", "Expert").when(F.col("o_orderstatus") == "O", "wizard").otherwise("Advanced Beginner")
    kind, rank = F.when(k == 0, "CORE").when(k == 1, "soft").when(k == 2, "other"), F.when(k == 0, "Senior").when(k == 1, "captain").when(k == 2, "INTERN")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), level.alias("p"), F.substring("o_orderpriority", 3, 20).alias("i"), kind.alias("t"), rank.alias("s"))
    return rows.select("id", fuzzy.domain_value(F.col("p"), vocab.PROFICIENCY_LEVELS).alias("proficiency"), fuzzy.domain_value(F.col("i"), vocab.IMPORTANCE).alias("importance"), fuzzy.domain_value(F.col("t"), vocab.SKILL_TYPES).alias("type"), fuzzy.domain_value(F.col("s"), vocab.SENIORITIES).alias("seniority"))


def _allowed(column: str, allowed: list[str]) -> str:
    return f"CASE WHEN lower({column}) IN ({', '.join(map(quote, allowed))}) THEN lower({column}) END"


ENTITY_SQL = f"""WITH e AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Expert' WHEN 'O' THEN 'wizard' ELSE 'Advanced Beginner' END AS p, substr(o_orderpriority, 3) AS i,
  CASE o_orderkey % 4 WHEN 0 THEN 'CORE' WHEN 1 THEN 'soft' WHEN 2 THEN 'other' END AS t, CASE o_orderkey % 4 WHEN 0 THEN 'Senior' WHEN 1 THEN 'captain' WHEN 2 THEN 'INTERN' END AS s FROM orders)
SELECT id, {_allowed("p", vocab.PROFICIENCY_LEVELS)} AS proficiency, {_allowed("i", vocab.IMPORTANCE)} AS importance, {_allowed("t", vocab.SKILL_TYPES)} AS type, {_allowed("s", vocab.SENIORITIES)} AS seniority FROM e"""

#: Tables and their columns, for the SQL.
DISCOVERED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"],
}


def field_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of every column of some tables, and how many of its values are present."""
    out = None
    for name in DISCOVERED:
        rows = table(spark, sf, name)
        found = schema.discover(rows.schema)
        kinds = [(c, k) for k in ("numeric", "summary", "skill", "role", "text") for c in getattr(found, k)]
        counted = rows.agg(*[F.count(c).alias(c) for c, _ in kinds])
        listed = counted.select(F.inline(F.array(*[F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("present")) for c, k in kinds])))
        out = listed if out is None else out.unionByName(listed)
    return out


def _kind_sql() -> str:
    words = lambda k: " OR ".join(f"contains(lower(column_name), {quote(w)})" for w in schema.KINDS[k])
    numeric = "data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT')"
    return f"CASE WHEN {words('numeric')} OR {numeric} THEN 'numeric' " + " ".join(f"WHEN {words(k)} THEN '{k}'" for k in ("summary", "skill", "role")) + " ELSE 'text' END"


FIELD_SQL = "WITH counted AS (" + " UNION ALL ".join(f"""SELECT '{t}' AS "table", unnest(c) AS "column", unnest(n) AS present FROM (SELECT [{", ".join(map(quote, cs))}] AS c, [{", ".join(f"count({c})" for c in cs)}] AS n FROM {t})""" for t, cs in DISCOVERED.items()) + f"""),
kinds AS (SELECT DISTINCT table_name AS "table", column_name AS "column", {_kind_sql()} AS kind FROM information_schema.columns)
SELECT "table", "column", kind, CAST(present AS BIGINT) AS present FROM counted JOIN kinds USING ("table", "column")"""

QUERIES = {
    "skill_parse": (skill_parse, SKILL_PARSE_SQL),
    "skill_normalize": (skill_normalize, SKILL_NORMALIZE_SQL),
    "clean_text": (clean_text, CLEAN_TEXT_SQL),
    "paren_lists": (paren_lists, PAREN_LISTS_SQL),
    "simple_tokens": (simple_tokens, SIMPLE_TOKENS_SQL),
    "semantic_text": (semantic_text, SEMANTIC_TEXT_SQL),
    "experience_band": (experience_band, EXPERIENCE_BAND_SQL),
    "years_extract": (years_extract, YEARS_EXTRACT_SQL),
    "intent_rules": (intent_rules, INTENT_RULES_SQL),
    "parse_query": (parse_query, PARSE_QUERY_SQL),
    "query_variants": (query_variants, None),
    "synonym_expand": (synonym_expand, SYNONYM_SQL),
    "template_expand": (template_expand, TEMPLATE_SQL),
    "negation_spans": (negation_spans, NEGATION_SPANS_SQL),
    "fuzzy_match": (fuzzy_match, FUZZY_SQL),
    "spell_correct": (spell_correct, SPELL_SQL),
    "dictionary_corrections": (dictionary_corrections, DICTIONARY_SQL),
    "canonical_match": (canonical_match, CANONICAL_SQL),
    "disjoint_levels": (disjoint_levels, DISJOINT_SQL),
    "entity_checks": (entity_checks, ENTITY_SQL),
    "field_discovery": (field_discovery, FIELD_SQL),
}
