"""Queries of skills, the property graph, merging, re-ranking and display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import vocab
from rankweave.operators import explain, fusion, graph, index, lexical, ranks, rerank
from rankweave.operators.names import held_terms
from rankweave.sources.io import table

from . import encoding
from .encoding import EDGES_SQL, HAS_SKILL_SQL, PROFILES_SQL
from .folders import settled
from .sql import listed, values

#: Graph queries: terms with kinds, and what is asked.
TERMS = [(1, "anvil", "skill"), (1, "blue", "skill"), (2, "building", "role"), (2, "red", "domain"), (3, "promo", "domain"), (3, "green", "skill")]
ASKED = [(1, 3.0, "senior", ["zzz"]), (2, 5.0, None, ["green"]), (3, None, "build", [])]
INTENTS = [(1, "domain_search", 0.9, ["experience_filter"], ["anvil"]), (2, "multi_skill", 0.75, ["location_filter", "unknown"], []), (3, "anything", 0.5, [], ["red"])]

HAS, GRAPH = f"WITH {HAS_SKILL_SQL}", f"WITH {HAS_SKILL_SQL}, {EDGES_SQL}"
TERMS_SQL = values("terms", "qid, term, kind", TERMS)
ASKED_SQL = values("asked", "qid, wanted, band, negated", [(a, b if b is None else float(b), c, listed(d)) for a, b, c, d in ASKED])


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "qid int, term string, kind string")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "qid int, wanted double, band string, negated array<string>")


def _skills(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.has_skill(spark, sf).select("cid", "skill")


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Skills of candidates and stored edges; lines of quantity 40 and more make a skill (see encoding)."""
    held = settled(encoding.has_skill(spark, sf))
    return held.select("cid", "skill"), settled(encoding.edges(spark, sf, held))


def skill_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 strongest holders of each skill, with their names."""
    post = encoding.skill_rows(spark, sf)
    asked = post.select("skill").distinct()
    found = index.lookup_skill(post, asked, 50)
    return found.join(encoding.profiles(spark, sf).select(F.col("cid").alias("doc_id"), "name"), "doc_id", "left").select("skill", "rank", "doc_id", "weight", "name")


SKILL_LOOKUP_SQL = f"""{HAS}, a AS (SELECT DISTINCT skill FROM hs)
SELECT skill, CAST(rank AS INTEGER) AS rank, cid AS doc_id, weight, c_name AS name FROM (SELECT skill, cid, weight, row_number() OVER (PARTITION BY skill ORDER BY weight DESC, cid) AS rank FROM hs JOIN a USING (skill)) LEFT JOIN customer ON cid = c_custkey WHERE rank <= 50"""


def top_skills(spark: SparkSession, sf: str) -> DataFrame:
    found = index.top_skills(encoding.skill_rows(spark, sf))
    return found.select("doc_id", F.size("top_skills").alias("n"), F.array_join("core_names", ",").alias("core"), F.array_join("secondary_names", ",").alias("secondary"), "core_text")


TOP_SKILLS_SQL = f"""{HAS}, t AS (SELECT *, CASE WHEN weight >= 2.0 THEN 'Expert' WHEN weight >= 1.7 THEN 'Advanced' WHEN weight >= 1.5 THEN 'Proficient' WHEN weight >= 1.2 THEN 'Competent' END AS lev FROM (SELECT cid, skill, weight, row_number() OVER (PARTITION BY cid ORDER BY weight DESC, skill) AS rn FROM hs) WHERE rn <= 10)
SELECT cid AS doc_id, CAST(count(*) AS INTEGER) AS n, coalesce(string_agg(skill, ',' ORDER BY rn) FILTER (WHERE weight >= 1.2), '') AS core, coalesce(string_agg(skill, ',' ORDER BY rn) FILTER (WHERE weight < 1.2), '') AS secondary,
  coalesce(string_agg(skill || ' (' || lev || ')', ', ' ORDER BY rn) FILTER (WHERE weight >= 1.2), '') AS core_text FROM t GROUP BY cid"""


def skill_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return index.cooccurrence(encoding.skill_rows(spark, sf))


def related_skills(spark: SparkSession, sf: str) -> DataFrame:
    return index.related(index.cooccurrence(encoding.skill_rows(spark, sf)), 3).select("src", "dst", "w", "rank")


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    post = encoding.skill_rows(spark, sf)
    return index.graph_stats(index.cooccurrence(post), post)


def skill_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return index.skill_frequency(encoding.skill_rows(spark, sf))


def node_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by label."""
    label = lambda df, c, name: df.select(F.lit(name).alias("label"), F.col(c).cast("string").alias("key")).distinct()
    skills, people = _skills(spark, sf), encoding.suitable(spark, sf)
    return graph.node_counts(label(skills, "skill", "Skill").unionByName(label(people, "cid", "Candidate")).unionByName(label(people, "role", "Role")))


def experience_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Which candidates have enough years for each asked number and band."""
    asked = spark.createDataFrame([(1, "5", None), (2, None, "senior"), (3, "4", "mid"), (4, "many", "odd")], "qid int, wanted string, band string")
    rows = encoding.profiles(spark, sf).crossJoin(F.broadcast(asked)).where(fusion.experienced(F.col("years"), F.col("wanted"), F.col("band")))
    return rows.select("qid", "cid")


EXPERIENCE_SQL = f"WITH {PROFILES_SQL} SELECT CAST(qid AS INTEGER) AS qid, cid FROM prof, (VALUES (1, 5.0, 0), (2, NULL, 4), (3, 4.0, 1), (4, NULL, 0)) a(qid, wanted, least) WHERE (wanted IS NULL OR coalesce(years, 0) >= wanted - 2.5) AND coalesce(years, 0) >= least"


def _hit_columns(df: DataFrame) -> DataFrame:
    return df.select("qid", "term", "cid", "node", "hops", F.col("delta").cast("double").alias("delta"))


def hop1_direct(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_columns(graph.direct(_skills(spark, sf), _terms(spark)))


def hop2_related(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_columns(graph.related(*_graph(spark, sf), _terms(spark)))


def hop2_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_columns(graph.domain(*_graph(spark, sf), _terms(spark)))


def hop1_role(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_columns(graph.role(encoding.suitable(spark, sf), _terms(spark)))


def hop3(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_columns(graph.far(*_graph(spark, sf), _terms(spark), 3))


def hop4(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_columns(graph.far(*_graph(spark, sf), _terms(spark), 4))


PATTERNS_SQL = f"""{TERMS_SQL},
w1 AS (SELECT DISTINCT src AS skill, dst AS name FROM edges), w2 AS (SELECT DISTINCT a.src AS skill, b.dst AS name FROM edges a JOIN edges b ON a.dst = b.src AND a.edge_id <> b.edge_id),
w3 AS (SELECT DISTINCT a.src AS skill, c.dst AS name FROM edges a JOIN edges b ON a.dst = b.src AND a.edge_id <> b.edge_id JOIN edges c ON b.dst = c.src AND c.edge_id <> a.edge_id AND c.edge_id <> b.edge_id),
wb AS (SELECT DISTINCT src AS skill, dst AS name FROM edges WHERE type = 'BELONGS_TO'),
h1 AS (SELECT DISTINCT qid, term, cid, skill AS node, 1 AS hops, CASE WHEN kind = 'skill' THEN 3.0 ELSE 1.5 END AS delta FROM hs, terms WHERE contains(lower(skill), term)),
h2 AS (SELECT DISTINCT qid, term, cid, skill AS node, 2 AS hops, 0.75 AS delta FROM hs JOIN w1 USING (skill), terms WHERE contains(lower(name), term)),
hd AS (SELECT DISTINCT qid, term, cid, name AS node, 2 AS hops, 0.5 AS delta FROM hs JOIN wb USING (skill), terms WHERE contains(lower(name), term)),
hr AS (SELECT DISTINCT qid, term, c_custkey AS cid, c_mktsegment AS node, 1 AS hops, 2.0 AS delta FROM customer, terms WHERE contains(lower(c_mktsegment), term) AND kind IN ('role', 'skill')),
h3 AS (SELECT DISTINCT qid, term, cid, skill AS node, 3 AS hops, 0.1875 AS delta FROM hs JOIN w2 USING (skill), terms WHERE contains(lower(name), term)),
h4 AS (SELECT DISTINCT qid, term, cid, skill AS node, 4 AS hops, 0.0469 AS delta FROM hs JOIN w3 USING (skill), terms WHERE contains(lower(name), term)),
hits AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM hd UNION ALL SELECT * FROM hr UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4)"""


def _hop_sql(name: str) -> str:
    return f"{GRAPH}, {PATTERNS_SQL} SELECT CAST(qid AS INTEGER) AS qid, term, cid, node, CAST(hops AS INTEGER) AS hops, CAST(delta AS DOUBLE) AS delta FROM {name}"


def _candidates(spark: SparkSession, sf: str, held: DataFrame | None = None) -> DataFrame:
    held = settled(encoding.has_skill(spark, sf)) if held is None else held
    skills = held.select("cid", "skill")
    found = graph.hits(skills, encoding.suitable(spark, sf), settled(encoding.edges(spark, sf, held)), _terms(spark), settled)
    return graph.candidates(found, skills, encoding.profiles(spark, sf), _asked(spark))


def graph_score(spark: SparkSession, sf: str) -> DataFrame:
    out = _candidates(spark, sf)
    return out.select("qid", "cid", "graph_score", "experience_score", "score", F.array_join("matched_terms", ",").alias("matched"), F.size("reasons").alias("reasons"), F.get("reasons", F.lit(0))["score_delta"].cast("double").alias("best"))


CANDIDATES_SQL = f"""{ASKED_SQL}, {PROFILES_SQL},
sc AS (SELECT qid, cid, round(CAST(sum(delta) AS DOUBLE), 4) AS graph_score, string_agg(DISTINCT term, ',' ORDER BY term) AS matched, CAST(count(*) AS INTEGER) AS reasons, max(CAST(delta AS DOUBLE)) AS best FROM hits GROUP BY qid, cid),
bw(band, words) AS (VALUES ('senior', ['senior', 'lead', 'principal', 'staff', 'architect']), ('build', ['build'])),
cs AS (SELECT cid, list(DISTINCT skill ORDER BY skill) AS core_skills FROM hs GROUP BY cid),
ex AS (SELECT sc.*, name, role, years, core_skills, CAST(CASE WHEN abs(coalesce(years, 0) - wanted) <= 1 THEN 2.0 WHEN abs(coalesce(years, 0) - wanted) <= 3 THEN 1.0 ELSE 0.0 END
   + CASE WHEN len(list_filter(coalesce(words, []), lambda w: contains(lower(role), w))) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS experience_score, negated
  FROM sc JOIN asked USING (qid) LEFT JOIN prof USING (cid) LEFT JOIN cs USING (cid) LEFT JOIN bw ON bw.band = asked.band),
ca AS (SELECT *, round(graph_score + experience_score, 4) AS score FROM ex WHERE NOT coalesce(len(list_filter(negated, lambda n: len(list_filter(core_skills, lambda s: contains(lower(s), n))) > 0)) > 0, false))"""


def negation_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles that a negated skill excludes, by part of a name and by whole words."""
    top = index.top_skills(encoding.skill_rows(spark, sf)).withColumn("names", F.array_union("core_names", "secondary_names"))
    asked = spark.createDataFrame([(1, ["blue anvil"]), (2, ["an"]), (3, ["red", "green bolt"])], "qid int, negated array<string>")
    rows = top.crossJoin(F.broadcast(asked)).withColumn("summary", F.array_join("names", ", ")).withColumn("words", F.split(F.replace("summary", F.lit(","), F.lit("")), " "))
    part, whole = fusion.has_negated(F.col("names"), F.col("summary"), F.col("negated")), fusion.has_negated_word(F.col("names"), F.col("words"), F.col("negated"))
    return rows.groupBy("qid").agg(F.count_if(part).alias("by_part"), F.count_if(whole).alias("by_word"), F.count("*").alias("n"))


NEGATION_SQL = f"""{HAS}, t AS (SELECT cid, list(skill) AS names FROM (SELECT cid, skill, row_number() OVER (PARTITION BY cid ORDER BY weight DESC, skill) AS rn FROM hs) WHERE rn <= 10 GROUP BY cid),
a(qid, negated) AS (VALUES (1, ['blue anvil']), (2, ['an']), (3, ['red', 'green bolt']))
SELECT CAST(qid AS INTEGER) AS qid, count(*) FILTER (WHERE len(list_filter(negated, lambda n: len(list_filter(names, lambda s: contains(s, n))) > 0)) > 0) AS by_part,
  count(*) FILTER (WHERE len(list_filter(negated, lambda n: list_contains(names, n) OR list_contains(flatten(list_transform(names, lambda s: string_split(s, ' '))), n))) > 0) AS by_word, count(*) AS n FROM t, a GROUP BY qid"""


def graph_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Graph terms of made-up requests, one a part: its words as skills, its type as a role, bands, texts, and a negated word."""
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    texts = F.array(
        F.struct(F.concat("p_name", F.lit(" and spark, senior "), "p_brand").alias("query"), F.lit("original").alias("strategy")),
        F.struct(F.concat(F.lit("related "), "p_type", F.lit(". go")).alias("query"), F.lit("kg_static").alias("strategy")),
    )
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "part").select(
        k.alias("qid"), F.when(k % 5 != 0, F.array(F.upper(F.get(words, F.lit(0))), F.get(words, F.lit(1)))).alias("skills"), F.when(k % 2 == 0, F.col("p_type")).otherwise(none).alias("role"),
        F.when(k % 3 == 0, "Senior").when(k % 3 == 1, "odd").otherwise(none).alias("band"), F.when(k % 4 == 0, F.array(F.get(words, F.lit(1)))).alias("negated"), texts.alias("queries"),
    )
    return graph.collect_terms(rows)


TERMS_OF_PARTS_SQL = f"""WITH r AS (SELECT p_partkey AS qid, string_split(p_name, ' ') AS w, * FROM part),
u AS (SELECT qid, 0 AS place, 0 AS at, lower(w[1]) AS term, 'skill' AS kind FROM r WHERE qid % 5 <> 0 UNION ALL SELECT qid, 0, 1, lower(w[2]), 'skill' FROM r WHERE qid % 5 <> 0
  UNION ALL SELECT qid, 1, 0, lower(p_type), 'role' FROM r WHERE qid % 2 = 0
  UNION ALL SELECT qid, 2, 0, unnest({listed(vocab.SENIORITY["senior"])}), 'role' FROM r WHERE qid % 3 = 0 UNION ALL SELECT qid, 2, 0, 'odd', 'role' FROM r WHERE qid % 3 = 1
  UNION ALL SELECT qid, 3, 0, unnest(regexp_split_to_array(lower(p_name || ' and spark, senior ' || p_brand), '[\\s,]+')), 'skill' FROM r
  UNION ALL SELECT qid, 4, 0, trim(unnest(regexp_split_to_array(lower('related ' || p_type || '. go'), '[\\s,]+')), '.'), 'domain' FROM r)
SELECT qid, term, arg_min(kind, place) AS kind FROM u JOIN r USING (qid) WHERE NOT (qid % 4 = 0 AND term = w[2]) AND (place < 3 OR (length(term) >= 3 AND NOT list_contains({listed(vocab.GRAPH_STOP)}, term))) GROUP BY qid, term"""


def _branches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A hybrid branch that scores by skill level, and the graph branch."""
    from .index_queries import _profile_index

    held = settled(encoding.has_skill(spark, sf))
    relations, top = _profile_index(spark, sf, held)
    queries = _terms(spark).groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("text"))
    terms = lexical.query_terms(queries, F.split("text", " "), ["qid"])
    scores = lexical.bm25(relations, terms, ["qid"], delta=0.0)
    scaled = lexical.min_max(scores.withColumn("score", F.round("score", 6)), ["qid"]).select("qid", F.col("doc_id").alias("id"), F.round("normalised", 4).alias("score"))
    detail = top.select(F.col("doc_id").alias("id"), F.col("core_names").alias("core_skills"))
    years = encoding.profiles(spark, sf).select(F.col("cid").alias("id"), "years", "roles")
    hybrid = scaled.join(detail, "id").join(years, "id").select("qid", "id", "score", "core_skills", F.array().cast("array<string>").alias("matched_terms"), "years", "roles")
    found = _candidates(spark, sf, held).select("qid", F.col("cid").alias("id"), F.round(F.col("score") / 100, 6).alias("score"), "core_skills", "matched_terms", "years", "roles")
    return hybrid, found


BRANCHES_SQL = f"""words AS (SELECT cid, unnest(string_split(skill, ' ')) AS term, greatest(1, CAST(round_even(2 * weight, 0) AS INTEGER)) AS copies FROM hs),
post AS (SELECT cid, term, sum(copies) AS tf FROM words GROUP BY cid, term), dls AS (SELECT cid, sum(tf) AS dl FROM post GROUP BY cid),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls), tms AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM post, corpus GROUP BY term, n),
bs AS (SELECT qid, p.cid, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS raw FROM terms JOIN tms USING (term) JOIN post p USING (term) JOIN dls ON dls.cid = p.cid, corpus GROUP BY qid, p.cid),
tops AS (SELECT cid, coalesce(list(skill ORDER BY rn) FILTER (WHERE weight >= 1.2), []) AS core_skills FROM (SELECT cid, skill, weight, row_number() OVER (PARTITION BY cid ORDER BY weight DESC, skill) AS rn FROM hs) WHERE rn <= 10 GROUP BY cid),
hb AS (SELECT b.qid, b.cid AS id, round(CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (raw - lo) / (hi - lo) END, 4) AS score, core_skills, years, role FROM (SELECT *, min(raw) OVER (PARTITION BY qid) AS lo, max(raw) OVER (PARTITION BY qid) AS hi FROM bs) b JOIN tops USING (cid) JOIN prof USING (cid)),
kb AS (SELECT qid, cid AS id, round(score / 100, 6) AS score, core_skills, matched, years, role FROM ca)"""


def tag_and_combine(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.tagged(*_branches(spark, sf))


def branch_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.branch_counts(tag_and_combine(spark, sf))


def _intents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTENTS, "qid int, intent string, confidence double, modifiers array<string>, negated array<string>")


def _ranked(spark: SparkSession, sf: str, limit: int | None = None) -> DataFrame:
    return rerank.reranked(rerank.pooled(*_branches(spark, sf)), _intents(spark), limit=limit, keep=settled)


RANK_COLUMNS = ["qid", "id", "rank", "final_score", "hybrid_score", "kg_score", "alpha", "beta", "modifier_delta", "source", "years"]


def rerank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select(*RANK_COLUMNS, F.size("core_skills").alias("skills"), F.array_join("matched_terms", ",").alias("matched"))


RERANK_SQL = f"""{values("intents", "qid, alpha, conf, bonus, negated", [(1, 0.30, 0.9, 0.05, listed(["anvil"])), (2, 0.40, 0.75, 0.03, listed([])), (3, 0.50, 0.5, 0.0, listed(["red"]))])},
pool AS (SELECT coalesce(h.qid, k.qid) AS qid, coalesce(h.id, k.id) AS id, coalesce(h.score, 0) AS hybrid_score, coalesce(k.score, 0) AS kg_score,
  CASE WHEN len(coalesce(k.core_skills, [])) > 0 THEN k.core_skills ELSE coalesce(h.core_skills, []) END AS core_skills, coalesce(k.matched, '') AS matched, coalesce(k.years, h.years) AS years, coalesce(k.role, h.role) AS role,
  CASE WHEN h.id IS NOT NULL AND k.id IS NOT NULL THEN 'both' WHEN h.id IS NOT NULL THEN 'hybrid_only' ELSE 'kg_only' END AS source FROM hb h FULL OUTER JOIN kb k ON h.qid = k.qid AND h.id = k.id),
al AS (SELECT pool.*, round(0.5 + (alpha - 0.5) * conf, 6) AS a, round(1 - round(0.5 + (alpha - 0.5) * conf, 6), 6) AS b,
  bonus - CAST(0.1 AS DOUBLE) * len(list_filter(negated, lambda n: len(list_filter(core_skills, lambda s: contains(lower(s), n))) > 0)) AS d FROM pool JOIN intents USING (qid)),
fi AS (SELECT *, greatest(0, least(1, a * hybrid_score + b * kg_score + d)) AS f FROM al),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f DESC, id) AS rank FROM fi)"""
FULL = f"{GRAPH}, {PATTERNS_SQL}, {CANDIDATES_SQL}, {BRANCHES_SQL}"


def scaled_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Re-ranking with both branches brought to 0..1 first: extremes of the final scores by query and source."""
    out = rerank.rounded(rerank.finals(rerank.pooled(*_branches(spark, sf)), _intents(spark), scale=True))
    return out.groupBy("qid", "source").agg(F.count("*").alias("n"), F.max("final_score").alias("most"), F.min("final_score").alias("least"))


SCALED_SQL = f"""{FULL}, {RERANK_SQL},
mm AS (SELECT *, min(hybrid_score) OVER w AS hl, max(hybrid_score) OVER w AS hh, min(kg_score) OVER w AS kl, max(kg_score) OVER w AS kh FROM al WINDOW w AS (PARTITION BY qid)),
sf AS (SELECT qid, source, round(greatest(0, least(1, a * CASE WHEN hh = hl THEN CASE WHEN hh > 0 THEN 1.0 ELSE 0 END ELSE (hybrid_score - hl) / (hh - hl) END + b * CASE WHEN kh = kl THEN CASE WHEN kh > 0 THEN 1.0 ELSE 0 END ELSE (kg_score - kl) / (kh - kl) END + d)), 4) AS f FROM mm)
SELECT CAST(qid AS INTEGER) AS qid, source, count(*) AS n, max(f) AS most, min(f) AS least FROM sf GROUP BY qid, source"""


def frontend_shape(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _ranked(spark, sf)
    details = encoding.profiles(spark, sf).select(F.col("cid").alias("id"), "name").crossJoin(F.broadcast(_intents(spark).select("qid")))
    none = "array<struct<query_term:string,matched_node:string,relationship:string,hops:int,score_delta:double>>"
    details = details.select("qid", "id", "name", F.lit("").alias("summary"), F.lit(None).cast(none).alias("reasons"))
    asked = _intents(spark).select("qid", "intent", "confidence").join(_terms(spark).groupBy("qid").agg(F.sort_array(F.collect_list("term")).alias("skills")), "qid")
    shown = explain.display(ranked, details, asked)
    return shown.select("qid", "id", "rank", "title", F.round("rrf_score", 4).alias("rrf_score"), "source", F.size("skills").alias("skills"), F.array_join("skill_overlap", ",").alias("overlap"), F.array_join("keyword_highlights", ",").alias("chips"), "bm25_percent", "semantic_percent", "intent_alignment")


SHAPE_SQL = f"""{FULL}, {RERANK_SQL}, qs AS (SELECT qid, list(term) AS qterms FROM terms GROUP BY qid), names(qid, intent, conf) AS (VALUES (1, 'domain_search', '0.90'), (2, 'multi_skill', '0.75'), (3, 'anything', '0.50'))
SELECT CAST(rk.qid AS INTEGER) AS qid, rk.id, CAST(rank AS INTEGER) AS rank, role AS title, round(f, 4) AS rrf_score, source, CAST(least(len(core_skills), 10) AS INTEGER) AS skills,
  array_to_string(list_slice(list_filter(core_skills, lambda s: len(list_filter(qterms, lambda t: contains(lower(s), t) OR contains(t, lower(s)))) > 0), 1, 8), ',') AS overlap,
  array_to_string(list_slice(string_split(matched, ','), 1, 8), ',') AS chips, CAST(round(round(a, 4) * 100) AS INTEGER) AS bm25_percent, CAST(round(round(b, 4) * 100) AS INTEGER) AS semantic_percent,
  'Intent: ' || intent || ' (confidence ' || conf || '). Retrieved via: ' || source || '.' AS intent_alignment FROM rk JOIN qs USING (qid) JOIN names USING (qid)"""


def explanations(spark: SparkSession, sf: str) -> DataFrame:
    """Stub texts, tiers and the narration that needs no service, for the best five of each query."""
    top = _ranked(spark, sf, limit=5)
    text = explain.narration(F.col("source"), F.col("alpha"), F.col("beta"), F.array().cast("array<string>"), F.col("core_skills"))
    return top.select("qid", "id", explain.score_tier(F.col("final_score")).alias("tier"), explain.share_tier(F.col("alpha")).alias("share"), explain.stub(F.col("id"), F.col("final_score"), F.col("source")).alias("stub"), text.alias("narration"))


EXPLAIN_SQL = f"""{FULL}, {RERANK_SQL}
SELECT CAST(qid AS INTEGER) AS qid, id, CASE WHEN round(f, 4) >= 0.8 THEN 'top-ranked' WHEN round(f, 4) >= 0.5 THEN 'highly ranked' WHEN round(f, 4) >= 0.25 THEN 'mid-ranked' ELSE 'lower-ranked' END AS tier,
  CASE WHEN a >= 0.65 THEN 'very strong' WHEN a >= 0.45 THEN 'strong' WHEN a >= 0.25 THEN 'moderate' ELSE 'weak' END AS share,
  printf('Candidate %s: final score %.3f (source: %s). Click ''Why Selected'' to generate a full AI explanation.', CAST(id AS VARCHAR), round(round(f, 4), 3), source) AS stub,
  source || ' was retrieved with ' || CASE WHEN a >= b THEN 'keyword and lexical' ELSE 'knowledge-graph and semantic' END || ' signals leading the match. ' || CASE WHEN len(core_skills) > 0 THEN 'Relevant skills include ' || array_to_string(list_slice(core_skills, 1, 4), ', ') || '.' ELSE '' END
  || ' The combined retrieval score places this candidate in the result set based on alignment with the search intent across both retrieval channels.' AS narration FROM rk WHERE rank <= 5"""


def skill_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every skill as wanted by name, and by a made-up name that has it, after one that nobody has, as a synonym."""
    post = encoding.skill_rows(spark, sf)
    names = post.select("skill").distinct()
    like = F.concat(F.lit("like "), "skill")
    wanted = names.select(F.lit(1).alias("qid"), "skill").unionByName(names.select(F.lit(2).alias("qid"), like.alias("skill")))
    synonyms = names.select(like.alias("term"), F.inline(F.array(F.struct(F.lit("nobody").alias("synonym"), F.lit(0).alias("place")), F.struct(F.col("skill").alias("synonym"), F.lit(1).alias("place")))))
    return lexical.matched_skills(wanted, synonyms, post)


SKILL_MATCHES_SQL = f"""{HAS} SELECT CAST(1 AS INTEGER) AS qid, cid AS doc_id, skill AS wanted, skill, weight, CAST(NULL AS VARCHAR) AS via FROM hs
UNION ALL SELECT 2, cid, 'like ' || skill, skill, weight, 'synonym of ' || chr(39) || 'like ' || skill || chr(39) FROM hs"""


def reasons_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons of each graph candidate by falling gain, then hops."""
    skills, edges = _graph(spark, sf)
    found = graph.scored(graph.hits(skills, encoding.suitable(spark, sf), edges, _terms(spark), settled))
    return found.select("qid", "cid", F.posexplode("reasons").alias("place", "r")).select("qid", "cid", "place", "r.query_term", "r.matched_node", "r.hops")


REASONS_SQL = f"""{GRAPH}, {PATTERNS_SQL} SELECT CAST(qid AS INTEGER) AS qid, cid, CAST(row_number() OVER (PARTITION BY qid, cid ORDER BY delta DESC, hops, term, node) - 1 AS INTEGER) AS place, term AS query_term, node AS matched_node, CAST(hops AS INTEGER) AS hops FROM hits"""


def skill_names_union(spark: SparkSession, sf: str) -> DataFrame:
    """Names of core and secondary skills together."""
    top = index.top_skills(encoding.skill_rows(spark, sf))
    return top.select("doc_id", F.array_join(F.array_sort(F.array_union("core_names", "secondary_names")), ",").alias("names"))


NAMES_UNION_SQL = f"""{HAS} SELECT cid AS doc_id, string_agg(skill, ',' ORDER BY skill) AS names FROM (SELECT cid, skill, row_number() OVER (PARTITION BY cid ORDER BY weight DESC, skill) AS rn FROM hs) WHERE rn <= 10 GROUP BY cid"""


def unique_skills(spark: SparkSession, sf: str) -> DataFrame:
    """The sorted vocabulary with places."""
    own = settled(index.vocabulary(encoding.skill_rows(spark, sf), "skill").select("skill", F.lit(1).alias("g"), F.lit(0).alias("even")))
    return ranks.numbered(own, ["g"], "even", "skill", "place").select("skill", "place")


def skill_search(spark: SparkSession, sf: str) -> DataFrame:
    """Holders of weighted skills with the share of the query's skills that each holds, and the score within its query."""
    post = encoding.skill_rows(spark, sf)
    asked = held_terms(post, "skill", _terms(spark).select("qid", "term"), fold=False).select("qid", "skill").distinct()
    scores = post.join(asked, "skill").groupBy("qid", "doc_id").agg(F.sum("weight").alias("score"))
    found = lexical.with_skills(scores.withColumn("score", F.round("score", 4)), asked, post)
    return found.select("qid", "doc_id", "score", F.round("normalised", 6).alias("normalised"), F.array_join("matched_skills", ",").alias("matched"), "skill_overlap")


SEARCH_SQL = f"""{HAS}, {TERMS_SQL}, a AS (SELECT DISTINCT qid, skill FROM hs, terms WHERE contains(skill, term)), n AS (SELECT qid, count(*) AS n FROM a GROUP BY qid),
s AS (SELECT qid, cid, round(sum(weight), 4) AS score, string_agg(skill, ',' ORDER BY skill) AS matched, count(*) AS m FROM hs JOIN a USING (skill) GROUP BY qid, cid),
e AS (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM s)
SELECT CAST(e.qid AS INTEGER) AS qid, cid AS doc_id, score, round(CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END, 6) AS normalised, matched, round(m / CAST(n AS DOUBLE), 3) AS skill_overlap FROM e JOIN n ON n.qid = e.qid"""


def hit_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of hits and the sentence that joins them."""
    top = index.top_skills(encoding.skill_rows(spark, sf))
    k = F.col("doc_id")
    core, other = (F.filter(c, lambda s: F.contains(s, F.lit("e"))) for c in ("core_names", "secondary_names"))
    band = F.when(k % 2 == 0, F.lit("senior"))
    reasons = fusion.signals(core, other, (k % 7 / 10).cast("double"), (k % 10 / 10).cast("double"), band, F.when(k % 3 > 0, (k % 9).cast("double")))
    return top.select("doc_id", fusion.why(reasons).alias("why"))


HIT_REASONS_SQL = f"""{HAS}, t AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY weight DESC, skill) AS rn FROM hs QUALIFY rn <= 10),
g AS (SELECT cid, string_agg(skill, ', ' ORDER BY rn) FILTER (WHERE weight >= 1.2 AND contains(skill, 'e')) AS c, string_agg(skill, ', ' ORDER BY rn) FILTER (WHERE weight < 1.2 AND contains(skill, 'e')) AS o FROM t GROUP BY cid)
SELECT cid AS doc_id, coalesce(nullif(concat_ws(' | ', 'Core skill match: ' || c, 'Secondary skill match: ' || o, CASE WHEN cid % 7 > 0 THEN printf('Keyword relevance (BM25=%.3f)', cid % 7 / 10.0::DOUBLE) END,
  CASE WHEN cid % 10 > 5 THEN printf('Semantic similarity (cos=%.3f)', cid % 10 / 10.0::DOUBLE) END, CASE WHEN cid % 2 = 0 THEN 'Experience band ' || chr(39) || 'senior' || chr(39) || ' — candidate has ' || CAST(CASE WHEN cid % 3 > 0 THEN cid % 9 ELSE 0 END AS VARCHAR) || '.0 yrs' END), ''), 'General profile relevance') AS why FROM g"""

QUERIES = {
    "skill_lookup": (skill_lookup, SKILL_LOOKUP_SQL),
    "top_skills": (top_skills, TOP_SKILLS_SQL),
    "skill_cooccurrence": (skill_cooccurrence, f"{HAS}, {EDGES_SQL} SELECT s1, s2, w FROM co WHERE s1 < s2"),
    "related_skills": (related_skills, f"{HAS}, {EDGES_SQL} SELECT s1 AS src, s2 AS dst, w, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY w DESC, s2) AS rn FROM co) WHERE rn <= 3"),
    "graph_stats": (graph_stats, f"{HAS}, {EDGES_SQL} SELECT (SELECT count(DISTINCT skill) FROM hs) AS nodes, count(*) AS edges, CAST(sum(w) AS BIGINT) AS weight FROM co WHERE s1 < s2"),
    "skill_frequency": (skill_frequency, f"{HAS} SELECT skill, count(DISTINCT cid) AS profiles FROM hs GROUP BY skill"),
    "reasons_sorted": (reasons_sorted, REASONS_SQL),
    "skill_names_union": (skill_names_union, NAMES_UNION_SQL),
    "unique_skills": (unique_skills, f"{HAS} SELECT skill, CAST(row_number() OVER (ORDER BY skill) AS INTEGER) AS place FROM (SELECT DISTINCT skill FROM hs)"),
    "skill_search": (skill_search, SEARCH_SQL),
    "hit_reasons": (hit_reasons, HIT_REASONS_SQL),
    "skill_matches": (skill_matches, SKILL_MATCHES_SQL),
    "node_counts": (node_counts, f"{HAS} SELECT 'Skill' AS label, count(DISTINCT skill) AS n FROM hs UNION ALL SELECT 'Candidate', count(DISTINCT c_custkey) FROM customer UNION ALL SELECT 'Role', count(DISTINCT c_mktsegment) FROM customer"),
    "experience_filter": (experience_filter, EXPERIENCE_SQL),
    "graph_hop1_direct": (hop1_direct, _hop_sql("h1")),
    "graph_hop2_related": (hop2_related, _hop_sql("h2")),
    "graph_hop2_domain": (hop2_domain, _hop_sql("hd")),
    "graph_hop1_role": (hop1_role, _hop_sql("hr")),
    "graph_hop3": (hop3, _hop_sql("h3")),
    "graph_hop4": (hop4, _hop_sql("h4")),
    "graph_terms": (graph_terms, TERMS_OF_PARTS_SQL),
    "graph_score": (graph_score, f"{GRAPH}, {PATTERNS_SQL}, {CANDIDATES_SQL} SELECT CAST(qid AS INTEGER) AS qid, cid, graph_score, experience_score, score, matched, reasons, best FROM ca"),
    "negation_filter": (negation_filter, NEGATION_SQL),
    "tag_and_combine": (tag_and_combine, f"{FULL} SELECT CAST(coalesce(h.qid, k.qid) AS INTEGER) AS qid, coalesce(h.id, k.id) AS id, CASE WHEN h.id IS NOT NULL THEN h.score ELSE k.score END AS score, CASE WHEN h.id IS NOT NULL AND k.id IS NOT NULL THEN 'both' WHEN h.id IS NOT NULL THEN 'hybrid' ELSE 'kg' END AS source FROM hb h FULL OUTER JOIN kb k ON h.qid = k.qid AND h.id = k.id"),
    "branch_counts": (branch_counts, f"{FULL} SELECT CAST(coalesce(h.qid, k.qid) AS INTEGER) AS qid, count(h.id) AS hybrid_n, count(k.id) AS kg_n, count(*) FILTER (WHERE h.id IS NOT NULL AND k.id IS NOT NULL) AS overlap_n FROM hb h FULL OUTER JOIN kb k ON h.qid = k.qid AND h.id = k.id GROUP BY 1"),
    "rerank_fusion": (rerank_fusion, f"{FULL}, {RERANK_SQL} SELECT CAST(qid AS INTEGER) AS qid, id, CAST(rank AS INTEGER) AS rank, round(f, 4) AS final_score, round(hybrid_score, 4) AS hybrid_score, round(kg_score, 4) AS kg_score, round(a, 4) AS alpha, round(b, 4) AS beta, round(d, 4) AS modifier_delta, source, years, CAST(len(core_skills) AS INTEGER) AS skills, matched FROM rk"),
    "scaled_rerank": (scaled_rerank, SCALED_SQL),
    "frontend_shape": (frontend_shape, SHAPE_SQL),
    "explanations": (explanations, EXPLAIN_SQL),
}
