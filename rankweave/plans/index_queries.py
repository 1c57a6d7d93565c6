"""Queries of the lexical index, dense vectors and rank fusion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.functions import vocab
from rankweave.operators import dense, fusion, incremental, index, lexical, metrics, pruned, threshold, understand
from rankweave.sources.io import table

from . import encoding
from .folders import dealt, settled
from .sql import INDEX, tokens, values

TOP = 10  # of the top-k reports
#: Scores are compared at six places, so that equal documents tie whatever the order of summation.
PLACES = 6
PAIRS = 1 << 22  # scores that a task makes where all pairs are asked for

VARIANTS = [
    (1, "the and of", "original"),
    (1, "with that from", "related_tech"),
    (1, "the was are", "template"),
    (2, "licensed under apache license", "original"),
    (2, "gnu general public license", "synonym"),
    (3, "no such zzzz", "original"),
]
SKILL_QUERIES = [(1, "blue anvil", "blue anvil"), (2, "red bolt green", "red bolt"), (3, "anvil", "zzz")]


DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _corpus(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return index.build_texts(table(spark, sf, "documents"), "doc_id", "text", dealt)


def _benchmark_terms(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.query_terms(table(spark, sf, "benchmark"), T.bm25_tokens(F.col("text")), ["item_id"])


QUERY_TERMS_SQL = tokens("benchmark", "item_id", "text", "qtok") + ",\nqt AS (SELECT item_id, term, count(*) AS n FROM qtok GROUP BY item_id, term)"


def tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = _corpus(spark, sf)
    return found["postings"].groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.count("*").alias("terms"))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf)["term_stats"].select("term", "df", F.round("idf", PLACES).alias("idf"))


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = _corpus(spark, sf)
    return found["corpus_stats"].crossJoin(found["term_stats"].agg(F.count("*").alias("vocabulary"))).select("n", F.round("avgdl", PLACES).alias("avgdl"), "vocabulary")


def _ranked(scores: DataFrame, keys: list[str], k: int = TOP) -> DataFrame:
    return lexical.top_k(scores.withColumn("score", F.round("score", PLACES)), keys, k)


def bm25_plus_topk(spark: SparkSession, sf: str) -> DataFrame:
    scores = lexical.bm25(_corpus(spark, sf), _benchmark_terms(spark, sf), ["item_id"])
    return _ranked(lexical.positive(scores), ["item_id"]).select("item_id", "rank", "doc_id", "score")


BM25_SQL = """s AS (SELECT item_id, p.doc_id, round(sum(n_ * idf * (tf * (1.5::DOUBLE + 1) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)) + 0.5::DOUBLE)), 6) AS score
  FROM (SELECT item_id, term, n AS n_ FROM qt) q JOIN terms USING (term) JOIN post p USING (term) JOIN dls ON dls.doc_id = p.doc_id, corpus GROUP BY item_id, p.doc_id)"""


def _pruned(spark: SparkSession, sf: str, k: int = TOP) -> DataFrame:
    """The benchmark passages against stored blocks: scores of the documents that were opened, and the postings that each took."""
    found = _corpus(spark, sf)
    impacts = pruned.with_impact(found["postings"], found["corpus_stats"]).select("doc_id", "term", "u")
    blocks = settled(pruned.range_blocks(impacts, store=settled))
    return settled(pruned.top_k(blocks, _benchmark_terms(spark, sf), ["item_id"], k, found["corpus_stats"].first()["n"], settled))


def bm25_pruned_topk(spark: SparkSession, sf: str) -> DataFrame:
    """As bm25_plus_topk, from blocks with their maxima and without scoring every posting."""
    return _ranked(lexical.positive(_pruned(spark, sf)), ["item_id"]).select("item_id", "rank", "doc_id", "score")


def term_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Which words of each benchmark passage each document holds; the count and the first of them."""
    hits = lexical.matched_terms(_corpus(spark, sf)["postings"], _benchmark_terms(spark, sf), ["item_id"])
    return hits.select("item_id", "doc_id", F.size("matched").cast("long").alias("n"), F.get("matched", F.lit(0)).alias("first"))


def bm25_normalized(spark: SparkSession, sf: str) -> DataFrame:
    scores = lexical.bm25(_corpus(spark, sf), _benchmark_terms(spark, sf), ["item_id"])
    return lexical.min_max(scores, ["item_id"]).groupBy("item_id").agg(F.count("*").alias("hits"), F.round(F.avg("normalised"), 4).alias("mean"), F.max("normalised").alias("most"))


def _variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIANTS, "qid int, query string, strategy string")


def _aggregated(spark: SparkSession, sf: str) -> DataFrame:
    terms = lexical.query_terms(_variants(spark), T.bm25_tokens(F.col("query")), ["qid", "query", "strategy"])
    return lexical.over_variants(lexical.bm25_parts(_corpus(spark, sf), terms, ["qid", "strategy", "query"], delta=0.0))


VARIANTS_SQL = (
    values("v", "qid, query, strategy", VARIANTS)
    + ",\nvtok AS (SELECT qid, strategy, query, unnest(string_split(coalesce(f, t), ' ')) AS term FROM (SELECT *, unnest(regexp_extract_all(query, '[a-z0-9][a-z0-9+#_]*')) AS t FROM v) LEFT JOIN abbr ON t = a),\n"
    + """vt AS (SELECT qid, strategy, query, term, count(*) AS m FROM vtok GROUP BY ALL),
parts AS (SELECT qid, p.doc_id, term, sum(CASE WHEN strategy IN ('original', 'synonym') THEN 1.0::DOUBLE WHEN strategy = 'related_tech' THEN 1.2::DOUBLE ELSE 0.6::DOUBLE END
    * m * idf * tf * (1.5::DOUBLE + 1) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS part
  FROM vt JOIN terms USING (term) JOIN post p USING (term) JOIN dls ON dls.doc_id = p.doc_id, corpus GROUP BY qid, p.doc_id, term),
sums AS (SELECT qid, doc_id, sum(part) AS raw FROM parts GROUP BY qid, doc_id),
agg AS (SELECT qid, doc_id, raw / max(raw) OVER (PARTITION BY qid) AS score, max(raw) OVER (PARTITION BY qid) AS most FROM sums)"""
)


def bm25_variant_agg(spark: SparkSession, sf: str) -> DataFrame:
    return _aggregated(spark, sf).select("qid", "doc_id", F.round("score", PLACES).alias("score"))


def matched_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Contributions of query words to each hit, at three places, by word."""
    words = F.transform("keywords", lambda p: F.struct(p["term"], F.round(p["contribution"], 3).alias("c")))
    return _aggregated(spark, sf).select("qid", "doc_id", F.inline(words)).where("c > 0").select("qid", "doc_id", "term", F.col("c").alias("contribution"))


MATCHED_SQL = """SELECT CAST(qid AS INTEGER) AS qid, doc_id, term, c AS contribution FROM (SELECT p.qid, p.doc_id, term, round(round(part / most, 4), 3) AS c FROM parts p JOIN agg a ON a.qid = p.qid AND a.doc_id = p.doc_id) WHERE c > 0"""


def keywords_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Query words of each hit by falling contribution."""
    return _aggregated(spark, sf).select("qid", "doc_id", F.posexplode("keywords").alias("place", "k")).select("qid", "doc_id", "place", "k.term")


RANKED_SQL = """SELECT CAST(qid AS INTEGER) AS qid, doc_id, CAST(row_number() OVER (PARTITION BY qid, doc_id ORDER BY c DESC, term) - 1 AS INTEGER) AS place, term FROM (SELECT p.qid, p.doc_id, term, round(part / most, 4) AS c FROM parts p JOIN agg a ON a.qid = p.qid AND a.doc_id = p.doc_id) WHERE c > 0"""


def top_intents(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen vectors as hypotheses of their label's intent: the three best intents of every vector, and what they decide."""
    rows = _vectors(spark, sf)
    asked = rows.where("doc_id < 16").select(F.concat(F.lit("intent"), "label").alias("intent"), F.col("vec").alias("qvec"))
    top = understand.top_intents(dense.scores(asked, rows.select("doc_id", "vec")), ["doc_id"])
    said = understand.judged(top, ["doc_id"]).select("doc_id", F.col("intent").alias("said"), F.array_join("modifiers", ",").alias("modifiers"))
    return top.join(said, "doc_id").select("doc_id", "place", "intent", F.round("score", PLACES).alias("score"), "said", "modifiers")


INTENTS_SQL = f"""WITH h AS (SELECT b.vec_id AS doc_id, 'intent' || a.label AS intent, max({DOT}) AS score FROM embeddings a, embeddings b WHERE a.vec_id < 16 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, intent) AS place FROM h QUALIFY place <= 3),
j AS (SELECT doc_id, CASE WHEN max(score) FILTER (WHERE place = 1) >= 0.4::DOUBLE THEN max(intent) FILTER (WHERE place = 1) ELSE 'unknown' END AS said,
  CASE WHEN max(score) FILTER (WHERE place = 1) >= 0.4::DOUBLE THEN coalesce(string_agg(intent, ',' ORDER BY place) FILTER (WHERE place > 1 AND score >= 0.3::DOUBLE), '') ELSE '' END AS modifiers FROM t GROUP BY doc_id)
SELECT doc_id, CAST(place AS INTEGER) AS place, intent, round(score, 6) AS score, said, modifiers FROM t JOIN j USING (doc_id)"""


def encoded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Part names by an injected encoder, as documents and, with a prefix, as queries."""
    encoder = lambda texts: np.array([[len(t), t.count("e"), 1.0] for t in texts])
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    both = dense.encode(dense.encode(parts, "p_name", encoder), "p_name", encoder, prefix="query: ", out="asked")
    return both.select("p_partkey", *[F.round(F.get(v, F.lit(i)), PLACES).alias(f"{v}{i}") for v in ("vec", "asked") for i in range(3)])


ENCODED_SQL = """WITH r AS (SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS n, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS DOUBLE) AS e FROM part)
SELECT p_partkey, round(n / sqrt(n * n + e * e + 1), 6) AS vec0, round(e / sqrt(n * n + e * e + 1), 6) AS vec1, round(1 / sqrt(n * n + e * e + 1), 6) AS vec2, round((n + 7) / sqrt((n + 7) * (n + 7) + (e + 1) * (e + 1) + 1), 6) AS asked0,
  round((e + 1) / sqrt((n + 7) * (n + 7) + (e + 1) * (e + 1) + 1), 6) AS asked1, round(1 / sqrt((n + 7) * (n + 7) + (e + 1) * (e + 1) + 1), 6) AS asked2 FROM r"""


def vector_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors removed, appended, and some of them asked for by id."""
    rows = _vectors(spark, sf).select("doc_id", "vec")
    kept = incremental.removed(rows, rows.where("doc_id % 5 = 0"), "doc_id")
    more = incremental.upserted(kept, rows.where("doc_id % 7 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "vec"), "doc_id")
    wanted = rows.where("doc_id % 3 = 0").select("doc_id").unionByName(rows.where("doc_id % 21 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id")))
    return incremental.get_many(more, wanted, "doc_id", {}).select("doc_id", F.get("vec", F.lit(0)).cast("double").alias("first"))


UPKEEP_SQL = """SELECT vec_id AS doc_id, CAST(CASE WHEN vec_id % 5 <> 0 THEN embedding[1] END AS DOUBLE) AS first FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, CAST(embedding[1] AS DOUBLE) FROM embeddings WHERE vec_id % 21 = 0"""


def plain_index(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the small index without skill cells: core skills count three times."""
    top = index.top_skills(encoding.skill_rows(spark, sf)).join(encoding.suitable(spark, sf).select(F.col("cid").alias("doc_id"), "role"), "doc_id")
    rows = top.select("doc_id", F.array_join("core_names", " ").alias("core"), F.array_join("secondary_names", " ").alias("secondary"), "role")
    found = index.plain_relations(rows, "doc_id", "core", ["secondary", "role"])
    return found["term_stats"].join(found["postings"].groupBy("term").agg(F.sum("tf").alias("total")), "term").select("term", "df", F.round("idf", PLACES).alias("idf"), "total")


PLAIN_SQL = f"""WITH {encoding.HAS_SKILL_SQL}, t AS (SELECT cid, unnest(string_split(skill, ' ')) AS w, CASE WHEN weight >= 1.2 THEN 3 ELSE 1 END AS n FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY weight DESC, skill) AS rn FROM hs) WHERE rn <= 10
  UNION ALL SELECT DISTINCT cid, lower(c_mktsegment), 1 FROM hs JOIN customer ON cid = c_custkey),
d AS (SELECT count(DISTINCT cid) AS docs FROM hs)
SELECT lower(w) AS term, count(DISTINCT cid) AS df, round(ln((docs - count(DISTINCT cid) + 0.5::DOUBLE) / (count(DISTINCT cid) + 0.5::DOUBLE) + 1), 6) AS idf, CAST(sum(n) AS BIGINT) AS total FROM t, d WHERE length(w) > 1 GROUP BY lower(w), docs"""


def variant_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five best positive hits of each variant."""
    terms = lexical.query_terms(_variants(spark), T.bm25_tokens(F.col("query")), ["qid", "query", "strategy"])
    scores = lexical.bm25(_corpus(spark, sf), terms, ["qid", "query", "strategy"], delta=0.0)
    return _ranked(lexical.positive(scores), ["qid", "query"], 5).select("qid", "query", "strategy", "rank", "doc_id", "score")


TOP5_SQL = """t5 AS (SELECT qid, query, strategy, p.doc_id, round(sum(m * idf * tf * (1.5::DOUBLE + 1) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM vt JOIN terms USING (term) JOIN post p USING (term) JOIN dls ON dls.doc_id = p.doc_id, corpus GROUP BY qid, query, strategy, p.doc_id)
SELECT CAST(qid AS INTEGER) AS qid, query, strategy, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, query ORDER BY score DESC, doc_id) AS rank FROM t5 WHERE score > 0) WHERE rank <= 5"""


def _profile_index(spark: SparkSession, sf: str, held: DataFrame | None = None, store: Callable[[DataFrame], DataFrame] = settled) -> tuple[dict[str, DataFrame], DataFrame]:
    """Relations of profiles as words, and their strongest skills; a skill of several words meets queries by its words."""
    held = settled(encoding.has_skill(spark, sf)) if held is None else held
    cells = encoding.cells(spark, sf, held).select(F.col("cid").alias("doc_id"), "cell")
    post = index.profile_postings(cells, "doc_id", ["cell"], [])
    words = store(post.select("doc_id", F.explode(F.split("term", "_")).alias("term"), "tf").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")))
    stats = index.doc_stats(words)
    corpus = index.corpus_stats(cells, stats)
    return {"postings": words, "doc_stats": stats, "corpus_stats": corpus, "term_stats": index.term_stats(words, corpus)}, store(index.top_skills(encoding.skill_rows(spark, sf, held)))


def bm25_boosted_topk(spark: SparkSession, sf: str) -> DataFrame:
    relations, top = _profile_index(spark, sf)
    queries = spark.createDataFrame(SKILL_QUERIES, "qid int, query string, core string")
    terms = lexical.query_terms(queries, T.bm25_tokens(F.col("query")), ["qid"])
    core = queries.select("qid", F.explode(F.split("core", " ")).alias("term"))
    parts = lexical.boosted_parts(relations, terms, lexical.skill_boosts(top), core, ["qid"])
    return _ranked(parts.groupBy("qid", "doc_id").agg(F.sum("part").alias("score")), ["qid"], 50).select("qid", "rank", "doc_id", "score")


BOOSTED_SQL = (
    "WITH "
    + encoding.HAS_SKILL_SQL
    + ",\n"
    + values("q", "qid, query, core", SKILL_QUERIES)
    + """,
words AS (SELECT cid, unnest(string_split(skill, ' ')) AS term, greatest(1, CAST(round_even(2 * weight, 0) AS INTEGER)) AS copies, weight FROM hs),
post AS (SELECT cid, term, sum(copies) AS tf FROM words GROUP BY cid, term),
top AS (SELECT * FROM (SELECT cid, skill, weight, row_number() OVER (PARTITION BY cid ORDER BY weight DESC, skill) AS rn FROM hs) WHERE rn <= 10),
boost AS (SELECT cid, term, max(CASE WHEN weight >= 1.2 THEN 3.0::DOUBLE ELSE 1.2::DOUBLE END) AS boost FROM (SELECT cid, weight, unnest(string_split(skill, ' ')) AS term FROM top) GROUP BY cid, term),
dls AS (SELECT cid, sum(tf) AS dl FROM post GROUP BY cid),
corpus AS (SELECT count(*) AS n, greatest(avg(dl), 1) AS avgdl FROM dls),
terms AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM post, corpus GROUP BY term, n),
qt AS (SELECT qid, core, term, count(*) AS m FROM (SELECT qid, core, unnest(string_split(query, ' ')) AS term FROM q) GROUP BY ALL),
s AS (SELECT qid, p.cid, round(sum(m * idf * CASE WHEN list_contains(string_split(core, ' '), term) THEN 1.5::DOUBLE ELSE 1 END
   * (tf * coalesce(boost, 1)) * 2.5::DOUBLE / (tf * coalesce(boost, 1) + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN terms USING (term) JOIN post p USING (term) LEFT JOIN boost USING (cid, term) JOIN dls ON dls.cid = p.cid, corpus GROUP BY qid, p.cid)
SELECT CAST(qid AS INTEGER) AS qid, CAST(rank AS INTEGER) AS rank, cid AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM s) WHERE rank <= 50"""
)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector whose id is divisible by 50 against all vectors, the ten nearest."""
    rows = _vectors(spark, sf)
    queries = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    return dense.top_k(queries, rows.select("doc_id", "vec"), TOP, places=PLACES).select("qid", "rank", "doc_id", "score")


DENSE_SQL = f"""SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
SELECT a.vec_id AS qid, b.vec_id AS doc_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10"""


def dense_weighted_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of three variants each: a vector, the next two, weighted by their strategies."""
    rows = _vectors(spark, sf)
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("strategy")) for i, s in enumerate(("original", "related_tech", "template"))]))
    asked = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), shift.alias("s")).select("qid", "s.i", "s.strategy")
    parts = rows.where(F.pmod("doc_id", F.lit(50)) < 3).select(F.col("doc_id").alias("v"), F.col("vec").alias("qvec"))
    queries = asked.join(parts, F.col("v") == F.col("qid") + F.col("i")).select("qid", "strategy", "qvec")
    mean = settled(dense.weighted_query(dense.variant_weights(queries), ["qid"]))
    return dense.scores(mean, rows.select("doc_id", "vec"), places=PLACES, clip=True, each=PAIRS).select("qid", "doc_id", "score")


WEIGHTED_SQL = f"""WITH s(i, w) AS (VALUES (0, 1.0::DOUBLE), (1, 1.2::DOUBLE), (2, 0.6::DOUBLE)), q AS (SELECT vec_id AS qid, i, w FROM embeddings, s WHERE vec_id % 50 = 0)
SELECT qid, b.vec_id AS doc_id, round(greatest(0, least(1, sum(w * {DOT}) / sum(w))), 6) AS score FROM q JOIN embeddings a ON a.vec_id = qid + i, embeddings b GROUP BY qid, b.vec_id"""


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf).select("doc_id", F.transform("vec", lambda x: x * F.lit(3.0).cast("float")).alias("vec"))
    one = rows.select("doc_id", dense.norm(F.col("vec")).alias("n"), dense.unit(F.col("vec")).alias("u"))
    return one.select("doc_id", F.round("n", 5).alias("norm"), F.round(F.get("u", F.lit(0)), 5).alias("first"), F.round(dense.norm(F.col("u")), 5).alias("unit"))


L2_SQL = """WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 3.0::FLOAT AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM r)
SELECT vec_id AS doc_id, round(n, 5) AS norm, round(v[1] / n, 5) AS first, 1.0::DOUBLE AS unit FROM n"""


def nearest_prototype(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    found = dense.nearest_prototype(rows.select("doc_id", "vec"), dense.centroids(rows, "label"), "label")
    return found.select("doc_id", "label", F.round("score", 5).alias("score"))


PROTOTYPE_SQL = """WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id, c.label, greatest(0, list_dot_product(embedding::DOUBLE[], centroid)) AS score FROM embeddings, c)
SELECT vec_id AS doc_id, label, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rn FROM s) WHERE rn = 1"""


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc_id, bm25, dense) of every document that has a vector, for the fixed queries; zero where a word is missing."""
    rows = _vectors(spark, sf).join(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "vec")
    lexical_ = _aggregated(spark, sf).select("qid", "doc_id", F.round("score", PLACES).alias("bm25"))
    queries = _variants(spark).select("qid").distinct().join(rows.select((F.col("doc_id") + 1).alias("qid"), F.col("vec").alias("qvec")), "qid")
    both = dense.scores(queries, rows).join(lexical_, ["qid", "doc_id"], "left")
    return settled(both.select("qid", "doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.round(dense.clipped(F.col("score")), PLACES).alias("dense")))


HYBRID_SQL = f"""hy AS (SELECT q.qid, b.vec_id AS doc_id, round(coalesce(agg.score, 0), 6) AS bm25, round(greatest(0, least(1, {DOT})), 6) AS dense
  FROM (SELECT DISTINCT qid FROM v) q JOIN embeddings a ON a.vec_id + 1 = q.qid, embeddings b JOIN documents d ON d.doc_id = b.vec_id LEFT JOIN agg ON agg.doc_id = b.vec_id AND agg.qid = q.qid),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc_id) AS rb, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id) AS rd FROM hy),
rf AS (SELECT *, 0.4::DOUBLE / (60 + rb) + 0.6::DOUBLE / (60 + rd) AS rrf FROM rr)"""


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.reciprocal_ranks(_hybrid(spark, sf), {"bm25": vocab.ALPHA_BM25, "dense": vocab.ALPHA_DENSE})
    return fused.select("qid", "doc_id", F.col("rank_bm25").cast("long").alias("rb"), F.col("rank_dense").cast("long").alias("rd"), F.round("rrf", 8).alias("rrf"))


def hybrid_gate_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion, a mask on every seventh document, a boost, the quality gate and the score floor."""
    fused = fusion.reciprocal_ranks(_hybrid(spark, sf), {"bm25": vocab.ALPHA_BM25, "dense": vocab.ALPHA_DENSE})
    fused = fused.withColumn("fused", F.round(fusion.boosted(F.col("rrf"), F.col("doc_id") % 7 != 0, (F.col("doc_id") % 3 == 0).cast("int")), 9))
    return fusion.floored(fusion.gated(fused), 50).select("qid", "rank", "doc_id", "fused")


def fused_threshold_topk(spark: SparkSession, sf: str) -> DataFrame:
    """As hybrid_gate_floor, by a threshold algorithm over both rankings."""
    rows = settled(_vectors(spark, sf).join(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "vec"))
    hits = _aggregated(spark, sf).select("qid", "doc_id", F.round("score", PLACES).alias("bm25")).where("bm25 > 0")
    hits = settled(hits.join(rows.select("doc_id"), "doc_id", "left_semi").select("qid", "doc_id", "bm25"))
    queries = settled(_variants(spark).select("qid").distinct().join(rows.select((F.col("doc_id") + 1).alias("qid"), F.col("vec").alias("qvec")), "qid"))

    def adjusted(seen: DataFrame) -> DataFrame:
        fused = F.round(fusion.boosted(F.col("rrf"), F.col("doc_id") % 7 != 0, (F.col("doc_id") % 3 == 0).cast("int")), 9)
        return seen.withColumn("fused", F.when(fusion.gate_passed(F.col("bm25"), F.col("dense"), F.col("_best")), fused).otherwise(0.0))

    found = threshold.fused_top(queries, rows, hits, 50, adjusted, 1.0 + vocab.CORE_HIT, places=PLACES, store=settled)
    return fusion.floored(found, 50).select("qid", "rank", "doc_id", "fused")


GATE_SQL = """g AS (SELECT qid, doc_id, bm25, dense, round(CASE WHEN doc_id % 7 <> 0 THEN rrf ELSE 0 END * (1 + 0.3::DOUBLE * CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END), 9) AS f0,
  max(dense) OVER (PARTITION BY qid) AS best FROM rf),
k AS (SELECT qid, doc_id, CASE WHEN bm25 >= 0.15 OR (dense >= CASE WHEN best > 0 THEN best * 0.75::DOUBLE ELSE 0.6 END AND bm25 > 0) THEN f0 ELSE 0 END AS fused FROM g),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, doc_id) AS rank, max(fused) OVER (PARTITION BY qid) AS top FROM k)
SELECT CAST(qid AS INTEGER) AS qid, CAST(rank AS INTEGER) AS rank, doc_id, fused FROM t WHERE rank <= 50 AND fused >= top * 0.35::DOUBLE AND fused > 0"""


def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 against the documents that hold a passage word for word."""
    found = bm25_plus_topk(spark, sf).select(F.col("item_id").alias("qid"), "doc_id", "rank")
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("p"))
    relevant = lexical.containing(table(spark, sf, "documents").select("doc_id", "text"), passages)
    per = metrics.retrieval_metrics(found, relevant, TOP)
    return per.select("qid", *[F.round(c, 5).alias(c) for c in ("p_at_k", "r_at_k", "ap", "rr", "ndcg")])


IR_SQL = """rel AS (SELECT item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
res AS (SELECT item_id AS qid, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10),
hit AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM res JOIN rel USING (qid, doc_id)),
tot AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
a AS (SELECT qid, count(*) AS h, sum(i / CAST(rank AS DOUBLE)) AS ap, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM hit GROUP BY qid)
SELECT qid, round(coalesce(h, 0) / 10::DOUBLE, 5) AS p_at_k, round(coalesce(h, 0) / CAST(n AS DOUBLE), 5) AS r_at_k, round(coalesce(ap, 0) / least(n, 10), 5) AS ap,
  round(coalesce(1 / CAST(first AS DOUBLE), 0), 5) AS rr, round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1 / log2(x + 1))), 5) AS ndcg FROM tot LEFT JOIN a USING (qid)"""


def hashed_projection(spark: SparkSession, sf: str) -> DataFrame:
    n, counted = index.text_counts(table(spark, sf, "documents"), "doc_id", "text")
    post = dealt(counted)
    vectors = dense.hashed_projection(post, index.term_stats(post, spark.createDataFrame([(n,)], "n long")), store=settled)
    return vectors.select("doc_id", F.size("vec").alias("dimensions"), F.round(dense.norm(F.col("vec")), 5).alias("norm"))


PROJECTION_SQL = "SELECT DISTINCT doc_id, CAST(384 AS INTEGER) AS dimensions, 1.0::DOUBLE AS norm FROM post"

QUERIES = {
    "tokenize_stats": (tokenize_stats, f"WITH {INDEX} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl, count(*) AS terms FROM post GROUP BY doc_id"),
    "term_stats": (term_stats, f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms"),
    "corpus_stats": (corpus_stats, f"WITH {INDEX} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM terms) AS vocabulary FROM corpus"),
    "bm25_plus_topk": (bm25_plus_topk, f"WITH {INDEX}, {QUERY_TERMS_SQL}, {BM25_SQL} SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"),
    "bm25_pruned_topk": (bm25_pruned_topk, f"WITH {INDEX}, {QUERY_TERMS_SQL}, {BM25_SQL} SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"),
    "term_matches": (term_matches, f"WITH {INDEX}, {QUERY_TERMS_SQL} SELECT item_id, doc_id, count(*) AS n, min(term) AS first FROM post JOIN qt USING (term) GROUP BY item_id, doc_id"),
    "bm25_normalized": (bm25_normalized, f"WITH {INDEX}, {QUERY_TERMS_SQL}, {BM25_SQL.replace('round(sum(', '(sum(').replace('), 6) AS score', ')) AS score')}, e AS (SELECT item_id, min(score) AS lo, max(score) AS hi FROM s GROUP BY item_id) SELECT item_id, count(*) AS hits, round(avg(CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END), 4) AS mean, max(CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END) AS most FROM s JOIN e USING (item_id) GROUP BY item_id"),
    "bm25_variant_agg": (bm25_variant_agg, f"WITH {INDEX}, {VARIANTS_SQL} SELECT CAST(qid AS INTEGER) AS qid, doc_id, round(score, 6) AS score FROM agg"),
    "matched_keywords": (matched_keywords, f"WITH {INDEX}, {VARIANTS_SQL} {MATCHED_SQL}"),
    "keywords_ranked": (keywords_ranked, f"WITH {INDEX}, {VARIANTS_SQL} {RANKED_SQL}"),
    "top_intents": (top_intents, INTENTS_SQL),
    "encoded_vectors": (encoded_vectors, ENCODED_SQL),
    "vector_upkeep": (vector_upkeep, UPKEEP_SQL),
    "plain_index": (plain_index, PLAIN_SQL),
    "variant_top5": (variant_top5, f"WITH {INDEX}, {VARIANTS_SQL}, {TOP5_SQL}"),
    "bm25_boosted_topk": (bm25_boosted_topk, BOOSTED_SQL),
    "dense_topk": (dense_topk, DENSE_SQL),
    "dense_weighted_avg": (dense_weighted_avg, WEIGHTED_SQL),
    "l2_normalize": (l2_normalize, L2_SQL),
    "nearest_prototype": (nearest_prototype, PROTOTYPE_SQL),
    "rrf_fusion": (rrf_fusion, f"WITH {INDEX}, {VARIANTS_SQL}, {HYBRID_SQL} SELECT CAST(qid AS INTEGER) AS qid, doc_id, rb, rd, round(rrf, 8) AS rrf FROM rf"),
    "hybrid_gate_floor": (hybrid_gate_floor, f"WITH {INDEX}, {VARIANTS_SQL}, {HYBRID_SQL}, {GATE_SQL}"),
    "fused_threshold_topk": (fused_threshold_topk, f"WITH {INDEX}, {VARIANTS_SQL}, {HYBRID_SQL}, {GATE_SQL}"),
    "ir_metrics": (ir_metrics, f"WITH {INDEX}, {QUERY_TERMS_SQL}, {BM25_SQL}, {IR_SQL}"),
    "hashed_projection": (hashed_projection, f"WITH {INDEX} {PROJECTION_SQL}"),
}
