"""Index relations: postings, document and term statistics, skill postings, vectors.

Relations are plain DataFrames: postings(doc_id, term, tf), doc_stats(doc_id, dl),
term_stats(term, df, idf), corpus_stats(n, avgdl), skill_postings(skill, doc_id, weight).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.functions import vocab

PIECE = 8 << 20  # bytes of text that a task tokenises


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Term frequencies; one shuffle by (doc_id, term) after partial counts."""
    return docs.select(F.col(key).alias("doc_id"), F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def token_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, term): the tokens of each text one by one, as text.bm25_tokens gives them; abbreviations come by a join with their fixed, small table."""
    table = docs.sparkSession.createDataFrame([(k, v.split(" ")) for k, v in vocab.ABBREVIATIONS.items()], "token string, words array<string>")
    own = F.col(key) if key == "doc_id" else F.col(key).alias("doc_id")  # an alias to the same name would part the stored rows from what is known of their dealing
    found = docs.select(own, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9][a-z0-9+#_]*"), F.lit(0))).alias("token"))
    return found.join(F.broadcast(table), "token", "left").select("doc_id", F.explode(F.coalesce("words", F.array("token"))).alias("term"))


def text_counts(docs: DataFrame, key: str, text: str, piece: int = PIECE) -> tuple[int, DataFrame]:
    """The number of texts, and (doc_id, term, tf) dealt by document.

    Texts move once, to their document's partition; counts of a document need no other move.
    There is a partition for each `piece` bytes of text, by counting them: tokens take far more memory than the compressed
    text by which Spark would join partitions, so a task's memory depends on `piece` and not on the corpus.
    """
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    own = docs.select(F.col(key), F.col(text)).repartition(1 + size // piece, key)
    return n, token_rows(own, key, text).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def build_texts(docs: DataFrame, key: str, text: str, store: Callable[[DataFrame], DataFrame], piece: int = PIECE) -> dict[str, DataFrame]:
    """All lexical relations of a text corpus; postings carry their document's length (dl) and are stored once by `store`.

    Rows are dealt as by text_counts(); lengths need no other move, nor do later scores where `store` keeps how rows are dealt
    (folders.dealt), so that a task of theirs has the documents of one piece too.
    """
    n, counted = text_counts(docs, key, text, piece)
    post = store(counted.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id"))))
    stats = post.groupBy("doc_id").agg(F.max("dl").alias("dl"))
    total = stats.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    corpus = docs.sparkSession.createDataFrame([(n, total / n if total else 1.0)], "n long, avgdl double")
    return {"postings": post, "doc_stats": stats, "corpus_stats": corpus, "term_stats": term_stats(post, corpus)}


def profile_postings(profiles: DataFrame, key: str, skill_columns: list[str], text_columns: list[str]) -> DataFrame:
    """Term frequencies of profiles: skills count by their level, other text by its tokens.

    A skill adds its copies for each column that holds it; its token is its name with underscores.
    """
    cells = F.concat(*[T.skill_cell(F.col(c)) for c in skill_columns]) if skill_columns else F.array().cast("array<struct<skill:string,weight:double>>")
    skills = profiles.select(F.col(key).alias("doc_id"), F.inline(cells)).select("doc_id", F.explode(T.bm25_tokens(F.replace("skill", F.lit(" "), F.lit("_")))).alias("term"), T.skill_copies(F.col("weight")).cast("long").alias("tf"))
    if not text_columns:
        return skills.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    words = F.concat_ws(" ", *[T.normal_text(F.col(c)) for c in text_columns])
    plain = profiles.select(F.col(key).alias("doc_id"), F.explode(T.bm25_tokens(words)).alias("term"), F.lit(1).cast("long").alias("tf"))
    return skills.unionByName(plain).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def doc_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def corpus_stats(docs: DataFrame, stats: DataFrame, floor: float = 0.0) -> DataFrame:
    """One row: documents, tokenless ones too, and their mean length (1 where there are none)."""
    n = docs.agg(F.count("*").alias("n"))
    total = stats.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return n.crossJoin(total).select("n", F.greatest(F.coalesce(F.when(mean > 0, mean), F.lit(1.0)), F.lit(float(floor))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def term_stats(post: DataFrame, corpus: DataFrame) -> DataFrame:
    """Document frequency and idf of every term; the corpus row is a single row, so it may be broadcast."""
    return post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def build(docs: DataFrame, key: str, tokens: Column) -> dict[str, DataFrame]:
    """All lexical relations of a text corpus."""
    post = postings(docs, key, tokens)
    stats = doc_stats(post)
    corpus = corpus_stats(docs, stats)
    return {"postings": post, "doc_stats": stats, "corpus_stats": corpus, "term_stats": term_stats(post, corpus)}


def skill_postings(profiles: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(skill, doc_id, weight): the largest weight of a skill over a profile's columns."""
    cells = F.concat(*[T.skill_cell(F.col(c)) for c in columns])
    return profiles.select(F.col(key).alias("doc_id"), F.inline(cells)).groupBy("skill", "doc_id").agg(F.max("weight").alias("weight"))


def lookup_skill(post: DataFrame, skills: DataFrame, k: int = 50) -> DataFrame:
    """The k profiles of the largest weight for each asked skill, ties by id."""
    rank = F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("weight"), "doc_id"))
    return post.join(skills.select("skill").distinct(), "skill").withColumn("rank", rank).where(F.col("rank") <= k)


def top_skills(post: DataFrame, k: int = 10, core: float = 1.2) -> DataFrame:
    """A profile's k strongest skills, cut into core and secondary ones by weight; ties by name."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "skill"))
    best = post.withColumn("rank", rank).where(F.col("rank") <= k)
    listed = best.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "skill", "weight"))).alias("s"))
    label = lambda s: F.concat(s["skill"], F.lit(" ("), T.weight_level(s["weight"]), F.lit(")"))
    one = lambda cond: F.filter("s", cond)
    is_core = lambda s: s["weight"] >= core
    names = lambda a: F.transform(a, lambda s: s["skill"])
    return listed.select(
        "doc_id",
        F.transform("s", lambda s: F.struct(s["skill"].alias("skill"), s["weight"].alias("weight"))).alias("top_skills"),
        names(one(is_core)).alias("core_names"),
        names(one(lambda s: ~is_core(s))).alias("secondary_names"),
        F.array_join(F.transform(one(is_core), label), ", ").alias("core_text"),
        F.array_join(F.transform(one(lambda s: ~is_core(s)), label), ", ").alias("secondary_text"),
    )


def cooccurrence(post: DataFrame) -> DataFrame:
    """(s1, s2, w), s1 < s2: profiles that have both skills. Skills of one profile are few, so pairs stay few a profile."""
    sets = post.groupBy("doc_id").agg(F.sort_array(F.collect_set("skill")).alias("s"))
    later = F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("s1"), b.alias("s2"))))
    return sets.select(F.inline(F.flatten(later))).groupBy("s1", "s2").agg(F.count("*").alias("w"))


def related(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent partners of each skill: (src, dst, w, rank), ties by name."""
    both = pairs.select(F.col("s1").alias("src"), F.col("s2").alias("dst"), "w").unionByName(pairs.select(F.col("s2").alias("src"), F.col("s1").alias("dst"), "w"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def vocabulary(post: DataFrame, column: str = "term") -> DataFrame:
    return post.select(column).distinct()


def skill_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("skill").agg(F.count_distinct("doc_id").alias("profiles"))


def graph_stats(pairs: DataFrame, post: DataFrame) -> DataFrame:
    """Nodes, edges and total edge weight of the co-occurrence graph."""
    return post.agg(F.count_distinct("skill").alias("nodes")).crossJoin(pairs.agg(F.count("*").alias("edges"), F.coalesce(F.sum("w"), F.lit(0)).alias("weight")))


def plain_relations(profiles: DataFrame, key: str, core: str, others: list[str], times: int = 3) -> dict[str, DataFrame]:
    """Relations of a small index that needs no skill cells: plain tokens, those of the core column `times` over."""
    tokens = lambda c: T.simple_tokens(F.col(c))
    each = profiles.select(F.col(key).alias("doc_id"), F.concat(*[F.transform(tokens(core), lambda t: F.struct(t.alias("term"), F.lit(times).alias("n")))], *[F.transform(tokens(c), lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"))) for c in others]).alias("_t"))
    post = each.select("doc_id", F.inline("_t")).groupBy("doc_id", "term").agg(F.sum("n").alias("tf"))
    stats = doc_stats(post)
    corpus = corpus_stats(profiles, stats)
    return {"postings": post, "doc_stats": stats, "corpus_stats": corpus, "term_stats": term_stats(post, corpus)}
