"""Operators with injected functions, properties of scores, and cases that SQL does not show."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.functions import vocab
from rankweave.operators import dense, explain, fuzzy, graph, index, lexical, metrics, ranks, rerank, understand
from rankweave.plans.folders import dealt, settled


def test_encode_with_prefix(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, t string")
    encoder = lambda texts: np.array([[len(t), 1.0] for t in texts])
    got = {r["id"]: r["vec"] for r in dense.encode(rows, "t", encoder, prefix="q: ").collect()}
    assert np.allclose(got[1], np.array([5, 1]) / np.sqrt(26)) and np.allclose(got[2], got[3])


def test_unit_of_zero(spark):
    row = spark.range(1).select(dense.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("u")).first()
    assert row["u"] == [0.0, 0.0]


def test_latent_vectors(spark):
    docs = spark.createDataFrame([(1, "red bolt steel"), (2, "red bolt iron"), (3, "blue sea wave"), (4, "blue sea foam")], "id long, t string")
    got = {r["doc_id"]: np.array(r["vec"]) for r in dense.latent_vectors(docs, "id", F.split("t", " "), k=2).collect()}
    assert got[1] @ got[2] > 0.9 and abs(got[1] @ got[3]) < 0.2


def test_compound_tokens_meet_queries(spark):
    row = spark.range(1).select(T.bm25_tokens(F.lit("machine_learning ML")).alias("a"), T.bm25_tokens(F.lit("machine_learning"), True).alias("b")).first()
    assert row["a"] == ["machine_learning", "machine", "learning"] and row["b"] == ["machine_learning", "machine", "learning"]


def test_levels_round_trip(spark):
    for name, weight in (("Expert", 2.0), ("Basic", 0.5), ("odd", 1.0)):
        row = spark.range(1).select(T.level_weight(F.lit(name)).alias("w"), T.weight_level(T.level_weight(F.lit(name))).alias("l")).first()
        assert row["w"] == weight and vocab.PROFICIENCY.get(row["l"].lower(), 1.0) == weight


def test_narration_falls_back(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")

    def service(row):
        if row["id"] == 2:
            raise RuntimeError("no answer")
        return "told " + row["t"]

    assert {r["explanation"] for r in explain.narrate(rows, service, F.lit("plain")).collect()} == {"told a", "plain"}
    assert {r["explanation"] for r in explain.narrate(rows, None, F.lit("plain")).collect()} == {"plain"}


def test_service_answers(spark):
    rows = spark.createDataFrame([(1, "x")], "id int, p string")
    asked = understand.call_service(rows, "p", lambda t: '```json\n{"skills": ["a"], "n": 2}\n```')
    row = asked.select(understand.answers(F.col("answer"), "skills array<string>, n int").alias("a")).first()
    assert row["a"]["skills"] == ["a"] and row["a"]["n"] == 2
    assert understand.call_service(rows, "p", None).first()["answer"] is None


def test_walks_use_an_edge_once(spark):
    edges = spark.createDataFrame([("1", "RELATED_TO", "a", "b"), ("2", "RELATED_TO", "b", "a")], "edge_id string, type string, src string, dst string")
    assert {tuple(r) for r in graph.walks(edges, 2).collect()} == {("a", "a"), ("b", "b")}
    assert graph.walks(edges, 3).count() == 0


def test_graph_upkeep(spark):
    edges = spark.createDataFrame([("1", "HAS_SKILL", "c1", "s"), ("2", "HAS_SKILL", "c2", "s"), ("3", "RELATED_TO", "c1", "t")], "edge_id string, type string, src string, dst string")
    left = graph.without_candidates(edges, spark.createDataFrame([("c1",)], "cid string"))
    assert {r["edge_id"] for r in left.collect()} == {"2", "3"}
    new = edges.where("edge_id = '1'").withColumn("dst", F.lit("u"))
    assert {(r["edge_id"], r["dst"]) for r in graph.upsert(edges, new, ["edge_id"]).collect()} == {("1", "u"), ("2", "s"), ("3", "t")}


def test_alpha_and_beta(spark):
    rows = spark.createDataFrame([(i, c) for i in [*vocab.INTENT_ALPHA, "x"] for c in (0.0, 0.4, 1.0)], "i string, c double")
    for r in rows.select("i", "c", rerank.alpha(F.col("i"), F.col("c")).alias("a")).collect():
        assert abs(r["a"] - (0.5 + (vocab.INTENT_ALPHA.get(r["i"], 0.5) - 0.5) * r["c"])) < 1e-6


def test_empty_query_batch(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    built = index.build(docs, "doc_id", F.split("text", " "))
    none = lexical.query_terms(spark.createDataFrame([], "qid int, text string"), F.split("text", " "), ["qid"])
    assert lexical.bm25(built, none, ["qid"]).count() == 0
    empty = index.build(docs.limit(0), "doc_id", F.split("text", " "))
    assert empty["corpus_stats"].first().asDict() == {"n": 0, "avgdl": 1.0}


def test_repeated_query_terms_count_again(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    built = index.build(docs, "doc_id", F.split("text", " "))
    score = lambda q: lexical.bm25(built, lexical.query_terms(spark.createDataFrame([(1, q)], "qid int, text string"), F.split("text", " "), ["qid"]), ["qid"]).where("doc_id = 1").first()["score"]
    assert abs(score("a a") - 2 * score("a")) < 1e-12


def test_metrics(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "qid int, doc_id int, rank int")
    relevant = spark.createDataFrame([(1, 10), (1, 12), (3, 5)], "qid int, doc_id int")
    found = {r["qid"]: r for r in metrics.retrieval_metrics(results, relevant, 2).collect()}
    assert found[1]["p_at_k"] == 0.5 and found[1]["r_at_k"] == 0.5 and found[1]["rr"] == 1.0 and found[1]["ap"] == 0.5
    assert found[3]["ndcg"] == 0.0 and set(found) == {1, 3}
    assert metrics.mean_metrics(metrics.retrieval_metrics(results, relevant, 2)).first()["queries"] == 2
    assert metrics.accuracy(results, "qid", "rank").first()["accuracy"] == 0.25


def test_indel_ratio(spark):
    rows = spark.createDataFrame([("kitten", "sitting", 200 * 4 / 13), ("", "", 100.0), ("ab", "cd", 0.0), ("", "x", 0.0)], "a string, b string, want double")
    for r in rows.select("want", fuzzy.indel_ratio(F.col("a"), F.col("b")).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 1e-9


def test_canonical_match_against_all_pairs(spark):
    """Repetitive names, names that differ by several characters, and names of all short lengths."""
    rng, alphabet = np.random.default_rng(8), "ab c"
    canon = {"a" * 50, "abc" * 12, "x", "xy", "cloud infrastructure engineering", *("".join(rng.choice(list(alphabet), rng.integers(2, 24))).strip() or "z" for _ in range(40))}
    names = {"a" * 49, "a" * 41, "abc" * 12 + "b", "cab" + "abc" * 11, "XY", "cloud infra structure enginering"}
    for c in canon:
        for _ in range(2):
            x = list(c)
            for _ in range(rng.integers(1, 4)):
                if rng.random() < 0.5 and len(x) > 1:
                    del x[rng.integers(len(x))]
                else:
                    x.insert(rng.integers(len(x) + 1), str(rng.choice(list("abcz"))))
            names.add("".join(x).strip() or "q")

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y):
                up = row[j + 1]
                row[j + 1] = last + 1 if c == d else max(up, row[j])
                last = up
        return row[-1]

    want = {}
    for n in names:
        key = n.lower()
        if key in canon:
            want[n] = (key, False)
            continue
        near = [(-200 * common(key, c) / (len(key) + len(c)), c) for c in canon if 200 * common(key, c) / (len(key) + len(c)) >= 90 - 1e-9]
        want[n] = (min(near)[1], False) if near else (n, True)
    got = fuzzy.canonical_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(c, c) for c in canon], "key string, name string"))
    assert {r["name"]: (r["canonical"], r["is_new"]) for r in got.collect()} == want


def test_numbers_over_a_whole_group(spark):
    """As a window numbers them, with many ties, several groups, and sides too large to broadcast."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", F.when(F.col("id") % 5 > 0, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(40)).cast("double")).alias("s")).repartition(5).cache()
    want = lexical.top_k(rows.withColumnRenamed("id", "doc_id"), ["g"], 10_000, "s").select("g", "doc_id", "rank")
    for most in (ranks.MOST_ROWS, 1):
        got = ranks.numbered(rows, ["g"], "s", "id", "n", cuts=8, most=most)
        assert sorted(map(tuple, got.select("g", "id", "n").collect())) == sorted(map(tuple, want.collect()))
    assert ranks.numbered(rows.where("false"), ["g"], "s", "id", "n").count() == 0


def test_passages_in_texts(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five six yy"), (2, "one two three four five"), (3, None), (4, "a shortone"), (5, "one two three four fiveX six")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "ne two three four five six"), (2, "short"), (3, "one two three four five si"), (4, "one two  three four five six")], "qid int, p string")
    assert {tuple(r) for r in lexical.containing(docs, asked).collect()} == {(1, 1), (2, 4), (3, 1)}


def test_walks_run_backwards_as_forwards(spark):
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(str(i), "RELATED_TO", f"n{a}", f"n{b}") for i, (a, b) in enumerate(rng.integers(0, 7, (24, 2)))], "edge_id string, type string, src string, dst string")
    terms = spark.createDataFrame([(1, "n1", "skill"), (2, "n", "skill")], "qid int, term string, kind string")
    listed = [(r["edge_id"], r["src"], r["dst"]) for r in edges.collect()]
    paths = [[e] for e in listed]
    for depth, found in enumerate(graph.sources(edges, terms, 3), 1):
        pairs = {(p[0][1], p[-1][2]) for p in paths}
        assert {tuple(r) for r in graph.walks(edges, depth).collect()} == pairs
        assert {tuple(r) for r in found.collect()} == {(q, t, s) for q, t in ((1, "n1"), (2, "n")) for s, n in pairs if t in n}
        paths = [[*p, e] for p in paths for e in listed if e[1] == p[-1][2] and e not in p]


def test_no_encoder_is_an_error(spark):
    with pytest.raises(ValueError, match="encoder"):
        dense.encode(spark.range(1), "id", None)


def test_query_blocks(spark):
    """A query batch over the bound is scored in blocks, with the same result."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "doc_id long, vec array<double>")
    queries = rows.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"), F.lit(2.0).alias("w"))
    one, many = (sorted((r["qid"], r["doc_id"], round(r["score"], 9)) for r in dense.scores(queries.drop("w"), rows, most=m).collect()) for m in (1 << 20, 500))
    assert one == many and len(one) == 2500
    mean = dense.weighted_query(queries.withColumn("qid", F.col("qid") % 5), ["qid"])
    parts = dense.scores(queries.withColumn("qid", F.col("qid") % 5), rows)
    a = {(r["qid"], r["doc_id"]): r["score"] for r in dense.weighted_mean(parts, ["qid"]).collect()}
    b = {(r["qid"], r["doc_id"]): r["s"] for r in dense.scores(mean, rows).withColumn("s", dense.clipped(F.col("score"))).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_products_are_held_in_parts():
    """Memory of a batch doesn't grow with the queries; scores are those of the whole product."""
    rng = np.random.default_rng(8)
    rows, asked = rng.normal(size=(3000, 4)), rng.normal(size=(4000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(rows.tolist())], ["doc_id", "vec"])
    own, n, whole = pa.table({"qid": np.arange(4000)}), 0, np.clip(asked @ rows.T, 0, 1)
    tracemalloc.start()
    for part in dense.products(iter([batch]), own, asked, None, None, True):
        q, d = part.column(0).to_numpy(), part.column(1).to_numpy()
        assert np.allclose(part.column(2).to_numpy(), whole[q, d], atol=1e-12)
        n += part.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 12_000_000 and most < 16 << 20  # 96 MB as a whole
    top = list(dense.products(iter([batch]), own, asked, 2, 6, False))
    assert sum(p.num_rows for p in top) == 8000
    assert {tuple(r.values()) for p in top[:1] for r in p.slice(0, 2).to_pylist()} == {(0, int(d), float(np.round(x, 6))) for d, x in sorted(enumerate(rows @ asked[0]), key=lambda r: -r[1])[:2]}


def test_scores_dealt_and_rounded(spark):
    """Halves are rounded away from zero and NaN counts as the largest, as in SQL; pairs are the same when dealt to tasks."""
    rows = spark.createDataFrame([(1, [0.0000125]), (2, [float("nan")]), (3, [-0.5]), (4, [7.0]), (5, [0.25])], "doc_id long, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0]), (2, [-1.0])], "qid long, qvec array<double>")
    plain, dealt_ = (dense.scores(queries, rows, places=6, clip=True, each=n) for n in (None, 2))
    want = {(1, 1): 0.000013, (1, 2): 1.0, (1, 3): 0.0, (1, 4): 1.0, (1, 5): 0.25, (2, 1): 0.0, (2, 2): 1.0, (2, 3): 0.5, (2, 4): 0.0, (2, 5): 0.0}
    for found in (plain, dealt_):
        assert {(r["qid"], r["doc_id"]): r["score"] for r in found.collect()} == want
    assert plain.rdd.getNumPartitions() == 1 and dealt_.rdd.getNumPartitions() == 5
    assert {r["s"] for r in dense.scores(queries, rows).where("not isnan(score)").select(F.round(F.abs("score"), 6).alias("s")).collect()} == {0.000013, 0.5, 7.0, 0.25}


def test_hashed_projection(spark):
    """As worked out term by term, with all, some and no terms broadcast, a document without an id, one of rare terms only and one of a lane at either end."""
    words = spark.range(4000).select(F.concat(F.lit("w"), "id").alias("term"), F.pmod(F.xxhash64(F.concat(F.lit("w"), "id"), F.lit(1)), F.lit(384)).alias("i"))
    ends = {r["i"]: r["term"] for r in words.where("i in (0, 383)").collect()}
    texts = [(i, " ".join(f"t{j}" for j in range(40) if (i * 7 + j * j) % (2 + j % 5) == 0) + f" u{i}") for i in range(30)]
    docs = spark.createDataFrame([*texts, (None, "t1 t2 t2 alone"), (77, "rare rarer"), (78, ends[0]), (79, ends[383]), (80, ""), (81, None)], "doc_id long, text string")
    n, counted = index.text_counts(docs, "doc_id", "text", piece=400)
    post = dealt(counted)
    terms = index.term_stats(post, spark.createDataFrame([(n,)], "n long"))
    drawn = terms.select("term", "idf", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(384)).alias("i"), F.when(F.xxhash64("term", F.lit(2)) % 2 == 0, 1.0).otherwise(-1.0).alias("s"))
    weights = {r["term"]: (r["i"], r["idf"] * r["s"]) for r in drawn.collect()}
    want = {}
    for r in post.collect():
        i, w = weights[r["term"]]
        want.setdefault(r["doc_id"], np.zeros(384))[i] += r["tf"] * w
    for most in (1 << 20, 1500, 0):
        vectors = dense.hashed_projection(post, terms, most=most, store=settled)
        got = {r["doc_id"]: np.array(r["vec"]) for r in vectors.collect()}
        assert got.keys() == want.keys() and len(got) == 34
        assert all(v.shape == (384,) and np.allclose(v, want[k] / np.linalg.norm(want[k]), atol=1e-12) for k, v in got.items())
        plan = vectors._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning" in plan) == (most < 1 << 20)  # postings don't move where all terms are broadcast


def test_vocabulary_file(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.createDataFrame([("Kubernetes", ["k8s", "kube"]), ("Go", ["golang"]), ("kube", ["k8s"])], "term string, aliases array<string>").write.json(path)
    found = understand.load_vocabulary(spark, path)
    assert {tuple(r) for r in found.collect()} == {("kubernetes", "kubernetes"), ("k8s", "kube"), ("kube", "kube"), ("go", "go"), ("golang", "go")}
    many = spark.range(4000).select(F.concat(F.lit("term"), "id").alias("term"), F.concat(F.lit("term"), "id").alias("canonical")).unionByName(found)
    asked = spark.createDataFrame([(1, "needs golang, term17 and K8S")], "qid int, text string")
    assert understand.terms_in(asked, many).first()["found"] == ["go", "kube", "term17"]


def test_aliases(spark):
    matched = spark.createDataFrame([("Go", "Go"), ("golang", "Go"), ("Rust", "Rust")], "name string, canonical string")
    assert {r["canonical"]: r["aliases"] for r in fuzzy.with_aliases(matched).collect()} == {"Go": ["golang"], "Rust": []}


def test_replace_aliases(spark):
    row = spark.range(1).select(understand.replace_aliases(F.lit("k8s and ml, mlops"), {"k8s": "kubernetes", "ml": "machine learning"}).alias("t")).first()
    assert row["t"] == "kubernetes and machine learning, mlops"


def test_without_negated_falls_back(spark):
    variants = spark.createDataFrame([(1, 1, "java people", "original"), (2, 1, "go people", "original")], "qid int, ord int, query string, strategy string")
    parsed = spark.createDataFrame([(1, "no Java people", ["java"]), (2, "go people", ["java"])], "qid int, text string, negated array<string>")
    assert {(r["qid"], r["query"]) for r in understand.without_negated(variants, parsed).collect()} == {(1, "no java people"), (2, "go people")}


def test_dense_top_k_agrees_with_all_scores(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=5).round(1).tolist()) for i in range(60)] + [(60, [1.0])], "doc_id long, vec array<double>")
    queries = rows.where("doc_id % 20 = 0 and doc_id < 60").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in dense.top_k(queries, rows.repartition(5), 7).collect()}
    every = lexical.top_k(dense.scores(queries, rows.where("doc_id < 60")).withColumn("score", F.round("score", 6)), ["qid"], 7)
    assert got == {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in every.collect()}
    assert dense.top_k(queries.limit(0), rows, 3).count() == 0
