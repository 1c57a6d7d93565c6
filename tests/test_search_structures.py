"""Gram index, impact blocks and threshold fusion against plain versions, and the shape of their plans."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import vocab
from rankweave.operators import dictionary, fusion, graph, index, lexical, merkle, names, pruned, ranks, rerank, threshold, understand
from rankweave.plans import graph_queries, index_queries, search
from rankweave.plans.folders import settled

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fold", [True, False])
@pytest.mark.parametrize("hinted", [True, False])
def test_names_that_hold_terms(spark, fold, hinted, monkeypatch):
    if not hinted:
        monkeypatch.setattr(names, "small", lambda side: side)
    rng = random.Random(5)
    letters = "abAB é\U0001f600"
    text = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    held = [text(9) for _ in range(300)] + [None, "", "ab", "the same", "the same"]
    asked = [(i, text(4)) for i in range(60)] + [(90, None), (91, ""), (92, "the"), (93, "zzz"), (94, "the"), (95, "xab")]
    low = (lambda s: s.lower()) if fold else (lambda s: s)
    want = {(q, t, n) for q, t in asked if t is not None for n in held if n is not None and low(t) in low(n)}
    found = names.held_terms(spark.createDataFrame([(n,) for n in held], "node string"), "node", spark.createDataFrame(asked, "qid int, term string"), fold=fold)
    assert {(r["qid"], r["term"], r["node"]) for r in found.collect()} == want and found.count() == len(want)


def nodes_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["graph_hop1_direct", "graph_hop1_role", "graph_hop2_domain", "graph_hop2_related", "graph_hop3", "graph_hop4", "graph_score", "skill_search"])
def test_no_nested_loops(spark, name):
    plan = nodes_of(graph_queries.QUERIES[name][0](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hits_are_dealt_by_candidate(spark, monkeypatch):
    """Tasks of the hits grow with the candidates' skills, and no join moves all rows of a query to one task."""
    monkeypatch.setattr(graph, "EACH", 10)
    held = spark.createDataFrame([(i, s) for i in range(40) for s in ("blue anvil", "red bolt")], "cid long, skill string")
    suits = spark.createDataFrame([(i, "building") for i in range(40)], "cid long, role string")
    edges = spark.createDataFrame([("r", "RELATED_TO", "blue anvil", "red bolt")], "edge_id string, type string, src string, dst string")
    terms = spark.createDataFrame([(1, "bolt", "skill"), (1, "build", "role")], "qid int, term string, kind string")
    found = graph.hits(held, suits, edges, terms, settled)
    assert "hashpartitioning(cid#" in nodes_of(found) and nodes_of(found).count(", 9), REPARTITION_BY_NUM") == 2
    assert Counter((r["via"], r["node"], r["delta"]) for r in found.collect()) == {("HAS_SKILL", "red bolt", 3.0): 40, ("RELATED_TO", "blue anvil", 0.75): 40, ("SUITABLE_FOR", "building", 2.0): 40}
    people = spark.createDataFrame([(i, 3.0, ["building"]) for i in range(40)], "cid long, years double, roles array<string>")
    asked = spark.createDataFrame([(1, 3.0, None, [])], "qid int, wanted double, band string, negated array<string>")
    assert not re.search(r"hashpartitioning\(qid#\d+, \d+\)", nodes_of(graph.candidates(found, held, people, asked)))


def test_totals_are_those_of_the_hits(spark):
    """Domains that several skills share, repeated rows, terms of two kinds and roles count as often as their different hits."""
    rng = random.Random(11)
    skills = [f"{a} {b}" for a in ("red", "blue", "green") for b in ("bolt", "anvil", "gear")]
    rows = [(i, rng.choice(skills)) for i in range(30) for _ in range(rng.randint(0, 6))]
    held = spark.createDataFrame(rows + rows[:9], "cid long, skill string")
    suits = spark.createDataFrame([(i, rng.choice(["building", "red tools"])) for i in range(34)] * 2, "cid long, role string")
    near = [(f"r{i}", "RELATED_TO", *rng.sample(skills, 2)) for i in range(14)]
    belongs = [(f"b{i}{d}", "BELONGS_TO", s, d) for i, s in enumerate(skills) for d in ("red metal", "bolt works", skills[0]) if rng.random() < 0.7]
    edges = spark.createDataFrame(near + belongs, "edge_id string, type string, src string, dst string")
    terms = spark.createDataFrame([(1, "red", "skill"), (1, "bolt", "domain"), (1, "build", "role"), (2, "anvil", "skill"), (2, "metal", "domain"), (2, "red", "role")], "qid int, term string, kind string")
    at, met = graph.gains(held, suits, edges, terms, settled)
    found = graph.hits(held, suits, edges, terms, settled)
    score = graph.scored(found)
    want = {(r["qid"], r["cid"]): r["graph_score"] for r in score.collect()}
    got = graph.totals(held, suits, at, met).collect()
    assert {(r["qid"], r["cid"]): r["graph_score"] for r in got} == want and len(got) == len(want) > 40
    few = spark.createDataFrame([k for k in want if k[1] % 5 == k[0]], "qid int, cid long")
    as_rows = lambda df: Counter(map(str, df.select("qid", "term", "cid", "node", "via", "hops", "delta").collect()))
    assert as_rows(graph.hits_of(few, held, suits, at, met)) == as_rows(found.join(few, ["qid", "cid"], "left_semi")) and few.count() > 3


def test_search_makes_hits_for_shown_rows_only(spark, monkeypatch):
    seen, scored = [], graph.scored
    monkeypatch.setattr(graph, "scored", lambda found: seen.append(found.select("qid", "cid").distinct().count()) or scored(found))
    out = search.search(spark, SF).collect()
    assert len(seen) == 1 and 0 < seen[0] <= len(out)
    assert any("Matched '" in r["bullets"] for r in out)


def test_gates_gather_no_query(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(1, i, i / 50, 0.0, i / 50) for i in range(50)], "qid int, doc_id long, bm25 double, dense double, fused double")
        out = fusion.floored(fusion.gated(rows), 5)
        assert "SortMergeJoin" not in nodes_of(out) and [r["doc_id"] for r in out.orderBy("rank").collect()] == [49, 48, 47, 46, 45]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_marks_below_a_place(spark):
    rng = random.Random(3)
    rows = [(sorted((rng.randint(0, 9) / 3, rng.randint(0, 9)) for _ in range(n)), (rng.randint(0, 9) / 3, rng.randint(0, 9))) for n in (0, 1, 2, 3, 63, 64, 65, 127, 128, 400, 1024) for _ in range(12)]
    df = spark.createDataFrame(rows, "m array<struct<s:double,t:int>>, p struct<s:double,t:int>")
    assert [r["n"] for r in df.select(ranks.below(F.col("m"), F.col("p")).alias("n")).collect()] == [sum(x < p for x in m) for m, p in rows]


def test_texts_are_dealt_by_their_bytes(spark):
    docs = spark.createDataFrame([(i, "some words of a text") for i in range(100)], "doc_id long, text string")
    found = index.build_texts(docs, "doc_id", "text", settled, piece=100)
    assert found["postings"].rdd.getNumPartitions() == 21
    assert found["corpus_stats"].first() == (100, 5.0) and found["postings"].count() == 500
    assert index.build_texts(docs.limit(0), "doc_id", "text", settled)["corpus_stats"].first() == (0, 1.0)


def test_scores_do_not_move_from_their_texts(spark):
    found = index_queries._corpus(spark, SF)
    terms = index_queries._benchmark_terms(spark, SF)
    moved = lambda df: [line for line in nodes_of(df).splitlines() if "Exchange hashpartitioning" in line and "doc_id#" in line]
    assert not moved(found["doc_stats"])
    assert not moved(lexical.bm25(found, terms, ["item_id"]))
    assert not moved(lexical.matched_terms(found["postings"], terms, ["item_id"]))
    assert not moved(index_queries._ranked(lexical.bm25(found, terms, ["item_id"]), ["item_id"]))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    again = index.build_texts(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text", settled)
    assert moved(lexical.bm25(again, terms, ["item_id"]))
    rows = lambda at: {(r["item_id"], r["doc_id"], round(r["score"], 6)) for r in lexical.bm25(at, terms, ["item_id"]).collect()}
    assert rows(found) == rows(again)


def test_queries_are_dealt_by_their_number(spark):
    asked = spark.createDataFrame([(i, f"senior java engineer not python, {i} years") for i in range(90)], "qid long, text string")
    known = [understand.vocabulary(spark, ["java", "python"]), understand.vocabulary(spark, ["engineer"])]
    parsed = settled(understand.parse(asked, *known, each=10))
    assert parsed.rdd.getNumPartitions() == 10
    assert {(*r["skills"], *r["negated"], r["role"]) for r in parsed.collect()} == {("java", "python", "engineer")} and parsed.count() == 90
    assert understand.parse(asked.limit(0), *known).count() == 0


def test_variants_are_made_once(spark):
    asked = spark.createDataFrame([(1, "no java people"), (2, "go people"), (3, "abc"), (4, "x not python no docker y")], "qid int, text string")
    parsed = settled(understand.parse(asked, understand.vocabulary(spark, ["java", "go", "python", "docker"]), understand.vocabulary(spark, [])))
    assert {r["qid"]: r["negated"] for r in parsed.collect()} == {1: ["java"], 2: [], 3: [], 4: ["docker", "python"]}
    out = understand.without_negated(understand.expand(parsed), parsed)
    assert nodes_of(out).count("Generate") == nodes_of(understand.expand(parsed)).count("Generate") > 0
    negated = {1: ["java"], 2: [], 3: [], 4: ["docker", "python"]}
    want = {tuple(r) for r in understand.expand(parsed).collect() if not any(n in r["query"] for n in negated[r["qid"]])}
    assert {tuple(r) for r in out.collect()} == want and (2, 1, "go people", "original") in want and (1, 1, "no java people", "original") not in want
    none = understand.without_negated(understand.expand(parsed).limit(0), parsed)
    assert {tuple(r) for r in none.collect()} == {(r["qid"], 1, r["text"], "original") for r in asked.collect()} and none.columns == out.columns


def test_whole_ranking_is_numbered_in_ranges(spark):
    pool = spark.createDataFrame([(1, i, (i * 7 % 50) / 50, 0.0, ["a"], [], "both") for i in range(300)], "qid int, id long, hybrid_score double, kg_score double, core_skills array<string>, matched_terms array<string>, source string")
    asked = spark.createDataFrame([(1, "x", 0.5, [], [])], "qid int, intent string, confidence double, modifiers array<string>, negated array<string>")
    out = rerank.reranked(pool, asked, keep=settled)
    assert "_b#" in nodes_of(out)
    got = {r["id"]: r["rank"] for r in out.collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(300), key=lambda i: (-(i * 7 % 50), i)), 1)}
    assert {r["id"]: r["rank"] for r in rerank.reranked(pool, asked, limit=20).collect()} == {i: n for i, n in got.items() if n <= 20}


def test_blocks(spark):
    rng = random.Random(2)
    rows = [(i, t, rng.random()) for t in "abc" for i in rng.sample(range(500), {"a": 500, "b": 70, "c": 1}[t])]
    blocks = pruned.range_blocks(spark.createDataFrame(rows, "doc_id long, term string, u double").repartition(3), 8, settled).collect()
    assert sorted((r["doc_id"], b["term"], r["u"]) for b in blocks for r in b["rows"]) == sorted(rows)
    assert all(len(b["rows"]) == b["n"] <= 8 and b["most"] == max(r["u"] for r in b["rows"]) for b in blocks)
    assert len({(b["range"], b["term"]) for b in blocks}) == len(blocks)


def made_corpus(spark, n: int = 400):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(80)]
    text = lambda most: " ".join(words[min(int(rng.expovariate(0.08)), 79)] for _ in range(rng.randint(1, most)))
    docs = spark.createDataFrame([(i, text(60)) for i in range(n)] + [(n + i, "w50 w51 w52") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, text(9)) for i in range(25)] + [(40, "w50 w51"), (41, "nothing"), (42, "w0"), (43, "w60 w60 w0")], "qid int, text string")
    return index.build_texts(docs, "doc_id", "text", settled), lexical.query_terms(queries, F.split("text", " "), ["qid"])


@pytest.mark.parametrize("k,size", [(1, 16), (5, 4), (30, 1), (1000, 16)])
def test_pruned_scores(spark, k, size):
    found, terms = made_corpus(spark)
    impacts = pruned.with_impact(found["postings"], found["corpus_stats"]).select("doc_id", "term", "u")
    some = pruned.top_k(settled(pruned.range_blocks(impacts, size, settled)), terms, ["qid"], k, found["corpus_stats"].first()["n"], settled)
    ranked = lambda df: {(r["qid"], r["rank"], r["doc_id"], r["score"]) for r in lexical.top_k(df.withColumn("score", F.round("score", 6)), ["qid"], k).collect()}
    assert ranked(some) == ranked(lexical.bm25(found, terms, ["qid"]))


def test_blocks_are_dealt_by_range(spark):
    rows = spark.createDataFrame([(i, t, 1.0 + i) for i in range(400) for t in "abc"], "doc_id long, term string, u double")
    blocks = settled(pruned.range_blocks(rows.repartition(6), 4, settled, each=100))
    assert blocks.rdd.getNumPartitions() == 13
    places = blocks.withColumn("at", F.spark_partition_id()).groupBy("range").agg(F.count_distinct("at").alias("n"))
    assert places.where("n > 1").count() == 0
    assert pruned.range_blocks(rows.limit(0), 4, settled).count() == 0


@pytest.mark.parametrize("most", [0, 3, 1 << 18])
def test_opened_ranges_move_few_blocks(spark, most, monkeypatch):
    monkeypatch.setattr(ranks, "MOST_ROWS", most)
    monkeypatch.setattr(pruned, "MOST_ROWS", most)
    monkeypatch.setattr(pruned, "small", lambda side: ranks.small(side, most))
    found, terms = made_corpus(spark)
    blocks = settled(pruned.range_blocks(pruned.with_impact(found["postings"], found["corpus_stats"]).select("doc_id", "term", "u"), 4, settled))
    asked = settled(pruned.wanted(blocks, terms, ["qid"], found["corpus_stats"].first()["n"]))
    part = pruned.opened(blocks, asked, pruned.range_bounds(blocks, asked, ["qid"]).where("range % 3 = 0").select("qid", "range"), ["qid"])
    want = blocks.where("range % 3 = 0").select("term", F.inline("rows")).join(asked, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("u")), 6).alias("score"), F.count("*").alias("scored"))
    as_rows = lambda df: {tuple(r) for r in df.collect()}
    assert as_rows(part.withColumn("score", F.round("score", 6))) == as_rows(want) and want.count() > 100


def test_few_postings_are_scored(spark):
    sf = "/root/testdata/sf0.01"
    every = index_queries._corpus(spark, sf)["postings"].join(index_queries._benchmark_terms(spark, sf), "term").count()
    assert index_queries._pruned(spark, sf, 2).agg(F.sum("scored")).first()[0] < 0.3 * every


@pytest.mark.parametrize("most_seen", [200_000, 0])
@pytest.mark.parametrize("k", [3, 20])
def test_fused_top(spark, k, most_seen, monkeypatch):
    monkeypatch.setattr(threshold, "MOST_SEEN", most_seen)
    rng = np.random.default_rng(3)
    n, queries = 600, 4
    vec, asked = rng.normal(size=(n, 8)), rng.normal(size=(queries, 8))
    vec, asked = vec / np.linalg.norm(vec, axis=1, keepdims=True), asked / np.linalg.norm(asked, axis=1, keepdims=True)
    vec[50:70] = vec[50]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "doc_id long, vec array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid int, qvec array<double>")
    bm25 = [{i: round(float(rng.integers(1, 30)) / 30, 6) for i in rng.choice(n, size, replace=False)} for size in (0, 5, 150, 600)]
    hits = settled(spark.createDataFrame([(j, int(i), s) for j, own in enumerate(bm25) for i, s in own.items()], "qid int, doc_id long, bm25 double"))

    def adjusted(df):
        fused = F.round(fusion.boosted(F.col("rrf"), F.col("doc_id") % 7 != 0, (F.col("doc_id") % 3 == 0).cast("int")), 9)
        return df.withColumn("fused", F.when(fusion.gate_passed(F.col("bm25"), F.col("dense"), F.col("_best")), fused).otherwise(0.0))

    found = threshold.fused_top(q, rows, hits, k, adjusted, 1.3, store=settled)
    got = {(r["qid"], r["rank"], r["doc_id"], r["rank_bm25"], r["rank_dense"], r["fused"]) for r in lexical.top_k(found, ["qid"], k, "fused").collect()}
    want = set()
    for j in range(queries):
        dense = np.round(np.clip(vec @ asked[j], 0, 1), 6)
        place = lambda s: {i: p for p, i in enumerate(sorted(range(n), key=lambda i: (-s(i), i)), 1)}
        by_words, by_vector = place(lambda i: bm25[j].get(i, 0.0)), place(lambda i: dense[i])
        scored = []
        for i, s in bm25[j].items():
            rrf = vocab.ALPHA_BM25 / (vocab.RRF_K + by_words[i]) + vocab.ALPHA_DENSE / (vocab.RRF_K + by_vector[i])
            passed = s >= vocab.BM25_FLOOR or dense[i] >= (dense.max() * vocab.DENSE_GATE if dense.max() > 0 else vocab.DENSE_GATE_EMPTY)
            fused = round(rrf * (i % 7 != 0) * (1 + 0.3 * (i % 3 == 0)), 9) if passed else 0
            if fused > 0:
                scored.append((-fused, int(i)))
        want |= {(j, p, i, by_words[i], by_vector[i], -f) for p, (f, i) in enumerate(sorted(scored)[:k], 1)}
    assert got == want


def test_sides_are_counted(spark):
    assert "Broadcast" in nodes_of(spark.range(5).join(ranks.small(spark.range(3)), "id"))


def test_dictionary_against_all_pairs(spark):
    rng = random.Random(8)
    made = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(3, 9)))
    texts = [" ".join(made() for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "ABCD abcd"]
    held = spark.createDataFrame([(t,) for t in texts], "t string")
    known = {r["word"]: r["n"] for r in dictionary.counted(held, "t", 2).collect()}
    want = Counter(w for t in texts for w in {x for x in re.split("[^a-z]+", (t or "").lower()) if len(x) >= 3})
    assert known == {w: n for w, n in want.items() if n >= 2}
    tokens = sorted({made() for _ in range(300)} | {"abc", "Abcd", "ab-cd"})

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row: list, i: int, x: str, b: str) -> list:
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    expected = set()
    for t in tokens:
        if len(t) >= 4 and re.fullmatch("[a-z]+", t) and t not in known:
            near = [(d, -n, w) for w, n in known.items() if (d := distance(t, w)) <= (1 if len(t) < 6 else 2)]
            if near:
                d, n, w = min(near)
                expected.add((t, w, d, -n))
    found = dictionary.corrections(spark.createDataFrame([(t,) for t in tokens], "token string"), dictionary.counted(held, "t", 2))
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 50


def test_merkle_reads_what_differs(spark, tmp_path):
    rows = spark.range(3000).select("id", (F.col("id") * 7 % 100).alias("v"))
    moved = rows.where("id <> 5").withColumn("v", F.when(F.col("id") == 17, 1000).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(9000, 1)], "id long, v long"))
    paths = {name: str(tmp_path / name) for name in ("old", "new", "same")}
    for name, df in (("old", rows), ("new", moved), ("same", rows.repartition(7))):
        merkle.write_tree(df, "id", ["v"], paths[name], buckets=60)
    assert {tuple(r) for r in merkle.changes(spark, paths["old"], paths["new"]).collect()} == {(5, "deleted"), (17, "changed"), (9000, "new")}
    found = merkle.differing(spark, paths["old"], paths["new"])
    assert 1 <= len(found) <= 3 and merkle.differing(spark, paths["old"], paths["same"]) == []
    plan = nodes_of(merkle.read_buckets(spark, paths["old"], found, "long"))
    assert "PartitionFilters: [bucket#" in plan and "Filter" not in plan.split("FileScan")[0]
    root = merkle.tree(spark, paths["old"]).orderBy(F.desc("level")).first()
    assert root["n"] == 3000 and root["node"] == 0
    merkle.write_tree(rows.limit(0), "id", ["v"], str(tmp_path / "none"), buckets=60)
    assert merkle.changes(spark, str(tmp_path / "none"), paths["old"]).where("change = 'new'").count() == 3000
