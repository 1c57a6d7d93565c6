"""The pipeline's stages one by one and as a whole, on the smallest tables."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import cases

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    named = dict(pipeline.STAGES)

    one = named["language ID"](spark, docs, SF)
    assert one.columns == columns and one.count() == len(start)

    two = named["line dedup"](spark, one, SF)
    assert two.columns == columns
    kept = {(i, t): n for (i, _, _, _, t), n in cases.line_rows([(i, t) for i, t in start.items()]).items()}
    assert {(r["doc_id"], r["text"]): 1 for r in two.collect()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = named["SimHash near-dedup"](spark, two, SF)
    assert three.columns == columns
    classes = {c for _, _, c in cases.simhash_rows([(i, t) for i, t in kept])}
    assert {r["doc_id"] for r in three.collect()} == classes

    four = named["mixing"](spark, three, SF)
    assert four.columns == columns
    left = {r["doc_id"] for r in four.collect()}
    assert left <= classes and len(left) > 0.7 * len(classes)

    five = named["BPE"](spark, four, SF)
    assert {r["doc_id"] for r in five.collect()} == left
    assert {tuple(r) for r in five.collect()} == {tuple(r) for r in pipeline.run(spark, SF).collect()}


def test_edges(spark):
    """What is without letters goes at once; what a copy, a null or a repeated id has is kept by its class."""
    docs = cases.edge_documents(spark).select("doc_id", "text", "lang", "row", "n_chars", "key")
    rows = [(r[0], r[1]) for r in cases.edge_rows()]
    named = dict(pipeline.STAGES)
    one = named["language ID"](spark, docs, SF)
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert {(r["doc_id"], r["text"]) for r in one.collect()} <= set(lettered)
    two = named["line dedup"](spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in two.where("text is not null").collect()) == sorted((i, t) for (i, _, _, _, t), n in cases.line_rows(rows).items() for _ in range(n) if t is not None)
    three = named["SimHash near-dedup"](spark, docs, SF).collect()
    assert len(three) == len({c for _, _, c in cases.simhash_rows(rows)})
    assert set((r["doc_id"], r["text"]) for r in three) <= set(rows)
    four = named["mixing"](spark, docs, SF).collect()
    assert not Counter((r["doc_id"], r["text"]) for r in four) - Counter(rows)
    five = named["BPE"](spark, docs, SF)
    assert Counter(r["doc_id"] for r in five.collect()) == Counter(r[0] for r in rows)


def test_near_dedup_keeps_every_class(spark):
    """Texts that share an id, or have none, are classes of their own; copies and repeated rows are not."""
    texts = [" ".join(f"{w}{n}x{k}" for k in range(40)) for n, w in enumerate(["alpha", "beta", "gamma", "delta", "omega", "sigma"])]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[3]), (7, texts[4]), (8, texts[4]), (None, texts[5]), (9, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = pipeline.near_dedup(spark, docs, SF).collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])]
    assert sorted(map(tuple, left), key=str) == sorted(want, key=str)
