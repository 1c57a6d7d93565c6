"""The training-data operators against brute force, on edge cases and on the smallest tables."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases
from pyspark.sql import functions as F

from rankweave.llm import bpe, components, exact_dedup, fingerprints, langid, licenses, line_dedup, mixing, queries, simhash, suffix_dedup, toxicity
from rankweave.llm.common import ascii_lower, train_split

SF = "/root/testdata/sf0.001"


def counted(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def edges(spark):
    return cases.edge_documents(spark).cache()


@pytest.fixture(scope="module")
def rows():
    return cases.edge_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def doc_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_ascii_lower(edges, rows):
    assert counted(edges, ascii_lower(F.coalesce("text", F.lit("")))) == Counter((cases.lower(r[1]),) for r in rows)


def test_fingerprints(edges, rows):
    found = fingerprints.fingerprint_documents(edges)
    assert counted(found, "doc_id", "n_chars", "edited_sha256") == cases.fingerprint_rows(rows)
    by_text = {}
    for r in found.join(edges.select("doc_id", "text"), "doc_id").where("doc_id not in (15, 33)").collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    full = [t for t in by_text if fingerprints.paragraphs(t)]
    assert len({next(iter(by_text[t])) for t in full}) == len(full)


def test_fingerprints_are_homomorphic():
    of = fingerprints.Fingerprint.of
    a, b = "first paragraph here\nsecond one", "third one is this"
    assert (of(a) + of(b)).text() == of(b + "\n" + a).text()
    assert (of(a + "\n" + b) - of(b)).text() == of("second one\nfirst paragraph here").text()
    assert of(a).text() != of(b).text()


def test_fingerprints_likeness(docs):
    found = fingerprints.fingerprint_documents(docs).toPandas()
    assert found.near_edited.mean() > 0.35 > 0.15 > found.near_next.mean()
    assert (found.near_edited > found.near_next).mean() > 0.95


def test_licenses(edges, rows):
    found = licenses.scan_licenses(edges)
    assert counted(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == cases.license_rows(rows)
    labels = {r["doc_id"]: r for r in found.collect()}
    assert labels[39]["labels"] == "cc-by,cc-by-nc,reserved" and labels[39]["score"] == 1.0
    assert "gpl-3.0" not in labels[39]["labels"] and "gpl" in labels[42]["labels"]
    assert labels[0]["labels"] == "" and labels[0]["score"] == 0.0


def test_licenses_near_template(spark):
    notice = licenses.NOTICES["mit"][1].replace("charge to", "charge or fee to")
    far = "permission is hereby refused to nobody"
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame([(1, "Intro. " + notice), (2, far)], "doc_id long, text string")).collect()}
    assert found[1]["labels"] == "mit" and 0.6 <= found[1]["score"] < 1.0
    assert found[2]["labels"] == ""


@pytest.mark.parametrize("window", [100, 400])
def test_suffix_dedup(edges, rows, window):
    found = suffix_dedup.remove_repeats(edges, window=window)
    assert counted(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cases.suffix_rows(rows, window)


def test_suffix_dedup_small_tables(docs, doc_rows):
    found = queries.op4_suffix_dedup(docs.sparkSession, SF)
    assert counted(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cases.suffix_rows(doc_rows, 400)


@pytest.mark.parametrize("most_bits", [6, 12])
def test_suffix_dedup_beyond_filters(docs, doc_rows, monkeypatch, most_bits):
    """With more keys than a filter holds, rows are equal and no pass writes more than with filters that hold all."""
    written: list[int] = []

    def counted_durable(df):
        kept = suffix_dedup_durable(df)
        if kept.columns == suffix_dedup.COLUMNS:
            written.append(kept.count())
        return kept

    suffix_dedup_durable = suffix_dedup.durable
    monkeypatch.setattr(suffix_dedup, "durable", counted_durable)
    found = suffix_dedup.remove_repeats(docs, most_bits=most_bits)
    assert counted(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cases.suffix_rows(doc_rows, 400)
    few, written = written[:], []
    suffix_dedup.repeated_spans(docs)
    assert len(few) == len(written) == 3
    assert all(0 < a <= b for a, b in zip(few, written)), (few, written)


def test_suffix_dedup_full_filter(edges, rows):
    found = suffix_dedup.remove_repeats(edges, window=100)
    full = suffix_dedup.remove_repeats(edges, window=100, most_bits=6)
    assert counted(full, *found.columns) == counted(found, *found.columns) == cases.suffix_rows(rows, 100)


def test_line_dedup(edges, rows):
    found = line_dedup.dedupe_lines(edges)
    assert found.columns[: len(edges.columns)] == edges.columns
    assert counted(found, "doc_id", "n_lines", "n_dropped", "n_near", "text") == cases.line_rows(rows)


def test_line_dedup_small_tables(docs, doc_rows):
    found = line_dedup.dedupe_lines(docs)
    assert counted(found, "doc_id", "n_lines", "n_dropped", "n_near", "text") == cases.line_rows(doc_rows)


def test_line_dedup_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(3 * line_dedup.RUN + 5))
    texts = [(1, long), (2, long.replace("w700 ", "")), (3, long.replace("w1000 ", "other ")), (4, long[5:] + " tail")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert counted(line_dedup.dedupe_lines(docs), "doc_id", "n_lines", "n_dropped", "n_near", "text") == cases.line_rows(texts)


def test_simhash(edges, rows):
    assert counted(simhash.near_duplicates(edges), "doc_id", "fingerprint", "component_id") == cases.simhash_rows(rows)


def test_simhash_small_tables(docs, doc_rows):
    assert counted(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == cases.simhash_rows(doc_rows)


def test_simhash_links_every_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            x = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = sorted(int(np.uint64(x).view(np.int64)) for x in fps)
    for block in (simhash.BLOCK, 4):
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block)
        got = {r["node"]: r["least"] for r in components.components(found).collect()}
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, x in enumerate(signed):
            for y in signed[:i]:
                if ((x ^ y) & (2**64 - 1)).bit_count() <= 3:
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
        assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 500).selectExpr("id a", "id + 1 b").repartition(7)
    found = {r["node"]: r["least"] for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(1, 501)}


def test_exact_dedup(edges, rows):
    found = exact_dedup.exact_duplicates(edges)
    assert counted(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == cases.exact_rows(rows)
    assert counted(exact_dedup.exact_duplicates(edges, most_bits=3), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == cases.exact_rows(rows)


def test_bpe(edges, rows):
    import hashlib

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.VOCABULARY)
    want = Counter()
    for r in rows:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert counted(bpe.encode_documents(edges, queries.VOCABULARY), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_properties():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    own, theirs = bpe.encoder(queries.VOCABULARY), Tokenizer.from_file(queries.VOCABULARY)

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.text(alphabet="etaonish .,'\n\téß 　²€1<|>", max_size=80)))
    def check(text):
        ids = own.encode(text)
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text

    check()


def test_language(docs):
    model = langid.train(docs, usable=train_split(F.col("doc_id")))
    found = langid.identify(docs, model).where(~train_split(F.col("doc_id"))).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_edges(edges, rows, spark):
    model = langid.train(edges, usable=train_split(F.col("doc_id")))
    carried = edges.select(F.struct("text", "lang", F.lit(1).alias("score"), F.lit(2).alias("lang_pred")).alias("own"))
    found = langid.identified(carried, model, "text").select("own.text", "own.lang", "lang_pred", "score").collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in langid.identify(edges, None).collect()} == {"und"}


def test_toxicity(spark):
    scored = queries.op3_toxicity(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    caught = scored[scored.toxic == 1].predicted.mean()
    false = scored[scored.toxic == 0].predicted.mean()
    assert caught >= 0.6 and false <= 0.05
    assert ((scored.score >= 0.3) == (scored.predicted == 1)).all()


def test_toxicity_fit_is_that_of_a_dense_matrix():
    draw = np.random.default_rng(0)
    held = draw.random((200, 60)) < 0.2
    held[:, 50] = False
    held[7] = False
    scale, use = draw.normal(size=60), (np.arange(200) % 3 > 0).astype(float)
    y = (held[:, :5].sum(1) + 0.3 * draw.normal(size=200) > 1).astype(float)
    w = toxicity.logistic(toxicity.Sparse([np.flatnonzero(r) for r in held], scale), y, use, 1.0, tolerance=1e-9)
    x, v, penalty = np.c_[held * scale, np.ones(200)], np.zeros(61), np.r_[np.ones(60), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve((x.T * (use * p * (1 - p))) @ x + np.diag(penalty), x.T @ (use * (p - y)) + penalty * v)
    assert np.abs(w - v).max() < 1e-5


def test_toxicity_reads_characters():
    """Grams are of characters of one to four bytes, within their own text."""
    texts = ["añb", "", "日本 x", "😀é", "plain"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, offsets = toxicity.characters(data, at)
    assert offsets.tolist() == np.cumsum([0, *map(len, texts)]).tolist()
    assert found.tolist() == [int.from_bytes(c.encode()) for c in "".join(texts)]
    assert toxicity.characters(data[:0], np.zeros(3, np.int64))[1].tolist() == [0, 0, 0]


def test_toxicity_edges(edges, rows, spark):
    labels = edges.select("doc_id", F.coalesce(F.contains("text", F.lit("idiot")), F.lit(False)).cast("int").alias("toxic"))
    found = toxicity.score_documents(edges, toxicity.train(edges, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    none = toxicity.score_documents(edges, toxicity.train(edges, labels.where("toxic = 1"))).collect()
    assert {r["score"] for r in none} == {0.0}


def test_mixing(spark):
    found = queries.op7_mixing(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert (found.rate >= 0).all() and np.allclose(found[["p_clean", "p_low", "p_toxic"]].sum(1), 1, atol=0.02)
    total = found.n_tokens.sum()
    share = {d: (found.n_tokens * found[f"p_{d}"]).sum() / total for d in mixing.DOMAINS}
    got = {d: (found.rate * found.n_tokens * found[f"p_{d}"]).sum() / total for d in mixing.DOMAINS}
    for d in mixing.DOMAINS:
        goal = mixing.TARGETS[d] * share["clean"] / mixing.TARGETS["clean"]
        assert abs(got[d] - goal) < 0.02 * goal
    both = found.merge(labels, on="doc_id")
    clean = both[(both.quality == 1) & (both.toxic == 0)]
    assert (clean.domain == "clean").mean() > 0.9


def refolded(steps, grid, most=np.inf):
    """A document's rate from the steps, with the momentum that each step states."""
    w = v = np.ones(len(grid))
    for s in steps:
        new = np.clip(v * s["keep"] + s["add"] - grid @ np.array(s["pull"]), 0, most)
        w, v = new, new + s["ahead"] * (new - w)
    return w


def test_mixing_solver_against_dense_solution(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([3, 1, 1], 60)
    grid = np.round(p * mixing.GRID).astype(int)
    t = rng.integers(1, 400, 60)
    cells = spark.createDataFrame([(row.tolist(), int(n)) for row, n in zip(grid, t)], "p array<int>, t long")
    steps = mixing.fit_rates(cells, steps=400)
    w, q, a = refolded(steps, grid), grid / mixing.GRID, t / t.sum()
    have = a @ q
    goal = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * have[0] / mixing.TARGETS["clean"]
    loss = lambda w: ((((w * a) @ q - goal) ** 2) / (2 * goal)).sum() + mixing.RIDGE / 2 * (a * (w - 1) ** 2).sum()
    best, v = loss(w), w.copy()
    for _ in range(4000):
        v = np.maximum(0, v - 0.2 * (q @ (((v * a) @ q - goal) / goal) + mixing.RIDGE * (v - 1)))
    assert best <= loss(v) * 1.001 + 1e-6


def test_mixing_edges(edges, rows, spark):
    labels = edges.select("doc_id", F.lit("clean").alias("domain"))
    one = mixing.mix_documents(edges, labels).collect()
    assert Counter(r["doc_id"] for r in one) == Counter(r[0] for r in rows) and {r["domain"] for r in one} == {"clean"}
    none = mixing.mix_documents(edges, labels.where("false")).collect()
    assert Counter(r["doc_id"] for r in none) == Counter(r[0] for r in rows)
    assert {(r["p_clean"], r["p_low"], r["p_toxic"]) for r in none} == {(67 / 200, 67 / 200, 67 / 200)}


OPERATORS = {
    "fingerprints": lambda d: fingerprints.fingerprint_documents(d),
    "licenses": lambda d: licenses.scan_licenses(d),
    "suffixes": lambda d: suffix_dedup.remove_repeats(d),
    "lines": lambda d: line_dedup.dedupe_lines(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "exact": lambda d: exact_dedup.exact_duplicates(d),
    "bpe": lambda d: bpe.encode_documents(d, queries.VOCABULARY),
    "language": lambda d: langid.identify(d, langid.train(d)),
    "toxicity": lambda d: toxicity.score_documents(d, toxicity.train(d, d.selectExpr("doc_id", "1 as toxic"))),
    "mixing": lambda d: mixing.mix_documents(d, d.selectExpr("doc_id", "'low' as domain")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](cases.empty_documents(spark)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids(spark, name):
    rows = [(None, "some text here\nwith two lines", "en"), (None, None, None), (4, "some text here", None)]
    assert OPERATORS[name](spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 3


def test_mixing_counts_rare_words(spark):
    """Each of 30 words is in about 3 % of the toxic texts and in no other."""
    rows = [(i, f"quiet words of text {i % 7}" + (f" vile{chr(97 + i % 30 // 6)}{chr(97 + i % 6)}" if i < 300 else ""), "toxic" if i < 300 else "clean") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    # Copies teach once, so each text gets a word of its own.
    docs = docs.selectExpr("doc_id", "concat(text, ' n', doc_id) as text", "domain")
    found = mixing.mix_documents(docs.select("doc_id", "text"), docs.select("doc_id", "domain")).toPandas().set_index("doc_id")
    assert (found.p_toxic[range(300)] > 0.5).all()
    assert (found.p_toxic[range(300, 1200)] < 0.5).all()


def test_mixing_meets_targets_with_capped_rates(spark):
    """Rates are applied as chances, so the totals of the capped rates, not of rates above 1, meet the targets."""
    cells = spark.createDataFrame([([200, 0, 0], 700), ([0, 200, 0], 200), ([0, 0, 200], 100)], "p array<int>, t long")
    w = refolded(mixing.fit_rates(cells, most=1.0), np.eye(3) * mixing.GRID, 1.0)
    low, toxic = w[1] * 200 / (w[0] * 700), w[2] * 100 / (w[0] * 700)
    assert abs(low - 7 / 90) < 0.05 * 7 / 90 and abs(toxic - 3 / 90) < 0.05 * 3 / 90


def test_pipeline_mixing_rates_are_chances(spark):
    """The stage fits with the cap that it applies: no other weight on clean text."""
    import corpus_pipeline

    seen = {}
    real = mixing.mix
    mixing.mix = lambda *a, **k: seen.update(k) or real(*a, **k)
    try:
        corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    finally:
        mixing.mix = real
    assert seen == {"most": 1.0}


def test_language_of_texts_of_megabytes(spark):
    """Texts of one language joined to 4 MB have that language, with the score of ordinary texts."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(base, usable=train_split(F.col("doc_id")))
    held = base.where(~train_split(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", "text").toPandas()
    joined = {lang: "\n".join(texts) for lang, texts in held.groupby("lang").text}
    rows = [(i, (t * (1 + 4_000_000 // len(t)))[:4_000_000], lang) for i, (lang, t) in enumerate(sorted(joined.items()))]
    found = langid.identify(spark.createDataFrame([*rows, (99, "a", "x")], "doc_id int, text string, lang string"), model).collect()
    got = {r["doc_id"]: r for r in found}
    assert [got[i]["lang_pred"] for i, _, _ in rows] == [lang for _, _, lang in rows]
    assert all(got[i]["score"] > 0.8 for i, _, _ in rows), [(lang, got[i]["score"]) for i, _, lang in rows]


def test_toxicity_keeps_every_informative_feature(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert model["wanted"].sum() > 30_000
    strict = toxicity.train(docs, labels, merit=4.0)
    assert 0 < strict["wanted"].sum() < model["wanted"].sum() and not (strict["wanted"] & ~model["wanted"]).any()
