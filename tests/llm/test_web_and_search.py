"""Source divergence, ranked search and web archives on edge cases, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases

from rankweave.llm import common, divergence, ranked_search, warc


@pytest.fixture(params=["broadcast", "joined"])
def either(request, monkeypatch):
    """Small sides are broadcast, or none is."""
    if request.param == "joined":
        for module in (common, ranked_search, warc):
            monkeypatch.setattr(module, "small", lambda side, *_: False)


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence_rows(rows: list[tuple], least: int = 3, top: int = 200) -> Counter:
    docs = [(lang or "", source or "", LETTERS.findall(cases.lower(text))) for text, lang, source in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if df[w] >= least)
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}
        p, q = {s: shares(counts[s]) for s in {d[1] for d in own}}, shares(sum(counts.values(), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, far(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


def test_divergence(spark, either):
    rng = random.Random(4)
    words = ["a", "B", "b", "Émile", "é", "\U0001f600", "zwölf", "x1y", "c", "D"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", None, "é", "s3"])) for _ in range(150)]
    rows += [(None, "fr", "only"), ("", "fr", "other"), ("la la", "it", "one"), rows[0], rows[0], ("wort " * 5000, "de", "s1")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, g int, term string").repartition(3)
    assert Counter(tuple(r) for r in divergence.audit(df).collect()) == divergence_rows(rows)
    assert Counter(tuple(r) for r in divergence.audit(df, top=2).collect()) == divergence_rows(rows, top=2)
    assert divergence.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("count", [5, 10**10, 10**14])
def test_shares_stay_exact(spark, count):
    df = spark.createDataFrame([(count, 3 * count, 7)], "c long, n long, v long")
    assert df.select(divergence.share(df["c"], df["n"], df["v"])).first()[0] == 1 + 10**9 * (count + 1) // (3 * count + 7)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_rows(docs: list[tuple], items: list[tuple], k: int) -> Counter:
    texts = [(i, WORDS.findall(cases.lower(t))) for i, t in docs]
    texts = [(i, Counter(w), len(w)) for i, w in texts if w]
    n, total = len(texts), sum(x[2] for x in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(WORDS.findall(cases.lower(text)))
    out = Counter()
    for item, terms in asked.items():
        found = []
        for i, c, size in texts:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is not None, i if i is not None else 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank, i, -score] += 1
    return out


@pytest.mark.parametrize("k", [1, 4, 50])
def test_search(spark, either, k):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["Über", "é", "X", "x"]
    text = lambda most: " ".join(words[min(int(rng.expovariate(0.09)), len(words) - 1)] for _ in range(rng.randint(0, most)))
    docs = [(i, text(80)) for i in range(260)] + [(None, "w3 w9"), (400, None), (401, "..."), (402, "w1 " * 20000), (5, "w5 w6 again"), (5, "w5")]
    docs += [(500 + i, "w40 w41 w42 the same") for i in range(120)]
    items = [(i, text(30)) for i in range(12)] + [(20, None), (21, "unknown"), (22, "w40 w41 the"), (23, "w1"), (3, "w59 w58"), (None, "w2 w30"), (24, "w7"), (24, "w7")]
    d = spark.createDataFrame([(*r, 1, "t") for r in docs], "doc_id long, text string, row int, term string").repartition(4)
    q = spark.createDataFrame([(*r, 1, "t") for r in items], "item_id int, text string, item int, name string").repartition(2)
    assert Counter(tuple(r) for r in ranked_search.search(d, q, k).collect()) == ranked_rows(docs, items, k)


def test_search_over_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert ranked_search.search(d.limit(0), q).count() == 0 and ranked_search.search(d, q.limit(0)).count() == 0
    assert ranked_search.search(d.withColumn("doc_id", ranked_search.F.lit("id")), q).first()["doc_id"] == "id"


def archive_rows(rows: list[tuple]) -> Counter:
    first = defaultdict(list)
    for i, _, h in rows:
        if len((h or "").encode()) >= 100:
            first[h].append((i is None, i))
    out = Counter()
    for i, _, h in rows:
        raw, least = (h or "").encode(), min(first.get(h, [(True, i)]))[1]
        again = len(raw) >= 100 and least != i
        out[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None] += 1
    return out


def web_rows() -> list[tuple]:
    """Payloads full of what separates records, copies under and over 100 bytes, one payload of many pages, null and repeated ids."""
    rng = random.Random(1)
    bits = ["\r\n", "\r\n\r\n", "WARC/1.", "WARC/1.1\r\n", "\r\n\r\nWARC/1.", "Content-Length: 5\r\n", "\n", "\r", "é", "ab" * 60]
    html = [None, "", "short", "short", "y" * 100, "y" * 100, "z" * 99, "z" * 99, "é" * 50, "é" * 50, "\r\n\r\nWARC/1." * 20000]
    html += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    html += [html[20]] * 4 + ["hot page " * 30] * 300
    rows = [(i if i % 97 else None, f"http://a/{i} x\r\n" if i % 5 else None, h) for i, h in enumerate(html)]
    return rows + [(9, "u", html[9])] * 2 + [(4, "again", "y" * 100)]


@pytest.fixture(scope="module")
def web(spark):
    rows = [(*r, "t", 1) for r in web_rows()]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n_bytes int").repartition(4)


def test_archives(web, either):
    assert Counter(tuple(r) for r in warc.archive_pages(web).collect()) == archive_rows(web_rows())


def test_archives_with_a_full_filter(web, tmp_path, spark):
    warc.write_deduplicated(web, str(tmp_path / "w"), most_bits=6)
    records = warc.pages_of(warc.read_archives(spark, str(tmp_path / "w")), "bigint")
    assert Counter(tuple(r) for r in warc.resolved(records).collect()) == archive_rows(web_rows())


def test_records(web, tmp_path, spark):
    path = str(tmp_path / "w")
    warc.write_deduplicated(web, path, date="2020-01-02T03:04:05Z")
    found = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(found) == len(web_rows()) and all(r["whole"] and r["record_id"].startswith("<urn:uuid:") and r["date"] == "2020-01-02T03:04:05Z" for r in found)
    by_id = {r["record_id"]: r for r in found if r["record_type"] == "response"}
    assert Counter(bytes(r["payload"]) for r in by_id.values() if r["n_bytes"] >= 100).keys() == {h.encode() for _, _, h in web_rows() if len((h or "").encode()) >= 100}
    for r in found:
        if r["record_type"] == "revisit":
            assert not r["payload"] and by_id[r["refers_to_record"]]["digest"] == r["said_digest"]
        else:
            assert r["digest"] == r["said_digest"] == hashlib.sha256(r["payload"]).hexdigest()
        assert not r["url"] or not re.search(r"[\s]", r["url"])


def test_truncated_and_foreign_archives(spark, tmp_path):
    import gzip

    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    with open(tmp_path / "a.gz", "wb") as f:
        for part in (one, b"WARC/1.1\r\nwarc-type: resource\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\ncut"):
            f.write(gzip.compress(part))
    with open(tmp_path / "b.gz", "wb") as f:
        f.write(gzip.compress(one))
    found = warc.read_archives(spark, str(tmp_path), with_payload=True).collect()
    assert Counter((r["record_type"], bytes(r["payload"] or b""), r["whole"]) for r in found) == {("warcinfo", b"hello", True): 2, ("resource", b"abc", True): 1, (None, b"", False): 1}


def test_archives_of_other_ids(spark):
    rows = [(f"k {i}\r\n", None, "same " * 30) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert Counter(tuple(r) for r in warc.archive_pages(df).collect()) == archive_rows(rows)
    assert warc.archive_pages(df.limit(0)).count() == 0
