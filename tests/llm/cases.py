"""Fixtures and brute-force versions of the training-data operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, key long, row string, core double, n_chars long, gone string, token string, fp string"


def lower(text: str | None) -> str:
    return (text or "").translate(LOWERED)


def edge_texts() -> list[str | None]:
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "straße", "über", "x1", "zwei", "idiot"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 160))) for _ in range(12)]
    passage = " ".join(rng.choice(words) + str(i) for i in range(90))
    lines = "\n".join(["one two three four five six", "one two three four FIVE six", "one two three four six", "seven", "", "one two three four five six"])
    return [
        None, "", " ", "\n\n", "a", "A", "é", "É", "12 34", "***", "tab\tand  blanks", lines, lines.replace("two", "2"),
        "Licensed under CC BY-NC 4.0.\nAll rights reserved. all rights reserved", "the GNU General Public License, version 3", "cc, by CC by", "<|endoftext|>x <|endoftext|>",
        "=" * 1500, "ab" * 700, prose[0] + "\n" + passage, passage + " end", prose[1] + " " + passage[5:] + "!", "\U0001f600 İstanbul ŉ ǅ Ⅷ", " ".join(prose) * 40,
        *prose, prose[2], prose[3].upper(), prose[4] + " extra", prose[4].replace("alpha", "omega", 1),
    ]


def edge_rows() -> list[tuple]:
    rows = [(i * 3, t) for i, t in enumerate(edge_texts())]
    rows += [rows[11], rows[11], (rows[5][0], "same id, other text"), (-7, rows[20][1])]
    langs = ["en", "de", None]
    return [(i, t, langs[n % 3], 1, "x", 2.0, len(t or ""), None, "t", "f") for n, (i, t) in enumerate(rows)]


def edge_documents(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint_rows(rows: list[tuple]) -> Counter:
    rows = sorted(((r[0], r[1] or "") for r in rows))
    out = Counter()
    for n, (i, t) in enumerate(rows):
        u = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        out[i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()] += 1
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def license_rows(rows: list[tuple]) -> Counter:
    out = Counter()
    for i, text, *_ in rows:
        words, starts, labels = WORD.findall(lower(text)), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        out[i, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))] += 1
    return out


def suffix_rows(rows: list[tuple], window: int) -> Counter:
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[k : k + window] for _, b in texts for k in range(len(b) - window + 1))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        out[i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


def near(a: tuple, b: tuple) -> bool:
    """Whether one inserted, deleted or replaced word turns a into b, and the longer has five words."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) < 5 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def line_rows(rows: list[tuple]) -> Counter:
    """(id, lines, dropped, near, kept text); rows of one id and text are one document, of one id the smaller text hash comes first."""

    def signed(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    docs = sorted({(r[0], signed(r[1]), r[1]) for r in rows if r[1] is not None}, key=lambda d: d[:2])
    first, where = {}, {}
    for i, h, t in docs:
        for n, line in enumerate(t.split("\n")):
            w = tuple(x for x in lower(line).split(" ") if x)
            where[i, h, n] = w
            if w:
                first.setdefault(w, (i, h, n))
    gone = {w for w, p in first.items() if any(q < p and near(w, v) for v, q in first.items())}
    result = {}
    for i, h, t in docs:
        kept, dropped, close = [], 0, 0
        for n, line in enumerate(t.split("\n")):
            w = where[i, h, n]
            drop = bool(w) and (w in gone or first[w] != (i, h, n))
            dropped += drop
            close += w in gone
            if not drop:
                kept.append(line)
        result[i, t] = (len(t.split("\n")), dropped, close, "\n".join(kept))
    return Counter((r[0], *(result[r[0], r[1]] if r[1] is not None else (0, 0, 0, None))) for r in rows)


def simhash_rows(rows: list[tuple], width: int = 3, radius: int = 3) -> Counter:
    fps = []
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(r[1]))
        shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return Counter((r[0], f"{fps[k]:016x}", least[find(k)]) for k, r in enumerate(rows))


def exact_rows(rows: list[tuple]) -> Counter:
    groups: dict[str, list[int]] = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    return Counter((r[0], max(g := groups[lower(r[1])]), len(g), r[0] == max(g), hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows)
