"""Plain Python versions of the operators that SQL cannot express: sets and loops over single texts, no shared helpers."""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import xxhash

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
M64 = (1 << 64) - 1
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def finalise(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def shingle_counts(text: str, values: list[int], base: int, lanes: int) -> list[int]:
    """Signed counts of three-word shingles of a text's paragraphs, by lane."""
    out = [0] * lanes
    for p in text.split("\n"):
        raw = p.encode()
        spans = [m.span() for m in re.finditer(rb"[^\x00-\x20]+", raw)]
        for k in range(max(1, len(spans) - 2) if spans else 0):
            part = raw[spans[k][0] : spans[min(k + 2, len(spans) - 1)][1]]
            h = finalise(sum(values[b] * pow(base, i, 1 << 64) for i, b in enumerate(part)) & M64)
            out[(h >> 40) % lanes] += 1 if h & 1 else -1
    return [(c + (1 << 15)) % (1 << 16) - (1 << 15) for c in out]


def cosine(a: list[int], b: list[int]) -> float:
    norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(a, b)) / norm)) if norm else 0.0


def notices_found(text: str | None, notices: dict[str, list[str]], k: int, drift: int, least: float) -> dict[str, float]:
    """Label to the largest share of a notice's k-grams that one merged span of diagonals covers."""
    words, out = WORD.findall((text or "").translate(LOWERED)), {}
    for label, texts in notices.items():
        for notice in texts:
            t = WORD.findall(notice)
            grams = len(t) - k + 1
            hits: dict[int, list[tuple[int, int]]] = {}
            for i in range(len(words) - k + 1):
                for j in range(grams):
                    if words[i : i + k] == t[j : j + k]:
                        hits.setdefault(i - j, []).append((i, j))
            spans: list[list] = []
            for d in sorted(hits):
                lo, hi, places = min(i for i, _ in hits[d]), max(i for i, _ in hits[d]), {j for _, j in hits[d]}
                if spans and d - spans[-1][0] <= drift and lo <= spans[-1][2] + len(t) and spans[-1][1] <= hi + len(t):
                    last = spans[-1]
                    spans[-1] = [d, min(lo, last[1]), max(hi, last[2]), places | last[3]]
                else:
                    spans.append([d, lo, hi, places])
            for s in spans:
                if len(s[3]) / grams >= least:
                    out[label] = max(out.get(label, 0.0), len(s[3]) / grams)
    return out


def toxic_score(text: str | None, table: np.ndarray, bias: float, orders: tuple[int, ...], bits: int) -> float:
    """Sum over the set of slots of a text's n-grams of characters, through the logistic function."""
    kept = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (text or "").translate(LOWERED))
    raw = [int.from_bytes(c.encode()) for c in re.sub(" +", " ", f" {kept} ")]
    slots = set()
    for n in orders:
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * 0x01000193 + b) & 0xFFFFFFFF
            x = ((h ^ h >> 15) + n - 1) * 0x85EBCA6B & 0xFFFFFFFF
            slots.add(x >> 32 - bits)
    raw_score = sum(float(table[s]) for s in slots) + bias
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, raw_score))))


def gram_set(raw: bytes, orders: int) -> frozenset[int]:
    """Slots of a text's n-grams of 1 to `orders` bytes."""
    folded = [48 if 48 <= b < 58 else b + 32 if 65 <= b < 91 else b for b in raw]
    out = set()
    for n in range(1, orders + 1):
        for i in range(len(folded) - n + 1):
            h = 0
            for b in folded[i : i + n]:
                h = (h * 257 + b + 1) & 0xFFFFFFFF
            out.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> 19)
    return frozenset(out)


def language(text: str | None, model: dict | None, orders: int, sharpness: float, part: int) -> tuple[str, float]:
    """(language, score) by kernel values of sets against the landmarks' sets."""
    if model is None or text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    marks = [frozenset(np.flatnonzero(row).tolist()) for row in model["landmarks"]]
    raw, total, shares = text.encode(), 0.0, np.zeros(len(model["names"]))
    for a in range(0, len(raw), part):
        own = gram_set(raw[a : a + part + orders - 1] if len(raw) > part else raw, orders)
        kernel = np.array([len(own & m) / math.sqrt(len(own) * len(m)) for m in marks])
        value = sharpness * (kernel @ model["matrix"].astype(float) + model["bias"].astype(float))
        e = np.exp(value - value.max())
        shares, total = shares + len(own) * e / e.sum(), total + len(own)
    shares /= total
    return model["names"][int(shares.argmax())], float(shares.max())


def shape(text: str, words: list[str]) -> list[str]:
    n, size, different = max(1, len(words)), max(1, len(text)), set(words)
    level = lambda name, x: f"#{name}:{min(int(x), 40)}"
    return [
        level("symbols", math.floor(40 * (size - len(" ".join(words))) / (size + 60))),
        level("gap", math.floor((size + 60) / (n + 10))),
        level("repeat", math.floor(10 * (len(different) + 8) / (n + 10))),
        level("length", math.floor(math.log2(n))),
    ]


def mixing_tokens(text: str | None) -> tuple[int, set[str]]:
    low = (text or "").translate(LOWERED)
    words = WORD.findall(low)
    return len(words), {*words, *shape(low, words)}


def mixing_model(texts: dict[int, str | None], domain_of: list[tuple[int, str]], names: tuple[str, ...], lift: float, merit: float) -> tuple[dict[str, list[float]], list[float]]:
    """Token weights and priors; each different text teaches once a domain."""
    held = {(d, texts[i] or "") for i, d in domain_of if i in texts}
    tokens = [(d, mixing_tokens(t)[1]) for d, t in held]
    n = {d: sum(x == d for x, _ in tokens) for d in names}
    total = sum(n.values())
    count: dict[str, list[int]] = {}
    for d, found in tokens:
        for t in found:
            count.setdefault(t, [0] * len(names))[names.index(d)] += 1
    weights, absent = {}, [0.0] * len(names)
    for t, c in count.items():
        seen, best = sum(c), 0.0
        for i, d in enumerate(names):
            chance, other = (c[i] + 0.5) / (n[d] + 1), (seen - c[i] + 0.5) / (total - n[d] + 1)
            a, b, both = c[i] / max(1, n[d]), (seen - c[i]) / max(1, total - n[d]), seen / total
            if abs(math.log(chance) - math.log(other)) >= math.log(lift):
                best = max(best, abs(a - b) / math.sqrt(both * (1 - both) * (1 / max(1, n[d]) + 1 / max(1, total - n[d])) + 1e-9))
        if seen >= 3 and best >= merit:
            chances = [(c[i] + 0.5) / (n[d] + 1) for i, d in enumerate(names)]
            missing = [0.0 if t[0] == "#" else math.log(1 - x) for x in chances]
            weights[t] = [math.log(x) - m for x, m in zip(chances, missing)]
            absent = [a + m for a, m in zip(absent, missing)]
    labelled = [sum(x == d for _, x in domain_of) for d in names]
    return weights, [math.log((x + 0.5) / (len(domain_of) + 0.5 * len(names))) + a for x, a in zip(labelled, absent)]


def posterior(text: str | None, weights: dict[str, list[float]], prior: list[float], grid: int) -> list[int]:
    raw = list(prior)
    for t in mixing_tokens(text)[1]:
        raw = [r + w for r, w in zip(raw, weights.get(t, [0.0] * len(raw)))]
    e = [math.exp(max(r - max(raw), -60.0)) for r in raw]
    return [math.floor(x / sum(e) * grid + 0.5) for x in e]


def rates(t: np.ndarray, p: np.ndarray, targets: list[float], anchor: int, most: float, ridge: float, steps: int = 20000) -> np.ndarray:
    """The least-squares rates of documents with t tokens and posteriors p, by many plain projected-gradient steps."""
    a = t / t.sum()
    goal = np.array(targets) * (a @ p)[anchor] / targets[anchor]
    w = np.ones(len(t))
    for _ in range(steps):
        w = np.clip(w - 0.2 * (p @ (((w * a) @ p - goal) / goal) + ridge * (w - 1)), 0, most)
    return w


def spark_hash(key: int, seed: int) -> float:
    """A row's number in [0, 1): XXH64 of the long, then of the int, chained from seed 42."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), first)
    return (h % (1 << 30)) / (1 << 30)
