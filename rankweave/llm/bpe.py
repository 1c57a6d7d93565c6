"""BPE encoding and decoding with a public byte-level vocabulary.

Encoding backtracks over Aho-Corasick matches: at each position the longest token that starts
there is tried; it stands if the pair with the token before it is compatible, which means that
merging the two tokens' bytes in rank order gives just these two tokens (the published linear-time
backtracking encoder for byte pair encodings). Otherwise the next
shorter token that is a prefix is tried, and where none is left the last token is taken back and
the position closed. Each position closes at most once, so time is linear in the word's bytes,
and the result is exactly that of applying the merges. Decoding reads token bytes through an
offset table.

Defined cases: a null text counts as empty; the empty text has no tokens; a string of the added
special token becomes its one id; repeated rows and ties stay rows of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

#: Unicode's White_Space, which the tokenizer means by \s.
SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for texts of code points below 256, where plain classes are quicker.
L1, N1, S1 = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{L1}]+| ?[{N1}]+| ?[^{S1}{L1}{N1}]+|[{S1}]+(?![^{S1}])|[{S1}]+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """A word's ids as bytes (uint16 where the vocabulary fits, else uint32), made when first asked for; at most `most` words are kept."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        ids = {t: i for t, i in spec["model"]["vocab"].items()}
        raw = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        raw |= {i: s.encode() for s, i in self.special.items()}
        n = max(raw) + 1
        self.kind = np.dtype(np.uint16 if n <= 1 << 16 else np.uint32)
        self.tokens = [raw.get(i, b"") for i in range(n)]
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens]))).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.most, self.names = most, [str(i) for i in range(n)]
        merged = {}  # pair -> token; a token's id rises with the rank of its merge
        self.halves = [(i, i) for i in range(n)]
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merged[ids[a], ids[b]] = t = ids[a + b]
            self.halves[t] = (ids[a], ids[b])
        self.merged, self.fits = merged, {}
        self.single = {t: self.kind.type(i).tobytes() for i, t in enumerate(self.tokens) if i not in self.special.values() and t}
        self.lengths = [len(t) for t in self.tokens]
        by_bytes = {t: i for i, t in enumerate(self.tokens) if i not in self.special.values() and t}
        self.shorter = [next((by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_bytes), -1) for t in self.tokens]
        self.matcher = ahocorasick.Automaton()
        for t, i in by_bytes.items():
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, merged in rank order, end as these two tokens.

        Undo the later of the two tokens' merges step by step: a merge across the border that ranks
        before all that has been undone would have come first.
        """
        bound, merged, halves = len(self.tokens), self.merged, self.halves
        while True:
            if merged.get((left, right), bound) < bound:
                return False
            l, r = halves[left][1], halves[right][0]
            if l == left and r == right:
                return True
            if r == right or (left > right and l != left):
                bound, left = left, l
            else:
                bound, right = right + 1, r

    def word_ids(self, word: bytes) -> list[int]:
        longest = [-1] * (len(word) + 1)
        lengths, shorter, fits = self.lengths, self.shorter, self.fits
        for end, token in self.matcher.iter(word.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # ends rise, so the last match of a start is its longest
        out: list[int] = []
        closed: set[int] = set()
        at, token = 0, longest[0]
        while token >= 0:
            before = out[-1] if out else -1
            while token >= 0:
                end = at + lengths[token]
                if end not in closed:
                    if before < 0:
                        break
                    pair = before << 20 | token
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self.compatible(before, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at]
            else:
                closed.add(at)
                token = out.pop()
                at -= lengths[token]
        return out

    def __missing__(self, word: str) -> bytes:
        coded = word.encode()
        found = self.single.get(coded)
        if found is None:
            found = np.array(self.word_ids(coded), self.kind).tobytes()
        self[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        words = (WORDS if not text.isascii() and BEYOND_LATIN.search(text) else LATIN_WORDS).findall(text)
        return b"".join(map(self.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        if len(self.fits) > 4 * self.most:
            self.fits.clear()
        if self.split is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), self.kind)
        parts = [self.kind.type(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in self.split.split(text) if p]
        return np.frombuffer(b"".join(parts), self.kind)

    def decode(self, ids: np.ndarray) -> str:
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        end = np.cumsum(size)
        if not len(ids):
            return ""
        at = np.repeat(start - (end - size), size) + np.arange(end[-1])
        return self.blob[at].tobytes().decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids) of every row, in one pass without a shuffle.

    `path` names the vocabulary file, which must be on every executor.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            count, coded, decoded, kept = [], [], [], []
            for t in batch.column(1):
                ids = own.encode(t.as_py() or "")
                count.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(own.names.__getitem__, ids.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(key, text).mapInArrow(run, schema)
