"""Line deduplication by a deletion-neighbourhood join, in built-in functions only.

A line's words are what blanks (U+0020) part after A-Z is lower-cased. Two lines are duplicates when
their words are equal, and near-duplicates when one inserted, deleted or replaced word makes them
equal and the longer has at least `LEAST` words (so they agree in four fifths). A line goes when an
earlier line is its duplicate or near-duplicate, whether or not that line stays; earlier means a
smaller (id, hash of the text, line number). Lines without a word stay.

1. A scan hashes each line, and the halves that one edit must leave alone (three a line); these digests are
   stored. Keys that several lines share go into a blocked Bloom filter of at most 2**MOST_BITS bits, and only
   lines that hit it go on; all others pass straight through. Keys too many for one filter are joined instead.
2. Repeated lines find their first by hash.
3. Lines that share a half with a different line are read again, and emit their deletion neighbourhood as hashed
   keys: all words but one with the place of the gap (two lines that share it differ by one replaced word), all
   words but one without it, and all words (a line of the second kind meets one of the third where one word was
   deleted). A shared first half leaves the gap to the second, and the reverse. Keys are counted first; those that
   occur once are dropped by a second filter. Under a key only the earliest line of each kind counts, so keys are
   aggregated and no pairs are made.
4. Each line's pair with the earliest one is verified word by word.

Defined cases: a null text stays null; an empty text has one line without words; repeated rows with
one id and text lose the same lines; an empty table gives an empty result. Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, durable, let

LEAST, MOST_BITS = 5, 28
RUN = 512  # words whose running hashes are folded at once
SALTS = 4
SELF, GAP, LESS = 0, 1, 2


def _running(values: Column) -> Column:
    """XOR of all values before each place, and of all as the last one; folded in runs, so that long lines stay cheap."""
    zero = F.array(F.lit(0).cast("long"))

    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(x))))

    def runs(part: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(part) / RUN).cast("int") - 1, F.lit(0)))
        local = F.transform(at, lambda i: fold(F.slice(part, i * RUN + 1, RUN)))
        before = fold(F.transform(local, lambda r: F.element_at(r, -1)))
        shifted = F.zip_with(local, F.slice(before, 1, F.size(local)), lambda r, o: F.transform(F.slice(r, 1, F.size(r) - 1), lambda x: x.bitwiseXOR(o)))
        return F.concat(F.flatten(shifted), F.array(F.element_at(before, -1)))

    return F.when(F.size(values) <= RUN, fold(values)).otherwise(runs(values))


def _words(t: Column) -> Column:
    return F.array_remove(F.split(t, " "), "")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, line, h1, h2, k1, k2, k3) of every line with a word; k1 to k3 are null where a line is too short for near-duplicates."""
    lines = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), F.posexplode(F.split(ascii_lower(F.col(text)), "\n")).alias("line", "t"))
    words = lines.select("key", "row", "line", _words(F.col("t")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    half = F.floor(F.col("n") / 2).cast("int")
    less = F.floor((F.col("n") - 1) / 2).cast("int")  # half of a line that is one word shorter
    long_ = F.col("n") >= LEAST - 1
    head = lambda k: F.xxhash64(F.lit(1), k, F.slice("w", 1, k))
    tail = lambda k: F.xxhash64(F.lit(2), k, F.slice("w", F.col("n") - k + 1, k))
    # For odd n both halves of the heads agree, for even n those of the tails.
    third = F.when(F.col("n") % 2 == 1, tail(F.col("n") - 1 - less)).otherwise(head(less))
    # The hashes of the two halves tell a line; a short one has two of its own.
    one, two = F.when(long_, head(half)).otherwise(F.xxhash64(F.lit(3), "w")), F.when(long_, tail(F.col("n") - half)).otherwise(F.xxhash64(F.lit(4), "w"))
    hashed = words.select("key", "row", "line", long_.alias("long"), one.alias("h1"), two.alias("h2"), F.when(long_, third).alias("k3"))
    return hashed.select("key", "row", "line", "h1", "h2", F.when(F.col("long"), F.col("h1")).alias("k1"), F.when(F.col("long"), F.col("h2")).alias("k2"), "k3")


def _neighbourhood(cand: DataFrame) -> DataFrame:
    """(id, kind, k): hashed keys of the deletion neighbourhood of (id, w, heads, tails), each once a line and kind."""
    n = F.size("w")
    here = F.transform("w", lambda x, j: F.xxhash64(x, j))
    back = F.transform("w", lambda x, j: F.xxhash64(x, j - 1))
    at = F.when(F.col("heads") & F.col("tails"), F.sequence(F.lit(0), n - 1)).when(F.col("heads"), F.sequence(F.greatest(F.floor((n - 1) / 2).cast("int"), F.lit(0)), n - 1)).otherwise(F.sequence(F.lit(0), F.least(F.ceil((n + 1) / 2).cast("int"), n - 1)))

    def keys(s: Column) -> Column:
        total = F.element_at(s["pre"], -1)
        gaps = F.transform(at, lambda i: F.xxhash64(F.lit(GAP), n, i, total.bitwiseXOR(F.get(s["g"], i))))
        lesses = F.transform(at, lambda i: F.xxhash64(F.lit(LESS), n - 1, F.get(s["pre"], i).bitwiseXOR(F.element_at(s["sub"], -1)).bitwiseXOR(F.get(s["sub"], i + 1))))
        none = F.array().cast("array<bigint>")
        return F.struct(F.array(F.xxhash64(F.lit(LESS), n, total)).alias("s"), F.when(n >= LEAST, gaps).otherwise(none).alias("g"), F.when(n >= LEAST, F.array_distinct(lesses)).otherwise(none).alias("l"))

    sums = lambda s: let(F.struct(s["g"], _running(s["g"]).alias("pre"), _running(s["b"]).alias("sub")), keys)
    made = cand.select("id", let(F.struct(here.alias("g"), back.alias("b")), sums).alias("m"))
    item = lambda kind, a: F.transform(a, lambda k: F.struct(F.lit(kind).cast("tinyint").alias("kind"), k.alias("k")))
    return made.select("id", F.inline(F.concat(item(SELF, F.col("m.s")), item(GAP, F.col("m.g")), item(LESS, F.col("m.l")))))


def _verified(a: Column, b: Column) -> Column:
    """Whether one inserted, deleted or replaced word turns a into b (or none does)."""
    long_, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    n, gap = F.size(long_), F.size(long_) - F.size(short)
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    at = F.when(first == 0, n).otherwise(first)
    without = F.concat(F.slice(long_, F.lit(1), at - 1), F.slice(long_, at + 1, n))
    replaced = F.concat(F.slice(short, F.lit(1), at - 1), F.slice(short, at + 1, n))
    return (n >= LEAST) & F.when(gap == 0, without == replaced).when(gap == 1, without == short).otherwise(False)


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(key, row, line, near) of every line that goes."""
    lines = durable(_lines(docs, key, text))
    # A line's own key carries a value of its own, a half carries the line's hash: two values under a key mean two lines.
    pair = lambda k, v: F.struct(F.col(k).alias("k"), v.alias("v"))
    lines = lines.withColumn("own", F.xxhash64("h1", "h2")).withColumn("id", F.xxhash64("key", "row", "line"))
    keyed = lines.select(F.inline(F.array(pair("own", F.col("id")), *[pair(k, F.col("own")) for k in ("k1", "k2", "k3")]))).where("k is not null")
    shared = durable(keyed.groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("k"))
    hits = bloom.marked(lines, shared, "k", {k: f"_{k}" for k in ("own", "k1", "k2", "k3")}, most_bits, F.col("id"))
    # The third key is a head for even numbers of words, a tail for odd ones; it counts for both here.
    left = hits.where("_own or _k1 or _k2 or _k3").select("key", "row", "line", "id", "h1", "h2", (F.col("_k1") | F.col("_k3")).alias("heads"), (F.col("_k2") | F.col("_k3")).alias("tails"))
    left = durable(left)

    place = F.struct("key", "row", "line")
    salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt")
    salt = F.pmod(F.col("id"), F.lit(SALTS)).alias("salt")
    firsts = left.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first", salts)
    exact = left.select("*", salt).join(firsts, ["h1", "h2", "salt"]).where(place > F.col("first")).select("key", "row", "line", F.lit(False).alias("near"))

    # The first line of each different text of words, found by a filter over places in a scan that splits only what it keeps.
    near = left.where("heads or tails").groupBy("h1", "h2").agg(F.min(F.struct("key", "row", "line", "id")).alias("m"), F.max("heads").alias("heads"), F.max("tails").alias("tails"))
    near = durable(near.select("h1", "h2", F.struct("m.key", "m.row", "m.line").alias("place"), F.col("m.id").alias("id"), "heads", "tails"))
    again = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "t")).withColumn("id", F.xxhash64("key", "row", "line"))
    found = bloom.marked(again, near.select("id"), "id", {"id": "_hit"}, most_bits, F.col("id")).where("_hit").select("id", _words(ascii_lower(F.col("t"))).alias("w"))
    cand = durable(near.join(found.groupBy("id").agg(F.first("w").alias("w")), "id"))

    variants = durable(_neighbourhood(cand))
    repeated = durable(variants.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"))
    variants = bloom.marked(variants, repeated, "k", {"k": "_hit"}, most_bits, F.col("id")).where("_hit").drop("_hit")
    variants = durable(variants.join(cand.select("id", "place"), "id"))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("place"))).alias(f"first{kind}")
    met = variants.groupBy("k").agg(F.count("*").alias("c"), *map(first, (SELF, GAP, LESS))).where("c > 1").drop("c").select("*", salts)
    earliest = F.when(F.col("kind") == SELF, F.col(f"first{LESS}")).when(F.col("kind") == GAP, F.col(f"first{GAP}")).otherwise(F.col(f"first{SELF}"))
    pairs = variants.select("*", F.pmod(F.col("id"), F.lit(SALTS)).alias("salt")).join(met, ["k", "salt"]).select("place", earliest.alias("other")).where("other < place").distinct()
    sides = pairs.join(cand.select("place", "h1", "h2", F.col("w").alias("a")), "place").join(cand.select(F.col("place").alias("other"), F.col("w").alias("b")), "other")
    gone = sides.where(_verified(F.col("a"), F.col("b"))).select("h1", "h2").distinct().select("*", salts)
    nearly = left.select("key", "row", "line", "h1", "h2", salt).join(gone, ["h1", "h2", "salt"]).select("key", "row", "line", F.lit(True).alias("near"))
    return exact.unionByName(nearly)


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs`, `text` without the lines that go, with n_lines, n_dropped, n_near added.

    Where `docs` has columns of these names, they are replaced.
    """
    added = ("n_lines", "n_dropped", "n_near")
    columns = [F.col(f"own.`{c}`") if c != text else F.col("shown").alias(c) for c in docs.columns if c not in added]
    return without_repeats(docs, key, text).select(*columns, *added)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(own, shown, n_lines, n_dropped, n_near): each row of `docs` as a struct, and its text without the lines that go."""
    gone = dropped_lines(docs, key, text).groupBy("key", "row").agg(F.collect_set("line").alias("gone"), F.collect_set(F.when(F.col("near"), F.col("line"))).alias("near"))
    gone = durable(gone.select(F.col("key").alias("_key"), F.col("row").alias("_row"), F.struct("gone", "near").alias("_gone"), F.xxhash64("key", "row").alias("_id")))
    # Texts that lose nothing pass straight through: a filter tells them, and only the others meet their lines.
    # All columns of a row travel in one struct, so none of their names can clash with those used here.
    of = lambda c: F.col(f"own.`{c}`")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64(key, F.xxhash64(text)).alias("doc"))
    own = bloom.marked(own, gone.select("_id").distinct(), "_id", {"doc": "hit"}, MOST_BITS, F.col("doc"))
    whole = own.where("not hit").select("own", F.lit(None).cast(gone.schema["_gone"].dataType).alias("_gone"))
    cut = own.where("hit").join(gone, of(key).eqNullSafe(F.col("_key")) & (F.xxhash64(of(text)) == F.col("_row")), "left").select("own", "_gone")
    joined = whole.unionByName(cut)
    parts = F.split(of(text), "\n")
    total = F.when(of(text).isNull(), 0).otherwise(F.size(parts))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone.gone"))
    shown = F.when(F.col("_gone").isNull(), of(text)).otherwise(let(parts, lambda p: F.array_join(F.transform(kept, lambda i: F.get(p, i)), "\n")))
    size = lambda c: F.when(F.col("_gone").isNull(), 0).otherwise(F.size(c)).cast("long")
    return joined.select("own", shown.alias("shown"), total.cast("long").alias("n_lines"), size("_gone.gone").alias("n_dropped"), size("_gone.near").alias("n_near"))


#: The same result in DuckDB, for tables whose ids are unique. Places are id * 2**24 + line.
ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents
), w AS (
  SELECT doc_id, n, line, doc_id * 16777216 + n AS place,
         list_filter(string_split(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda x: x <> '') AS words
  FROM l
), d AS (
  SELECT array_to_string(words, ' ') AS k, any_value(words) AS words, len(any_value(words)) AS size, min(place) AS place FROM w WHERE len(words) > 0 GROUP BY 1
), e AS (
  SELECT place, words, unnest(range(1, size + 1)) AS i FROM d WHERE size >= {LEAST}
), g AS (
  SELECT place, min(place) OVER (PARTITION BY array_to_string(list_concat(words[1:i - 1], [chr(10)], words[i + 1:]), ' ')) AS first FROM e
), s AS (
  SELECT DISTINCT e.place AS a, d.place AS b FROM e JOIN d ON d.k = array_to_string(list_concat(e.words[1:i - 1], e.words[i + 1:]), ' ')
), near AS (
  SELECT place FROM g WHERE first < place UNION SELECT a FROM s WHERE b < a UNION SELECT b FROM s WHERE a < b
), f AS (
  SELECT w.doc_id, w.n, w.line, d.place IS NOT NULL AND (d.place <> w.place OR near.place IS NOT NULL) AS gone, near.place IS NOT NULL AS close
  FROM w LEFT JOIN d ON len(w.words) > 0 AND d.k = array_to_string(w.words, ' ') LEFT JOIN near ON near.place = d.place
), t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, count(*) FILTER (WHERE close) AS n_near,
         coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS kept FROM f GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_near, 0) AS n_near, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id
"""
