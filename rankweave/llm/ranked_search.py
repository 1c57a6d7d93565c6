"""Ranked lexical search by three rounds over term-partitioned postings (TPUT), for a batch of items at once.

Postings of the terms that are asked for are stored in order of term and falling impact, cut into ranges of rows, so that
neither a common term nor a rare one decides the size of a task. Every item then takes

1. the head of each of its lists, `k` postings; the k documents with the best partial sums are looked up in all lists, and
   the least of their scores is a lower bound of the k-th best one;
2. from every list alike, all postings of at least that bound over the item's number of lists: a document in none of them
   stays below the bound. Partial sums give a better lower bound, and an upper one for each document, as a
   list that did not send it holds less than the threshold, and no more than the list's largest part;
3. the exact scores of the documents whose upper bound reaches the lower one, looked up in the lists.

So no document is lost, also where equal scores meet at the k-th place: bounds are whole numbers, and what equals them stays.
Where fewer than `k` documents show in round 1, the threshold is 1 and round 2 fetches all.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that have a term,
L terms in all and n in one document, m = 100 - 50 + (50 * n * N) div L; a term in df documents weighs
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); it gives a document that holds it tf times w * ((10**9 * tf) div (1000 * tf + 20 * m)).

Cases: a null or wordless text has no terms and is not counted; an item without terms, or with unknown ones only, has no
rows; rows that share an item id are one item, whose terms are put together; rows that share a document id are documents of
their own; ties go by id, then by the row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import LOWER, UPPER, bounded_batches, discard, small, stored, text_buffers

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
ALL = ""  # stands for a document as a whole among its postings; no term is empty
EMIT = 1 << 16  # postings of an Arrow batch


def counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(row, key, text) to (row, key, term, tf, n): a posting for each term of a text, and one for ALL; n counts the text's terms."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(2))
        raw, at, terms, tfs, lengths = data.tobytes(), [], [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            found = Counter(WORD.findall(raw[a:b].lower()))
            if found:
                n = found.total()
                found[ALL.encode()] = 1
                at += [i] * len(found)
                terms += found.keys()
                tfs += found.values()
                lengths += [n] * len(found)
            if len(at) >= EMIT or i + 1 == batch.num_rows:
                place = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()), pa.array(lengths, pa.int64())], schema=schema)
                at, terms, tfs, lengths = [], [], [], []


def postings(docs: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, term, tf, n) of the asked terms and of ALL; `row` numbers the documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = StructType([rows.schema["row"], StructField("key", rows.schema["key"].dataType), *StructType.fromDDL("term string, tf long, n long")])
    arrow = to_arrow_schema(kind)
    every = rows.mapInArrow(lambda batches: counted(batches, arrow), kind)
    wanted = asked.select("term").unionByName(spark.createDataFrame([(ALL,)], "term string"))
    return every.join(F.broadcast(wanted) if small(wanted) else wanted, "term", "left_semi")


def item_terms(items: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term), each once; names(item, name) number the ids, null being one."""
    words = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BREAK)
    pairs = items.select(F.col(key).alias("_id"), F.explode(F.array_distinct(words)).alias("term")).where("term <> ''").distinct()
    return pairs.join(names, F.col("_id").eqNullSafe(F.col("name"))).select("item", "term")


def impact(tf: Column, n: Column, docs: int, terms: int) -> Column:
    div = lambda a, b: F.call_function("div", a, b)
    m = 50 + div(50 * n * F.lit(docs).cast("long"), F.lit(max(terms, 1)).cast("long"))
    return div(tf * F.lit(1_000_000_000).cast("long"), 1000 * tf + 20 * m)


def weight(df: Column, docs: int) -> Column:
    return F.floor(1000 * F.ln(F.lit(2.0 * docs + 2) / (2 * df + 1)))


def kth(sums: DataFrame, score: str, k: int) -> DataFrame:
    """(item, bound): the k-th best score of each item, 0 where it has fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score)))
    best = sums.select("item", score).withColumn("place", place).where(F.col("place") <= k)
    return best.groupBy("item").agg(F.when(F.count("*") >= k, F.min(score)).otherwise(0).cast("long").alias("bound"))


def _with(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(side) if small(side) else side, on, how)


def lists_of(docs: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored lists (term, row, x) in order of term and falling x; the terms (item, term, w, most, lists) that some document holds; the documents' (row, key)."""
    raw = stored(postings(docs, pairs.select("term").distinct(), key, text))
    keys = stored(raw.where(F.col("term") == ALL).select("row", "key"))
    total = raw.where(F.col("term") == ALL).agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    held = raw.where(F.col("term") != ALL).select("term", "row", impact(F.col("tf"), F.col("n"), total["n"], total["l"]).alias("x"))
    lists = stored(held.repartitionByRange("term", F.desc("x")).sortWithinPartitions("term", F.desc("x")))
    discard(raw)
    per = lists.groupBy("term").agg(F.count("*").alias("df"), F.max("x").alias("x"))
    weighed = per.select("term", weight(F.col("df"), total["n"]).alias("w"), "x").where("w * x > 0")
    found = pairs.join(weighed, "term").select("item", "term", "w", (F.col("w") * F.col("x")).alias("most"))
    return lists, stored(found.join(found.groupBy("item").agg(F.count("*").alias("lists")), "item")), keys


def thresholds(terms: DataFrame) -> DataFrame:
    """Adds `least`, the largest threshold, one for all lists of an item, below which what the lists hold sums up to less than `bound`.

    A list holds at most its `most`, so the small ones leave the others more: with the lists in order of `most`, the bound that is left
    after the smaller ones is shared by the rest, and the first share under its list's `most` counts.
    """
    order = Window.partitionBy("item").orderBy("most", "term")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("lists") - F.row_number().over(order) + 1
    share = terms.withColumn("share", F.floor((F.col("bound") - 1 - before) / left))
    level = share.groupBy("item").agg(F.max(F.when(F.col("share") < F.col("most"), F.col("share"))).alias("share"))
    return terms.join(level, "item").withColumn("least", F.greatest(F.lit(1).cast("long"), F.col("share") + 1)).drop("share")


def best(sums: DataFrame, score: str, k: int) -> DataFrame:
    """Rows among an item's k best, with those that tie with the last of them."""
    return sums.withColumn("place", F.rank().over(Window.partitionBy("item").orderBy(F.desc(score)))).where(F.col("place") <= k).drop("place")


def exact(lists: DataFrame, terms: DataFrame, some: DataFrame) -> DataFrame:
    """(item, row, score) of given pairs, looked up in the lists; `some` should be stored."""
    near = _with(lists, some.select("row").distinct(), ["row"], "left_semi")
    return some.join(terms.select("item", "term", "w"), "item").join(near, ["row", "term"]).groupBy("item", "row").agg(F.sum(F.col("w") * F.col("x")).alias("score"))


def candidates(lists: DataFrame, terms: DataFrame, k: int = TOP) -> DataFrame:
    """(item, row) whose upper bound reaches the item's lower one: rounds 1 and 2."""
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("x"), "row"))
    heads = lists.withColumn("place", place).where(F.col("place") <= k).drop("place")
    first = kth(_with(heads, terms, ["term"]).groupBy("item", "row").agg(F.sum(F.col("w") * F.col("x")).alias("sum")), "sum", k)
    limited = stored(thresholds(terms.join(first, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0).cast("long")))))
    # A list that does not send a document holds less than the threshold of it, and at most the list's largest part.
    short = F.least(F.col("least") - 1, F.col("most"))
    send = limited.select("item", "term", "w", short.alias("short"), F.expr("(least + w - 1) div w").alias("from")).where("w * `from` <= most")
    floors = send.groupBy("term").agg(F.min("from").alias("floor"))
    # What is sent moves once, a posting for all items that its term serves, to its document's partition, where items' sums need no other move.
    sent = _with(lists, floors, ["term"]).where("x >= floor").select("row", "term", "x").repartition("row")
    sums = _with(sent, send, ["term"]).where("x >= `from`").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("x")).alias("sum"), F.sum("short").alias("covered"))
    ends = stored(limited.groupBy("item").agg(F.max("bound").alias("before"), F.sum(short).alias("rest")))
    upper = F.col("sum") + F.col("rest") - F.col("covered")
    near = stored(_with(sums, ends, ["item"]).where(upper >= F.col("before")).select("item", "row", "sum", upper.alias("upper")))
    return _with(near, kth(near, "sum", k), ["item"]).where("upper >= bound").select("item", "row")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score) of the k best documents of every item."""
    names = stored(items.select(F.col(item).alias("name")).distinct().withColumn("item", F.monotonically_increasing_id()))
    lists, terms, keys = lists_of(docs, stored(item_terms(items, names, item, item_text)), key, text)
    some = stored(candidates(lists, terms, k))
    # Rows below the k-th score cannot rank, so few rows look their ids up.
    keyed = _with(keys, stored(best(exact(lists, terms, some).where("score > 0"), "score", k)), ["row"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key", "row"))
    ranked = keyed.withColumn("rank", rank).where(F.col("rank") <= k)
    return _with(ranked, names, ["item"]).select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score")


ORACLE_SQL = r"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
n AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY r, doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
p AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (r), c GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""
