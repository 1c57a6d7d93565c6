"""Dense vectors: exact inner products, normalisation, prototypes, projections.

Queries are a stated batch; their matrix goes to the executors in blocks of a checked size
(`MOST_QUERY_BYTES`), and batches of vectors are multiplied with it where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import vocab
from rankweave.functions.text import let

MOST_QUERY_BYTES = 64 << 20
MOST_PRODUCTS = 1 << 16  # that a Python worker holds at a time
MOST_TERM_BYTES = 8 << 20  # of the terms whose weights are broadcast to postings


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector over its length; a zero vector stays zero."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(1e-9)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def blocks(queries: DataFrame, vector: str, most: int = MOST_QUERY_BYTES) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The other columns and the matrix of a query batch, in blocks of at most about `most` bytes, by a hash of the other columns."""
    size = queries.agg(F.sum(F.size(vector) * 8 + 64)).first()[0] or 0
    parts, others = max(1, -(-size // most)), [c for c in queries.columns if c != vector]
    for i in range(parts):
        held = (queries if parts == 1 else queries.where(F.pmod(F.xxhash64(*others), F.lit(parts)) == i)).toArrow()  # bounded
        if held.num_rows:
            yield held.select(others).combine_chunks(), np.array(held.column(vector).to_pylist(), float)


def _rows_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    return batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _kinds(queries: DataFrame, vectors: DataFrame, q: str) -> str:
    own = [f"`{n}` {t}" for n, t in queries.dtypes if n != q]
    return ", ".join([*own, f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}", "score double"])


def _clipped(x: np.ndarray) -> np.ndarray:
    """As clipped(): NaN counts as the largest number."""
    return np.where(np.isnan(x), 1.0, np.clip(x, 0.0, 1.0)) + 0.0


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """To the nearest, halves away from zero, as SQL rounds."""
    y = x * 10.0**places
    whole = np.trunc(y)
    return (whole + np.sign(y) * (np.abs(y - whole) >= 0.5)) / 10.0**places


def products(batches: Iterator[pa.RecordBatch], own: pa.Table, asked: np.ndarray, k: int | None, places: int | None, clip: bool) -> Iterator[pa.RecordBatch]:
    """(query columns, doc_id, score) of batches (doc_id, vec) with all queries or the k best of each; about `MOST_PRODUCTS` are held at a time, however many queries there are."""
    names = [*own.column_names, "doc_id", "score"]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, rows = _rows_of(batch)
        step = max(1, MOST_PRODUCTS // len(ids))
        for first in range(0, len(asked), step):
            found = (rows @ asked[first : first + step].T).T
            if clip:
                found = _clipped(found)
            if places is not None:
                found = _rounded(found, places)
            if k is None:
                at = np.tile(np.arange(len(ids)), len(found))
            else:
                best = [np.lexsort((ids.to_numpy(zero_copy_only=False), -x))[:k] for x in found]
                at, found = np.concatenate(best), np.array([x[b] for x, b in zip(found, best, strict=True)])
            named = own.take(pa.array(np.repeat(np.arange(first, first + len(found)), found.shape[1]))).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[c.chunk(0) for c in named.columns], ids.take(pa.array(at)), pa.array(np.ascontiguousarray(found).ravel())], names)


def _multiplied(queries: DataFrame, vectors: DataFrame, q: str, v: str, k: int | None, places: int | None, most: int, clip: bool = False, each: int | None = None) -> DataFrame:
    """(query columns, doc_id, score) of all pairs, or of the k best of each query in each batch of vectors."""
    kinds, out, n = _kinds(queries, vectors, q), None, None
    for names, matrix in blocks(queries, q, most):
        shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return products(batches, *shared.value, k, places, clip)

        held = vectors.where(F.size(v) == matrix.shape[1]).select("doc_id", v)
        if each is not None:
            n = held.count() if n is None else n
            tasks = -(-n * len(matrix) // each)
            held = held.repartition(tasks) if tasks > 1 else held
        part = held.mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], kinds) if out is None else out


def scores(queries: DataFrame, vectors: DataFrame, q: str = "qvec", v: str = "vec", most: int = MOST_QUERY_BYTES, places: int | None = None, clip: bool = False, each: int | None = None) -> DataFrame:
    """(query columns, doc_id, score): inner product of each query with each vector, aligned by id; cut to 0..1 and rounded where asked.

    Vectors of another length than the queries' are left out. Rows stay where they are; with `each`, where queries grow with the
    vectors, these are dealt to tasks of about so many pairs.
    """
    return _multiplied(queries, vectors, q, v, None, places, most, clip, each)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, q: str = "qvec", v: str = "vec", places: int = 6, most: int = MOST_QUERY_BYTES, clip: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): the k vectors of the largest inner product, cut to 0..1 where asked, with each query (qid, qvec); ties by id.

    Batches of vectors pass on their own k best, so few rows move for the final ranks.
    """
    found = _multiplied(queries.select("qid", q), vectors, q, v, k, places, most, clip)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def weighted_query(queries: DataFrame, keys: list[str], weight: str = "w", q: str = "qvec") -> DataFrame:
    """(keys, qvec): the mean of a query's variants by weight. Its product with a vector is the weighted mean of theirs."""
    listed = queries.groupBy(*keys).agg(F.collect_list(F.struct(F.col(weight).cast("double").alias("w"), F.col(q).alias("x"))).alias("_l"), F.sum(weight).alias("_w"))
    zero = F.transform(F.get("_l", F.lit(0))["x"], lambda x: F.lit(0.0))
    total = F.aggregate("_l", zero, lambda acc, s: F.zip_with(acc, s["x"], lambda a, x: a + s["w"] * x.cast("double")))
    return listed.select(*keys, F.transform(total, lambda x: x / F.col("_w")).alias(q))


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def weighted_mean(parts: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """Mean of a document's scores over query variants by weight, cut to 0..1."""
    mean = F.sum(F.col(weight) * F.col("score")) / F.sum(weight)
    return parts.groupBy(*keys, "doc_id").agg(clipped(mean).alias("score"))


def centroids(vectors: DataFrame, label: str, v: str = "vec") -> DataFrame:
    """(label, centroid): mean vector of each label; sums are combined on the map side."""
    parts = vectors.select(label, F.posexplode(v).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = parts.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("l"))
    return listed.select(label, F.transform("l", lambda s: s["m"]).alias("centroid"))


def nearest_prototype(vectors: DataFrame, prototypes: DataFrame, label: str, v: str = "vec", most: int = MOST_QUERY_BYTES) -> DataFrame:
    """(doc_id, label, score): the prototype of the largest inner product, negative ones as 0; ties by label."""
    kind = prototypes.schema[label].dataType.simpleString()
    kinds, out, n = f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}, label {kind}, score double", None, 0
    for names, matrix in blocks(prototypes.select(label, "centroid").orderBy(label), "centroid", most):
        shared = vectors.sparkSession.sparkContext.broadcast((names.column(0).combine_chunks(), matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            labels, asked = shared.value
            order = np.argsort(np.array(labels.to_pylist()), kind="stable")
            for batch in batches:
                ids, rows = _rows_of(batch)
                found = np.maximum(rows @ asked[order].T, 0.0)
                best = found.argmax(1)
                yield pa.RecordBatch.from_arrays([ids, labels.take(pa.array(order[best])), pa.array(found[np.arange(len(best)), best])], ["doc_id", "label", "score"])

        part = vectors.where(F.size(v) == matrix.shape[1]).select("doc_id", v).mapInArrow(run, kinds)
        out, n = part if out is None else out.unionByName(part), n + 1
    if out is None:
        return vectors.sparkSession.createDataFrame([], kinds)
    if n == 1:
        return out
    return out.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "label")).alias("m")).select("doc_id", "m.label", (-F.col("m.less")).alias("score"))


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray] | None, prefix: str = "", out: str = "vec") -> DataFrame:
    """Vectors of texts by an injected encoder, in Arrow batches, each of unit length. Queries pass a prefix, documents none.

    Without an encoder this fails: made-up vectors would give made-up ranks.
    """
    if encoder is None:
        raise ValueError("no encoder is given; hashed_projection or latent_vectors need none")

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.asarray(encoder([prefix + (t or "") for t in texts]), dtype=float)
            yield pd.Series(list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)))

    return df.withColumn(out, run(F.col(text)))


def _frequent(terms: DataFrame, most: int) -> int:
    """The least document frequency from which on terms take at most `most` bytes, by sums of levels of frequencies."""
    sizes = F.sum(F.octet_length("term").cast("long") + 32).alias("size")
    levels = terms.groupBy(F.floor(F.log2("df") * 8).alias("level")).agg(sizes, F.min("df").alias("least"), F.max("df").alias("top")).orderBy(F.desc("level")).collect()
    least, size = (levels[0]["top"] + 1 if levels else 1), 0
    for r in levels:
        size += r["size"]
        if size > most:
            break
        least = r["least"]
    return least


def hashed_projection(post: DataFrame, terms: DataFrame, dimensions: int = 384, most: int = MOST_TERM_BYTES, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(doc_id, vec): tf·idf rows under a random sign projection that is drawn from hashes, without an encoder.

    Postings stay where they are (dealt by document): the weights of the most frequent terms, `most` bytes of them, are broadcast
    to them. Only postings of rarer terms move, to their weight and back to their document. `store` may keep the terms, which are
    read a few times.
    """
    sign = F.when(F.xxhash64("term", F.lit(2)) % 2 == 0, 1.0).otherwise(-1.0)
    lane = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(dimensions)).cast("int")
    weights = store(terms.select("term", "df", lane.alias("i"), (F.col("idf") * sign).alias("w")))
    least = _frequent(weights, most)
    held = lambda own: own.select("doc_id", "i", (F.col("tf") * F.col("w")).alias("x"))
    known = post.select("doc_id", "term", "tf").join(F.broadcast(weights.where(F.col("df") >= least).select("term", "i", "w")), "term", "left")
    parts = held(known.where(F.col("i").isNotNull()))
    if least > 1:
        rare = known.where(F.col("i").isNull()).select("doc_id", "term", "tf").join(weights.where(F.col("df") < least), "term")
        parts = parts.unionByName(held(rare).repartition(post.rdd.getNumPartitions(), "doc_id"))
    lanes = parts.groupBy("doc_id", "i").agg(F.sum("x").alias("x"))
    listed = lanes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("l"))
    return listed.select("doc_id", unit(_filled("l", dimensions)).alias("vec"))


def _filled(lanes: str, dimensions: int) -> Column:
    """All lanes of a vector from those that it has, (i, x) by i: zeros between them, without a search for each lane."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = lambda k: F.coalesce(F.get(F.col(lanes), k - 1)["i"], F.lit(-1))
    return F.concat(F.flatten(F.transform(lanes, lambda s, k: F.concat(zeros(s["i"] - before(k) - 1), F.array(s["x"])))), zeros(F.lit(dimensions - 1) - before(F.size(lanes))))


def latent_vectors(docs: DataFrame, key: str, tokens: Column, k: int = 256, least: int = 2, most: float = 0.95, features: int = 1 << 15) -> DataFrame:
    """(doc_id, vec): latent semantic vectors of 1- and 2-grams (sublinear tf·idf, truncated SVD, unit length).

    The `features` most frequent grams count (a documented bound: the SVD holds features squared numbers). Ids
    may be of any type. The SVD is Spark's own, which takes and gives rows as an RDD.
    """
    from pyspark.ml.feature import IDF, CountVectorizer, NGram
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    names = docs.select(F.col(key).alias("own"), F.xxhash64(key).alias("doc_id"))
    words = docs.select(F.xxhash64(key).alias("doc_id"), tokens.alias("one"))
    grams = NGram(n=2, inputCol="one", outputCol="two").transform(words).select("doc_id", F.concat("one", "two").alias("grams"))
    counted = CountVectorizer(inputCol="grams", outputCol="tf", minDF=least, maxDF=most, vocabSize=features).fit(grams).transform(grams)
    damped = counted.select("doc_id", array_to_vector(F.transform(vector_to_array("tf"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))).alias("tf"))
    weighted = IDF(inputCol="tf", outputCol="x").fit(damped).transform(damped).select("doc_id", vector_to_array("x").alias("x"))
    rows = weighted.rdd.map(lambda r: IndexedRow(r["doc_id"], r["x"]))
    found = IndexedRowMatrix(rows).computeSVD(k, computeU=True)
    s = found.s.toArray()
    out = found.U.rows.map(lambda r: (int(r.index), (r.vector.toArray() * s).tolist())).toDF("doc_id long, vec array<double>")
    return out.join(names, "doc_id").select(F.col("own").alias("doc_id"), unit(F.col("vec")).alias("vec"))


def variant_weights(queries: DataFrame) -> DataFrame:
    """Adds w from `strategy`."""
    out = None
    for name, w in vocab.STRATEGY_WEIGHTS.items():
        out = F.when(F.col("strategy") == name, w) if out is None else out.when(F.col("strategy") == name, w)
    return queries.withColumn("w", out.otherwise(vocab.OTHER_STRATEGY))
