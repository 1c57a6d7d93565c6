"""A corpus pipeline of five stages over `documents`: run() applies them, STAGES lists them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `documents`. Between stages, run() writes Parquet in the session's shared folder, and deletes what
no later stage reads. Columns that a stage does not use travel in one struct, so their names are free.

Defined cases: null and empty texts, and those without a letter, go at language ID; an empty table gives an empty
result; repeated rows are one class of near-duplicates; a missing label teaches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import bpe, langid, line_dedup, mixing, simhash
from rankweave.llm.common import discard, hash_fraction, stored, table, train_split
from rankweave.llm.queries import VOCABULARY

LEAST_SCORE = 0.2


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language in particular, go."""
    model = langid.train(docs, usable=train_split(F.col("doc_id")))
    found = langid.identified(_packed(docs), model, "text")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("own.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go; documents stay, and n_chars follows the text."""
    shown = F.when(F.col("n_dropped") > 0, F.length("shown")).otherwise(F.col("own.n_chars")) if "n_chars" in docs.columns else None
    as_before = {"text": F.col("shown"), "n_chars": shown}
    kind = {f.name: f.dataType for f in docs.schema}
    return line_dedup.without_repeats(docs).select(*[(as_before[c].cast(kind[c]) if c in as_before else F.col(f"own.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id, then text hash, stays, once."""
    keep = simhash.survivors(docs).select(F.col("key").alias("_key"), F.col("row").alias("_row"), "copies")
    left = _packed(docs).join(keep, F.col("own.doc_id").eqNullSafe(F.col("_key")) & (F.xxhash64("own.text") == F.col("_row")))
    # Only rows that share id and text with others need to meet to become one.
    once, more = left.where("copies = 1").select("own"), left.where("copies > 1").dropDuplicates(["_key", "_row"]).select("own")
    return once.unionByName(more).select("own.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays with the probability of its rate, by a hash of its id. No document stays more than once, so rates end at 1."""
    labels = table(spark, sf_dir, "labels")
    domains = labels.select("doc_id", mixing.label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    mixed = mixing.mix(docs, domains, most=1.0)
    gone = mixed.where(F.col("rate") + hash_fraction(F.col("key"), 909) < 1).select(F.col("key").alias("_key"), F.col("row").alias("_row"))
    left = _packed(docs).join(gone, F.col("own.doc_id").eqNullSafe(F.col("_key")) & (F.xxhash64("own.text") == F.col("_row")), "left_anti")
    return left.select("own.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, VOCABULARY)


STAGES = [("language ID", language_id), ("line dedup", line_dedup_stage), ("SimHash near-dedup", near_dedup), ("mixing", mix_sources), ("BPE", tokenise)]

#: Classifiers, fingerprints and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if before is not first:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
