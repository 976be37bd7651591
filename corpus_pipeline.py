"""A training-data pipeline from the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as Parquet and hands what it
reads back to the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import exact_dedup, mixing, ngram_join, packing, queries, toxicity
from tessera.llm.common import text_key, written

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, scores below one half.

    Null and empty texts get the score of the bias and stay unless most labels are toxic; a null doc_id is scored and never
    learned from; repeated rows stay as often as they come; an empty table gives none. Columns besides those of documents go.
    """
    docs = _documents(docs)
    model = toxicity.learn(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("toxicity < 0.5").drop("toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id.

    Texts that differ in white space alone are equal; a null text equals an empty one; null doc_ids come after all others; of
    rows with equal doc_id and text one stays, with any of their other values. Columns besides those of documents go.
    """
    docs = _documents(docs)
    return _rows_of(docs, exact_dedup.exact_groups(docs).where("kept").select("doc_id", "h"))


def _rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows with these doc_ids and keys (64 bits of hash over doc_id and text); of equal rows one."""
    docs = docs.withColumn("__key", text_key())
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    same = (F.col("__key") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["__key", "doc_id"]).drop("__key")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, a similarity of 0.8), the one with the smallest doc_id.

    Documents without words are like nothing and stay; null doc_ids come after all others; equal rows are near duplicates of
    each other. Columns besides those of documents go.
    """
    docs = _documents(docs)
    groups = written(ngram_join.similar_groups(docs, n=5, num=4, den=5), "groups")
    first = groups.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"))
    return _rows_of(docs, first.select("first.doc_id", "first.h").unionByName(groups.where("comp is null").select("doc_id", "h")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, shard by shard in the shards' own order.

    A null source is one of its own; documents without words have no weight and are drawn as their block is; equal rows are
    drawn alike. Columns besides those of documents go.
    """
    return _documents(mixing.mixed(_documents(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens.

    A null or empty text is its end id alone; null doc_ids and repeated rows are packed as often as they come.
    """
    return packing.pack(_documents(docs), queries.tokenizer_path(), capacity=2048, end_id=1).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_similar),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the draws and the tokenizer; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
