"""Importance resampling towards a target distribution by hashed n-grams, with an external sort-count.

1. Each document's features (runs of one and two words) become buckets, unsigned 16-bit numbers. They are written as packed streams,
   one for a slice of documents, beside the documents' ids and lengths (their offsets): texts are read once.
2. Streams are sorted and run-length encoded; runs are summed by bucket. What reaches the driver is a number for each bucket,
   of which there are ``buckets``, at most 65536, whatever the corpus holds.
3. Gains by bucket are gathered along each stream and summed for each document with ``np.add.reduceat``.
4. Scores get a Gumbel number from a hash of the seed and the doc_id, so the highest scores are a draw without replacement by
   importance, and reruns agree. Ranks come from a range partitioning by score: no task sees all scores.

Defined results: a null text has no features and a weight of 0; it counts as a document without words. A null doc_id is hashed as
an empty string and comes after all others among equal scores. Repeated rows are documents of their own. Without any feature in a table its
counts are 0. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checksums
from .common import Batches, Texts, left_in_text, numbered, runs, slices, written

#: Bytes that end a word: all of ASCII but digits and letters.
GAPS = np.zeros(256, bool)
GAPS[:128] = True
GAPS[48:58] = GAPS[65:91] = GAPS[97:123] = False
STREAMS = "doc_ids array<long>, n_words array<long>, n_features array<long>, stream binary"
#: Buckets of streams that a worker sorts together, about.
SORTED = 4_000_000


def features(t: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, text by text, and how many each text has: one for each word and one for each pair of neighbours."""
    n = t.counts
    size = np.where(n > 0, 2 * n - 1, 0)
    base = (np.cumsum(size) - size)[t.doc_of_word()]
    place = base + np.arange(len(t.starts)) - t.first[t.doc_of_word()]
    out = np.empty(int(size.sum()), np.uint16)
    crc = checksums.of_words(t)
    out[place] = crc % np.uint32(buckets)
    first = np.flatnonzero(left_in_text(t) > 1)
    out[place[first] + n[t.doc_of_word()[first]]] = checksums.of_pairs(t, crc, first) % np.uint32(buckets)
    return out, size


def streams(texts: DataFrame, buckets: int) -> DataFrame:
    """Packed streams (``STREAMS``) of a table (doc_id, text)."""

    def f(batches: Batches) -> Batches:
        for b in (part for batch in batches for part in slices(batch, 1)):
            t = Texts(b.column(1), lower=True, gaps=GAPS)
            stream, size = features(t, buckets)
            each = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c) for c in (b.column(0), pa.array(t.counts.astype(np.int64)), pa.array(size.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([*each, pa.array([stream.tobytes()], pa.binary())], ["doc_ids", "n_words", "n_features", "stream"])

    return texts.mapInArrow(f, STREAMS)


def _counted(packed: DataFrame) -> DataFrame:
    """(bucket, n): how many features each bucket has."""

    def run_lengths(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(parts), kind="stable")  # a radix sort for 16-bit numbers
        at, n = runs(x)
        return pa.RecordBatch.from_arrays([pa.array(x[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["bucket", "n"])

    def f(batches: Batches) -> Batches:
        held, size = [], 0
        for b in batches:
            for v in b.column(0):
                held.append(np.frombuffer(v.as_buffer(), np.uint16))
                size += len(held[-1])
                if size >= SORTED:
                    yield run_lengths(held)
                    held, size = [], 0
        if size:
            yield run_lengths(held)

    return packed.select("stream").mapInArrow(f, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(packed: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target has each bucket, with one added to each count."""
    spark = packed.sparkSession
    counts = _counted(packed).withColumnRenamed("n", "s").join(_counted(target).withColumnRenamed("n", "t"), "bucket", "full")
    all_ = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["s", "t"])
    s, t = np.array(sorted(tuple(r) for r in all_.collect()), np.float64).reshape(-1, 3)[:, 1:].T  # a row for each bucket
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features."""
    shared = packed.sparkSession.sparkContext.broadcast(gain)

    def f(batches: Batches) -> Batches:
        for b in batches:
            for row in range(b.num_rows):
                ids, words, size = (b.column(i).slice(row, 1).flatten() for i in range(3))
                n = size.to_numpy()
                some = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(some):
                    mine = shared.value[np.frombuffer(b.column(3)[row].as_buffer(), np.uint16)]
                    weight[some] = np.add.reduceat(mine, (np.cumsum(n) - n)[some]) // n[some]
                yield pa.RecordBatch.from_arrays([ids, words, size, pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(f, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number from a hash of the seed and the id, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (of the drawn ones, else null).

    ``percent`` of the documents with ``least_words`` words or more are drawn, those of the highest scores, ties to the smaller
    doc_id. ``target`` holds the texts (column text) whose distribution the draw is to have.
    """
    if not 0 < buckets <= 65536:
        raise ValueError("buckets are unsigned 16-bit numbers")
    text = F.col("text").cast("string").alias("text")
    packed = written(streams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), buckets), "streams")
    wanted = written(streams(target.select(F.lit(None).cast("long").alias("doc_id"), text), buckets), "target")
    scored = _weighed(packed, gains(packed, wanted, buckets)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored, "scores")
    long = F.col("n_words") >= least_words
    eligible = numbered(scored.where(long), [F.desc("score"), F.asc_nulls_last("doc_id")])
    ranked = eligible.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("idx") < F.floor(F.col("n") * percent / 100), F.col("idx") + 1).alias("rank"))
    return ranked.unionByName(scored.where(~long).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of documents that were drawn, with their rank; doc_ids should be unique."""
    return docs.join(ranked.where("rank is not null").select("doc_id", "rank"), "doc_id")
