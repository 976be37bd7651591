"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``near`` nearest pivots in order, of ``pivots`` distinct vectors from a bounded sample. Pivots have
inverted files: the vectors that have a pivot among their nearest, with its place. Two orders are compared by Spearman's footrule over
the pivots of either, one that is not there taking the place after the last; it is added up from the files of the query's pivots
alone, as what other pivots add follows from the number of places. The vectors of smallest footrule are reranked by their distance.

Vectors are dealt into shards of ``SHARD_BYTES``, whatever their content, and each shard has its own inverted files and ranks its own vectors,
so that candidates never cross the network; a query goes once to each shard of its width, and each sends back its ``k`` nearest. A
worker holds one shard and reads the queries one batch after the other. Equal vectors of a shard are one entry with their first ids,
so copies take no candidate's place from others; of ``k + 1`` ids more cannot be nearest.

Each query reranks ``share`` of a shard's entries, ``LEAST`` at least: unlike a fixed number this keeps recall at any size, also
where vectors have no structure (uniform on a sphere of 64 dimensions, where nothing but a large share helps).

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates. Vectors of
another length than a query's are no candidates. Null ids are no queries and come after all others of equal distance. Of rows with equal ids each is a query and
a candidate of its own; a query's own row alone is left out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, packed, runs, written

#: Pivots of each width and how many of them represent a vector; rows that pivots are chosen from, about.
PIVOTS, NEAR, SAMPLE = 256, 64, 4096
#: Part of a shard's entries that a query reranks, and how many at least.
SHARE, LEAST = 0.1, 200
#: Bytes of vectors in a shard, about; rows in a shard at least, where there are few.
SHARD_BYTES, SHARD_ROWS = 64_000_000, 1000
#: Entries in a row of the index.
ROW = 4096
INDEX = "dim int, shard int, kind int, key int, a binary, b binary, c binary"
FOUND = "row long, query_id long, vec_id long, score double"


def orders(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the first pivot."""
    out = np.empty((len(x), min(near, len(pivots))), np.uint16)
    with np.errstate(over="ignore", invalid="ignore"):
        size = (pivots * pivots).sum(1)
        for lo in range(0, len(x), ROW):
            d = np.nan_to_num(size - 2 * (x[lo : lo + ROW] @ pivots.T), nan=np.inf)
            out[lo : lo + ROW] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        d = x - query
        return np.sqrt((d * d).sum(1))


def entries(x: np.ndarray, ids: np.ndarray, none: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, where each one's ids begin (one bound more than rows), and the first ``most`` ids of each with whether they are null."""
    x = np.ascontiguousarray(x + 0.0)  # no negative zeros
    whole = x.view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    order = np.lexsort((ids, none, which))
    at, n = runs(which[order])
    place = np.arange(len(order)) - np.repeat(at, n)
    keep = order[place < most]
    return x[first], np.r_[0, np.cumsum(np.minimum(n, most))], ids[keep], none[keep]


class Shard:
    """The entries of a shard and its inverted files."""

    def __init__(self, dim: int, rows: list[dict], k: int, share: float):
        blocks = [r for r in rows if r["kind"] == 0]
        self.x = np.concatenate([np.frombuffer(r["a"], np.float64).reshape(-1, dim) for r in blocks])
        pairs = np.concatenate([np.frombuffer(r["b"], np.int64).reshape(-1, 2) for r in blocks])
        self.ids, self.none = pairs[:, 0], pairs[:, 1] == 1
        self.bounds = np.r_[0, np.cumsum(np.concatenate([np.frombuffer(r["c"], np.int64) for r in blocks]))]
        self.files = {r["key"]: (np.frombuffer(r["a"], np.uint32), np.frombuffer(r["b"], np.uint16).astype(np.int64)) for r in rows if r["kind"] == 1}
        self.k, self.most = k, max(LEAST, int(np.ceil(share * len(self.x))))

    def nearest(self, query: np.ndarray, order: np.ndarray, own: int | None) -> list[tuple]:
        """(score, id is null, id) of the ``k`` nearest candidates; one of the ids ``own`` of an equal vector is left out."""
        near, none = len(order), (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if self.most < len(self.x):
            files = [self.files.get(p, none) for p in order.tolist()]
            place = np.concatenate([f[1] for f in files])
            mine = np.repeat(np.arange(near), [len(f[0]) for f in files])
            less = np.abs(place - mine) - (near - mine) - (near - place)  # against a pivot that neither has
            rule = np.bincount(np.concatenate([f[0] for f in files]), weights=less, minlength=len(self.x))
            cut = np.partition(rule, self.most - 1)[self.most - 1]
            at = np.flatnonzero(rule <= cut)  # ties of the last one as well
        else:
            at = np.arange(len(self.x))
        d = distances(self.x[at], query)
        if len(d) > self.k + 1:
            within = d <= np.partition(d, self.k)[self.k]
            at, d = at[within], d[within]
        out = []
        for score, e in sorted(zip(d.tolist(), at.tolist(), strict=True)):
            mine = [(score, bool(n), int(i)) for i, n in zip(self.ids[self.bounds[e] : self.bounds[e + 1]], self.none[self.bounds[e] : self.bounds[e + 1]], strict=True)]
            if own is not None and (self.x[e] == query).all() and (score, False, own) in mine:
                mine.remove((score, False, own))
            out += mine
        return sorted(out)[: self.k]


def _good(rows: DataFrame) -> Column:
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists("e", lambda v: v != 0)
    return F.coalesce(finite, F.lit(False))


def _pivots(rows: DataFrame, counts: dict[int, int], pivots: int) -> dict[int, np.ndarray]:
    """Distinct vectors of each width from about ``SAMPLE`` rows, taken by a hash of id and vector, so reruns agree."""
    unit = 1 << 30
    below = F.create_map(*[F.lit(v) for d, n in counts.items() for v in (d, min(int(2 * SAMPLE / n * unit) + 1, unit))])
    h = F.xxhash64("vec_id", "e")
    taken = rows.withColumn("h", h).where(F.pmod("h", F.lit(unit)) < below[F.col("dim")]).select("dim", "h", "e").collect()
    out: dict[int, np.ndarray] = {}
    for dim in counts:
        mine = sorted((r.h, tuple(r.e)) for r in taken if r.dim == dim)
        out[dim] = np.array(list(dict.fromkeys(e for _, e in mine))[:pivots])
    return out


def prepared(vectors: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Vectors that take part (vec_id, e, row, dim, shard) and the number of shards of each width."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = written(rows.where(_good(rows)).withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("e")), "vectors")
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows, {d: max(-(-n * d * 8 // SHARD_BYTES), min(p, -(-n // SHARD_ROWS))) for d, n in counts.items()}


def _shard(shards: dict[int, int]) -> Column:
    """A row's shard of its width, whatever its content."""
    many = F.create_map(*[F.lit(int(v)) for pair in shards.items() for v in pair])
    return F.pmod(F.xxhash64("row"), many[F.col("dim")]).cast("int")


def built(rows: DataFrame, shards: dict[int, int], model: dict[int, np.ndarray], k: int, near: int = NEAR) -> DataFrame:
    """The index (``INDEX``): kind 0, entries (a: vectors, b: ids and whether they are null, c: ids of each entry); kind 1, a pivot's inverted file (a: entries, b: places)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # PIVOTS vectors of each width

    def f(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        x = table["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids = table["vec_id"].combine_chunks()
        x, bounds, ids, none = entries(x, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), k + 1)
        order = orders(x, shared.value[dim], near)
        at = np.r_[np.arange(0, len(x), ROW), len(x)]
        pairs = np.stack([ids, none.astype(np.int64)], 1)
        post = np.argsort(order.ravel(), kind="stable")
        pivot, n = runs(order.ravel()[post])
        ends = np.r_[pivot, len(post)]
        first = pa.table({"key": at[:-1].astype(np.int32), "kind": np.zeros(len(at) - 1, np.int32), "a": packed(x.ravel(), at * dim), "b": packed(pairs.ravel(), bounds[at] * 2), "c": packed(np.diff(bounds), at)})
        files = pa.table({"key": order.ravel()[post][pivot].astype(np.int32), "kind": np.ones(len(pivot), np.int32), "a": packed((post // order.shape[1]).astype(np.uint32), ends), "b": packed((post % order.shape[1]).astype(np.uint16), ends), "c": pa.nulls(len(pivot), pa.binary())})
        out = pa.concat_tables([first, files])
        for name, v in (("shard", shard), ("dim", dim)):
            out = out.append_column(name, pa.array(np.full(len(out), v, np.int32)))
        return out.select(["dim", "shard", "kind", "key", "a", "b", "c"])

    return written(rows.withColumn("shard", _shard(shards)).groupBy("dim", "shard").applyInArrow(f, INDEX), "index")


def _ordered(model: dict[int, np.ndarray], near: int):
    def f(batches: Batches) -> Batches:
        for b in batches:
            vecs, size = b.column(2), b.column(3).to_numpy()
            at = np.r_[0, np.cumsum(size)]
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            parts = [flat[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            marks = [orders(x[None], model[len(x)], near)[0].tobytes() for x in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in parts], pa.binary()), b.column(3), b.column(4), pa.array(marks, pa.binary())], ["row", "query_id", "e", "dim", "own", "marks"])

    return f


def _searched(k: int, share: float):
    def f(batches: Batches) -> Batches:
        def rows() -> Iterator[dict]:
            for b in batches:
                yield from b.to_pylist()

        out: list[tuple] = []
        for (dim, _), same in groupby(rows(), key=lambda r: (r["dim"], r["shard"])):
            shard, index = None, []
            for r in same:  # the index first, then queries
                if r["kind"] < 2:
                    index.append(r)
                    continue
                if shard is None:
                    shard, index = Shard(dim, index, k, share), []
                query, order = np.frombuffer(r["a"], np.float64), np.frombuffer(r["b"], np.uint16)
                got = shard.nearest(query + 0.0, order, r["query_id"] if r["own"] else None)
                out += [(r["row"], r["query_id"], None if none else i, score) for score, none, i in got]
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["row", "query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: Column, k: int = 10, pivots: int = PIVOTS, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """The ``k`` nearest found for each row that the condition ``queries`` (on vec_id) names: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows, shards = prepared(vectors)
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = _pivots(rows, {d: n for d, n in ((r["dim"], r["count"]) for r in rows.groupBy("dim").count().collect())}, pivots)
    index = built(rows, shards, model, k, near)
    own = rows.where(F.coalesce(queries, F.lit(False))).withColumn("own", _shard(shards))
    asked = own.select("row", F.col("vec_id").alias("query_id"), "e", "dim", "own").mapInArrow(_ordered(model, near), "row long, query_id long, e binary, dim int, own int, marks binary")
    many = F.create_map(*[F.lit(int(v)) for pair in shards.items() for v in pair])
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), many[F.col("dim")] - 1)))
    cols = ["dim", "shard", "kind", "key", "a", "b", "row", "query_id", "own"]
    sent = sent.select("dim", "shard", F.lit(2).alias("kind"), F.lit(0).alias("key"), F.col("e").alias("a"), F.col("marks").alias("b"), F.lit(None).cast("binary").alias("c"), "row", "query_id", (F.col("own") == F.col("shard")).alias("own"))
    none = F.lit(None)
    both = index.withColumn("row", none.cast("long")).withColumn("query_id", none.cast("long")).withColumn("own", none.cast("boolean")).unionByName(sent)
    p = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(shards.values()))
    found = both.repartition(p, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "key").select(*cols[:6], "c", *cols[6:]).mapInArrow(_searched(k, share), FOUND)
    best = Window.partitionBy("row").orderBy("score", F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
