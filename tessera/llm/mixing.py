"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources, in code-point order with null last, weigh ``weights`` in turn and share ``share`` of all words;
a target stops at ``most`` times its source's words and the excess is shared again by weight.

Each source is dealt into at most ``blocks`` blocks by a hash of its rows, and a seeded permutation orders them.
A source's quota of blocks is exact: whole passes over it, then blocks in permuted order while the middle of the
block is within what the target still lacks, so the error is half a block at most. The quotas of all sources are
then split among the output shards by a tree: at each node a multivariate-hypergeometric draw says how many of
each source's blocks go left, down to the shards. A shard takes disjoint runs of the permuted blocks, and its rows
are shuffled by a hash within the shard alone.

Only counts by source (one row for each) reach the driver. What a block is drawn for is worked out in the table of
blocks, so rows meet it in one join by (source, block): a source with a third of all rows is in as many places as it has
blocks. Both tables are broadcast only up to ``SENT`` values. A reread or a rerun gives the same draws, as everything
depends on hashes of rows and on the seed.

A draw from at least ``LARGE`` blocks halves the sources until each half is below; how many go to a half is then a
hypergeometric number by its binomial or normal limit (exact to about one part in the square root of ``LARGE``). Quotas
and shards' sizes are exact at any size.

Defined results: a null text has no words. Sources without words get target 0. Repeated rows are drawn alike.
Other columns are kept where rows are returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, Texts, slices, text_key, written


#: Names of columns that come and go while rows are drawn.
KEY, DRAW, SIZE, TARGET = "__mix_key", "__mix_draw", "__mix_size", "__mix_target"
#: Rows of the table of blocks, and values of the table of sources, up to which these go whole to every executor.
SENT = 1 << 18
#: Blocks from which a draw is not made by the library's exact sampler, which takes no more.
LARGE = 10**9
#: Bytes of a part of a shard, about, and of a word.
PART_BYTES, WORD_BYTES = 256_000_000, 7


def targets(words: list[int], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Target words of each source, in the order of sources."""
    w = np.array([weights[i % len(weights)] for i in range(len(words))], float)
    cap = most * np.array(words, float)
    left, out, free = share * float(sum(words)), np.zeros(len(words)), cap > 0
    while free.any():
        part = left * w / w[free].sum()
        over = free & (part >= cap)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        free &= ~over
    return out.tolist()


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones are among n drawn without replacement."""
    total, few = good + bad, min(good, bad)
    if max(good, bad) < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    if few < 1_000_000:  # each of the few is drawn or not, almost independently
        x = int(rng.binomial(few, n / total))
        x = x if few == good else n - x
    else:
        x = round(rng.normal(n * (good / total), (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5))
    return min(max(x, n - bad, 0), n, good)


def _drawn(rng: np.random.Generator, q: np.ndarray, n: int) -> np.ndarray:
    """How many of n blocks, drawn without replacement, come from each source: multivariate hypergeometric."""
    if int(q.sum()) < LARGE:
        return rng.multivariate_hypergeometric(q, n, method="marginals") if len(q) else q
    if len(q) == 1:
        return np.array([n], np.int64)
    mid = len(q) // 2
    left = _hypergeometric(rng, int(q[:mid].sum()), int(q[mid:].sum()), n)
    return np.r_[_drawn(rng, q[:mid], left), _drawn(rng, q[mid:], n - left)]


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas (by source) split among shards: an array (shards, sources) whose columns sum to the quotas."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        left = _drawn(rng, q, int(q.sum()) * (mid - lo) // (hi - lo))
        node(lo, mid, left)
        node(mid, hi, q - left)

    if len(quotas):
        node(0, shards, quotas)
    return out


def _sizes(batches: Batches) -> Batches:
    for b in (part for batch in batches for part in slices(batch, 3)):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(Texts(b.column(3)).counts.astype(np.int64))], ["doc_id", "source", "h", "size"])


def _dealing(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, blocks: int, shards: int, seed: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows (doc_id, source, h, size), and what adds SIZE, TARGET and DRAW to rows with a source and KEY."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_key().alias("h"), F.col("text").cast("string").alias("text"))
    sized = written(keyed.mapInArrow(_sizes, "doc_id long, source string, h long, size long"), "sizes")
    block = lambda h: F.pmod(F.xxhash64(F.lit(seed), F.col(h)), F.lit(blocks))
    table = sized.withColumn("block", block("h")).groupBy("source", "block").agg(F.sum("size").alias("words"))
    table = table.withColumn("order", F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("block")))
    over = W.partitionBy("source").orderBy("order", "block")
    table = written(table.withColumn("rank", F.row_number().over(over) - 1).withColumn("upto", F.sum("words").over(over)).drop("order"), "blocks")
    sources = sorted(table.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.words for r in sources], weights, share, most)
    passes = [int(t // r.words) if r.words else 0 for t, r in zip(goal, sources, strict=True)]
    need = [t - p * r.words for t, p, r in zip(goal, passes, sources, strict=True)]
    names = pa.array([r.source for r in sources], pa.string())
    n = np.array([r.n for r in sources], np.int64)

    def by_source(width: int, **columns) -> DataFrame:
        df = spark.createDataFrame(pa.table({"__mix_s": names, **columns}))
        return F.broadcast(df) if len(sources) * width <= SENT else df

    lack = by_source(1, lack=pa.array(need, pa.float64()))
    cut = table.join(lack, table["source"].eqNullSafe(lack["__mix_s"])).where((F.col("lack") > 0) & (F.col("upto") - F.col("words") / 2 <= F.col("lack")))
    cuts = {r.source: r.k for r in cut.groupBy("source").agg(F.count("*").alias("k")).collect()}
    quota = np.array([p * r.n + cuts.get(r.source, 0) for r, p in zip(sources, passes, strict=True)], np.int64)
    ends = np.cumsum(split(quota, shards, seed), axis=0)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sources) + 1) * shards, pa.int32()), pa.array(ends.T.ravel()))
    plan = by_source(shards, __mix_n=pa.array(n), __mix_quota=pa.array(quota), __mix_ends=lists, **{SIZE: pa.array([r.words for r in sources], pa.int64()), TARGET: pa.array(goal, pa.float64())})
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(np.ceil(most)))), lambda i: F.struct(i.alias("pass"), (F.col("rank") + i * F.col("__mix_n")).alias("draw"))), lambda x: x["draw"] < F.col("__mix_quota"))
    shard = F.transform(copies, lambda x: F.struct(x["pass"].alias("pass"), F.size(F.filter("__mix_ends", lambda e: e <= x["draw"])).alias("shard")))
    of_block = table.join(plan, table["source"].eqNullSafe(plan["__mix_s"])).select(F.col("source").alias("__mix_s2"), F.col("block").alias("__mix_b2"), SIZE, TARGET, shard.alias(DRAW))
    if int(n.sum()) <= SENT:
        of_block = F.broadcast(of_block)

    def drawn(given: DataFrame) -> DataFrame:
        out = given.join(of_block, given["source"].cast("string").eqNullSafe(F.col("__mix_s2")) & (block(KEY) == F.col("__mix_b2")))
        return out.select(*(given[f"`{c}`"] for c in given.columns), SIZE, TARGET, DRAW)

    return sized, drawn


def draws(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, blocks: int = 4096, shards: int = 64, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, h, size, source_size, target, draws (array of (pass, shard))."""
    sized, drawn = _dealing(docs, weights, share, most, blocks, shards, seed)
    return drawn(sized.withColumn(KEY, F.col("h"))).select("doc_id", "source", "h", "size", F.col(SIZE).alias("source_size"), F.col(TARGET).alias("target"), F.col(DRAW).alias("draws"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, blocks: int = 4096, shards: int = 64, seed: int = 42) -> DataFrame:
    """The mix itself: the rows of docs as often as drawn, with their columns and (mix_shard, mix_order).

    A shard is one partition, or several by ranges of mix_order if it is large; partitions come in the order of shards, and rows of
    a shard in that of mix_order. Texts cross the network once, as often as drawn.
    """
    sized, drawn = _dealing(docs, weights, share, most, blocks, shards, seed)
    out = drawn(docs.drop("mix_shard", "mix_order").withColumn(KEY, text_key())).drop(SIZE, TARGET).withColumn(DRAW, F.explode(DRAW))
    shard, turn = F.col(DRAW)["shard"], F.col(DRAW)["pass"]
    out = out.withColumn("mix_shard", shard).withColumn("mix_order", F.xxhash64(F.lit(seed + 2), shard, KEY, turn)).drop(KEY, DRAW)
    words = sized.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-int(words * share * WORD_BYTES) // (shards * PART_BYTES)))
    # mix_order is a hash, so equal ranges of it hold about as many rows; its upper half tells the range.
    part = F.floor((F.shiftright("mix_order", 32) + (1 << 31)) * parts / (1 << 32))
    return out.repartitionById(shards * parts, (F.col("mix_shard") * parts + part).cast("int")).sortWithinPartitions("mix_shard", "mix_order")
