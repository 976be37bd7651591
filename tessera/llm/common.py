"""Shared parts of the corpus operators.

Words are the maximal runs of bytes outside ``0x20, 0x09-0x0D`` of a text's UTF-8 form. They are found and
hashed for a whole Arrow batch at once with numpy, so that no Python code runs per word.

*Groups*: an operator that has to look at the texts more than once deals the rows into ``g`` groups by a hash
of (doc_id, text). A group is small (``GROUP_BYTES``), the number of groups grows with the corpus, and what
other stages have to say about a group is sent to it as packed arrays, so texts cross the network once.

*Buckets*: what is compared across documents (hashes of windows, n-grams, words) is first combined within a
group and then sent, packed, to the bucket that owns its hash. A hot hash thus reaches its bucket at most once
for each group, however many rows hold it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: One word, as a Java or Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes of text in a group, about.
GROUP_BYTES = 6_000_000
#: Entries in a bucket, about.
BUCKET_ROWS = 250_000
#: UTF-8 bytes of text that a Python worker looks at together, about; a longer text is one part.
SLICE_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: Gaps between runs of letters: all of ASCII but letters.
NOT_LETTERS = np.zeros(256, bool)
NOT_LETTERS[:128] = True
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x9FB21C651E98DF25
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        for key, base in (("p", _P), ("i", _P_INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


class Texts:
    """The words of a batch of texts: ``starts`` and ``ends`` into ``buf``, ``first`` the words before each text."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False, gaps: np.ndarray = _SPACE):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
        buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) > 1 else np.zeros(0, np.uint8)
        self.offsets = offs - offs[0]
        self.raw = buf
        self.buf = _LOWER[buf] if lower else buf
        word = ~gaps[self.buf]
        before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        edges = self.offsets[1:-1]
        before[edges[edges < len(word)]] = False
        after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n = len(column)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of its first ``most``): polynomial over scrambled bytes, then scrambled again."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + _CHUNK, side="right")))
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            p, inv = _powers_to(int(e[-1]) + 1)
            total = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(_TABLE[self.buf[base : base + e[-1]]] * p[: e[-1]], out=total[1:])
            e = e if most is None else np.minimum(e, s + most)
            out[at:to] = (total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            at = to
        return mix(out)

    def words(self, which: np.ndarray) -> list[bytes]:
        """The bytes of the given words."""
        b = self.buf.tobytes()
        return [b[s:e] for s, e in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


def windows(h: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of each ``k`` neighbouring values; ``len(h) - k + 1`` of them (none if fewer). Made by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, width, size, power = None, 0, 1, h
    while size <= k:
        if k & size:
            if out is None:
                out, width = power, size
            else:  # the new part goes after what there is
                m = len(h) - (width + size) + 1
                out = out[:m] * np.uint64(pow(base, size, 1 << 64)) + power[width : width + m]
                width += size
        if size * 2 <= k:
            m = len(h) - 2 * size + 1
            power = power[:m] * np.uint64(pow(base, size, 1 << 64)) + power[size : size + m]
        size *= 2
    return mix(out[:n])


def left_in_text(t: Texts) -> np.ndarray:
    """Words from each word to the end of its text, itself included."""
    return np.repeat(t.first[1:], t.counts) - np.arange(len(t.starts))


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values[bounds[i]:bounds[i+1]]``."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.view(np.uint8) if len(values) else b"")])


def unpacked(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """What packed() has packed, one after the other; nulls hold nothing."""
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c) and c.buffers()[2] is not None:
            o = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[o[0] : o[-1]])
    return np.frombuffer(np.concatenate(parts).tobytes(), dtype) if parts else np.zeros(0, dtype)


def lengths(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Values in each packed row."""
    import pyarrow.compute as pc

    return pc.binary_length(column).fill_null(0).to_numpy() // np.dtype(dtype).itemsize if len(column) else np.zeros(0, np.int64)


def dealt(to: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Sorts rows by where they go: the targets that get any, bounds, and the columns in that order."""
    if not len(to):
        return np.zeros(0, np.int32), np.zeros(1, np.int64), {k: v[:0] for k, v in columns.items()}
    small = to.astype(np.uint16) if to.max() < 65536 else to
    order = np.argsort(small, kind="stable")
    t = to[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    return t[first].astype(np.int32), np.r_[first, len(t)].astype(np.int64), {k: v[order] for k, v in columns.items()}


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return s, np.diff(np.r_[s, len(x)])


def within(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def groups_for(spark: SparkSession, total_bytes: int) -> int:
    """Groups for so many bytes of text; never below the shuffle partitions, that all cores have work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // GROUP_BYTES), 1)


def buckets_for(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // BUCKET_ROWS), 1)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0)


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identifies a row by its id and text; equal rows share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def grouped_texts(docs: DataFrame, g: int) -> DataFrame:
    """(g, h, doc_id, text), to be grouped by g; every use within one query shares one exchange."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", text_key())
    return keyed.select(F.pmod(F.col("h"), F.lit(g)).cast("int").alias("g"), "h", "doc_id", "text")


def workdir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster's executors share (``spark.checkpoint.dir``).

    Where that is unset, a local master gets a folder of its own for the session; a cluster has none that all
    executors see, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows from a table in the shared folder: computed once, whatever executors are lost later."""
    path = f"{workdir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than this share of all rows is dealt in parts; so at most as many keys are.
HOT_KEYS = 4096


def dealt_join(rows: DataFrame, side: DataFrame, key: str, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` to ``side``, which holds each key once.

    A key that over 1/``HOT_KEYS`` of all rows have goes to as many tasks as it has such shares: its rows by a hash of
    the columns ``by``, its row of ``side`` to each. The table of these keys has at most ``HOT_KEYS`` rows, which is why
    it may be broadcast. ``rows`` should be a written table, as they are counted first.
    """
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("__m")).where(F.col("__m") * HOT_KEYS > total).select(key, F.ceil(F.col("__m") * HOT_KEYS / max(total, 1)).cast("int").alias("__parts"))
    hot = F.broadcast(written(hot, "hot"))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("__parts")
    right = side.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"], how).drop("__part")


#: Rows of a table of places that are broadcast at most; beyond that it is joined by a shuffle.
PLACES = 100_000
#: Rows of a part that numbered() sorts in one task, about.
PART_ROWS = 1_000_000


def numbered(rows: DataFrame, order: list[Column], group: str | None = None) -> DataFrame:
    """Rows with ``idx``, their place (from 0) in the order of columns, and ``n``, how many there are, in each value of ``group`` (not null).

    Rows are dealt by ranges and sorted part by part; where each part and group begins follows from counts by part, so no
    task sees a whole group. ``rows`` should be a written table; of rows with equal order any may come first.
    """
    spark = rows.sparkSession
    by = [F.col("__group")]
    rows = rows.withColumn("__group", F.col(group) if group else F.lit(0)).withColumn("__row", F.monotonically_increasing_id())
    p = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    parts = rows.repartitionByRange(p, *by, *order, "__row").sortWithinPartitions(*by, *order, "__row").drop("__row")
    parts = written(parts.withColumn("__id", F.monotonically_increasing_id()), "parts").withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    mine = Window.partitionBy("__group")
    counts = parts.groupBy("__part", "__group").agg(F.count("*").alias("k"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("k").over(mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("__part", "__group", (before - F.col("first")).alias("__before"), F.sum("k").over(mine).alias("n")), "starts")
    starts = F.broadcast(starts) if starts.count() <= PLACES else starts
    out = parts.join(starts, ["__part", "__group"]).withColumn("idx", F.col("__at") + F.col("__before"))
    return out.drop("__part", "__group", "__id", "__at", "__before")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, comp) for every node with an edge, comp the smallest node that it reaches.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so the
    rounds grow with the logarithm of a component's diameter. All of it is joins and aggregates; each round's
    labels are written to the shared folder. Edges with a null end are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        far = labels.select(F.col("node").alias("comp"), F.col("comp").alias("f"))
        step = labels.join(near, "node").join(far, "comp", "left").select("node", F.least("comp", "m", "f").alias("new"), F.col("comp").alias("old"))
        step = written(step, "labels")
        labels = step.select("node", F.col("new").alias("comp"))
        if not step.where("new <> old").limit(1).count():
            return labels


Batches = Iterator[pa.RecordBatch]


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Batches:
    """The rows of a batch in order, in parts of about ``most`` bytes of the texts (or bytes) in column ``text``."""
    part = np.cumsum(lengths(batch.column(text), np.uint8)) // most
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        yield batch.slice(lo, hi - lo)


def only(n: int, **columns) -> dict:
    """Null arrays of length n for the other columns."""
    return {k: pa.nulls(n, t) for k, t in columns.items()}
