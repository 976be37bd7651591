"""Exact duplicates, by skew-safe combining.

Texts are equal when identical after each run of ``0x20, 0x09-0x0D`` has become one space. Three stages, each of
which compares whole contents, never digests alone:

1. locally, each input task keeps the row with the smallest doc_id of equal texts and counts them;
2. the rows that stay are dealt by (digest, salt), the salt taken from the row's own number, so that a group that
   fills a third of the corpus is merged in ``salts`` places, of which there are more the more turns stage 1 took;
3. the at most ``salts`` winners of each group are combined globally.

Contents travel compressed (zstd, one level, without a frame checksum): equal bytes are equal contents. Stages 2 and 3
deal so many partitions as the contents' bytes and rows ask for (``PART_BYTES``, ``PART_ROWS``) and read each sorted by
digest, so a worker holds the groups of one digest at a time, each content once. Stage 1 is a written table, so a lost executor costs no
second pass. Which row stays is joined back by row numbers, of which none is hot: a local row speaks for the rows of one
task, a salted one for one row of each task.

Defined results: a null text counts as empty. Null doc_ids come after all others; a group of null doc_ids alone
has a null keep_id. Of rows with equal doc_id and text one is kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Batches, slices, text_key, written

#: Contents and rows that stage 1 holds before it starts anew.
LOCAL_BYTES, LOCAL_ROWS = 64_000_000, 200_000
#: Rows of one content that a place of stage 2 merges at most, about: so many of stage 1's turns.
TURNS = 1024
#: Compressed contents and rows of a partition in stages 2 and 3, about.
PART_BYTES, PART_ROWS = 128_000_000, 1_000_000
LEVEL = 1


def normalised(text: str | None) -> bytes:
    b = (text or "").encode()
    words = b.split()
    if not words:
        return b" " if b else b""
    lead, tail = b" " * (b[0] in b" \t\n\r\x0b\x0c"), b" " * (b[-1] in b" \t\n\r\x0b\x0c")
    return lead + b" ".join(words) + tail


def _order(doc_id: int | None) -> tuple:
    return (doc_id is None, doc_id or 0)


def _local(batches: Batches) -> Batches:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
    base = TaskContext.get().partitionId() << 40
    number, size = base, 0
    groups: dict[tuple[bytes, bytes], list] = {}
    rows: list[list] = []

    def flush() -> pa.RecordBatch:
        leads = {id(v): v for v in groups.values()}
        for v in leads.values():
            v[0][3] = v[1]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        rep = [r[2][0][1] for r in rows]
        out = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(rep, pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array(cols[4], pa.binary()), pa.array([r[5] if r[3] else None for r in rows], pa.binary()), pa.array(cols[6], pa.int64())], ["doc_id", "row", "rep", "n", "digest", "content", "h"])
        rows.clear()
        groups.clear()
        return out

    for batch in (part for b in batches for part in slices(b, 1)):
        for doc_id, text, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            content = normalised(text)
            digest = hashlib.sha256(content).digest()
            small = squeeze(content)
            row = [doc_id, number, None, 0, digest, small, h]
            number += 1
            group = groups.get((digest, small))
            if group is None:
                group = groups[digest, small] = [row, 0]
                size += len(small)
            else:
                row[5] = group[0][5]
                if _order(doc_id) < _order(group[0][0]):
                    group[0] = row
            group[1] += 1
            row[2] = group
            rows.append(row)
        if size > LOCAL_BYTES or len(rows) > LOCAL_ROWS:
            yield flush()
            size = 0
    if rows:
        yield flush()


def _merged(last: bool):
    """Merges rows of equal content in a partition sorted by digest: (rep, winner) for each, contents and counts with the winners."""
    names = ["rep", "winner", "doc_id", "n", *([] if last else ["digest", "content"])]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 2

    def of_digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        groups: dict[bytes, list] = {}  # each content once: [doc_id, rep, n, content]
        held = []
        for doc_id, rep, n, digest, content in rows:
            group = groups.setdefault(content, [None, None, 0, content])
            if group[1] is None or (*_order(doc_id), rep) < (*_order(group[0]), group[1]):
                group[0], group[1] = doc_id, rep
            group[2] += n
            held.append((rep, group))
        for rep, (keep_id, winner, n, content) in held:
            lead = rep == winner
            yield (rep, winner, keep_id, n) if last else (rep, winner, keep_id, n if lead else 0, digest, content if lead else None)

    def f(batches: Batches) -> Batches:
        def rows() -> Iterator[tuple]:
            for b in (part for batch in batches for part in slices(batch, 4)):
                yield from zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)

        out, size = [], 0
        for _, same in groupby(rows(), key=itemgetter(3)):
            for row in of_digest(same):
                out.append(row)
                size += 48 + len(row[-1] or b"") if not last else 48
                if size > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names)

    return f


def exact_groups(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (SHA-256 of the normalised text, binary), h (the row's key)."""
    spark = docs.sparkSession
    local = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("h")).mapInArrow(_local, "doc_id long, row long, rep long, n long, digest binary, content binary, h long"), "local")
    cols = ("doc_id", "rep", "n", "digest", "content")
    size, leads, tasks = local.where("n > 0").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)), F.count("*"), F.coalesce(F.max(F.shiftright("row", 40)) + 1, F.lit(0))).first()
    turns = tasks + size // LOCAL_BYTES + local.count() // LOCAL_ROWS  # no content has more rows than this in stage 2
    salts = salts or max(16, -(-turns // TURNS))
    p = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES), -(-leads // PART_ROWS))
    salted = local.where("n > 0").select("doc_id", F.col("row").alias("rep"), "n", "digest", "content").repartition(p, "digest", F.pmod(F.xxhash64("rep"), F.lit(salts))).sortWithinPartitions("digest")
    merged = written(salted.select(*cols).mapInArrow(_merged(False), "rep long, winner long, doc_id long, n long, digest binary, content binary"), "salted")
    won = merged.where("n > 0").select("doc_id", F.col("winner").alias("rep"), "n", "digest", "content").repartition(p, "digest").sortWithinPartitions("digest")
    final = won.select(*cols).mapInArrow(_merged(True), "rep long, winner long, doc_id long, n long")
    to_winner = merged.select("rep", F.col("winner").alias("mid"))
    to_final = final.select(F.col("rep").alias("mid"), F.col("winner").alias("keep_row"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    reps = to_winner.join(to_final, "mid")
    return local.select("doc_id", "row", "rep", "digest", "h").join(reps, "rep").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "h")
