"""Removal of passages that repeat, by difference-cover anchors.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it has the same
words as a window that starts earlier: in a document with a smaller doc_id, or earlier in the same document.

Method. Let D be a difference cover modulo the period v: for any two positions i and j some shift below v
brings both to residues in D. Hashes of ``window - v + 1`` words are taken at cover positions only, so two equal
windows always have an equal anchor at an equal shift, and 4 of 13 positions are hashed instead of all. Only
windows round an anchor that occurs twice are candidates; these extend to the whole window, compared by 128
bits of hash, and for each the smallest (doc_id, start) is the one that stays.

Stages (see common.py for groups and buckets): anchors by bucket; repeated anchors back to the groups that hold
them; candidate windows by bucket, one for each group; positions that are not the first back to their groups.
A window that very many documents hold costs a bucket one entry for each group at most.

Defined results: a null text has no words. Null doc_ids come after all others and equal one another. Rows with
one doc_id are compared by start alone, so equal rows keep the same words. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, buckets_for, dealt, grouped_texts, groups_for, left_in_text, lengths, packed, runs, text_bytes, unpacked, windows, within

#: Difference covers by period (perfect difference sets).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LAST = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least two fifths of the window."""
    if window < 4:
        return 1, (0,)
    return max((v, d) for v, d in COVERS.items() if window - v + 1 >= 0.4 * window)


def _rows(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The distinct rows of a group in an order that does not depend on arrival, and where each row is among them."""
    _, first, inverse = np.unique(table["h"].to_numpy(), return_index=True, return_inverse=True)
    return table.take(pa.array(first)), inverse


def _anchors(t: Texts, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors (among all words of the group) and their hashes, in texts that hold a window."""
    period, cover = cover_for(window)
    size = window - period + 1
    h = windows(words, size)
    at = np.arange(len(h)) - np.repeat(t.first[:-1], t.counts)[: len(h)]
    here = np.zeros(period, bool)
    here[list(cover)] = True
    long = np.repeat(t.counts >= window, t.counts)[: len(h)]
    idx = np.flatnonzero(here[at % period] & long & (left_in_text(t)[: len(h)] >= size))
    return idx, h[idx]


def drop_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by a space), removed (spans of words)."""
    spark = docs.sparkSession
    total = text_bytes(docs)
    g = groups_for(spark, total)
    period, cover = cover_for(window)
    b = buckets_for(spark, total // 7 * len(cover) // period)
    texts = grouped_texts(docs, g)

    def anchors(table: pa.Table) -> pa.Table:
        rows, _ = _rows(table)
        t = Texts(rows["text"])
        _, h = _anchors(t, t.hashes(), window)
        h = np.unique(h)
        to, bounds, cols = dealt((h % np.uint64(b)).astype(np.int64), {"h": h})
        return pa.table({"b": to, "g": np.full(len(to), table["g"][0].as_py(), np.int32), "hs": packed(cols["h"], bounds)})

    def shared(table: pa.Table) -> pa.Table:
        h = unpacked(table["hs"], np.uint64)
        src = np.repeat(table["g"].to_numpy(), lengths(table["hs"], np.uint64))
        order = np.argsort(h)
        s, n = runs(h[order])
        many = np.repeat(n > 1, n)
        to, bounds, cols = dealt(src[order][many], {"h": h[order][many]})
        return pa.table({"g": to, "hs": packed(cols["h"], bounds)})

    def candidates(table: pa.Table, known: pa.Table) -> pa.Table:
        """Candidate windows: the first of each in this group goes to its bucket, the others are marked at once."""
        rows, _ = _rows(table)
        t = Texts(rows["text"])
        words = t.hashes()
        idx, h = _anchors(t, words, window)
        u, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        repeated = within(u, np.unique(unpacked(known["hs"], np.uint64))) | (count > 1)
        marks = np.zeros(len(words) + period + 1, np.int32)
        marks[idx[repeated[inverse]] + 1] = 1
        marks = np.cumsum(marks)
        n = max(len(words) - window + 1, 0)
        near = marks[np.minimum(np.arange(n) + period, len(words))] > marks[:n]
        pos = np.flatnonzero(near & (left_in_text(t)[:n] >= window))
        h1, h2 = windows(words, window)[pos], windows(words, window, 0x9E3779B185EBCA87)[pos]
        row = np.searchsorted(t.first, pos, side="right") - 1
        doc = rows["doc_id"].fill_null(LAST).to_numpy()[row]
        start = pos - t.first[row]
        order = np.lexsort((start, doc, h2, h1))
        h1, h2, doc, start, row = h1[order], h2[order], doc[order], start[order], row[order]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h1) else np.zeros(0, np.int64)
        later = (doc > doc[lead]) | (start > start[lead])
        at = (row.astype(np.uint64) << np.uint64(32)) | start.astype(np.uint64)
        # Rows of one doc_id in this group can share the first place; each of them has to hear of an earlier one elsewhere.
        entry = np.zeros(int((~later).sum()), ENTRY)
        for name, x in (("h1", h1), ("h2", h2), ("doc", doc), ("at", at)):
            entry[name] = x[~later]
        to, bounds, cols = dealt((entry["h1"] % np.uint64(b)).astype(np.int64), {"e": entry})
        own = np.zeros(int(later.sum()), ENTRY)
        own["at"] = at[later]
        gid = table["g"][0].as_py()
        bins = np.r_[to, [gid % b]].astype(np.int32)
        blobs = pa.concat_arrays([packed(cols["e"], bounds), packed(np.zeros(0, ENTRY), np.array([0, 0]))])
        done = pa.concat_arrays([pa.nulls(len(to), pa.binary()), packed(own["at"], np.array([0, len(own)]))])
        return pa.table({"b": bins, "g": np.full(len(bins), gid, np.int32), "es": blobs, "marks": done})

    def later_ones(table: pa.Table) -> pa.Table:
        e = unpacked(table["es"], ENTRY)
        src = np.repeat(table["g"].to_numpy(), lengths(table["es"], ENTRY))
        start = e["at"] & np.uint64(0xFFFFFFFF)
        order = np.lexsort((start, e["doc"], e["h2"], e["h1"]))
        e, src, start = e[order], src[order], start[order]
        new = np.r_[True, (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])] if len(e) else np.zeros(0, bool)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(e) else np.zeros(0, np.int64)
        later = (e["doc"] > e["doc"][lead]) | (start > start[lead])
        to, bounds, cols = dealt(src[later], {"at": e["at"][later]})
        passed = table.select(["g", "marks"]).filter(pa.compute.is_valid(table["marks"]))
        return pa.concat_tables([pa.table({"g": to, "marks": packed(cols["at"], bounds)}), passed.cast(pa.schema({"g": pa.int32(), "marks": pa.binary()}))])

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        rows, inverse = _rows(table)
        t = Texts(rows["text"])
        marks = unpacked(found["marks"], np.uint64)
        pos = t.first[(marks >> np.uint64(32)).astype(np.int64)] + (marks & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.zeros(len(t.starts) + 1, np.int32)
        np.add.at(edge, pos, 1)
        np.add.at(edge, np.minimum(pos + window, len(t.starts)), -1)
        gone = np.cumsum(edge)[:-1] > 0
        total = np.r_[0, np.cumsum(gone)]
        removed = total[t.first[1:]] - total[t.first[:-1]]
        kept, spans = [], []
        for i, text in enumerate(rows["text"].to_pylist()):
            words = (text or "").encode().split()
            here = gone[t.first[i] : t.first[i + 1]]
            if removed[i]:
                kept.append(b" ".join([w for w, x in zip(words, here.tolist(), strict=True) if not x]))
                turn = np.flatnonzero(np.diff(np.r_[False, here, False].astype(np.int8)))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2], strict=True)])
            else:
                kept.append(b" ".join(words))
                spans.append([])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        out = pa.table({"doc_id": rows["doc_id"].combine_chunks(), "n_words": t.counts.astype(np.int64), "n_removed": removed.astype(np.int64), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(spans, kind)})
        return out if len(inverse) == len(rows) else out.take(pa.array(inverse))

    first = texts.groupBy("g").applyInArrow(anchors, "b int, g int, hs binary")
    known = first.groupBy("b").applyInArrow(shared, "g int, hs binary")
    second = texts.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(_guarded(candidates, "b int, g int, es binary, marks binary"), "b int, g int, es binary, marks binary")
    found = second.groupBy("b").applyInArrow(later_ones, "g int, marks binary")
    return texts.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_guarded(finish, RESULT), RESULT)


ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("at", "<u8")])


def _guarded(f, schema: str):
    """A group without texts has nothing to say."""

    def g(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left):
            return f(left, right)
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        return to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    return g
