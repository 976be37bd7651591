"""Packing of tokenised documents into sequences of a fixed length, shortest pack first over the length histogram.

A document's ids, an end id after them, are cut at multiples of the sequence length: full pieces fill a sequence,
the rest of each document is packed whole. The plan needs the histogram of piece lengths alone (at most
``capacity`` counts, however large the corpus): lengths are placed longest first, each into the pack that is
shortest so far, and packs of equal content are one pattern with a count. Pieces find their place by rank: the
r-th piece of a length takes the r-th slot for that length over all patterns.

Ranks are exact without a sort over all rows: a task numbers its own pieces of a length, and the counts by
(task, length) are summed up before it. The pieces are a written table, so the numbers never change.

Tokens: where a tokenizer's file says that words between ``0x20, 0x09-0x0D`` never share a token (``WORDWISE``), each
distinct word is encoded once by a worker and kept (up to ``KEPT`` words); a text is then looked up as a whole. Any other
tokenizer reads whole texts.

Defined results: a null text is empty and has the end id alone. Repeated rows are packed as often as they come.
Null doc_ids are packed too. An empty table has no sequences. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Batches, Texts, mix, slices, within, written

#: Words that a worker keeps encoded (about 20 bytes each).
KEPT = 6_000_000
PIECES = "doc_id long, start long, length int, checksum long, doc_tokens long, part int, rank long, ids array<int>"


#: Fixed values of a tokenizer's file: the steps before its model by which words are encoded one by one, and that model's word end.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "end_of_word_suffix": "</w>",
}


#: Kinds of bytes to the split; what takes more than a byte, apostrophes, '<' and controls are unclear by the byte alone.
_LETTER, _DIGIT, _OTHER, _UNCLEAR = range(4)
_KINDS = np.full(256, _UNCLEAR, np.uint8)
_KINDS[[c for c in range(0x21, 0x7F) if chr(c) not in "'<"]] = _OTHER
_KINDS[[ord(c) for c in string.ascii_letters]] = _LETTER
_KINDS[[ord(c) for c in string.digits]] = _DIGIT


def _wordwise(path: str) -> bool:
    """Whether the file has exactly the steps of WORDWISE, and added tokens start with '<' only."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = (j.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [x for x in steps if x.get("type") == "Split" and x.get("pattern", {}).get("Regex") == WORDWISE["split"] and x.get("behavior") == "Removed" and x.get("invert")]
    rest = [x for x in steps if x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex")]
    suffix = j["model"].get("end_of_word_suffix")
    return j.get("normalizer") == WORDWISE["normalizer"] and len(steps) == 2 and steps == split + rest and suffix == WORDWISE["end_of_word_suffix"] and all(t["content"].startswith("<") for t in j.get("added_tokens", []))


class Encoder:
    """Ids of words, with those met before kept in sorted arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.wordwise = _wordwise(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.plain = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
        self.forget()

    def forget(self) -> None:
        self.hash, self.at, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, where each word's begin and how many they are. Plain words go through the tokenizer many at a time;
        the ends of their parts tell them apart."""
        parts = self._parts(words)
        found, at, n = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        size, easy = 0, np.flatnonzero(parts)
        batches = [easy[k : k + 200] for k in range(0, len(easy), 200)]
        texts = [b" ".join([words[i] for i in batch.tolist()]).decode() for batch in batches]
        for batch, enc in zip(batches, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, np.int32)
            last = np.cumsum(parts[batch])
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != last[-1]:
                parts[batch] = 0
                continue
            bounds = np.r_[0, cut[last - 1]]
            at[batch], n[batch] = size + bounds[:-1], np.diff(bounds)
            found.append(ids)
            size += len(ids)
        rest = np.flatnonzero(parts == 0).tolist()
        for i, enc in zip(rest, self.tok.encode_batch_fast([words[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            at[i], n[i] = size, len(enc.ids)
            found.append(np.array(enc.ids, np.int32))
            size += len(enc.ids)
        return np.concatenate(found) if found else np.zeros(0, np.int32), at, n

    def _parts(self, words: list[bytes]) -> np.ndarray:
        """How many parts the split makes of each word; 0 for words that have to go alone. Bytes tell it of ASCII words without
        apostrophes: a run of letters, a digit and a run of anything else are a part each."""
        if not words:
            return np.zeros(0, np.int64)
        kind = _KINDS[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.r_[0, np.cumsum([len(w) for w in words])[:-1]]
        new = (kind == _DIGIT) | np.r_[True, kind[1:] != kind[:-1]]
        new[starts] = True
        n = np.add.reduceat(new, starts, dtype=np.int64)
        for i in np.flatnonzero(np.maximum.reduceat(kind, starts) == _UNCLEAR).tolist():
            s = words[i].decode("utf-8", "replace")
            n[i] = len(self.parts.findall(s.lower())) if "<" not in s and self.plain.fullmatch(s) else 0
        return n

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, one text after the other, and how many each text has."""
        if not self.wordwise:
            found = [self.tok.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]
            return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)
        t = Texts(texts, lower=True)
        ids, n = self._of_words(t)
        total = np.r_[0, np.cumsum(n)]
        return ids, total[t.first[1:]] - total[t.first[:-1]]

    def _of_words(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch's words, and how many each has. Words go to the tokenizer lower-cased, but as they are if they
        hold a '<', or a capital and a code point from U+0300: the tokenizer composes characters before it lower-cases."""
        h = t.hashes()
        raw = t.raw.tobytes()
        odd = np.unique(np.searchsorted(t.starts, np.flatnonzero(t.raw == ord("<")), side="right") - 1)
        marks = t.raw >= 0xCC
        if marks.any():
            capital = np.searchsorted(t.starts, np.flatnonzero(t.raw != t.buf), side="right") - 1
            capital = capital[np.r_[True, capital[1:] != capital[:-1]][: len(capital)]]
            before = np.r_[0, np.cumsum(marks, dtype=np.int32)]
            odd = np.union1d(odd, capital[before[t.ends[capital]] > before[t.starts[capital]]])
        for i in odd.tolist():
            h[i] = mix(np.frombuffer(hashlib.blake2b(raw[t.starts[i] : t.ends[i]], digest_size=8).digest(), np.uint64))[0]
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = ~within(u, self.hash)
        if new.any():
            if len(self.hash) + int(new.sum()) > KEPT:
                self.forget()
                new = np.ones(len(u), bool)
            which = first[new]
            special = set(odd.tolist())
            low = t.buf.tobytes()
            ids, at, n = self.encode([(raw if i in special else low)[s:e] for i, s, e in zip(which.tolist(), t.starts[which].tolist(), t.ends[which].tolist(), strict=True)])
            at += len(self.ids)
            self.ids = np.concatenate([self.ids, ids])
            key = np.concatenate([self.hash, u[new]])
            order = np.argsort(key, kind="stable")
            self.hash, self.at, self.len = key[order], np.concatenate([self.at, at])[order], np.concatenate([self.len, n])[order]
        where = np.searchsorted(self.hash, u)
        at, n = self.at[where][inverse], self.len[where][inverse].astype(np.int64)
        cum = np.cumsum(n)
        src = np.arange(cum[-1] if len(cum) else 0) + np.repeat(at - (cum - n), n)
        return self.ids[src], n


_encoders: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cuts documents into pieces: doc_id, start, length, checksum (CRC-32 of the ids as little-endian 32-bit), doc_tokens, ids (if asked for)."""

    def cut(batches: Batches) -> Batches:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder, part = _encoders[path], TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, 1):
                m = rows.num_rows
                ids, per_doc = encoder.ids_of(rows.column(1))
                all_ids = np.full(len(ids) + m, end_id, "<u4")
                all_ids[np.arange(len(ids)) + np.repeat(np.arange(m), per_doc)] = ids
                sizes = per_doc + 1
                bounds = np.r_[0, np.cumsum(sizes)]
                k = -(-sizes // capacity)
                doc = np.repeat(np.arange(m), k)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                b = memoryview(all_ids).cast("B")
                s, e = (bounds[doc] + start) * 4, (bounds[doc] + start + length) * 4
                sums = [zlib.crc32(b[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(doc), np.int64)
                ls = length[order]
                new = np.flatnonzero(np.r_[True, ls[1:] != ls[:-1]])
                rank[order] = np.arange(len(ls)) - np.repeat(new, np.diff(np.r_[new, len(ls)])) + used[ls]
                used += np.bincount(length, minlength=capacity + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[s, e[-1:]] // 4, pa.int32()), pa.array(all_ids.view(np.int32))) if with_ids else pa.nulls(len(doc), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(sums, pa.int64()), pa.array(sizes[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank), lists], ["doc_id", "start", "length", "checksum", "doc_tokens", "part", "rank", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns of lengths, each with how many sequences have it."""
    open_: dict[int, list[list]] = {}
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            gap = max((g for g, packs in open_.items() if g >= length and packs), default=None)
            if gap is None:  # new packs hold as many of this length as fit, since nothing longer comes
                m = capacity // length
                for count, copies in ((n // m, m), (1, n % m)):
                    if count and copies:
                        open_.setdefault(capacity - copies * length, []).append([count, [length] * copies])
                n = 0
            else:
                count, pack = open_[gap].pop()
                k = min(count, n)
                if count > k:
                    open_[gap].append([count - k, pack])
                open_.setdefault(gap - length, []).append([k, [*pack, length]])
                n -= k
    return [(c, p) for _, packs in sorted(open_.items()) for c, p in packs]


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """(length, first rank, first sequence, offset) of each slot, by length and rank."""
    out, seq, used = [], 0, {}
    for count, pack in patterns:
        at = 0
        for length in pack:
            out.append((length, used.get(length, 0), seq, at))
            used[length] = used.get(length, 0) + count
            at += length
        seq += count
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, checksum, doc_tokens, ids, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, path, capacity, end_id, with_ids), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("k")), "counts")
    histogram = {r.length: r.k for r in counts.groupBy("length").agg(F.sum("k").alias("k")).collect()}
    table = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, capacity)))
    before = counts.select("part", "length", (F.sum("k").over(W.partitionBy("length").orderBy("part")) - F.col("k")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")

    def place(batches: Batches) -> Batches:
        s = table.value
        big = np.int64(1) << np.int64(48)
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            at = np.searchsorted(s[:, 0] * big + s[:, 1], length * big + rank, side="right") - 1 if len(s) else np.zeros(0, np.int64)
            cols = [batch.column(k) for k in ("doc_id", "start", "length", "checksum", "doc_tokens", "ids")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s[at, 2] + rank - s[at, 1]), pa.array(s[at, 3])], ["doc_id", "start", "length", "checksum", "doc_tokens", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length int, checksum long, doc_tokens long, ids array<int>, sequence_id long, offset long")
