"""Language of texts and of spans within them.

Letters' script ranges narrow the candidates of each word to the languages that were learned with that script; each
word is scored under each candidate by byte trigrams (with the gaps round it); a Viterbi pass over a text's words
with a penalty for each switch labels spans of mixed-language text. The text's language has most bytes of words
with a letter; its score is that share.

Learning counts trigrams (hashed to ``CELLS``) and scripts for each language over all labelled rows, whole texts. The
tasks' counts are added up in two levels, each in many places; what reaches the driver is one row of fixed size for each
language and part.

Defined results: a null text, or one without a letter (by Unicode category), is ``und`` with score 0; so is every text if nothing was
learned. Rows with a null label are not learned from. Words without letters take the label of their neighbours.
Equal scores go to the language that comes first by code point. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, Texts, slices

CELLS, PARTS = 1 << 17, 64
#: Places into which the tasks' counts go before they are added up, so that no task sees those of all others.
SALTS = 256
#: Code points of the scripts by their ranges: Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic and Syriac, Indic,
#: South-East Asian, Georgian and Ethiopic, Kana, CJK, Hangul. Letters outside are one script more.
SCRIPTS = (
    ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    ((0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)),
    ((0x530, 0x5FF), (0xFB13, 0xFB4F)),
    ((0x600, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    ((0x900, 0xDFF), (0xA8E0, 0xA8FF)),
    ((0xE00, 0x109F), (0x1780, 0x17FF), (0xA9E0, 0xAA7F)),
    ((0x10A0, 0x10FF), (0x1200, 0x139F), (0x1C90, 0x1CBF)),
    ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
    ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
)
_OTHER = len(SCRIPTS) + 1
#: Natural-log loss of a switch between languages, and of a word in a script not learned for a language.
SWITCH, OFF = 12.0, 60.0


def _cells(t: Texts) -> np.ndarray:
    """The trigram's cell at each byte; gaps count as a space."""
    b = np.where(np.isin(t.buf, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)), 32, t.buf).astype(np.uint32)
    before, after = np.full(len(b), 32, np.uint32), np.full(len(b), 32, np.uint32)
    before[1:], after[:-1] = b[:-1], b[1:]
    edges = t.offsets[1:-1]
    before[edges[edges < len(b)]] = 32
    after[edges[edges > 0] - 1] = 32
    key = (before << np.uint32(16)) | (b << np.uint32(8)) | after
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(15)).astype(np.int64)


@cache
def _script_table() -> np.ndarray:
    """The script of each code point; 255 for one that is not a letter by its Unicode category."""
    table = np.array([len(SCRIPTS) if chr(c).isalpha() else 255 for c in range(0x110000)], np.uint8)
    for i, ranges in enumerate(SCRIPTS):
        for lo, hi in ranges:
            table[lo : hi + 1][table[lo : hi + 1] != 255] = i
    return table


def _letters(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where letters start in a batch's bytes, and their scripts."""
    table, b = _script_table(), np.r_[t.buf, np.zeros(3, np.uint8)]
    plain = np.flatnonzero(table[:128][np.minimum(t.buf, 127)] != 255)
    lead = np.flatnonzero(t.buf >= 0xC2)
    if not len(lead):
        return plain, table[t.buf[plain]]
    x = [b[lead + k].astype(np.int64) & 0x3F for k in range(4)]
    two, three, four = ((x[0] & 0x1F) << 6) | x[1], ((x[0] & 0x0F) << 12) | (x[1] << 6) | x[2], ((x[0] & 0x07) << 18) | (x[1] << 12) | (x[2] << 6) | x[3]
    code = np.where(b[lead] < 0xE0, two, np.where(b[lead] < 0xF0, three, np.minimum(four, 0x10FFFF)))
    script = table[code]
    lead, script = lead[script != 255], script[script != 255]
    at = np.r_[plain, lead]
    order = np.argsort(at, kind="stable")
    return at[order], np.r_[table[t.buf[plain]], script][order]


def _scripts(t: Texts) -> np.ndarray:
    """The script of each word's first letter; 255 without one."""
    at, s = _letters(t)
    first = np.searchsorted(at, t.starts)
    ok = first < len(at)
    out = np.full(len(t.starts), 255, np.uint8)
    inside = at[first[ok]] < t.ends[ok]
    out[np.flatnonzero(ok)[inside]] = s[first[ok][inside]]
    return out


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        p = (counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * CELLS) if len(langs) else counts
        self.logs = np.log(p).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.allowed = share >= 0.005
        self.allowed[:, ~self.allowed.any(0)] = True

    def spans(self, texts: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray]:
        """The words of a batch, each word's label and whether it has a letter."""
        t = Texts(texts, lower=True)
        cells, script = _cells(t), _scripts(t)
        scores = np.zeros((len(t.starts), len(self.langs)), np.float32)
        if len(t.starts):
            bounds = np.empty(2 * len(t.starts), np.int64)
            bounds[::2], bounds[1::2] = t.starts, t.ends
            bounds = bounds[:-1] if bounds[-1] == len(cells) else bounds
            for i in range(len(self.langs)):
                scores[:, i] = np.add.reduceat(self.logs[i][cells], bounds)[::2]
        letters = script != 255
        scores[~letters] = 0
        for k in np.unique(script[letters]):
            off = ~self.allowed[:, k]
            if off.any():
                rows = np.flatnonzero(script == k)
                scores[np.ix_(rows, np.flatnonzero(off))] -= OFF
        return t, viterbi(scores, t.first), letters

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        t, label, letters = self.spans(texts)
        k = max(len(self.langs), 1)
        doc = t.doc_of_word()
        size = ((t.ends - t.starts) * letters).astype(np.float64)
        share = np.bincount(doc * k + label, weights=size, minlength=t.n * k).reshape(t.n, k)
        total = share.sum(1)
        best = share.argmax(1)
        score = share[np.arange(t.n), best] / np.maximum(total, 1)
        known = (total > 0) & bool(self.langs)
        return [self.langs[i] if ok else "und" for i, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word: the sum of scores less ``switch`` for each change within a text. All texts advance together."""
    n, k = scores.shape
    label = np.zeros(n, np.int64)
    if not n or k < 2:
        return label
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    base, size = first[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # texts longer than each step
    v = np.zeros((int(live[0]), k), np.float32)
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for step, m in enumerate(live.tolist()):
        v = v[:m]
        if step:
            top = v.argmax(1)
            best = v[np.arange(m), top] - switch
            jump = v < best[:, None]
            back.append((top.astype(np.uint16), np.packbits(jump, axis=1)))
            v = np.where(jump, best[:, None], v)
        v = v + scores[base[:m] + step]
        ended = slice(int(live[step + 1]) if step + 1 < len(live) else 0, m)
        label[base[ended] + step] = v[ended].argmax(1)
    now = np.zeros(int(live[0]), np.int64)
    for step in range(len(live) - 1, -1, -1):
        m = int(live[step])
        ended = slice(int(live[step + 1]) if step + 1 < len(live) else 0, m)
        now[ended] = label[base[ended] + step]
        label[base[:m] + step] = now[:m]
        if step:
            top, jump = back[step - 1]
            hit = (jump[np.arange(m), now[:m] >> 3] >> (7 - (now[:m] & 7)).astype(np.uint8)) & 1
            now[:m] = np.where(hit == 1, top[:m], now[:m])
    return label


def _counted(batches: Batches) -> Batches:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in (part for batch in batches for part in slices(batch, 1)):
        langs = np.array(b.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            t = Texts(b.column(1).filter(pa.array(langs == lang)), lower=True)
            cells, script = _cells(t), _scripts(t)
            inside = np.zeros(len(cells) + 1, np.int8)
            inside[t.starts] += 1
            inside[t.ends] -= 1
            c, s = sums.setdefault(lang, (np.zeros(CELLS, np.int64), np.zeros(_OTHER, np.int64)))
            c += np.bincount(cells[np.cumsum(inside[:-1]) > 0], minlength=CELLS)
            s += np.bincount(script[script != 255], minlength=_OTHER)
    salt = TaskContext.get().partitionId() % SALTS
    for lang, (c, s) in sums.items():
        step = CELLS // PARTS
        blobs = [zlib.compress(c[k * step : (k + 1) * step].tobytes(), 1) for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * PARTS), pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(blobs, pa.binary()), pa.array([s.tobytes()] + [None] * (PARTS - 1), pa.binary()), pa.array(np.full(PARTS, salt, np.int32))], ["lang", "part", "cells", "scripts", "salt"])


def _summed(table: pa.Table) -> pa.Table:
    c, s = np.zeros(CELLS // PARTS, np.int64), np.zeros(_OTHER, np.int64)
    for x in table["cells"].to_pylist():
        c += np.frombuffer(zlib.decompress(x), np.int64)
    for x in table["scripts"].to_pylist():
        s += np.frombuffer(x, np.int64) if x else 0
    return pa.table({"lang": table["lang"].slice(0, 1).combine_chunks(), "part": table["part"].slice(0, 1).combine_chunks(), "cells": pa.array([zlib.compress(c.tobytes(), 1)], pa.binary()), "scripts": pa.array([s.tobytes()], pa.binary())})


def learn(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Learns from all rows whose label and text are not null."""
    known = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    kind = "lang string, part int, cells binary, scripts binary"
    counted = known.mapInArrow(_counted, f"{kind}, salt int")
    found = counted.groupBy("lang", "part", "salt").applyInArrow(_summed, kind).groupBy("lang", "part").applyInArrow(_summed, kind).collect()
    langs = sorted({r.lang for r in found})
    counts, scripts = np.zeros((len(langs), CELLS)), np.zeros((len(langs), _OTHER))
    step = CELLS // PARTS
    for r in found:
        i = langs.index(r.lang)
        counts[i, r.part * step : (r.part + 1) * step] = np.frombuffer(zlib.decompress(r.cells), np.int64)
        scripts[i] += np.frombuffer(r.scripts, np.int64)
    return Model(langs, counts, scripts)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Batches) -> Batches:
        for b in (part for batch in batches for part in slices(batch, 1)):
            langs, score = shared.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(f, "doc_id long, lang_pred string, score double")


def labelled_spans(docs: DataFrame, model: Model) -> DataFrame:
    """Spans of one language: doc_id, start and end (words), lang; a document has as many rows as spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Batches) -> Batches:
        for b in (part for batch in batches for part in slices(batch, 1)):
            t, label, _ = shared.value.spans(b.column(1))
            doc = t.doc_of_word()
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]) if len(doc) else np.zeros(0, np.int64)
            end = np.r_[new[1:], len(doc)][: len(new)]
            d = doc[new]
            names = pa.array([shared.value.langs[k] for k in label[new]], pa.string()) if shared.value.langs else pa.array(["und"] * len(new), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array((new - t.first[d]).astype(np.int32)), pa.array((end - t.first[d]).astype(np.int32)), names], ["doc_id", "start", "end", "lang"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(f, "doc_id long, start int, end int, lang string")
