"""Scores of texts by an interpolated bigram model with deleted interpolation.

Tokens are lower-cased (A-Z) words and one end after each text. With counts c over the training documents,

    p(w | v) = L * c(v w) / c(v) + (1 - L) * (c(w) + 0.1) / (N + 0.1 * (V + 1)),

v being the token before w (a start for the first). L depends on the bucket of the context's frequency (octaves
of c(v)) and is learned by expectation-maximisation on held-out counts: each training token is deleted in turn, so
it is predicted with c(v w) - 1 and c(v) - 1. The deleted likelihood needs, for each bucket, only a histogram of
the ratio of the two estimates, which has a fixed size.

Counts cover all training documents. Groups (common.py) send distinct words, and then distinct bigrams of words that
other groups have as well, with their own counts to the bucket that owns the hash, and hear the sums in the order
of what they sent, so answers carry no names. Bigrams with a word that one group alone has need no message.
Bigrams are named by 40 bits beside their bucket, so about one in ten million shares a count with another.

Defined results: a null text is empty: one end token. A null doc_id counts as the empty text, whose checksum holds
it out. Repeated rows are counted and scored as often as they come. Without training documents N and V are 0 and
all tokens are unknown. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, buckets_for, dealt, grouped_texts, groups_for, lengths, mix, packed, text_bytes, unpacked

END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A2757A271)
#: Steps a decade and the zero of a quantised logarithm; bins of the ratio, of which 0 is a ratio of zero.
STEPS, ZERO, BINS, BUCKETS = 12, 128, 512, 48
#: Histograms that one task adds up, about.
MERGED = 32
MESSAGE = "g int, kind int, es binary, n long, v long, weights array<double>"
SCHEMA = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("es", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("weights", pa.list_(pa.float64()))])
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held(doc_id: int | None, folds: int = 10) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


class _Group:
    """Tokens of a group: ``token`` and ``before`` as indexes of the distinct tokens ``u``; ``train`` by token."""

    def __init__(self, table: pa.Table):
        t = Texts(table["text"], lower=True)
        self.counts = t.counts + 1
        self.held = np.array([held(x) for x in table["doc_id"].to_pylist()], bool)
        ends = np.cumsum(self.counts) - 1
        h = np.empty(len(t.starts) + t.n, np.uint64)
        is_end = np.zeros(len(h), bool)
        is_end[ends] = True
        h[is_end], h[~is_end] = END, t.hashes()
        self.u, token = np.unique(h, return_inverse=True)
        self.token = token.astype(np.int64)
        self.train = np.repeat(~self.held, self.counts)
        self.before = np.empty(len(h), np.int64)
        self.before[1:] = self.token[:-1]
        self.before[np.r_[0, ends[:-1] + 1]] = np.searchsorted(self.u, END)  # as many starts as ends
        self.own = np.bincount(self.token[self.train], minlength=len(self.u))

    def dealt(self, b: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Where the distinct tokens go, in the order in which their buckets get them."""
        return dealt((self.u >> np.uint64(20)).astype(np.int64) % b, {"at": np.arange(len(self.u))})

    def told(self, answers: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts over all groups, and which tokens other groups have."""
        c, shared = np.zeros(len(self.u), np.int64), np.zeros(len(self.u), bool)
        at = self.dealt(b)[2]["at"]
        c[at], shared[at] = answers >> 1, (answers & 1) == 1
        return c, shared

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (v, w) as indexes, which pair each token ends, and the pairs' counts in training texts."""
        pairs, which = np.unique(self.before * len(self.u) + self.token, return_inverse=True)
        return pairs // len(self.u), pairs % len(self.u), which, np.bincount(which[self.train], minlength=len(pairs))


class _Wide:
    """The bigrams of a group that others can have, as rows in the order in which their buckets get them (long counts take several)."""

    def __init__(self, x: _Group, shared: np.ndarray, b: int):
        self.left, self.right, self.which, self.own = x.bigrams()
        self.at = np.flatnonzero(shared[self.left] & shared[self.right])
        bucket, self.h = _name(x.u, self.left[self.at], self.right[self.at], b)
        k = self.own[self.at]
        times = np.maximum(-(-k // 65535), 1)
        row = np.repeat(np.arange(len(k)), times)
        part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        self.to, self.bounds, cols = dealt(bucket[row], {"row": row, "k": np.minimum(k[row] - part * 65535, 65535)})
        self.row, self.k = cols["row"], cols["k"].astype("<u2")


def _name(u: np.ndarray, v: np.ndarray, w: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(u[v] * np.uint64(0x9E3779B97F4A7C15) + u[w])
    return (h >> np.uint64(40)).astype(np.int64) % b, h & np.uint64((1 << 40) - 1)


def _octave(c: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(c, 1).astype(np.float64))[1] - 1


def _ratio_bins(bucket: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Token counts by (bucket, bin of the deleted ratio), for bigrams with counts c."""
    log = np.rint(STEPS * np.log10(np.maximum(c - 1, 1))).astype(np.int64) + x.astype(np.int64) + 1
    bins = np.where(c > 1, np.clip(log, 1, BINS - 1), 0)
    return np.bincount(bucket.astype(np.int64) * BINS + bins, weights=c, minlength=BUCKETS * BINS)


def weights_by_em(histogram: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weight of each bucket from (bucket, bin) token counts."""
    ratio = np.r_[0.0, 10.0 ** ((np.arange(1, BINS) - 1 - ZERO) / STEPS)]
    out = np.zeros(BUCKETS)
    for i, row in enumerate(histogram.reshape(BUCKETS, BINS)):
        if row[1:].any():
            lam = 0.5
            for _ in range(rounds):
                post = lam * ratio / (lam * ratio + 1 - lam)
                lam = min(float((row * post).sum() / row.sum()), 1 - 1e-6)
            out[i] = lam
    return out


def _answers(told: pa.Table, kind: int) -> np.ndarray:
    """What the buckets answered, in the order of buckets."""
    rows = told.filter(pa.compute.equal(told["kind"], kind)).sort_by("n")
    return unpacked(rows["es"], np.int64)


def _message(g, kind: int, es=None, n=None, v=None, weights=None) -> pa.Table:
    """Rows of a message; n also holds the bucket that an answer comes from."""
    m = len(g)
    cols = [pa.array(np.asarray(g, np.int32)), pa.array(np.full(m, kind, np.int32))]
    cols += [pa.nulls(m, t.type) if x is None else x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x, t in zip((es, n, v, weights), list(SCHEMA)[2:], strict=True)]
    return pa.Table.from_arrays(cols, schema=SCHEMA)


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    total = text_bytes(docs)
    g = groups_for(spark, total)
    b = buckets_for(spark, total // 12)
    texts = grouped_texts(docs, g)

    def words(table: pa.Table) -> pa.Table:
        x = _Group(table)
        to, bounds, cols = x.dealt(b)
        return pa.table({"b": to, "g": np.full(len(to), table["g"][0].as_py(), np.int32), "hs": packed(x.u[cols["at"]], bounds), "ks": packed(x.own[cols["at"]].astype("<u4"), bounds)})

    def sums(table: pa.Table) -> pa.Table:
        """Kind 0: twice the counts of a group's words, plus 1 if others have the word; kind 2: tokens and distinct tokens of the bucket."""
        h, k = unpacked(table["hs"], np.uint64), unpacked(table["ks"], "<u4").astype(np.int64)
        u, which, m = np.unique(h, return_inverse=True, return_counts=True)
        c = np.bincount(which, weights=k, minlength=len(u)).astype(np.int64)
        bounds = np.r_[0, np.cumsum(lengths(table["hs"], np.uint64))]
        out = _message(table["g"].to_numpy(), 0, packed((2 * c + (m > 1))[which], bounds), n=table["b"].cast(pa.int64()))
        return pa.concat_tables([out, _message([-1], 2, n=pa.array([int(c.sum())]), v=pa.array([int((c > 0).sum())]))])

    def pairs(table: pa.Table, told: pa.Table) -> pa.Table:
        """Bigrams to their buckets (es), and the histogram of those that this group alone can have (bins)."""
        if not len(table):
            return PAIRS.empty_table()
        x = _Group(table)
        n, v = _totals(told)
        c, shared = x.told(_answers(told, 0), b)
        y = _Wide(x, shared, b)
        p = (c[y.right] + 0.1) / (n + 0.1 * (v + 1))
        q = np.clip(np.rint(-STEPS * np.log10(np.maximum(c[y.left] - 1, 1) * p)) + ZERO, 0, 255).astype(np.uint8)
        q = np.where(c[y.left] > 1, q, 0).astype(np.uint8)
        bucket = _octave(c[y.left]).astype(np.uint8)
        narrow = np.ones(len(q), bool)
        narrow[y.at] = False
        own = _ratio_bins(bucket[narrow], q[narrow], y.own[narrow])
        name = np.ascontiguousarray(y.h[y.row]).view(np.uint8).reshape(-1, 8)[:, :5]
        name = np.ascontiguousarray(name).view("V5").ravel()
        gid, at, m = table["g"][0].as_py(), y.at[y.row], len(y.to)
        rows = pa.table({"b": y.to, "g": np.full(m, gid, np.int32), "hs": packed(name, y.bounds), "ks": packed(y.k, y.bounds), "cs": packed(bucket[at], y.bounds), "xs": packed(q[at], y.bounds), "bins": pa.nulls(m, pa.binary())})
        some = np.flatnonzero(own)
        bins = np.zeros(len(some), BIN)
        bins["bin"], bins["k"] = some, own[some]
        extra = pa.table({"b": np.array([gid % b], np.int32), "g": np.array([gid], np.int32), **{k: pa.nulls(1, pa.binary()) for k in ("hs", "ks", "cs", "xs")}, "bins": packed(bins, np.array([0, len(bins)]))})
        return pa.concat_tables([rows.cast(PAIRS), extra.cast(PAIRS)])

    def pair_sums(table: pa.Table) -> pa.Table:
        """Kind 1: the counts of a group's bigrams; kind 3: histograms."""
        rows = table.filter(table["hs"].is_valid())
        name = unpacked(rows["hs"], np.uint8).reshape(-1, 5)
        h = np.zeros((len(name), 8), np.uint8)
        h[:, :5] = name
        u, first, which = np.unique(h.view(np.uint64).ravel(), return_index=True, return_inverse=True)
        c = np.bincount(which, weights=unpacked(rows["ks"], "<u2"), minlength=len(u)).astype(np.int64)
        hist = _ratio_bins(unpacked(rows["cs"], np.uint8)[first], unpacked(rows["xs"], np.uint8)[first], c)
        extra = unpacked(table["bins"], BIN)
        np.add.at(hist, extra["bin"].astype(np.int64), extra["k"])
        bounds = np.r_[0, np.cumsum(lengths(rows["ks"], "<u2"))]
        some = np.flatnonzero(hist)
        bins = np.zeros(len(some), BIN)
        bins["bin"], bins["k"] = some, hist[some]
        out = _message(rows["g"].to_numpy(), 1, packed(c[which], bounds), n=rows["b"].cast(pa.int64()))
        return pa.concat_tables([out, _message([-1], 3, packed(bins, np.array([0, len(bins)])))])

    def learn(table: pa.Table) -> pa.Table:
        e = unpacked(table["es"], BIN)
        hist = np.zeros(BUCKETS * BINS)
        np.add.at(hist, e["bin"].astype(np.int64), e["k"])
        return pa.table({"weights": pa.array([weights_by_em(hist).tolist()], pa.list_(pa.float64()))})

    def part_of_hist(table: pa.Table) -> pa.Table:
        e = unpacked(table["es"], BIN)
        u, at = np.unique(e["bin"], return_inverse=True)
        bins = np.zeros(len(u), BIN)
        bins["bin"], bins["k"] = u, np.bincount(at, weights=e["k"], minlength=len(u))
        return pa.table({"one": np.zeros(1, np.int32), "es": packed(bins, np.array([0, len(bins)]))})

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return RESULT.empty_table()
        x = _Group(table)
        n, v = _totals(told)
        kinds = told["kind"].to_numpy()
        lam = np.array(told.filter(pa.array(kinds == 4))["weights"][0].as_py())
        c, shared = x.told(_answers(told, 0), b)
        y = _Wide(x, shared, b)
        left, right, which, k = y.left, y.right, y.which, y.own.astype(np.int64)
        k[y.at[y.row]] = _answers(told, 1)
        p = (c + 0.1) / (n + 0.1 * (v + 1))
        cv = c[left]
        weight = np.where(cv > 0, lam[_octave(cv)], 0.0)
        logs = np.log10(weight * k / np.maximum(cv, 1) + (1 - weight) * p[right])
        doc = np.repeat(np.arange(len(x.counts)), x.counts)
        add = lambda y: np.bincount(doc, weights=y, minlength=len(x.counts))
        m = len(x.counts)
        return pa.Table.from_arrays([table["doc_id"].combine_chunks(), pa.array(x.held), pa.array(x.counts.astype(np.int64)), pa.array(add((c > 0)[x.token]).astype(np.int64)), pa.array(np.full(m, n, np.int64)), pa.array(add(np.log10(p)[x.token])), pa.array(add(logs[which]))], schema=RESULT)

    one = texts.groupBy("g").applyInArrow(words, "b int, g int, hs binary, ks binary")
    said = one.groupBy("b").applyInArrow(sums, MESSAGE)
    totals = said.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g")
    none = F.lit(None).cast("binary").alias("es")
    totals = totals.select(everywhere, F.lit(2).alias("kind"), none, "n", "v", F.lit(None).cast("array<double>").alias("weights"))
    counts = said.where("kind = 0").unionByName(totals)
    two = texts.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(pairs, "b int, g int, hs binary, ks binary, cs binary, xs binary, bins binary")
    heard = two.groupBy("b").applyInArrow(pair_sums, MESSAGE)
    parts, many = heard.where("kind = 3").select(F.lit(0).alias("one"), "es"), b
    while many > MERGED:  # level by level, so that no task sees the histograms of all buckets
        many = -(-many // MERGED)
        parts = parts.select("es", F.pmod(F.xxhash64("es"), F.lit(many)).alias("part")).groupBy("part").applyInArrow(part_of_hist, "one int, es binary")
    learned = parts.groupBy("one").applyInArrow(learn, "weights array<double>")
    no = F.lit(None).cast("long")
    learned = learned.select(everywhere, F.lit(4).alias("kind"), none, no.alias("n"), no.alias("v"), "weights")
    all_ = counts.unionByName(heard.where("kind = 1")).unionByName(learned)
    return texts.groupBy("g").cogroup(all_.groupBy("g")).applyInArrow(finish, OUT)


BIN = np.dtype([("bin", "<u4"), ("k", "<f8")])
PAIRS = pa.schema([("b", pa.int32()), ("g", pa.int32()), *((k, pa.binary()) for k in ("hs", "ks", "cs", "xs", "bins"))])
RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _totals(told: pa.Table) -> tuple[int, int]:
    t = told.filter(pa.compute.equal(told["kind"], 2))
    return t["n"][0].as_py(), t["v"][0].as_py()
