"""Personal data by fixed patterns and a skip-chain conditional random field over each document.

Patterns give the base spans (email, ip, card, phone), which always stay. The field's nodes are a text's words that
hold a digit, an at sign or one written in brackets (``[at]``). Neighbouring nodes share chain potentials; nodes whose words are equal or similar (same
letters and digits without case and punctuation; for numbers, the same last nine digits) share skip potentials,
however far apart they are. Sum-product messages are passed over this loopy graph, base nodes held at their label,
so a label that one mention has carries over to mentions that no pattern fits. Every text with nodes is inferred, also
one without base spans or skip edges. Nodes outside base spans whose label is at least ``sure`` become spans too.
A node can only have kinds whose check its word passes (Luhn's for cards, parts of addresses, numbers of digits, an at sign), so a word
that failed the pattern's check is never labelled by its neighbours.

Weights of shapes of words, chain and skip potentials are fitted together, by the pseudo-likelihood of each node's label
given its neighbours' labels, on the base labels of all texts with such words. A node without a base label counts as one of no kind,
unless a word that is alike has a label that it may have itself: the patterns can't tell what that one is, so it is left out. Weights have a prior of zero; skip potentials one by which alike words agree (``AGREE``, and less so on no
label, ``OPEN``), which holds where the corpus has no repeated words. Executors count nodes by shape, label and neighbourhood
(in which a skip neighbour's label counts once); the driver sees these counts alone. Their number is bounded by the shapes
that there are, as the share of digits in a word goes into ``BINS`` bins, each with its mean.

Defined results: a null text is empty and has no spans. Offsets are code points, ends exclusive. Each row is read on
its own, so repeated rows get equal spans. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, slices

KINDS = ("email", "ip", "card", "phone")
_NONE = len(KINDS) + 1
#: Bins of a word's share of digits, and the unit in which shares are summed.
BINS, UNIT = 16, 1 << 20
#: What equal words' labels are worth before any is seen, for kinds and for no label; weights of the priors.
AGREE, OPEN = 4.0, 2.0
DECAY, TRUST = 1e-4, 1e-4
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# A match starts where its run starts or the one before ended; so each pattern is searched in linear time.
_LOCAL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_AT, _EMAIL = re.compile(_LOCAL), re.compile(r"(?<![A-Za-z0-9._%+-])" + _LOCAL)
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_TEXT = r"[0-9@]|[\[({]at[\])}]"
_ANY = re.compile(_ANY_TEXT)
_AT, _DOT = re.compile(r"[\[({]at[\])}]"), re.compile(r"[\[({]dot[\])}]")
_NODE = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches that pass their checks, sorted."""
    out = []
    if not _ANY.search(text):
        return out
    if "@" in text:
        at = 0
        while m := _EMAIL_AT.match(text, at) or _EMAIL.search(text, at):
            out.append((m.start(), 0, m.end()))
            at = m.end()
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shapes(words: list[str]) -> np.ndarray:
    """Features of words: counts in ranges, which characters there are, and a constant."""
    out = np.zeros((len(words), 20))
    for row, w in zip(out, words, strict=True):
        d = sum(c in "0123456789" for c in w)
        row[0], row[1] = 1, "@" in w
        row[2 + int(np.searchsorted([1, 3, 5, 7, 9, 13, 19], d))] = 1
        row[10], row[11], row[12] = "." in w, w.count(".") == 3, w.startswith("+")
        row[13], row[14], row[15] = "(" in w or ")" in w, "-" in w, any(c.isalpha() for c in w)
        row[16], row[17], row[18] = "=" in w or ":" in w or "/" in w, w.isupper(), w[:1] in "\"'"
        row[19] = d / len(w)
    return out


def same_key(word: str) -> str:
    """What equal or similar words share; empty for words too short to tell."""
    digits = re.sub("[^0-9]", "", word)
    plain = re.sub(r"[\W_]", "", _DOT.sub(".", _AT.sub("@", word.lower())))
    if len(digits) >= 9 and len(digits) == len(plain):
        return digits[-9:]
    return plain if len(plain) >= 7 else ""


def kinds_allowed(word: str) -> list[bool]:
    """Whether a word may have no label, and each kind."""
    digits = re.sub("[^0-9]", "", word)
    parts = re.findall("[0-9]+", word)
    ip = len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts)
    card = 14 <= len(digits) <= 19 and _luhn(digits)
    return [True, "@" in word or bool(_AT.search(word.lower())), ip, card, 2 <= len(digits) <= 15]


class Graph:
    """A text's nodes, labels that base spans give them (0: none), and edges: chain and skip."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.nodes = [(m.start(), m.end()) for m in _NODE.finditer(text) if _ANY.search(m[0])]
        self.words = [text[s:e] for s, e in self.nodes]
        self.label = np.zeros(len(self.nodes), np.int64)
        starts = np.array([s for s, _ in self.nodes], np.int64)
        ends = np.array([e for _, e in self.nodes], np.int64)
        for s, kind, e in reversed(base):
            self.label[np.searchsorted(ends, s, side="right") : np.searchsorted(starts, e)] = kind + 1
        self.allowed = np.array([kinds_allowed(w) for w in self.words], bool).reshape(-1, _NONE)
        self.allowed[np.arange(len(self.words)), self.label] = True
        near = np.flatnonzero(starts[1:] - ends[:-1] <= 2) if len(starts) > 1 else np.zeros(0, np.int64)
        self.chain = np.stack([near, near + 1], 1)
        seen: dict[str, tuple[int, int]] = {}
        skip = []
        for i, w in enumerate(self.words):
            if key := same_key(w):
                first, last = seen.get(key, (i, i))
                skip += [(j, i) for j in {first, last} if j != i]
                seen[key] = (first, i)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)


class Model:
    """Weights of shapes by label, and log potentials of chain (left, right) and skip edges (symmetric)."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    def beliefs(self, g: Graph, rounds: int = 8) -> np.ndarray:
        """Label probabilities of nodes by loopy sum-product."""
        k = len(KINDS) + 1
        z = shapes(g.words) @ self.node
        phi = np.exp(z - z.max(1, keepdims=True))
        phi /= phi.sum(1, keepdims=True)
        phi = np.where(g.allowed, np.maximum(phi, 1e-300), 1e-300)
        held = g.label > 0
        phi[held] = 1e-9
        phi[held, g.label[held]] = 1
        edges = np.concatenate([g.chain, g.skip])
        if not len(edges):
            return phi
        pot = np.concatenate([np.broadcast_to(np.exp(self.chain), (len(g.chain), k, k)), np.broadcast_to(np.exp(self.skip), (len(g.skip), k, k))])
        src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        msg = np.full((len(src), k), 1 / k)
        for _ in range(rounds):
            log = np.log(phi)
            np.add.at(log, dst, np.log(msg))
            out = log[src] - np.log(msg[back])
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.einsum("ei,eij->ej", out, pot)
            msg = 0.5 * msg + 0.5 * new / new.sum(1, keepdims=True)
        log = np.log(phi)
        np.add.at(log, dst, np.log(msg))
        out = np.exp(log - log.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def spans(self, text: str, sure: float = 0.9) -> list[tuple[int, int, int, bool]]:
        """(start, kind, end, base) of all spans, sorted."""
        base = base_spans(text)
        out = [(s, k, e, True) for s, k, e in base]
        if _ANY.search(text):
            g = Graph(text, base)
            open_ = np.flatnonzero(g.label == 0)
            if len(open_):
                p = self.beliefs(g)
                best = p.argmax(1)
                for i in open_[(best[open_] > 0) & (p[open_, best[open_]] >= sure)]:
                    s, e = g.nodes[i]
                    w = g.words[i]
                    s, e = s + len(w) - len(w.lstrip("\"'([<")), e - (len(w) - len(w.rstrip("\"')]>.,;:!?")))
                    if s < e:
                        out.append((s, int(best[i]) - 1, e, False))
        return sorted(out)


_AROUND = _NONE * (_NONE + 1) * (_NONE + 1) * (1 << _NONE)


def _counts(texts: Iterable[str]) -> np.ndarray:
    """Rows (key, n, ratio): nodes by shape, label, labels to the left and right (``_NONE`` without) and which labels alike words have."""
    keys, ratios = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text in texts:
        g = Graph(text, base_spans(text))
        n = len(g.words)
        marked = np.zeros((n, _NONE), bool)  # labels but none that alike words have
        i, j = np.r_[g.skip[:, 0], g.skip[:, 1]], np.r_[g.skip[:, 1], g.skip[:, 0]]
        marked[i, g.label[j]] = True
        told = ~((g.label == 0) & (marked[:, 1:] & g.allowed[:, 1:]).any(1))
        shown = np.where(told, g.label, _NONE)  # the others' labels are not known to their neighbours either
        left, right = np.full(n, _NONE), np.full(n, _NONE)
        right[g.chain[:, 0]], left[g.chain[:, 1]] = shown[g.chain[:, 1]], shown[g.chain[:, 0]]
        alike = np.zeros((n, _NONE), bool)
        alike[i[told[j]], g.label[j[told[j]]]] = True
        around = ((g.label * (_NONE + 1) + left) * (_NONE + 1) + right) * (1 << _NONE) + alike @ (1 << np.arange(_NONE))
        for lo in range(0, len(g.words), 1 << 16):  # part by part to bound memory
            part = np.flatnonzero(told[lo : lo + (1 << 16)])
            x = shapes(g.words[lo : lo + (1 << 16)])[part]
            cell = x[:, :19].astype(np.int64) @ (1 << np.arange(19)) | np.minimum(x[:, 19] * BINS, BINS - 1).astype(np.int64) << 19
            keys.append(cell * _AROUND + around[lo : lo + (1 << 16)][part])
            ratios.append(np.rint(x[:, 19] * UNIT).astype(np.int64))
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    ratio = np.zeros(len(u), np.int64)
    np.add.at(ratio, at, np.concatenate(ratios))
    return np.stack([u, np.bincount(at, minlength=len(u)), ratio], 1)


def _solve(counts: np.ndarray, steps: int = 400, rate: float = 0.1) -> Model:
    """Shape weights, chain and skip potentials together, by the pseudo-likelihood of labels and its gradient."""
    k = _NONE
    prior = np.eye(k) * AGREE
    prior[0, 0] = OPEN
    w, chain, skip = np.zeros((20, k)), np.zeros((k, k)), prior.copy()
    key, n, ratio = counts.T
    total = n.sum()
    if not total:
        return Model(w, chain, skip)
    cell, around = key // _AROUND, key % _AROUND
    alike = (around[:, None] >> np.arange(k) & 1).astype(float)
    around = around >> k
    one = np.vstack([np.eye(k), np.zeros(k)])  # a neighbour that is not there has no label
    right, left, y = one[around % (k + 1)], one[around // (k + 1) % (k + 1)], one[around // (k + 1) ** 2]
    x = np.c_[cell[:, None] >> np.arange(19) & 1, ratio / n / UNIT]
    share = n[:, None] / total
    flat = [w, chain, skip]
    mean, var = [np.zeros_like(v) for v in flat], [np.zeros_like(v) for v in flat]
    for step in range(1, steps + 1):  # Adam, in full batches: the same counts give the same model
        z = x @ w + left @ chain + right @ chain.T + alike @ skip
        p = np.exp(z - z.max(1, keepdims=True))
        e = (p / p.sum(1, keepdims=True) - y) * share
        s = alike.T @ e
        slopes = [x.T @ e + DECAY * w, left.T @ e + e.T @ right + DECAY * chain, (s + s.T) / 2 + TRUST * (skip - prior)]
        for v, slope, m, q in zip(flat, slopes, mean, var, strict=True):
            m += 0.1 * (slope - m)
            q += 0.001 * (slope * slope - q)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return Model(w, chain, skip)


def fit(texts: list[str], **how) -> Model:
    """Fits the field on texts that are at hand."""
    return _solve(_counts(texts), **how)


def learn(docs: DataFrame) -> Model:
    """Fits the field on all texts, whatever their length; repeated texts count as often as they occur."""
    names = ["key", "n", "ratio"]

    def f(batches: Batches) -> Batches:
        for b in (part for batch in batches for part in slices(batch, 0)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(_counts(b.column(0).to_pylist()).T)], names)

    have = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike(_ANY_TEXT))
    counts = have.mapInArrow(f, ", ".join(f"{c} long" for c in names)).groupBy("key").agg(F.sum("n").alias("n"), F.sum("ratio").alias("ratio"))
    return _solve(np.array(sorted(tuple(r) for r in counts.collect()), np.int64).reshape(-1, 3))


def found(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, spans (sorted by start and kind; base or added by the field)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def f(batches: Batches) -> Batches:
        for b in (part for batch in batches for part in slices(batch, 1)):
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": x} for s, k, e, x in shared.value.spans(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(f, f"doc_id long, spans {SPAN}")


def redacted(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
            at = s["end"]
    return "".join([*out, text[at:]])
