"""Toxicity of texts by a counterfactual-regularised classifier.

A logistic regression over which words (runs of letters, lower-cased A-Z) a text holds, and which beginnings of words (``STEMS``
bytes), as inflected words share these. To the loss comes, for
each labelled text that names a group of people, the squared change of its score when the named term is swapped for
each other term, so the mention of one group cannot weigh more than that of another; an own penalty keeps the
terms' common weight near zero, so neutral mentions do not make a text toxic.

The labelled sample is bounded: at most ``rows`` labelled rows, those with the smallest hash of their id, whole
texts. Words are chosen by how differently toxic and other texts of the sample hold them. Scoring reads all texts.

Defined results: null and empty texts get the score that the bias gives. Labels that are null or not 0 or 1 are ignored; of several
labels of one id the largest holds. Without labels of both kinds all scores are the smoothed share of toxic ones.
Rows with a null doc_id are scored and never learned from. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_LETTERS, Batches, Texts, slices, within, written

#: Terms that name groups of people, swapped for one another (lower case, single words).
IDENTITY = (
    "women men woman man girls boys gay lesbian bisexual transgender straight queer muslim muslims christian christians jewish jews "
    "hindu hindus buddhist buddhists atheist atheists catholic catholics black white asian asians african africans european europeans "
    "american americans mexican mexicans arab arabs indian indians chinese russian russians immigrant immigrants refugee refugees "
    "foreigner foreigners disabled deaf blind elderly frauen männer juden muslime christen ausländer flüchtlinge femmes hommes juifs "
    "musulmans immigrés étrangers mujeres hombres judíos musulmanes inmigrantes extranjeros"
).split()


#: Bytes at the beginning of a longer word that are a feature of their own.
STEMS = (4, 5, 6, 8)
#: Texts of the sample that must hold a feature.
LEAST = 3


def features_of(t: Texts) -> list[np.ndarray]:
    """Hashes by word: of the word and of each beginning; where a word is no longer than that, the word's own again."""
    whole, size = t.hashes(), t.ends - t.starts
    return [whole, *(np.where(size > k, t.hashes(k) ^ np.uint64(k), whole) for k in STEMS)]


def sets_of(t: Texts) -> list[np.ndarray]:
    """The distinct features of each text."""
    h = np.stack(features_of(t), 1)
    return [np.unique(h[s:e]) for s, e in zip(t.first[:-1], t.first[1:], strict=True)]


def hash_words(words: list[str]) -> np.ndarray:
    return Texts(pa.array(words), lower=True, gaps=NOT_LETTERS).hashes()


class Model:
    """Weights of words (sorted hashes) and a bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(words)
        self.words, self.weights, self.bias = words[order], weights[order], bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        t = Texts(texts, lower=True, gaps=NOT_LETTERS)
        z = np.full(t.n, self.bias)
        if len(self.words):
            found = []
            for h in features_of(t):
                at = np.searchsorted(self.words, h)
                at[at == len(self.words)] = 0
                hit = np.flatnonzero(self.words[at] == h)
                found.append((np.searchsorted(t.first, hit, side="right") - 1) * len(self.words) + at[hit])
            pairs = np.unique(np.concatenate(found))
            z += np.bincount(pairs // len(self.words), weights=self.weights[pairs % len(self.words)], minlength=t.n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def choose(u: np.ndarray, df: np.ndarray, hit: np.ndarray, n: int, pos: float, features: int) -> np.ndarray:
    """The features (of ``u``, sorted) that toxic texts hold most differently, with all of the identity terms', sorted.

    ``df`` of ``n`` texts hold a feature and ``hit`` of the ``pos`` toxic ones.
    """
    a, b = (hit + 0.5) / (pos + 1), (df - hit + 0.5) / (n - pos + 1)
    gain = np.abs(np.log(a / b)) * np.sqrt(np.minimum(df, n - df))
    gain[df < LEAST] = 0
    best = np.argsort(-gain, kind="stable")[:features]
    return np.union1d(u[best[gain[best] > 0]], np.concatenate(_terms()))


def _terms() -> list[np.ndarray]:
    return sets_of(Texts(pa.array(IDENTITY), lower=True, gaps=NOT_LETTERS))


def _held(words: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Places in ``words`` of those that the set holds."""
    return np.searchsorted(words, s[within(s, words)]).astype(np.int32)


def _constant(n: int, pos: float) -> Model:
    rate = (pos + 0.5) / (n + 1)
    return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))


def solve(words: np.ndarray, held: list[np.ndarray], y: np.ndarray, l2: float = 0.1, counterfactual: float = 4.0, steps: int = 12) -> Model:
    """Weights of ``words`` from the places that each text holds, by Newton steps."""
    n, pos, width = len(y), float(y.sum()), len(words)
    x = np.zeros((n, width), np.uint8)
    for i, at in enumerate(held):
        x[i, at] = 1
    terms = _terms()
    k = len(terms)
    group = np.zeros((k, width))  # the features that each term brings
    for i, t in enumerate(terms):
        group[i, np.searchsorted(words, t)] = 1
    # A swap of term i for j in m texts changes scores by what i brings less what j brings: a quadratic form.
    m = x[:, np.searchsorted(words, hash_words(list(IDENTITY)))].sum(0, dtype=float) + 1
    swap = np.diag(m * k + m.sum()) - m[:, None] - m[None, :]
    penalty = counterfactual * group.T @ (swap / k + np.diag(m)) @ group
    penalty[np.diag_indices(width)] += l2
    w, bias = np.zeros(width), _constant(n, pos).bias
    for _ in range(steps):  # the penalty makes the Hessian positive
        gradient = np.r_[penalty @ w, 0.0]
        h = np.zeros((width + 1, width + 1))
        h[:-1, :-1] = penalty
        for lo in range(0, n, 1024):  # block by block to bound memory
            part = x[lo : lo + 1024].astype(np.float32)
            wide = np.c_[part, np.ones(len(part), np.float32)]
            p = 1 / (1 + np.exp(-np.clip(part @ w + bias, -30, 30)))
            gradient += wide.astype(float).T @ (p - y[lo : lo + 1024])
            h += wide.T @ (wide * np.maximum(p * (1 - p), 1e-6)[:, None].astype(np.float32))
        step = np.linalg.solve(h, gradient)
        step /= max(1, np.abs(step).max() / 5)
        w, bias = w - step[:-1], bias - step[-1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(words, w, float(bias))


def fit(sets: list[np.ndarray], y: np.ndarray, features: int = 512, **how) -> Model:
    """Fits the model on sets of word hashes that are at hand."""
    n, pos = len(y), float(y.sum())
    if not 0 < pos < n:
        return _constant(n, pos)
    u, at = np.unique(np.concatenate(sets), return_inverse=True)
    hit = np.bincount(at, weights=np.repeat(y, [len(s) for s in sets]), minlength=len(u))
    words = choose(u, np.bincount(at, minlength=len(u)).astype(float), hit, n, pos, features)
    return solve(words, [_held(words, s) for s in sets], y, **how)


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = 8192, features: int = 512) -> Model:
    """Fits on at most ``rows`` labelled rows of docs that ``train`` (a condition on doc_id) admits, and on ``features``
    features at most besides those of the identity terms; a text with none of them gets the bias alone.

    Spark counts the features; the driver sees those of at least ``LEAST`` sample texts and, of each sample text,
    the places of the chosen ones.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if train is not None:
        y = y.where(train)
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = written(texts.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")), "labelled")
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < pos < n:
        return _constant(n, pos)

    def parts(batches: Batches) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches:
            for b in slices(batch, 2):
                yield b, sets_of(Texts(b.column(2), lower=True, gaps=NOT_LETTERS))

    def counted(batches: Batches) -> Batches:
        for b, sets in parts(batches):
            if sets:
                word, at = np.unique(np.concatenate(sets), return_inverse=True)
                toxic = np.repeat(b.column(1).to_numpy(), [len(s) for s in sets])
                hit = np.bincount(at, weights=toxic, minlength=len(word)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at, minlength=len(word))), pa.array(hit)], ["word", "df", "hit"])

    held_by = sample.mapInArrow(counted, "word long, df long, hit long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("hit").alias("hit")).where(F.col("df") >= LEAST).toArrow()
    u = held_by["word"].to_numpy().view(np.uint64)
    order = np.argsort(u)
    words = choose(u[order], *(held_by[k].to_numpy()[order].astype(float) for k in ("df", "hit")), n, pos, features)

    def held(batches: Batches) -> Batches:
        for b, sets in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_held(words, s).tobytes() for s in sets], pa.binary())], ["doc_id", "y", "held"])

    found = sorted(sample.mapInArrow(held, "doc_id long, y int, held binary").collect())
    return solve(words, [np.frombuffer(r.held, np.int32) for r in found], np.array([r.y for r in found], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with their columns and ``toxicity`` (0 to 1), which replaces a column of that name."""
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def f(batches: Batches) -> Batches:
        for batch in batches:
            for b in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(b.column(at)))], [*b.schema.names, "toxicity"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(f, StructType([*docs.schema.fields, StructField("toxicity", DoubleType())]))
