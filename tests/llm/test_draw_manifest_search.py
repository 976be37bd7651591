"""Resampling, the manifest and the index against plain versions, and every operator's SQL on the small tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import checksums, exact_dedup, merkle, mixing, permutation_index, queries, resampling
from tessera.llm.common import Texts, numbered
from tests.llm.test_operators import corpus, rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    extra = "doc_id long, text string, lang string, source string, n_chars long, h long, idx string, g string"
    spark.createDataFrame([(*r, None if i % 5 else i, 7, "x", "y") for i, r in enumerate(corpus())], extra).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(t, 1) for t in TARGET], "text string, bucket int").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


TARGET = ("The cat sat on THE old tree", None, " ", "le chat près de la rivière 2024")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_operator_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    got, want = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLES[name])
    names = sorted(want.columns)
    assert set(names) <= set(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.project(", ".join(names)).fetchall())


def test_checksums_of_words_and_pairs():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abz09é短"), rng.integers(1, 70))) for _ in range(20)) for _ in range(20)] + [None, "", "one", "x" * 5000 + " y", "y " + "x" * 5000]
    t = Texts(pa.array(texts), lower=True)
    crc = checksums.of_words(t)
    words = t.words(np.arange(len(t.starts)))
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    first = np.flatnonzero(np.r_[t.doc_of_word()[1:] == t.doc_of_word()[:-1], False])
    assert checksums.of_pairs(t, crc, first).tolist() == [zlib.crc32(words[i] + b" " + words[i + 1]) for i in first]


def plain_features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(w), [zlib.crc32(x) % 10000 for x in [*w, *(a + b" " + b for a, b in zip(w, w[1:], strict=False))]]


def plain_draw(docs, target):
    s, t = Counter(), Counter()
    for r in docs:
        s.update(plain_features(r[1])[1])
    for x in target:
        t.update(plain_features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for doc_id, text, *_ in docs:
        n, f = plain_features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(order[: 25 * len(order) // 100])}
    return Counter((r[0], r[2], r[3], r[4], drawn.get(id(r))) for r in out)


def test_resampling(spark, data):
    got = Counter(map(tuple, queries.op11_resampling(spark, data).collect()))
    want = plain_draw(corpus(), TARGET)
    assert got == want and max(r[4] or 0 for r in want) > 20


def test_resampling_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "b a"), (1, "b a"), (None, None), (None, "..."), (2, "A " * 30)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = rows(resampling.resampled(docs, none, buckets=7, percent=100, least_words=0))
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5] and all(r["weight"] == 0 for r in got if not r["n_features"])
    assert {r["n_features"] for r in got if r["doc_id"] == 2} == {59}
    assert resampling.resampled(docs.limit(0), docs).count() == 0
    assert {r["rank"] for r in rows(resampling.resampled(docs, docs))} == {None}
    picked = resampling.drawn(docs.where("doc_id = 2"), resampling.resampled(docs.where("doc_id = 2"), docs, percent=100))
    assert [(r["doc_id"], r["rank"]) for r in rows(picked)] == [(2, 1)]
    with pytest.raises(ValueError, match="16-bit"):
        resampling.resampled(docs, docs, buckets=70_000)


def test_draws_follow_the_target(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}{j}" for j in range(50)], 40).tolist())) for i in range(400)]
    target = spark.createDataFrame([(" ".join(f"a{j}" for j in rng.integers(0, 50, 2000)),)], "text string")
    got = rows(resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), target))
    drawn = [r["doc_id"] for r in got if r["rank"]]
    assert len(drawn) == 100 and sum(i % 2 == 0 for i in drawn) > 60


def test_numbers_within_groups(spark):
    data = [(g, v) for g, n in (("a", 700), ("b", 1), ("c", 30)) for v in range(n)]
    df = spark.createDataFrame(data, "k string, v int").repartition(5)
    got = rows(numbered(df, [F.desc("v")], "k"))
    assert sorted((r["k"], r["v"], r["idx"], r["n"]) for r in got) == sorted((g, v, n - 1 - v, n) for g, n in (("a", 700), ("b", 1), ("c", 30)) for v in range(n))
    same = spark.createDataFrame([(1,)] * 50, "v int")
    assert sorted(r["idx"] for r in rows(numbered(same, [F.col("v")]))) == list(range(50))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The root, and the proof of each node as (side, sibling) or None."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, at in zip(proofs, where, strict=True):
            other = at ^ 1
            p.append(("R" if other > at else "L", nodes[other]) if other < len(nodes) else None)
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return nodes[0], proofs


def plain_manifest(table):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda doc_id, text, lang, source, n: h(*map(part, (doc_id, source, lang, n, text)))
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in table:
        changed = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 0 and n is not None
        mine = leaf(doc_id, text, lang, source, n)
        groups[lang].append((doc_id is None, doc_id or 0, mine, doc_id, leaf(doc_id, text, lang, source, n + 1) if changed else mine))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), *plain_tree([r[2] for r in sorted(groups[g])])) for g in order}
    root, tops = plain_tree([trees[g][1] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (*_, mine, doc_id, other), proof in zip(trees[g][0], trees[g][2], strict=True):
            node = other
            for s in proof + top:
                node = h(node) if s is None else h(s[1], node) if s[0] == "L" else h(node, s[1])
            out.append((doc_id, mine, trees[g][1], root, h(*(s[1] for s in proof + top if s)), node, node == root))
    return Counter(out)


def test_manifest(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = Counter(map(tuple, queries.op12_manifest(spark, data).collect()))
    assert got == plain_manifest(map(tuple, docs))
    assert {k[-1] for k in got} == {True, False} and len({k[2] for k in got}) == 3


@pytest.mark.parametrize("sizes", [(1,), (2,), (1, 1), (5, 1, 3), (17, 4, 1, 2, 9)])
@pytest.mark.parametrize("bits", [1, 2, 3, 8])
def test_trees_of_any_size_and_step(spark, sizes, bits):
    docs = [(i, f"t{i}", f"l{g}" if g else None, None, i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    out = merkle.manifest(df, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, merkle.leaf(n_chars=F.col("n_chars") + 1)), bits=bits)
    folded = merkle.fold(F.col("other"), F.col("proof"))
    got = out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256), folded, folded == F.col("root"))
    assert Counter(map(tuple, got.collect())) == plain_manifest(docs)


def brute(vectors, ask, k):
    """The k nearest of each query row: (query_id, rank, vec_id)."""
    good = [(i, np.array(v, float)) for i, v in vectors if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, x) in enumerate(good):
        if q is not None and ask(q):
            d = sorted((float(np.sqrt(((y - x) ** 2).sum())), i is None, i or 0) for j, (i, y) in enumerate(good) if j != at and len(y) == len(x))
            out += [(q, r + 1, None if none else i, round(s, 9)) for r, (s, none, i) in enumerate(d[:k])]
    return Counter(out)


def test_nearest_with_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[0][1]) for i in range(40)] + [(0, vectors[0][1]), (None, vectors[0][1]), (None, vectors[3][1])]
    vectors += [(300, None), (400, [0.0] * 8), (500, [math.nan] * 8), (600, [1.0, None] * 4), (700, [1.0, 2.0]), (701, [1.5, 2.0]), (800, [math.inf] * 8), (900, [])]
    df = spark.createDataFrame([(*v, 3, "x") for v in vectors], "vec_id long, embedding array<double>, row int, dim string")
    monkeypatch.setattr(permutation_index, "SHARD_ROWS", 30)
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in rows(permutation_index.nearest(df, F.col("vec_id") % 100 == 0)))
    assert got == brute(vectors, lambda i: i % 100 == 0, 10)
    few = df.where("vec_id in (700, 701)")
    assert [tuple(r) for r in permutation_index.nearest(few, F.col("vec_id") % 100 == 0).collect()] == [(700, 1, 701, 0.5)]
    assert permutation_index.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_recall(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    if kind == "clusters":
        x = x * 0.3 + rng.normal(size=(20, 64))[rng.integers(20, size=4000)]
    x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    monkeypatch.setattr(permutation_index, "LEAST", 1)
    got = {(r["query_id"], r["vec_id"]) for r in rows(permutation_index.nearest(df, F.col("vec_id") % 100 == 0))}
    d = ((x[::100, None] - x[None]) ** 2).sum(2)
    d[np.arange(40), np.arange(40) * 100] = 9
    want = {(int(q) * 100, int(i)) for q in range(40) for i in np.argsort(d[q])[:10]}
    assert len(got & want) / len(want) >= 0.9


def test_footrule_is_that_of_whole_orders():
    rng = np.random.default_rng(6)
    x, pivots, near = rng.normal(size=(300, 6)), rng.normal(size=(20, 6)), 7
    order = permutation_index.orders(x, pivots, near)
    place = np.full((300, 20), near)
    np.put_along_axis(place, order.astype(int), np.arange(near)[None], 1)
    query = rng.normal(size=6)
    mine = permutation_index.orders(query[None], pivots, near)[0]
    at = np.full(20, near)
    at[mine] = np.arange(near)
    rule = np.abs(place - at).sum(1)
    rows_ = [{"kind": 0, "a": x.tobytes(), "b": np.stack([np.arange(300), np.zeros(300, int)], 1).tobytes(), "c": np.ones(300, np.int64).tobytes()}]
    for p in range(20):
        who, where = np.nonzero(order == p)
        rows_.append({"kind": 1, "key": p, "a": who.astype(np.uint32).tobytes(), "b": where.astype(np.uint16).tobytes()})
    shard = permutation_index.Shard(6, rows_, 3, 0.0)
    shard.most = 40
    got = shard.nearest(query, mine, None)
    inside = np.flatnonzero(rule <= np.sort(rule)[39])
    d = np.sqrt(((x[inside] - query) ** 2).sum(1))
    assert [i for _, _, i in got] == inside[np.argsort(d)][:3].tolist()


def test_copies_over_many_turns_are_one_group(spark, monkeypatch):
    """A hot content in every turn of stage 1: rows, not distinct contents, end a turn, and salts follow the turns."""
    monkeypatch.setattr(exact_dedup, "LOCAL_ROWS", 20)
    monkeypatch.setattr(exact_dedup, "TURNS", 1)
    docs = [(i, "the same  text" if i % 3 else f"own {i}") for i in range(900)]
    got = rows(exact_dedup.exact_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    hot = [r for r in got if r["keep_id"] == 1]
    assert len(hot) == 600 and {r["group_size"] for r in hot} == {600} and [r["doc_id"] for r in hot if r["kept"]] == [1]
    assert all(r["kept"] and r["group_size"] == 1 for r in got if r["doc_id"] % 3 == 0)


def test_a_shard_of_several_parts_keeps_its_order(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 9), f"s{i % 3}", "x") for i in range(600)], "doc_id long, text string, source string, lang string")
    whole = [tuple(r) for r in mixing.mixed(docs, shards=4).select("mix_shard", "mix_order", "doc_id").collect()]
    monkeypatch.setattr(mixing, "PART_BYTES", 1000)
    cut = mixing.mixed(docs, shards=4)
    sizes = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 12 and max(sizes) < len(whole) / 6
    assert [tuple(r) for r in cut.select("mix_shard", "mix_order", "doc_id").collect()] == whole
