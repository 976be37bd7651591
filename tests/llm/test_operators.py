"""The corpus operators against brute force, on small tables with nulls, ties, repeated rows and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import embedding_dedup, language_id, mixing, ngram_join, packing, pii, queries, substring_dedup, toxicity

EN = "the cat sat on the mat and looked at the small bird that sang in the old tree near the quiet river while rain fell on every roof in town".split()
FR = "le chat est assis sur le tapis et regarde le petit oiseau qui chante dans le vieil arbre près de la rivière pendant que la pluie tombe".split()


def corpus() -> list[tuple]:
    rng = np.random.default_rng(5)
    pick = lambda words, n: " ".join(rng.choice(words, n).tolist())
    long = pick(EN, 4000)
    passage = pick(EN, 40)
    rows = [(i, pick(EN if i % 3 else FR, 30 + i), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, f"{pick(EN, 15)} {passage} {pick(EN, 9)}", "en", "s1") for i in range(4)]
    near = pick(EN, 200).split()
    for i in range(12):
        w = list(near)
        w[i * 15] = f"x{i}"
        rows.append((200 + i, " ".join(w), "en", None))
    rows += [(300, None, None, None), (301, "", "en", "s0"), (302, " \n\t ", "en", "s0"), (303, long, "en", "s2"), (304, long.replace(" ", "  "), None, "s2")]
    rows += [(305, "two words", "en", "s3"), (306, "two words", "en", "s3"), (307, "Two  words", "fr", "s3"), (308, "12 34 !", "en", "s3"), (309, "é" * 5000, "fr", "s1")]
    rows += [(310, "mail me.now@ex-ample.co.uk or ME.NOW@ex-ample.co.uk, ip 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (555) 123-4567", "en", "s1")]
    rows += [(310, rows[-1][1], "en", "s1"), (None, "no id here at all", "en", "s0"), (None, None, None, None)]
    rows += [(400 + i, f"{pick(EN, 20)} {'awful idiot' if i % 2 else pick(EN, 2)} {pick(EN, 5)}", "en", "s0") for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    rows = [(*r, None, 7, "x") for r in corpus()]
    extra = "doc_id long, text string, lang string, source string, n_chars long, h long, g string"
    spark.createDataFrame(rows, extra).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(400 + i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (401, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("a", "the cat sat on the old tree"), ("b", None), ("c", " "), ("d", "le chat près de la rivière")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", [k for k in queries.QUERIES if k != "pipeline"])
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts of over a million characters, among them copies, beside columns with the names that operators use inside."""
    d = tmp_path_factory.mktemp("odd")
    rng = np.random.default_rng(9)
    long = " ".join(rng.choice([f"w{i}" for i in range(5000)], 200_000).tolist())
    data = [(1, long, "en", "s"), (2, long + " end", "en", "s"), (3, "x" * 1_200_000, "en", "s"), (4, "短" * 400_000, "zh", "s"), (5, "short text", "en", None), (6, None, None, None)]
    clash = ("toxicity", "mix_shard", "mix_order", "row", "e", "c", "h", "g", "key", "n", "__key", "bytes", "part", "digest", "rep", "size", "target")
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in clash)
    spark.createDataFrame([(*r, 0, *clash) for r in data], kind).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("a", "w1 w2 w3")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("name", [k for k in queries.QUERIES if k not in ("pipeline", "op9_embedding_dedup", "op13_nearest")])
def test_very_long_texts_and_clashing_columns(spark, odd, name):
    got = rows(queries.QUERIES[name](spark, odd))
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6}
    by = {r["doc_id"]: r for r in got}
    if name == "op1_substring_dedup":
        assert by[2]["n_removed"] == 200_000 and by[1]["n_words"] == 200_000
    if name == "op4_ngram_join":
        assert by[2]["component_id"] == 1 and by[3]["component_id"] == 3
    if name == "op7_language_id":
        assert by[6]["lang_pred"] == "und"


def test_pipeline_on_very_long_texts_and_clashing_columns(spark, odd):
    assert {r["doc_id"] for r in rows(queries.pipeline(spark, odd))} <= {1, 3, 4, 5, 6}


def test_empty_pipeline(spark, empty):
    assert queries.pipeline(spark, empty).collect() == []


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_substring_dedup(spark, data):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(queries.op1_substring_dedup(spark, data)))
    first, want = {}, Counter()
    docs = [(r[0] if r[0] is not None else math.inf, words(r[1]), r[0]) for r in corpus()]
    for i, w, _ in docs:
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (math.inf, math.inf)), (i, s))
    for i, w, doc_id in docs:
        gone = {p for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (i, s) for p in range(s, s + 20)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        want[doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_covers_meet_every_shift():
    for v, cover in substring_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_exact_dedup(spark, data):
    groups = defaultdict(list)
    for r in corpus():
        groups[re.sub("[\x20\x09-\x0d]+", " ", r[1] or "")].append(r[0])
    got = rows(queries.op10_exact_dedup(spark, data))
    assert len(got) == len(corpus())
    for text, ids in groups.items():
        mine = [r for r in got if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        assert Counter(r["doc_id"] for r in mine) == Counter(ids)
        assert {r["keep_id"] for r in mine} == {min((i for i in ids if i is not None), default=None)} and {r["group_size"] for r in mine} == {len(ids)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [mine[0]["keep_id"]]


def plain_links(docs, n, num, den):
    """Sets, and for each document those that it links with."""
    sets = []
    for r in docs:
        w = [x.lower() if x.isascii() else x for x in words(r[1])]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    link = [[j for j in range(len(docs)) if i != j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] for i in range(len(docs))]
    return sets, link


def least_reached(ids, link):
    out = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in set(link[todo.pop()]) - seen:
                seen.add(j)
                todo.append(j)
        out.append(min((ids[j] for j in seen if ids[j] is not None), default=None))
    return out


@pytest.mark.parametrize("small", [48, 3])
def test_ngram_join(spark, data, monkeypatch, small):
    from tessera.llm import common

    docs = corpus()
    monkeypatch.setattr(ngram_join, "SMALL", small)
    if small == 3:  # hot lists, blocks, relays and hot keys all come into play
        monkeypatch.setattr(ngram_join, "BLOCK", 3)
        monkeypatch.setattr(ngram_join, "FAN", 1)
        monkeypatch.setattr(common, "HOT_KEYS", 10)
    sets, link = plain_links(docs, 4, 85, 100)
    least = least_reached([r[0] for r in docs], link)
    want = Counter((r[0], len(s), c) for r, s, c in zip(docs, sets, least, strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(queries.op4_ngram_join(spark, data))) == want
    table = spark.read.parquet(f"{data}/documents.parquet")
    want = Counter((r[0], c, len(k)) for r, c, k in zip(docs, least, link, strict=True))
    assert Counter((r["doc_id"], r["component_id"], r["n_links"]) for r in rows(ngram_join.similar_groups(table, 4, 85, 100, links=True))) == want


def test_ngram_join_of_clusters_that_share_frequent_words(spark, monkeypatch):
    """Many near copies of a few texts whose words are all frequent: lists stay open, pivots' distances keep clusters apart."""
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    rng = np.random.default_rng(11)
    heads = [rng.choice(["a", "b", "c"], 60).tolist() for _ in range(4)]
    docs = []
    for i in range(80):
        w = list(heads[i % 4])
        w[int(rng.integers(60))] = "abc"[int(rng.integers(3))]
        docs.append((i, " ".join(w)))
    _, link = plain_links(docs, 3, 4, 5)
    got = rows(ngram_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), 3, 4, 5, links=True))
    least = least_reached([r[0] for r in docs], link)
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in got} == {i: (c, len(k)) for i, (c, k) in enumerate(zip(least, link, strict=True))}


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 8)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    got = Counter((r["k"], r["v"]) for r in rows(common.dealt_join(left, right, "k", ["i"])))
    assert got == {("hot", 1): 200, ("k0", 2): 1, ("k3", 3): 1}
    assert common.dealt_join(left, right, "k", ["i"], "left").count() == 301


def test_lm_scoring(spark, data):
    docs = [(r[0], [x.lower() if x.isascii() else x for x in words(r[1])] + ["END"]) for r in corpus()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(t for i, w in docs if not held(i) for t in w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 6)) for i, w in docs)
    got = rows(queries.op3_lm_scoring(spark, data))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    # The model itself: bigrams whose weights by octave of the context come from expectation-maximisation on deleted counts.
    pairs, contexts = Counter(), Counter()
    for i, w in docs:
        if not held(i):
            for a, b in zip(["END", *w], w, strict=False):
                pairs[a, b] += 1
    for (a, _), k in pairs.items():
        contexts[a] += k
    uni = lambda t: (c[t] + 0.1) / (n + 0.1 * (v + 1))
    tokens = defaultdict(list)
    for (a, b), k in pairs.items():
        tokens[int(math.log2(contexts[a]))].append((k, (k - 1) / max(contexts[a] - 1, 1) / uni(b) if k > 1 else 0.0))
    weight = {}
    for octave, rows_ in tokens.items():
        k, ratio = np.array(rows_).T
        lam = 0.5
        for _ in range(60):
            lam = min(float((k * lam * ratio / (lam * ratio + 1 - lam)).sum() / k.sum()), 1 - 1e-6) if ratio.any() else 0.0
        weight[octave] = lam
    scores = defaultdict(list)
    for i, w in docs:
        total = 0.0
        for a, b in zip(["END", *w], w, strict=False):
            lam = weight.get(int(math.log2(contexts[a])), 0.0) if contexts[a] else 0.0
            total += math.log10(lam * pairs[a, b] / max(contexts[a], 1) + (1 - lam) * uni(b))
        scores[i].append(total)
    for r in got:  # ratios are counted in steps of a twelfth of a decade
        assert min(abs(r["score"] - x) / abs(x) for x in scores[r["doc_id"]]) < 0.01, (r["doc_id"], r["score"], scores[r["doc_id"]])
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_packing_round_trip(spark, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r in corpus():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            want[r[0], s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)] += 1
    got = rows(queries.op6_packing(spark, data))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seqs.values():
        at = 0
        for o, k in sorted(pieces):
            assert o == at
            at += k
        assert at <= 2048


def test_packs_are_shortest_first():
    h = {2048: 3, 1500: 4, 700: 2, 500: 9, 10: 1000}
    patterns = packing.shortest_pack_first(h, 2048)
    used = Counter()
    for c, p in patterns:
        assert sum(p) <= 2048
        for x in p:
            used[x] += c
    assert used == h and sum(c for c, _ in patterns) <= 14


def test_encoder_agrees_on_odd_words():
    from tokenizers import Tokenizer

    import pyarrow as pa

    marks = ["\u0308", "\u0331", "\u030c", "\u030a", "\u0307", "\u0345", "\u0338"]
    alphabet = [*"abtTHJWYKIiсЯéÉßΣσςÅ日<>|'’.,0123 ", *marks, "'s", "'T", "don't", "<|endoftext|>", "\xa0", "\u3000", "\x85", "\x1c", "İ", "ﬁ", "👍", "\u200d", "\u2003", "\u212a", " ", " ", "\n"]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 14))) for _ in range(50_000)]
    texts += [chr(c) + chr(m) for c in range(65, 91) for m in range(0x300, 0x370)]
    texts += ["It's NAÏVE, don't! <|endoftext|> <|ENDOFTEXT|> a<b x\x1cy 12345 \u0301e é 日本語 ab'll", "…— 'S 've", None, ""]
    enc, tok = packing.Encoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    ids, n = enc.ids_of(pa.array(texts))
    ends = np.cumsum(n)
    assert enc.wordwise and len(ids) == ends[-1]
    for text, s, e, want in zip(texts, ends - n, ends, tok.encode_batch([x or "" for x in texts], add_special_tokens=False), strict=True):
        assert ids[s:e].tolist() == want.ids, ascii(text)


def test_other_tokenizers_read_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, texts = packing.Encoder(path), ["Two words", None, " a  b ", ""]
    ids, n = enc.ids_of(pa.array(texts))
    assert not enc.wordwise
    assert ids.tolist() == [i for x in texts for i in Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids] and n.tolist()[1] == n.tolist()[3] == 0


def plain_targets(size):
    """Targets by bisection on the level that the capped shares have to reach."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    lo, hi = 0.0, 10.0 * (1 + sum(size.values()))
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2 * size[s], level * weight[s]) for s in names) < 1.5 * sum(size.values()) else (lo, level)
    return {s: min(2 * size[s], hi * weight[s]) for s in names}


def test_mixing(spark, data):
    got = rows(queries.op8_mixing(spark, data))
    assert len(got) == len(corpus())
    size, taken, largest = Counter(), Counter(), Counter()
    source = {(r[0], len(words(r[1]))): r[3] for r in corpus()}
    for r in corpus():
        size[r[3]] += len(words(r[1]))
        largest[r[3]] = max(largest[r[3]], len(words(r[1])))
    want = plain_targets(size)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s], rel=1e-9) and r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["size"] * len([x for x in r["shards"].split(",") if x])
        taken[s] += r["taken"]
    # A source is off by half a block at most; here a block holds one text, or by chance two.
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)
    assert Counter(map(str, got)) == Counter(map(str, rows(queries.op8_mixing(spark, data))))
    assert sum(want.values()) == pytest.approx(1.5 * sum(size.values()))


def test_mix_follows_the_tree(spark, data, monkeypatch):
    before = {(r["doc_id"], r["size"]): r["shards"] for r in rows(queries.op8_mixing(spark, data))}
    monkeypatch.setattr(mixing, "split", lambda q, shards, seed: np.vstack([q, np.zeros((shards - 1, len(q)), np.int64)]))
    after = {(r["doc_id"], r["size"]): r["shards"] for r in rows(queries.op8_mixing(spark, data))}
    assert before != after and {x for v in after.values() for x in v.split(",")} <= {"0", ""}


def test_mix_is_the_same_without_broadcasts(spark, data, monkeypatch):
    want = Counter(map(str, rows(queries.op8_mixing(spark, data))))
    monkeypatch.setattr(mixing, "SENT", 0)
    assert Counter(map(str, rows(queries.op8_mixing(spark, data)))) == want


def test_tree_over_very_many_blocks():
    q = np.full(200_000, 8192, np.int64)
    q[7] = 5 * 10**9
    q[11] = 3
    parts = mixing.split(q, 4, 3)
    assert (parts.sum(0) == q).all() and (parts >= 0).all() and parts.sum(1).max() - parts.sum(1).min() <= 2
    assert abs(parts[0, 7] - q[7] / 4) < 6 * (q[7] * 0.25 * 0.75) ** 0.5
    spread = parts[:, 100:].astype(float)
    assert abs(spread.mean() - 2048) < 1 and abs(spread.std() - (8192 * 0.25 * 0.75) ** 0.5) < 1


def test_mixing_very_many_sources(spark, monkeypatch):
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('a b c ', id) as text", "cast(id % 20000 as string) as source")
    got = mixing.draws(docs, shards=4).selectExpr("count(*) as n", "sum(size * size(draws)) as taken", "sum(target / if(source < 10000, 2, 1)) as t").first()
    assert got.n == 30_000 and abs(got.taken - 1.5 * 4 * 30_000) < 0.5 * 4 * 20_000


def test_mix_is_written_shard_by_shard(spark, data, tmp_path):
    import corpus_pipeline
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{data}/documents.parquet")
    mix = [(r.mix_shard, r.mix_order, r.doc_id, r.text) for r in mixing.mixed(docs).collect()]
    assert [r[:2] for r in mix] == sorted(r[:2] for r in mix) and len({r[0] for r in mix}) > 32
    corpus_pipeline.mix_sources(spark, docs, data).write.parquet(f"{tmp_path}/mix")
    files = sorted((tmp_path / "mix").glob("part-*.parquet"))
    assert [(r["doc_id"], r["text"]) for f in files for r in pq.read_table(f).to_pylist()] == [r[2:] for r in mix]
    shards = Counter((r["doc_id"], int(s)) for r in rows(queries.op8_mixing(spark, data)) for s in r["shards"].split(",") if s)
    assert shards == Counter((r[2], r[0]) for r in mix)


def test_targets_and_tree():
    assert mixing.targets([10, 100, 1000]) == pytest.approx([20, 200, 1445])
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == [0, 7.5]
    q = np.array([5, 0, 1000, 37])
    parts = mixing.split(q, 7, 1)
    assert (parts.sum(0) == q).all() and parts.sum(1).max() - parts.sum(1).min() <= 3


def test_embeddings(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 64))
    vecs = [b for b in base] + [b + 0.3 * rng.normal(size=64) * s for b in base[:10] for s in (0.1, 0.5, 1.0)] + [base[0]] * 5 + [base[1] * 3]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    data += [(500, None), (501, [0.0] * 64), (502, [float("nan")] * 64), (503, [None] * 64), (504, []), (None, data[0][1]), (7, data[7][1]), (505, data[0][1][:8])]
    spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    ok = [i for i, (_, v) in enumerate(data) if v and None not in v and np.isfinite(v).all() and any(v)]
    link = defaultdict(set)
    for i in ok:
        for j in ok:
            x, y = np.array(data[i][1]), np.array(data[j][1])
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                link[i].add(j)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min((data[j][0] for j in seen if data[j][0] is not None), default=None)

    want = Counter((data[i][0], len(link[i]), reach(i)) for i in range(len(data)))
    for block in (2048, 4):
        embedding_dedup.BLOCK, before = block, embedding_dedup.BLOCK
        got = rows(queries.op9_embedding_dedup(spark, str(tmp_path)))
        embedding_dedup.BLOCK = before
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("dim", [3, 64, 384, 768])
@pytest.mark.parametrize("classes", [1000, 10**6, 10**9, 10**12])
def test_recall_of_hashing(dim, classes):
    """Pairs at the threshold that meet, for each number of rotations that so many classes ask for."""
    k = embedding_dedup.rotations_for(dim, classes)
    tables = embedding_dedup.tables_for(dim, k, 0.95, embedding_dedup.PROBES)
    rng = np.random.default_rng(0)
    a, n = rng.normal(size=(200, dim)), rng.normal(size=(200, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * n
    x, y = (embedding_dedup.codes(v, k, tables, embedding_dedup.PROBES).reshape(200, -1).tolist() for v in (a, b))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(x, y, strict=True)]) >= 0.97


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aB9041.+-@_ ()%é"), 60)) for _ in range(4000)] + [r[1] or "" for r in corpus()]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "9" * 30, "+1" + " " * 50, "4111 1111 1111 1111 " * 3]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_pii_long_runs_take_linear_time():
    for t in ("9" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1 " * 100_000):
        pii.base_spans(t)


def test_pii(spark, data):
    got = rows(queries.op2_pii(spark, data))
    want = Counter()
    for r in corpus():
        spans = plain_spans(r[1] or "")
        line = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in spans)
        want[r[0], *(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(line.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    model = pii.fit([r[1] or "" for r in corpus()])
    line = lambda text: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _ in model.spans(text or ""))
    assert Counter((r["doc_id"], r["spans"]) for r in got) == Counter((r[0], line(r[1])) for r in corpus())


def test_beliefs_are_exact_without_loops():
    """All labellings of a chain with one skip edge to a lone word, weighed one by one."""
    rng = np.random.default_rng(8)
    k = len(pii.KINDS) + 1
    half = rng.normal(size=(k, k))
    model = pii.Model(rng.normal(size=(20, k)), rng.normal(size=(k, k)), half + half.T)
    g = pii.Graph("1234567x 22 a@b.co far away from here 1234567X", pii.base_spans("1234567x 22 a@b.co far away from here 1234567X"))
    assert len(g.chain) == 2 and len(g.skip) == 1 and (g.label > 0).sum() == 1
    node, want = pii.shapes(g.words) @ model.node, np.zeros((len(g.words), k))
    for y in np.ndindex(*[k] * len(g.words)):
        if all(g.label[i] in (0, y[i]) and g.allowed[i, y[i]] for i in range(len(y))):
            w = sum(node[i, y[i]] for i in range(len(y))) + sum(model.chain[y[i], y[j]] for i, j in g.chain) + sum(model.skip[y[i], y[j]] for i, j in g.skip)
            for i, v in enumerate(y):
                want[i, v] += math.exp(w)
    assert model.beliefs(g, rounds=60) == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-5)


def test_potentials_are_fitted_together():
    """The gradient of the pseudo-likelihood, by differences of a plain version, is next to zero at the fit but for the priors' pull."""
    texts = [f"mail a{i % 5}@b{i % 5}.com and a{i % 5}@b{i % 5}.com, then 55{i} or +1 (555) 010-{1000 + i}" for i in range(30)] + ["ab1234567 12 AB1234567"] * 3
    model = pii.fit(texts)

    def loss(w, chain, skip):
        total, nodes = 0.0, 0
        for t in texts:
            g = pii.Graph(t, pii.base_spans(t))
            x = pii.shapes(g.words)
            x[:, 19] = np.minimum(x[:, 19], 1)
            z = x @ w
            for i, j in g.chain:
                z[j] += chain[g.label[i]]
                z[i] += chain[:, g.label[j]]
            seen = {(i, int(g.label[j])) for i, j in g.skip} | {(j, int(g.label[i])) for i, j in g.skip}
            for i, label in seen:
                z[i] += skip[label]
            total += (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), g.label]).sum()
            nodes += len(z)
        prior = np.eye(5) * pii.AGREE
        prior[0, 0] = pii.OPEN
        return total / nodes + pii.DECAY / 2 * ((w**2).sum() + (chain**2).sum()) + pii.TRUST / 2 * ((skip - prior) ** 2).sum()

    here = loss(model.node, model.chain, model.skip)
    prior = np.eye(5) * pii.AGREE
    prior[0, 0] = pii.OPEN
    assert here < 0.1 * loss(np.zeros((20, 5)), np.zeros((5, 5)), prior)
    rng = np.random.default_rng(0)
    for _ in range(20):
        d = rng.normal(size=(5, 5)) * 0.3
        step = [rng.normal(size=(20, 5)) * 0.3, rng.normal(size=(5, 5)) * 0.3, d + d.T]
        assert loss(model.node + step[0], model.chain + step[1], model.skip + step[2]) > here - 1e-3


def test_field_carries_labels_to_similar_mentions():
    model = pii.fit([f"write to user{i}@mail{i}.example.com or call +1 (555) 010-{1000 + i} for case {i}" for i in range(80)])
    text = "write to user7@mail7.example.com today. Later: (user7@mail7.example.com and USER7@MAIL7EXAMPLECOM got mail, case 7"
    spans = model.spans(text)
    assert [(s, e) for s, k, e, b in spans if b] == [(s, e) for s, _, e in plain_spans(text)]
    assert [text[s:e] for s, k, e, b in spans if not b] == ["USER7@MAIL7EXAMPLECOM"]
    assert model.spans("case 12 of 77 at 3pm") == []


def test_field_infers_texts_without_base_spans_or_repeated_words():
    model = pii.fit([f"write to user{i}@mail{i}.example.com or call +1 (555) 010-{1000 + i} for case {i}" for i in range(80)])
    for text in ("call (555) 010-7777 or later (555) 010-7777", "call (555) 010-7777 today", "write to a@b.example.com or call (555) 010-7777"):
        found = [text[s:e] for s, k, e, b in model.spans(text) if not b and pii.KINDS[k] == "phone"]
        assert found and set(found) <= {"(555)", "555", "010-7777"}, text


def planted(rng, n):
    """Texts with a mention that fits a pattern, others of the same that none fits, and numbers that are nothing; and what is to be added."""

    def luhn(prefix):
        return next(prefix + str(d) for d in range(10) if pii._luhn(prefix + str(d)))

    out = []
    for i in range(n):
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        card = luhn("4" + digits[:14])
        wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
        user = f"u{rng.integers(10**6)}.{rng.choice(EN)}"
        base, other = [
            (f"+49{30 + i % 60}{digits[:8]}", f"0{30 + i % 60}/{digits[:8]}"),
            (f"+1({digits[:3]}){digits[3:6]}-{digits[6:10]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:10]}"),
            (f"{user}@mail.example.org", f"{user}[at]mail[dot]example.org"),
            ("-".join(card[k : k + 4] for k in range(0, 16, 4)), "/".join(card[k : k + 4] for k in range(0, 16, 4))),
        ][i % 4]
        kind = ("phone", "phone", "email", "card")[i % 4]
        fill = lambda: " ".join(rng.choice(EN, rng.integers(3, 30)))
        noise = f"order {rng.integers(10**8, 10**9)} {fill()} ticket {wrong} {fill()} again {wrong} on 2024-03-{1 + i % 28}"
        text = f"{fill()} {base} {fill()} {other} {fill()} {noise} {fill()} {other} {fill()}"
        out.append((text, {(text.index(other), kind), (text.rindex(other), kind)}))
    return out


def test_added_spans_of_planted_mentions():
    rng = np.random.default_rng(12)
    model = pii.fit([t for t, _ in planted(rng, 400)])
    assert np.abs(model.skip - (np.eye(5) * pii.AGREE - np.diag([pii.AGREE - pii.OPEN, 0, 0, 0, 0]))).max() > 0.5  # off the prior
    right = added = wanted = 0
    for text, want in planted(rng, 400):
        got = {(s, pii.KINDS[k]) for s, k, _, base in model.spans(text) if not base}
        right, added, wanted = right + len(got & want), added + len(got), wanted + len(want)
    print(f"added spans: precision {right / added:.3f}, recall {right / wanted:.3f}")
    assert right / added >= 0.95 and right / wanted >= 0.9


def test_words_that_fail_a_check_are_never_added():
    model = pii.fit([t for t, _ in planted(np.random.default_rng(3), 100)])
    text = "card 5927243074273351 and 5927243074273351, again 5927243074273351 beside 4111111111111111"
    assert [k for _, k, _, base in model.spans(text) if pii.KINDS[k] == "card"] == [2]
    assert not pii.kinds_allowed("999.1.1.1")[2] and pii.kinds_allowed("10.0.0.1")[2] and pii.kinds_allowed("x[at]y.org")[1]


def test_field_learns_from_long_texts(spark):
    texts = [" ".join([*EN * 200, f"write to user{i}@mail{i}.example.com or call +1 (555) 010-{1000 + i} for case {i}"]) for i in range(40)]
    assert min(map(len, texts)) > 20_000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "no digits"])], "doc_id long, text string").repartition(3)
    model, want = pii.learn(docs), pii.fit(texts)
    assert np.abs(model.node).max() > 0.1 and np.allclose(model.node, want.node) and np.allclose(model.chain, want.chain) and np.allclose(model.skip, want.skip)


def test_toxicity(spark, data):
    got = rows(queries.op5_toxicity(spark, data))
    assert len(got) == len(corpus()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] >= 400)


def labelled(rng, n):
    """Texts of which toxic ones insult, mostly groups of people; clean ones seldom name any."""
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        w = rng.choice(EN, 15).tolist()
        if toxic:
            w.insert(3, str(rng.choice(["idiots", "vermin", "filth", "trash"])))
        if rng.random() < (0.8 if toxic else 0.1):
            w.insert(7, str(rng.choice(["muslims", "jews", "women", "immigrants"])))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_of_held_out_rows_and_neutral_mentions(spark, tmp_path):
    rng = np.random.default_rng(6)
    data = labelled(rng, 900)
    neutral = [(2000 + i, f"{' '.join(rng.choice(EN, 6))} {term} {' '.join(rng.choice(EN, 6))}", 0) for i, term in enumerate(["muslims", "jews", "women", "immigrants", "christians", "refugees"] * 5)]
    spark.createDataFrame([(i, t) for i, t, _ in data + neutral], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in rows(queries.op5_toxicity(spark, str(tmp_path)))}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held) and len(held) > 100
    assert np.mean([got[i]["predicted"] == y for i, y in held]) >= 0.98
    assert all(got[i]["predicted"] == 0 for i, _, _ in neutral)
    # Without the penalty the same labels make neutral mentions worse than clean texts that name nobody.
    sets = lambda texts: toxicity.sets_of(toxicity.Texts(pa.array(texts), lower=True, gaps=toxicity.NOT_LETTERS))
    import pyarrow as pa

    y = np.array([t[2] for t in data], float)
    gap = []
    for penalty in (0.0, 4.0):
        model = toxicity.fit(sets([t[1] for t in data]), y, counterfactual=penalty)
        gap.append(float(model.scores(pa.array([t[1] for t in neutral])).mean() - model.scores(pa.array([" ".join(EN)])).mean()))
    assert gap[1] < 0.5 * gap[0]


def test_swapped_terms_score_alike():
    rng = np.random.default_rng(2)
    y = np.array([1.0, 0.0] * 200)
    texts = [" ".join(rng.choice(EN, 12)) + (" idiot" if t else "") + (" muslim" if t and rng.random() < 0.7 else " christian" if rng.random() < 0.5 else "") for t in y]
    import pyarrow as pa

    sets = toxicity.sets_of(toxicity.Texts(pa.array(texts), lower=True, gaps=toxicity.NOT_LETTERS))
    gap = []
    for penalty in (0.0, 4.0):
        p = toxicity.fit(sets, y, counterfactual=penalty).scores(pa.array(["a muslim sang", "a christian sang"]))
        gap.append(abs(p[0] - p[1]))
    assert gap[1] < 0.1 * gap[0]


def test_language(spark, data):
    got = rows(queries.op7_language_id(spark, data))
    want = {r[0]: r for r in corpus()}
    for r in got:
        text = want[r["doc_id"]][1] if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
        if r["doc_id"] is not None and r["doc_id"] < 300:
            assert r["lang_pred"] == want[r["doc_id"]][2]


def test_letters_are_told_by_category():
    import sys

    import pyarrow as pa

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    at, script = language_id._letters(language_id.Texts(pa.array([every])))
    assert len(at) == len(script) == sum(c.isalpha() for c in every)
    model = language_id.Model(["en"], np.ones((1, language_id.CELLS)), np.ones((1, language_id._OTHER)))
    odd = ["😀", "×", "。", "٣٤", "12 ÷ 3", "²", "_", "", None, "\ue000", "\u0301"]
    assert model.predict(pa.array(odd, pa.string()))[0] == ["und"] * len(odd)
    assert model.predict(pa.array(["a×", "日本", "٣ب", "ª", "\U00010400"]))[0] == ["en"] * 5


def test_language_against_brute_force(spark, tmp_path):
    """A plain version, word by word and with all paths' best, of what is learned, scored and chosen."""
    data = [(i, t, lang) for i, t, lang, _ in corpus() if i is not None and i < 310] + [(500, " ".join(EN[:9] + FR[:9]), None), (501, "Привет мир cat", "ru"), (502, "Привет, мир", "ru"), (503, "мир 日本 7", "ru")]
    spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(queries.op7_language_id(spark, str(tmp_path)))}

    def trigrams(text):
        b = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 * (65 <= c <= 90) for c in text.encode())
        return [((((b[i - 1] if i else 32) << 16 | b[i] << 8 | (b[i + 1] if i + 1 < len(b) else 32)) * 0x9E3779B1 & 0xFFFFFFFF) >> 15) for i in range(len(b))]

    def script(word):
        c = next((c for c in word if c.isalpha()), None)
        return None if c is None else next((k for k, r in enumerate(language_id.SCRIPTS) if any(a <= ord(c) <= b for a, b in r)), len(language_id.SCRIPTS))

    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in data:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            t = trigrams(text)
            for m in re.finditer(rb"[^ \t-\r]+", text.encode()):
                counts[lang].update(t[m.start() : m.end()])
                scripts[lang][script(m[0].decode())] += 1
    langs = sorted(counts)
    for x in scripts.values():
        x.pop(None, None)
    log = {k: lambda c, k=k, n=sum(counts[k].values()): math.log((counts[k][c] + 0.05) / (n + 0.05 * language_id.CELLS)) for k in langs}
    known = {s: [k for k in langs if scripts[k][s] >= 0.005 * sum(scripts[k].values())] for s in range(language_id._OTHER)}
    for i, text, _ in data:
        t, best = trigrams(text or ""), None
        share = Counter()
        found = [(m, script(m[0].decode())) for m in re.finditer(rb"[^ \t-\r]+", (text or "").encode())]
        path = {}
        for m, s in found:
            step = {}
            for k in langs:
                x = 0.0 if s is None else sum(log[k](c) for c in t[m.start() : m.end()]) - (language_id.OFF if known[s] and k not in known[s] else 0)
                prior = max(((v - (language_id.SWITCH if j != k else 0), p) for j, (v, p) in path.items()), default=(0.0, []), key=lambda y: y[0])
                step[k] = (prior[0] + x, [*prior[1], k])
            path = step
        if path:
            best = max(path.values(), key=lambda y: y[0])[1]
            for (m, s), k in zip(found, best, strict=True):
                if s is not None:
                    share[k] += m.end() - m.start()
        if not share:
            assert got[i] == ("und", 0.0)
        else:
            top = max(sorted(share), key=lambda k: share[k])
            assert got[i][0] == top and got[i][1] == pytest.approx(share[top] / sum(share.values())), (i, text[:60])


def test_viterbi_is_exact():
    rng = np.random.default_rng(4)
    scores, first = rng.normal(size=(40, 3)).astype(np.float32), np.array([0, 5, 5, 6, 40])
    got = language_id.viterbi(scores, first, 1.5)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            v = scores[a].astype(float)
            for i in range(a + 1, b):
                v = np.maximum(v, v.max() - 1.5) + scores[i]
            path = got[a:b]
            assert scores[np.arange(a, b), path].sum() - 1.5 * (path[1:] != path[:-1]).sum() == pytest.approx(v.max(), abs=1e-4)


def test_spans_of_mixed_text(spark):
    df = spark.createDataFrame([(i, " ".join(EN), "en") for i in range(5)] + [(9, " ".join(FR), "fr")] * 5, "doc_id long, text string, lang string")
    got = rows(language_id.labelled_spans(spark.createDataFrame([(1, " ".join(EN + FR))], "doc_id long, text string"), language_id.learn(df)))
    assert [r["lang"] for r in sorted(got, key=lambda r: r["start"])] == ["en", "fr"] and abs(got[0]["end"] - len(EN)) <= 2


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, data), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
        if name == "toxicity":
            assert not {401, 403} & {r.doc_id for r in docs.collect()}
        if name == "exact_dedup":
            texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if name == "ngram_join":
            assert len([r for r in docs.collect() if r.doc_id and 200 <= r.doc_id < 212]) == 1
    assert sizes[0] > sizes[1] > sizes[2]
    assert queries.pipeline(spark, data).count() >= sizes[3]


def test_slices_keep_rows_in_order_and_bound_texts():
    import pyarrow as pa

    from tessera.llm.common import slices

    texts = ["aaaa", None, "", "b" * 50, "cc", "äö", None, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "text"])
    for most in (1, 4, 10, 1000):
        parts = list(slices(batch, 1, most))
        assert [r for b in parts for r in b.to_pylist()] == batch.to_pylist()
        for b in parts:
            sizes = [len((x or "").encode()) for x in b.column(1).to_pylist()]
            assert sum(sizes[1:]) < most  # only a part's first text may be longer
    assert sum(b.num_rows for b in slices(batch.slice(0, 0), 1)) == 0
