"""Self-join of documents by the Jaccard similarity of their word n-grams.

A document's set holds its distinct ``n``-grams of lower-cased (A-Z) words; with fewer words the whole sequence
is the one member; without words the set is empty and linked with nothing. Two documents link when
``den * |x & y| >= num * |x | y|``.

Method. Equal sets are one class. The members of each set are ordered rare-first, by a hashed table of counts
over all documents; only the first ``|x| - ceil(num/den * |x|) + 1`` of them (the prefix) are indexed, since two
similar sets share one of these. Pairs that share a prefix member pass a length filter and a positional filter,
are made distinct, and are verified once: a suffix filter (a lower bound of the Hamming distance from member
counts in hash ranges) and then the exact intersection.

Skew. A prefix member that more than ``SMALL`` classes share would give a square of pairs. There, every class is first
paired only with the ``PIVOTS`` classes that hold it earliest in their order. What the links then found leave in
different components is paired in a second round, in blocks of ``BLOCK`` classes, so that no link between components is
lost; pairs within one component need no test. The Jaccard distance is a metric, so two classes whose distances to
one pivot differ by more than a link allows are not paired either. Links within such a list are therefore not counted,
components are exact; with ``links`` all pairs of these lists are tested, in the same blocks, and counted.

Of a pair, the class with fewer partners is the one that the other's set is sent to, and a set that many groups ask for is
passed on by ``FAN`` groups each: a pivot's partners never meet in one place.

A set is named by 64 bits of hash; two unequal sets share a name with probability of about ``N * N / 2**65``.

Defined results: a null text has no words; null doc_ids come after all others, and a component of null doc_ids
has a null component_id. Equal rows are members of one class. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, Texts, buckets_for, components, dealt, dealt_join, grouped_texts, groups_for, lengths, mix, packed, runs, slices, text_key, unpacked, windows, written

#: Cells of the table of counts (a broadcast of one byte each), and the parts in which it is added up.
CELLS, PARTS = 1 << 22, 64
#: Places into which the tasks' counts go before they are added up, so that no task sees those of all others.
SALTS = 64
#: Classes that may share a prefix member before pivots stand for all pairs; pivots; classes of a block of the second round.
SMALL, PIVOTS, BLOCK = 48, 4, 1024
#: Groups that one copy of a set is passed on to.
FAN = 1024
ENTRY = np.dtype([("tok", "<u4"), ("key", "<u8"), ("n", "<u4"), ("pos", "<u4")])
FOUND = "kind int, a long, b long, tok long, n int, pos int"


def shingles(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a batch, one text after the other, and bounds by text; a text shorter than n words has one."""
    words, counts = t.hashes(), t.counts
    size = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    bounds = np.r_[0, np.cumsum(size)]
    out = np.empty(bounds[-1], np.uint64)
    h = windows(words, n)
    full = np.repeat(counts >= n, size)
    start = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) + np.repeat(t.first[:-1], size)
    out[full] = h[start[full]]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            out[bounds[short]] = mix(windows(words, k)[t.first[short]] + np.uint64(k))
    return out, bounds


def name_of(members: np.ndarray) -> int:
    """The name of a set of distinct hashes, as a signed integer."""
    x = mix(np.array([np.add.reduce(mix(members)) + np.uint64(len(members))], np.uint64))
    return int(x.view(np.int64)[0])


def _sets(n: int):
    """Names and sizes of sets, and this task's counts of members by cell."""

    def f(batches: Batches) -> Batches:
        counts, salt = np.zeros(CELLS, np.uint32), TaskContext.get().partitionId() % SALTS
        for batch in (part for b in batches for part in slices(b, 2)):
            t = Texts(batch.column(2), lower=True)
            h, bounds = shingles(t, n)
            keys, sizes = np.zeros(t.n, np.int64), np.zeros(t.n, np.int32)
            for i in range(t.n):
                u = np.unique(h[bounds[i] : bounds[i + 1]])
                sizes[i] = len(u)
                if len(u):
                    keys[i] = name_of(u)
                    counts[(u & np.uint64(CELLS - 1)).astype(np.int64)] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(sizes), pa.array(np.diff(t.offsets)), pa.nulls(t.n, pa.int32()), pa.nulls(t.n, pa.binary())], NAMES)
        if counts.any():
            some = [k for k in range(PARTS) if counts[k * CELLS // PARTS : (k + 1) * CELLS // PARTS].any()]
            blobs = [zlib.compress(counts[k * CELLS // PARTS : (k + 1) * CELLS // PARTS].astype(np.uint64).tobytes(), 1) for k in some]
            m = len(some)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, x) for x in (pa.int64(), pa.int64(), pa.int64())), pa.array([salt] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], NAMES)

    return f


NAMES = ["doc_id", "h", "key", "n", "bytes", "part", "counts"]


def _summed(table: pa.Table) -> pa.Table:
    """A part of the table of counts, added up over tasks."""
    total = np.zeros(CELLS // PARTS, np.uint64)
    for chunk in table["counts"].to_pylist():
        total += np.frombuffer(zlib.decompress(chunk), np.uint64)
    return pa.table({"part": table["part"].slice(0, 1).combine_chunks(), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _steps(counts: bytes) -> np.ndarray:
    """Counts in steps of an eighth of an octave."""
    return np.minimum(np.floor(8 * np.log2(1 + np.frombuffer(zlib.decompress(counts), np.uint64).astype(np.float64))), 255).astype(np.uint8)


def rare_first(members: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The members of a set, those of rare cells first, ties by hash."""
    return members[np.lexsort((members, steps[(members & np.uint64(CELLS - 1)).astype(np.int64)]))]


def _pairs_in(e: np.ndarray, bucket: int, num: int, den: int) -> pa.Table:
    """Candidate pairs among a bucket's prefix entries, and the entries of members that too many sets share."""
    e = e[np.lexsort((e["key"], e["tok"]))]
    e = e[np.r_[True, (e["tok"][1:] != e["tok"][:-1]) | (e["key"][1:] != e["key"][:-1])]] if len(e) else e
    s, m = runs(e["tok"])
    size = np.repeat(m, m)
    few = e[(size > 1) & (size <= SMALL)]
    left, right = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero(few["tok"][d:] == few["tok"][:-d]) if len(few) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        x, y = few[i], few[i + d]
        nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
        need = -(-num * (nx + ny) // (num + den))
        good = (np.minimum(nx, ny) * den >= np.maximum(nx, ny) * num) & (np.minimum(nx - x["pos"], ny - y["pos"]) >= need)
        left.append(x["key"][good])
        right.append(y["key"][good])
    hot, pivots, others, lists = [], [], [], []
    for at, k in zip(s[m > SMALL].tolist(), m[m > SMALL].tolist(), strict=True):
        part = e[at : at + k]
        hot.append(part)
        for p in part[np.argsort(part["pos"], kind="stable")[:PIVOTS]]:
            n = part["n"].astype(np.int64)
            good = (part["key"] != p["key"]) & (np.minimum(n, int(p["n"])) * den >= np.maximum(n, int(p["n"])) * num)
            others.append(part["key"][good])
            pivots.append(np.full(int(good.sum()), p["key"]))
            lists.append(part["tok"][good])
    a = np.concatenate(left).view(np.int64) if left else np.zeros(0, np.int64)
    b = np.concatenate(right).view(np.int64) if right else np.zeros(0, np.int64)
    a, b = np.minimum(a, b), np.maximum(a, b)
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b = a[new], b[new]
    h = np.concatenate(hot) if hot else np.zeros(0, ENTRY)
    p, q = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (pivots, others))
    name = lambda tok: (tok.astype(np.int64) << 31) | bucket
    k, j, m = len(a), len(h), len(p)
    none = np.zeros(k, np.int64)
    return pa.table(
        {
            "kind": np.repeat(np.array([0, 1, 2], np.int32), [k, j, m]),
            "a": np.r_[a, h["key"].astype(np.uint64).view(np.int64), p],
            "b": np.r_[b, np.zeros(j, np.int64), q],
            "tok": np.r_[none, name(h["tok"]), name(np.concatenate(lists)) if m else none[:0]],
            "n": np.r_[none, h["n"], np.zeros(m, np.int64)].astype(np.int32),
            "pos": np.r_[none, h["pos"], np.zeros(m, np.int64)].astype(np.int32),
        }
    )


_RANGES = (np.arange(1, 16, dtype=np.uint64) << np.uint64(60)).astype(np.uint64)


def shared(x: np.ndarray, y: np.ndarray, least: int = 0) -> int:
    """Common members of two sorted sets of hashes; -1 if the suffix filter tells that there are fewer than ``least``."""
    nx, ny = len(x), len(y)
    if least:
        if min(nx, ny) < least:
            return -1
        cx, cy = np.diff(np.r_[0, np.searchsorted(x, _RANGES), nx]), np.diff(np.r_[0, np.searchsorted(y, _RANGES), ny])
        if int(np.minimum(cx, cy).sum()) < least:
            return -1
    small, large = (x, y) if nx <= ny else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


class NgramJoin:
    """One join; the steps are methods so that tests can look at them."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, links: bool = False):
        self.docs, self.n, self.num, self.den, self.links = docs, n, num, den, links
        self.spark: SparkSession = docs.sparkSession
        self.sizes = None

    def measured(self) -> None:
        """Names and sizes of all sets, and the table of counts."""
        keyed = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), F.col("text").cast("string").alias("text"))
        schema = "doc_id long, h long, key long, n int, bytes long, part int, counts binary"
        both = written(keyed.mapInArrow(_sets(self.n), schema), "sets")
        self.sizes = both.where("part is null").select("doc_id", "h", "key", "n", "bytes")
        counted = both.where("part is not null").select("part", F.col("n").alias("salt"), "counts")
        kind = "part int, counts binary"
        parts = counted.groupBy("part", "salt").applyInArrow(_summed, kind).groupBy("part").applyInArrow(_summed, kind).collect()
        steps = np.zeros(CELLS, np.uint8)
        for r in parts:
            steps[r.part * CELLS // PARTS : (r.part + 1) * CELLS // PARTS] = _steps(r.counts)
        self.steps = self.spark.sparkContext.broadcast(steps)
        total, members = self.sizes.agg(F.sum("bytes"), F.sum("n")).first()
        self.g = groups_for(self.spark, total or 0)
        self.b = buckets_for(self.spark, (members or 0) * (self.den - self.num) // self.den)
        self.reps = self.sizes.where("n > 0").groupBy("key").agg(F.min("h").alias("h"))

    def indexed(self) -> DataFrame:
        """Candidate pairs (kind 0), the entries of hot prefix members (kind 1) and their pairs with pivots, a the pivot (kind 2)."""
        n, num, den, b, steps = self.n, self.num, self.den, self.b, self.steps

        def entries(batches: Batches) -> Batches:
            seen: set[int] = set()
            for batch in (part for b in batches for part in slices(b, 0)):
                t = Texts(batch.column(0), lower=True)
                h, bounds = shingles(t, n)
                parts = []
                for i in range(t.n):
                    if bounds[i] == bounds[i + 1]:
                        continue
                    u = np.unique(h[bounds[i] : bounds[i + 1]])
                    key = name_of(u)
                    if key in seen:
                        continue
                    seen.add(key)
                    m = len(u)
                    prefix = rare_first(u, steps.value)[: m - -(-num * m // den) + 1]
                    e = np.empty(len(prefix), WIDE)
                    e["h"], e["key"], e["n"], e["pos"] = prefix, key & 0xFFFFFFFFFFFFFFFF, m, np.arange(len(prefix))
                    parts.append(e)
                if not parts:
                    continue
                e = np.concatenate(parts)
                to, bounds, cols = dealt((e["h"] % np.uint64(b)).astype(np.int64), {k: e[k] for k in e.dtype.names})
                out = np.empty(len(e), ENTRY)
                out["tok"] = (mix(cols["h"]) >> np.uint64(32)).astype(np.uint32)
                for k in ("key", "n", "pos"):
                    out[k] = cols[k]
                yield pa.RecordBatch.from_arrays([pa.array(to), packed(out, bounds)], ["b", "es"])

        def pairs(table: pa.Table) -> pa.Table:
            return _pairs_in(unpacked(table["es"], ENTRY), table["b"][0].as_py(), num, den)

        first = self.docs.select(F.col("text").cast("string").alias("text")).mapInArrow(entries, "b int, es binary")
        return written(first.groupBy("b").applyInArrow(pairs, FOUND), "pairs")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b, exact) that link, and those whose distance is asked for: (a, b, link, distance)."""
        n, num, den, g = self.n, self.num, self.den, self.g
        texts = grouped_texts(self.docs, g)
        partners = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("d"))
        ends = written(partners.join(self.reps, "key"), "ends")
        side = lambda x: ends.select(F.col("key").alias(x), F.col("h").alias(f"h{x}"), F.col("d").alias(f"d{x}"))
        both = written(dealt_join(pairs, side("a"), "a", ["b"]), "asked")
        both = dealt_join(both, side("b"), "b", ["a"])
        swap = (F.col("db") > F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("b") < F.col("a")))
        turned = {x: F.when(swap, F.col(x[:-1] + "b")).otherwise(F.col(x)).alias(x) for x in ("a", "ha", "da")} | {x: F.when(swap, F.col(x[:-1] + "a")).otherwise(F.col(x)).alias(x) for x in ("b", "hb")}
        group = lambda h: F.pmod(F.col(h), F.lit(g)).cast("int")
        asked = written(both.select(*turned.values(), "exact").withColumn("gb", group("hb")), "turned")
        copies = F.ceil(F.least("da", F.lit(g)) / FAN).cast("int")
        wanted = asked.select("a", "ha", copies.alias("copies"), "gb").distinct().withColumn("copy", F.pmod(F.xxhash64("gb"), F.col("copies")).cast("int"))
        wanted = wanted.groupBy(group("ha").alias("g"), "a", "ha", "copies", "copy").agg(F.collect_list("gb").alias("to"))
        tests = asked.select(F.col("gb").alias("g"), "a", "b", F.col("hb").alias("h"), "exact", F.lit(None).cast("binary").alias("members"))

        def sets_of(texts: pa.Table, hs: np.ndarray) -> dict[int, np.ndarray]:
            """Sorted sets by row key."""
            own, first = np.unique(texts["h"].to_numpy(), return_index=True)
            need = np.unique(hs)
            rows = first[np.searchsorted(own, need)]
            t = Texts(texts["text"].take(pa.array(rows)), lower=True)
            h, bounds = shingles(t, n)
            return {int(k): np.unique(h[bounds[i] : bounds[i + 1]]) for i, k in enumerate(need)}

        def send(texts: pa.Table, wanted: pa.Table) -> pa.Table:
            hs = wanted["ha"].to_numpy() if len(wanted) else np.zeros(0, np.int64)
            sets = {k: v.tobytes() for k, v in sets_of(texts, hs).items()} if len(hs) else {}
            return wanted.select(["a", "copies", "copy", "to"]).append_column("members", pa.array([sets[int(x)] for x in hs], pa.binary())).cast(SENT)

        def test(texts: pa.Table, given: pa.Table) -> pa.Table:
            if not len(given):
                return TESTED.empty_table()
            is_set = given["members"].is_valid()
            sent, asked = given.filter(is_set), given.filter(pa.compute.invert(is_set))
            theirs = {k: np.frombuffer(v, np.uint64) for k, v in zip(sent["a"].to_pylist(), sent["members"].to_pylist(), strict=True)}
            hs = asked["h"].to_numpy()
            own = sets_of(texts, hs)
            link, distance = np.zeros(len(asked), bool), np.ones(len(asked))
            exact = asked["exact"].to_numpy()
            for i, (a, h) in enumerate(zip(asked["a"].to_numpy().tolist(), hs.tolist(), strict=True)):
                x, y = theirs[a], own[h]
                total = len(x) + len(y)
                k = shared(x, y, 0 if exact[i] else -(-num * total // (num + den)))
                link[i] = k >= 0 and den * k >= num * (total - k)
                distance[i] = 1 - k / (total - k) if k >= 0 else 1
            some = link | exact
            return pa.table({"a": asked["a"].to_numpy()[some], "b": asked["b"].to_numpy()[some], "link": link[some], "distance": distance[some]}).cast(TESTED)

        sets = written(texts.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(send, "a long, copies int, copy int, to array<int>, members binary"), "sent")
        p = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        far = sets.where("copies > 1").repartition(p, "a", "copy")
        given = sets.where("copies = 1").unionByName(far).select(F.explode("to").alias("g"), "a", F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("h"), F.lit(False).alias("exact"), "members")
        given = given.unionByName(tests)
        return texts.groupBy("g").cogroup(given.groupBy("g")).applyInArrow(test, "a long, b long, link boolean, distance double")

    def second(self, known: DataFrame, distances: DataFrame) -> DataFrame:
        """Pairs of the second round: from each list (tok), classes of different components that the filters leave; all of them with ``links``."""
        open_ = known.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"))
        open_ = open_ if self.links else open_.where("lo <> hi")
        rows = known.join(open_.select("tok", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")), "tok").join(distances, ["tok", "key"], "left")
        rows = written(rows.withColumn("blk", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")), "open")
        met = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", "parts")
        x = met.where("blk = i").drop("blk")
        y = met.where("blk = j").select("tok", "i", "j", *(F.col(c).alias(f"{c}2") for c in ("key", "n", "pos", "comp", "to_pivots")))
        short = F.least("n", "n2") * self.den >= F.greatest("n", "n2") * self.num
        need = F.ceil(F.lit(self.num) * (F.col("n") + F.col("n2")) / F.lit(self.num + self.den))
        rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= need
        apart = lambda p: F.abs(F.col("to_pivots")[p] - F.col("to_pivots2")[p]) > 1 - self.num / self.den + 1e-9
        far = F.coalesce(F.exists(F.map_keys("to_pivots"), lambda p: F.coalesce(apart(p), F.lit(False))), F.lit(False))
        once = (F.col("i") < F.col("j")) | (F.col("key") < F.col("key2"))
        pairs = x.join(y, ["tok", "i", "j"]).where(once & (F.col("key") != F.col("key2")) & short & rest & ~far)
        pairs = pairs if self.links else pairs.where("comp <> comp2")
        return pairs.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()

    def labelled(self) -> tuple[DataFrame, DataFrame]:
        """(key, comp) of the classes that link with another, and the links found (a, b)."""
        found = self.indexed()
        plain = found.where("kind = 0").select("a", "b", F.lit(False).alias("exact"))
        pivots = found.where("kind = 2").select("tok", F.col("a").alias("pivot"), F.col("b").alias("key"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        first = plain.unionByName(pivots.select("a", "b", F.lit(True).alias("exact")))
        first = written(first.groupBy("a", "b").agg(F.max("exact").alias("exact")), "distinct")
        tested = written(self.verified(first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "link", "distance"), "tested")
        links = tested.where("link").select("a", "b")
        labels = components(links)
        hot = found.where("kind = 1").select("tok", F.col("a").alias("key"), "n", "pos")
        known = written(hot.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key")), "hot")
        distances = pivots.join(tested, ["a", "b"]).groupBy("tok", "key").agg(F.map_from_entries(F.collect_list(F.struct("pivot", "distance"))).alias("to_pivots"))
        more = written(self.second(known, distances).join(first.select("a", "b"), ["a", "b"], "left_anti").withColumn("exact", F.lit(False)), "more")
        if not more.limit(1).count():
            return labels, links
        links = links.unionByName(written(self.verified(more), "tested").where("link").select("a", "b"))
        return components(links), links

    def run(self) -> DataFrame:
        """One row per document: doc_id, h (the row's key), n_shingles, component_id, comp (names the component; null for empty
        sets), and n_links (other documents linked directly) if ``links``."""
        self.measured()
        labels, links = self.labelled()
        ids = self.sizes.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
        ids = ids.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        ids = written(ids, "ids")
        ends = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
        named = dealt_join(ids, ends, "comp", ["key"]).select("key", "comp", "component_id", "copies")
        if self.links:
            ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            others = ways.join(ids.select(F.col("key").alias("b"), F.col("copies").alias("k")), "b").groupBy(F.col("a").alias("key")).agg(F.sum("k").alias("k"))
            named = named.join(others, "key", "left").withColumn("n_links", F.coalesce("k", F.lit(0)) + F.col("copies") - 1).drop("k")
        else:
            named = named.withColumn("n_links", F.lit(None).cast("long"))
        named = written(named.drop("copies"), "named")
        out = dealt_join(self.sizes.where("n > 0"), named, "key", ["h"])
        none = self.sizes.where("n = 0").select("*", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
        columns = ["doc_id", "h", F.col("n").cast("long").alias("n_shingles"), "component_id", "comp", *(["n_links"] if self.links else [])]
        return out.unionByName(none).select(*columns)


WIDE = np.dtype([("h", "<u8"), ("key", "<u8"), ("n", "<u4"), ("pos", "<u4")])
SENT = pa.schema([("a", pa.int64()), ("copies", pa.int32()), ("copy", pa.int32()), ("to", pa.list_(pa.field("element", pa.int32()))), ("members", pa.binary())])
TESTED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("link", pa.bool_()), ("distance", pa.float64())])


def similar_groups(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, links: bool = False) -> DataFrame:
    """Components of documents whose sets of n-grams have a Jaccard similarity of at least num/den."""
    return NgramJoin(docs, n, num, den, links).run()
