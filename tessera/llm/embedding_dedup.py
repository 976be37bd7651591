"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform (vectors are padded to a power of two);
its hash is the axis nearest to the rotated vector, of 2d. A table's code is the hashes of ``k`` rotations; besides its own
code, a vector probes the codes that come next by how little they lose. All of a bucket's pairs are verified by
cosine in double precision, so no link below the threshold is reported.

How many rotations make a code follows from the number of classes and the vectors' width; how many tables there are, from
the chance that two vectors at the threshold meet in one table, which is measured on ``PAIRS`` random pairs of that
width: so many that all tables miss less than ``MISS`` of these.

Equal vectors are one class first, found in two steps, so that copies of one vector never meet in one place. Every pair of classes is counted in the first bucket
that both probe and nowhere else; buckets hence report sums of links and a spanning forest, never all pairs. A
bucket of over ``BLOCK`` classes is cut into blocks that meet in pairs, each in a task of its own.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link. Repeated ids are rows of their own; null ids come after all others. Other columns
are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, components, dealt_join, mix, runs, written

#: Classes of a bucket that one task compares.
BLOCK = 2048
#: Probes of each table; random pairs and tables by which a table's chance is measured; share of pairs at the threshold that may be missed.
PROBES, PAIRS, TRIED, MISS = 4, 400, 8, 0.005
#: Classes for each code, about.
PER_CODE = 32
OUT = "kind int, a long, b long, k long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def width_of(dim: int) -> int:
    """Axes of a rotation: a power of two, and enough for short vectors that signs make many rotations."""
    return max(1 << max(dim - 1, 0).bit_length(), 16)


def codes(x: np.ndarray, k: int, tables: int, probes: int, seed: int = 7) -> np.ndarray:
    """Keys (rows, tables, probes) of unit vectors; no key is twice in a row."""
    n, dim = x.shape
    d = width_of(dim)
    x = np.pad(x, ((0, 0), (0, d - dim)))
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    out = np.empty((n, tables, probes), np.uint64)
    m = min(probes, 2 * d)
    for t in range(tables):
        lists, losses = [], []
        for _ in range(k):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            both = np.concatenate([y, -y], 1)
            top = np.argsort(-both, axis=1)[:, :m]
            lists.append(top.astype(np.uint64))
            s = np.take_along_axis(both, top, 1)
            losses.append((s[:, :1] - s) ** 2)
        code, loss = lists[0], losses[0]
        for c, f in zip(lists[1:], losses[1:], strict=True):
            code = (code[:, :, None] * np.uint64(2 * d) + c[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + f[:, None, :]).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
        out[:, t, : code.shape[1]] = code[:, :probes] + np.uint64(1)
        for p in range(code.shape[1], probes):
            out[:, t, p] = np.uint64(2) ** np.uint64(62) + np.uint64(p)  # fewer codes than probes
        out[:, t] = mix(out[:, t] * np.uint64(tables * 1021) + np.uint64(t * 1021 + dim % 1021))
    return out


def rotations_for(dim: int, classes: int) -> int:
    """Rotations of a code, so that there are about ``PER_CODE`` classes for each."""
    width, k = 2 * width_of(dim), 1
    while width**k * PER_CODE < classes:
        k += 1
    return k


@cache
def tables_for(dim: int, k: int, floor: float, probes: int) -> int:
    """Tables by which pairs at a cosine of ``floor`` meet but for a share of ``MISS``."""
    rng = np.random.Generator(np.random.PCG64([11, dim]))
    a, b = rng.normal(size=(PAIRS, dim)), rng.normal(size=(PAIRS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    b = floor * a + np.sqrt(max(1 - floor * floor, 0)) * b
    x, y = codes(a, k, TRIED, probes, seed=13), codes(b, k, TRIED, probes, seed=13)
    met = (x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).mean()
    chance = max(met - 2 * np.sqrt(met * (1 - met) / (PAIRS * TRIED)), 1e-3)
    n = 1 if chance >= 1 - 1e-9 else max(int(np.ceil(np.log(MISS) / np.log(1 - chance))), 2)
    while True:  # tables of short vectors are not quite independent, so the choice is tried out
        x, y = codes(a, k, n, probes), codes(b, k, n, probes)
        if (x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).any(1).mean() >= 1 - 2 * MISS:
            return n
        if n > 4096:
            raise ValueError(f"pairs at a cosine of {floor} are not found in {n} tables")
        n += max(n // 4, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe from overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def stored(row: np.ndarray) -> bytes:
    """A vector's components, in single precision where that is exact."""
    short = row.astype("<f4")
    return b"f" + short.tobytes() if (short == row).all() else b"d" + row.astype("<f8").tobytes()


def loaded(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<f4" if b[:1] == b"f" else "<f8", offset=1).astype(np.float64)


def _hashed(plan: dict[int, tuple[int, int]], probes: int):
    def f(batches: Batches) -> Batches:
        for b in batches:
            lists = b.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.cumsum(size) - size
            rows, keys, vecs = [], [], []
            for dim in np.unique(size):
                which = np.flatnonzero(size == dim)
                x = flat[at[which][:, None] + np.arange(dim)]
                c = codes(unit(x), *plan[int(dim)], probes).reshape(len(x), -1).view(np.int64)
                rows.append(which)
                keys += [r for r in c]
                vecs += [stored(r) for r in x]
            order = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order)), b.column(2).take(pa.array(order)), pa.array(vecs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["c", "n", "vec", "keys"])

    return f


def _linked(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray, key: int, floor: float, same: bool):
    """Index pairs of linked vectors whose first common key this is."""
    for lo in range(0, len(x), 256):
        i, j = np.nonzero(x[lo : lo + 256] @ y.T >= floor)
        i = i + lo
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            first = np.ones(len(i), bool)
            for t in range(kx.shape[1]):
                a, b = kx[i, t], ky[j, t]
                hit = (a[:, :, None] == b[:, None, :]) & first[:, None, None]
                low = np.where(hit.any(2), a, np.iinfo(np.int64).max).min(1)
                any_ = low != np.iinfo(np.int64).max
                mine = (a == key).any(1) & (b == key).any(1)
                first &= ~any_ | (mine & (low == key))
                i, j, first, done = i, j, first, mine & any_
                yield_now = first & done
                if yield_now.any():
                    yield i[yield_now], j[yield_now]
                keep = first & ~done
                i, j, first = i[keep], j[keep], first[keep]
                if not len(i):
                    break


def _bucket(floor: float, plan: dict[int, tuple[int, int]], probes: int):
    def f(table: pa.Table) -> pa.Table:
        key, i, j, blk = (table[k].to_numpy() for k in ("key", "i", "j", "blk"))
        c, n = table["c"].to_numpy(), table["n"].to_numpy()
        order = np.lexsort((blk, j, i, key))
        whole = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])]) if len(order) else np.zeros(0, np.int64)
        ends = np.r_[whole[1:], len(order)]
        links = np.zeros(len(c), np.int64)
        edges_a, edges_b = [], []
        vecs, keys = table["vec"].combine_chunks(), table["keys"].combine_chunks()
        for s, e in zip(whole.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            rows = order[s:e]
            each = [loaded(v) for v in vecs.take(pa.array(rows)).to_pylist()]
            size = np.array([len(v) for v in each])
            for dim in np.unique(size):
                r = rows[size == dim]
                x = unit(np.stack([v for v, here in zip(each, size == dim, strict=True) if here]))
                k = keys.take(pa.array(r)).flatten().to_numpy().reshape(len(r), plan[int(dim)][1], probes)
                one = i[r[0]] == j[r[0]]
                a = np.arange(len(r)) if one else np.flatnonzero(blk[r] == i[r[0]])
                b = a if one else np.flatnonzero(blk[r] == j[r[0]])
                label = np.arange(len(r))
                for p, q in _linked(x[a], x[b], k[a], k[b], int(key[r[0]]), floor, one):
                    p, q = a[p], b[q]
                    np.add.at(links, r[p], n[r[q]])
                    np.add.at(links, r[q], n[r[p]])
                    while True:  # joins the trees of linked vectors, smallest label first
                        lp, lq = label[p], label[q]
                        open_ = lp != lq
                        if not open_.any():
                            break
                        p, q, lp, lq = p[open_], q[open_], lp[open_], lq[open_]
                        high, low = np.maximum(lp, lq), np.minimum(lp, lq)
                        root = np.arange(len(r))
                        np.minimum.at(root, high, low)
                        moved = root[label]
                        while (root[moved] != moved).any():
                            moved = root[moved]
                        label = moved
                tree = np.flatnonzero(label != np.arange(len(r)))
                edges_a.append(c[r[tree]])
                edges_b.append(c[r[label[tree]]])
        some = np.flatnonzero(links)
        a = np.concatenate([c[some], *edges_a])
        b = np.concatenate([np.zeros(len(some), np.int64), *edges_b])
        k = np.concatenate([links[some], np.zeros(len(a) - len(some), np.int64)])
        return pa.table({"kind": np.repeat(np.array([0, 1], np.int32), [len(some), len(a) - len(some)]), "a": a, "b": b, "k": k})

    return f


def near_vectors(vectors: DataFrame, floor: float = 0.95, probes: int = PROBES) -> DataFrame:
    """One row per vector: vec_id, n_links (others linked), component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists("e", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("good", F.coalesce(finite, F.lit(False))).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(p)).cast("int")), "vectors")
    good = rows.where("good").drop("good")
    # Equal vectors first by salt, then these together; rows find their class by the numbers of these parts.
    parts = written(good.groupBy("e", "salt").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.min("row").alias("part")), "parts")
    classes = written(parts.groupBy("e").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.min("part").alias("c")), "classes")
    part_of = good.join(parts.select("e", "salt", "part"), ["e", "salt"]).select("vec_id", "row", "part")
    of = written(part_of.join(parts.select("e", "part").join(classes.select("e", "c"), "e").select("part", "c"), "part").select("vec_id", "row", "c"), "members")
    widths = {r.d: r.k for r in classes.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("k")).collect()}
    plan = {d: (k, tables_for(d, k, floor, probes)) for d, k in ((d, rotations_for(d, n)) for d, n in widths.items())}
    hashed = written(classes.select("c", "e", "n").mapInArrow(_hashed(plan, probes), "c long, n long, vec binary, keys array<long>"), "codes")
    hot = hashed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    spread = hashed.withColumn("key", F.explode("keys")).join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = spread.withColumn("blk", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o"))
    b = max(p, sum(n * plan[d][1] * probes for d, n in widths.items()) // 20_000)
    spread = spread.select(F.pmod(F.xxhash64("key", "i", "j"), F.lit(b)).cast("int").alias("bin"), "key", "i", "j", "blk", "c", "n", "vec", "keys")
    found = written(spread.groupBy("bin").applyInArrow(_bucket(floor, plan, probes), OUT), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("c")).agg(F.sum("k").alias("k"))
    labels = components(found.where("kind = 1").select("a", "b"))
    comps = classes.select("c", "least", "n").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c")).join(links, "c", "left")
    comps = written(comps, "components")
    ends = comps.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = written(dealt_join(comps, ends, "comp", ["c"]).select("c", "component_id", (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    out = dealt_join(of, named, "c", ["row"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    none = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
