"""Sparse factorisation of a large M as joins and sums, and solving with it.

1. *Sets of unknowns.* A level eliminates many unknowns at once: an independent set (no two share an entry) of those with the least fill,
   Markowitz' (r - 1)(c - 1), among those whose pivot is at least ``PIVOT`` times the largest of its row or its column. With the
   set S and the rest C the next matrix is ``M_CC - M_CS D^-1 M_SC``: one join on the pivot, one sum. What a block-triangular order
   would solve without fill (unknowns outside every cycle) has a cost of 0 and goes first, so a chain of n takes log n levels, not n.
2. *The core.* When at most ``most`` unknowns are left, or too few go at once (the rest is nearly dense), the core is cut into dense blocks
   of ``BLOCK`` unknowns, factorised block by block: the products of a step are a join of its column and its row of blocks, dealt to all tasks.
3. *Solving.* Right-hand sides go down the levels (a join and a sum each), through the core, and up again.

A factorisation is kept as tables in the shared folder and serves any number of right-hand sides. The driver sees counts alone; a
task sees three blocks at most. Cores of over ``CORE`` unknowns, and those with a singular block on the diagonal, are left to the
caller's iterative solver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import numbered, written

#: A pivot is at least so large against its row or column; unknowns of a dense block; right-hand sides of a block of them.
PIVOT, BLOCK, RHS = 0.1, 1000, 128
#: So many levels in a row that take less than a share of what is left end the sparse part, or one where rows have so many entries.
PATIENCE, LEAST, DENSELY = 3, 0.05, 20
#: Unknowns of the largest core that is factorised in blocks.
CORE = 60_000
BLOCKS = "bi int, bj int, h int, w int, data binary"
VECTORS = "rhs int, idx int, value double"


class Singular(ValueError):
    def __init__(self, why: str):
        super().__init__(f"the matrix is singular: {why}")


@dataclass
class Level:
    """Unknowns that went together: their pivots (node, d), and their entries in the columns (lower) and rows (upper) of the rest."""

    pivots: DataFrame
    lower: DataFrame
    upper: DataFrame
    report: dict


@dataclass
class Factors:
    """M as levels and a core: ``blocks`` (factorised, with ``places`` of its unknowns) or ``rest``, entries that an iterative solver gets."""

    levels: list[Level]
    core: int
    rest: DataFrame
    blocks: DataFrame | None = None
    places: DataFrame | None = None
    many: int = 0
    report: dict = field(default_factory=dict)

    def fill(self) -> DataFrame:
        """A row for each level and one for the core: unknowns before it, eliminated ones, entries before and kept."""
        rows = [(i, "level", x.report["unknowns"], x.report["taken"], x.report["entries"], x.report["kept"]) for i, x in enumerate(self.levels)]
        rows.append((len(rows), "blocks" if self.blocks is not None else "rest", self.core, self.core, self.report["core_entries"], self.core**2 if self.blocks is not None else self.report["core_entries"]))
        return self.rest.sparkSession.createDataFrame(rows, "step int, kind string, unknowns long, taken long, entries long, kept long")


def _candidates(s: DataFrame) -> DataFrame:
    """Unknowns that may be pivots: node, d, and their order (cost, hash, node)."""
    side = lambda c, n, m: s.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(n), F.max(F.abs("value")).alias(m))
    diagonal = s.where("row_idx = col_idx").select(F.col("row_idx").alias("node"), F.col("value").alias("d"))
    able = diagonal.join(side("row_idx", "r", "rm"), "node").join(side("col_idx", "c", "cm"), "node").where(F.abs("d") >= PIVOT * F.least("rm", "cm"))
    cost = (F.col("r") - 1) * (F.col("c") - 1)
    return written(able.select("node", "d", cost.alias("cost"), F.struct(cost.alias("cost"), F.xxhash64("node").alias("h"), "node").alias("key")))


def _independent(s: DataFrame) -> DataFrame:
    """Pivots (node, d) no two of which share an entry: those that come before all their neighbours, among the cheaper half."""
    able = _candidates(s)
    half = able.agg(F.percentile_approx("cost", 0.5)).first()[0]
    if half is None:
        return able.select("node", "d")
    able = able.where(F.col("cost") <= half)
    off = s.where("row_idx <> col_idx")
    near = off.select(F.col("row_idx").alias("node"), F.col("col_idx").alias("other")).unionByName(off.select(F.col("col_idx").alias("node"), F.col("row_idx").alias("other")))
    first = near.join(able.select(F.col("node").alias("other"), F.col("key").alias("k")), "other").groupBy("node").agg(F.min("k").alias("least"))
    return able.join(first, "node", "left").where("least is null or key < least").select("node", "d")


def _shape(s: DataFrame) -> tuple[int, int, int]:
    return tuple(s.agg(F.count("*"), F.countDistinct("row_idx"), F.countDistinct("col_idx")).first())


def factorised(m: DataFrame, most: int) -> Factors:
    """Factors of M (row_idx, col_idx, value), with a core of at most ``most`` unknowns if the rest stays sparse."""
    s = written(m.where("value <> 0").select("row_idx", "col_idx", "value"))
    entries, rows, cols = _shape(s)
    left = m.select(F.col("row_idx").alias("node")).unionByName(m.select(F.col("col_idx").alias("node"))).distinct().count()
    levels: list[Level] = []
    poor = 0  # levels in a row that took little, as one unknown that all others share an entry with can hold them back
    while True:
        if rows < left or cols < left:
            raise Singular("a row or a column has no entry")
        if left <= most:
            break
        chosen = written(_independent(s))
        taken = chosen.count()
        poor = poor + 1 if taken < LEAST * left else 0
        if not taken or (poor and (entries > DENSELY * left or poor >= PATIENCE)):
            break
        e = s.join(chosen.select(F.col("node").alias("row_idx"), F.col("d").alias("dr")), "row_idx", "left").join(chosen.select(F.col("node").alias("col_idx"), F.col("d").alias("dc")), "col_idx", "left")
        e = written(e)
        lower = e.where("dc is not null and dr is null").select("row_idx", "col_idx", "value")
        upper = e.where("dr is not null and dc is null").select("row_idx", "col_idx", "value")
        times = e.where("dc is not null and dr is null").select("row_idx", F.col("col_idx").alias("p"), (F.col("value") / F.col("dc")).alias("l")).join(upper.select(F.col("row_idx").alias("p"), "col_idx", F.col("value").alias("u")), "p")
        rest = e.where("dr is null and dc is null").select("row_idx", "col_idx", "value").unionByName(times.select("row_idx", "col_idx", (-F.col("l") * F.col("u")).alias("value")))
        s = written(rest.groupBy("row_idx", "col_idx").agg(F.sum("value").alias("value")).where("value <> 0"))
        before = entries
        entries, rows, cols = _shape(s)
        kept = lower.count() + upper.count() + taken
        levels.append(Level(chosen, lower, upper, {"unknowns": left, "taken": taken, "entries": before, "kept": kept}))
        left -= taken
    out = Factors(levels, left, s, report={"core_entries": entries})
    return _blocked(out) if 0 < left <= CORE else out


# The core


def _matrix(r: dict, name: str = "data") -> np.ndarray:
    return np.frombuffer(r[name], np.float64).reshape(r["h"], r["w"])


def _block(bi: int, bj: int, x: np.ndarray) -> pa.Table:
    return pa.Table.from_pylist([{"bi": bi, "bj": bj, "h": x.shape[0], "w": x.shape[1], "data": np.ascontiguousarray(x).tobytes()}], BLOCK_SCHEMA)


BLOCK_SCHEMA = pa.schema([("bi", pa.int32()), ("bj", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())])


def _dense(size: int, unknowns: int) -> Callable[[pa.Table], pa.Table]:
    def f(t: pa.Table) -> pa.Table:
        bi, bj = t["bi"][0].as_py(), t["bj"][0].as_py()
        x = np.zeros((min(size, unknowns - bi * size), min(size, unknowns - bj * size)))
        x[t["i"].to_numpy(), t["j"].to_numpy()] = t["value"].to_numpy()
        return _block(bi, bj, x)

    return f


def _inverse(t: pa.Table) -> pa.Table:
    """The inverse of a diagonal block; one without data where that is singular."""
    r = t.to_pylist()[0]
    x = _matrix(r)
    try:
        w = np.linalg.inv(x)
        good = np.isfinite(w).all() and np.abs(w).max() * np.abs(x).max() < 1e13
    except np.linalg.LinAlgError:
        good = False
    return _block(r["bi"], r["bj"], w) if good else pa.Table.from_pylist([{"bi": r["bi"], "bj": r["bj"], "h": 0, "w": 0, "data": None}], BLOCK_SCHEMA)


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks of ``left`` by those of ``right`` whose row is their column."""
    a = left.select("bi", F.col("bj").alias("k"), F.col("h").alias("h1"), F.col("w").alias("w1"), F.col("data").alias("d1"))
    b = right.select(F.col("bi").alias("k"), "bj", F.col("h").alias("h2"), F.col("w").alias("w2"), F.col("data").alias("d2"))
    return a.join(b, "k").select("bi", "bj", "h1", "w1", "d1", "h2", "w2", "d2")


def _added(sign: float) -> Callable[[pa.Table], pa.Table]:
    """The sum of a place's blocks (d1 without d2) and ``sign`` times its products."""

    def f(t: pa.Table) -> pa.Table:
        out = None
        for i in range(len(t)):
            r = t.slice(i, 1).to_pylist()[0]
            x = np.frombuffer(r["d1"], np.float64).reshape(r["h1"], r["w1"])
            if r["d2"] is not None:
                x = sign * (x @ np.frombuffer(r["d2"], np.float64).reshape(r["h2"], r["w2"]))
            out = x if out is None else out + x
        return _block(t["bi"][0].as_py(), t["bj"][0].as_py(), out)

    return f


def _summed(whole: DataFrame | None, products: DataFrame, sign: float) -> DataFrame:
    rows = products
    if whole is not None:
        none = F.lit(None)
        rows = whole.select("bi", "bj", F.col("h").alias("h1"), F.col("w").alias("w1"), F.col("data").alias("d1"), none.cast("int").alias("h2"), none.cast("int").alias("w2"), none.cast("binary").alias("d2")).unionByName(products)
    return rows.groupBy("bi", "bj").applyInArrow(_added(sign), BLOCKS)


def _blocked(f: Factors) -> Factors:
    """Factorises the core: below the diagonal blocks times the inverse of their column's, on the diagonal that inverse, above it as they are."""
    size = min(BLOCK, max(f.core, 1))
    many = -(-f.core // size)
    # Unknowns that can't be pivots come last: by then others have changed their entries.
    able = _candidates(f.rest).select("node", F.lit(False).alias("weak"))
    order = f.rest.select(F.col("row_idx").alias("node")).distinct().join(able, "node", "left").fillna(True, ["weak"])
    places = written(numbered(order, ["weak", "node"], "place").drop("weak"))
    at = lambda c, b, i: places.select(F.col("node").alias(c), F.floor(F.col("place") / size).cast("int").alias(b), (F.col("place") % size).cast("int").alias(i))
    cells = f.rest.join(at("row_idx", "bi", "i"), "row_idx").join(at("col_idx", "bj", "j"), "col_idx").select("bi", "bj", "i", "j", "value")
    now = written(cells.groupBy("bi", "bj").applyInArrow(_dense(size, f.core), BLOCKS))
    done: list[DataFrame] = []
    for k in range(many):
        inverse = written(now.where((F.col("bi") == k) & (F.col("bj") == k)).groupBy("bi", "bj").applyInArrow(_inverse, BLOCKS))
        if not inverse.where("data is not null").limit(1).count():
            return f  # left to an iterative solver
        row = now.where((F.col("bi") == k) & (F.col("bj") > k))
        done += [inverse, row]
        if k + 1 < many:
            column = written(_summed(None, _paired(now.where((F.col("bj") == k) & (F.col("bi") > k)), inverse), 1.0))
            done.append(column)
            now = written(_summed(now.where((F.col("bi") > k) & (F.col("bj") > k)), _paired(column, row), -1.0))
    f.blocks, f.places, f.many = written(_all(done)), places, many
    return f


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _columns(y: DataFrame, f: Factors) -> DataFrame:
    """Right-hand sides of the core as blocks: bi their place, bj their number by ``RHS``."""
    size = min(BLOCK, max(f.core, 1))
    place = f.places.select(F.col("node").alias("idx"), F.floor(F.col("place") / size).cast("int").alias("bi"), (F.col("place") % size).cast("int").alias("i"))
    cells = y.join(place, "idx").select("bi", F.floor(F.col("rhs") / RHS).cast("int").alias("bj"), "i", F.pmod("rhs", F.lit(RHS)).cast("int").alias("j"), "value")
    core = f.core

    def dense(t: pa.Table) -> pa.Table:
        bi = t["bi"][0].as_py()
        x = np.zeros((min(size, core - bi * size), RHS))
        x[t["i"].to_numpy(), t["j"].to_numpy()] = t["value"].to_numpy()
        return _block(bi, t["bj"][0].as_py(), x)

    return cells.groupBy("bi", "bj").applyInArrow(dense, BLOCKS)


def _through(f: Factors, y: DataFrame) -> DataFrame:
    """The core's x (rhs, idx, value) by forward and backward substitution over its blocks."""
    place = lambda row, col: f.blocks.where(row & col)
    bi, bj = F.col("bi"), F.col("bj")
    now, tops = written(_columns(y, f)), []
    for k in range(f.many):
        tops.append(now.where(bi == k))
        if k + 1 < f.many:
            now = written(_summed(now.where(bi > k), _paired(place(bi > k, bj == k), tops[k]), -1.0))
    x: list[DataFrame] = []
    now = _all(tops)
    for k in reversed(range(f.many)):
        x.append(written(_summed(None, _paired(place(bi == k, bj == k), now.where(bi == k)), 1.0)))
        if k:
            now = written(_summed(now.where(bi < k), _paired(place(bi < k, bj == k), x[-1]), -1.0))
    size = min(BLOCK, max(f.core, 1))

    def cells(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                v = _matrix(r)
                at, rhs = np.nonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array((rhs + r["bj"] * RHS).astype(np.int32)), pa.array(at + r["bi"] * size), pa.array(v[at, rhs])], ["rhs", "place", "value"])

    return _all(x).mapInArrow(cells, "rhs int, place long, value double").join(f.places, "place").select("rhs", F.col("node").alias("idx"), "value")


def solved(f: Factors, y: DataFrame, core: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """x (rhs, idx, value) of M x = y; ``core`` solves what has no blocks, given its entries and right-hand sides."""
    kept = []
    for level in f.levels:
        y = written(y)
        own = y.join(level.pivots.select(F.col("node").alias("idx"), "d"), "idx", "left")
        mine = own.where("d is not null").select("rhs", "idx", (F.col("value") / F.col("d")).alias("value"))
        less = level.lower.join(mine.select("rhs", F.col("idx").alias("col_idx"), F.col("value").alias("v")), "col_idx").select("rhs", F.col("row_idx").alias("idx"), (-F.col("value") * F.col("v")).alias("value"))
        kept.append(mine)
        y = own.where("d is null").select("rhs", "idx", "value").unionByName(less).groupBy("rhs", "idx").agg(F.sum("value").alias("value")).where("value <> 0")
    y = written(y)
    x = written(_through(f, y) if f.blocks is not None else core(f.rest, y)) if f.core else y.where("false")
    for level, mine in zip(reversed(f.levels), reversed(kept), strict=True):
        scaled = level.upper.join(level.pivots.select(F.col("node").alias("row_idx"), "d"), "row_idx")
        less = scaled.join(x.select("rhs", F.col("idx").alias("col_idx"), F.col("value").alias("v")), "col_idx").select("rhs", F.col("row_idx").alias("idx"), (-F.col("value") / F.col("d") * F.col("v")).alias("value"))
        new = mine.unionByName(less).groupBy("rhs", "idx").agg(F.sum("value").alias("value")).where("value <> 0")
        x = written(x.unionByName(new))
    return x
