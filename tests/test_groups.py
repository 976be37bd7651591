"""Equal multisets, exact order statistics, and answers that follow rewritten tables."""

import gzip
import json
import math
import shutil
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import multisets, selection
from tessera.plans import registry
from tessera.sources import factors, references, tiles
from tessera.sources.tables import written


def lines(spark, groups):
    return written(multisets.counted(spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "id int, x string"), "id", F.col("x")))


GROUPS = {1: "ab", 2: "ba", 3: "aab", 4: "abb", 5: "baa", 6: "c", 7: "ab", 8: "abc"}


@pytest.mark.parametrize("collide", [False, True])
def test_equal_multisets_whatever_their_hashes(spark, monkeypatch, collide):
    """With hashes that always collide, groups of as many lines are told apart line by line."""
    if collide:
        monkeypatch.setattr(multisets, "halves", lambda line: (F.lit(1).cast("decimal(20,0)"), F.lit(2).cast("decimal(20,0)")))
    got = {r[0]: r[1] for r in multisets.classes(lines(spark, GROUPS)).select("key", "first").collect()}
    first = defaultdict(lambda: 99)
    for k, v in GROUPS.items():
        first[tuple(sorted(v))] = min(first[tuple(sorted(v))], k)
    assert got == {k: first[tuple(sorted(v))] for k, v in GROUPS.items()}


def test_digests_do_not_depend_on_order_but_on_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "a")], "k int, x string").repartition(4)
    got = {r.k: r.d for r in df.groupBy("k").agg(multisets.digest(F.col("x")).alias("d")).collect()}
    assert got[1] == got[2] != got[3]


def test_order_statistics_are_exact(spark, monkeypatch):
    """Groups of hot values, wide ranges, few rows and none: the ranks by narrowed ranges equal those of sorted values."""
    monkeypatch.setattr(selection, "SMALL", 50)
    rng = np.random.default_rng(3)
    groups = {"even": rng.normal(size=6000), "hot": np.r_[np.full(5000, 7.0), rng.normal(size=800)], "wide": np.exp(rng.normal(size=4001) * 60), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([5.0]), "same": np.full(3000, 1.5)}
    data = [(g, float(v)) for g, x in groups.items() for v in x] + [("few", None), ("none", None), ("few", float("nan"))]
    df = spark.createDataFrame(data, "grp string, v double").repartition(5)
    got = {r.grp: r for r in selection.selected(df, "grp", "v", {"p95": selection.nearest_rank(0.95), "least": F.lit(1), "over": F.col("n") + 1, **selection.middle()}).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        x = np.sort(np.r_[x, np.nan] if g == "few" else x)
        n = len(x)
        assert (got[g].low, got[g].high, got[g].least, got[g].over) == (x[(n - 1) // 2], x[n // 2], x[0], None), g
        p95 = x[math.ceil(0.95 * n) - 1]
        assert got[g].p95 == p95 or (math.isnan(p95) and math.isnan(got[g].p95)), g


def test_no_ranges_are_read_for_an_empty_table(spark):
    df = spark.createDataFrame([], "grp string, v double")
    assert selection.selected(df, "grp", "v", selection.middle()).collect() == []


def test_answers_follow_rewritten_tables(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    for t in ("nation", "supplier", "part", "lineitem"):
        shutil.copy(f"{data}/{t}.parquet", tmp_path / f"{t}.parquet")
    ask = lambda: Counter(tuple(r) for r in registry.queries()["qr01"](spark, str(tmp_path)).collect())
    before = ask()
    assert before == ask()
    spark.read.parquet(f"{data}/lineitem.parquet").withColumn("l_extendedprice", F.col("l_extendedprice") * 2).coalesce(1).write.parquet(str(tmp_path / "new"))
    (tmp_path / "lineitem.parquet").unlink()
    shutil.copytree(tmp_path / "new", tmp_path / "lineitem.parquet")
    after = ask()
    assert {k: v for k, v in after} == pytest.approx({k: 2 * v for k, v in before}, abs=2e-6)


def test_affected_roots_by_bits(spark):
    """More sources than bits of a row, cycles, sources that are roots, and roots that reach nothing, against a search from each root."""
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 400, (700, 2))} | {(400 + i, 400 + (i + 1) % 50) for i in range(50)}
    sources, roots = [*range(0, 300, 2), 425, 999], [*range(1, 400, 7), 400, 449, 999, 1000]
    got = references.affected(spark.createDataFrame(sorted(pairs), "src int, dst int"), spark.createDataFrame([(i,) for i in sources], "node int"), spark.createDataFrame([(i,) for i in roots + roots[:3]], "node int"))
    want = set()
    for root in roots:
        seen, todo = {root}, [root]
        while todo:
            at = todo.pop()
            new = {b for a, b in pairs if a == at} - seen
            seen |= new
            todo += new
        want |= {(i, root) for i in seen & set(sources)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_changed_order_rebuilds_its_columns_alone(spark):
    from tessera.plans import solving
    from tessera.sources.network import Network

    data = "/root/testdata/sf0.01"
    old, new = solving._Before(spark, data), Network(spark, data)
    a, b, h, at_a, at_b = solving._followed(old, new)
    last = new.table("lineitem").join(new.table("lineitem").agg(F.max("l_orderkey").alias("l_orderkey")), "l_orderkey").select("l_suppkey").distinct()
    touched = {r.l_suppkey for r in last.collect()}
    assert {r.col_idx for r in at_b.collect()} == touched and touched <= {r.col_idx for r in at_a.collect()}
    assert at_a.count() < new.n / 2
    cells = lambda m: {(r.row_idx, r.col_idx): r.value for r in m.collect()}
    assert cells(a) == pytest.approx(cells(new.a)) and cells(b) == pytest.approx(cells(new.b))
    from tessera.operators import linear

    assert cells(h) == pytest.approx(cells(linear.adjoint(new.a, linear.product(new.c, new.b), new.n)), abs=1e-9)


def test_mended_impacts_equal_solved_ones(spark, monkeypatch):
    from tessera.operators import linear, snapshots

    rng = np.random.default_rng(8)
    n = 12
    m = np.eye(n) * 3 - rng.random((n, n))
    u = np.zeros((n, n))
    u[:, [2, 5, 7]] = rng.random((n, 3)) * 0.3
    d, more = rng.random((2, n)), np.zeros((2, n))
    more[:, 4] = 1.0
    table = lambda x: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "row_idx int, col_idx int, value double")
    solver = linear.Solver(linear.transposed(table(m)), n)
    got = snapshots.mended(table(d @ np.linalg.inv(m)), solver, table(u), table(more))
    x = np.zeros((2, n))
    for r in got.collect():
        x[r.row_idx, r.col_idx] = r.value
    assert x == pytest.approx((d + more) @ np.linalg.inv(m + u), abs=1e-10)
    monkeypatch.setattr(snapshots, "MOST", 2)
    with pytest.raises(ValueError, match="anew"):
        snapshots.mended(table(d), solver, table(u), table(more))


def test_a_view_opens_the_files_that_it_touches(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-500, 500, (5000, 2)))]
    df = spark.createDataFrame([*data, (5000, None, 1.0)], "id int, x double, y double")
    index = tiles.write(df, str(tmp_path), size=100)
    assert index.count() > 40 and index.agg(F.sum("points")).first()[0] == 5000
    got = tiles.view(spark, str(tmp_path), df.schema, -100.0, 0.0, 50.0, 120.0)
    want = {i for i, x, y in data if -100 <= x <= 0 and 50 <= y <= 120}
    assert {r.id for r in got.collect()} == want and len(want) > 20
    assert len(got.inputFiles()) <= index.count() / 5
    assert tiles.view(spark, str(tmp_path), df.schema, 900.0, 901.0, 0.0, 1.0).collect() == []
    none = tmp_path / "none"
    assert tiles.write(df.limit(0), str(none)).count() == 0 and tiles.view(spark, str(none), df.schema, 0, 1, 0, 1).count() == 0


def test_records_of_an_index_are_read_piece_by_piece(spark, tmp_path):
    index = {f"k{i}": {"flow_id": f'a,"{{[\\{i}', "list": [{"x": [1, 2, {}]}, "}"] * (i % 4), "n": i} for i in range(3000)} | {"plain": 1, "text": "a,b"}
    for indent in (None, 1):
        cut = json.dumps(index, indent=indent).split(",")
        assert [json.loads("{" + e + "}") for e in factors.entries(iter(cut))] == [{k: v} for k, v in index.items()]
    with gzip.open(tmp_path / "index.json.gz", "wt") as f:
        json.dump(index, f)
    rows = factors.read(spark, str(tmp_path / "index.json.gz"))
    assert rows.count() == len(index) and max(len(r.json) for r in rows.collect()) < 300
    assert list(factors.entries(iter(["{}"]))) == list(factors.entries(iter([" { } "]))) == []
    assert list(factors.entries(iter('{"a": 1}\n{"b": 2, "c": {}}'.split(",")))) == ['"a": 1', '"b": 2', ' "c": {}']
    for bad in ("", "[1", '{"a": 1', '{"a": "b', '{"a": 1} x', '{"a": "\\'):
        with pytest.raises(ValueError):
            list(factors.entries(iter(bad.split(","))))
