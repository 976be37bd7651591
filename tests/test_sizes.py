"""What must not grow with copies of the tables, and what is made once."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, layout, linear, linking
from tessera.plans import registry, solving
from tessera.sources.network import Network

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """The network's tables with every supplier ten times."""
    path, many = str(tmp_path_factory.mktemp("copies")), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("copy")
    k = spark.read.parquet(f"{SF}/supplier.parquet").count()
    for name in ("nation", "part", "supplier", "lineitem"):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        key = {"supplier": "s_suppkey", "lineitem": "l_suppkey"}.get(name)
        if key:
            t = t.select("*", many).withColumn(key, F.col(key) + F.col("copy") * k).drop("copy")
        t.write.parquet(f"{path}/{name}.parquet")
    return path


def test_passes_do_not_grow_with_the_processes(spark, copies, monkeypatch):
    counts, passed = [], graph.passed
    monkeypatch.setattr(graph, "passed", lambda *x: counts.append(1) or passed(*x))
    few = {r.node for r in registry.queries()["ss04"](spark, SF).collect()}
    base = len(counts)
    many = {r.node for r in registry.queries()["ss04"](spark, copies).collect()}
    assert len(counts) == 2 * base
    k = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert {x % k for x in many} == few
    assert len(many) > 20 * base


def test_parts_of_entries_are_counted_without_a_shuffle_of_pairs(spark):
    plan = registry.queries()["ag01"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    at = plan.index("HashAggregate")
    assert "Exchange" not in plan[at : plan.index("BroadcastHashJoin")].replace("BroadcastExchange", ""), plan


def test_texts_are_parsed_once(spark):
    """Filters on what is parsed were evaluated below it, with the parsing anew."""
    plan = registry.queries()["cp04"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    parsed = [x for x in plan.splitlines() if "from_json(" in x or "get_json_object(" in x or "to_json(" in x]
    assert parsed and not [x for x in parsed if "Filter " in x], plan


@pytest.mark.parametrize("held", [1_000_000, 7])
def test_edges_of_a_layout_stay_where_they_are(spark, monkeypatch, held):
    """A round shuffled every edge; now places and sums alone are, also where edges have to meet places in parts."""
    monkeypatch.setattr(layout, "HELD", held)
    pairs = [(i % 20, i * 7 % 90) for i in range(600)]
    nodes = spark.createDataFrame([(f"p{i}", i, "process") for i in range(20)] + [(f"f{i}", 100 + i, "flow") for i in range(90)], "id string, n long, kind string")
    edges = layout._dealt(nodes, spark.createDataFrame([(f"p{p}", f"f{f}") for p, f in pairs], "process string, flow string"))
    placed = nodes.selectExpr("n", "kind", "cast(n as double) as v")
    for kind, other, ends in (("process", "flow", [(p, 100 + f) for p, f in pairs]), ("flow", "process", [(100 + f, p) for p, f in pairs])):
        sums = edges.sums(kind, placed.where(placed.kind == other).select("n", "v"))
        want = {}
        for a, b in ends:
            want[a] = want.get(a, 0.0) + b
        assert {r.n: r.v for r in sums.collect()} == want
        lines = sums._jdf.queryExecution().executedPlan().toString().splitlines()
        scans = [i for i, x in enumerate(lines) if "InMemoryTableScan" in x]
        assert scans
        for i in scans:
            above = next(x for x in reversed(lines[:i]) if not any(y in x for y in ("Filter", "Project", "ColumnarToRow", "TableCacheQueryStage")))
            assert "Exchange hashpartitioning" not in above, lines
    edges.rows.unpersist()


def test_snapshots_keep_factors_not_entries(spark, copies):
    """Ten times the processes have a hundred times the entries; what a snapshot keeps of A grows with the processes."""
    kept, entries = [], []
    for path in (SF, copies):
        n = Network(spark, path)
        base = solving._snapshot(n)
        a = linking.Factored.read(spark, f"{base}/matrices/a")
        kept.append(a.loads.count() + a.shares.count())
        entries.append(a.count())
        got = {(r.row_idx, r.col_idx): r.value for r in linking.activities(a.pairs()).collect()}
        want = {(r.row_idx, r.col_idx): r.value for r in n.a.collect()}
        assert len(got) == len(want) == a.count()
        assert got == pytest.approx(want, rel=1e-12)
    assert entries[1] == 100 * entries[0] and kept[1] == 10 * kept[0]


def test_evidence_keeps_what_edges_follow_from(spark, copies):
    """Ten times the processes have a hundred times the edges; the evidence, in chunks of bounded length, grows with the processes, and every edge comes back."""
    kept = []
    for path in (SF, copies):
        n = Network(spark, path)
        rows = spark.read.parquet(solving._evidence(n)).select("version", "format", "records").collect()
        kept.append(sum(r.records for r in rows))
        assert {(r.version, r.format) for r in rows} == {(v, f"release-evidence-{k}") for v in (1, 2) for k in ("loads", "shares")}
        assert max(r.records for r in rows) <= 256 * 24
    assert kept[1] == 10 * kept[0]
    want = {(r.row_idx, r.col_idx): r.value for r in Network(spark, copies).a.collect()}
    got = registry.queries()["src05"](spark, copies).collect()
    for v in (1, 2):
        mine = {(r.row_idx, r.col_idx): r.value for r in got if r.version == v}
        assert mine == pytest.approx(want, abs=1e-6)
    assert len(got) == 2 * len(want)


def test_the_system_that_is_solved_does_not_grow_with_the_processes(spark, copies, monkeypatch):
    """A matrix of as many unknowns as processes went to one task; now its unknowns are the places that are asked.

    These are the solvers of all queries on solutions: la10 and la11 call the first, the others those of the model.
    """
    sizes, made = [], linear.Solver.__init__
    monkeypatch.setattr(linear.Solver, "__init__", lambda self, m, n, *x: sizes.append(n) or made(self, m, n, *x))
    n = Network(spark, copies)
    registry._impacts(n)
    model = linear.prepare(n.product, n.b, n.c, n.n, n.m())
    assert model.rows and model.columns
    assert len(sizes) == 3 and max(sizes) <= n.nearest.select("flow", "sign", "tier", "place").distinct().count() < n.n


def test_an_envelope_holds_a_part_of_a_solution(spark, monkeypatch):
    """A demand's whole solution was one task's group."""
    monkeypatch.setattr(solving, "PART", 4)
    seen, encoded = [], solving.artifacts.encoded
    monkeypatch.setattr(solving.artifacts, "encoded", lambda *x, **y: seen.append(encoded(*x, **y)) or seen[0])
    got = registry.queries()["snk01"](spark, SF).collect()
    rows = seen[0].select("name", "records").collect()
    assert max(r.records for r in rows) <= 4 < max(sum(r.rhs == k for r in got) for k in range(3))
    assert len({r.name for r in rows}) == len(rows) and sum(r.records for r in rows) == len(got)
