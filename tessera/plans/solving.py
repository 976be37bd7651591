"""Queries on solving: prepared models, demands, residuals, stored results, and the files that results become."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import graph, linear, linking, snapshots
from ..sources import artifacts, exports, results
from ..sources.network import FLOWS, Network
from ..sources.tables import shared_folder, written
from .registry import NETWORK, SOLVED, STEPS, query

#: Demands (rhs, process, amount) that the queries solve.
DEMANDS = ((0, 1, 1.0), (0, 2, 2.0), (1, 3, 1.0), (2, 0, 0.5))
#: Processes of an envelope of a solution at most.
PART = 1 << 16
#: Names and units of the derived network's impacts.
IMPACTS = (("GWP", "Global warming", "kg CO2-eq"), ("AP", "Acidification", "mol H+-eq"), ("EP", "Eutrophication", "kg P-eq"))


def _series(name: str, start: str) -> str:
    """SQL of the tables name0 to name{STEPS}: name{k} = start + A name{k - 1}."""
    step = ", ".join(f"{name}{k} AS MATERIALIZED (SELECT rhs, idx, sum(value) AS value FROM (SELECT rhs, idx, value FROM {start} UNION ALL SELECT v.rhs, a.row_idx, v.value * a.value FROM {name}{k - 1} v JOIN a ON a.col_idx = v.idx) GROUP BY 1, 2)" for k in range(1, STEPS + 1))
    return f"{name}0 AS (SELECT * FROM {start}), {step}, {name} AS (SELECT * FROM {name}{STEPS})"


def _backward(name: str, start: str) -> str:
    """SQL of name{k} = start + name{k - 1} A, rows by (row_idx, col_idx)."""
    step = ", ".join(f"{name}{k} AS MATERIALIZED (SELECT row_idx, col_idx, sum(value) AS value FROM (SELECT row_idx, col_idx, value FROM {start} UNION ALL SELECT v.row_idx, a.col_idx, v.value * a.value FROM {name}{k - 1} v JOIN a ON v.col_idx = a.row_idx) GROUP BY 1, 2)" for k in range(1, STEPS + 1))
    return f"{name}0 AS (SELECT * FROM {start}), {step}, {name} AS (SELECT * FROM {name}{STEPS})"


_Y = "y AS (SELECT * FROM (VALUES " + ", ".join(map(str, DEMANDS)) + ") AS t(rhs, idx, value) WHERE idx IN (SELECT process_idx FROM process))"
_X = f"{NETWORK}, {_Y}, {_series('x', 'y')}, g AS (SELECT x.rhs, b.row_idx AS idx, sum(b.value * x.value) AS value FROM x JOIN b ON b.col_idx = x.idx GROUP BY 1, 2), hx AS (SELECT g.rhs, c.row_idx AS idx, sum(c.value * g.value) AS value FROM g JOIN c ON c.col_idx = g.idx GROUP BY 1, 2)"
_M = "m AS (SELECT row_idx, col_idx, sum(value) AS value FROM (SELECT row_idx, col_idx, -value AS value FROM a UNION ALL SELECT process_idx, process_idx, 1.0 FROM process) GROUP BY 1, 2)"
_LCI = f"{SOLVED}, {_backward('u', 'b')}"


_PREPARED: dict[tuple[str, str], tuple[str, linear.Prepared]] = {}


def _model(n: Network) -> linear.Prepared:
    """The network's model, prepared once for each application and state of the tables: rewritten tables get a new one."""
    key, state = (n.spark.sparkContext.applicationId, n.dir), n.state
    if _PREPARED.get(key, ("",))[0] != state:
        _PREPARED[key] = state, linear.prepare(n.product, written(n.b), written(n.c), n.n, n.m())
    return _PREPARED[key][1]


def _demands(n: Network) -> DataFrame:
    y = n.spark.createDataFrame([(r, i, v) for r, i, v in DEMANDS], "rhs int, idx int, value double")
    return y.join(n.processes.select(F.col("process_idx").alias("idx")), "idx", "left_semi").select("rhs", "idx", "value")


def _units(n: Network) -> DataFrame:
    return _model(n).solve_all_units().select(F.col("rhs").alias("process_idx"), F.col("idx").alias("impact"), F.col("value").alias("amount"))


_STORED: dict[tuple[str, str], tuple[str, str]] = {}


def _stored(n: Network) -> str:
    """Where the impacts of all units lie; they are solved and written once for each application and state of the tables."""
    key, state = (n.spark.sparkContext.applicationId, n.dir), n.state
    if _STORED.get(key, ("",))[0] != state:
        path = shared_folder(n.spark)
        results.check_coverage(results.write(_units(n), path), n.n)
        _STORED[key] = state, path
    return _STORED[key][1]


# Linear algebra


@query("la04", f"SELECT 'network' AS model, CASE WHEN bool_and(abs(value) > 1e-12) THEN 'ready' ELSE 'near_singular' END AS state, (SELECT count(*) FROM m WHERE abs(value) > 1e-15) AS m_nnz, (SELECT count(*) FROM b WHERE abs(value) > 1e-15) AS b_nnz, (SELECT count(*) FROM c) AS c_nnz FROM m WHERE row_idx = col_idx UNION ALL SELECT 'no column', 'failed', NULL, NULL, NULL UNION ALL SELECT 'dependent rows', 'failed', NULL, NULL, NULL", f"{NETWORK}, {_M}")
def la04(n):
    """Factorisation: the network is ready; an empty column and dependent rows fail, the first by structure, the second by value."""
    k = n.spark
    shape = "row_idx int, col_idx int, value double"
    cases = {"no column": k.createDataFrame([(0, 0, 1.0)], shape), "dependent rows": k.createDataFrame([(0, 1, -1.0), (1, 0, -1.0)], shape)}
    rows = []
    for name, a in cases.items():
        try:
            model = linear.prepare(a, n.b, n.c, 2)
            linear.solve(model.m, k.createDataFrame([(0, 0, 1.0)], linear.VECTORS), 2).collect()
            rows.append((name, "ready", None, None, None))
        except Exception as e:  # noqa: BLE001 (Spark wraps a worker's error)
            if "singular" not in str(e) and "empty" not in str(e):
                raise
            rows.append((name, "failed", None, None, None))
    model = _model(n)
    state = "ready" if model.report["status"] == "ok" else "near_singular"
    rows.append(("network", state, model.report["nnz"], model.b.count(), model.c.count()))
    return k.createDataFrame(rows, "model string, state string, m_nnz long, b_nnz long, c_nnz long")


@query("la05", "SELECT 'x' AS vector, idx, round(value, 6) AS amount FROM x WHERE rhs = 0 UNION ALL SELECT 'g', idx, round(value, 6) FROM g WHERE rhs = 0 UNION ALL SELECT 'h', idx, round(value, 6) FROM hx WHERE rhs = 0", _X)
def la05(n):
    """One demand: activities, inventory and impacts."""
    found = _model(n).solve(_demands(n).where("rhs = 0"), x=True, g=True, h=True)
    parts = [v.select(F.lit(k).alias("vector"), "idx", F.round("value", 6).alias("amount")) for k, v in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("la06", "SELECT rhs, idx AS impact, round(value, 6) AS amount FROM hx", _X)
def la06(n):
    """A batch of demands, impacts only."""
    return _model(n).solve(_demands(n), x=False, h=True)["h"].select("rhs", F.col("idx").alias("impact"), F.round("value", 6).alias("amount"))


@query("la07", "SELECT col_idx // 128 AS batch, col_idx AS process_idx, row_idx AS impact, round(value, 6) AS amount FROM h", SOLVED)
def la07(n):
    """One unit of every process, with the batch of 128 in which it is asked for."""
    return _units(n).select(F.floor(F.col("process_idx") / linear.RHS).alias("batch"), "process_idx", "impact", F.round("amount", 6).alias("amount"))


@query("la12", "SELECT y.rhs, round((SELECT max(s) FROM (SELECT sum(abs(value)) AS s FROM m GROUP BY row_idx)), 6) AS m_norm, round((SELECT max(abs(value)) FROM x WHERE x.rhs = y.rhs), 6) AS x_norm, round(max(abs(value))::DOUBLE, 6) AS y_norm, 0.0::DOUBLE AS relative FROM y GROUP BY 1", f"{_X}, {_M}")
def la12(n):
    """The residual of M x = y over |M| |x| + |y|, to twelve places, with these norms."""
    model, y = _model(n), _demands(n)
    r = linear.residual(model.m, model.solve(y)["x"], y, model.factors, n.ruled("split_by_process_volume").norm(n.n))
    return r.select("rhs", F.round("m_norm", 6).alias("m_norm"), F.round("x_norm", 6).alias("x_norm"), F.round("y_norm", 6).alias("y_norm"), F.round("relative", 12).alias("relative"))


@query("la13", "SELECT row_idx, col_idx, round(value, 6) + 0.0 AS value FROM (SELECT process_idx AS row_idx, process_idx AS col_idx, 1.0 - coalesce((SELECT sum(value) FROM a WHERE row_idx = process_idx AND col_idx = process_idx), 0) AS value FROM process UNION ALL SELECT row_idx, col_idx, -value FROM a WHERE row_idx <> col_idx AND value <> 0) WHERE value <> 0")
def la13(n):
    """The entries of M from those of A by exact tests of zero, without an epsilon."""
    return n.m(0.0).select("row_idx", "col_idx", (F.round("value", 6) + 0.0).alias("value"))


@query("la14", "SELECT 'x' AS vector, rhs, count(*) AS size, round(max(abs(value)), 6) AS largest, true AS passed FROM x GROUP BY 2 UNION ALL SELECT 'g', rhs, count(*), round(max(abs(value)), 6), true FROM g GROUP BY 2 UNION ALL SELECT 'h', rhs, count(*), round(max(abs(value)), 6), true FROM hx GROUP BY 2", _X)
def la14(n):
    """x, g and h of the solver against those of a power series, an independent way to them."""
    model, y = _model(n), _demands(n)
    found = model.solve(y, x=True, g=True, h=True)
    x = linear.neumann(model.factors, y)
    g = linear._matvec(model.b, x)
    other = {"x": x, "g": g, "h": linear._matvec(model.c, g)}
    out = None
    for k, v in found.items():
        largest = v.groupBy("rhs").agg(F.max(F.abs("value")).alias("l"))
        part = linear.compared(v, other[k]).join(largest, "rhs").select(F.lit(k).alias("vector"), "rhs", "size", F.round("l", 6).alias("largest"), "passed")
        out = part if out is None else out.unionByName(part)
    return out


@query("la15", "SELECT * FROM (VALUES (0, 'status', 'none'), (1, 'prepare', 'ready'), (2, 'prepare large', 'failed'), (3, 'invalidate', '1'), (4, 'status', 'none'), (5, 'rebuild', 'ready')) AS t(step, action, state)", "")
def la15(n):
    """A model's life: unknown, prepared, one over the capacity refused, invalidated, built anew."""
    models, model = linear.Models(capacity=1 << 30), (n.product, written(n.b), n.c, n.n)
    states = [("status", models.status("v1") or "none"), ("prepare", models.prepare("v1", *model))]
    small = linear.Models(capacity=1)
    states += [("prepare large", small.prepare("v1", *model)), ("invalidate", str(models.invalidate("v1"))), ("status", models.status("v1") or "none"), ("rebuild", models.prepare("v1", *model))]
    return n.spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(states)], "step int, action string, state string")


@query("ss03", "SELECT * FROM (VALUES ('a', 'ready'), ('b', 'evicted'), ('c', 'ready')) AS t(version, state)", "")
def ss03(n):
    """Prepared models by least recent use: the third takes the place of the one not asked for since."""
    model = n.product, written(n.b), n.c, n.n
    models = linear.Models(capacity=linear.Models.size_of(*model) * 2)
    for v in ("a", "b"):
        models.prepare(v, *model)
    models.get("a")
    models.prepare("c", *model)
    return n.spark.createDataFrame([(v, models.status(v) or "evicted") for v in ("a", "b", "c")], "version string, state string")


# Snapshots


class _Before(Network):
    """The tables before their last order came."""

    def table(self, name: str) -> DataFrame:
        rows = super().table(name)
        return rows.join(F.broadcast(rows.agg(F.max("l_orderkey").alias("l_orderkey"))), "l_orderkey", "left_anti") if name == "lineitem" else rows


def _elementary(n: Network) -> DataFrame:
    return n.table("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice")


def _marks(n: Network) -> tuple[DataFrame, DataFrame]:
    """Marks of A's and B's columns."""
    return written(snapshots.technosphere_marks(n.nearest, n.offers)), written(snapshots.column_marks(_elementary(n), "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice"))


def _followed(old: Network, new: Network) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """A and B of the new tables from those of the old, with the changed columns alone built anew: a, b, h and the changed columns of both.

    Stored impacts need the changed columns of A alone; where too many have changed they are solved anew.
    """
    b = written(old.b)
    solver = old.product.transposed().solver(old.n)
    as_h = lambda x: x.select(F.col("rhs").alias("row_idx"), F.col("idx").alias("col_idx"), "value")
    h = written(as_h(solver.solve(linear.product(old.c, b).select(F.col("row_idx").alias("rhs"), F.col("col_idx").alias("idx"), "value"))))
    at_a, at_b = (written(snapshots.changed(p, q)) for p, q in zip(_marks(old), _marks(new), strict=True))

    def columns(n: Network) -> DataFrame:
        return linking.technosphere(linking.routed(n.nearest.join(at_a.withColumnRenamed("col_idx", "consumer"), "consumer", "left_semi"), n.offers))

    new_a = snapshots.replaced(old.a, at_a, columns(new))
    new_b = written(snapshots.replaced(b, at_b, new.b.join(at_b, "col_idx", "left_semi")))
    if at_a.count() > snapshots.MOST:
        return new_a, new_b, linear.adjoint(new.product, linear.product(new.c, new_b), new.n), at_a, at_b
    more_a = snapshots.difference(columns(new), columns(old))
    more_d = linear.product(new.c, snapshots.difference(new_b.join(at_b, "col_idx", "left_semi"), b.join(at_b, "col_idx", "left_semi")))
    return new_a, new_b, snapshots.mended(h, solver, more_a.withColumn("value", -F.col("value")), more_d), at_a, at_b


@query("cp18_update", "SELECT row_idx AS impact, col_idx AS process_idx, round(value, 6) AS amount FROM h", SOLVED)
def cp18_update(n):
    """Impacts of all units after the last order came, mended from those before it; the columns that it touches alone are built anew."""
    h = _followed(_Before(n.spark, n.dir), n)[2]
    return h.select(F.col("row_idx").alias("impact"), F.col("col_idx").alias("process_idx"), F.round("value", 6).alias("amount"))


# Stored results


@query("qr01", "SELECT row_idx AS impact, round(value, 6) AS amount FROM h WHERE col_idx = 3", SOLVED)
def qr01(n):
    """One process, all impacts, from the stored chunk."""
    return results.of_process(n.spark, _stored(n), 3).select("impact", F.round("amount", 6).alias("amount"))


@query("qr02", "SELECT col_idx AS process_idx, round(value, 6) AS amount FROM h WHERE row_idx = 1", SOLVED)
def qr02(n):
    """All processes, one impact, from the stored chunks."""
    return results.of_impact(n.spark, _stored(n), 1).select("process_idx", F.round("amount", 6).alias("amount"))


@query("qr03", "SELECT CASE WHEN col_idx % 2 = 0 THEN 'all_unit' ELSE 'fallback_solve_batch' END AS source, col_idx AS process_idx, row_idx AS impact, round(value, 6) AS amount FROM h WHERE col_idx IN (2, 3, 4, 5)", SOLVED)
def qr03(n):
    """Processes that are stored, and others that are solved: here only even ones are stored."""
    path = shared_folder(n.spark)
    results.write(results.read(n.spark, _stored(n)).where("process_idx % 2 = 0"), path)

    def solve(missing: list[int]) -> DataFrame:
        y = n.spark.createDataFrame([(p, p, 1.0) for p in missing], linear.VECTORS)
        return _model(n).solve(y, x=False, h=True)["h"].select(F.col("rhs").alias("process_idx"), F.col("idx").alias("impact"), F.col("value").alias("amount"))

    return results.ask(n.spark, path, [2, 3, 4, 5], solve).select("source", "process_idx", "impact", F.round("amount", 6).alias("amount"))


@query("snk01", "SELECT rhs, idx, round(value, 6) AS amount FROM x", _X)
def snk01(n):
    """Solutions as compressed envelopes, one for each demand and ``PART`` processes, and read back from these."""
    x = _model(n).solve(_demands(n))["x"]
    path = shared_folder(n.spark)
    artifacts.encoded(x, "rhs", "solve-result", size=1, part=F.floor(F.col("idx") / PART)).write.parquet(path)
    return artifacts.decoded(n.spark.read.parquet(path), "solve-result", linear.VECTORS).select("rhs", "idx", F.round("value", 6).alias("amount"))


@query("snk02", "SELECT col_idx // 256 AS chunk, min(col_idx) AS first, max(col_idx) AS last, count(*) AS records FROM h GROUP BY 1", SOLVED)
def snk02(n):
    """The index of stored results: ranges of chunks whose coverage is checked."""
    found = results.index(results.read(n.spark, _stored(n)))
    results.check_coverage(found, n.n)
    return found.drop("sha256")


def _inventory(n: Network) -> DataFrame:
    """Inventory of one unit of every process: as few solves as there are elementary flows."""
    model = _model(n)
    y = model.b.select(F.col("row_idx").alias("rhs"), F.col("col_idx").alias("idx"), "value")
    return model.columns.solve(y).select(F.col("idx").alias("process_idx"), F.col("rhs").alias("flow_idx"), F.col("value").alias("amount"))


@query("snk05", "SELECT 'lci' AS kind, col_idx // 256 AS chunk, col_idx AS process_idx, row_idx AS item, round(value, 4) AS amount FROM u WHERE value <> 0 UNION ALL SELECT 'lcia', col_idx // 256, col_idx, row_idx, round(value, 4) FROM h", _LCI)
def snk05(n):
    """Inventories and impacts of all units written chunk by chunk as compressed lines, and read with their counts checked."""
    both = written(_inventory(n).select(F.lit("lci").alias("kind"), "process_idx", F.col("flow_idx").alias("item"), "amount").unionByName(_units(n).select(F.lit("lcia").alias("kind"), "process_idx", F.col("impact").alias("item"), "amount")))
    path = shared_folder(n.spark)
    exports.chunked(both, "process_idx").repartition("kind", "chunk").sortWithinPartitions("kind", "chunk", "process_idx", "item").write.partitionBy("kind", "chunk").option("compression", "gzip").json(path)
    lines = exports.read_lines(n.spark, path, "kind string, chunk bigint, process_idx int, item int, amount double", both.count())
    return lines.select("kind", "chunk", "process_idx", "item", F.round("amount", 4).alias("amount"))


def _axis(n: Network) -> DataFrame:
    return n.processes.select("process_idx", fn.uuid(1, F.col("process_idx")).alias("process_uuid"), F.lit("01.00.000").alias("process_version")).join(n.ports.select("process_idx", fn.uuid(2, F.split_part("flow", F.lit("#"), F.lit(2)).cast("int")).alias("reference_flow_uuid")), "process_idx", "left")


_AXIS = "axis AS (SELECT p.process_idx, printf('%08x-0000-4000-8000-%012x', 1, p.process_idx) AS process_uuid, printf('%08x-0000-4000-8000-%012x', 2, split_part(flow, '#', 2)::INT) AS reference_flow_uuid FROM process p LEFT JOIN port USING (process_idx))"


def _lcia_rows(n: Network) -> DataFrame:
    names = n.spark.createDataFrame([(i, *x) for i, x in enumerate(IMPACTS)], "impact int, lcia_method_key string, lcia_method_name string, result_unit string")
    rows = results.read(n.spark, _stored(n)).join(F.broadcast(names), "impact").join(_axis(n), "process_idx")
    return rows.select(F.col("process_idx").alias("process_index"), "process_uuid", "process_version", "reference_flow_uuid", F.lit("01.00.000").alias("reference_flow_version"), F.lit("kg").alias("reference_unit"), fn.uuid(3, F.col("impact")).alias("lcia_method_uuid"), F.lit("01.00.000").alias("lcia_method_version"), "lcia_method_key", "lcia_method_name", "result_unit", F.col("amount").alias("mean_amount"))


def _lci_rows(n: Network) -> DataFrame:
    return _inventory(n).join(_axis(n), "process_idx").select(F.col("process_idx").alias("process_index"), "process_uuid", "process_version", fn.uuid(4, F.col("flow_idx")).alias("flow_uuid"), F.lit("01.00.000").alias("flow_version"), F.when(F.col("flow_idx") % 2 == 1, "Output").otherwise("Input").alias("direction"), F.lit("kg").alias("unit"), F.lit("GLO").alias("location"), F.col("amount").alias("mean_amount"))


_LCIA_SQL = "SELECT h.col_idx AS process_index, process_uuid, '01.00.000' AS process_version, reference_flow_uuid, '01.00.000' AS reference_flow_version, 'kg' AS reference_unit, printf('%08x-0000-4000-8000-%012x', 3, h.row_idx) AS lcia_method_uuid, '01.00.000' AS lcia_method_version, k AS lcia_method_key, nm AS lcia_method_name, un AS result_unit, round(h.value, 6) AS mean_amount FROM h JOIN axis ON process_idx = col_idx JOIN (VALUES " + ", ".join(str((i, *x)) for i, x in enumerate(IMPACTS)) + ") AS i(idx, k, nm, un) ON i.idx = h.row_idx"
_LCI_SQL = "SELECT u.col_idx AS process_index, process_uuid, '01.00.000' AS process_version, printf('%08x-0000-4000-8000-%012x', 4, u.row_idx) AS flow_uuid, '01.00.000' AS flow_version, CASE WHEN u.row_idx % 2 = 1 THEN 'Output' ELSE 'Input' END AS direction, 'kg' AS unit, 'GLO' AS location, round(u.value, 4) AS mean_amount FROM u JOIN axis ON process_idx = col_idx WHERE u.value <> 0"


@query("snk07", _LCIA_SQL, f"{SOLVED}, {_AXIS}")
def snk07(n):
    """Impacts as comma-separated values in their twelve columns, and read back; inventories have a file of nine columns."""
    path = shared_folder(n.spark)
    rows = _lcia_rows(n)
    rows.write.option("header", True).csv(path)
    return n.spark.read.schema(rows.schema).option("header", True).option("enforceSchema", False).csv(path).withColumn("mean_amount", F.round("mean_amount", 6))


@query("snk08", _LCI_SQL, f"{_LCI}, {_AXIS}")
def snk08(n):
    """Inventories as Parquet, zstd, in groups of 50,000 rows, nine columns."""
    path = shared_folder(n.spark)
    rows = _lci_rows(n)
    rows.write.option("compression", "zstd").option("parquet.block.row.count.limit", 50_000).parquet(path)
    return n.spark.read.schema(rows.schema).parquet(path).withColumn("mean_amount", F.round("mean_amount", 4))


@query("snk09", _LCIA_SQL + " WHERE h.row_idx = 0", f"{SOLVED}, {_AXIS}")
def snk09(n):
    """One impact as a workbook, whose rows the format bounds, and read back from it."""
    rows = _lcia_rows(n).where(F.col("lcia_method_key") == IMPACTS[0][0])
    found = rows.orderBy("process_index").limit(artifacts.SHEET_ROWS).collect()
    data = artifacts.workbook({"LCIA": (rows.columns, [tuple(r) for r in found])})
    head, *body = artifacts.sheet(data)
    out = [tuple(int(v) if c == "process_index" else round(v, 6) if c == "mean_amount" else v for c, v in zip(head, r, strict=True)) for r in body]
    return n.spark.createDataFrame(out, rows.schema)


_CONFIG = {"provider_rule": "split_by_process_volume", "technosphere_boundary_policy": "closed", "self_loop_cutoff": 0.999}


def _snapshot(n: Network) -> str:
    """Writes a snapshot: matrices (A as its factors), configuration and coverage as artifacts, and the index beside them."""
    base = shared_folder(n.spark)
    n.ruled(_CONFIG["provider_rule"]).write(f"{base}/matrices/a")
    for name, m in (("b", n.b), ("c", n.c)):
        m.write.parquet(f"{base}/matrices/{name}")
    artifacts.document(n.spark, "config", "snapshot-config", 1, _CONFIG).write.parquet(f"{base}/artifact")
    n.processes.select(F.col("process_idx").alias("process_index"), fn.uuid(1, F.col("process_idx")).alias("process_id"), F.lit("01.00.000").alias("process_version"), "location").write.json(f"{base}/snapshot-index/process_map")
    return base


@query("snk10", "SELECT 'a' AS matrix, row_idx, col_idx, round(value, 6) AS value FROM a UNION ALL SELECT 'b', row_idx, col_idx, round(value, 6) FROM b UNION ALL SELECT 'c', row_idx, col_idx, value::DOUBLE FROM c")
def snk10(n):
    """A snapshot's matrices, written and read."""
    base = _snapshot(n)
    matrices = {"a": linking.activities(linking.Factored.read(n.spark, f"{base}/matrices/a").pairs())} | {k: n.spark.read.parquet(f"{base}/matrices/{k}") for k in "bc"}
    parts = [m.select(F.lit(k).alias("matrix"), "row_idx", "col_idx", F.round("value", 6).alias("value")) for k, m in matrices.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("src04", "SELECT 'split_by_process_volume' AS provider_rule, 'closed' AS boundary_policy, (SELECT count(*) FROM a) AS a_nnz, (SELECT count(*) FROM b) AS b_nnz, (SELECT count(*) FROM c) AS c_nnz")
def src04(n):
    """A snapshot decoded: configuration and sizes of its matrices."""
    base = _snapshot(n)
    config = artifacts.read_document(n.spark.read.parquet(f"{base}/artifact"), "config", "snapshot-config")
    sizes = [linking.Factored.read(n.spark, f"{base}/matrices/a").count(), *(n.spark.read.parquet(f"{base}/matrices/{k}").count() for k in "bc")]
    return n.spark.createDataFrame([(config["provider_rule"], config["technosphere_boundary_policy"], *sizes)], "provider_rule string, boundary_policy string, a_nnz long, b_nnz long, c_nnz long")


#: Parts of the evidence of edges: the key of their chunks and their columns.
_EVIDENCE = {"loads": ("consumer", "consumer int, flow string, sign double, tier int, place string, residual double, per double"), "shares": ("provider", "flow string, sign double, tier int, place string, provider int, pivot double, share double")}


def _evidence(n: Network) -> str:
    """Writes the evidence of the edges in both versions: what demands ask of places and what ports take of it, from which each edge follows."""
    path, made = shared_folder(n.spark), n.ruled(_CONFIG["provider_rule"])
    parts = [artifacts.encoded(getattr(made, k), key, f"release-evidence-{k}", v) for v in (1, 2) for k, (key, _) in _EVIDENCE.items()]
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    return path


@query("src05", "SELECT 1 AS version, row_idx, col_idx, round(value, 6) AS value FROM a UNION ALL SELECT 2, row_idx, col_idx, round(value, 6) FROM a")
def src05(n):
    """Evidence of the edges in both versions of its format, each chunk bound to its hash; edges are made from it when it is read."""
    found, parts = n.spark.read.parquet(_evidence(n)), []
    for v in (1, 2):
        made = linking.Factored(*(written(artifacts.decoded(found.where(F.col("version") == v), f"release-evidence-{k}", shape)) for k, (_, shape) in _EVIDENCE.items()))
        parts.append(linking.activities(made.pairs()).select(F.lit(v).alias("version"), "row_idx", "col_idx", F.round("value", 6).alias("value")))
    return parts[0].unionByName(parts[1])


@query("src07", "SELECT process_idx AS process_index, printf('%08x-0000-4000-8000-%012x', 1, process_idx) AS process_id, '01.00.000' AS process_version, location FROM process")
def src07(n):
    """The index beside a snapshot, found from the snapshot's own address."""
    artifact = f"{_snapshot(n)}/artifact"
    return n.spark.read.schema("process_index int, process_id string, process_version string, location string").json(f"{artifact.rpartition('/')[0]}/snapshot-index/process_map")


@query("src11", "SELECT process_idx, location FROM process")
def src11(n):
    """Compressed lines read with their count."""
    path = shared_folder(n.spark)
    n.processes.select("process_idx", "location").write.option("compression", "gzip").json(path)
    return exports.read_lines(n.spark, path, "process_idx int, location string", n.n)


@query("src12", "SELECT process_idx, location FROM process")
def src12(n):
    """Lines read against a descriptor: the files' names, lengths and hashes, and the count."""
    path = shared_folder(n.spark)
    n.processes.select("process_idx", "location").write.json(path)
    described = written(artifacts.files(n.spark, path))
    artifacts.check_files(artifacts.files(n.spark, path), described)
    return exports.read_lines(n.spark, path, "process_idx int, location string", n.n)


@query("src13", "SELECT part, sha256(string_agg(o_orderkey || chr(10), '' ORDER BY o_orderkey)) AS sha256, sum(length(o_orderkey::VARCHAR) + 1)::BIGINT AS length, (sum(length(o_orderkey::VARCHAR) + 1) > 4096) AS refused FROM (SELECT o_orderkey, o_orderkey % 16 AS part FROM orders) GROUP BY 1", "")
def src13(n):
    """Objects with their hashes, and which are longer than a bound and would be refused before they are read."""
    path = shared_folder(n.spark)
    rows = n.table("orders").select("o_orderkey", (F.col("o_orderkey") % 16).alias("part"))
    rows.repartition(16, "part").sortWithinPartitions("part", "o_orderkey").select(F.col("o_orderkey").cast("string").alias("value"), "part").write.partitionBy("part").text(path)
    found = artifacts.files(n.spark, path, limit=1 << 30, partitions=True).where("name like 'part-%'")
    return found.select(F.col("part").cast("long").alias("part"), "sha256", "length", (F.col("length") > 4096).alias("refused"))


@query("snk14", "SELECT o_custkey AS snapshot_id, o_orderkey AS result_id, strftime(o_orderdate, '%Y-%m-%d') AS computed_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1", "")
def snk14(n):
    """The latest result of each snapshot: older ones are stored, newer ones replace them."""
    o = n.table("orders").select(F.col("o_custkey").alias("snapshot_id"), F.col("o_orderkey").alias("result_id"), F.col("o_orderdate").alias("computed_at"))
    cut = F.lit("1996-01-01").cast("timestamp")
    stored = exports.upserted(o.where(F.col("computed_at") < cut).limit(0), o.where(F.col("computed_at") < cut), "snapshot_id", ["computed_at", "result_id"])
    return exports.upserted(stored, o.where(F.col("computed_at") >= cut), "snapshot_id", ["computed_at", "result_id"]).withColumn("computed_at", F.date_format("computed_at", "yyyy-MM-dd"))


@query("snk15", "SELECT 'a' AS file, count(*) AS rows, round(sum(value), 4) AS total FROM a UNION ALL SELECT 'b', count(*), round(sum(value), 4) FROM b UNION ALL SELECT 'm', count(*), round(sum(value), 4) FROM m WHERE value <> 0 UNION ALL SELECT 'c', count(*), round(sum(value)::DOUBLE, 4) FROM c WHERE row_idx = 0 UNION ALL SELECT 'h', count(*), round(sum(value), 4) FROM h WHERE row_idx = 0", f"{SOLVED}, {_M}")
def snk15(n):
    """Matrices A, B and M, one row of C and one column of H as tab-separated triplets in gzip, read back."""
    h = results.of_impact(n.spark, _stored(n), 0).select(F.col("process_idx").alias("row_idx"), F.col("impact").alias("col_idx"), F.col("amount").alias("value"))
    tables = {"a": n.a, "b": n.b, "m": n.m(0.0), "c": n.c.where("row_idx = 0"), "h": h}
    base, out = shared_folder(n.spark), None
    for k, t in tables.items():
        t.select("row_idx", "col_idx", "value").write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(f"{base}/{k}")
        back = n.spark.read.schema("row_idx int, col_idx int, value double").option("sep", "\t").option("header", True).csv(f"{base}/{k}")
        part = back.agg(F.lit(k).alias("file"), F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


_PATH_SQL = ", s AS (SELECT p.process_idx, p.volume * d.value AS direct FROM process p JOIN d ON d.col_idx = p.process_idx AND d.row_idx = 0), t AS (SELECT greatest(sum(abs(direct)), 1e-12) AS total FROM s), e AS (SELECT a.col_idx AS src, a.row_idx AS dst, abs(s.direct) AS size, abs(s.direct) / t.total AS share, row_number() OVER (PARTITION BY a.col_idx ORDER BY abs(s.direct) DESC, a.row_idx) AS rank FROM a JOIN s ON s.process_idx = a.row_idx CROSS JOIN t WHERE abs(s.direct) / t.total >= 0.01), k AS (SELECT * FROM e WHERE rank <= 5), paths AS (SELECT 0 AS node, [0] AS path, 0 AS depth, 0.0::DOUBLE AS score, false AS cut UNION ALL SELECT k.dst, list_append(path, k.dst), depth + 1, score + size, list_contains(path, k.dst) FROM paths JOIN k ON k.src = node WHERE depth < 4 AND NOT cut), ends AS (SELECT array_to_string(path, '>') AS path, round(score, 4) AS score, CASE WHEN cut THEN 'cycle_cut' WHEN depth = 4 THEN 'max_depth' WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.col_idx = node) THEN 'leaf' ELSE 'cutoff' END AS reason FROM paths p WHERE cut OR depth = 4 OR NOT EXISTS (SELECT 1 FROM k WHERE k.src = p.node))"


def _branches(n: Network) -> graph.Branches:
    d = linear.product(n.c, n.b).where("row_idx = 0").select(F.col("col_idx").alias("process_idx"), F.col("value").alias("d"))
    s = graph.contributions(n.processes.select("process_idx", F.col("volume").alias("x")), d)
    return graph.branches(n.a.select(F.col("col_idx").alias("src"), F.col("row_idx").alias("dst")), s, n.spark.range(1).select(F.col("id").cast("int").alias("node")))


def _path(c: str = "path"):
    return F.array_join(F.col(c).cast("array<string>"), ">")


@query("gr03", "SELECT path, score, reason FROM ends", "RECURSIVE " + NETWORK.strip() + _PATH_SQL)
def gr03(n):
    """Upstream branches of the first process, bounded by depth 4, five children, a share of 1 % and 200 nodes, with why each ends."""
    return _branches(n).ends.select(_path().alias("path"), F.round("score", 4).alias("score"), "reason")


@query("gr04", "SELECT reason, count(*) AS branches, max(score) AS best FROM ends GROUP BY 1", "RECURSIVE " + NETWORK.strip() + _PATH_SQL)
def gr04(n):
    """Scores of branches by why they end."""
    return _branches(n).ends.groupBy("reason").agg(F.count("*").alias("branches"), F.max(F.round("score", 4)).alias("best"))


@query("gr05", "SELECT node, min(depth) AS least_depth, round((SELECT sum(abs(direct)) FROM s WHERE process_idx IN (SELECT node FROM paths WHERE NOT cut)) / (SELECT total FROM t), 6) AS coverage FROM paths WHERE NOT cut GROUP BY 1", "RECURSIVE " + NETWORK.strip() + _PATH_SQL)
def gr05(n):
    """The least depth of each node that is expanded, and the share of all direct impact that these nodes have."""
    b = _branches(n)
    return b.nodes.crossJoin(F.broadcast(b.coverage())).select("node", "least_depth", F.round("coverage", 6).alias("coverage"))


@query("wn09", "SELECT row_number() OVER (ORDER BY score DESC, path) AS rank, path FROM ends", "RECURSIVE " + NETWORK.strip() + _PATH_SQL)
def wn09(n):
    """Branches of one root in the order of score and path."""
    ends = _branches(n).ends.select(F.element_at("path", 1).alias("root"), _path().alias("path"), F.round("score", 4).alias("score"))
    return ends.select(F.row_number().over(graph.by_rank("root")).cast("long").alias("rank"), "path")


@query("snk03", "SELECT path, score, reason FROM ends", "RECURSIVE " + NETWORK.strip() + _PATH_SQL)
def snk03(n):
    """Branches as JSON, and read back."""
    path = shared_folder(n.spark)
    _branches(n).ends.select(_path().alias("path"), "score", "reason").write.json(path)
    return n.spark.read.schema("path string, score double, reason string").json(path).withColumn("score", F.round("score", 4))


_DIRECT = ", s AS (SELECT p.process_idx, p.location, p.volume * d.value AS direct FROM process p JOIN d ON d.col_idx = p.process_idx AND d.row_idx = 0), f AS (SELECT * FROM s WHERE abs(direct) > 1e-12 OR process_idx = 0)"


def _shown(n: Network) -> DataFrame:
    d = linear.product(n.c, n.b).where("row_idx = 0").select(F.col("col_idx").alias("process_idx"), F.col("value").alias("d"))
    s = graph.contributions(n.processes.select("process_idx", F.col("volume").alias("x")), d)
    return graph.shown(s, 0).join(n.processes.select("process_idx", "location"), "process_idx")


@query("flt11", _DIRECT + " SELECT process_idx, round(direct, 4) AS direct FROM f")
def flt11(n):
    """Contributions that are not next to nothing, and the root's."""
    return _shown(n).select("process_idx", F.round("direct", 4).alias("direct"))


@query("st05", _DIRECT + " SELECT row_number() OVER (ORDER BY abs(direct) DESC, location, process_idx) AS place, process_idx FROM f ORDER BY place LIMIT 20")
def st05(n):
    """The twenty largest contributions, ties by label."""
    top = _shown(n).orderBy(F.desc(F.abs("direct")), "location", "process_idx").limit(20).withColumn("all", F.lit(0))
    return top.select(F.row_number().over(graph.largest_first("all")).cast("long").alias("place"), "process_idx")


@query("ag24", f", r AS (SELECT n_name AS grp, abs(s_acctbal - c) AS a, (s_acctbal - c) AS e FROM (SELECT s_nationkey, s_acctbal, avg(s_acctbal) OVER (PARTITION BY s_nationkey) AS c FROM supplier) JOIN nation ON n_nationkey = s_nationkey) SELECT count(*) AS groups, round(max(m), 6) AS abs_inf, round(max(l), 6) AS l2, bool_and(m <= 1e4) AS passed, max_by(grp, {{'m': m, 'grp': grp}}) AS worst FROM (SELECT grp, max(a) AS m, sqrt(sum(e * e)) AS l FROM r GROUP BY 1)")
def ag24(n):
    """The worst of a metric over groups: largest deviations from a group's mean, and the group that has it (of equal ones the last by name)."""
    s = n.table("supplier").join(F.broadcast(n.table("nation").select("n_nationkey", F.col("n_name").alias("grp"))), F.col("s_nationkey") == F.col("n_nationkey"))
    mean = s.groupBy("grp").agg(F.avg("s_acctbal").alias("c"))
    e = F.col("s_acctbal") - F.col("c")
    by = s.join(mean, "grp").groupBy("grp").agg(F.max(F.abs(e)).alias("m"), F.sqrt(F.sum(e * e)).alias("l"))
    return by.agg(F.count("*").alias("groups"), F.round(F.max("m"), 6).alias("abs_inf"), F.round(F.max("l"), 6).alias("l2"), F.bool_and(F.col("m") <= 1e4).alias("passed"), F.max_by("grp", F.struct("m", "grp")).alias("worst"))


@query("flt15", f"SELECT k AS impact_key, list_position({[x[0] for x in IMPACTS]}, k) - 1 AS impact_index, count(*) AS requests FROM (SELECT ['GWP', 'EP', 'AP', 'none'][event_id % 4 + 1] AS k FROM events) GROUP BY 1", "")
def flt15(n):
    """The positions of the impacts that events ask for by key; null for one that the axis lacks."""
    axis = n.spark.createDataFrame([(i, x[0]) for i, x in enumerate(IMPACTS)], "impact_index int, impact_key string")
    asked = n.table("events").groupBy(F.get(F.array(*map(F.lit, ("GWP", "EP", "AP", "none"))), (F.col("event_id") % 4).cast("int")).alias("impact_key")).agg(F.count("*").alias("requests"))
    return asked.join(axis, "impact_key", "left").select("impact_key", "impact_index", "requests")


@query("op02", "SELECT s_suppkey AS impact_index, printf('%08x-0000-4000-8000-%012x', 3, s_suppkey) AS impact_id, s_suppkey = (SELECT max(s_suppkey) FROM supplier) AS is_default FROM supplier", "")
def op02(n):
    """The axis of a package, suppliers standing in for impacts, and its default, asked for by key; one that the axis lacks is an error."""
    s = n.table("supplier")
    axis = s.select(F.col("s_suppkey").alias("impact_index"), F.col("s_name").alias("impact_key"), fn.uuid(3, F.col("s_suppkey")).alias("impact_id"))
    return exports.impact_axis(axis, s.agg(F.max_by("s_name", "s_suppkey")).first()[0]).select("impact_index", "impact_id", "is_default")


assert len(FLOWS) == 6
