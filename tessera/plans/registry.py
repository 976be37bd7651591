"""The queries of the life-cycle-assessment engine and their SQL.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import graph, linear, linking, multisets
from ..sources.network import FACTORS, FLOWS, Network
from ..sources.tables import written

_QUERIES: dict[str, Callable[[Network], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _r(c, n: int = 6):
    return F.round(c, n)


NETWORK = f"""
process AS (SELECT s_suppkey::INT AS process_idx, s_nationkey::INT AS nation, n_regionkey::INT AS region, n_name AS location,
  CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 1.0 END AS volume, NOT coalesce(s_acctbal > 0, false) AS volume_fallback
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
brand AS (SELECT l_suppkey::INT AS process_idx, p_brand AS flow, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY process_idx ORDER BY qty DESC, flow) AS rn, sum(qty) OVER (PARTITION BY process_idx) AS total FROM brand),
port AS (SELECT process_idx, flow FROM ranked WHERE rn = 1),
residual AS (SELECT process_idx AS consumer, flow, -0.5 * qty / total AS residual FROM ranked WHERE rn > 1),
candidate AS (SELECT r.consumer, r.flow, p.process_idx AS provider, r.residual,
  CASE WHEN x.nation = y.nation THEN 1 WHEN x.region = y.region THEN 2 ELSE 3 END AS tier, y.volume, y.volume_fallback
  FROM residual r JOIN port p USING (flow) JOIN process x ON x.process_idx = r.consumer JOIN process y ON y.process_idx = p.process_idx),
best AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY consumer, flow) AS m FROM candidate) WHERE tier = m),
weighted AS (SELECT *, volume / sum(volume) OVER (PARTITION BY consumer, flow) AS weight FROM best),
a AS MATERIALIZED (SELECT provider AS row_idx, consumer AS col_idx, sum(-residual * weight) AS value FROM weighted GROUP BY 1, 2),
b AS MATERIALIZED (SELECT list_position({list(FLOWS)!r}, l_returnflag || l_linestatus) - 1 AS row_idx, l_suppkey::INT AS col_idx, sum(l_extendedprice) * 1e-6 AS value
  FROM lineitem GROUP BY 1, 2),
c AS (SELECT * FROM (VALUES {", ".join(map(str, FACTORS))}) AS t(row_idx, col_idx, value)),
d AS MATERIALIZED (SELECT c.row_idx, b.col_idx, sum(c.value * b.value) AS value FROM c JOIN b ON c.col_idx = b.row_idx GROUP BY 1, 2)"""

STEPS = 40
_H = ", ".join(["h0 AS MATERIALIZED (SELECT * FROM d)"] + [f"h{k} AS MATERIALIZED (SELECT row_idx, col_idx, sum(value) AS value FROM (SELECT row_idx, col_idx, value FROM d UNION ALL SELECT h.row_idx, a.col_idx, h.value * a.value FROM h{k - 1} h JOIN a ON h.col_idx = a.row_idx) GROUP BY 1, 2)" for k in range(1, STEPS + 1)])
SOLVED = f"{NETWORK}, {_H}, h AS (SELECT * FROM h{STEPS})"


def query(name: str, sql: str, prelude: str = NETWORK):
    def add(f: Callable[[Network], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = f"WITH {prelude} {sql}" if prelude else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Network(spark, sf_dir))) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _direct(n: Network) -> DataFrame:
    return linear.product(n.c, n.b)


def _impacts(n: Network) -> DataFrame:
    return linear.adjoint(n.product, _direct(n), n.n)


# Linear algebra


@query("la01", "SELECT row_idx, col_idx, round(sum(value), 6) + 0.0 AS value FROM (SELECT row_idx, col_idx, -value AS value FROM a WHERE abs(value) > 1e-15 UNION ALL SELECT process_idx, process_idx, 1.0 FROM process) GROUP BY 1, 2 HAVING abs(sum(value)) > 1e-15")
def la01(n):
    """M = I - A with small entries dropped before and after duplicates are summed."""
    return n.m().select("row_idx", "col_idx", (_r("value") + 0.0).alias("value"))


@query("la02", "SELECT count(*) AS entries, count(*) FILTER (WHERE row_idx NOT BETWEEN 0 AND (SELECT count(*) - 1 FROM supplier) OR col_idx NOT BETWEEN 0 AND (SELECT count(*) - 1 FROM supplier)) AS outside FROM a")
def la02(n):
    """Entries of A outside its bounds, counted by place without making them."""
    return n.spark.createDataFrame([n.ruled("split_by_process_volume").bounds(n.n, n.n)], "entries long, outside long")


@query(
    "la03",
    """, m AS (SELECT row_idx, col_idx, sum(value) AS value FROM (SELECT row_idx, col_idx, -value AS value FROM a UNION ALL SELECT process_idx, process_idx, 1.0 FROM process) GROUP BY 1, 2),
k AS (SELECT (SELECT count(*) FROM supplier) AS n, count(*) AS nnz, count(DISTINCT row_idx) AS r, count(DISTINCT col_idx) AS c, count(*) FILTER (WHERE row_idx = col_idx AND abs(value) > 1e-12) AS g FROM m WHERE abs(value) > 1e-15)
SELECT n, nnz, n - r AS empty_rows, n - c AS empty_cols, n - g AS zero_diagonal, round(1 - nnz / (n * n), 6) AS sparsity,
CASE WHEN r < n OR c < n THEN 'failed_invalid_structure' WHEN g < n THEN 'warning_near_singular' ELSE 'ok' END AS status FROM k""",
)
def la03(n):
    """Structure of M: empty rows and columns, near-zero diagonal, sparsity, status; entries are counted by place without making them."""
    return n.ruled("split_by_process_volume").shape(n.n)


@query("la08", "SELECT a.row_idx AS process_idx, round(sum(a.value * p.volume), 4) AS value FROM a JOIN process p ON p.process_idx = a.col_idx GROUP BY 1")
def la08(n):
    """Sparse matrix times vector: A times the volumes, from A's factors, without its entries."""
    x = n.processes.select(F.col("process_idx").alias("idx"), F.col("volume").alias("value"))
    return n.ruled("split_by_process_volume").times(x).select(F.col("idx").alias("process_idx"), _r("value", 4).alias("value"))


@query("la10", "SELECT row_idx AS impact, col_idx AS process_idx, round(value, 6) AS amount FROM h", SOLVED)
def la10(n):
    """Impacts of one unit of every process, by one adjoint solve for each impact."""
    return _impacts(n).select(F.col("row_idx").alias("impact"), F.col("col_idx").alias("process_idx"), _r("value").alias("amount"))


@query("la11", "SELECT h.col_idx AS process_idx, round(h.value, 6) AS expected, round(coalesce(d.value, 0), 6) AS direct, round(h.value - coalesce(d.value, 0), 6) AS indirect FROM h LEFT JOIN d USING (row_idx, col_idx) WHERE h.row_idx = 0", SOLVED)
def la11(n):
    """Expected, direct and indirect impact of each process for the first impact."""
    d = _direct(n).where("row_idx = 0")
    h = linear.adjoint(n.product, d, n.n).select("col_idx", F.col("value").alias("h"))
    return h.join(d.select("col_idx", F.col("value").alias("d")), "col_idx", "left").fillna(0.0, ["d"]).select(F.col("col_idx").alias("process_idx"), _r("h").alias("expected"), _r("d").alias("direct"), _r(F.col("h") - F.col("d")).alias("indirect"))


@query("jn17", "SELECT row_idx AS impact, col_idx AS process_idx, round(value, 6) AS value FROM d")
def jn17(n):
    """C B: direct impact of each process."""
    return _direct(n).select(F.col("row_idx").alias("impact"), F.col("col_idx").alias("process_idx"), _r("value").alias("value"))


@query("jn18", "SELECT b.row_idx AS flow_idx, round(sum(b.value * p.volume), 3) AS amount FROM b JOIN process p ON p.process_idx = b.col_idx GROUP BY 1")
def jn18(n):
    """B x for the volumes: the inventory of elementary flows."""
    x = n.processes.select(F.col("process_idx").alias("idx"), F.col("volume").alias("value"))
    return linear.times(n.b, x).select(F.col("idx").alias("flow_idx"), _r("value", 3).alias("amount"))


@query("la09", "SELECT flow, direction, round(sum(amount), 4) AS amount FROM (SELECT l_returnflag AS flow, CASE WHEN l_linestatus = 'O' THEN 'Output' ELSE 'Input' END AS direction, l_extendedprice * 1e-6 AS amount FROM lineitem) GROUP BY 1, 2 HAVING sum(amount) <> 0")
def la09(n):
    """Directional inventory by flow and direction without exact zeros."""
    t = n.table("lineitem").select(F.col("l_returnflag").alias("flow"), F.when(F.col("l_linestatus") == "O", "Output").otherwise("Input").alias("direction"), (F.col("l_extendedprice") * 1e-6).alias("amount"))
    return t.groupBy("flow", "direction").agg(F.sum("amount").alias("s")).where("s <> 0").select("flow", "direction", _r("s", 4).alias("amount"))


@query("ag22", "SELECT round(min(value), 6) AS least, count(*) FILTER (WHERE value < 0) AS negative, count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS not_finite FROM d")
def ag22(n):
    """Least value, negative and not finite values."""
    return _direct(n).agg(_r(F.min("value")).alias("least"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.isnan("value") | (F.abs("value") == float("inf"))).alias("not_finite"))


@query("ag15", ", s AS (SELECT col_idx, string_agg(row_idx || ':' || CAST(round(value, 6) * 1000000 AS BIGINT), '|' ORDER BY row_idx) AS sig FROM b GROUP BY 1) SELECT count(*) AS columns, count(DISTINCT sig) AS signatures FROM s")
def ag15(n):
    """Columns of B with equal signatures."""
    entry = F.concat_ws(":", "row_idx", (_r("value") * 1_000_000).cast("long"))
    same = multisets.classes(written(multisets.counted(n.b, "col_idx", entry)))
    return same.agg(F.count("*").alias("columns"), F.countDistinct("first").alias("signatures"))


# Linking


@query("jn02", "SELECT consumer, flow, provider, tier, round(residual, 6) AS residual FROM candidate")
def jn02(n):
    """Ports of the same flow with the opposite sign, for each residual demand."""
    return linking.candidates(n.residuals, n.ports, n.processes, 6).select("consumer", "flow", "provider", "tier", "residual")


@query("wn06", "SELECT consumer, flow, provider, tier FROM best")
def wn06(n):
    """Candidates of the nearest tier of each demand."""
    return n.weighted.select("consumer", "flow", "provider", "tier")


@query("wn04", "SELECT consumer, flow, provider, round(weight, 6) AS weight FROM weighted")
def wn04(n):
    """Volume shares within each demand."""
    return linking.routed(n.nearest, n.offers, 6).select("consumer", "flow", "provider", "weight")


@query("wn07", ", o AS (SELECT *, provider % 7 = consumer % 7 AS own FROM candidate), p AS (SELECT *, bool_or(own) OVER (PARTITION BY consumer, flow) AS any_own FROM o) SELECT consumer, flow, provider, own FROM p WHERE own OR NOT any_own")
def wn07(n):
    """Candidates of the consumer's own model where there are any; the model is the index modulo 7."""
    place = lambda tier, c: F.struct(F.lit(tier).alias("tier"), c.cast("string").alias("place"))
    places = lambda who: F.array(place(1, F.col(who) % 7), place(2, F.lit("*"))).alias("places")
    offers = linking.offers(n.everywhere.select("provider", "flow", "pivot", "volume", "volume_fallback", places("provider")))
    near = linking.nearest(n.demands.select("*", places("consumer")), offers)
    return linking.routed(near, offers).select("consumer", "flow", "provider", (F.col("tier") == 1).alias("own"))


@query("cp14", "SELECT row_idx, col_idx, round(value, 6) AS value FROM a")
def cp14(n):
    """The technosphere matrix A."""
    return n.a.select("row_idx", "col_idx", _r("value").alias("value"))


_DECISION = """, n AS (SELECT consumer, flow, count(*) AS n_candidates, min(tier) AS tier, count(*) FILTER (WHERE NOT volume_fallback) AS n_valid FROM candidate GROUP BY 1, 2),
decision AS (SELECT r.consumer, r.flow, coalesce(n_candidates, 0) AS n_candidates, tier, coalesce(n_valid, 0) AS n_valid,
CASE WHEN n_candidates IS NULL THEN 'no_provider' WHEN n_candidates = 1 THEN 'unique_provider' ELSE 'multi_provider' END AS kind FROM residual r LEFT JOIN n USING (consumer, flow)) """


def _decisions(n: Network) -> DataFrame:
    return linking.decisions(n.nearest)


@query("cp08", "SELECT consumer, flow, provider FROM (SELECT *, count(*) OVER (PARTITION BY consumer, flow) AS k FROM candidate) WHERE k = 1")
def cp08(n):
    """strict_unique_provider."""
    return n.ruled("strict_unique_provider").pairs().select("consumer", "flow", "provider")


@query("cp09", "SELECT consumer, flow, provider FROM (SELECT *, row_number() OVER w AS k, lead(volume) OVER w AS nxt FROM candidate WINDOW w AS (PARTITION BY consumer, flow ORDER BY volume DESC, provider)) WHERE k = 1 AND (nxt IS NULL OR volume >= 2 * nxt)")
def cp09(n):
    """best_provider_strict: the best, if it scores twice the next (ours)."""
    return n.ruled("best_provider_strict").pairs().select("consumer", "flow", "provider")


@query("cp11", "SELECT consumer, flow, provider, round(1.0 / count(*) OVER (PARTITION BY consumer, flow), 6) AS weight FROM candidate")
def cp11(n):
    """split_equal."""
    return n.ruled("split_equal").pairs(6).select("consumer", "flow", "provider", "weight")


@query("ag03", _DECISION + "SELECT round(100.0 * count(*) FILTER (WHERE n_candidates > 0) / nullif(count(*), 0), 2) AS write_pct, round(100.0 * count(*) FILTER (WHERE n_valid > 0) / nullif(count(*) FILTER (WHERE n_candidates > 0), 0), 2) AS usable_pct FROM decision")
def ag03(n):
    """Percentages with a null-safe division."""
    some, valid = F.count_if(F.col("n_candidates") > 0), F.count_if(F.col("n_valid") > 0)
    return _decisions(n).agg(fn.percent(some, F.count("*")).alias("write_pct"), fn.percent(valid, some).alias("usable_pct"))


@query("ag05", _DECISION + "SELECT kind, tier, count(*) AS demands FROM decision GROUP BY ROLLUP (kind, tier)")
def ag05(n):
    """Two-level histogram with subtotals."""
    return _decisions(n).rollup("kind", "tier").agg(F.count("*").alias("demands"))


@query("ag06", _DECISION + "SELECT count(*) FILTER (WHERE n_valid = n_candidates) AS all_valid, count(*) FILTER (WHERE n_valid BETWEEN 1 AND n_candidates - 1) AS partly_valid, count(*) FILTER (WHERE n_valid = 0) AS none_valid FROM decision WHERE n_candidates > 0")
def ag06(n):
    """Quality of volume weights by demand."""
    v, k = F.col("n_valid"), F.col("n_candidates")
    return _decisions(n).where(k > 0).agg(F.count_if(v == k).alias("all_valid"), F.count_if((v > 0) & (v < k)).alias("partly_valid"), F.count_if(v == 0).alias("none_valid"))


@query("ag29", "SELECT count(*) AS demands, count(*) FILTER (WHERE abs(s - 1) > 1e-9) AS broken FROM (SELECT sum(weight) AS s FROM weighted GROUP BY consumer, flow)")
def ag29(n):
    """Weights of each demand sum to one."""
    return n.weighted.groupBy("consumer", "flow").agg(F.sum("weight").alias("s")).agg(F.count("*").alias("demands"), F.count_if(F.abs(F.col("s") - 1) > 1e-9).alias("broken"))


@query("jn06", "SELECT consumer, flow FROM residual r WHERE NOT EXISTS (SELECT 1 FROM port p WHERE p.flow = r.flow)")
def jn06(n):
    """Demands without a provider in scope."""
    return n.residuals.join(n.ports, "flow", "left_anti").select(F.col("process_idx").alias("consumer"), "flow")


# Joins, windows, sets over the supplied tables


@query("wn02", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1", "")
def wn02(n):
    """The latest order of each customer."""
    last = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return n.table("orders").withColumn("k", F.row_number().over(last)).where("k = 1").select("o_custkey", "o_orderkey")


@query("wn05", "SELECT process_idx, string_agg(flow, ',' ORDER BY rn) AS top5 FROM ranked WHERE rn <= 5 GROUP BY 1")
def wn05(n):
    """The five main brands of each process."""
    top = n.ranked.where("rn <= 5").groupBy("process_idx").agg(F.array_sort(F.collect_list(F.struct("rn", "flow"))).alias("x"))
    return top.select("process_idx", F.array_join(F.transform("x", lambda s: s["flow"]), ",").alias("top5"))


@query("jn04", "SELECT x.l_orderkey AS k, count(*) AS pairs FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND abs(x.l_quantity - y.l_quantity) <= 1 GROUP BY 1", "")
def jn04(n):
    """Pairs of lines of one order with nearly equal quantities (equi-join with a tolerance)."""
    t = n.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    u = t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m"), F.col("l_quantity").alias("q"))
    near = (F.col("l_orderkey") == F.col("k")) & (F.col("l_linenumber") < F.col("m")) & (F.abs(F.col("l_quantity") - F.col("q")) <= 1)
    return t.join(u, near).groupBy("k").agg(F.count("*").alias("pairs"))


@query("jn05", ", e AS (SELECT DISTINCT r.consumer AS dst, p.process_idx AS src FROM residual r JOIN port p USING (flow) WHERE r.consumer <> p.process_idx) SELECT src, count(*) AS consumers FROM e GROUP BY 1")
def jn05(n):
    """Distinct consumers of each provider, over shared flows."""
    return linking.consumers(n.residuals, n.ports)


@query("gr06", "WITH RECURSIVE " + NETWORK.strip() + ", reach AS (SELECT 0 AS node UNION SELECT a.row_idx FROM reach JOIN a ON a.col_idx = reach.node) SELECT node FROM reach", "")
def gr06(n):
    """Processes that the first one needs, directly or not."""
    e = n.a.select(F.col("col_idx").alias("src"), F.col("row_idx").alias("dst"))
    return graph.closure(e, n.spark.range(1).select(F.col("id").cast("int").alias("node"))).select("node")


_SHARE = ", s AS (SELECT p.process_idx, p.volume * d.value AS direct FROM process p JOIN d ON d.col_idx = p.process_idx AND d.row_idx = 0) "


@query("gr02", _SHARE + "SELECT process_idx, round(direct, 4) AS direct, round(abs(direct) / greatest(sum(abs(direct)) OVER (), 1e-12), 6) AS share FROM s")
def gr02(n):
    """Direct contributions and their shares, for the volumes as activities."""
    d = _direct(n).where("row_idx = 0").select(F.col("col_idx").alias("process_idx"), F.col("value").alias("d"))
    return graph.contributions(n.processes.select("process_idx", F.col("volume").alias("x")), d).select("process_idx", _r("direct", 4).alias("direct"), _r("share").alias("share"))


@query("wn08", _SHARE + ", k AS (SELECT a.col_idx AS src, a.row_idx AS dst, row_number() OVER (PARTITION BY a.col_idx ORDER BY abs(direct) DESC, a.row_idx) AS rank FROM a JOIN s ON s.process_idx = a.row_idx) SELECT * FROM k WHERE rank <= 5")
def wn08(n):
    """The five providers of each process that contribute most."""
    d = _direct(n).where("row_idx = 0").select(F.col("col_idx").alias("process_idx"), F.col("value").alias("d"))
    s = graph.contributions(n.processes.select("process_idx", F.col("volume").alias("x")), d)
    e = n.a.select(F.col("col_idx").alias("src"), F.col("row_idx").alias("dst"))
    return graph.top_children(e, s, 5).select("src", "dst", F.col("rank").cast("long").alias("rank"))


@query("ag13", "SELECT fp, count(*) AS copies FROM (SELECT md5(string_agg(l_returnflag || ':' || l_linestatus, '|' ORDER BY l_returnflag || ':' || l_linestatus)) AS fp FROM lineitem GROUP BY l_orderkey) GROUP BY 1 HAVING count(*) > 1", "")
def ag13(n):
    """Fingerprints of an order's multiset of lines that occur more than once.

    Orders are told apart by sums of hashes, verified line by line; only the first order of each multiset is written out in order.
    """
    lines = written(multisets.counted(n.table("lineitem"), "l_orderkey", F.concat_ws(":", "l_returnflag", "l_linestatus")))
    same = written(multisets.classes(lines).groupBy("first").agg(F.count("*").alias("copies")).where("copies > 1"))
    shown = lines.join(same.select(F.col("first").alias("key")), "key", "left_semi")
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "k"))), lambda x: F.array_repeat(x["line"], x["k"].cast("int")))), "|")
    fp = shown.groupBy(F.col("key").alias("first")).agg(F.md5(text).alias("fp"))
    return same.join(fp, "first").select("fp", "copies")


@query("sc01", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS signed FROM lineitem", "")
def sc01(n):
    """Signed coefficients: returned lines count as inputs."""
    d = F.when(F.col("l_returnflag") == "R", "Input").otherwise("Output")
    return n.table("lineitem").select("l_orderkey", "l_linenumber", fn.signed(d, F.col("l_quantity")).alias("signed"))


@query("so04", "SELECT flow FROM (SELECT DISTINCT p_brand AS flow FROM part EXCEPT ALL SELECT DISTINCT flow FROM port)")
def so04(n):
    """Brands that no process has as its reference."""
    return n.table("part").select(F.col("p_brand").alias("flow")).distinct().exceptAll(n.ports.select("flow").distinct())


@query("st01", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 10", "")
def st01(n):
    """Sort with nulls last, top ten."""
    return n.table("supplier").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey").limit(10).select("s_suppkey", "s_acctbal")


@query("snk04", "SELECT process_idx // 256 AS chunk, count(*) AS processes, min(process_idx) AS first, max(process_idx) AS last FROM process GROUP BY 1")
def snk04(n):
    """Chunks of 256 processes with their ranges."""
    chunk = F.floor(F.col("process_idx") / 256)
    return n.processes.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("processes"), F.min("process_idx").alias("first"), F.max("process_idx").alias("last"))
