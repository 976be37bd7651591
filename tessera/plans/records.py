"""Queries on rows that are read, joined, kept or dropped: sources, jobs, retention, graphs and maps, reports.

Orders stand for results, artifacts and jobs: their date is when they were made, their customer who asked for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import gates, graph, jobs, linear, maps, selection
from ..sources import exports
from ..sources.network import Network
from ..sources.tables import numbered, page, running, shared_folder, written
from .audits import _V, _requests, _versions
from .compiler import _GEO, _REVIEW, _RULED, _SCOPE, _anchored, _gaps, _review, ruled
from .registry import NETWORK, query

NOW = "1997-01-01 00:00:00"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _orders(n: Network, *columns: Column | str) -> DataFrame:
    return n.table("orders").select(F.col("o_orderkey").alias("id"), *columns)


# Sources


@query("src01", "SELECT id, version FROM datasets WHERE id > 5 OR (id = 5 AND version > 2) ORDER BY id, version LIMIT 20", _V)
def src01(n):
    """A page of twenty rows after a key."""
    return page(_versions(n), ["id", "version"], (5, 2), 20)


@query("src02", "SELECT (rn - 1) // 4000 AS page, count(*) AS rows, min(id) AS first, max(id) AS last FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F' OR o_custkey = 7) GROUP BY 1", "")
def src02(n):
    """All of a scope, public rows and one user's, in pages along its key: rows are numbered once, so no page reads the table anew."""
    rows = n.table("orders").where("o_orderstatus = 'F' or o_custkey = 7").select(F.col("o_orderkey").alias("id"))
    page = F.floor(F.col("idx") / 4000).alias("page")
    return numbered(rows, ["id"]).groupBy(page).agg(F.count("*").alias("rows"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("src03", "SELECT id, version, rows FROM (SELECT l_suppkey AS id, l_linenumber AS version, count(*) AS rows FROM lineitem GROUP BY 1, 2) WHERE (id, version) IN (SELECT id, version FROM requests)", _V)
def src03(n):
    """Rows of exact roots: first by id, then by version."""
    t = n.table("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("version"))
    asked = _requests(n)
    return t.join(asked.select("id").distinct(), "id", "left_semi").join(asked, ["id", "version"], "left_semi").groupBy("id", "version").agg(F.count("*").alias("rows"))


@query("src15", "SELECT * FROM (SELECT 'active' AS pointer, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'latest_solve', event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 1)", "")
def src15(n):
    """The active snapshot and the one solved last, by their times."""
    e = n.table("events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")
    last = lambda name, rows: rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select(F.lit(name).alias("pointer"), "event_id", at)
    return last("active", e.where("event_type = 'view'")).unionByName(last("latest_solve", e.where("event_type <> 'view'")))


@query("so01", "SELECT kind, count(*) AS rows, count(DISTINCT id) AS ids FROM (SELECT 'supplier' AS kind, s_suppkey::VARCHAR AS id FROM supplier UNION ALL SELECT 'customer', c_custkey::VARCHAR FROM customer UNION ALL SELECT 'part', p_partkey::VARCHAR FROM part UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'region', r_regionkey::VARCHAR FROM region UNION ALL SELECT 'events', event_id::VARCHAR FROM events UNION ALL SELECT 'documents', doc_id::VARCHAR FROM documents) GROUP BY 1", "")
def so01(n):
    """Documents of eight tables in one, with their kind."""
    keys = {"supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id"}
    rows = _union([n.table(t).select(F.lit(t).alias("kind"), F.col(k).cast("string").alias("id")) for t, k in keys.items()])
    return rows.groupBy("kind").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))


@query("snk06", "SELECT l_suppkey // 16 AS chunk, count(*) AS rows, min(l_suppkey) AS first, max(l_suppkey) AS last, sha256(count(*) || ':' || sum(('0x' || substr(md5(k), 1, 16))::UBIGINT) || ':' || sum(('0x' || substr(md5(k), 17, 16))::UBIGINT)) AS sha256 FROM (SELECT l_suppkey, l_orderkey || ':' || l_linenumber || ':' || l_partkey AS k FROM lineitem) GROUP BY 1", "")
def snk06(n):
    """A bundle's manifest: ranges, counts and hashes of its chunks, none of which is missing."""
    rows = n.table("lineitem").select("l_suppkey", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("line"))
    found = exports.content_manifest(rows, "l_suppkey", "line", 16)
    missing = exports.missing_chunks(found, n.n, 16)
    return found.join(missing, "chunk", "left_anti")


# Joins and filters


@query("flt04", "SELECT count(*) AS edges, count(*) FILTER (WHERE p_size % 4 <> 2) AS kept FROM lineitem JOIN part ON p_partkey = l_partkey", "")
def flt04(n):
    """Edges of the graph without those to elementary flows."""
    kind = F.element_at(F.array(*map(F.lit, ("Product flow", "Waste flow", "Elementary flow", "Other flow"))), F.col("p_size") % 4 + 1)
    e = n.table("lineitem").select("l_partkey").join(n.table("part").select("p_partkey", fn.flow_space(kind).alias("space")), F.col("l_partkey") == F.col("p_partkey"))
    return e.agg(F.count("*").alias("edges"), F.count_if(F.col("space") != "biosphere").alias("kept"))


@query("flt14", "WITH f AS (SELECT p_partkey FROM part ORDER BY 1 LIMIT 500), s AS (SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 50), e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM f) AND l_suppkey IN (SELECT s_suppkey FROM s) ORDER BY 1, 2, 3, 4 LIMIT 1000) SELECT (SELECT count(*) FROM f) AS flows, (SELECT count(*) FROM s) AS processes, count(*) AS edges, max(l_orderkey) AS last FROM e", "")
def flt14(n):
    """Bounds on flows, processes and edges, in an order that is the same each time."""
    flows, processes = maps.first(n.table("part").select("p_partkey"), ["p_partkey"], 500), maps.first(n.table("supplier").select("s_suppkey"), ["s_suppkey"], 50)
    e = n.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    e = e.join(flows, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(processes, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    e = maps.first(e, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 1000)
    counts = flows.agg(F.count("*").alias("flows")).crossJoin(processes.agg(F.count("*").alias("processes")))
    return counts.crossJoin(e.agg(F.count("*").alias("edges"), F.max("l_orderkey").alias("last")))


@query("jn09", "SELECT word, count(*) AS parts FROM (SELECT unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_name] ELSE string_split(p_name, ' ') END) AS word FROM part) GROUP BY 1", "")
def jn09(n):
    """Documents against their own arrays; a value that is none counts as one of one element."""
    words = F.split("p_name", " ")
    json = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(F.col("p_name").alias("words")))).otherwise(F.to_json(F.struct(words.alias("words"))))
    text = F.get_json_object(json, "$.words")
    array = F.when(text.startswith("["), F.from_json(F.when(text.startswith("["), text), "array<string>")).otherwise(F.array(text))
    return n.table("part").select(F.explode(array).alias("word")).groupBy("word").agg(F.count("*").alias("parts"))


@query("jn16", "SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (WHERE o_orderdate <= a.at) AS before FROM orders CROSS JOIN (SELECT o_orderdate AS at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) a GROUP BY 1", "")
def jn16(n):
    """Rows with the one active snapshot."""
    active = n.table("orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select(F.col("o_orderdate").alias("at"))
    return n.table("orders").crossJoin(F.broadcast(active)).groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderdate") <= F.col("at")).alias("before"))


_WHERE = "CASE s_nationkey % 5 WHEN 0 THEN 'CN-BJ' WHEN 1 THEN 'uk' WHEN 2 THEN 'RER' WHEN 3 THEN ' de-by ' ELSE 'XX' END"


@query("jn20", f"SELECT key, count(*) AS processes, CASE key WHEN 'CN' THEN 3 WHEN 'GB' THEN 2 WHEN 'DE' THEN 1 END AS shape FROM (SELECT CASE {_WHERE} WHEN 'CN-BJ' THEN 'CN' WHEN 'uk' THEN 'GB' WHEN ' de-by ' THEN 'DE' END AS key FROM supplier) GROUP BY 1", "")
def jn20(n):
    """Places with the shape of their country; macro-regions and unknown ones have none."""
    k = F.col("s_nationkey") % 5
    place = F.when(k == 0, "CN-BJ").when(k == 1, "uk").when(k == 2, "RER").when(k == 3, " de-by ").otherwise("XX")
    shapes = n.spark.createDataFrame([("DE", 1), ("GB", 2), ("CN", 3)], "key string, shape int")
    return n.table("supplier").select(fn.region_key(place, ["DE", "GB"]).alias("key")).groupBy("key").agg(F.count("*").alias("processes")).join(F.broadcast(shapes), "key", "left")


@query("jn21", "SELECT c.c_custkey IS NOT NULL AS has_job, l.k IS NOT NULL AS has_cache, count(*) AS results FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o_custkey LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A') l ON l.k = o_orderkey GROUP BY 1, 2", "")
def jn21(n):
    """Results with their job and their cache entry, where these are there."""
    job = n.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("j"))
    cache = n.table("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("c")).distinct()
    rows = n.table("orders").join(job, "o_custkey", "left").join(cache, "o_orderkey", "left")
    return rows.groupBy(F.col("j").isNotNull().alias("has_job"), F.col("c").isNotNull().alias("has_cache")).agg(F.count("*").alias("results"))


@query("jn23", ", s AS (SELECT event_type, event_id % 2 = 0 AS base, value FROM events), p AS (SELECT event_type, quantile_disc(value, 0.95) FILTER (WHERE base) AS b, quantile_disc(value, 0.95) FILTER (WHERE NOT base) AS c FROM s GROUP BY 1) SELECT event_type, round((c / b - 1) * 100, 4) AS regression_pct, (c / b - 1) * 100 <= 5 AS passed FROM p", "z AS (SELECT 1)")
def jn23(n):
    """Paired samples by group: how much the candidate's 95th percentile is above the baseline's, and whether 5 % is kept."""
    s = n.table("events").withColumn("side", F.struct("event_type", (F.col("event_id") % 2 == 0).alias("base")))
    p = selection.selected(s, "side", "value", {"p95": selection.nearest_rank(0.95)}).groupBy("side.event_type")
    p = p.agg(F.max(F.when(F.col("side.base"), F.col("p95"))).alias("b"), F.max(F.when(~F.col("side.base"), F.col("p95"))).alias("c"))
    change = (F.col("c") / F.col("b") - 1) * 100
    return p.select("event_type", F.round(change, 4).alias("regression_pct"), (change <= 5).alias("passed"))


# Numbers


@query("ag23", ", x AS (SELECT process_idx, volume AS p, volume + (process_idx % 3) * 1e-3 AS q FROM process) SELECT count(*) AS size, round(max(abs(p - q)), 6) AS abs_inf, round(max(abs(p - q)) / greatest(max(abs(p)), 1), 9) AS rel_inf, round(sqrt(sum((p - q) * (p - q))), 6) AS l2, max(abs(p - q)) <= 1e-9 OR max(abs(p - q)) / greatest(max(abs(p)), 1) <= 1e-6 AS passed FROM x")
def ag23(n):
    """How far two vectors are apart: largest difference, also relative, length of the difference, and whether either bound holds."""
    i = F.col("process_idx")
    vector = lambda v: n.processes.select(F.lit(0).alias("rhs"), i.alias("idx"), v.alias("value"))
    out = linear.compared(vector(F.col("volume")), vector(F.col("volume") + (i % 3) * 1e-3))
    return out.select("size", F.round("abs_inf", 6).alias("abs_inf"), F.round("rel_inf", 9).alias("rel_inf"), F.round("l2", 6).alias("l2"), "passed")


@query("ag25", "SELECT event_type, median(value) AS median, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS sd, round(stddev_pop(value) / avg(value), 6) AS cv, min(value) AS least, max(value) AS most FROM events GROUP BY 1", "")
def ag25(n):
    """Median, nearest-rank 95th percentile, mean, population variance and deviation, also over the mean, extremes."""
    e, v = n.table("events"), "value"
    ranks = selection.selected(e, "event_type", v, {"p95": selection.nearest_rank(0.95), **selection.middle()})
    sums = e.groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.var_pop(v), 4).alias("variance"), F.round(F.stddev_pop(v), 6).alias("sd"), F.round(F.try_divide(F.stddev_pop(v), F.avg(v)), 6).alias("cv"), F.min(v).alias("least"), F.max(v).alias("most"))
    return sums.join(ranks, "event_type").withColumn("median", (F.col("low") + F.col("high")) / 2).drop("low", "high")


@query("ag17", "SELECT node, count(*) AS degree, max(count(*)) OVER () AS most FROM (SELECT row_idx AS node FROM a UNION ALL SELECT col_idx FROM a) GROUP BY 1")
def ag17(n):
    """Degree of each process, both ends counted, and the largest."""
    d = graph.degrees(n.a.select(F.col("col_idx").alias("src"), F.col("row_idx").alias("dst")))
    return d.crossJoin(F.broadcast(d.agg(F.max("degree").alias("most"))))


@query("ag18", "SELECT 1 AS level, p_type AS label, count(*) AS flows FROM part GROUP BY 2 UNION ALL SELECT 3, p_type || ' / ' || p_brand || ' / S' || (p_size % 2), count(*) FROM part GROUP BY 2", "")
def ag18(n):
    """Sizes of clusters by the first level of a category path and by three."""
    levels = F.array("p_type", "p_brand", F.concat(F.lit("S"), (F.col("p_size") % 2).cast("string")), F.lit("more"))
    return _union([n.table("part").groupBy(F.lit(k).alias("level"), fn.cluster(levels, k)["label"].alias("label")).agg(F.count("*").alias("flows")) for k in (1, 3)])


@query("cp06", _RULED + "SELECT rule, consumer, flow, k AS candidates, kind, reason FROM z WHERE rule IN ('strict_unique_provider', 'best_provider_strict')")
def cp06(n):
    """Kind of decision for each demand under two rules, and why one fails."""
    return ruled(n, ("strict_unique_provider", "best_provider_strict")).select("rule", "consumer", "flow", F.col("k").alias("candidates"), "kind", "reason")


@query("cp10", ", s AS (SELECT *, sum(CASE WHEN volume_fallback THEN 0 ELSE volume END) OVER p AS real, count(*) OVER p AS k, CASE WHEN volume_fallback THEN 0 ELSE volume END AS own FROM candidate WINDOW p AS (PARTITION BY consumer, flow)) SELECT 'hybrid' AS rule, consumer, flow, provider, round(CASE WHEN real > 0 THEN own / real ELSE 1.0 / k END, 6) AS weight FROM s UNION ALL SELECT 'evidence', consumer, flow, provider, round(own / real, 6) FROM s WHERE real > 0")
def cp10(n):
    """split_by_evidence, which leaves a demand without any evidence open, and its hybrid, which then shares equally."""
    both = (("hybrid", "split_by_evidence_hybrid"), ("evidence", "split_by_evidence"))
    return _union([n.ruled(rule).pairs(6).select(F.lit(name).alias("rule"), "consumer", "flow", "provider", "weight") for name, rule in both])


@query("cp18", "SELECT count(*) AS k, sha256(count(*) || '|' || strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') || '|{\"rule\":\"split_equal\"}') AS fingerprint, true AS reuse_same, false AS reuse_changed FROM orders", "")
def cp18(n):
    """A source's fingerprint from its count, last change and the build's configuration; a snapshot of the same one is used again."""
    found = exports.fingerprint(n.table("orders"), "o_orderdate", {"rule": "split_equal"})
    other = exports.fingerprint(n.table("orders"), "o_orderdate", {"rule": "split_by_process_volume"}).select(F.col("fingerprint").alias("other"))
    again = exports.fingerprint(n.table("orders"), "o_orderdate", {"rule": "split_equal"}).select(F.col("fingerprint").alias("again"))
    return found.crossJoin(other).crossJoin(again).select("k", "fingerprint", (F.col("again") == F.col("fingerprint")).alias("reuse_same"), (F.col("other") == F.col("fingerprint")).alias("reuse_changed"))


# Graphs and maps


@query("gr01", "SELECT col_idx AS src, list_aggregate(list_sort(list(DISTINCT row_idx)), 'string_agg', ',') AS providers FROM a GROUP BY 1")
def gr01(n):
    """Sorted distinct providers of each consumer."""
    e = n.a.select(F.col("col_idx").alias("src"), F.col("row_idx").alias("dst"))
    return graph.adjacency(e).select("src", F.array_join(F.col("targets").cast("array<string>"), ",").alias("providers"))


@query("gr14", "SELECT p.process_idx AS src, coalesce(t.targets, '') AS targets, coalesce(sum(k) OVER (ORDER BY p.process_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM process p LEFT JOIN (SELECT col_idx, list_aggregate(list_sort(list(DISTINCT row_idx)), 'string_agg', ',') AS targets, count(DISTINCT row_idx) AS k FROM a GROUP BY 1) t ON t.col_idx = p.process_idx")
def gr14(n):
    """Adjacency in compressed rows: each process's sorted providers and where they start among all."""
    e = graph.adjacency(n.a.select(F.col("col_idx").alias("src"), F.col("row_idx").alias("dst")))
    rows = n.processes.select(F.col("process_idx").alias("src")).join(e.select("src", "degree"), "src", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    at = running(rows, ["src"], "degree", "offset").select("src", "offset")  # of numbers alone; the lists stay where they are made
    return at.join(e, "src", "left").select("src", F.coalesce(F.array_join(F.col("targets").cast("array<string>"), ","), F.lit("")).alias("targets"), "offset")


_BIP = "e AS (SELECT DISTINCT l_suppkey AS p, l_partkey % 40 AS f, CASE WHEN l_returnflag = 'R' THEN 'Input' ELSE 'Output' END AS d FROM lineitem)"


def _bipartite(n: Network) -> DataFrame:
    d = F.when(F.col("l_returnflag") == "R", "Input").otherwise("Output")
    return n.table("lineitem").select(F.col("l_suppkey").alias("process"), (F.col("l_partkey") % 40).alias("flow"), d.alias("direction")).distinct()


@query("gr13", "SELECT kind, id, count(*) AS degree, count(*) FILTER (WHERE out) AS leaving FROM (SELECT 'process' AS kind, p AS id, d = 'Output' AS out FROM e UNION ALL SELECT 'flow', f, d = 'Input' FROM e) GROUP BY 1, 2", _BIP)
def gr13(n):
    """The graph of processes and flows: nodes with their degree, and how many edges leave them."""
    return maps.nodes(_bipartite(n))


@query("snk13", "SELECT 'edges' AS file, count(*) AS rows FROM e UNION ALL SELECT 'nodes', (SELECT count(DISTINCT p) FROM e) + (SELECT count(DISTINCT f) FROM e) UNION ALL SELECT 'adjacency', (SELECT count(DISTINCT p) FROM e) + (SELECT count(DISTINCT f) FROM e) UNION ALL SELECT 'directions', count(DISTINCT d) FROM e", _BIP)
def snk13(n):
    """The graph's files written: edges, nodes, compressed rows, dictionaries; and counted."""
    base = shared_folder(n.spark)
    maps.write(_bipartite(n), base)
    return _union([n.spark.read.parquet(f"{base}/{k}").agg(F.lit(k).alias("file"), F.count("*").alias("rows")) for k in ("edges", "nodes", "adjacency", "directions")])


@query("st04", "SELECT row_number() OVER (ORDER BY degree DESC, f) - 1 AS place, f AS flow FROM (SELECT f, count(*) AS degree FROM e GROUP BY 1)", _BIP)
def st04(n):
    """Flows in the order in which a search lists them: by degree, then by name."""
    by = maps.nodes(_bipartite(n)).where("kind = 'flow'").select((-F.col("degree")).alias("d"), F.col("id").alias("flow"))
    return numbered(by, ["d", "flow"], "place").select("place", "flow")


@query("gr15", ", v AS (SELECT process_idx, region FROM process WHERE region < 3), k AS (SELECT p, f, d FROM e WHERE p IN (SELECT process_idx FROM v)), links AS (SELECT DISTINCT o.f, o.p AS src, i.p AS dst FROM k o JOIN k i ON o.f = i.f AND o.d = 'Output' AND i.d = 'Input' AND o.p <> i.p), ends AS (SELECT src AS node FROM links UNION ALL SELECT dst FROM links) SELECT (SELECT count(*) FROM v) AS processes, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM process WHERE region >= 3) AS excluded, (SELECT count(DISTINCT region) FROM v) AS regions, (SELECT max(c) FROM (SELECT count(*) AS c FROM ends GROUP BY node)) AS most, (SELECT array_to_string(list_sort(list(DISTINCT location))[1:8], ',') FROM process WHERE region >= 3) AS examples", f"{NETWORK}, {_BIP}")
def gr15(n):
    """A map of the processes of three regions: links from makers to users of a flow, what is left out, and where that lies."""
    anchors = n.processes.select(F.col("process_idx").cast("long").alias("process"), F.when(F.col("region") < 3, F.col("region")).alias("anchor"), "location")
    return maps.summary(_bipartite(n), anchors)


# Jobs, caches and retention


def _jobs(n: Network) -> DataFrame:
    k = F.col("o_orderkey") % 5
    status = F.when(k == 0, "queued").when(k < 3, "running").otherwise("completed")
    expires = F.when(k == 1, F.col("o_orderdate")).when(k == 2, F.lit("2100-01-01").cast("timestamp"))
    return _orders(n, F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 50).alias("key"), F.col("o_orderdate").alias("created"), status.alias("status"), expires.alias("lease_expires"))


_JOBS = "j AS (SELECT o_orderkey AS id, o_orderstatus AS kind, o_custkey % 50 AS key, o_orderdate AS created, CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'running' ELSE 'completed' END AS status, o_orderkey % 5 = 1 AND o_orderdate < TIMESTAMP '1997-01-01' AS lapsed FROM orders)"


@query("ss01", "SELECT id, 'running' AS status, strftime(TIMESTAMP '1997-01-01 00:05:00', '%Y-%m-%d %H:%M:%S') AS lease FROM (SELECT * FROM j WHERE status = 'queued' OR lapsed ORDER BY created, id LIMIT 20)", _JOBS)
def ss01(n):
    """The twenty oldest jobs that are queued or whose lease has ended, claimed for five minutes; an end that comes twice holds once."""
    found = jobs.claim(_jobs(n), NOW, 20, 300).where("claimed")
    ends = n.spark.createDataFrame([(-1, "completed"), (-1, "failed")], "id long, end string")
    return jobs.finished(found, ends).select("id", "status", F.date_format("lease_expires", "yyyy-MM-dd HH:mm:ss").alias("lease"))


@query("ss02", "SELECT status, count(*) AS requests FROM (SELECT user_id, arg_max(CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'ready' ELSE 'failed' END, event_id) AS status FROM events GROUP BY 1) GROUP BY 1", "")
def ss02(n):
    """Cache entries by the state that their log ends in."""
    t = F.col("event_type")
    status = F.when(t == "view", "pending").when(t == "click", "running").when(t == "purchase", "ready").otherwise("failed")
    log = n.table("events").select(F.col("user_id").alias("key"), status.alias("status"), F.col("event_id").alias("at"), F.col("event_id").alias("id"))
    return jobs.cache_states(log).groupBy("status").agg(F.count("*").alias("requests"))


@query("ss04", "SELECT node FROM reach", "RECURSIVE " + NETWORK.strip() + ", reach AS (SELECT 0 AS node UNION SELECT a.row_idx FROM reach JOIN a ON a.col_idx = reach.node)")
def ss04(n):
    """A traversal in passes of at most twenty nodes whose state lies in a table between them, so that it can go on anywhere.

    Processes that demand of a place reach all that make for it, so places are the nodes that are followed: the passes are as many as
    these need, not as many as there are processes, and entries of A are never made.
    """
    made, asked = (m.select("row_idx", "col_idx") for m in (n.product.left, n.product.right))
    by = asked.select(F.col("row_idx").alias("dst"), F.col("col_idx").alias("process"))
    e = written(made.select(F.col("col_idx").alias("src"), F.col("row_idx").alias("process")).join(by, "process").select("src", "dst").distinct())
    state, left = graph.started(asked.where("col_idx = 0").select(F.col("row_idx").alias("node"))), True
    while left:
        state, left = graph.passed(e, state, 20)
    reached = made.join(state.select(F.col("node").alias("col_idx")), "col_idx").select(F.col("row_idx").alias("node"))
    return n.spark.range(1).select(F.col("id").cast("int").alias("node")).unionByName(reached).distinct()


@query("ss05", "SELECT fate, count(*) AS objects FROM (SELECT CASE WHEN o_orderkey % 7 = 1 THEN 'kept' ELSE 'deleted' END AS fate FROM orders WHERE o_orderdate + INTERVAL 1 YEAR < TIMESTAMP '1996-12-31 23:59:59' AND o_orderkey % 7 <> 0) GROUP BY 1", "")
def ss05(n):
    """Garbage in two phases: claimed when nothing refers to it, deleted if that still holds while the claim does."""
    objects = _orders(n, (F.col("o_orderdate") + F.expr("interval 1 year")).alias("expires"))
    ids = n.table("orders").select(F.col("o_orderkey").alias("id"))
    claims = jobs.claimed_garbage(objects, ids.where("id % 7 = 0"), "1996-12-31 23:59:59", 3600)
    return jobs.collected(claims, ids.where("id % 7 < 2"), NOW).groupBy("fate").agg(F.count("*").alias("objects"))


@query("ss06", "SELECT refused, soft, count(*) AS demands FROM (SELECT CASE WHEN o_totalprice > 400000 THEN 'memory' WHEN o_custkey > 1000 THEN 'temp' END AS refused, NOT (o_totalprice > 400000 OR o_custkey > 1000) AND o_totalprice > 200000 AS soft FROM orders) GROUP BY 1, 2", "")
def ss06(n):
    """Demands on resources that are admitted, with a warning, or refused, and by what."""
    d = _orders(n, F.col("o_totalprice").alias("memory"), F.col("o_custkey").alias("temp"))
    return jobs.resources(d, {"memory": 400_000, "temp": 1000}, 200_000).groupBy("refused", "soft").agg(F.count("*").alias("demands"))


@query("ag30", "SELECT kind, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'running') < 3000 AS admit FROM j GROUP BY 1", _JOBS)
def ag30(n):
    """Whether one more job of a kind may run."""
    return jobs.admitted(_jobs(n), 3000)


@query("op11", "SELECT (SELECT count(*) FROM j) + count(*) AS jobs, count(*) AS added FROM (SELECT DISTINCT key FROM (SELECT o_custkey % 90 AS key FROM orders) WHERE key NOT IN (SELECT key FROM j WHERE status <> 'completed'))", _JOBS)
def op11(n):
    """Jobs enqueued once for each key that no open job holds."""
    old = written(_jobs(n))
    new = _orders(n, F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 90).alias("key"), F.col("o_orderdate").alias("created"), F.lit("queued").alias("status"), F.lit(None).cast("timestamp").alias("lease_expires")).withColumn("id", -F.col("id") - 1)
    return jobs.enqueued(old, new).agg(F.count("*").alias("jobs"), F.count_if(F.col("id") < 0).alias("added"))


@query("wn13", "SELECT why, count(*) AS files FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-02' THEN 'expired' WHEN row_number() OVER (PARTITION BY o_custkey % 10, o_orderdate < TIMESTAMP '1996-01-02' ORDER BY o_orderdate DESC, o_orderkey DESC) > 100 THEN 'excess' END AS why FROM orders) WHERE why IS NOT NULL GROUP BY 1", "")
def wn13(n):
    """Files to delete: those over a year old, and all but the newest hundred of a folder."""
    files = n.table("orders").select((F.col("o_custkey") % 10).alias("folder"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    return jobs.newest_kept(files, NOW, 365, 100).groupBy("why").agg(F.count("*").alias("files"))


@query("ag27", "SELECT o_orderstatus AS kind, o_custkey % 400 AS directory, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS names, count(*) AS objects, sum(o_custkey)::BIGINT AS bytes FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2", "")
def ag27(n):
    """Candidates by directory: their names, how many and how large."""
    rows = n.table("orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select(F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 400).alias("directory"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").alias("bytes"))
    return jobs.directories(rows)


def _retention(n: Network) -> DataFrame:
    k = F.col("o_orderkey")
    job = F.when(k % 11 != 0, F.col("o_custkey"))
    a = n.table("orders").select(k.alias("id"), job.alias("job"), F.when(k % 11 != 1, F.when(k % 13 == 0, "running").otherwise("completed")).alias("job_status"), (k % 17 == 0).alias("pinned"), F.when(k % 19 == 0, "deleted").when(k % 23 == 0, "failed").otherwise("ready").alias("status"), F.when(k % 29 != 0, F.col("o_orderdate")).alias("expires"), (k % 31 == 0).alias("cached"), F.col("o_custkey").alias("bytes"))
    a = a.withColumn("reason", jobs.artifact_reason(NOW)).select(F.lit("artifacts").alias("area"), F.lit("delete_object_then_mark_deleted").alias("action"), "reason", "bytes", F.lit(0).cast("long").alias("hits"))
    c = n.table("events").select(F.when(F.col("event_id") % 10 == 0, "pending").otherwise("ready").alias("status"), F.col("ts").alias("accessed"), F.when(F.col("event_id") % 7 == 0, "queued").alias("job_status"), F.col("user_id").alias("hits"))
    c = c.withColumn("reason", jobs.cache_reason("2024-01-20 00:00:00", 14)).select(F.lit("request_cache").alias("area"), F.lit("delete_stale_request_cache_row").alias("action"), "reason", F.lit(0).cast("long").alias("bytes"), "hits")
    return a.unionByName(c)


_RET = """ret AS (SELECT 'artifacts' AS area, 'delete_object_then_mark_deleted' AS action, CASE WHEN o_orderkey % 11 IN (0, 1) THEN 'protected_missing_parent_worker_job' WHEN o_orderkey % 17 = 0 THEN 'protected_pinned_artifact' WHEN o_orderkey % 19 = 0 THEN 'protected_already_deleted' WHEN o_orderkey % 23 = 0 THEN 'protected_artifact_not_ready' WHEN o_orderkey % 13 = 0 THEN 'protected_active_parent_worker_job' WHEN o_orderkey % 29 = 0 THEN 'protected_missing_expires_at' WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'protected_expires_at_in_future' WHEN o_orderkey % 31 = 0 THEN 'protected_request_cache_reference' ELSE 'eligible_expired_unpinned_artifact' END AS reason, o_custkey AS bytes, 0 AS hits FROM orders
UNION ALL SELECT 'request_cache', 'delete_stale_request_cache_row', CASE WHEN event_id % 10 = 0 THEN 'protected_active_request_cache' WHEN ts >= TIMESTAMP '2024-01-06' THEN 'protected_recent_request_cache_access' WHEN event_id % 7 = 0 THEN 'protected_active_parent_worker_job' ELSE 'eligible_stale_request_cache' END, 0, user_id FROM events)"""


@query("rt01", "SELECT area, action, starts_with(reason, 'eligible') AS eligible, reason, count(*) AS rows, sum(bytes)::BIGINT AS bytes, sum(hits)::BIGINT AS hits FROM ret GROUP BY ALL", _RET)
def rt01(n):
    """Artifacts and cache entries by why they are kept or may go, with their sizes."""
    return _retention(n).groupBy("area", "action", F.col("reason").startswith("eligible").alias("eligible"), "reason").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("hits").alias("hits"))


@query("so02", "SELECT area, reason, count(*) AS rows FROM ret GROUP BY 1, 2", _RET)
def so02(n):
    """Classified relations of two kinds in one."""
    return _retention(n).groupBy("area", "reason").agg(F.count("*").alias("rows"))


@query("op12", ", c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 1 AND o_orderdate < TIMESTAMP '1997-01-01') SELECT done, i // 1000 AS batch, count(*) AS results FROM c CROSS JOIN (VALUES ('planned'), ('deleted')) AS t(done) GROUP BY 1, 2", "z AS (SELECT 1)")
def op12(n):
    """Results that may go, the oldest first, in batches of a thousand: planned in a dry run, deleted in a real one."""
    newest = W.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    old = n.table("orders").withColumn("rn", F.row_number().over(newest)).where((F.col("rn") > 1) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")))
    rows = written(numbered(old.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]))
    return _union([jobs.batches(rows, 1000, execute).groupBy("done", "batch").agg(F.count("*").alias("results")) for execute in (False, True)])


_JOBS = ("result_gc", "package_artifact_gc", "other", "snapshot_gc")


@query("op13", "SELECT argv, count(*) AS jobs FROM (SELECT CASE WHEN program IS NOT NULL THEN program || ' --max-batches ' || (o_custkey % 3) || CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 2 = 0 THEN ' --execute' ELSE ' --dry-run' END END AS argv FROM (SELECT *, ['result_gc', 'package_gc', NULL, 'snapshot_gc'][o_orderkey % 4 + 1] AS program FROM orders)) GROUP BY 1", "")
def op13(n):
    """Maintenance jobs that orders ask for as programs with arguments; a dry run holds against a wish to execute, an unknown job has none."""
    kind = F.get(F.array(*map(F.lit, _JOBS)), (F.col("o_orderkey") % 4).cast("int"))
    argv = jobs.argv(kind, {"max_batches": F.col("o_custkey") % 3}, F.col("o_orderstatus") != "F", F.col("o_orderkey") % 2 == 1)
    return n.table("orders").groupBy(argv.alias("argv")).agg(F.count("*").alias("jobs"))


@query("op14", "SELECT 'service' AS role, count(*) AS rows FROM orders UNION ALL SELECT 'authenticated', count(*) FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'anonymous', 0", "")
def op14(n):
    """What each role may read."""
    rows = n.table("orders")
    return _union([jobs.visible(rows, "o_custkey", role, user).agg(F.lit(role).alias("role"), F.count("*").alias("rows")) for role, user in (("service", None), ("authenticated", 7), ("anonymous", 7))])


@query("op10", "SELECT 'a' AS bundle, 'parent' AS part, count(*) AS rows FROM region UNION ALL SELECT 'a', 'child', count(*) FROM nation", "")
def op10(n):
    """A parent and its children written together: a bundle that fails on the way is not seen at all."""
    path = shared_folder(n.spark)
    whole = {"parent": n.table("region"), "child": n.table("nation")}
    exports.write_together(whole, path, "a")
    try:
        exports.write_together({"parent": n.table("region"), "child": n.table("nation").select(F.raise_error(F.lit("broken")).alias("x"))}, path, "b")
    except Exception as e:  # noqa: BLE001 (Spark wraps what the row raises)
        if "broken" not in str(e):
            raise
    return exports.read_together(n.spark, path, ["parent", "child"])


@query("op01", "SELECT printf('%08x-0000-4000-8000-%012x', 1, s_suppkey) AS id, '01.00.000' AS version, s_suppkey % 3 = 0 AS published FROM supplier", "")
def op01(n):
    """The roots that a package's manifest names, under either spelling, and which of them are published."""
    s = F.col("s_suppkey")
    state = F.when(s % 3 == 0, 100).otherwise(20)
    one = F.struct(fn.uuid(1, s).alias("id"), F.lit("01.00.000").alias("version"), state.alias("stateCode"))
    two = F.struct(fn.uuid(1, s).alias("processId"), F.lit(" 01.00.000").alias("processVersion"), state.alias("state_code"))
    text = F.when(s % 2 == 0, F.to_json(one)).otherwise(F.to_json(two))
    manifest = n.table("supplier").groupBy((s % 4).alias("m")).agg(F.concat(F.lit('{"processes":['), F.array_join(F.collect_list(text), ","), F.lit("]}")).alias("json"))
    roots = manifest.select(F.inline(jobs.request_roots(F.col("json"))))
    return roots.select("id", "version", F.col("state").between(100, 199).alias("published"))


@query("op03", "SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'not_in_axis' WHEN y.id IS NULL THEN 'not_certified' ELSE 'moved' END AS fault FROM (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier WHERE s_suppkey % 50 <> 7) x FULL JOIN (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier WHERE s_suppkey % 50 <> 3) y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL OR x.i <> y.i", "")
def op03(n):
    """Where an axis is not the certified one, in what it holds or in its order."""
    s = n.table("supplier").select(F.col("s_suppkey").alias("id"))
    return exports.axis_faults(numbered(s.where("id % 50 <> 7"), ["id"]), numbered(s.where("id % 50 <> 3"), ["id"]))


@query("op04", "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'bound' WHEN 1 THEN 'missing_binding' WHEN 2 THEN 'unbound_snapshot' ELSE 'differs' END AS binding, count(*) AS results FROM orders GROUP BY 1", "")
def op04(n):
    """Results whose evidence is the snapshot's, whatever the order of its keys."""
    k, a, b = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    own = F.when(k % 4 != 2, F.to_json(F.struct(a.alias("a"), b.alias("b"))))
    given = F.when(k % 4 == 0, F.to_json(F.struct(b.alias("b"), a.alias("a")))).when(k % 4 == 2, F.to_json(F.struct(a.alias("a")))).when(k % 4 == 3, F.to_json(F.struct((a + 1).alias("a"), b.alias("b"))))
    return n.table("orders").groupBy(exports.binding(own, given).alias("binding")).agg(F.count("*").alias("results"))


@query("op05", ", inside AS (SELECT * FROM x WHERE id % 4 = 0), f AS (SELECT id, string_agg(k, '|' ORDER BY k) AS fp FROM (SELECT id, flow || ':' || lower(direction) || ':' || amount AS k FROM inside) GROUP BY 1) SELECT 'duplicate_exchanges' AS detector, count(*) AS found FROM (SELECT fp FROM f GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'service_loops', count(*) FROM inside i JOIN inside o ON i.id = o.id AND i.flow = o.flow AND i.direction = 'Input' AND o.direction = 'Output' AND i.amount = o.amount AND i.amount NOT IN ('12%', 'n/a')", _REVIEW)
def op05(n):
    """Why a snapshot may not factorise: equal processes and loops among those that it holds."""
    scope = n.table("orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"))
    inside = _review(n).join(scope, "id", "left_semi")
    parts = {"duplicate_exchanges": gates.equal_exchanges(inside), "service_loops": gates.loops(inside)}
    return _union([rows.agg(F.lit(name).alias("detector"), F.count("*").alias("found")) for name, rows in parts.items()])


@query("op06", "SELECT o_orderkey AS id, o_orderkey::VARCHAR AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_custkey ELSE 'v' || o_custkey END AS snapshot_id FROM orders", "")
def op06(n):
    """Payloads under their canonical names; a canonical name holds against its aliases."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    one = F.to_json(F.struct(k.alias("jobId"), F.concat(F.lit("s"), c).alias("snapshot_id"), F.concat(F.lit("x"), c).alias("modelVersion")))
    two = F.to_json(F.struct(k.alias("job_id"), F.lit("no").alias("lcaJobId"), F.concat(F.lit("v"), c).alias("modelVersion")))
    p = jobs.normal_payload(F.when(k % 2 == 0, one).otherwise(two))
    return n.table("orders").select(k.alias("id"), p["job_id"].alias("job_id"), p["snapshot_id"].alias("snapshot_id"))


# Reports


@query("dq01", "SELECT tag, count(*) AS exchanges, count(DISTINCT p_partkey) AS flows FROM (SELECT p_partkey, CASE WHEN l_linenumber % 4 = 0 AND p_size % 2 = 0 THEN 'pn_comment_but_mass_flow' WHEN p_name ILIKE '%small%' THEN 'pm02_flow_hit' WHEN p_name ILIKE '%gear%' THEN 'particle_flow_hit' END AS tag FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R') WHERE tag IS NOT NULL GROUP BY 1", "")
def dq01(n):
    """Outputs whose comment or flow does not go with the flow's property, by the first suspicion that holds."""
    flows = n.table("part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "Mass").otherwise("Particles").alias("property"))
    ex = n.table("lineitem").where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_linenumber") % 4 == 0, "counted as PN").alias("comment")).join(flows, "p_partkey", "left")
    tag = gates.suspicion(F.col("comment"), F.col("name"), F.col("property"), "small", "gear")
    return ex.withColumn("tag", tag).where("tag is not null").groupBy("tag").agg(F.count("*").alias("exchanges"), F.countDistinct("p_partkey").alias("flows"))


_DQ3 = _GEO + _RULED + _SCOPE.rstrip() + ", w AS (SELECT * FROM z WHERE rule = 'split_by_process_volume') "


@query("dq03", _DQ3 + "SELECT 'write_pct' AS report, 'all' AS label, '' AS sub, round(100.0 * count(*) FILTER (WHERE kind IN ('unique_provider', 'multi_resolved')) / nullif(count(*), 0), 2) AS value FROM w UNION ALL SELECT 'usable_pct', rule, '', round(100.0 * count(*) FILTER (WHERE kind IN ('unique_provider', 'multi_resolved')) / nullif(count(*) FILTER (WHERE k > 0), 0), 2) FROM z GROUP BY rule UNION ALL SELECT 'reason', rule, reason, count(*) FROM z WHERE reason IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'strategy', rule, strategy, count(*) FROM z WHERE strategy IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'tier', strategy, tier::VARCHAR, count(*) FROM w WHERE tier IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'source', source, '', count(*) FROM anchored GROUP BY 2 UNION ALL SELECT 'volume', CASE WHEN valid = k THEN 'all_valid' WHEN valid > 0 THEN 'partial' ELSE 'none' END, '', count(*) FROM w WHERE k > 0 GROUP BY 2 UNION ALL SELECT 'flow_gap', flow, '', count(*) FROM miss GROUP BY 2 UNION ALL SELECT 'process_gap', consumer::VARCHAR, '', count(*) FROM miss GROUP BY 2 UNION ALL SELECT 'trend', o_orderstatus, '', last FROM (SELECT o_orderstatus, max(o_orderkey) AS last FROM orders GROUP BY 1)")
def dq03(n):
    """The ten reports on what is written to A: shares, reasons, strategies, tiers, sources, volumes, gaps, and the latest by state."""
    z = written(ruled(n))
    w = z.where("rule = 'split_by_process_volume'")
    done, double = F.col("kind").isin("unique_provider", "multi_resolved"), lambda c: F.col(c).cast("double").alias("value")
    row = lambda df, report, label, sub, value: df.select(F.lit(report).alias("report"), label.cast("string").alias("label"), sub.cast("string").alias("sub"), value)
    none, count = F.lit(""), F.count("*").alias("n")
    near, _ = _anchored(n)
    gaps = written(_gaps(n).where("unmatched"))
    quality = F.when(F.col("valid") == F.col("k"), "all_valid").when(F.col("valid") > 0, "partial").otherwise("none")
    return _union(
        [
            row(w.agg(fn.percent(F.count_if(done), F.count("*")).alias("n")), "write_pct", F.lit("all"), none, double("n")),
            row(z.groupBy("rule").agg(fn.percent(F.count_if(done), F.count_if(F.col("k") > 0)).alias("n")), "usable_pct", F.col("rule"), none, double("n")),
            row(z.where("reason is not null").groupBy("rule", "reason").agg(count), "reason", F.col("rule"), F.col("reason"), double("n")),
            row(z.where("strategy is not null").groupBy("rule", "strategy").agg(count), "strategy", F.col("rule"), F.col("strategy"), double("n")),
            row(w.where("tier is not null").groupBy("strategy", "tier").agg(count), "tier", F.col("strategy"), F.col("tier"), double("n")),
            row(near.groupBy("source").agg(count), "source", F.col("source"), none, double("n")),
            row(w.where("k > 0").groupBy(quality.alias("q")).agg(count), "volume", F.col("q"), none, double("n")),
            row(gaps.groupBy("flow").agg(count), "flow_gap", F.col("flow"), none, double("n")),
            row(gaps.groupBy("consumer").agg(count), "process_gap", F.col("consumer"), none, double("n")),
            row(n.table("orders").groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("n")), "trend", F.col("o_orderstatus"), none, double("n")),
        ]
    )
