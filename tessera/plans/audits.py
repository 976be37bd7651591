"""Queries on versions, scopes, audits, retention and packages over the supplied tables, and their SQL.

The supplied tables hold no documents, so ids and states are stood in for: a supplier's lines are its dataset's
versions (by line number), orders are results with a state, a time and an owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import linking, versions
from ..sources import documents
from ..sources.network import Network
from .registry import query


def _versions(n: Network) -> DataFrame:
    return n.table("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("version")).distinct()


def _requests(n: Network) -> DataFrame:
    return n.table("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 9).alias("version"))


_V = "datasets AS (SELECT DISTINCT l_suppkey AS id, l_linenumber AS version FROM lineitem), requests AS (SELECT s_suppkey AS id, s_nationkey % 9 AS version FROM supplier)"


# Filters


@query("flt01", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') OR o_custkey = 7", "")
def flt01(n):
    """Rows in the admitted states, and all of one owner."""
    return n.table("orders").where(F.col("o_orderstatus").isin("F", "O") | (F.col("o_custkey") == 7)).select("o_orderkey")


@query("flt02", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_custkey = 7 AND o_orderstatus = 'O')", "")
def flt02(n):
    """The data scope: published rows, and the drafts of one owner."""
    state = F.col("o_orderstatus")
    return n.table("orders").where((state == "F") | ((F.col("o_custkey") == 7) & (state == "O"))).select("o_orderkey")


@query("flt03", ", s AS (SELECT process_idx, CASE WHEN region < 2 THEN 'public' ELSE 'private' END AS part FROM process) SELECT x.part || '-' || y.part AS label, count(*) AS edges FROM a JOIN s x ON x.process_idx = a.col_idx JOIN s y ON y.process_idx = a.row_idx GROUP BY 1")
def flt03(n):
    """Edges by the public or private part of both ends."""
    part = n.processes.select("process_idx", F.when(F.col("region") < 2, "public").otherwise("private").alias("part"))
    ends = n.a.join(part.select(F.col("process_idx").alias("col_idx"), F.col("part").alias("x")), "col_idx").join(part.select(F.col("process_idx").alias("row_idx"), F.col("part").alias("y")), "row_idx")
    return ends.groupBy(F.concat_ws("-", "x", "y").alias("label")).agg(F.count("*").alias("edges"))


@query("flt09", "SELECT l_linenumber, count(*) AS rows, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS numbers FROM lineitem GROUP BY 1", "")
def flt09(n):
    """Amount texts that are numbers; others hold a percent sign or a word."""
    k = F.col("l_linenumber") % 3
    text = F.when(k == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("string"))).when(k == 1, F.concat(F.col("l_quantity").cast("string"), F.lit("%"))).otherwise("n/a")
    return n.table("lineitem").groupBy("l_linenumber").agg(F.count("*").alias("rows"), F.count_if(fn.is_number(text)).alias("numbers"))


@query("flt12", "SELECT a.row_idx, a.col_idx FROM a WHERE a.row_idx IN (SELECT process_idx FROM process WHERE region = 1) AND a.col_idx IN (SELECT process_idx FROM process WHERE region = 1)")
def flt12(n):
    """Edges with both ends in the scope."""
    seen = n.processes.where("region = 1").select("process_idx")
    return n.a.join(seen.select(F.col("process_idx").alias("row_idx")), "row_idx", "left_semi").join(seen.select(F.col("process_idx").alias("col_idx")), "col_idx", "left_semi").select("row_idx", "col_idx")


@query("flt13", "SELECT p_partkey, CASE WHEN p_name ILIKE '%RING%' THEN 'ring' WHEN p_name ILIKE 'small%' THEN 'small' END AS tag FROM part WHERE p_name ILIKE '%RING%' OR p_name ILIKE 'small%'", "")
def flt13(n):
    """Suspicious names with the first tag that holds."""
    name = F.col("p_name")
    tagged = n.table("part").select("p_partkey", F.when(name.ilike("%RING%"), "ring").when(name.ilike("small%"), "small").alias("tag"))
    return tagged.where("tag is not null")


# Joins


@query("jn13", f"SELECT r.id, r.version, CASE WHEN d.id IS NOT NULL THEN r.version ELSE m.latest END AS resolved, CASE WHEN d.id IS NOT NULL THEN 'exact' WHEN m.latest IS NOT NULL THEN 'latest' ELSE 'missing' END AS how FROM requests r LEFT JOIN datasets d ON d.id = r.id AND d.version = r.version LEFT JOIN (SELECT id, max(version) AS latest FROM datasets GROUP BY 1) m ON m.id = r.id", _V)
def jn13(n):
    """The requested version, else the latest."""
    return versions.exact_or_latest(_requests(n), _versions(n))


@query("jn15", ", existing AS (SELECT id, version, CASE WHEN id % 2 = 0 THEN 'draft' ELSE 'final' END AS state FROM datasets) SELECT r.id, r.version, CASE WHEN e.id IS NULL THEN 'insert' WHEN e.state = 'draft' THEN 'replace' ELSE 'reject' END AS action FROM requests r LEFT JOIN existing e ON e.id = r.id AND e.version = r.version", _V)
def jn15(n):
    """Incoming datasets against existing ones, by state."""
    state = F.when(F.col("id") % 2 == 0, "draft").otherwise("final")
    return versions.conflicts(_requests(n), _versions(n).withColumn("state", state), ["draft"])


@query("jn11", "SELECT r.id, r.version, EXISTS (SELECT 1 FROM datasets d WHERE d.id = r.id) AS id_exists, EXISTS (SELECT 1 FROM datasets d WHERE d.id = r.id AND d.version = r.version) AS version_exists FROM requests r", _V)
def jn11(n):
    """Whether a reference's target exists, in any and in its exact version."""
    d = _versions(n)
    ids, exact = d.groupBy("id").agg(F.lit(True).alias("i")), d.withColumn("v", F.lit(True))
    out = _requests(n).join(ids, "id", "left").join(exact, ["id", "version"], "left")
    return out.select("id", "version", F.col("i").isNotNull().alias("id_exists"), F.col("v").isNotNull().alias("version_exists"))


@query("jn07", "SELECT id, version FROM datasets d WHERE EXISTS (SELECT 1 FROM requests r WHERE r.id = d.id AND r.version = d.version)", _V)
def jn07(n):
    """Datasets that a list of (id, version) names."""
    return _versions(n).join(_requests(n), ["id", "version"], "left_semi")


@query("jn03", "SELECT x.l_orderkey AS k, count(*) AS pairs FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_quantity = y.l_quantity AND x.l_returnflag = 'R' AND y.l_returnflag <> 'R' GROUP BY 1", "")
def jn03(n):
    """Inputs (returned lines) and outputs of one order with the same amount."""
    t = n.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("string").alias("amount"), "l_returnflag")
    back = t.where("l_returnflag = 'R'").select("k", "amount")
    return back.join(t.where("l_returnflag <> 'R'").select("k", "amount"), ["k", "amount"]).groupBy("k").agg(F.count("*").alias("pairs"))


@query("jn08", "SELECT r.consumer, r.flow, coalesce(p.process_idx, -1) AS provider FROM residual r LEFT JOIN (SELECT flow, min(process_idx) AS process_idx FROM port GROUP BY 1) p USING (flow)")
def jn08(n):
    """Demands with their flow's first provider, -1 where there is none."""
    first = n.ports.groupBy("flow").agg(F.min("process_idx").alias("provider"))
    return n.residuals.select(F.col("process_idx").alias("consumer"), "flow").join(first, "flow", "left").fillna(-1, ["provider"]).select("consumer", "flow", "provider")


@query("jn22", ", e AS (SELECT process_idx, volume AS expected, CASE WHEN process_idx % 5 = 0 THEN volume + 1 ELSE volume END AS actual FROM process) SELECT process_idx, abs(expected - actual) <= 1e-9 AS ok FROM e WHERE process_idx % 7 <> 0 UNION ALL SELECT process_idx, false FROM e WHERE process_idx % 7 = 0")
def jn22(n):
    """Expected against actual values within a tolerance; a missing one fails."""
    expected = n.processes.select("process_idx", F.col("volume").alias("expected"))
    k = F.col("process_idx")
    actual = expected.where(k % 7 != 0).select("process_idx", F.when(k % 5 == 0, F.col("expected") + 1).otherwise(F.col("expected")).alias("actual"))
    return expected.join(actual, "process_idx", "left").select("process_idx", F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= 1e-9, F.lit(False)).alias("ok"))


# Aggregates


@query("ag12", "SELECT lang, max(octet_length(encode(coalesce(text, '')))) AS largest, count(*) FILTER (WHERE octet_length(encode(coalesce(text, ''))) > 4096) AS over_limit FROM documents GROUP BY 1", "")
def ag12(n):
    """Largest document and documents over a limit, by category."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return n.table("documents").groupBy("lang").agg(F.max(size).cast("long").alias("largest"), F.count_if(size > 4096).alias("over_limit"))


@query("ag14", "SELECT id, count(*) AS versions FROM datasets GROUP BY 1 HAVING count(*) > 1", _V)
def ag14(n):
    """Ids with several versions."""
    return _versions(n).groupBy("id").agg(F.count("*").alias("versions")).where("versions > 1")


@query("ag19", "SELECT n_name, count(s_suppkey) AS datasets FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1", "")
def ag19(n):
    """Counts for every table of a manifest, zero where there is nothing."""
    many = n.table("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("datasets"))
    return n.table("nation").select("n_nationkey", "n_name").join(many, "n_nationkey", "left").select("n_name", F.coalesce("datasets", F.lit(0)).alias("datasets"))


@query("ag26", "SELECT o_orderstatus AS area, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' WHEN o_totalprice > 300000 THEN 'pinned' ELSE 'kept' END AS reason, count(*) AS results, round(sum(o_totalprice), 2) AS size FROM orders GROUP BY 1, 2", "")
def ag26(n):
    """Retention by area and reason."""
    reason = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), "expired").when(F.col("o_totalprice") > 300000, "pinned").otherwise("kept")
    return n.table("orders").groupBy(F.col("o_orderstatus").alias("area"), reason.alias("reason")).agg(F.count("*").alias("results"), F.round(F.sum("o_totalprice"), 2).alias("size"))


# Windows and order


@query("wn01", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 1 AND o_orderdate < TIMESTAMP '1997-01-01' AND o_totalprice <= 300000", "")
def wn01(n):
    """Results to delete: not the newest of their key, expired and not pinned."""
    newest = W.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    old = n.table("orders").withColumn("rn", F.row_number().over(newest)).where("rn > 1")
    return old.where((F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")) & (F.col("o_totalprice") <= 300000)).select("o_orderkey")


@query("wn03", "SELECT o_custkey, last FROM (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ORDER BY last DESC, o_custkey LIMIT 8", "")
def wn03(n):
    """The latest of each key, of these the newest eight."""
    return n.table("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last")).orderBy(F.desc("last"), "o_custkey").limit(8)


@query("wn12", ", k AS (SELECT consumer, flow, volume, row_number() OVER (PARTITION BY consumer, flow ORDER BY volume DESC, provider) AS rn, lead(volume) OVER (PARTITION BY consumer, flow ORDER BY volume DESC, provider) AS next FROM candidate) SELECT consumer, flow, volume AS top1, next IS NULL OR volume >= 2 * next AS clear FROM k WHERE rn = 1")
def wn12(n):
    """The best score of each demand, and whether it is twice the next."""
    d = n.demands.withColumn("sign", -F.signum("residual")).join(linking.by_flow(n.everywhere), ["flow", "sign"])
    return d.select("consumer", "flow", "top1", linking.clear().alias("clear"))


@query("wn11", "SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier", "")
def wn11(n):
    """A process's place within its geographic anchor."""
    return n.table("supplier").select("s_nationkey", "s_suppkey", (F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("long").alias("place"))


@query("st06", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name))[1:8], ',') AS examples FROM part GROUP BY 1", "")
def st06(n):
    """The first eight distinct examples of each group."""
    return n.table("part").groupBy("p_brand").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_name")), 1, 8), ",").alias("examples"))


@query("so03", "SELECT id, version FROM datasets UNION SELECT id, version FROM requests", _V)
def so03(n):
    """The union of two sets of identities."""
    return _versions(n).unionByName(_requests(n)).dropDuplicates(["id", "version"])


@query("so05", "SELECT DISTINCT row_idx FROM b INTERSECT SELECT col_idx FROM c")
def so05(n):
    """Flows that have factors and that the biosphere holds."""
    return n.b.select("row_idx").intersect(n.c.select(F.col("col_idx").alias("row_idx")))


# Scalars


@query("sc02", "SELECT process_idx, flow, round(1 / abs(residual), 6) AS scale, sign(residual)::DOUBLE AS coefficient FROM (SELECT consumer AS process_idx, flow, residual FROM residual WHERE residual <> 0)")
def sc02(n):
    """References brought to +1 or -1."""
    c = F.col("coefficient")
    return n.residuals.where(c != 0).select("process_idx", "flow", F.round(fn.scale(c), 6).alias("scale"), F.signum(c).alias("coefficient"))


@query("sc21", "SELECT s_suppkey, s_name AS id, s_nationkey::VARCHAR AS version FROM supplier", "")
def sc21(n):
    """Roots written as id@version."""
    r = fn.root(F.concat_ws("@", "s_name", "s_nationkey"))
    return n.table("supplier").select("s_suppkey", r["id"].alias("id"), r["version"].alias("version"))


@query("sc23", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders", "")
def sc23(n):
    """Times as RFC 3339 in UTC."""
    return n.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("sc24", "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS expires FROM orders", "")
def sc24(n):
    """Expiry thirty days on."""
    return n.table("orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 30 days")).alias("expires"))


@query("sc25", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem", "")
def sc25(n):
    """Ratios, null for a whole of zero."""
    return n.table("lineitem").select("l_orderkey", "l_linenumber", F.round(fn.ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("ratio"))


# Graph and packages


@query("op07", "SELECT s_nationkey, sha256(string_agg(s_name || ':' || s_suppkey, '|' ORDER BY s_name || ':' || s_suppkey)) AS manifest FROM supplier GROUP BY 1", "")
def op07(n):
    """The hash of a sorted list of identities."""
    return n.table("supplier").groupBy("s_nationkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "s_name", "s_suppkey"))), "|"), 256).alias("manifest"))


# Documents: an order is a process, its lines are exchanges, line 1 is the reference, each third line has an allocation.

_X = "x AS (SELECT l_orderkey AS id, l_linenumber AS ex, l_partkey AS flow, l_returnflag, l_quantity AS amount, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS c FROM lineitem), g AS (SELECT id, count(*) FILTER (WHERE ex = 1) AS n_ref, max(c) FILTER (WHERE ex = 1) AS piv, bool_or(ex = 1) AND bool_or(ex = 2) AS two FROM x GROUP BY 1)"


def _documents(n: Network) -> DataFrame:
    line = F.col("l_linenumber")
    entries = F.array(*(F.struct(F.lit(t).alias(documents.TARGET), F.lit(v).alias(documents.SHARE)) for t, v in (("1", "25"), ("2", "75"))))
    exchange = F.struct(
        line.cast("string").alias("@dataSetInternalID"),
        F.when(F.col("l_returnflag") == "R", "Input").otherwise("Output").alias("exchangeDirection"),
        F.struct(F.col("l_partkey").cast("string").alias("@refObjectId"), F.lit("01.00.000").alias("@version")).alias("referenceToFlowDataSet"),
        F.col("l_quantity").alias("meanAmount"),
        F.when(line % 3 == 0, F.struct(entries.alias("allocation"))).alias("allocations"),
    )
    d = n.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(exchange).alias("exchange"))
    reference = F.struct(F.struct(F.lit("1").alias("referenceToReferenceFlow")).alias("quantitativeReference")).alias("processInformation")
    return d.select("id", F.lit("01.00.000").alias("version"), F.to_json(F.struct(F.struct(reference, F.struct("exchange").alias("exchanges")).alias("processDataSet"))).alias("json"))


@query("cp01", "SELECT id, ex::VARCHAR AS exchange_id, CASE WHEN l_returnflag = 'R' THEN 'Input' ELSE 'Output' END AS direction, flow::VARCHAR AS flow_id, amount FROM x", _X)
def cp01(n):
    """Exchanges parsed from documents."""
    return documents.exchanges(_documents(n)).select("id", "exchange_id", "direction", "flow_id", "amount")


@query("cp02", "SELECT id, CASE WHEN n_ref = 0 THEN 'missing' WHEN n_ref > 1 THEN 'several' WHEN piv = 0 THEN 'invalid' ELSE 'ok' END AS reference, CASE WHEN n_ref = 1 AND piv <> 0 THEN piv END AS pivot_amount FROM g", _X)
def cp02(n):
    """Each process's reference and its pivot."""
    k = F.col("n_references")
    status = F.when(k == 0, "missing").when(k > 1, "several").when(F.col("pivot").isNull(), "invalid").otherwise("ok")
    return documents.processes(_documents(n)).select("id", status.alias("reference"), F.col("pivot").alias("pivot_amount"))


@query("cp03", "SELECT CASE WHEN ex % 3 <> 0 THEN 'undeclared' WHEN two THEN 'explicit' ELSE 'error' END AS kind, count(*) AS exchanges, sum(CASE WHEN ex % 3 <> 0 THEN 1.0::DOUBLE WHEN two THEN 0.25 END) AS shares FROM x JOIN g USING (id) GROUP BY 1", _X)
def cp03(n):
    """Allocations by kind and the sum of the shares selected."""
    return documents.exchanges(_documents(n)).groupBy(F.col("allocation_kind").alias("kind")).agg(F.count("*").alias("exchanges"), F.sum("share").alias("shares"))


@query("cp04", "SELECT id, ex::VARCHAR AS exchange_id, flow::VARCHAR AS flow_id, round(c / abs(piv) * CASE WHEN ex % 3 = 0 THEN 0.25::DOUBLE ELSE 1 END, 6) AS residual FROM x JOIN g USING (id) WHERE ex <> 1 AND n_ref = 1 AND piv <> 0 AND (ex % 3 <> 0 OR two)", _X)
def cp04(n):
    """Residual coefficients of documents."""
    r = documents.residuals(documents.exchanges(_documents(n)))
    return r.select("id", "exchange_id", "flow_id", F.round("residual", 6).alias("residual"))


