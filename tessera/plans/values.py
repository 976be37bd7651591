"""Queries on single values: amounts, shares, versions, texts, codes, hashes, and orders by them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import graph, layout
from ..sources import documents, tiles
from ..sources.tables import numbered, shared_folder, written
from .registry import query



def _k():
    return F.col("l_linenumber")


def _sql(values) -> str:
    """A list of texts in SQL."""
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in values) + "]"


def _of(values, key):
    """The text of a row, by its key in turn."""
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


_LINE = "SELECT l_orderkey, l_linenumber, "


@query("sc04", _LINE + "CASE l_linenumber % 4 WHEN 1 THEN l_quantity WHEN 2 THEN l_tax WHEN 3 THEN l_discount END AS amount FROM lineitem", "")
def sc04(n):
    """The amount under the first key that is there, resulting before mean before mean value, even if its value is null."""
    some = lambda when, c: F.when(_k() % 4 == when, F.col(c).cast("string"))
    pairs = F.array(F.struct(F.lit("resultingAmount").alias("k"), some(1, "l_quantity").alias("v")), F.struct(F.lit("meanAmount").alias("k"), some(2, "l_tax").alias("v")), F.struct(F.lit("meanValue").alias("k"), F.col("l_discount").cast("string").alias("v")))
    there = F.filter(pairs, lambda p: p["v"].isNotNull() | ((_k() % 4 == 0) & (p["k"] == "resultingAmount")))
    return n.table("lineitem").select("l_orderkey", "l_linenumber", documents.amount(F.map_from_entries(there)).alias("amount"))


@query("sc05", _LINE + "CASE l_linenumber % 4 WHEN 0 THEN l_discount WHEN 1 THEN 1.0 WHEN 2 THEN NULL ELSE 0.25 END AS fraction, l_linenumber % 4 IN (1, 2) AS is_full FROM lineitem", "")
def sc05(n):
    """Percentages as fractions, which no sign may follow, and whether they are the whole, which 100% is by an old custom."""
    text = F.when(_k() % 4 == 0, F.round(F.col("l_discount") * 100, 4).cast("string")).when(_k() % 4 == 1, "100").when(_k() % 4 == 2, "100%").otherwise(" 25 ")
    return n.table("lineitem").select("l_orderkey", "l_linenumber", F.round(fn.fraction(text), 6).alias("fraction"), fn.full_share(text).alias("is_full"))


_BOUNDARIES = ("closed", "open", "cutoff", "Closed", "", "sealed")


@query("sc06", f"SELECT o_orderstatus, t, CASE WHEN t IN ('closed', 'open', 'cutoff') THEN t END AS policy, count(*) AS orders FROM (SELECT o_orderstatus, {_sql(_BOUNDARIES)}[o_custkey % 6 + 1] AS t FROM orders) GROUP BY ALL", "")
def sc06(n):
    """Boundary policies that orders name; other texts are none."""
    t = n.table("orders").select("o_orderstatus", _of(_BOUNDARIES, F.col("o_custkey")).alias("t"))
    return t.groupBy("o_orderstatus", "t", fn.boundary(F.col("t")).alias("policy")).agg(F.count("*").alias("orders"))


@query("sc07", _LINE + "(l_quantity * 1000)::BIGINT AS amount FROM lineitem", "")
def sc07(n):
    """Amounts written with commas, blanks and no-break spaces."""
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.when(_k() % 3 == 0, F.concat(F.lit(" "), q, F.lit(",000"))).when(_k() % 3 == 1, F.concat(q, F.lit(" 000 "))).otherwise(F.concat(q, F.lit("000")))
    return n.table("lineitem").select("l_orderkey", "l_linenumber", fn.number(fn.clean_amount(text)).cast("long").alias("amount"))


@query("sc08", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE (props->>'$.k') END AS found FROM events", "")
def sc08(n):
    """The first of several paths in a JSON text that holds a value."""
    json = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("@location")).alias("geography")))).otherwise(F.col("props"))
    return n.table("events").select("event_id", documents.first_path(json, "$.geography['@location']", "$.missing[0]", "$.k").alias("found"))


@query("sc09", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand WHEN 3 THEN p_name END AS name FROM part", "")
def sc09(n):
    """Texts in several languages and forms: Chinese, else English, else the first; an object's text; plain ones; blanks are none."""
    text = lambda lang, c: F.struct(F.lit(lang).alias("@xml:lang"), F.col(c).alias("#text"))
    k = F.col("p_partkey") % 5
    json = F.when(k == 0, F.to_json(F.array(text("en", "p_type"), text("zh", "p_name")))).when(k == 1, F.to_json(F.array(text("de", "p_name"), text("en", "p_type")))).when(k == 2, F.to_json(text("fr", "p_brand"))).when(k == 3, F.concat(F.lit(" "), "p_name")).otherwise("  ")
    return n.table("part").select("p_partkey", fn.localized(json).alias("name"))


@query("sc10", _LINE + "CASE l_returnflag WHEN 'R' THEN 'Input' WHEN 'A' THEN 'Output' END AS gate, CASE l_returnflag WHEN 'R' THEN 'Input' WHEN 'A' THEN 'Output' ELSE CASE WHEN l_linenumber = 1 THEN 'Output' ELSE 'Input' END END AS graph FROM lineitem", "")
def sc10(n):
    """Directions by the gate's spellings, where an unknown one is null, and by the graph's, where it depends on the reference."""
    flag = F.col("l_returnflag")
    gate = F.when(flag == "R", " IN").when(flag == "A", "output ").otherwise("none")
    graph_ = F.when(flag == "R", "Process input").when(flag == "A", "OUTPUT flow")
    return n.table("lineitem").select("l_orderkey", "l_linenumber", fn.direction(gate).alias("gate"), fn.flow_direction(graph_, _k() == 1).alias("graph"))


@query("sc11", "SELECT p_partkey, lpad((p_partkey % 20)::VARCHAR, 2, '0') || '.' || lpad((p_partkey % 7)::VARCHAR, 2, '0') || '.' || lpad((p_partkey % 300)::VARCHAR, 3, '0') AS version, CASE WHEN [p_partkey % 20, p_partkey % 7, p_partkey % 300] < [10, 3, p_size] THEN -1 WHEN [p_partkey % 20, p_partkey % 7, p_partkey % 300] > [10, 3, p_size] THEN 1 ELSE 0 END AS compared FROM part", "")
def sc11(n):
    """Normalised versions, and how they compare with another by numbers."""
    k = F.col("p_partkey")
    v = F.concat_ws(".", k % 20, k % 7, k % 300)
    return n.table("part").select("p_partkey", fn.normal_version(v).alias("version"), fn.compare_versions(v, F.concat(F.lit("10.03."), F.col("p_size").cast("string"))).alias("compared"))


_DATASETS = {"process data set": "processes", "Flow": "flows", "flow  property data set": "flowproperties", "lifeCycleModel data set": "lifecyclemodels", "LCIA method": "lciamethods", "unit group": "unitgroups", "other external file": None}


@query("sc12", f"SELECT p_brand, {_sql(_DATASETS.values())}[p_partkey % 7 + 1] AS category, count(*) AS parts FROM part GROUP BY ALL", "")
def sc12(n):
    """Categories of the dataset types that parts are declared as, by brand."""
    kind = _of(tuple(_DATASETS), F.col("p_partkey"))
    return n.table("part").groupBy("p_brand", fn.category(kind).alias("category")).agg(F.count("*").alias("parts"))


_ROLES = (
    ("processes", "flows", "$.processDataSet.exchanges.exchange[0].referenceToFlowDataSet", "exchange_flow", "validate_exchange_axis"),
    ("lciamethods", "flows", "$.LCIAMethodDataSet.characterisationFactors.factor[1].referenceToFlowDataSet", "required_support", "fetch_required_support"),
    ("flows", "flows", "$.flowDataSet.common:referenceToPrecedingDataSetVersion", "lineage", "record_evidence"),
    ("processes", "processes", "$.processDataSet.technology.referenceToIncludedProcesses", "model_composition", "record_evidence"),
    ("lifecyclemodels", "processes", "$.model.instances.referenceToProcess", "model_composition", "record_evidence"),
    ("processes", "contacts", "$.processDataSet.common:referenceToOwnershipOfDataSet", "administrative_support", "fetch_optional_support"),
    ("processes", "processes", "$.processDataSet.provider.referenceToProcess", "provider_process", "validate_provider_invariant"),
    ("flows", "flowproperties", "$.flowDataSet.flowProperties.referenceToFlowPropertyDataSet", "required_support", "fetch_required_support"),
    ("sources", "flows", "$.sourceDataSet.referenceToSomething", "unknown", None),
)


@query("sc13", f"SELECT l_returnflag, role, action, count(*) AS lines FROM (SELECT l_returnflag, {_sql(r[3] for r in _ROLES)}[(l_orderkey + l_linenumber) % {len(_ROLES)} + 1] AS role, {_sql(r[4] for r in _ROLES)}[(l_orderkey + l_linenumber) % {len(_ROLES)} + 1] AS action FROM lineitem) GROUP BY ALL", "")
def sc13(n):
    """What the references that lines make are for, and what a calculation does with them."""
    refs = F.get(F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(("source", "target", "path"), r, strict=False))) for r in _ROLES)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_ROLES)).cast("int"))
    role = n.table("lineitem").select("l_returnflag", refs.alias("r")).withColumn("role", fn.reference_role(F.col("r.source"), F.col("r.target"), F.col("r.path")))
    return role.groupBy("l_returnflag", "role", fn.reference_action(F.col("role"), "review_submit").alias("action")).agg(F.count("*").alias("lines"))


@query("sc14", "SELECT s_suppkey, s_suppkey % 3 = 0 AS is_id, s_suppkey % 4 IN (0, 1) AS is_version FROM supplier", "")
def sc14(n):
    """Ids and versions by their forms."""
    k = F.col("s_suppkey")
    id_ = F.when(k % 3 == 0, fn.uuid(1, k)).when(k % 3 == 1, F.upper(F.concat(F.lit("a"), F.substring(fn.uuid(1, k), 2, 40)))).otherwise(F.substring(fn.uuid(1, k), 1, 30))
    version = F.when(k % 4 == 0, "01.02.003").when(k % 4 == 1, "01.02").when(k % 4 == 2, "1.2.3")
    return n.table("supplier").select("s_suppkey", fn.is_uuid(id_).alias("is_id"), fn.is_version(version).alias("is_version"))


_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("sc15", f"SELECT DISTINCT p_type, p_brand, {_SLUG.format('p_type')} AS id1, p_type AS label1, {_SLUG.format('label3')} AS id3, label3 FROM (SELECT p_type, p_brand, p_type || ' / ' || p_brand || ' / ' || 'S' || (p_size % 2) AS label3 FROM part)", "")
def sc15(n):
    """Clusters of categories by the first level and by three, with ids made from their labels."""
    levels = F.array("p_type", "p_brand", F.concat(F.lit("S"), (F.col("p_size") % 2).cast("string")), F.lit("more"))
    one, three = fn.cluster(levels, 1), fn.cluster(levels, 3)
    return n.table("part").select("p_type", "p_brand", one["id"].alias("id1"), one["label"].alias("label1"), three["id"].alias("id3"), three["label"].alias("label3")).distinct()


@query("sc16", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'kg' || p_size END AS unit FROM part", "")
def sc16(n):
    """Units named second in a text's first parentheses."""
    text = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" (mass, kg"), F.col("p_size").cast("string"), F.lit(" , x) (a, b)"))).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" (mass)"))).otherwise(F.col("p_name"))
    return n.table("part").select("p_partkey", fn.unit_hint(text).alias("unit"))


_PLACES = ("CN", "CN-BJ", "cn-xx", "uk", "DE-BY", "RER", "GLO", "FR", "", None)


@query("sc17", f"SELECT country, province, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM (SELECT ['CN', 'CN', 'CN', 'GB', 'DE', NULL, NULL, NULL, NULL, NULL][s_suppkey % 10 + 1] AS country, CASE WHEN s_suppkey % 10 = 1 THEN 'BJ' END AS province, s_acctbal FROM supplier) GROUP BY ALL", "")
def sc17(n):
    """Suppliers by the country and province of their places that a map has; France is not on this one."""
    s = n.table("supplier").select("s_acctbal", _of(_PLACES, F.col("s_suppkey")).alias("place"))
    return s.groupBy(fn.region_key(F.col("place"), ["DE", "GB"]).alias("country"), fn.province(F.col("place"), ["BJ", "SH"]).alias("province")).agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("sc18", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN sha256('{"a":' || s_nationkey || ',"name":"' || s_name || '","z":[' || s_suppkey || ',null]}') END AS digest FROM supplier""", "")
def sc18(n):
    """Hashes of JSON with sorted keys; a value that is not finite has none."""
    value = F.when(F.col("s_suppkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    rows = n.table("supplier").select("s_suppkey", documents.canonical({"z": F.concat(F.lit("["), F.col("s_suppkey").cast("string"), F.lit(",null]")), "name": documents.quoted(F.col("s_name")), "a": F.col("s_nationkey").cast("string")}).alias("json"), value.alias("v"))
    return rows.select("s_suppkey", F.when(documents.finite(F.col("v")), F.sha2("json", 256)).alias("digest"))


@query("sc19", "SELECT p_partkey, 'process-link:world:' || substr(sha256('world' || chr(0) || p_brand || chr(0) || p_partkey || chr(0) || p_size), 1, 20) AS link FROM part", "")
def sc19(n):
    """Ids of links over scope, flow and both ends."""
    text = lambda c: F.col(c).cast("string")
    return n.table("part").select("p_partkey", fn.link_id("world", F.col("p_brand"), text("p_partkey"), text("p_size")).alias("link"))


@query("sc20", "SELECT least(greatest(l_linenumber - 1, 1), 8)::INT AS depth, least(greatest(l_quantity::INT - 5, 1), 20)::INT AS k, CASE WHEN l_discount >= 0.05 THEN least(l_discount * 20, 1.0) ELSE 0.01 END::DOUBLE AS cutoff, least(greatest(l_partkey * 3, 10), 2000)::INT AS nodes, count(*) AS requests FROM lineitem GROUP BY ALL", "")
def sc20(n):
    """Bounds of path searches that lines ask for, brought into their ranges."""
    share = F.when(F.col("l_discount") >= 0.05, F.col("l_discount") * 20).otherwise(-F.col("l_discount") - 1)
    bounds = graph.bounded(F.col("l_linenumber") - 1, F.col("l_quantity").cast("int") - 5, share, F.col("l_partkey") * 3)
    return n.table("lineitem").groupBy(*(c.alias(name) for name, c in bounds.items())).agg(F.count("*").alias("requests"))


def _unit_sql(salt: int) -> str:
    """The hash of names of eight or nine letters, letter by letter."""

    def chain(n: int) -> str:
        h = str((0xCBF29CE484222325 ^ salt) & 0xFFFFFFFF) + "::BIGINT"
        for i in range(1, n + 1):
            h = f"(xor({h}, ascii(substr(n_name, {i}, 1))::BIGINT) * 435 % 4294967296)"
        return h

    return f"((CASE WHEN length(n_name) = 8 THEN {chain(8)} ELSE {chain(9)} END) / 4294967295.0::DOUBLE)"


@query("sc22", f"SELECT n_name, round({_unit_sql(17)}, 6) AS unit, round(cos({_unit_sql(5)} * 2 * pi()) * sqrt({_unit_sql(6)}) * 684, 4) AS x FROM nation", "")
def sc22(n):
    """Numbers from hashes of names, and places in a disc by them."""
    u = lambda salt: fn.hash_unit(F.col("n_name"), salt)
    x = F.cos(u(5) * 2 * math.pi) * F.sqrt(u(6)) * 684
    return n.table("nation").select("n_name", F.round(u(17), 6).alias("unit"), F.round(x, 4).alias("x"))


_BITS = " + ".join(f"((p_size >> {i}) & 1)::BIGINT * {1 << (2 * i)} + (((p_partkey % 1000) >> {i}) & 1) * {1 << (2 * i + 1)}" for i in range(10))


@query("st07", f"SELECT p_partkey, {_BITS} AS place FROM part", "")
def st07(n):
    """Places in the plane by a key that keeps close ones close."""
    return n.table("part").select("p_partkey", fn.morton(F.col("p_size").cast("long"), F.col("p_partkey") % 1000).alias("place"))


GOLDEN_ANGLE = 2.3999631  # fixed value


@query("gr16", f"SELECT n_name, round(cos(t) * sqrt(1 - z * z) * 310, 3) AS x, round(sin(t) * sqrt(1 - z * z) * 310, 3) AS y, round(z * 310, 3) AS z FROM (SELECT n_name, 1 - 2 * (i + 0.5::DOUBLE) / k AS z, i * {GOLDEN_ANGLE}::DOUBLE + {_unit_sql(17)} * 0.12::DOUBLE AS t FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS k FROM nation))", "")
def gr16(n):
    """Nodes on a sphere, turn by turn of the golden angle."""
    rows = numbered(n.table("nation").select("n_name"), ["n_name"], "i")
    count = F.broadcast(rows.agg(F.count("*").alias("k")))
    z, t = F.col("z0"), F.col("t0")
    rows = rows.crossJoin(count).withColumn("z0", 1 - 2 * (F.col("i") + 0.5) / F.col("k")).withColumn("t0", F.col("i") * GOLDEN_ANGLE + fn.hash_unit(F.col("n_name"), 17) * 0.12)
    ring = F.sqrt(1 - z * z) * 310
    return rows.select("n_name", F.round(F.cos(t) * ring, 3).alias("x"), F.round(F.sin(t) * ring, 3).alias("y"), F.round(z * 310, 3).alias("z"))


@query("st07_viewport", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 950 AND 980", "")
def st07_viewport(n):
    """Parts in a window of size and price, from files along a space-filling curve of which only those are opened that the window touches."""
    points = n.table("part").select("p_partkey", "p_size", "p_retailprice")
    path = shared_folder(n.spark)
    tiles.write(points, path, "p_size", "p_retailprice")
    return tiles.view(n.spark, path, points.schema, 10, 20, 950, 980, "p_size", "p_retailprice")


@query("gr16_topology", "", "")
def gr16_topology(n):
    """Suppliers and the parts that they deliver laid out by who delivers what, in all rounds of the layout; a test holds it against a plain version."""
    pairs = written(n.table("lineitem").select("l_suppkey", "l_partkey").distinct())
    ends = {"process": F.concat(F.lit("p"), "l_suppkey"), "flow": F.concat(F.lit("f"), "l_partkey")}
    degree = lambda kind, key: pairs.groupBy(key).agg(F.count("*").alias("degree")).select(ends[kind].alias("id"), F.lit(kind).alias("kind"), "degree")
    nodes = degree("process", "l_suppkey").unionByName(degree("flow", "l_partkey"))
    at = layout.expanded(nodes, pairs.select(*(end.alias(kind) for kind, end in ends.items())))
    return at.select("id", *(F.round(c, 2).alias(c) for c in "xyz"))


@query("wn10", "SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS idx FROM supplier", "")
def wn10(n):
    """The processes' axis: places in the order of their names, numbered part by part."""
    return numbered(n.table("supplier").select("s_name"), ["s_name"]).select("s_name", "idx")


@query("gr17", "SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code, count(*) AS uses FROM part GROUP BY 1", "")
def gr17(n):
    """A dictionary of repeated texts: each with its code and how often it is used."""
    uses = n.table("part").groupBy("p_type").agg(F.count("*").alias("uses"))
    return numbered(uses, ["p_type"], "code").select("p_type", "code", "uses")


@query("st02", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, l_partkey, l_suppkey, l_linenumber) AS place FROM lineitem", "")
def st02(n):
    """Exchanges of each process in the order in which artifacts hold them."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linestatus", "l_partkey", "l_suppkey", "l_linenumber")
    return n.table("lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).cast("long").alias("place"))


@query("ag28", "SELECT kind, count(*) AS vectors FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'sum' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'unknown_target' ELSE 'out_of_range' END AS kind FROM orders) GROUP BY 1", "")
def ag28(n):
    """Allocation vectors: whole, of another sum, with a target twice, with one that is unknown, with a share out of range."""
    k = F.col("o_orderkey") % 5
    entry = lambda target, share: F.struct(F.lit(target).alias("target"), F.lit(share).alias("share"))
    v = F.when(k == 0, F.array(entry("1", "40"), entry("2", "60"))).when(k == 1, F.array(entry("1", "40"), entry("2", "50"))).when(k == 2, F.array(entry("1", "40"), entry("1", "60"))).when(k == 3, F.array(entry("1", "40"), entry("9", "60"))).otherwise(F.array(entry("1", "140"), entry("2", "-40")))
    known = F.array(F.lit("1"), F.lit("2"), F.lit("3"))
    return n.table("orders").groupBy(documents.vector_fault(v, known).alias("kind")).agg(F.count("*").alias("vectors"))


@query("flt07", "SELECT l_linenumber % 3 = 0 AS allocated, count(*) AS exchanges, count(*) FILTER (WHERE l_linenumber % 6 <> 0) AS kept FROM lineitem GROUP BY 1", "")
def flt07(n):
    """Exchanges whose share of the reference is zero are dropped; every second share here is."""
    share = F.when(_k() % 6 == 0, 0.0).when(_k() % 3 == 0, 0.5).otherwise(1.0)
    rows = n.table("lineitem").select((_k() % 3 == 0).alias("allocated"), share.alias("share"))
    kept = documents.allocated(rows).groupBy("allocated").agg(F.count("*").alias("kept"))
    return rows.groupBy("allocated").agg(F.count("*").alias("exchanges")).join(kept, "allocated", "left").fillna(0, ["kept"])
