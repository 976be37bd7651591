"""Queries on compiling: routing of demands, its counters and reports, matrices, readiness and gates.

Where the derived network has no such thing, it is stood in for: a process's model is its number modulo 7, its version
its number modulo 3, its state 100 or 0; some processes lie in no country or everywhere, and a third of the brands name
the country that their demands have to be met from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import gates, linear, linking
from ..sources.network import Network
from ..sources.tables import written
from .registry import NETWORK, SOLVED, query
from .solving import DEMANDS, _model

_BRAND = "split_part(flow, '#', 2)::INT"


def _brand() -> Column:
    return F.split_part("flow", F.lit("#"), F.lit(2)).cast("int")


def _place(tier: int, place: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), place.cast("string").alias("place"))


# Routing


@query("cp05", ", q AS (SELECT process_idx AS provider, flow, CASE WHEN process_idx % 9 = 0 THEN -1.0 ELSE 1.0 END AS pv FROM port) SELECT CASE WHEN sign(pv) = -sign(residual) THEN 'accepted_opposite_sign_reference' ELSE 'rejected_same_sign_reference' END AS eligibility, count(*) AS candidates, count(DISTINCT provider) AS providers FROM residual JOIN q USING (flow) GROUP BY 1")
def cp05(n):
    """Ports of each demand's flow by whether their sign lets them balance it; each ninth process is a waste treatment."""
    q = n.ports.select(F.col("process_idx").alias("provider"), "flow", F.when(F.col("process_idx") % 9 == 0, -1.0).otherwise(1.0).alias("pivot"))
    demand = n.residuals.groupBy("flow", F.signum("coefficient").alias("sign")).agg(F.count("*").alias("k"))
    kind = F.when(F.signum("pivot") == -F.col("sign"), "accepted_opposite_sign_reference").otherwise("rejected_same_sign_reference")
    return demand.join(q, "flow").groupBy(kind.alias("eligibility")).agg(F.sum("k").alias("candidates"), F.countDistinct("provider").alias("providers"))


@query("flt08", "SELECT sign(residual)::DOUBLE AS sign, count(*) AS demands, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM port p WHERE p.flow = r.flow)) AS eligible FROM (SELECT consumer, flow, CASE WHEN consumer % 9 = 0 THEN -residual ELSE residual END AS residual FROM residual) r WHERE residual < 0 GROUP BY 1")
def flt08(n):
    """Demands whose sign is the opposite of some port's of their flow."""
    c = F.when(F.col("process_idx") % 9 == 0, -F.col("coefficient")).otherwise(F.col("coefficient"))
    d = n.residuals.select("flow", F.signum(c).alias("sign")).where("sign < 0")
    there = n.ports.select("flow", (-F.signum("coefficient")).alias("sign")).distinct().withColumn("on", F.lit(True))
    return d.join(there, ["flow", "sign"], "left").groupBy("sign").agg(F.count("*").alias("demands"), F.count("on").alias("eligible"))


_MODEL = ", o AS (SELECT *, provider % 7 = consumer % 7 AS own FROM candidate), p AS (SELECT *, bool_or(own) OVER (PARTITION BY consumer, flow) AS any_own FROM o), q AS (SELECT *, min(tier) OVER (PARTITION BY consumer, flow) AS best FROM p WHERE own OR NOT any_own)"


def _with_models(n: Network, rows: DataFrame, who: str) -> DataFrame:
    """Places of the default rule: those of the own model come before those of all, nation before region before everywhere."""
    near = n.processes.select(F.col("process_idx").alias(who), "nation", "region", "volume", "volume_fallback")
    model = lambda c: F.concat_ws("|", F.col(who) % 7, c)
    scopes = [F.col("nation"), F.col("region"), F.lit("*")]
    places = [_place(i + 1, model(c)) for i, c in enumerate(scopes)] + [_place(i + 11, c) for i, c in enumerate(scopes)]
    return rows.join(near, who).withColumn("places", F.array(*places)).drop("nation", "region")


@query("cp07", _MODEL + " SELECT consumer, flow, provider, tier, round(volume / sum(volume) OVER (PARTITION BY consumer, flow), 6) AS weight FROM q WHERE tier = best")
def cp07(n):
    """split_by_process_volume as it is documented: the own model first, then the nearest tier, then shares of volume."""
    ports = n.ports.select(F.col("process_idx").alias("provider"), "flow", F.col("coefficient").alias("pivot"))
    offers = linking.offers(_with_models(n, ports, "provider"))
    demands = n.residuals.select(F.col("process_idx").alias("consumer"), "flow", F.col("coefficient").alias("residual"))
    near = linking.nearest(_with_models(n, demands, "consumer").drop("volume", "volume_fallback"), offers)
    return linking.routed(near, offers, 6).select("consumer", "flow", "provider", (F.col("tier") % 10).alias("tier"), "weight")


_GEO = f""", loc AS (SELECT process_idx, region, CASE WHEN process_idx % 10 = 0 THEN 'GLO' WHEN process_idx % 17 = 0 THEN NULL ELSE 'C' || lpad(nation::VARCHAR, 2, '0') || '-' || (process_idx % 4) END AS location FROM process),
country AS (SELECT 'C' || lpad(n_nationkey::VARCHAR, 2, '0') AS country, n_regionkey AS region FROM nation),
demand AS (SELECT consumer, flow, CASE WHEN {_BRAND} % 3 = 0 THEN 'C' || lpad(({_BRAND} % 25)::VARCHAR, 2, '0') END AS exchange_location, location AS own FROM residual JOIN loc ON process_idx = consumer),
anchored AS (SELECT *, coalesce(exchange_location, own) AS anchor, CASE WHEN exchange_location IS NOT NULL THEN 'exchange_location' WHEN own IS NOT NULL THEN 'consumer_process_location' ELSE 'unspecified' END AS source FROM demand),
ranked5 AS (SELECT d.consumer, d.flow, d.source, min(CASE WHEN l.process_idx IS NULL THEN NULL WHEN anchor LIKE '%-%' AND l.location = anchor THEN 1 WHEN l.location LIKE 'C%' AND split_part(l.location, '-', 1) = split_part(anchor, '-', 1) THEN 2 WHEN l.location LIKE 'C%' AND a.region = l.region THEN 3 WHEN l.location = 'GLO' THEN 4 ELSE 5 END) AS tier
  FROM anchored d LEFT JOIN country a ON a.country = split_part(anchor, '-', 1) LEFT JOIN port USING (flow) LEFT JOIN loc l ON l.process_idx = port.process_idx GROUP BY 1, 2, 3)"""
TIERS = ("local_subnational", "same_country", "same_region", "global", "other")


def _country(number: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(number.cast("string"), 2, "0"))


def _located(n: Network) -> DataFrame:
    k = F.col("process_idx")
    location = F.when(k % 10 == 0, "GLO").when(k % 17 == 0, None).otherwise(F.concat_ws("-", _country(F.col("nation")), k % 4))
    return n.processes.select("process_idx", "region", "volume", "volume_fallback", location.alias("location"))


def _five(location: Column, region: Column) -> Column:
    """The places of a location, nearest first: itself, its country, its region, the world, anywhere."""
    land = F.when(location.startswith("C"), F.split_part(location, F.lit("-"), F.lit(1)))
    places = [_place(1, F.when(location.contains("-"), location)), _place(2, land), _place(3, F.when(land.isNotNull(), region)), _place(4, F.when((location == "GLO") | location.isNull() | land.isNotNull(), F.lit("GLO"))), _place(5, F.lit("*"))]
    return F.filter(F.array(*places), lambda p: p["place"].isNotNull())


def _anchored(n: Network) -> tuple[DataFrame, DataFrame]:
    """Demands with the place that they have to be met from, where it comes from and the tier that meets them; offers."""
    at = _located(n)
    port_places = F.filter(_five(F.col("location"), F.col("region")), lambda p: (p["tier"] != 4) | F.coalesce(F.col("location") == "GLO", F.lit(False)))
    ports = n.ports.select("process_idx", "flow", F.col("coefficient").alias("pivot")).join(at, "process_idx")
    offers = linking.offers(ports.select(F.col("process_idx").alias("provider"), "flow", "pivot", "volume", "volume_fallback", port_places.alias("places")))
    stated = F.when(_brand() % 3 == 0, _country(_brand() % 25))
    d = n.residuals.select("process_idx", "flow", F.col("coefficient").alias("residual"), stated.alias("stated")).join(at.select("process_idx", F.col("location").alias("own")), "process_idx")
    source = F.when(F.col("stated").isNotNull(), "exchange_location").when(F.col("own").isNotNull(), "consumer_process_location").otherwise("unspecified")
    d = d.withColumn("anchor", F.coalesce("stated", "own")).withColumn("source", source)
    regions = n.table("nation").select(_country(F.col("n_nationkey")).alias("land"), F.col("n_regionkey").alias("anchor_region"))
    d = d.join(F.broadcast(regions), F.split_part("anchor", F.lit("-"), F.lit(1)) == F.col("land"), "left")
    d = d.select(F.col("process_idx").alias("consumer"), "flow", "residual", "source", "anchor", _five(F.col("anchor"), F.col("anchor_region")).alias("places"))
    return linking.nearest(d, offers), offers


@query("cp12", _GEO + " SELECT source, count(*) AS demands, count(exchange_location) AS stated FROM anchored GROUP BY 1")
def cp12(n):
    """Where the supply region comes from: the exchange, else the consumer, else nowhere."""
    near, _ = _anchored(n)
    return near.groupBy("source").agg(F.count("*").alias("demands"), F.count_if(F.col("source") == "exchange_location").alias("stated"))


@query("cp13", _GEO + " SELECT source, CASE tier WHEN 1 THEN 'local_subnational' WHEN 2 THEN 'same_country' WHEN 3 THEN 'same_region' WHEN 4 THEN 'global' WHEN 5 THEN 'other' ELSE 'none' END AS tier, count(*) AS demands FROM ranked5 GROUP BY 1, 2")
def cp13(n):
    """Demands by the first of the five tiers that has a port, seen from the supply region."""
    near, _ = _anchored(n)
    name = F.when(F.col("tier").isNull(), "none").otherwise(F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier")))
    return near.groupBy("source", name.alias("tier")).agg(F.count("*").alias("demands"))


# Decisions by rule, their counters and reports

RULES = ("split_by_process_volume", "strict_unique_provider", "best_provider_strict", "split_by_evidence_hybrid")
_RULED = ", t AS (SELECT flow, max(volume) AS top1, CASE WHEN count(*) > 1 THEN list_sort(list(volume), 'DESC')[2] END AS top2, count(*) AS k, count(*) FILTER (WHERE NOT volume_fallback) AS valid FROM port JOIN process USING (process_idx) GROUP BY 1), bt AS (SELECT consumer, flow, min(tier) AS tier FROM candidate GROUP BY 1, 2), r AS (SELECT unnest([" + ", ".join(map(repr, RULES)) + "]) AS rule), " + """z AS (SELECT rule, consumer, flow, coalesce(k, 0) AS k, tier, coalesce(valid, 0) AS valid,
CASE WHEN k IS NULL THEN 'no_provider' WHEN k = 1 THEN 'unique_provider' WHEN rule = 'strict_unique_provider' OR (rule = 'best_provider_strict' AND top1 < 2 * top2) THEN 'multi_unresolved' ELSE 'multi_resolved' END AS kind,
CASE WHEN k = 1 THEN 'unique_provider' WHEN rule = 'split_by_process_volume' AND k > 1 THEN rule WHEN rule = 'best_provider_strict' AND top1 >= 2 * top2 THEN rule WHEN rule = 'split_by_evidence_hybrid' AND k > 1 THEN CASE WHEN valid > 0 THEN 'split_by_evidence' ELSE 'split_equal_fallback' END END AS strategy,
CASE WHEN k IS NULL THEN 'no_provider_candidates' WHEN k > 1 AND rule = 'strict_unique_provider' THEN 'rule_requires_unique_provider' WHEN k > 1 AND rule = 'best_provider_strict' AND top1 < 2 * top2 THEN 'top1_top2_ratio_too_close' END AS reason
FROM residual CROSS JOIN r LEFT JOIN t USING (flow) LEFT JOIN bt USING (consumer, flow)) """


def ruled(n: Network, rules: tuple[str, ...] = RULES) -> DataFrame:
    """Each demand under each rule: kind, strategy, failure reason. Ports are ranked by flow, before demands meet them."""
    top = linking.by_flow(n.everywhere).select("flow", "sign", "top1", "top2")
    d = n.nearest.select("consumer", "flow", "sign", "tier", F.col("n_candidates").alias("k"), F.col("n_valid").alias("valid")).join(top, ["flow", "sign"], "left")
    d = d.withColumn("rule", F.explode(F.array(*map(F.lit, rules))))
    k, rule, close = F.col("k"), F.col("rule"), F.col("top1") < 2 * F.col("top2")
    many, strict, best = k > 1, rule == "strict_unique_provider", rule == "best_provider_strict"
    open_ = many & (strict | (best & close))
    kind = F.when(k == 0, "no_provider").when(k == 1, "unique_provider").when(open_, "multi_unresolved").otherwise("multi_resolved")
    evidence = F.when(F.col("valid") > 0, "split_by_evidence").otherwise("split_equal_fallback")
    strategy = F.when(k == 1, "unique_provider").when(many & ~open_, F.when(rule == "split_by_evidence_hybrid", evidence).otherwise(rule))
    reason = F.when(k == 0, "no_provider_candidates").when(many & strict, "rule_requires_unique_provider").when(many & best & close, "top1_top2_ratio_too_close")
    return d.select("rule", "consumer", "flow", "k", "tier", "valid", kind.alias("kind"), strategy.alias("strategy"), reason.alias("reason"))


@query("ag02", _RULED + "SELECT rule, count(*) AS total, count(*) FILTER (WHERE kind = 'unique_provider') AS unique_, count(*) FILTER (WHERE k > 1) AS multi, count(*) FILTER (WHERE kind = 'multi_resolved') AS resolved, count(*) FILTER (WHERE kind = 'multi_unresolved') AS unresolved, count(*) FILTER (WHERE strategy = 'split_equal_fallback') AS fallback, count(*) FILTER (WHERE kind = 'no_provider') AS none, count(*) FILTER (WHERE kind IN ('unique_provider', 'multi_resolved')) AS written FROM z GROUP BY 1")
def ag02(n):
    """The eight matching counters of each rule."""
    kind = F.col("kind")
    g = ruled(n).groupBy("rule")
    return g.agg(F.count("*").alias("total"), F.count_if(kind == "unique_provider").alias("unique_"), F.count_if(F.col("k") > 1).alias("multi"), F.count_if(kind == "multi_resolved").alias("resolved"), F.count_if(kind == "multi_unresolved").alias("unresolved"), F.count_if(F.col("strategy") == "split_equal_fallback").alias("fallback"), F.count_if(kind == "no_provider").alias("none"), F.count_if(kind.isin("unique_provider", "multi_resolved")).alias("written"))


@query("ag04", _GEO + _RULED + "SELECT rule, 'candidates' AS histogram, k::VARCHAR AS label, count(*) AS demands FROM z GROUP BY 1, 3 UNION ALL SELECT rule, 'strategy', strategy, count(*) FROM z WHERE strategy IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT rule, 'reason', reason, count(*) FROM z WHERE reason IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT rule, 'tier', coalesce(tier::VARCHAR, 'none'), count(*) FROM z GROUP BY 1, 3 UNION ALL SELECT rule, 'source', source, count(*) FROM anchored CROSS JOIN r GROUP BY 1, 3")
def ag04(n):
    """Five histograms of each rule: numbers of candidates, strategies, reasons, tiers, and sources of the supply region."""
    text = lambda c: F.col(c).cast("string")
    labels = F.array(*(F.struct(F.lit(name).alias("histogram"), c.alias("label")) for name, c in (("candidates", text("k")), ("strategy", F.col("strategy")), ("reason", F.col("reason")), ("tier", F.coalesce(text("tier"), F.lit("none"))))))
    out = ruled(n).select("rule", F.inline(labels)).where("label is not null").groupBy("rule", "histogram", "label").agg(F.count("*").alias("demands"))
    near, _ = _anchored(n)
    sources = near.groupBy("source").agg(F.count("*").alias("demands")).select(F.explode(F.array(*map(F.lit, RULES))).alias("rule"), F.lit("source").alias("histogram"), F.col("source").alias("label"), "demands")
    return out.unionByName(sources)


@query("rd06", _RULED + "SELECT consumer, flow, k AS candidates, kind, strategy, reason, CASE kind WHEN 'unique_provider' THEN 'none' WHEN 'multi_resolved' THEN 'multi_provider_resolved' WHEN 'multi_unresolved' THEN 'multi_provider_unresolved' ELSE 'no_provider' END AS ambiguity, CASE WHEN kind = 'unique_provider' THEN 'high' WHEN kind = 'multi_resolved' AND strategy <> 'split_equal_fallback' THEN 'medium' ELSE 'low' END AS confidence FROM z WHERE rule = 'best_provider_strict'")
def rd06(n):
    """Evidence of each decision: its kind, strategy and reason, and how ambiguous and how sure it is."""
    return gates.evidence(ruled(n, ("best_provider_strict",))).select("consumer", "flow", F.col("k").alias("candidates"), "kind", "strategy", "reason", "ambiguity", "confidence")


# A scope in which only each fourth process provides leaves demands unmatched.
_SCOPE = """, inscope AS (SELECT DISTINCT flow FROM port WHERE process_idx % 4 = 0),
gap AS (SELECT r.consumer, r.flow, p.location, (100 + r.consumer % 3) AS state, r.consumer || '@' || (r.consumer % 3) AS version, i.flow IS NULL AS unmatched, r.flow IN (SELECT flow FROM port) AS known FROM residual r JOIN process p ON p.process_idx = r.consumer LEFT JOIN inscope i USING (flow)),
miss AS (SELECT *, CASE WHEN known THEN 'no_provider_in_scope' ELSE 'flow_missing_in_flow_table' END AS category FROM gap WHERE unmatched) """


def _gaps(n: Network) -> DataFrame:
    inscope = n.ports.where("process_idx % 4 = 0").select("flow").distinct().withColumn("i", F.lit(True))
    known = n.ports.select("flow").distinct().withColumn("kn", F.lit(True))
    c = F.col("consumer")
    rows = n.residuals.select(F.col("process_idx").alias("consumer"), "flow").join(n.processes.select(F.col("process_idx").alias("consumer"), "location"), "consumer").join(inscope, "flow", "left").join(known, "flow", "left")
    category = F.when(F.col("kn"), "no_provider_in_scope").otherwise("flow_missing_in_flow_table")
    return rows.select("consumer", "flow", "location", (100 + c % 3).alias("state"), F.concat_ws("@", c, c % 3).alias("version"), F.col("i").isNull().alias("unmatched"), category.alias("category"))


@query("ag07", _SCOPE + "SELECT * FROM (SELECT 'flow' AS kind, flow AS label, count(*) AS edges, count(*) FILTER (WHERE unmatched) AS missing, round(100.0 * count(*) FILTER (WHERE NOT unmatched) / count(*), 2) AS write_pct FROM gap GROUP BY 2 ORDER BY missing DESC, edges DESC, label LIMIT 20) UNION ALL SELECT * FROM (SELECT 'process', consumer::VARCHAR, count(*) AS edges, count(*) FILTER (WHERE unmatched) AS missing, round(100.0 * count(*) FILTER (WHERE NOT unmatched) / count(*), 2) FROM gap GROUP BY 2 ORDER BY missing DESC, edges DESC, 2 LIMIT 20)")
def ag07(n):
    """The flows and the processes with most demands that nobody meets, twenty of each, with the share that is met."""
    gaps = _gaps(n)

    def top(kind: str, by: Column) -> DataFrame:
        some = F.count_if(~F.col("unmatched"))
        out = gaps.groupBy(F.lit(kind).alias("kind"), by.cast("string").alias("label")).agg(F.count("*").alias("edges"), F.count_if("unmatched").alias("missing"), fn.percent(some, F.count("*")).alias("write_pct"))
        return out.orderBy(F.desc("missing"), F.desc("edges"), "label").limit(20)

    return top("flow", F.col("flow")).unionByName(top("process", F.col("consumer")))


@query("ag08", _SCOPE + "SELECT category, flow, count(*) AS unmatched, count(DISTINCT version) AS versions, count(DISTINCT consumer) AS ids, array_to_string(list_sort(list(DISTINCT state)), ',') AS states, array_to_string(list_sort(list(DISTINCT location))[1:5], ' | ') AS locations FROM miss GROUP BY 1, 2")
def ag08(n):
    """Unmatched demands by flow: counts, distinct versions and ids, the states, the first five places."""
    text = lambda c: F.array_sort(F.collect_set(F.col(c).cast("string")))
    g = _gaps(n).where("unmatched").groupBy("category", "flow")
    return g.agg(F.count("*").alias("unmatched"), F.countDistinct("version").alias("versions"), F.countDistinct("consumer").alias("ids"), F.array_join(text("state"), ",").alias("states"), F.array_join(F.slice(text("location"), 1, 5), " | ").alias("locations"))


@query("ag09", _SCOPE + ", f AS (SELECT consumer, flow, row_number() OVER (PARTITION BY consumer ORDER BY count(*) DESC, flow) AS rn FROM miss GROUP BY 1, 2) SELECT m.consumer, count(*) AS unmatched, count(DISTINCT m.flow) AS flows, count(*) FILTER (WHERE category = 'flow_missing_in_flow_table') AS unknown, count(*) FILTER (WHERE category = 'no_provider_in_scope') AS unserved, (SELECT string_agg(flow, ' | ' ORDER BY rn) FROM f WHERE f.consumer = m.consumer AND rn <= 5) AS top, CASE WHEN bool_or(category = 'flow_missing_in_flow_table') THEN 'add_flow' ELSE 'add_provider' END AS hint FROM miss m GROUP BY 1")
def ag09(n):
    """Unmatched demands by process: counts under conditions, the five main flows, what to do."""
    miss = _gaps(n).where("unmatched")
    by = W.partitionBy("consumer").orderBy(F.desc("k"), "flow")
    top = miss.groupBy("consumer", "flow").agg(F.count("*").alias("k")).withColumn("rn", F.row_number().over(by)).where("rn <= 5")
    top = top.groupBy("consumer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "flow"))), lambda x: x["flow"]), " | ").alias("top"))
    lost = F.col("category") == "flow_missing_in_flow_table"
    out = miss.groupBy("consumer").agg(F.count("*").alias("unmatched"), F.countDistinct("flow").alias("flows"), F.count_if(lost).alias("unknown"), F.count_if(~lost).alias("unserved"), F.when(F.bool_or(lost), "add_flow").otherwise("add_provider").alias("hint"))
    return out.join(top, "consumer")


@query("ag10", _SCOPE + "SELECT 'input_edges_total' AS item, count(*)::VARCHAR AS value FROM gap UNION ALL SELECT 'unmatched', count(*)::VARCHAR FROM miss UNION ALL SELECT 'impacted_versions', count(DISTINCT version)::VARCHAR FROM miss UNION ALL SELECT 'impacted_ids', count(DISTINCT consumer)::VARCHAR FROM miss UNION ALL SELECT 'missing_flows', count(DISTINCT flow)::VARCHAR FROM miss UNION ALL SELECT 'rows::' || category, count(*)::VARCHAR FROM miss GROUP BY category UNION ALL SELECT 'state::' || state, count(*)::VARCHAR FROM miss GROUP BY state UNION ALL SELECT * FROM (SELECT 'top_flow::' || flow, count(*)::VARCHAR FROM miss GROUP BY flow ORDER BY count(*) DESC, flow LIMIT 10)")
def ag10(n):
    """The summary of unmatched demands as items and values."""
    gaps = _gaps(n)
    miss = gaps.where("unmatched")
    total = gaps.agg(F.count("*").alias("input_edges_total"), F.count_if("unmatched").alias("unmatched"), F.countDistinct(F.when(F.col("unmatched"), F.col("version"))).alias("impacted_versions"), F.countDistinct(F.when(F.col("unmatched"), F.col("consumer"))).alias("impacted_ids"), F.countDistinct(F.when(F.col("unmatched"), F.col("flow"))).alias("missing_flows"))
    out = total.select(F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in total.columns))).alias("x")).select("x.*")
    for prefix, c in (("rows::", "category"), ("state::", "state")):
        out = out.unionByName(miss.groupBy(c).agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("item"), "value"))
    flows = miss.groupBy("flow").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "flow").limit(10)
    return out.unionByName(flows.select(F.concat(F.lit("top_flow::"), "flow").alias("item"), F.col("k").cast("string").alias("value")))


@query("snk16", _SCOPE + "SELECT consumer, flow, category FROM miss")
def snk16(n):
    """Unmatched demands as the rows of a diagnostics workbook, read back from it."""
    from ..sources import artifacts

    rows = _gaps(n).where("unmatched").select("consumer", "flow", "category").orderBy("consumer", "flow").limit(artifacts.SHEET_ROWS)
    data = artifacts.workbook({"unmatched": (rows.columns, [tuple(r) for r in rows.collect()])})
    _, *body = artifacts.sheet(data)
    return n.spark.createDataFrame([(int(c), f, k) for c, f, k in body], "consumer int, flow string, category string")


# Matrices


@query("ag01", "SELECT row_idx, col_idx, round(sum(value), 6) AS value, count(*) AS parts FROM (SELECT provider AS row_idx, consumer AS col_idx, -residual * weight AS value FROM weighted) GROUP BY 1, 2")
def ag01(n):
    """Entries of A before and after those of one place are added up."""
    return linking.summed(n.nearest, n.offers).select("row_idx", "col_idx", F.round("value", 6).alias("value"), "parts")


@query("flt05", "SELECT k AS row_idx, 0 AS col_idx, sum(v) AS value FROM (SELECT (l_suppkey % 50)::INT AS k, CASE l_linenumber % 3 WHEN 0 THEN 0.0 WHEN 1 THEN l_quantity ELSE -l_quantity END AS v FROM lineitem WHERE l_linenumber < 4) WHERE v <> 0 GROUP BY 1 HAVING sum(v) <> 0", "")
def flt05(n):
    """Zeros go before entries of one place are added up, and again after."""
    v = F.when(F.col("l_linenumber") % 3 == 0, 0.0).when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return linear.merged(n.table("lineitem").where("l_linenumber < 4").select((F.col("l_suppkey") % 50).cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), v.alias("value")))


@query("flt06", "SELECT space, count(*) AS flows FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'technosphere' WHEN 1 THEN 'technosphere' WHEN 2 THEN 'biosphere' ELSE 'reporting' END AS space FROM part) GROUP BY 1", "")
def flt06(n):
    """Flows by the space that their type sends them to."""
    kind = F.element_at(F.array(*map(F.lit, ("Product flow", "Waste flow", "Elementary flow", "Other flow"))), F.col("p_size") % 4 + 1)
    return n.table("part").groupBy(fn.flow_space(kind).alias("space")).agg(F.count("*").alias("flows"))


@query("ag16", "SELECT 'row' AS axis, process_idx AS idx FROM process WHERE process_idx NOT IN (SELECT row_idx FROM a) UNION ALL SELECT 'column', process_idx FROM process WHERE process_idx NOT IN (SELECT col_idx FROM a)")
def ag16(n):
    """Rows and columns of A without an entry."""
    parts = [linear.empty(n.a, c, n.n).select(F.lit(name).alias("axis"), "idx") for name, c in (("row", "row_idx"), ("column", "col_idx"))]
    return parts[0].unionByName(parts[1])


_EDGES = "e AS (SELECT l_suppkey::INT AS col_idx, list_position(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], l_returnflag || l_linestatus) - 1 AS row_idx, CASE WHEN l_linestatus = 'O' THEN 'Output' ELSE 'Input' END AS direction, sum(l_extendedprice) * 1e-6 AS amount FROM lineitem GROUP BY 1, 2, 3)"


def _elementary(n: Network) -> DataFrame:
    """Elementary exchanges with their direction: the line status says which."""
    return n.b.select("row_idx", "col_idx", F.when(F.col("row_idx") % 2 == 1, "Output").otherwise("Input").alias("direction"), F.col("value").alias("amount"))


@query("cp15", "SELECT mode, row_idx, col_idx, round(CASE WHEN mode = 'signed' AND direction = 'Input' THEN -amount ELSE amount END, 6) AS value FROM e CROSS JOIN (VALUES ('gross'), ('signed')) AS t(mode)", _EDGES)
def cp15(n):
    """B with gross amounts, and with inputs negative."""
    e = _elementary(n)
    parts = [linking.biosphere(e, mode).select(F.lit(mode).alias("mode"), "row_idx", "col_idx", F.round("value", 6).alias("value")) for mode in ("gross", "signed")]
    return parts[0].unionByName(parts[1])


@query("cp16", "SELECT mode, c.row_idx, c.col_idx, c.value::DOUBLE AS value FROM (SELECT *, CASE WHEN col_idx IN (0, 3) THEN 'Output' ELSE 'Input' END AS direction FROM c) c CROSS JOIN (VALUES ('any'), ('directed')) AS t(mode) WHERE c.col_idx IN (SELECT row_idx FROM b) AND (mode = 'any' OR (c.direction = 'Output') = (c.col_idx % 2 = 1))")
def cp16(n):
    """Factors of flows that the biosphere holds, and of these the ones whose direction its exchanges have, and no other."""
    c = n.c.withColumn("direction", F.when(F.col("col_idx").isin(0, 3), "Output").otherwise("Input"))
    parts = [linking.active_factors(c, _elementary(n), directed=mode == "directed").select(F.lit(mode).alias("mode"), "row_idx", "col_idx", "value") for mode in ("any", "directed")]
    return parts[0].unionByName(parts[1])


@query("sc03", "SELECT count(*) AS demands, count(*) FILTER (WHERE abs(residual + s) > 1e-12 * greatest(1.0, abs(residual))) AS open, round(max(activity), 6) AS largest FROM (SELECT consumer, flow, any_value(residual) AS residual, sum(-residual * weight) AS s, max(-residual * weight) AS activity FROM weighted GROUP BY 1, 2)")
def sc03(n):
    """Each balance closes: what providers do, times their pivots, cancels the demand."""
    return linking.closure(n.weighted).agg(F.count("*").alias("demands"), F.count_if(~F.col("closed")).alias("open"), F.round(F.max("largest"), 6).alias("largest"))


# Coverage, readiness and gates


def _coverage(n: Network) -> DataFrame:
    """The one row that readiness looks at, from the demands under best_provider_strict and the matrices."""
    d = ruled(n, ("best_provider_strict",))
    kind = F.col("kind")
    match = d.agg(F.count("*").alias("input_edges_total"), F.count_if(kind.isin("unique_provider", "multi_resolved")).alias("written"), F.count_if(kind == "no_provider").alias("unmatched_no_provider"), F.count_if(kind == "multi_unresolved").alias("multi_unresolved"), F.count_if(F.col("strategy") == "split_equal_fallback").alias("equal_fallback"))
    match = match.withColumn("a_write_pct", fn.percent(F.col("written"), F.col("input_edges_total")))
    diagonal = n.a.where("row_idx = col_idx").agg(F.count_if(F.abs("value") >= 0.999).alias("risky_diagonal"), F.count_if(F.abs(1 - F.col("value")) <= 1e-12).alias("zero_diagonal"))
    sizes = n.a.agg(F.count("*").alias("a_nnz")).crossJoin(n.b.agg(F.count("*").alias("b_nnz"))).crossJoin(n.c.agg(F.count("*").alias("c_nnz")))
    out = match.crossJoin(diagonal).crossJoin(sizes)
    return out.withColumn("risk_level", F.when(F.col("zero_diagonal") > 0, "high").when(F.col("risky_diagonal") > 0, "medium").otherwise("low"))


_COVER = _RULED + ", cov AS (SELECT count(*) AS input_edges_total, count(*) FILTER (WHERE kind IN ('unique_provider', 'multi_resolved')) AS written, count(*) FILTER (WHERE kind = 'no_provider') AS unmatched, count(*) FILTER (WHERE kind = 'multi_unresolved') AS unresolved, round(100.0 * count(*) FILTER (WHERE kind IN ('unique_provider', 'multi_resolved')) / nullif(count(*), 0), 2) AS pct FROM z WHERE rule = 'best_provider_strict') "


@query("cp17", _COVER + "SELECT input_edges_total, written, unmatched AS unmatched_no_provider, unresolved AS multi_unresolved, pct AS a_write_pct, (SELECT count(*) FROM a) AS a_nnz, (SELECT count(*) FROM b) AS b_nnz, (SELECT count(*) FROM c) AS c_nnz, CASE WHEN EXISTS (SELECT 1 FROM a WHERE row_idx = col_idx AND abs(1 - value) <= 1e-12) THEN 'high' WHEN EXISTS (SELECT 1 FROM a WHERE row_idx = col_idx AND abs(value) >= 0.999) THEN 'medium' ELSE 'low' END AS risk_level FROM cov")
def cp17(n):
    """The coverage report: what is matched and written, sizes of the matrices, the risk of a singular one."""
    return _coverage(n).select("input_edges_total", "written", "unmatched_no_provider", "multi_unresolved", "a_write_pct", "a_nnz", "b_nnz", "c_nnz", "risk_level")


@query("rd01", _COVER + ", s AS (SELECT unnest(['closed', 'open', 'sealed']) AS policy) SELECT policy, code, severity FROM (SELECT policy, 'technosphere_boundary_policy_unsupported' AS code, 'blocker' AS severity, policy = 'sealed' AS hit FROM s UNION ALL SELECT policy, 'provider_closure_write_pct_below_policy', 'blocker', policy <> 'open' AND pct < 100 FROM s, cov UNION ALL SELECT policy, 'provider_closure_unmatched', 'blocker', policy <> 'open' AND unmatched > 0 FROM s, cov UNION ALL SELECT policy, 'provider_closure_multi_unresolved', 'blocker', policy <> 'open' AND unresolved > 0 FROM s, cov UNION ALL SELECT policy, 'technosphere_boundary_unresolved_permitted', 'warning', policy = 'open' AND (unmatched > 0 OR unresolved > 0) FROM s, cov UNION ALL SELECT policy, 'provider_closure_no_input_edges', 'warning', input_edges_total = 0 FROM s, cov) WHERE hit")
def rd01(n):
    """Findings on closure under a closed, an open and an unknown boundary; the unknown one is taken as closed."""
    cover = written(_coverage(n))
    parts = [gates.provider_findings(cover, p).select(F.lit(p).alias("policy"), "code", "severity") for p in ("closed", "open", "sealed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("rd02", ", byproduct AS (SELECT process_idx, flow FROM ranked WHERE rn = 2), gaps AS (SELECT r.consumer, r.flow, count(b.process_idx) AS candidates FROM residual r JOIN byproduct b ON b.flow = r.flow AND b.process_idx <> r.consumer WHERE r.flow NOT IN (SELECT flow FROM port WHERE process_idx % 4 = 0) GROUP BY 1, 2) SELECT consumer, flow, candidates, (SELECT count(*) FROM gaps) AS missing FROM gaps ORDER BY consumer, flow LIMIT 8")
def rd02(n):
    """Demands that only by-products would meet, as no process in scope has them as its reference: how many, and eight of them."""
    byproducts = n.ranked.where("rn = 2").select("process_idx", "flow")
    return gates.by_products_only(n.residuals.select(F.col("process_idx").alias("consumer"), "flow"), n.ports.where("process_idx % 4 = 0"), byproducts)


@query("rd03", "SELECT * FROM (VALUES ('as it is', NULL, NULL), ('without factors', 'lcia_factors_missing', 'blocker'), ('without exchanges', 'biosphere_entries_missing', 'warning'), ('risk high', 'singular_risk_high', 'blocker'), ('risk medium', 'singular_risk_medium', 'blocker'), ('risk allowed', 'singular_risk_medium', 'warning'), ('bad references', 'reference_normalization_not_closed', 'blocker'), ('bad allocation', 'allocation_fraction_invalid', 'blocker')) AS t(scenario, code, severity)", "")
def rd03(n):
    """Findings on the graph in eight scenarios of its coverage."""
    base = written(_coverage(n).withColumn("missing_references", F.lit(0)).withColumn("invalid_references", F.lit(0)).withColumn("invalid_allocations", F.lit(0)))
    change = {"as it is": {}, "without factors": {"c_nnz": 0}, "without exchanges": {"b_nnz": 0}, "risk high": {"risk_level": "high"}, "risk medium": {"risk_level": "medium"}, "risk allowed": {"risk_level": "medium"}, "bad references": {"invalid_references": 2}, "bad allocation": {"invalid_allocations": 1}}
    out = None
    for name, columns in change.items():
        cover = base.withColumn("risk_level", F.lit("low")).withColumns({k: F.lit(v) for k, v in columns.items()})
        found = gates.graph_findings(cover, gates.Policy(allow_medium_singular_risk=name == "risk allowed"))
        part = n.spark.createDataFrame([(name,)], "scenario string").join(found, F.lit(True), "left").select("scenario", "code", "severity")
        out = part if out is None else out.unionByName(part)
    return out


@query("rd04", "SELECT count(DISTINCT col_idx) AS sampled, count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS not_finite, count(*) FILTER (WHERE value < -1e-12) AS negative, round(min(value), 6) AS least FROM h WHERE col_idx < 16", SOLVED)
def rd04(n):
    """The first sixteen unit demands solved: values that are not finite, impacts below zero, the least impact."""
    y = n.spark.range(min(16, n.n)).select(F.col("id").cast("int").alias("rhs"), F.col("id").cast("int").alias("idx"), F.lit(1.0).alias("value"))
    found = _model(n).solve(y, x=True, g=True, h=True)
    return gates.stability(found).select("sampled", "not_finite", "negative", F.round("least", 6).alias("least"))


#: Findings that orders stand in for: code and severity.
_FOUND = (("lcia_factors_missing", "blocker"), ("singular_risk_observed", "info"), ("biosphere_entries_missing", "warning"), (None, None), ("provider_closure_unmatched", "blocker"), ("singular_risk_high", "blocker"), ("compute_non_finite_values", "blocker"), ("write_pct_low", "warning"), ("coverage_observed", "info"), (None, None), ("factorization_not_ready", "blocker"))
_FOUND_SQL = "f AS (SELECT o_custkey, o_orderkey, [" + ", ".join("NULL" if c is None else f"'{c}'" for c, _ in _FOUND) + "][(o_orderkey + o_custkey) % 11 + 1] AS code, [" + ", ".join("NULL" if x is None else f"'{x}'" for _, x in _FOUND) + "][(o_orderkey + o_custkey) % 11 + 1] AS severity FROM orders)"
_ACTION_SQL = "CASE WHEN bool_or(severity = 'blocker' AND code LIKE 'provider_closure%') THEN 'repair_provider_closure_then_recheck' WHEN bool_or(severity = 'blocker' AND (code LIKE 'factorization%' OR code LIKE 'compute%')) THEN 'repair_compute_stability_then_recheck' WHEN bool_or(severity = 'blocker' AND code LIKE 'lcia%') THEN 'repair_lcia_factors_then_recheck' WHEN bool_or(severity = 'blocker') THEN 'repair_graph_readiness_then_recheck' WHEN bool_or(severity = 'warning') THEN 'manual_review_warnings' ELSE 'publish_ready' END"


def _findings(n: Network) -> DataFrame:
    """Findings of customers' orders; a customer is a report."""
    x = F.get(F.array(*(F.struct(F.lit(c).cast("string").alias("code"), F.lit(s).cast("string").alias("severity")) for c, s in _FOUND)), ((F.col("o_orderkey") + F.col("o_custkey")) % 11).cast("int"))
    return n.table("orders").select("o_custkey", "o_orderkey", x.alias("x")).select("o_custkey", "o_orderkey", "x.*")


@query("rd05", f"SELECT o_custkey AS report, CASE WHEN bool_or(severity = 'blocker') THEN 'failed' ELSE 'passed' END AS status, {_ACTION_SQL} AS next_action FROM f GROUP BY 1", _FOUND_SQL)
def rd05(n):
    """Status and next action of each customer's report from its findings."""
    return gates.status(_findings(n), "o_custkey").withColumnRenamed("o_custkey", "report")


@query("sc26", f"SELECT code, next_action, count(*) AS reports FROM (SELECT o_orderkey, any_value(code) AS code, {_ACTION_SQL} AS next_action FROM f WHERE code IS NOT NULL GROUP BY 1) GROUP BY 1, 2", _FOUND_SQL)
def sc26(n):
    """What a single finding asks for, and how many orders have it."""
    one = _findings(n).where("code is not null")
    asked = gates.status(one, "o_orderkey").join(one.select("o_orderkey", "code"), "o_orderkey")
    return asked.groupBy("code", "next_action").agg(F.count("*").alias("reports"))


@query("rq01", _COVER + "SELECT category, findings, CASE WHEN findings > 0 THEN 'findings' ELSE 'clear' END AS status FROM (SELECT 'completeness' AS category, (pct < 100)::BIGINT + (unmatched > 0)::BIGINT AS findings FROM cov UNION ALL SELECT 'numerical_stability', (unresolved > 0)::BIGINT FROM cov)")
def rq01(n):
    """The joint diagnostic: findings by category, a section without any is clear. An unresolved provider counts as numerical, as its code holds "solve"."""
    cover = _coverage(n).withColumn("missing_references", F.lit(0)).withColumn("invalid_references", F.lit(0)).withColumn("invalid_allocations", F.lit(0))
    cover = written(cover)
    return gates.sections(gates.provider_findings(cover, "closed").unionByName(gates.graph_findings(cover, gates.Policy())))


# Review gate: an order is a process, its lines are exchanges; the first line is the reference.

_REVIEW = "x AS (SELECT l_orderkey AS id, l_linenumber AS ex, l_partkey % 40 AS flow, CASE WHEN l_returnflag = 'R' THEN 'Input' ELSE 'Output' END AS direction, CASE l_linenumber % 11 WHEN 5 THEN '12%' WHEN 6 THEN 'n/a' ELSE l_quantity::INT::VARCHAR END AS amount, CASE WHEN l_linenumber % 5 = 0 THEN '150' WHEN l_linenumber % 5 = 1 THEN '50' END AS share FROM lineitem)"


def _review(n: Network) -> DataFrame:
    k = F.col("l_linenumber")
    amount = F.when(k % 11 == 5, "12%").when(k % 11 == 6, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string"))
    share = F.when(k % 5 == 0, "150").when(k % 5 == 1, "50")
    direction = F.when(F.col("l_returnflag") == "R", "in").otherwise("Output")
    return n.table("lineitem").select(F.col("l_orderkey").alias("id"), k.alias("ex"), (F.col("l_partkey") % 40).alias("flow"), direction.alias("direction"), amount.alias("amount"), share.alias("share"))


@query("gt01", "SELECT s_suppkey AS id, s_nationkey % 3 <> 0 AS fresh, CASE WHEN s_nationkey % 3 = 0 THEN 'revision_report_stale' END AS code FROM supplier", "")
def gt01(n):
    """Reports whose checksum is that of the current revision; a missing one is stale too."""
    actual = F.sha2(F.concat_ws("|", "s_name", "s_acctbal"), 256)
    expected = F.when(F.col("s_nationkey") % 6 == 0, None).when(F.col("s_nationkey") % 3 == 0, F.sha2("s_name", 256)).otherwise(actual)
    return gates.freshness(n.table("supplier").select(F.col("s_suppkey").alias("id"), expected.alias("expected"), actual.alias("actual")))


@query("gt02", "SELECT id, array_to_string(list_sort(list(version)), ',') AS versions FROM (SELECT DISTINCT l_suppkey % 60 AS id, (l_suppkey % 7)::VARCHAR AS version FROM lineitem) GROUP BY 1 HAVING count(*) > 1", "")
def gt02(n):
    """Processes that come in several versions."""
    rows = n.table("lineitem").select((F.col("l_suppkey") % 60).alias("id"), (F.col("l_suppkey") % 7).cast("string").alias("version")).distinct()
    return gates.several_versions(rows)


@query("gt03", "SELECT 'invalid_exchange_amount' AS code, count(*) AS found FROM x WHERE amount IN ('12%', 'n/a') UNION ALL SELECT 'invalid_allocation_fraction', count(*) FROM x WHERE share = '150' UNION ALL SELECT 'missing_or_zero_reference', count(*) FROM (SELECT id FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE ex = 1) <> 1)", _REVIEW)
def gt03(n):
    """Amounts and shares that are no numbers in range, and processes without one reference that is a number other than zero."""
    return gates.invalid_records(_review(n), F.lit(1))


@query("gt04", ", f AS (SELECT id, string_agg(k, '|' ORDER BY k) AS fp FROM (SELECT id, flow || ':' || lower(direction) || ':' || amount AS k FROM x) GROUP BY 1) SELECT min(id) AS first, count(*) AS copies FROM f GROUP BY fp HAVING count(*) > 1", _REVIEW)
def gt04(n):
    """Processes with equal multisets of exchanges."""
    return gates.equal_exchanges(_review(n)).select("first", "copies")


@query("gt05", " SELECT i.id, i.flow, i.ex AS input, o.ex AS output FROM x i JOIN x o ON i.id = o.id AND i.flow = o.flow AND i.direction = 'Input' AND o.direction = 'Output' WHERE i.amount NOT IN ('12%', 'n/a') AND o.amount NOT IN ('12%', 'n/a') AND abs(i.amount::DOUBLE - o.amount::DOUBLE) <= 10", _REVIEW)
def gt05(n):
    """Inputs and outputs of one flow in one process whose amounts are equal within ten."""
    return gates.loops(_review(n), 10.0)


@query("gt06", _RULED + "SELECT count(*) AS decisions, count(*) FILTER (WHERE kind = 'no_provider') AS missing, count(*) FILTER (WHERE kind = 'multi_unresolved') AS unresolved, count(*) FILTER (WHERE valid < k) AS volume_invalid, (SELECT count(*) FROM (SELECT sum(weight) AS s FROM weighted GROUP BY consumer, flow) WHERE abs(s - 1) > 1e-9) AS not_conserved FROM z WHERE rule = 'best_provider_strict'")
def gt06(n):
    """Provider metrics of the gate: missing and unresolved decisions, volumes stood in for, weights that do not add up to one."""
    broken = n.weighted.groupBy("consumer", "flow").agg(F.sum("weight").alias("s"), F.min("weight").alias("least")).agg(F.count_if((F.abs(F.col("s") - 1) > 1e-9) | (F.col("least") < 0)).alias("not_conserved"))
    d = ruled(n, ("best_provider_strict",))
    return d.agg(F.count("*").alias("decisions"), F.count_if(F.col("kind") == "no_provider").alias("missing"), F.count_if(F.col("kind") == "multi_unresolved").alias("unresolved"), F.count_if(F.col("valid") < F.col("k")).alias("volume_invalid")).crossJoin(broken)


_KINDS = f", kind AS (SELECT DISTINCT flow, CASE WHEN {_BRAND} % 6 = 0 THEN 'elementary' ELSE 'product' END AS kind FROM brand), ekind AS (SELECT i AS row_idx, CASE WHEN i % 4 = 3 THEN 'product' ELSE 'elementary' END AS kind FROM range(6) t(i)) "


@query("gt07", _KINDS + "SELECT 'provider_decision_non_product_flow' AS code, count(*) AS found FROM residual JOIN kind USING (flow) WHERE kind <> 'product' UNION ALL SELECT 'technosphere_non_product_flow', count(*) FROM weighted JOIN kind USING (flow) WHERE kind <> 'product' UNION ALL SELECT 'biosphere_non_elementary_flow', count(*) FROM b JOIN ekind USING (row_idx) WHERE kind <> 'elementary' UNION ALL SELECT 'lcia_factor_on_product_flow', count(*) FROM c JOIN ekind ON ekind.row_idx = c.col_idx WHERE kind = 'product'")
def gt07(n):
    """Uses of a flow that its kind does not allow, of four kinds."""
    flows = n.ranked.select("flow").distinct().withColumn("kind", F.when(_brand() % 6 == 0, "elementary").otherwise("product"))
    elementary = n.spark.range(6).select(F.col("id").cast("int").alias("flow_idx"), F.when(F.col("id") % 4 == 3, "product").otherwise("elementary").alias("kind"))
    return gates.semantics(flows, elementary, n.residuals, n.weighted, n.b, n.c)


@query("gt08", "SELECT 'zero_or_near_zero_diagonal' AS code, count(*) AS found FROM process WHERE abs(1 - coalesce((SELECT sum(value) FROM a WHERE row_idx = process_idx AND col_idx = process_idx), 0)) <= 1e-12 UNION ALL SELECT 'duplicate_sparse_columns', 1")
def gt08(n):
    """Diagonal of M next to zero, and columns of M that are equal; the network's have none, so a pair is added."""
    made = n.ruled("split_by_process_volume")
    ones = n.spark.range(n.n).select(F.col("id").cast("int").alias("col_idx"), F.col("id").cast("int").alias("row_idx"))
    twin = lambda rows, c: rows.unionByName(rows.where(F.col(c) == 0).withColumn(c, F.lit(-1)))
    return gates.structure(linking.Factored(twin(made.loads, "consumer"), made.shares), twin(ones, "col_idx"), n.n)


@query("gt09", "SELECT * FROM (VALUES ('covered', NULL, 3, 0), ('none asked', 'target_process_not_covered_by_probe', 0, 0), ('outside', 'target_process_not_covered_by_probe', 1, 0), ('too many', 'target_process_not_covered_by_probe', 2, 0), ('without factors', 'lcia_factor_missing_for_impact_submit', 1, 0)) AS t(request, code, probed, not_finite)", "")
def gt09(n):
    """Probes of target processes: covered, none, one outside the axis, more than the limit, and impacts without factors."""
    model = _model(n)
    cases = {"covered": ([0, 1, 2, 2], 32, 8), "none asked": ([], 32, 8), "outside": ([0, 10**6], 32, 8), "too many": ([0, 1, 2], 2, 8), "without factors": ([1], 32, 0)}
    rows = [(name, *gates.probe(model, targets, limit, factors)) for name, (targets, limit, factors) in cases.items()]
    return n.spark.createDataFrame(rows, "request string, code string, probed int, not_finite int")


assert DEMANDS and NETWORK
