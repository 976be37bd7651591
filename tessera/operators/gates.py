"""Findings on a compiled network: readiness to be computed, and the gate that a review has to pass.

A finding is a row (code, severity); severities are info, warning and blocker. Checks on counts look at one row of coverage,
checks on records at the records themselves; none collects more than the findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources.tables import written
from . import linear, linking, multisets

#: Examples that a finding shows.
EXAMPLES = 8
BOUNDARIES = ("closed", "open", "cutoff")
#: Random numbers of a row by which columns are told apart.
SKETCHES = 3


@dataclass(frozen=True)
class Policy:
    """What a snapshot has to fulfil."""

    min_write_pct: float = 100.0
    max_unmatched: int = 0
    max_multi_unresolved: int = 0
    allow_equal_fallback: bool = False
    allow_medium_singular_risk: bool = False
    allow_high_singular_risk: bool = False
    require_factors: bool = True


def _found(coverage: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    rows = F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, hit in checks))
    return coverage.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


def provider_findings(coverage: DataFrame, boundary: str, policy: Policy = Policy()) -> DataFrame:
    """Findings on closure. An unknown boundary policy is a finding and is then taken as closed; only a closed one asks for closure."""
    known = boundary in BOUNDARIES
    closed = F.lit(not known or boundary == "closed")
    unmatched, multi = F.col("unmatched_no_provider"), F.col("multi_unresolved")
    return _found(
        coverage,
        [
            ("technosphere_boundary_policy_unsupported", "blocker", F.lit(not known)),
            ("provider_closure_write_pct_below_policy", "blocker", closed & (F.col("a_write_pct") < policy.min_write_pct)),
            ("provider_closure_unmatched", "blocker", closed & (unmatched > policy.max_unmatched)),
            ("provider_closure_multi_unresolved", "blocker", closed & (multi > policy.max_multi_unresolved)),
            ("provider_closure_equal_fallback", "blocker", F.lit(not policy.allow_equal_fallback) & (F.col("equal_fallback") > 0)),
            ("technosphere_boundary_unresolved_permitted", "warning", ~closed & ((unmatched > 0) | (multi > 0))),
            ("provider_closure_no_input_edges", "warning", F.col("input_edges_total") == 0),
        ],
    )


def graph_findings(coverage: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Findings on references, allocations, the risk of a singular matrix, and empty matrices."""
    risk = F.col("risk_level")
    medium = "warning" if policy.allow_medium_singular_risk else "blocker"
    return _found(
        coverage,
        [
            ("reference_normalization_not_closed", "blocker", (F.col("missing_references") > 0) | (F.col("invalid_references") > 0)),
            ("allocation_fraction_invalid", "blocker", F.col("invalid_allocations") > 0),
            ("singular_risk_high", "blocker", (risk == "high") & F.lit(not policy.allow_high_singular_risk)),
            ("singular_risk_medium", medium, risk == "medium"),
            ("singular_risk_observed", "info", ~risk.isin("low", "medium") & ((risk != "high") | F.lit(policy.allow_high_singular_risk))),
            ("lcia_factors_missing", "blocker", F.lit(policy.require_factors) & (F.col("c_nnz") == 0)),
            ("biosphere_entries_missing", "warning", F.col("b_nnz") == 0),
        ],
    )


def by_products_only(demands: DataFrame, ports: DataFrame, byproducts: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Demands that no reference meets but another process's by-product would: the first examples, and how many there are."""
    supply = byproducts.groupBy("flow").agg(F.count("*").alias("all"))
    own = byproducts.select(F.col("process_idx").alias("consumer"), "flow", F.lit(1).alias("own"))
    gaps = demands.join(ports.select("flow").distinct(), "flow", "left_anti").join(supply, "flow").join(own, ["consumer", "flow"], "left")
    gaps = gaps.select("consumer", "flow", (F.col("all") - F.coalesce("own", F.lit(0))).alias("candidates")).where("candidates > 0")
    total = gaps.agg(F.count("*").alias("missing"))
    return gaps.orderBy("consumer", "flow").limit(examples).crossJoin(F.broadcast(total))


def stability(vectors: dict[str, DataFrame], eps: float = 1e-12) -> DataFrame:
    """Of solved demands (x, g, h): how many, values that are not finite, impacts below zero and the least of them."""
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    rows = vectors["x"].withColumn("h", F.lit(False)).unionByName(vectors["g"].withColumn("h", F.lit(False))).unionByName(vectors["h"].withColumn("h", F.lit(True)))
    impact = F.when(F.col("h") & ~bad, F.col("value"))
    return rows.agg(F.countDistinct("rhs").alias("sampled"), F.count_if(bad).alias("not_finite"), F.count_if(impact < -eps).alias("negative"), F.min(impact).alias("least"))


def status(findings: DataFrame, by: str) -> DataFrame:
    """Status and next action of each report from its findings; a row without a code stands for a report without any."""
    blocker, code = F.col("severity") == "blocker", F.col("code")
    has = lambda *starts: F.bool_or(blocker & code.rlike("^(" + "|".join(starts) + ")"))
    action = F.when(has("provider_closure"), "repair_provider_closure_then_recheck").when(has("factorization", "compute"), "repair_compute_stability_then_recheck").when(has("lcia"), "repair_lcia_factors_then_recheck").when(F.bool_or(blocker), "repair_graph_readiness_then_recheck")
    action = action.when(F.bool_or(F.col("severity") == "warning"), "manual_review_warnings").otherwise("publish_ready")
    return findings.groupBy(by).agg(F.when(F.bool_or(blocker), "failed").otherwise("passed").alias("status"), action.alias("next_action"))


#: What a finding's code holds if it is one on numbers; all others are on completeness.
NUMERICAL = ("singular", "factorization", "solve", "non_finite", "negative_lcia", "matrix_validation")


def sections(findings: DataFrame) -> DataFrame:
    """Findings by category, each with its status; a category without findings is clear."""
    numerical = F.col("code").rlike("|".join(NUMERICAL))
    by = findings.agg(F.count_if(~numerical).alias("completeness"), F.count_if(numerical).alias("numerical_stability"))
    rows = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("findings"), F.when(F.col(c) > 0, "findings").otherwise("clear").alias("status")) for c in by.columns))
    return by.select(F.inline(rows))


def evidence(decisions: DataFrame) -> DataFrame:
    """Decisions (kind, strategy, reason) with how ambiguous and how sure each is."""
    kind = F.col("kind")
    ambiguity = F.when(kind == "unique_provider", "none").when(kind == "multi_resolved", "multi_provider_resolved").when(kind == "multi_unresolved", "multi_provider_unresolved").when(kind == "no_provider", "no_provider").otherwise("unknown")
    plain = F.col("reason").isNull() & (F.coalesce("strategy", F.lit("")) != "split_equal_fallback")
    confidence = F.when((kind == "unique_provider") & plain, "high").when((kind == "multi_resolved") & plain, "medium").otherwise("low")
    return decisions.withColumn("ambiguity", ambiguity).withColumn("confidence", confidence)


def freshness(revisions: DataFrame) -> DataFrame:
    """Revisions (id, expected, actual) whose checksums agree; without an expected one a report is stale."""
    fresh = F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    return revisions.select("id", fresh.alias("fresh"), F.when(~fresh, "revision_report_stale").alias("code"))


def several_versions(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("version")), ",").alias("versions"), F.count("*").alias("k")).where("k > 1").drop("k")


def invalid_records(exchanges: DataFrame, reference: Column, eps: float = 1e-12) -> DataFrame:
    """Counts of exchanges (id, ex, flow, direction, amount, share) with an amount or a share that is none, and of processes
    whose reference is not exactly one exchange with a direction and an amount other than zero."""
    amount, share = fn.number(F.col("amount")), fn.number(F.col("share"))
    named = F.col("ex") == reference
    good = named & fn.direction(F.col("direction")).isNotNull() & F.coalesce(F.abs(amount) > eps, F.lit(False))
    by = exchanges.groupBy("id").agg(F.count_if(amount.isNull()).alias("a"), F.count_if(F.col("share").isNotNull() & ~F.coalesce(share.between(0, 100), F.lit(False))).alias("s"), (F.when((F.count_if(named) == 1) & (F.count_if(good) == 1), 0).otherwise(1)).alias("r"))
    total = by.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("invalid_exchange_amount"), F.coalesce(F.sum("s"), F.lit(0)).alias("invalid_allocation_fraction"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("missing_or_zero_reference"))
    return total.select(F.inline(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("found")) for c in total.columns))))


def equal_exchanges(exchanges: DataFrame) -> DataFrame:
    """Groups of processes with equal multisets of (flow, direction, amount): the fingerprint, the first process, how many.

    Amounts that are numbers are compared as such, others as texts. No process's exchanges are gathered, and equal fingerprints are verified.
    """
    number = fn.number(F.col("amount"))
    amount = F.when(number.isNotNull(), number.cast("string")).otherwise(F.coalesce("amount", F.lit("")))
    line = F.concat_ws(":", "flow", F.lower(F.coalesce(fn.direction(F.col("direction")), F.col("direction"))), amount)
    lines = written(multisets.counted(exchanges, "id", line))
    same = multisets.classes(lines).groupBy("first").agg(F.count("*").alias("copies")).where("copies > 1")
    mark = multisets.fingerprints(lines).select(F.col("key").alias("first"), F.sha2(F.concat_ws(":", *multisets.MARK), 256).alias("fingerprint"))
    return same.join(mark, "first").select("fingerprint", "first", "copies")


def loops(exchanges: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Inputs and outputs of one process and flow whose amounts differ by ``eps`` at most."""
    e = exchanges.select("id", "flow", "ex", fn.direction(F.col("direction")).alias("d"), fn.number(F.col("amount")).alias("amount")).where("amount is not null")
    i = e.where("d = 'Input'").select("id", "flow", F.col("ex").alias("input"), F.col("amount").alias("p"))
    o = e.where("d = 'Output'").select("id", "flow", F.col("ex").alias("output"), F.col("amount").alias("q"))
    return i.join(o, ["id", "flow"]).where(F.abs(F.col("p") - F.col("q")) <= eps).select("id", "flow", "input", "output")


def semantics(flows: DataFrame, elementary: DataFrame, demands: DataFrame, edges: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """How often a flow (flow, kind) or elementary flow (flow_idx, kind) is used as its kind does not allow; an unknown one counts."""
    kind = flows.select("flow", "kind")  # both grow with the catalog, so Spark chooses how to join them by their size
    other = elementary.select(F.col("flow_idx").alias("row_idx"), "kind")
    not_ = lambda k: F.coalesce(F.col("kind") != k, F.lit(True))
    parts = [
        ("provider_decision_non_product_flow", demands.join(kind, "flow", "left").where(not_("product"))),
        ("technosphere_non_product_flow", edges.join(kind, "flow", "left").where(not_("product"))),
        ("biosphere_non_elementary_flow", b.join(other, "row_idx", "left").where(not_("elementary"))),
        ("lcia_factor_on_product_flow", c.select(F.col("col_idx").alias("row_idx")).join(other, "row_idx", "left").where("kind = 'product'")),
    ]
    counted = [rows.agg(F.lit(code).alias("code"), F.count("*").alias("found")) for code, rows in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


def _near(made: linking.Factored, columns: DataFrame, eps: float) -> DataFrame:
    """(col_idx) of columns of M that may equal another to ``eps``, told without making entries.

    Each row has ``SKETCHES`` fixed random numbers; a column's sums of entries times these follow from the factors. Sums of equal columns differ by no more
    than what entries are rounded by and what sums of doubles lose; others are that near in all sums by chance alone. Columns without finite sums may equal any.
    """
    ks = range(SKETCHES)
    mark = lambda row, k: F.xxhash64(F.col(row).cast("long"), F.lit(k)).cast("double") / 2.0**63
    unit = F.col("share") / F.col("pivot")
    offered = made.shares.groupBy(linking.PLACE).agg(*(F.sum(unit * mark("provider", k)).alias(f"s{k}") for k in ks), F.sum(F.abs(unit)).alias("size"))
    part = F.col("residual") * F.col("per")
    sums = made.loads.join(offered, linking.PLACE).groupBy(F.col("consumer").alias("col_idx")).agg(*(F.sum(part * F.col(f"s{k}")).alias(f"s{k}") for k in ks), F.sum(F.abs(part) * F.col("size")).alias("size"))
    zero = F.lit(0.0)
    rows = columns.join(sums, "col_idx", "left").select("col_idx", (1 + F.coalesce("size", zero)).alias("size"), *((mark("row_idx", k) + F.coalesce(f"s{k}", zero)).alias(f"s{k}") for k in ks))
    rows = written(rows.withColumn("finite", F.col("size") < 1e300))  # a size bounds its sums; NaN is above all
    size = rows.where("finite").agg(F.coalesce(F.max("size"), F.lit(1.0))).first()[0]
    tolerance = 4 * eps * (made.shares.select("provider").distinct().count() + 2) * size
    width = 1024 * tolerance
    cells = rows.where("finite")
    for k in ks:  # values within the tolerance share a cell, as each is put where it is and where the tolerance would bring it
        at = [F.floor((F.col(f"s{k}") + x) / width) for x in (0.0, tolerance)]
        cells = cells.withColumn(f"c{k}", F.explode(F.array_distinct(F.array(*at))))
    key = [f"c{k}" for k in ks]
    shared = cells.groupBy(key).agg(F.count("*").alias("k")).where("k > 1")
    return cells.join(shared, key, "left_semi").select("col_idx").unionByName(rows.where("not finite").select("col_idx")).distinct()


def structure(made: linking.Factored, columns: DataFrame, n: int, eps: float = 1e-12) -> DataFrame:
    """Places of the diagonal of M = I - A next to zero, and groups of its columns that are equal, by A's factors.

    ``columns`` (col_idx, row_idx) are M's columns, each with the row of its one. Only entries of columns that are near another are made; these are compared entry by entry.
    """
    own = made.own().groupBy(F.col("idx").alias("id")).agg(F.sum("value").alias("value"))
    zero = columns.sparkSession.range(n).join(own, "id", "left").where(F.abs(1 - F.coalesce("value", F.lit(0.0))) <= eps)
    near = written(_near(made, columns, eps))
    asked = linking.Factored(made.loads.join(near.withColumnRenamed("col_idx", "consumer"), "consumer", "left_semi"), made.shares)
    entries = linking.activities(asked.pairs()).select("row_idx", "col_idx", (-F.col("value")).alias("value"))
    ones = columns.join(near, "col_idx", "left_semi").select("row_idx", "col_idx", F.lit(1.0).alias("value"))
    m = linear.merged(entries.unionByName(ones), 0.0).where(F.abs("value") > eps)
    entry = F.concat_ws(":", "row_idx", F.round(F.col("value"), 12))
    groups = multisets.classes(written(multisets.counted(m, "col_idx", entry)))
    equal = groups.groupBy("first").agg(F.count("*").alias("k")).where("k > 1")
    return zero.agg(F.lit("zero_or_near_zero_diagonal").alias("code"), F.count("*").alias("found")).unionByName(equal.agg(F.lit("duplicate_sparse_columns").alias("code"), F.count("*").alias("found")))


def probe(model: linear.Prepared, targets: list[int], limit: int, factors: int, require_factors: bool = True) -> tuple[str | None, int, int]:
    """Solves a unit of each target (at most ``limit``): the first blocker's code, targets solved, values that are not finite."""
    wanted = sorted(set(targets))
    inside = [t for t in wanted if 0 <= t < model.n][:limit]
    code = None
    if require_factors and not factors:
        code = "lcia_factor_missing_for_impact_submit"
    elif not wanted or len(wanted) > limit or any(not 0 <= t < model.n for t in wanted):
        code = "target_process_not_covered_by_probe"
    if not inside:
        return code, 0, 0
    y = model.m.sparkSession.createDataFrame([(t, t, 1.0) for t in inside], linear.VECTORS)
    found = model.solve(y, x=True, g=True)
    bad = found["x"].unionByName(found["g"]).agg(F.count_if(F.isnan("value") | (F.abs("value") == float("inf")))).first()[0]
    return code or ("target_probe_non_finite_result" if bad else None), len(inside), bad


def suspicion(comment: Column, flow: Column, quantity: Column, small: str = "PM0.2", particle: str = "particle") -> Column:
    """The first suspicion that holds of an output: a count of particles on a flow of mass, or a flow that is named like one of particles."""
    has = lambda c, t: F.coalesce(c.ilike(f"%{t}%"), F.lit(False))
    return F.when(has(comment, "PN") & has(quantity, "mass"), "pn_comment_but_mass_flow").when(has(flow, small), "pm02_flow_hit").when(has(flow, particle), "particle_flow_hit")
