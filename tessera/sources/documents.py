"""Process documents (JSON texts) as exchanges, references, allocations and residuals.

All of it is projections of one document's row: a document's exchanges are an array of maps, what they have in common
(ids, the reference, its pivot) is taken from that array, and only then are they exploded. Nothing is shuffled.

Rules. The calculation amount is that of the first key present of ``AMOUNTS``, even if its value is null. A reference
must name exactly one exchange, with a known direction and a finite amount other than zero. An allocation is a
share of the reference: 1 where none is declared or it is an empty object, 0 where a closed vector leaves the
reference out; a vector with unknown or repeated targets, bad percentages or a sum other than 100 % is an error. One
entry without a target counts only if it is a full one and the reference is unique. Texts that are not JSON and null
texts have no exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn

#: Fixed values of the document format: keys of the amount in order, and the tolerance of an allocation's sum.
AMOUNTS = ("resultingAmount", "meanAmount", "meanValue")
TOLERANCE = 0.000010000001
TARGET, SHARE = "@internalReferenceToCoProduct", "@allocatedFraction"

_MAPS = "array<map<string,string>>"


def _items(text: Column) -> Column:
    """Objects of a JSON array, or of the one object that stands for an array."""
    return F.from_json(F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).when(text.startswith("["), text), _MAPS)


def _amount(m: Column) -> Column:
    first = F.when(F.lit(False), F.lit(None).cast("string"))
    for key in AMOUNTS:
        first = first.when(F.map_contains_key(m, key), F.element_at(m, key))
    return fn.number(first)


def _signed(m: Column) -> Column:
    return fn.signed(fn.direction(m["exchangeDirection"]), _amount(m))


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are evaluated once for each row, however often filters and other columns use them: no expression is moved across a generator."""
    return df.select("*", F.inline_outer(F.array(F.struct(*columns))))


def processes(docs: DataFrame) -> DataFrame:
    """(id, version, items, ids, reference, n_references, pivot) of documents (id, version, json).

    ``pivot`` is the signed amount of the reference; null unless the reference is valid.
    """
    items, reference = _items(F.get_json_object("json", "$.processDataSet.exchanges.exchange")), F.get_json_object("json", "$.processDataSet.processInformation.quantitativeReference.referenceToReferenceFlow")
    d = _once(docs.select("id", "version", "json"), items.alias("all"), reference.alias("r"))
    many = F.from_json(F.when(F.col("r").startswith("["), F.col("r")), "array<string>")
    one = F.when(F.col("r").startswith("["), F.when(F.size(many) == 1, F.get(many, F.lit(0)))).otherwise(F.col("r"))
    d = _once(d, F.filter(F.coalesce("all", F.array().cast(_MAPS)), lambda m: m.isNotNull()).alias("items"), F.trim(one).alias("reference"))
    named = F.filter("items", lambda m: F.trim(m["@dataSetInternalID"]) == F.col("reference"))
    d = _once(d, F.transform("items", lambda m: F.trim(m["@dataSetInternalID"])).alias("ids"), named.alias("named"))
    d = _once(d, F.size("named").alias("n_references"), F.when(F.size("named") == 1, _signed(F.get("named", F.lit(0)))).alias("p"))
    return d.select("id", "version", "items", "reference", "ids", "n_references", F.when(F.col("p") != 0, F.col("p")).alias("pivot"))


def _allocation(text: Column, raw: Column, entries: Column, declared: Column, reference: Column, ids: Column, n_references: Column) -> Column:
    """(share, kind) of an exchange's allocations: their text, its list, the entries of this and whether there are any; the share of an error is null."""

    def share(e: Column) -> Column:
        x = fn.number(e[SHARE])
        return F.when(x.between(0, 100), x / 100)

    only = F.get(entries, F.lit(0))
    bare = (F.size(entries) == 1) & ~F.map_contains_key(only, TARGET)
    full = (n_references == 1) & ((F.trim(only[SHARE]) == "100%") | (share(only) == 1))
    to = F.transform(entries, lambda e: F.trim(e[TARGET]))
    known = F.forall(entries, lambda e: F.coalesce(F.array_contains(ids, F.trim(e[TARGET])) & (F.trim(e[TARGET]) != "") & share(e).isNotNull(), F.lit(False)))
    unique = F.size(F.array_distinct(to)) == F.size(to)
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + share(e))
    mine = F.transform(F.filter(entries, lambda e: F.trim(e[TARGET]) == reference), share)
    # A target is a text; as a number it names nothing.
    texts = F.from_json(F.when(raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]"))).when(raw.startswith("["), raw), "array<string>")
    named = F.forall(texts, lambda t: F.coalesce(t.rlike(f'"{TARGET}"\\s*:\\s*"'), F.lit(False)))
    good = (F.size(entries) > 0) & known & named & unique & (F.abs(total - 1) <= TOLERANCE)

    def kind(name: str, value: Column | float | None) -> Column:
        return F.struct((value if isinstance(value, Column) else F.lit(value)).cast("double").alias("share"), F.lit(name).alias("kind"))

    out = F.when(~declared, kind("undeclared", 1.0)).when(raw == "{}", kind("empty", 1.0))
    out = out.when(bare & full, kind("inferred", 1.0)).when(bare, kind("error", None))
    out = out.when(good & (F.size(mine) == 1), kind("explicit", F.get(mine, F.lit(0)))).when(good, kind("sparse", 0.0))
    return out.otherwise(kind("error", None))


def exchanges(docs: DataFrame) -> DataFrame:
    """One row per exchange, with its signed amount, its allocation and its process's reference and pivot."""
    p = processes(docs).select("*", F.explode("items").alias("m"))
    m, text, raw = F.col("m"), F.col("text"), F.col("raw")
    p = _once(p, m["allocations"].alias("text"), F.map_contains_key(m, "allocations").alias("declared"), m["referenceToFlowDataSet"].alias("flow"))
    p = _once(p, F.when(text.startswith("{"), F.get_json_object(text, "$.allocation")).alias("raw"))
    p = _once(p, _items(raw).alias("entries"))
    allocation = _allocation(text, raw, F.col("entries"), F.col("declared"), F.col("reference"), F.col("ids"), F.col("n_references"))
    p = _once(p, fn.direction(m["exchangeDirection"]).alias("direction"), _amount(m).alias("amount"), F.trim(m["@dataSetInternalID"]).alias("exchange_id"), allocation.alias("allocation"))
    out = ("id", "version", "reference", "n_references", "pivot", "exchange_id", "direction")
    flow = F.get_json_object("flow", "$['@refObjectId']").alias("flow_id"), F.get_json_object("flow", "$['@version']").alias("flow_version")
    return p.select(*out, *flow, "amount", m["location"].alias("location"), "allocation.share", F.col("allocation.kind").alias("allocation_kind"))


def residuals(e: DataFrame) -> DataFrame:
    """Normalised residual coefficients of the exchanges that are not the reference; errors and shares of zero give none."""
    raw = fn.signed(F.col("direction"), F.col("amount"))
    rest = e.where((F.col("exchange_id") != F.col("reference")) & F.col("pivot").isNotNull() & (F.col("share") > 0))
    rest = _once(rest, (raw * fn.scale(F.col("pivot")) * F.col("share")).alias("residual")).where("residual is not null")
    return rest.select("id", "version", "exchange_id", "flow_id", "flow_version", "location", "residual")


def amount(m: Column) -> Column:
    """The calculation amount of an exchange, given as a map of its keys."""
    return _amount(m)


def first_path(json: Column, *paths: str) -> Column:
    """The value at the first of the paths that holds one."""
    return F.coalesce(*(F.get_json_object(json, p) for p in paths))


def finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def canonical(values: dict[str, Column]) -> Column:
    """JSON of an object with sorted keys; the values are JSON texts."""
    parts = [x for i, k in enumerate(sorted(values)) for x in (F.lit(("," if i else "{") + f'"{k}":'), values[k])]
    return F.concat(*parts, F.lit("}"))


def vector_fault(entries: Column, known: Column) -> Column:
    """What is wrong with an allocation vector of (target, share): out_of_range, unknown_target, duplicate, sum, or ok."""
    share = lambda e: fn.number(e["share"])
    to = F.transform(entries, lambda e: F.trim(e["target"]))
    outside = F.exists(entries, lambda e: ~F.coalesce(share(e).between(0, 100), F.lit(False)))
    unknown = F.exists(to, lambda t: ~F.coalesce(F.array_contains(known, t), F.lit(False)))
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + share(e) / 100)
    out = F.when(outside, "out_of_range").when(unknown, "unknown_target").when(F.size(F.array_distinct(to)) < F.size(to), "duplicate")
    return out.when(F.abs(total - 1) > TOLERANCE, "sum").otherwise("ok")


def allocated(exchanges: DataFrame) -> DataFrame:
    """Exchanges whose share of the reference is known and not zero."""
    return exchanges.where(F.col("share") > 0)
