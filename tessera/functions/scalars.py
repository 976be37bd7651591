"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def signed(direction: Column, amount: Column) -> Column:
    """Input counts negative, Output positive; anything else, or an amount that is not finite, is null."""
    sign = F.when(direction == "Input", -1.0).when(direction == "Output", 1.0)
    return F.when(~F.isnan(amount) & (F.abs(amount) != float("inf")), sign * amount)


def scale(pivot: Column) -> Column:
    """What brings a reference to +1 or -1; null for zero."""
    return F.when(pivot != 0, 1 / F.abs(pivot))


def number(text: Column) -> Column:
    """Decimal text, trimmed, as a finite number; anything else, a percent sign included, is null."""
    t = F.trim(text)
    x = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    return F.when(F.abs(x) != float("inf"), x)


def fraction(text: Column) -> Column:
    """A percentage without a percent sign, divided by 100; null unless a finite number."""
    return number(text) / 100


def clean_amount(text: Column) -> Column:
    """Amount text without spaces, no-break spaces and commas."""
    return F.regexp_replace(text, "[\\u00a0, ]", "")


def version_key(version: Column) -> Column:
    """Comparable numbers of a dotted version; null if a part is not a number."""
    parts = F.split(version, "\\.")
    return F.when(version.rlike(r"^\d+(\.\d+){2}$"), F.transform(parts, lambda p: p.cast("int")))


def normal_version(version: Column) -> Column:
    """NN.NN.NNN; text that is not a version stays."""
    p = F.split(version, "\\.")
    padded = F.concat_ws(".", F.lpad(p[0], 2, "0"), F.lpad(p[1], 2, "0"), F.lpad(p[2], 3, "0"))
    return F.when(version.rlike(r"^\d{1,2}\.\d{1,2}\.\d{1,3}$"), padded).otherwise(version)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def weight(volume: Column) -> Column:
    """A volume as a weight: 1 unless finite and positive."""
    return F.when((volume > 0) & ~F.isnan(volume) & (volume != float("inf")), volume).otherwise(1.0)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places; null for a whole of zero."""
    return F.round(100 * part / F.when(whole != 0, whole), 2)


def is_number(text: Column) -> Column:
    """Whether text is a finite number without a percent sign; null text is not."""
    return number(text).isNotNull()


def direction(text: Column) -> Column:
    """Input or Output from their usual spellings, else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("in", "input"), "Input").when(t.isin("out", "output"), "Output")


def unit_hint(text: Column) -> Column:
    """The second item, by commas, inside the first parentheses; null if there is none."""
    return F.trim(F.get(F.split(F.regexp_extract(text, r"\(([^)]*)\)", 1), ","), F.lit(1)))


def root(text: Column) -> Column:
    """id and version of ``id@version``; without @ the version is null."""
    parts = F.split(text, "@", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("version"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null for a whole of zero."""
    return F.try_divide(part, whole)


def uuid(kind: int, number: Column) -> Column:
    """An id in the form of a UUID from a kind and a number, for tables that have numbers alone."""
    return F.format_string("%08x-0000-4000-8000-%012x", F.lit(kind), number.cast("long"))


def flow_space(kind: Column) -> Column:
    """Where a flow of a type goes: products and wastes to the technosphere, elementary ones to the biosphere, others are reported."""
    t = F.lower(kind)
    return F.when(t.startswith("product") | t.startswith("waste"), "technosphere").when(t.startswith("elementary"), "biosphere").otherwise("reporting")


def boundary(text: Column) -> Column:
    """A technosphere boundary policy; null if it is none of the three."""
    return F.when(text.isin("closed", "open", "cutoff"), text)


def full_share(text: Column) -> Column:
    """Whether a share is the whole: the number 100, or exactly the text 100%."""
    return F.coalesce((text == "100%") | (number(text) == 100), F.lit(False))


def localized(json: Column) -> Column:
    """A text from its forms: plain, one object, or an array of which the one in Chinese comes first, then English, then any."""
    t = F.trim(json)
    many = F.from_json(F.when(t.startswith("["), t), "array<map<string,string>>")
    lang = lambda code: F.get(F.filter(many, lambda m: m["@xml:lang"] == code), F.lit(0))["#text"]
    any_ = F.coalesce(lang("zh"), lang("en"), F.get(many, F.lit(0))["#text"])
    out = F.trim(F.when(t.startswith("["), any_).when(t.startswith("{"), F.get_json_object(t, "$['#text']")).otherwise(t))
    return F.when(out != "", out)


def flow_direction(text: Column, is_reference: Column) -> Column:
    """The direction that a text names somewhere; without one a reference goes out and any other exchange in."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("output"), "Output").when(t.contains("input"), "Input").otherwise(F.when(is_reference, "Output").otherwise("Input"))


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1: by numbers where both are versions, else as normalised texts."""
    a, b = version_key(left), version_key(right)
    s, t = normal_version(left), normal_version(right)
    both = a.isNotNull() & b.isNotNull()
    return F.when(F.when(both, a < b).otherwise(s < t), -1).when(F.when(both, a > b).otherwise(s > t), 1).otherwise(0)


#: The categories of datasets by the names of their types.
CATEGORIES = {
    "contact data set": "contacts",
    "flow data set": "flows",
    "flow property data set": "flowproperties",
    "lcia method data set": "lciamethods",
    "lifecycle model data set": "lifecyclemodels",
    "life cycle model data set": "lifecyclemodels",
    "process data set": "processes",
    "source data set": "sources",
    "unit group data set": "unitgroups",
}


def category(kind: Column) -> Column:
    """The category of a dataset type, in any case and spacing, with or without "data set"; null for others."""
    t = F.trim(F.regexp_replace(F.lower(F.regexp_replace(kind, "([a-z])([A-Z])", "$1 $2")), r"\s+", " "))
    t = F.regexp_replace(F.concat(F.regexp_replace(t, " data set$", ""), F.lit(" data set")), "^life cycle", "lifecycle")
    names = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return F.try_element_at(names, t)


#: Ends of the paths, in lower case, at which a document names who and what it is administered by.
ADMINISTRATIVE = (
    "referencetocommissioner",
    "referencetocompliancesystem",
    "referencetocontact",
    "referencetoconvertedoriginaldatasetfrom",
    "referencetodatahandlingprinciples",
    "referencetodatasetformat",
    "referencetodatasetuseapproval",
    "referencetodatasource",
    "referencetoentitieswithexclusiveaccess",
    "referencetolcamethoddetails",
    "referencetologo",
    "referencetoownershipofdataset",
    "referencetopersonorentityenteringthedata",
    "referencetopersonorentitygeneratingthedataset",
    "referencetoregistrationauthority",
    "referencetotechnologyflowdiagrammorpicture",
    "referencetotechnologypictogramme",
    "referencetounchangedrepublication",
)


def reference_role(source: Column, target: Column, path: Column) -> Column:
    """What a reference between documents is for; ``unknown`` for a flow or process at a path that tells nothing."""
    p = F.lower(path)
    process = source == "processes"
    lineage = p.rlike("referenceto(precedingdatasetversion|replaceddataset|originaldataset)")
    composed = p.contains("referencetoincludedprocess") | ((source == "lifecyclemodels") & (p.contains("referenceto") | (target == "processes")))
    out = F.when(process & (target == "flows") & p.contains("exchange") & p.endswith("referencetoflowdataset"), "exchange_flow")
    out = out.when((source == "lciamethods") & (target == "flows") & p.rlike("characteri[sz]ation"), "required_support")
    out = out.when(lineage, "lineage").when(composed, "model_composition").when(p.rlike("(" + "|".join(ADMINISTRATIVE) + ")$"), "administrative_support")
    out = out.when(process & (target == "processes") & p.rlike("provider|referenceprocess"), "provider_process")
    return out.when(target.isin("flows", "processes"), "unknown").otherwise("required_support")


def reference_action(role: Column, purpose: str) -> Column:
    """What is done with a reference: a certificate follows all of them, a calculation only those that it needs."""
    if purpose == "certificate_closure":
        return F.lit("traverse_administrative")
    out = F.when(role == "exchange_flow", "validate_exchange_axis").when(role == "provider_process", "validate_provider_invariant")
    return out.when(role == "required_support", "fetch_required_support").when(role == "administrative_support", "fetch_optional_support").when(role.isin("lineage", "model_composition"), "record_evidence")


def is_uuid(text: Column) -> Column:
    """Whether text is a lower-case UUID of versions 1 to 5."""
    return F.coalesce(text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def is_version(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9]{2}\.[0-9]{2}(\.[0-9]{3})?$"), F.lit(False))


def cluster(levels: Column, level: int) -> Column:
    """(id, label) of a category path's first levels; a path without any is uncategorized."""
    levels = F.filter(levels, lambda x: F.trim(x) != "")
    label = F.array_join(F.transform(F.slice(levels, 1, level), lambda x: F.trim(x)), " / ")
    label = F.when(F.coalesce(F.size(levels), F.lit(0)) > 0, label).otherwise("uncategorized")
    id_ = F.when(slug(label) != "", slug(label)).otherwise("uncategorized")
    return F.struct(id_.alias("id"), label.alias("label"))


def region_key(location: Column, known: list[str]) -> Column:
    """The country of a location that a map knows: China's provinces count as China, UK is GB, macro-regions are none."""
    t = F.upper(F.trim(location))
    code = F.split_part(t, F.lit("-"), F.lit(1))
    code = F.when(code == "UK", "GB").otherwise(code)
    return F.when(code.rlike("^[A-Z]{2}$") & code.isin([*known, "CN"]), code)


def province(location: Column, known: list[str]) -> Column:
    code = F.split_part(F.upper(F.trim(location)), F.lit("-"), F.lit(2))
    return F.when(F.upper(F.trim(location)).startswith("CN-") & code.isin(known), code)


def link_id(scope: str, flow: Column, source: Column, target: Column) -> Column:
    """The id of a link between two processes over a flow: twenty digits of a hash over its parts, parted by a zero byte."""
    digest = F.sha2(F.concat_ws("\x00", F.lit(scope), flow, source, target), 256)
    return F.concat(F.lit(f"process-link:{scope}:"), F.substring(digest, 1, 20))


def hash_unit(text: Column, salt: int) -> Column:
    """A number from 0 to 1 by the low 32 bits of an FNV-1a hash of the text's bytes."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(F.hex(F.encode(text, "utf-8")), 2 * i - 1, 2), 16, 10).cast("long"))
    start = F.lit((0xCBF29CE484222325 ^ salt) & 0xFFFFFFFF).cast("long")
    # The prime's low half is 0x1B3, so no step leaves 64 bits.
    return F.when(F.octet_length(text) > 0, F.aggregate(codes, start, lambda h, c: h.bitwiseXOR(c) * 0x1B3 % (1 << 32))).otherwise(start) / 0xFFFFFFFF


def morton(x: Column, y: Column, bits: int = 10) -> Column:
    """The bits of two numbers in turn, from the lowest: places close by in the plane get keys close by."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out + F.shiftleft(F.shiftright(x, b).bitwiseAND(1), 2 * b) + F.shiftleft(F.shiftright(y, b).bitwiseAND(1), 2 * b + 1)
    return out
