"""References between JSON documents: found wherever they are, typed, with their paths; and what is reached by them.

A reference is an object with ``@refObjectId``, or with ``@type`` and ``@uri`` or ``@version``. It names an id, a type (by
@type, else by the folder in @uri) and, or not, a version; what is wrong with one of these is an issue, and then there is no
edge. Documents are walked one by one where they lie; nesting costs no stack.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CATEGORIES
from .tables import numbered, written

FOUND = "category string, id string, version string, reference_key string, target_category string, target_id string, requested string, role string, json_path string, empty boolean, issue string"
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")
_VERSION = re.compile(r"[0-9]{2}\.[0-9]{2}(\.[0-9]{3})?")
_FOLDERS = set(CATEGORIES.values())


def _kind(value, uri) -> str | None:
    """The category by a type's name or, without a known one, by the folder of an address."""
    text = " ".join(str(value or "").lower().split())
    name = CATEGORIES.get(text) or CATEGORIES.get(f"{text} data set")
    if name is None and value is None:
        name = next((part for part in reversed(str(uri or "").split("/")[:-1]) if part in _FOLDERS), None)
    return name


def walk(source: str, value) -> list[tuple]:
    """(key, target category, id, version, role, path, empty, issue) of all references in a parsed document, in its order."""
    out, todo = [], [("", "$", value)]
    while todo:
        key, path, v = todo.pop()
        if isinstance(v, list):
            todo += [(key, f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
            continue
        if not isinstance(v, dict):
            continue
        todo += [(k, f"{path}.{k}", x) for k, x in reversed(v.items())]
        named = "referenceto" in key.lower()
        if not ("@refObjectId" in v or ("@type" in v and ("@uri" in v or "@version" in v)) or (named and not v)):
            continue
        lower = path.lower()
        role = "support_document"
        if source == "processes" and "exchange" in lower and lower.endswith("referencetoflowdataset"):
            role = "process_exchange_flow"
        elif source == "lciamethods" and "characterisationfactor" in lower:
            role = "lcia_factor_flow"
        id_, version, target = str(v.get("@refObjectId") or "").strip(), v.get("@version"), _kind(v.get("@type"), v.get("@uri"))
        version = str(version).strip() if version is not None else ""
        issues = []
        if not id_:
            issues.append("reference_object_id_missing")
        elif not _UUID.fullmatch(id_):
            issues.append("reference_object_id_invalid")
        if target is None:
            issues.append("reference_type_unresolved")
        if version and not _VERSION.fullmatch(version):
            issues.append("reference_version_invalid")
        out += [(key, target, id_ or None, version or None, role, path, not v, issue) for issue in issues or [None]]
    return out


def extracted(docs: DataFrame) -> DataFrame:
    """References of documents (category, id, version, json), one row for each edge or issue. Texts that are no JSON have none."""

    def f(batches):
        for b in batches:
            rows = []
            for source, id_, version, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    value = json.loads(text or "null")
                except ValueError:
                    continue
                rows += [(source, id_, version, *r) for r in walk(source, value)]
            names = [c.split()[0] for c in FOUND.split(", ")]
            kinds = [pa.bool_() if c.endswith("boolean") else pa.string() for c in FOUND.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select("category", "id", "version", "json").mapInArrow(f, FOUND)


def resolved(refs: DataFrame, docs: DataFrame, latest: bool = True) -> DataFrame:
    """Edges with the version they mean: the one asked for if it is there (null if not), without one the latest."""
    have = docs.select(F.col("category").alias("target_category"), F.col("id").alias("target_id"), "version")
    exact = have.select("target_category", "target_id", F.col("version").alias("requested"), F.col("version").alias("exact")).distinct()
    key = F.struct(F.coalesce(F.transform(F.split("version", r"\."), lambda p: p.try_cast("int")), F.array().cast("array<int>")), "version")
    last = have.groupBy("target_category", "target_id").agg(F.max_by("version", key).alias("last"))
    out = refs.where("issue is null").join(exact, ["target_category", "target_id", "requested"], "left").join(last, ["target_category", "target_id"], "left")
    newest = F.col("last") if latest else F.lit(None).cast("string")
    return out.withColumn("found", F.when(F.col("requested").isNotNull(), F.col("exact")).otherwise(newest)).drop("exact", "last")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) of all documents that roots reach over resolved edges (src, dst), roots included, cycles allowed."""
    seen = written(roots.select("node", F.lit(0).alias("depth")).distinct())
    e = written(edges.select("src", "dst").distinct())
    depth = 0
    while True:
        depth += 1
        front = seen.where(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
        new = written(e.join(front, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if not new.limit(1).count():
            return seen
        seen = seen.unionByName(new)


def affected(edges: DataFrame, sources: DataFrame, roots: DataFrame) -> DataFrame:
    """(source, root) for every root from which a source (a document with an issue) is reached, itself included.

    Sources are numbered, and a document holds those that it reaches as bits, 64 to a row. Each round sends the bits that are
    new one edge back and ors them, so a round has a row for each edge and 64 sources at most, cycles end by themselves, and sources are
    told apart again for roots alone.
    """
    e = written(edges.select("src", "dst").distinct())
    number = written(numbered(sources.select(F.col("node").alias("source")).distinct(), ["source"], "i"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("i", F.lit(64)).cast("int"))
    front = written(number.select(F.col("source").alias("node"), F.floor(F.col("i") / 64).alias("word"), bit.alias("bits")))
    front = seen = written(front.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    while True:
        back = front.join(e, front["node"] == e["dst"]).groupBy(F.col("src").alias("node"), "word").agg(F.bit_or("bits").alias("got"))
        fresh = F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))))
        front = written(back.join(seen, ["node", "word"], "left").select("node", "word", fresh.alias("bits")).where("bits <> 0"))
        if not front.limit(1).count():
            break
        seen = written(seen.unionByName(front).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    held = seen.join(roots.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("root"), "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    held = held.where(F.call_function("shiftrightunsigned", F.col("bits"), F.col("b")).bitwiseAND(F.lit(1)) == 1)
    return held.select("root", (F.col("word") * 64 + F.col("b")).alias("i")).join(number, "i").select("source", "root")


def provenance(refs: DataFrame, samples: int = 8) -> DataFrame:
    """Of evidence references: how many, a hash over all of them, some of them in order, and whether these are not all.

    The hash is one over the sorted hashes of parts, so that no task sorts all references.
    """
    line = F.concat_ws("|", "category", "id", "version", "json_path", "target_category", "target_id", F.coalesce("requested", F.lit("")), "role")
    rows = refs.select(line.alias("line")).distinct()
    parts = rows.groupBy(F.substring(F.sha2("line", 256), 1, 2).alias("part")).agg(F.count("*").alias("k"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    total = parts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("references"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))
    some = rows.orderBy("line").limit(samples).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("samples"))
    return total.crossJoin(F.broadcast(some)).withColumn("truncated", F.col("references") > samples)


