"""Characterisation factors: a bundle whose parts are checked by hash, size and count, and its index of factors.

The index is one JSON object: keys are a flow's id and a direction, values hold one factor or a list. It is read piece by piece,
however large it is: Spark's reader cuts the text at commas, and pieces are put together to records of the top level as
they come. No cell holds more than a record, and the object is never built.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTIONS = ("INPUT", "OUTPUT")
_RECORD = "struct<flow_id: string, flow_version: string, direction: string, factor: string>"


def entries(pieces: Iterator[str]) -> Iterator[str]:
    """The entries of the top level of JSON objects, each with its key, from a text cut at commas; objects may follow each other.

    A text that ends inside an object, or holds anything else, is an error.
    """
    depth, quoted, held, any_ = 0, False, [], False
    for piece in pieces:
        start, i = 0, 0
        while i < len(piece):
            c = piece[i]
            if quoted:
                i += c == "\\"
                quoted = c != '"'
            elif c == "{" and depth == 0:
                depth, start, any_ = 1, i + 1, True
            elif depth == 0:
                if not c.isspace():
                    raise ValueError("an index is an object")
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if depth == 0:
                    held.append(piece[start:i])
                    if "".join(held).strip():
                        yield ",".join(held)
                    held = []
            i += 1
        if i > len(piece):
            raise ValueError("an escape is cut off")
        if depth:
            held.append(piece[start:])
            if depth == 1 and not quoted:
                yield ",".join(held)
                held = []
    if depth or quoted or not any_:
        raise ValueError("an index is cut off")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(json) of each record of the indexes at a path, gzip or plain, an object of one entry; files are read as streams.

    A compressed file is one task's stream. A plain one must not be cut by ``spark.sql.files.maxPartitionBytes``, so larger ones have to be compressed.
    """

    def f(batches):
        def pieces():
            for b in batches:
                yield from b.column(0).to_pylist()

        out, size = [], 0
        for e in _objects(pieces()):
            out.append("{" + e + "}")
            size += len(e)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["json"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["json"])

    return spark.read.option("lineSep", ",").text(path).mapInArrow(f, "json string")


def _objects(pieces: Iterator[str]) -> Iterator[str]:
    """Entries of one object, or none if a task has no text at all."""
    for first in pieces:
        yield from entries(_chained(first, pieces))


def _chained(first: str, rest: Iterator[str]) -> Iterator[str]:
    yield first
    yield from rest


def parsed(index: DataFrame, json: str = "json") -> DataFrame:
    """(flow_id, direction, method, value) of an index's texts; a key that differs from its record, or a record without a factor, fails."""
    entries = index.select(F.explode(F.from_json(json, f"map<string, {_RECORD}>")).alias("key", "r"))
    text = F.trim(F.col("r.factor"))
    list_ = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<struct<key: string, value: string>>")
    direction = F.upper(F.col("r.direction"))
    good = (F.col("key") == F.concat_ws(":", "r.flow_id", direction)) & direction.isin(*DIRECTIONS) & (F.coalesce(F.size(list_), F.lit(0)) > 0) & (F.trim("r.flow_version") != "")
    checked = F.when(F.coalesce(good, F.lit(False)), list_).otherwise(F.raise_error(F.concat(F.lit("bad factor record "), "key")))
    rows = entries.select(F.col("r.flow_id").alias("flow_id"), direction.alias("direction"), F.explode(checked).alias("f"))
    value = F.col("f.value").try_cast("double")
    number = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value).otherwise(F.raise_error(F.concat(F.lit("bad factor value "), F.coalesce("f.value", F.lit("null")))))
    return rows.select("flow_id", "direction", F.col("f.key").alias("method"), number.alias("value"))


def cardinality(factors: DataFrame) -> DataFrame:
    """Entries, distinct (flow, direction) keys and duplicates of each method."""
    keys = factors.groupBy("method", "flow_id", "direction").agg(F.count("*").alias("k"))
    return keys.groupBy("method").agg(F.sum("k").alias("entries"), F.count("*").alias("distinct_keys")).withColumn("duplicates", F.col("entries") - F.col("distinct_keys"))


def verify(found: DataFrame, manifest: DataFrame, files: DataFrame, expected: DataFrame) -> DataFrame:
    """The factors' cardinalities, if files (name, length, sha256) and cardinalities are those that a manifest states; else an error."""
    from .artifacts import check_files

    check_files(files, expected)
    counts = cardinality(found)
    both = counts.withColumn("f", F.lit(True)).join(manifest.withColumn("m", F.lit(True)), ["method", "entries", "distinct_keys", "duplicates"], "full")
    if bad := both.where("f is null or m is null").select("method").first():
        raise ValueError(f"the factors of {bad.method} are not those of the manifest")
    return counts


def coverage(factors: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Counts by method of exchange keys (flow_id, direction, amount) that have a factor (matched), none (unmatched), no valid amount
    (invalid), or a direction that factors do not know (unsupported_direction); each method has as many in all."""
    keys = exchanges.groupBy("flow_id", "direction").agg(F.bool_and(F.col("amount").isNotNull()).alias("valid"))
    known = F.col("direction").isin(*DIRECTIONS)
    total = keys.agg(F.count_if(known & F.col("valid")).alias("usable"), F.count_if(known & ~F.col("valid")).alias("invalid"), F.count_if(~known).alias("unsupported_direction"))
    hits = factors.select("method", "flow_id", "direction").distinct().join(keys.where(known & F.col("valid")), ["flow_id", "direction"], "left")
    by = hits.groupBy("method").agg(F.count("valid").alias("matched"))
    return by.crossJoin(F.broadcast(total)).select("method", "matched", (F.col("usable") - F.col("matched")).alias("unmatched"), "invalid", "unsupported_direction")


def catalog(files: DataFrame) -> DataFrame:
    """Paths of classification catalogs (system, json): (system, data_type, level, ids, names), one row for each category.

    Each level is exploded from the one above, down to where there is none.
    """
    shape = "array<struct<`@id`: string, `@name`: string, category: string>>"
    array = lambda c: F.when(F.trim(c).startswith("["), F.trim(c)).otherwise(F.concat(F.lit("["), F.trim(c), F.lit("]")))
    groups = F.from_json(array(F.get_json_object("json", "$.CategorySystem.categories")), "array<struct<`@dataType`: string, category: string>>")
    level = files.select("system", F.explode(groups).alias("g")).select("system", F.coalesce("g.`@dataType`", F.lit("Flow")).alias("data_type"), F.col("g.category").alias("rest"), F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("names"))
    out = None
    for depth in range(1, 33):
        here = level.where("rest is not null").select("system", "data_type", "ids", "names", F.explode(F.from_json(array(F.col("rest")), shape)).alias("c")).where("c.`@name` is not null")
        slug = F.regexp_replace(F.lower("c.`@name`"), "[^a-z0-9]+", "-")
        level = here.select("system", "data_type", F.col("c.category").alias("rest"), F.concat("ids", F.array(F.coalesce("c.`@id`", slug))).alias("ids"), F.concat("names", F.array(F.trim("c.`@name`"))).alias("names"))
        part = level.select("system", "data_type", F.lit(depth).alias("level"), "ids", "names")
        out = part if out is None else out.unionByName(part)
        if not level.where("rest is not null").limit(1).count():
            return out
    raise ValueError("a catalog is deeper than 32 levels")


def lookup(rows: DataFrame, paths: DataFrame, system: str, data_type: str, ids: str, names: str) -> DataFrame:
    """Rows with the catalog's names (found) for their path, by ids first and by names else; null where it has neither."""
    table = paths.where((F.col("system") == system) & (F.col("data_type") == data_type))
    by = lambda c: table.groupBy(F.array_join(c, "\x1f").alias(f"k_{c}")).agg(F.min(F.array_join("names", " / ")).alias(f"f_{c}"))
    out = rows.join(by("ids"), F.array_join(ids, "\x1f") == F.col("k_ids"), "left").join(by("names"), F.array_join(names, "\x1f") == F.col("k_names"), "left")
    return out.withColumn("found", F.coalesce("f_ids", "f_names")).drop("k_ids", "k_names", "f_ids", "f_names")
