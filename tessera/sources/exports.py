"""Chunked bundles with a manifest, and line files that are read against what their descriptor says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def chunked(df: DataFrame, key: str, size: int = 256) -> DataFrame:
    """The rows with ``chunk``, the number of their run of ``size`` keys."""
    return df.withColumn("chunk", F.floor(F.col(key) / size).cast("long"))


def manifest(df: DataFrame, key: str, size: int = 256) -> DataFrame:
    """One row per chunk: chunk, rows, first, last and a digest that does not depend on the rows' order or partitions.

    The digest is the sum of the rows' hashes as a decimal, so it is added up on the map side, and repeated rows count.
    """
    rows = chunked(df, key, size)
    digest = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))
    return rows.groupBy("chunk").agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), F.sha2(digest.cast("string"), 256).alias("digest"))


def missing_chunks(found: DataFrame, n: int, size: int = 256) -> DataFrame:
    """Chunks of ``n`` keys that a manifest lacks."""
    return found.sparkSession.range(-(-n // size)).select(F.col("id").alias("chunk")).join(found.select("chunk"), "chunk", "left_anti")


def write_bundle(df: DataFrame, path: str, key: str, size: int = 256) -> DataFrame:
    """Writes the rows as Parquet in one folder per chunk, sorted by key, and returns the manifest of what was written."""
    spark = df.sparkSession
    chunked(df, key, size).repartition("chunk").sortWithinPartitions("chunk", key).write.partitionBy("chunk").option("compression", "zstd").parquet(path)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return manifest(spark.read.schema(f"{kind}, chunk bigint").parquet(path).select(*df.columns), key, size)


def read_lines(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """JSON lines (plain or gzip). A line that is not JSON fails the read; so does a count other than ``rows``."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{path} holds {n} rows, not {rows}")
    return df


def upserted(stored: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order`` of what is stored and new. It is aggregated, so a hot key is combined first."""
    rows = stored.unionByName(new)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return last.select("row.*")


def impact_axis(axis: DataFrame, default: str | None = None) -> DataFrame:
    """The axis (impact_index, impact_id, impact_key) with ``is_default``: the impact of that id or key, the first one without any."""
    wanted = (F.col("impact_id") == default) | (F.col("impact_key") == default) if default else F.col("impact_index") == 0
    out = axis.withColumn("is_default", wanted)
    if not out.where("is_default").limit(1).count():
        raise ValueError(f"the axis has no impact {default or 0}")
    return out


def content_manifest(rows: DataFrame, key: str, line: str, size: int = 256) -> DataFrame:
    """One row per chunk: chunk, rows, first, last and a hash of the multiset of its lines; sums, so no chunk is gathered."""
    from ..operators.multisets import digest

    return chunked(rows, key, size).groupBy("chunk").agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), digest(F.col(line)).alias("sha256"))


def fingerprint(rows: DataFrame, modified: str, config: dict) -> DataFrame:
    """(k, fingerprint) of a source: its count, its last change and the configuration that it is built with."""
    from .artifacts import canonical

    text = F.concat_ws("|", F.count("*").cast("string"), F.date_format(F.max(modified), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(canonical(config).decode()))
    return rows.agg(F.count("*").alias("k"), F.sha2(text, 256).alias("fingerprint"))


def axis_faults(axis: DataFrame, certified: DataFrame) -> DataFrame:
    """(id, fault) where two numbered axes (id, idx) differ: not_in_axis, not_certified, or moved to another place."""
    both = axis.select("id", F.col("idx").alias("i")).join(certified.select("id", F.col("idx").alias("j")), "id", "full")
    fault = F.when(F.col("i").isNull(), "not_in_axis").when(F.col("j").isNull(), "not_certified").when(F.col("i") != F.col("j"), "moved")
    return both.select("id", fault.alias("fault")).where("fault is not null")


def binding(snapshot: Column, result: Column) -> Column:
    """Whether a result's evidence (JSON) is its snapshot's, whatever the order of keys: none, missing_binding, unbound_snapshot, differs, bound."""
    same = F.to_json(F.parse_json(snapshot)) == F.to_json(F.parse_json(result))
    return F.when(snapshot.isNull() & result.isNull(), "none").when(result.isNull(), "missing_binding").when(snapshot.isNull(), "unbound_snapshot").when(same, "bound").otherwise("differs")


def write_together(tables: dict[str, DataFrame], path: str, bundle: str) -> None:
    """Writes tables as one bundle: its mark comes last, and without it no reader sees any of them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/data/{bundle}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(bundle,)], "bundle string").write.mode("overwrite").parquet(f"{path}/marks/{bundle}")


def read_together(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(bundle, part, rows) of the bundles that are whole."""
    marks = [r.bundle for r in spark.read.parquet(f"{path}/marks/*").select("bundle").distinct().collect()]
    parts = [spark.read.parquet(f"{path}/data/{b}/{name}").agg(F.lit(b).alias("bundle"), F.lit(name).alias("part"), F.count("*").alias("rows")) for b in sorted(marks) for name in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
