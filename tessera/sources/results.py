"""Stored impacts of all unit demands, in chunks of processes, and what is asked of them.

A chunk is a folder of ``SIZE`` processes, sorted by process and impact, so a query for a process opens one folder and one
for an impact reads the columns' statistics. What is not stored is solved, if the query allows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 256
SCHEMA = "process_idx int, impact int, amount double, chunk bigint"


def write(h: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Writes impacts (process_idx, impact, amount) and returns the index of what was written."""
    rows = h.select(F.col("process_idx").cast("int"), F.col("impact").cast("int"), "amount").withColumn("chunk", F.floor(F.col("process_idx") / size).cast("long"))
    rows.repartition("chunk").sortWithinPartitions("chunk", "process_idx", "impact").write.partitionBy("chunk").option("compression", "zstd").parquet(path)
    return index(read(h.sparkSession, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def index(rows: DataFrame) -> DataFrame:
    """One row per chunk: chunk, first and last process, records and a hash of its lines in any order."""
    from ..operators.multisets import digest

    content = digest(F.concat_ws(":", "process_idx", "impact", "amount"))
    return rows.groupBy("chunk").agg(F.min("process_idx").alias("first"), F.max("process_idx").alias("last"), F.count("*").alias("records"), content.alias("sha256"))


def check_coverage(found: DataFrame, n: int) -> None:
    """Fails unless the chunks' ranges cover n processes."""
    covered = found.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0))).first()[0]
    if covered != n:
        raise ValueError(f"the chunks cover {covered} processes, not {n}")


def of_process(spark: SparkSession, path: str, process: int, size: int = SIZE) -> DataFrame:
    """One process, all impacts: one folder is opened."""
    return read(spark, path).where((F.col("chunk") == process // size) & (F.col("process_idx") == process)).drop("chunk")


def of_impact(spark: SparkSession, path: str, impact: int, processes: list[int] | None = None, size: int = SIZE) -> DataFrame:
    """Many processes (all of them without a list), one impact."""
    rows = read(spark, path).where(F.col("impact") == impact)
    if processes is not None:
        rows = rows.where(F.col("chunk").isin(sorted({p // size for p in processes})) & F.col("process_idx").isin(processes))
    return rows.drop("chunk")


def ask(spark: SparkSession, path: str | None, processes: list[int], solve: Callable[[list[int]], DataFrame], impact: int | None = None, allow_fallback: bool = True, size: int = SIZE) -> DataFrame:
    """Impacts of processes with where they come from: all_unit (stored), or fallback_solve_one or fallback_solve_batch.

    ``solve`` gives (process_idx, impact, amount) for the processes that are not stored; without ``allow_fallback`` these
    are an error.
    """
    kind = "fallback_solve_one" if len(processes) == 1 else "fallback_solve_batch"
    stored = spark.createDataFrame([], "process_idx int, impact int, amount double")
    if path is not None:
        stored = read(spark, path).where(F.col("chunk").isin(sorted({p // size for p in processes})) & F.col("process_idx").isin(processes)).drop("chunk")
    there = {r.process_idx for r in stored.select("process_idx").distinct().collect()}
    missing = [p for p in processes if p not in there]
    if missing and not allow_fallback:
        raise KeyError(f"no result is stored for {missing}")
    out = stored.withColumn("source", F.lit("all_unit"))
    if missing:
        out = out.unionByName(solve(missing).select(F.col("process_idx").cast("int"), F.col("impact").cast("int"), "amount", F.lit(kind).alias("source")))
    return out if impact is None else out.where(F.col("impact") == impact)
