"""Reading tables and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Where that is unset, a local master gets a folder of its own for the session; a cluster has none that all
    executors see, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lca/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder: computed once, lineage cut."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def page(rows: DataFrame, keys: list[str], after: tuple | None = None, limit: int = 1000) -> DataFrame:
    """The next ``limit`` rows in the order of ``keys`` after a row's key values: a keyset page, which skips nothing by counting."""
    if after is not None:
        later = F.lit(False)
        for key, value in reversed(list(zip(keys, after, strict=True))):
            later = (F.col(key) > F.lit(value)) | ((F.col(key) == F.lit(value)) & later)
        rows = rows.where(later)
    return rows.orderBy(*keys).limit(limit)


def pages(rows: DataFrame, keys: list[str], limit: int = 1000):
    """All keyset pages, one after the other; the driver sees the last key of each page alone."""
    after = None
    while True:
        part = page(rows, keys, after, limit)
        last = part.orderBy(*(F.desc(k) for k in keys)).select(*keys).first()
        if last is None:
            return
        yield part
        after = tuple(last)


def running(rows: DataFrame, keys: list[str], weight: str, name: str) -> DataFrame:
    """Rows with the sum of ``weight`` over those before them in the order of ``keys``, which have to be unique, without a task that sees all.

    Rows are dealt by ranges of the keys and summed by part; within a part the sum runs on from those before it. The driver
    sees one sum for each part.
    """
    spark = rows.sparkSession
    parts = written(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("__part", F.spark_partition_id()))
    before, at = [], 0
    for part, k in sorted(tuple(r) for r in parts.groupBy("__part").agg(F.sum(weight)).collect()):
        before.append((part, at))
        at += k
    starts = F.broadcast(spark.createDataFrame(before, "__part int, __before long"))
    own = F.sum(weight).over(W.partitionBy("__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1))
    return parts.withColumn("__own", F.coalesce(own, F.lit(0))).join(starts, "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def numbered(rows: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """Rows with their place (from 0) in the order of ``keys``, which have to be unique."""
    return running(rows.withColumn("__one", F.lit(1)), keys, "__one", name).drop("__one")
