"""Points in the plane stored so that a view of a part of it opens few files.

Points are dealt into files by ranges of their Morton key, so a file covers a compact piece of the plane. An index beside them holds each
file's box and count; a view reads the index, then the files whose boxes it touches, and nothing of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import morton

#: Bits of each coordinate in a key; points of a file, about.
BITS, POINTS = 16, 100_000


def write(points: DataFrame, path: str, x: str = "x", y: str = "y", size: int = POINTS) -> DataFrame:
    """Writes points and returns the index: file, points, and the box x0, x1, y0, y1. Points without a place are left out."""
    spark = points.sparkSession
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    box = placed.agg(F.count("*").alias("k"), *(f(c).alias(f"{n}{i}") for i, c in enumerate((x, y)) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cell = lambda c, lo, hi: F.floor((F.col(c) - F.lit(lo)) / max(hi - lo, 1e-300) * ((1 << BITS) - 1)).cast("long")
    key = morton(cell(x, box.lo0 or 0.0, box.hi0 or 0.0), cell(y, box.lo1 or 0.0, box.hi1 or 0.0), BITS)
    keyed = placed.withColumn("__key", key).repartitionByRange(max(-(-box.k // size), 1), "__key").sortWithinPartitions("__key").drop("__key")
    keyed.write.option("compression", "zstd").parquet(f"{path}/points")
    stored = spark.read.schema(points.schema).parquet(f"{path}/points")
    index = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("points"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def view(spark: SparkSession, path: str, schema, x0: float, x1: float, y0: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    """The points of a box, ends included; only files whose boxes touch it are opened. The driver sees these files' names."""
    index = spark.read.parquet(f"{path}/index")
    files = [r.file for r in index.where((F.col("x1") >= x0) & (F.col("x0") <= x1) & (F.col("y1") >= y0) & (F.col("y0") <= y1)).select("file").collect()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
