"""Snapshots of a model that follow small changes of their tables.

Every column of A and B has a mark, a hash of all that it is made from: for A the demands of its process with the marks of the
places that meet them (a hash of a place's ports), for B its exchanges. Marks are sums, so no column is gathered. Where marks differ, the
column is built anew; all others are taken from the stored snapshot.

Stored impacts h, with h M = d, are mended instead of solved again. With K the changed columns of M, U what is added to these and
Q the rows K of the inverse of M (as many right-hand sides as changed columns),

    h' = h0 - (h0 U) (I + Q U)^-1 Q,    h0 = h + (d' - d) M^-1.

The driver sees square matrices of at most ``MOST`` changed columns; beyond that a model is built anew.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import linear, linking
from .multisets import digest

#: Changed columns up to which stored impacts are mended.
MOST = 256


def technosphere_marks(near: DataFrame, offers: DataFrame) -> DataFrame:
    """(col_idx, mark) of A's columns, of demands with their nearest place and of offers."""
    places = offers.groupBy(linking.PLACE).agg(digest(F.concat_ws(":", "provider", "pivot", "volume")).alias("ports"))
    rows = near.where("tier is not null").join(places, linking.PLACE)
    return rows.groupBy(F.col("consumer").alias("col_idx")).agg(digest(F.concat_ws(":", "flow", "residual", "sign", "tier", "place", "ports")).alias("mark"))


def column_marks(rows: DataFrame, column: str, *parts: str) -> DataFrame:
    """(col_idx, mark) of columns that rows make up."""
    return rows.groupBy(F.col(column).cast("int").alias("col_idx")).agg(digest(F.concat_ws(":", *parts)).alias("mark"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(col_idx) of columns whose marks differ, also those that come or go."""
    both = old.select("col_idx", F.col("mark").alias("p")).join(new.select("col_idx", F.col("mark").alias("q")), "col_idx", "full")
    return both.where(~F.col("p").eqNullSafe(F.col("q"))).select("col_idx")


def replaced(old: DataFrame, columns: DataFrame, new: DataFrame) -> DataFrame:
    """A matrix with the given columns taken from ``new``, which holds these alone."""
    return old.join(columns, "col_idx", "left_anti").select("row_idx", "col_idx", "value").unionByName(new.select("row_idx", "col_idx", "value"))


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    both = new.select("row_idx", "col_idx", "value").unionByName(old.select("row_idx", "col_idx", (-F.col("value")).alias("value")))
    return both.groupBy("row_idx", "col_idx").agg(F.sum("value").alias("value")).where("value <> 0")


def mended(h: DataFrame, solver: linear.Solver, more_m: DataFrame, more_d: DataFrame) -> DataFrame:
    """h' (row_idx, col_idx, value), of h with h M = d and what is added to M and to d.

    ``solver`` is that of the transposed M of before: ``h M = d`` for right-hand sides in rows.
    """
    spark = h.sparkSession
    as_y = lambda d: d.select(F.col("row_idx").alias("rhs"), F.col("col_idx").alias("idx"), "value")
    as_h = lambda x: x.select(F.col("rhs").alias("row_idx"), F.col("idx").alias("col_idx"), "value")
    h = h.select("row_idx", "col_idx", "value")
    more_m, more_d = written(more_m), written(more_d)
    if more_d.limit(1).count():
        h = written(h.unionByName(as_h(solver.solve(as_y(more_d)))).groupBy("row_idx", "col_idx").agg(F.sum("value").alias("value")))
    keys = sorted(r.col_idx for r in more_m.select("col_idx").distinct().limit(MOST + 1).collect())
    if not keys:
        return h
    if len(keys) > MOST:
        raise ValueError(f"over {MOST} columns have changed: the model has to be built anew")
    place, k = {c: i for i, c in enumerate(keys)}, len(keys)
    q = written(as_h(solver.solve(spark.createDataFrame([(c, c, 1.0) for c in keys], linear.VECTORS))))
    s = np.eye(k)
    for r in linear.product(q, more_m).collect():  # changed columns squared
        s[place[r.row_idx], place[r.col_idx]] += r.value
    # P S^-1, without P on the driver: each row of P, an array over the changed columns, times S^-1.
    inverse = spark.createDataFrame([(c, i, float(v)) for c, row in zip(keys, np.linalg.inv(s), strict=True) for i, v in zip(keys, row, strict=True)], "row_idx int, col_idx int, value double")
    weights = linear.product(linear.product(h, more_m), inverse)
    less = linear.product(weights, q)
    out = h.unionByName(less.select("row_idx", "col_idx", (-F.col("value")).alias("value")))
    return out.groupBy("row_idx", "col_idx").agg(F.sum("value").alias("value"))
