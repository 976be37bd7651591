"""Exact order statistics of groups of any size.

A group's values are never gathered. Each round sketches the values that a rank can still be among (``percentile_approx``, which is
combined before it is shuffled), takes the marks round the rank, with one to spare on either side, and counts exactly what is
below and between them. About ``GRID`` / 3 times fewer values are left each round, until a range holds at most ``SMALL`` or one value
alone. All groups and ranks are narrowed together, and a hot group is spread over all tasks that hold its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Values of a range that are sorted in one place; marks of a sketch; groups whose ranges are broadcast at most.
SMALL, GRID, BROADCAST = 10_000, 256, 100_000
KEY = ["g", "ask"]


def _within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values of each range (lo and hi included; null for none)."""
    small = F.broadcast(ranges) if ranges.count() <= BROADCAST else ranges
    inside = F.coalesce(F.col("v") >= F.col("lo"), F.lit(True)) & F.coalesce(F.col("v") <= F.col("hi"), F.lit(True))
    return rows.join(small, "g").where(inside)


def selected(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(group, a column for each name): the values of the ranks (from 1), expressions over ``n``, the group's number of values.

    Nulls are no values; a group without any has no row, and a rank that is not there a null. NaN comes after all numbers.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    asks = F.array(*(F.struct(F.lit(name).alias("ask"), rank.cast("long").alias("rank")) for name, rank in ranks.items()))
    none = F.lit(None).cast(rows.schema["v"].dataType)
    open_ = sizes.select("g", F.col("n").alias("inside"), F.inline(asks)).where("rank between 1 and inside").withColumn("lo", none).withColumn("hi", none)
    open_ = written(open_)
    done = open_.where("false")
    while True:
        ready = (F.col("inside") <= SMALL) | F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
        done = done.unionByName(open_.where(ready))
        open_ = open_.where(~ready)
        if not open_.limit(1).count():
            break
        mine = _within(rows, open_)
        marks = mine.groupBy(KEY).agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], 10_000).alias("marks"))
        at = F.floor((F.col("rank") - 1) * GRID / F.col("inside")).cast("int")
        near = open_.join(marks, KEY).withColumn("lo2", F.get("marks", F.greatest(at - 1, F.lit(0)))).withColumn("hi2", F.get("marks", F.least(at + 2, F.lit(GRID))))
        near = written(near.drop("marks"))
        both = _within(rows, near).groupBy(KEY).agg(F.count_if(F.col("v") < F.col("lo2")).alias("below"), F.count_if(F.col("v").between(F.col("lo2"), F.col("hi2"))).alias("now"))
        open_ = near.join(both, KEY).select("g", F.col("now").alias("inside"), "ask", (F.col("rank") - F.col("below")).alias("rank"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))
        open_ = written(open_)
        if open_.where("rank not between 1 and inside").limit(1).count():
            raise ValueError("a sketch is farther off than its accuracy says")
    done = written(done)
    one = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    sorted_ = _within(rows, done.where(~one)).groupBy(KEY).agg(F.array_sort(F.collect_list("v")).alias("all"), F.first("rank").alias("rank"))  # SMALL at most
    found = done.where(one).select(*KEY, F.col("lo").alias("x")).unionByName(sorted_.select(*KEY, F.get("all", (F.col("rank") - 1).cast("int")).alias("x")))
    wide = found.groupBy("g").agg(*(F.max(F.when(F.col("ask") == name, F.col("x"))).alias(name) for name in ranks))
    return wide.withColumnRenamed("g", group)


def nearest_rank(p: float) -> Column:
    """The rank of the smallest value that at least a share ``p`` of all do not exceed."""
    return F.greatest(F.ceil(F.col("n") * p - 1e-9), F.lit(1))


def middle() -> dict[str, Column]:
    """The ranks whose mean is the median."""
    return {"low": F.floor((F.col("n") + 1) / 2), "high": F.floor(F.col("n") / 2) + 1}
