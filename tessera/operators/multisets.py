"""Groups that hold equal multisets of lines, without a list of any group.

A group's fingerprint is its number of distinct lines and of all, and two sums of 64 bits of each line's MD5: sums do not depend on
an order and are combined before they are shuffled. Groups of equal fingerprints are then compared line by line with the first of them,
so a collision of hashes never makes two groups equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

MARK = ["lines", "n", "a", "b"]


def halves(line: Column) -> tuple[Column, Column]:
    """The two halves of a line's MD5 as unsigned numbers."""
    h = F.md5(line)
    return tuple(F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))


def digest(line: Column, times: Column | None = None) -> Column:
    """An aggregate: a hash of the multiset of lines, in any order."""
    k = F.lit(1) if times is None else times
    a, b = (F.sum((x * k).cast("decimal(38,0)")) for x in halves(line))
    return F.sha2(F.concat_ws(":", F.sum(k), a, b), 256)


def counted(rows: DataFrame, key: str, line: Column) -> DataFrame:
    """(key, line, k): how often each group has each line."""
    return rows.groupBy(F.col(key).alias("key"), line.alias("line")).agg(F.count("*").alias("k"))


def fingerprints(lines: DataFrame) -> DataFrame:
    """(key, lines, n, a, b) of counted lines."""
    a, b = (F.sum((x * F.col("k")).cast("decimal(38,0)")) for x in halves(F.col("line")))
    return lines.groupBy("key").agg(F.count("*").alias("lines"), F.sum("k").alias("n"), a.alias("a"), b.alias("b"))


def classes(lines: DataFrame) -> DataFrame:
    """(key, first) of counted lines (a written table): the smallest key whose group is equal."""
    todo, out = written(fingerprints(lines)), None
    while True:
        named = todo.join(todo.groupBy(MARK).agg(F.min("key").alias("first")), MARK)
        other = written(named.where("key <> first").select("key", "first", "lines"))
        own = named.where("key = first").select("key", "first")
        there = lines.select(F.col("key").alias("first"), "line", F.col("k").alias("there"))
        same = lines.join(other, "key").join(there, ["first", "line"]).where("k = there").groupBy("key").agg(F.count("*").alias("same"))
        checked = written(other.join(same, "key", "left").withColumn("equal", F.coalesce(F.col("same") == F.col("lines"), F.lit(False))))
        found = own.unionByName(checked.where("equal").select("key", "first"))
        out = found if out is None else out.unionByName(found)
        wrong = checked.where("not equal").select("key")
        if not wrong.limit(1).count():
            return out
        todo = written(todo.join(wrong, "key", "left_semi"))
