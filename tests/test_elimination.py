"""Sparse factorisation against dense solutions, and its fill on large structures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import elimination, linear


def entries(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], "row_idx int, col_idx int, value double")


def values(df, n, k):
    x = np.zeros((k, n))
    for r in df.collect():
        x[r.rhs, r.idx] = r.value
    return x


@pytest.mark.parametrize(("most", "block", "least"), [(12, 5, 0.05), (20, 1000, 0.05), (10, 20, 0.9)])
def test_random_systems_equal_dense_solutions(spark, monkeypatch, most, block, least):
    rng = np.random.default_rng(1)
    n, k = 50, 3
    m = np.eye(n) - rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.05)
    m[3, 3], m[3, 5], m[6, 3] = 0.0, 2.0, 1.0  # not every unknown can be a pivot
    y = rng.normal(size=(k, n)) * (rng.random((k, n)) < 0.3)
    monkeypatch.setattr(linear, "DENSE", most)
    monkeypatch.setattr(elimination, "BLOCK", block)
    monkeypatch.setattr(elimination, "LEAST", least)
    monkeypatch.setattr(elimination, "DENSELY", 0 if least > 0.5 else 20)
    right = spark.createDataFrame([(int(a), int(b), float(y[a, b])) for a, b in zip(*np.nonzero(y), strict=True)], linear.VECTORS)
    solver = linear.Solver(entries(spark, m), n)
    assert solver.factors.blocks is not None and (least > 0.5) == (not solver.factors.levels)
    assert values(solver.solve(right), n, k) == pytest.approx(np.linalg.solve(m, y.T).T, rel=1e-8, abs=1e-9)
    assert values(solver.solve(right.where("rhs = 1")), n, k)[1] == pytest.approx(np.linalg.solve(m, y[1]), rel=1e-8, abs=1e-9)


def test_singular_blocks_are_left_to_the_iterative_solver(spark, monkeypatch):
    monkeypatch.setattr(linear, "DENSE", 0)
    monkeypatch.setattr(elimination, "BLOCK", 1)
    m = np.array([[0.0, 2.0, 0.0], [4.0, 0.0, 1.0], [0.0, 5.0, 1e-20]])
    m[2] = [1.0, 5.0, 0.0]
    y = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (0, 2, 3.0)], linear.VECTORS)
    solver = linear.Solver(entries(spark, m), 3)
    assert solver.factors.blocks is None and solver.factors.core == 3
    assert values(solver.solve(y), 3, 1)[0] == pytest.approx(np.linalg.solve(m, [2.0, 1.0, 3.0]))


def test_structural_and_numerical_singularity(spark, monkeypatch):
    monkeypatch.setattr(linear, "DENSE", 1)
    with pytest.raises(elimination.Singular, match="no entry"):
        linear.Solver(entries(spark, np.array([[1.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 1.0]])), 3)
    near = np.array([[1.0, 2.0, 0.0], [0.5, 1.0 + 1e-16, 0.0], [0.0, 1.0, 1.0]])
    with pytest.raises(ValueError, match="singular"):
        linear.Solver(entries(spark, near), 3).solve(spark.createDataFrame([(0, 0, 1.0)], linear.VECTORS))


def test_a_hundred_thousand_unknowns(spark):
    """A chain through all, rings of 50, and a hub that all use and that uses the first: solved with little fill in few levels."""
    n = 100_000
    i = spark.range(n).select(F.col("id").cast("int").alias("i"))
    row, col = F.col("row_idx"), F.col("col_idx")
    parts = [
        i.select(F.col("i").alias("row_idx"), F.col("i").alias("col_idx"), F.lit(1.0).alias("value")),
        i.where(F.col("i") < n - 1).select(F.col("i").alias("row_idx"), (F.col("i") + 1).alias("col_idx"), F.lit(-0.6).alias("value")),
        i.where("i % 50 = 49").select(F.col("i").alias("row_idx"), (F.col("i") - 49).alias("col_idx"), F.lit(-0.3).alias("value")),
        i.where("i % 3 = 0 and i > 0").select(F.lit(0).alias("row_idx"), F.col("i").alias("col_idx"), F.lit(-1e-5).alias("value")),
    ]
    m = parts[0]
    for p in parts[1:]:
        m = m.unionByName(p)
    m = m.groupBy(row, col).agg(F.sum("value").alias("value"))
    truth = i.select(F.lit(0).alias("rhs"), F.col("i").alias("idx"), (1 + F.col("i") % 7).cast("double").alias("value"))
    solver = linear.Solver(m, n)
    x = solver.solve(linear._matvec(solver.m, truth))
    off = x.join(truth.withColumnRenamed("value", "t"), ["rhs", "idx"], "full").agg(F.max(F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("t", F.lit(0.0)))), F.count("*")).first()
    assert off[0] < 1e-8 and off[1] == n
    fill = solver.factors.fill().collect()
    assert len(fill) < 25 and solver.factors.core <= linear.DENSE
    assert sum(r.kept for r in fill if r.kind == "level") < 4 * fill[0].entries
