"""Pairs that are the result come in blocks, so that files of them stay small."""

import random

import pytest

from tessera.operators import linking
from tessera.plans import registry


@pytest.mark.parametrize("held", [1_000_000, 9])
def test_blocks_hold_every_pair_once(spark, monkeypatch, held):
    monkeypatch.setattr(linking, "HELD", held)
    monkeypatch.setattr(linking, "ASKING", 4)
    monkeypatch.setattr(linking, "OFFERED", 3)
    rnd = random.Random(5)
    demands = [(c, f, s, rnd.random()) for c in range(40) for f in "fgh" for s in (1.0, -1.0) if rnd.random() < 0.7] + [(3, "f", 1.0, 0.5)] * 11
    ports = [(p, f, s, rnd.random()) for p in range(25) for f in "fgx" for s in (1.0, -1.0) if rnd.random() < 0.6]
    want = sorted((c, f, s, r, p, v) for c, f, s, r in demands for p, g, t, v in ports if (f, s) == (g, t))
    got = linking.blocked(spark.createDataFrame(demands, "consumer int, flow string, sign double, residual double"), spark.createDataFrame(ports, "provider int, flow string, sign double, pivot double"), ["flow", "sign"])
    assert sorted((r.consumer, r.flow, r.sign, r.residual, r.provider, r.pivot) for r in got.collect()) == want


def test_pairs_take_a_fraction_of_their_bits(spark, tmp_path):
    """Three thousand demands of three flows with a thousand ports each; in any order they took 0.55 bytes a pair."""
    n = 3000
    processes = spark.range(n).selectExpr("cast(id as int) process_idx", "cast(id % 25 as int) nation", "cast(id % 5 as int) region", "1.0D + id volume", "false volume_fallback")
    ports = spark.range(n).selectExpr("cast(id as int) process_idx", "concat('f', id % 3) flow", "1.0D coefficient")
    residuals = spark.range(n).selectExpr("cast(id as int) process_idx", "concat('f', (id + 1) % 3) flow", "-1.0D / (1 + id % 977) coefficient")
    pairs = linking.candidates(residuals, ports, processes, 6).select("consumer", "flow", "provider", "tier", "residual")
    pairs.write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == n * n // 3
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.35 * n * n / 3


def test_blocks_are_dealt_to_all_tasks(spark):
    plan = registry.queries()["cp11"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("REPARTITION_BY_NUM")]
    asking = above[above.index("BroadcastHashJoin") :]
    assert asking.count("Exchange hashpartitioning") == 1, plan
