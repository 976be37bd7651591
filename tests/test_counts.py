"""Counts that are taken without pairs, and pages that are taken without reading anew."""

import random

from tessera.operators import maps
from tessera.plans import registry


def test_a_map_is_summed_up_without_its_links(spark, monkeypatch):
    rnd = random.Random(2)
    edges = sorted({(rnd.randrange(40), rnd.randrange(6), rnd.choice(("Output", "Input"))) for _ in range(150)})
    anchors = [(p, None if p % 5 == 0 else p % 3, f"P{p % 7}") for p in range(45)]
    e, a = spark.createDataFrame(edges, "process long, flow long, direction string"), spark.createDataFrame(anchors, "process long, anchor int, location string")
    monkeypatch.setattr(maps, "links", None)
    got = maps.summary(e, a).first()
    seen = {p for p, x, _ in anchors if x is not None}
    links = {(f, p, q) for p, f, d in edges for q, g, c in edges if f == g and (d, c) == ("Output", "Input") and p != q and {p, q} <= seen}
    ends = [x for _, p, q in links for x in (p, q)]
    assert (got.processes, got.links, got.excluded, got.regions, got.most) == (36, len(links), 9, 3, max(map(ends.count, ends)))
    none = maps.summary(e.where("direction = 'Input'"), a).first()
    assert none.links == 0 and none.most is None


def test_pages_read_their_table_once(spark):
    got = registry.queries()["src02"](spark, "/root/testdata/sf0.01")
    assert got.count() > 1
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_entries_of_the_network_are_not_summed(spark):
    from tessera.sources.network import Network

    plan = Network(spark, "/root/testdata/sf0.001").a._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[row_idx" not in plan and "HashAggregate(keys=[provider" not in plan, plan
