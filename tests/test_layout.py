"""The layout by topology against a plain version, node by node."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.functions import scalars as fn
from tessera.operators import layout


def unit(text, salt):
    h = 0xCBF29CE484222325 ^ salt
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return (h & 0xFFFFFFFF) / 0xFFFFFFFF


def plain(nodes, edges, rounds, limit):
    kind, degree = {n: k for n, k, _ in nodes}, {n: max(d, 1) for n, _, d in nodes}
    near = defaultdict(list)
    for p, f in edges:
        near[p].append(f)
        near[f].append(p)
    anchors = sorted((n for n in kind if kind[n] == "flow"), key=lambda n: (-degree[n], n))[:limit]
    at = {}
    for r, n in enumerate(anchors):
        out, a = math.sqrt((r + 0.5) / len(anchors)) * 0.34 + 0.18, r * 2.3999631 + (unit(n, 709) - 0.5) * 0.22
        at[n] = (math.cos(a) * 1900 * out, math.sin(a) * 1250 * out)

    def about(n, others, weight, low, per, most, spread, flat, salts):
        w = [weight(o) for o in others]
        if not w:
            a, r = unit(n, salts[0]) * math.tau, math.sqrt(unit(n, salts[0] + 1))
            return math.cos(a) * r * 1900 * 0.36, math.sin(a) * r * 1250 * 0.36
        a, r = unit(n, salts[1]) * math.tau, low + min(math.sqrt(degree[n]) * per, most) + unit(n, salts[2]) * spread
        x, y = (sum(at[o][i] * v for o, v in zip(others, w, strict=True)) / sum(w) for i in (0, 1))
        return x + math.cos(a) * r, y + math.sin(a) * r * flat

    fixed = set(anchors)
    at |= {n: about(n, [o for o in near[n] if o in fixed], lambda o: 1.2 + math.log1p(degree[o]) * 0.12, 24, 13, 120, 36, 0.72, (811, 821, 823)) for n in kind if kind[n] == "process"}
    at |= {n: about(n, near[n], lambda o: degree[o] ** -0.28, 18, 9, 95, 26, 0.76, (829, 831, 833)) for n in kind if kind[n] == "flow" and n not in fixed}
    pressed = 0
    for turn in range(rounds):
        new = dict(at)
        for n in kind:
            if n in fixed or not near[n]:
                continue
            w = [degree[o] ** (-0.48 if kind[n] == "process" else -0.24) for o in near[n]]
            b = 0.34 if kind[n] == "process" else 0.08 if degree[n] > 180 else 0.14 if degree[n] > 72 else 0.28
            new[n] = tuple(at[n][i] * (1 - b) + b * sum(at[o][i] * v for o, v in zip(near[n], w, strict=True)) / sum(w) for i in (0, 1))
        at = new
        if turn % 8 == 7:
            cells = defaultdict(list)
            for n, (x, y) in at.items():
                cells[math.floor(x / 68), math.floor(y / 68)].append(n)
            moved = {}
            for inside in cells.values():
                mx, my = (sum(at[n][i] for n in inside) / len(inside) for i in (0, 1))
                if len(inside) > 18:
                    for n in set(inside) - fixed:
                        dx, dy = at[n][0] - mx, at[n][1] - my
                        d = math.hypot(dx, dy)
                        a = unit(f"{n}:{turn}", 839) * math.tau
                        ux, uy = (math.cos(a), math.sin(a)) if d < 0.001 else (dx / d, dy / d)
                        f = min((len(inside) - 18) / 18, 2.4) * (12 if kind[n] == "process" else 9)
                        moved[n] = (at[n][0] + ux * f, at[n][1] + uy * f)
                        pressed += 1
            at |= moved
    lo, hi = ([f(v[i] for v in at.values()) for i in (0, 1)] for f in (min, max))
    scale = min(1900 / max(hi[0] - lo[0], 1), 1250 / max(hi[1] - lo[1], 1))
    z = {n: 26 + min(math.log1p(degree[n]) * 1.6, 14) if kind[n] == "process" else 9 + min(math.log1p(degree[n]) * 1.1, 10) for n in kind}
    return {n: (*((v[i] - (hi[i] + lo[i]) / 2) * scale for i in (0, 1)), z[n]) for n, v in at.items()}, pressed


def test_layout_equals_a_plain_version(spark):
    rng = np.random.default_rng(4)
    edges = [(f"p{a}", f"f{b}") for a, b in zip(rng.integers(0, 120, 900), rng.integers(0, 200, 900) ** 2 // 250, strict=True)]
    degree = Counter(x for e in edges for x in e)
    nodes = [(n, "process" if n[0] == "p" else "flow", d) for n, d in degree.items()] + [("p900", "process", 0), ("f900", "flow", 0)]
    want, pressed = plain(nodes, edges, 9, 12)
    assert pressed > 20
    got = layout.expanded(spark.createDataFrame(nodes, "id string, kind string, degree long"), spark.createDataFrame(edges, "process string, flow string"), rounds=9, anchors=12).collect()
    assert {r.id for r in got} == set(want)
    for r in got:
        assert (r.x, r.y, r.z) == pytest.approx(want[r.id], abs=1e-4), r.id
    assert max(abs(r.x) for r in got) <= 950.01 and max(abs(r.y) for r in got) <= 625.01


def test_units_of_hashes(spark):
    df = spark.createDataFrame([("p1",), ("f:77",), ("",)], "id string")
    assert [r.u for r in df.select(fn.hash_unit(df.id, 831).alias("u")).collect()] == pytest.approx([unit(x, 831) for x in ("p1", "f:77", "")], abs=1e-9)


def test_the_query_runs_all_rounds_with_all_anchors(spark, monkeypatch):
    """The query ran 16 of the 72 rounds."""
    from tessera.plans import registry

    ran = []
    monkeypatch.setattr(layout, "_rounds", lambda at, edges, k, turn: ran.append((k, turn)) or at)
    anchored, limits = layout._anchored, []
    monkeypatch.setattr(layout, "_anchored", lambda nodes, anchors: limits.append(anchors) or anchored(nodes, anchors))
    registry.queries()["gr16_topology"](spark, "/root/testdata/sf0.001")
    assert sum(k for k, _ in ran) == layout.ROUNDS == 72 and limits == [96]
    assert [turn for _, turn in ran] == list(range(7, 72, 8))
