"""Layout of the graph of processes and flows in the plane, by its topology.

The flows of highest degree are anchors on rings; processes start about their anchors and other flows about their processes. Then
nodes are drawn towards the means of their neighbours, and every ``PRESSED`` rounds those in a crowded cell of a grid are pushed
from the cell's centre; anchors stay. What repels is a cell's centre, never a pair of nodes.

Edges are numbered and dealt once, by their end on the side that has more nodes, and stay where they are (``Edges``). The places of that side stay with
them from round to round, those of the smaller side go to all tasks, and what edges add is summed where they lie first: only the sums of the smaller side are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit
from ..sources.tables import numbered, written

# Size of the layout, anchors, rounds, cells, salts of hashes, and how much each part weighs.
WIDTH, HEIGHT = 1900.0, 1250.0
ANCHORS, ROUNDS, PRESSED = 96, 72, 8
GOLDEN_ANGLE = 2.3999631
CELL, COMFORTABLE, MOST_PRESSURE = 68.0, 18, 2.4
TURN = 2 * math.pi
#: Nodes of the smaller side that a task holds at once (more are met one part after the other), and edges of a task.
HELD, DEALT = 1_000_000, 8_000_000


def _held(rows: DataFrame) -> DataFrame:
    """Rows kept where they are made; how they lie is known to later plans only once they are there."""
    rows = rows.persist()
    rows.count()
    return rows


@dataclass
class Edges:
    """Edges by numbers of their ends (few, many, k), k of each, kept by their end on the side of more nodes, whose kind is ``larger``; the other side has ``parts`` parts. They lie in ``tasks`` parts."""

    rows: DataFrame
    larger: str
    parts: int
    tasks: int

    @property
    def smaller(self) -> str:
        return "process" if self.larger == "flow" else "flow"

    def beside(self, placed: DataFrame) -> DataFrame:
        """Nodes of the larger side, where their edges are."""
        return _held(placed.where(F.col("kind") == self.larger).repartition(self.tasks, "n").sortWithinPartitions("n"))

    def sums(self, kind: str, placed: DataFrame) -> DataFrame:
        """(n, *columns): for nodes of a kind, sums over their edges of the columns of the ends on the other side (n, *columns)."""
        add = [F.sum(F.col("k") * F.col(c)).alias(c) for c in placed.columns if c != "n"]
        if kind != self.larger:
            return self.rows.join(placed.withColumnRenamed("n", "many"), "many").groupBy(F.col("few").alias("n")).agg(*add)
        few = placed.withColumnRenamed("n", "few")
        part = F.pmod("few", F.lit(self.parts))
        met = [self.rows.join(F.broadcast(few.where(part == i) if self.parts > 1 else few), "few") for i in range(self.parts)]
        return reduce(DataFrame.unionByName, met).groupBy(F.col("many").alias("n")).agg(*add)


def _dealt(nodes: DataFrame, edges: DataFrame) -> Edges:
    """Edges (process, flow) of numbered nodes (n, id, kind)."""
    count = {"process": 0, "flow": 0} | {r.kind: r.k for r in nodes.groupBy("kind").agg(F.count("*").alias("k")).collect()}
    larger, smaller = ("flow", "process") if count["flow"] >= count["process"] else ("process", "flow")
    ends = lambda kind, n: nodes.where(F.col("kind") == kind).select(F.col("id").alias(kind), F.col("n").alias(n))
    rows = edges.join(ends(larger, "many"), larger).join(ends(smaller, "few"), smaller).select("few", "many")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // DEALT))
    rows = _held(rows.repartition(tasks, "many").groupBy("few", "many").agg(F.count("*").alias("k")).sortWithinPartitions("many"))
    return Edges(rows, larger, -(-count[smaller] // HELD) or 1, tasks)


def _seed(node: Column, salt: int) -> list[Column]:
    """A place in a disc by a node's hash."""
    angle, radius = hash_unit(node, salt) * TURN, F.sqrt(hash_unit(node, salt + 1))
    return [F.cos(angle) * radius * WIDTH * 0.36, F.sin(angle) * radius * HEIGHT * 0.36]


def _anchored(nodes: DataFrame, anchors: int) -> DataFrame:
    """The anchors (id, x, y), ``anchors`` at most."""
    top = nodes.where("kind = 'flow'").orderBy(F.desc("degree"), "id").limit(anchors).withColumn("all", F.lit(0))
    top = top.withColumn("rank", F.row_number().over(W.partitionBy("all").orderBy(F.desc("degree"), "id")) - 1).withColumn("k", F.count("*").over(W.partitionBy("all")))
    out = F.sqrt((F.col("rank") + 0.5) / F.col("k")) * 0.34 + 0.18
    angle = F.col("rank") * GOLDEN_ANGLE + (hash_unit(F.col("id"), 709) - 0.5) * 0.22
    return top.select("id", (F.cos(angle) * WIDTH * out).alias("x"), (F.sin(angle) * HEIGHT * out).alias("y"))


def _about(nodes: DataFrame, sums: DataFrame, base: tuple, flat: float, salts: tuple[int, int, int]) -> DataFrame:
    """Nodes near the mean of those placed neighbours that have sums (n, sx, sy, sw) of weighted places and weights; others at a place of their own."""
    low, per, most, spread = base
    angle = hash_unit(F.col("id"), salts[1]) * TURN
    radius = low + F.least(F.sqrt("degree") * per, F.lit(most)) + hash_unit(F.col("id"), salts[2]) * spread
    x, y = _seed(F.col("id"), salts[0])
    rows = nodes.join(sums, "n", "left")
    none = F.col("sw").isNull()
    return rows.select("n", F.when(none, x).otherwise(F.col("sx") / F.col("sw") + F.cos(angle) * radius).alias("x"), F.when(none, y).otherwise(F.col("sy") / F.col("sw") + F.sin(angle) * radius * flat).alias("y"))


def _weighted(placed: DataFrame, weight: Column) -> DataFrame:
    return placed.select("n", *((F.col(c) * weight).alias(f"s{c}") for c in "xy"), weight.alias("sw"))


def _started(nodes: DataFrame, edges: Edges, anchors: DataFrame) -> DataFrame:
    degree = nodes.select("n", "degree")
    by_anchor = edges.sums("process", _weighted(anchors.join(degree, "n"), 1.2 + F.log1p("degree") * 0.12))
    processes = written(_about(nodes.where("kind = 'process'"), by_anchor, (24.0, 13.0, 120.0, 36.0), 0.72, (811, 821, 823)))
    free = nodes.where("kind = 'flow'").join(anchors.select("n"), "n", "left_anti")
    by_process = edges.sums("flow", _weighted(processes.join(degree, "n"), F.pow("degree", F.lit(-0.28))))
    flows = _about(free, by_process, (18.0, 9.0, 95.0, 26.0), 0.76, (829, 831, 833))
    return anchors.select("n", "x", "y").unionByName(processes).unionByName(flows)


def _both(edges: Edges, at: DataFrame, *columns: Column) -> DataFrame:
    """Sums of columns over the neighbours of all nodes."""
    side = lambda kind: at.where(F.col("kind") == kind).select("n", *columns)
    return edges.sums("process", side("flow")).unionByName(edges.sums("flow", side("process")))


def _bound(nodes: DataFrame, edges: Edges, anchors: DataFrame, at: DataFrame) -> DataFrame:
    """(n, id, kind, pull, blend, whole, x, y): places with how much a node pulls others, how much of its place its neighbours give it, and the sum of their pulls."""
    degree = F.col("degree")
    pull = F.pow(degree, F.when(F.col("kind") == "flow", -0.48).otherwise(-0.24))
    blend = F.when(F.col("fixed"), 0.0).when(F.col("kind") == "process", 0.34).when(degree > 180, 0.08).when(degree > 72, 0.14).otherwise(0.28)
    rows = nodes.join(anchors.select("n", F.lit(True).alias("fixed")), "n", "left").select("n", "id", "kind", pull.alias("pull"), blend.alias("blend"))
    whole = _both(edges, rows, F.col("pull").alias("whole"))
    return rows.join(whole, "n", "left").join(at, "n")


def _drawn(side: DataFrame, sums: DataFrame) -> DataFrame:
    """Nodes of a side drawn towards what their neighbours add up to (n, sx, sy)."""
    moved = lambda c: F.when(F.col(f"s{c}").isNull(), F.col(c)).otherwise((1 - F.col("blend")) * F.col(c) + F.col("blend") * F.col(f"s{c}") / F.col("whole")).alias(c)
    return side.join(sums, "n", "left").select("n", "id", "kind", "pull", "blend", "whole", moved("x"), moved("y"))


def _rounds(at: DataFrame, edges: Edges, k: int, turn: int | None) -> DataFrame:
    """Places after k rounds, and after the push of round ``turn`` if there is one.

    The larger side stays beside its edges; the smaller one is written each round, which keeps plans short.
    """
    pulls = lambda side: side.select("n", *((F.col("pull") * F.col(c)).alias(f"s{c}") for c in "xy"))
    many, few = edges.beside(at), at.where(F.col("kind") == edges.smaller)
    for _ in range(k):
        next_few = written(_drawn(few, edges.sums(edges.smaller, pulls(many))))
        next_many = _held(_drawn(many, edges.sums(edges.larger, pulls(few))))
        many.unpersist()
        many, few = next_many, next_few
    both = many.unionByName(few)
    out = written(both if turn is None else _pressed(both, turn))
    many.unpersist()
    return out


def _pressed(at: DataFrame, turn: int) -> DataFrame:
    """Nodes of crowded cells moved away from the cell's centre, the farther the more there are."""
    cell = [F.floor(F.col(c) / CELL).cast("int").alias(f"c{c}") for c in "xy"]
    at = at.select("*", *cell)
    cells = at.groupBy("cx", "cy").agg(F.count("*").alias("many"), F.avg("x").alias("mx"), F.avg("y").alias("my")).where(F.col("many") > COMFORTABLE)
    rows = at.join(F.broadcast(cells), ["cx", "cy"], "left")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    length = F.hypot(dx, dy)
    angle = hash_unit(F.concat("id", F.lit(f":{turn}")), 839) * TURN
    force = F.least((F.col("many") - COMFORTABLE) / COMFORTABLE, F.lit(MOST_PRESSURE)) * F.when(F.col("kind") == "process", 12.0).otherwise(9.0)
    still = F.col("many").isNull() | (F.col("blend") == 0)
    moved = lambda c, d, unit: F.when(still, F.col(c)).otherwise(F.col(c) + F.when(length < 0.001, unit).otherwise(d / length) * force).alias(c)
    return rows.select("n", "id", "kind", "pull", "blend", "whole", moved("x", dx, F.cos(angle)), moved("y", dy, F.sin(angle)))


def expanded(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, anchors: int = ANCHORS) -> DataFrame:
    """(id, x, y, z) of nodes (id, kind process or flow, degree), by edges (process, flow), scaled into the layout's size.

    Repeated edges pull as often as they come; a node without edges stays where it starts. The driver sees nothing but plans and, on
    their way to all tasks, the places of the smaller side, ``HELD`` at most at once. Edges are read twice.
    """
    nodes = written(nodes.select("id", "kind", F.greatest("degree", F.lit(1)).alias("degree")))
    nodes = written(numbered(nodes, ["id"], "n"))
    dealt = _dealt(nodes, edges)
    fixed = written(_anchored(nodes, anchors).join(nodes.select("id", "n"), "id"))
    at = written(_bound(nodes, dealt, fixed, _started(nodes, dealt, fixed)))
    for first in range(0, rounds, PRESSED):
        k = min(PRESSED, rounds - first)
        at = _rounds(at, dealt, k, first + k - 1 if k == PRESSED else None)
    dealt.rows.unpersist()
    box = at.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("least_", F.min), ("most_", F.max))))
    span = lambda c: F.greatest(F.col(f"most_{c}") - F.col(f"least_{c}"), F.lit(1.0))
    scale = F.least(WIDTH / span("x"), HEIGHT / span("y"))
    place = lambda c: ((F.col(c) - (F.col(f"most_{c}") + F.col(f"least_{c}")) / 2) * scale).alias(c)
    log = F.log1p("degree")
    z = F.when(F.col("kind") == "process", 26.0 + F.least(log * 1.6, F.lit(14.0))).otherwise(9.0 + F.least(log * 1.1, F.lit(10.0)))
    return at.drop("kind", "id").crossJoin(F.broadcast(box)).join(nodes, "n").select("id", place("x"), place("y"), z.alias("z"))
