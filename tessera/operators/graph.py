"""Reachability, adjacency and bounded upstream paths over edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted distinct targets of each source, and how many these are."""
    out = edges.select("src", "dst").distinct().groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets"))
    return out.withColumn("degree", F.size("targets"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) of all that the roots reach, by a frontier that is joined until it is empty; cycles end it as well."""
    e = written(edges.select("src", "dst").distinct())
    seen = written(roots.select("node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while True:
        depth += 1
        front = seen.where(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
        new = e.join(front, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        new = written(new.select("node", F.lit(depth).alias("depth")))
        if not new.limit(1).count():
            return seen
        seen = seen.unionByName(new)


def degrees(edges: DataFrame) -> DataFrame:
    """Every edge counts for both ends."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def contributions(x: DataFrame, direct: DataFrame) -> DataFrame:
    """Direct contribution of each process, x * d, and its share of the sum of magnitudes."""
    d = x.join(direct, "process_idx").select("process_idx", (F.col("x") * F.col("d")).alias("direct"))
    total = d.agg(F.greatest(F.sum(F.abs("direct")), F.lit(1e-12)).alias("total"))
    return d.crossJoin(F.broadcast(total)).select("process_idx", "direct", (F.abs("direct") / F.col("total")).alias("share"))


def top_children(edges: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k providers of each consumer with the largest magnitude, ties by index."""
    e = edges.join(scores.select(F.col("process_idx").alias("dst"), "direct"), "dst")
    order = W.partitionBy("src").orderBy(F.desc(F.abs("direct")), "dst")
    return e.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shown(scores: DataFrame, root: int, eps: float = 1e-12) -> DataFrame:
    """Contributions that are not next to nothing, and the root's."""
    return scores.where((F.abs("direct") > eps) | (F.col("process_idx") == root))


def largest_first(group: str) -> W:
    return W.partitionBy(group).orderBy(F.desc(F.abs("direct")), "location", "process_idx")


def by_rank(root: str) -> W:
    return W.partitionBy(root).orderBy(F.desc("score"), "path")


def options(depth: int = 4, k: int = 5, cutoff: float = 0.01, nodes: int = 200) -> dict:
    """The bounds of a path search brought into their ranges: depth 1 to 8, children 1 to 20, nodes 10 to 2000, share at most 1."""
    share = min(cutoff, 1.0) if cutoff >= 0 and cutoff == cutoff and cutoff != float("inf") else 0.01
    return {"depth": min(max(depth, 1), 8), "k": min(max(k, 1), 20), "cutoff": share, "nodes": min(max(nodes, 10), 2000)}


def bounded(depth: Column, k: Column, cutoff: Column, nodes: Column) -> dict[str, Column]:
    """The same for requests in a table."""
    within = lambda c, lo, hi: F.least(F.greatest(c.cast("int"), F.lit(lo)), F.lit(hi))
    share = cutoff.cast("double")
    good = (share >= 0) & ~F.isnan(share) & (share != float("inf"))
    return {"depth": within(depth, 1, 8), "k": within(k, 1, 20), "cutoff": F.when(good, F.least(share, F.lit(1.0))).otherwise(0.01), "nodes": within(nodes, 10, 2000)}


@dataclass
class Branches:
    """What a path search found: rows (root, path, depth, score, reason); the reason is null for a node that was expanded."""

    found: DataFrame
    scores: DataFrame

    @property
    def ends(self) -> DataFrame:
        """Branches: root, path, score (magnitudes of all nodes but the root) and why they end."""
        return self.found.where("reason is not null").select("root", "path", "score", "reason")

    @property
    def nodes(self) -> DataFrame:
        """Nodes that were expanded with their least depth."""
        return self.found.where("reason is null").groupBy("root", F.element_at("path", -1).alias("node")).agg(F.min("depth").alias("least_depth"))

    def coverage(self) -> DataFrame:
        """The share of all contributions that expanded nodes have, by root."""
        return self.nodes.join(self.scores, F.col("node") == F.col("process_idx")).groupBy("root").agg(F.least(F.sum("share"), F.lit(1.0)).alias("coverage"))


STATE = ("root", "node", "path", "order", "depth", "score", "cut")


def _grown(front: DataFrame, kids: DataFrame) -> DataFrame:
    """The children of paths, with their place in the order of a depth-first search: the ranks along the path."""
    on = front.join(kids, front["node"] == kids["src"])
    return written(on.select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("order", F.array("rank")).alias("order"), (F.col("depth") + 1).alias("depth"), (F.col("score") + F.col("size")).alias("score"), F.array_contains("path", F.col("dst")).alias("cut")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def branches(edges: DataFrame, scores: DataFrame, roots: DataFrame, depth: int = 4, k: int = 5, cutoff: float = 0.01, nodes: int = 200) -> Branches:
    """Upstream paths of each root (node), depth first, along contributions (process_idx, direct, share).

    A node goes on to the ``k`` providers of largest magnitude with a share of at least ``cutoff``, down to ``depth``. A
    path that meets itself ends there, and so does one at a new node once ``nodes`` are expanded.

    Nothing is cut before ``nodes`` are expanded, so these are the first distinct nodes of the search without that bound. They are
    found by growing the ``nodes`` foremost open paths of each root, in the order of the search, round by round, until no open path
    comes before the last of them. Then only paths along these nodes are grown to their ends. So a root makes the paths that it returns and, in a round, children
    of at most ``nodes`` others; never ``k ** depth``.
    """
    bound = options(depth, k, cutoff, nodes)
    depth, nodes = bound["depth"], bound["nodes"]
    e, scores = written(edges.select("src", "dst").distinct()), written(scores)
    likely = scores.where(F.col("share") >= bound["cutoff"])
    kids = written(top_children(e, likely, bound["k"]).select("src", F.col("dst").cast("int").alias("dst"), F.abs("direct").alias("size"), "rank"))
    node = F.col("node").cast("int")
    first = roots.select(node.alias("root"), node.alias("node"), F.array(node).alias("path"), F.array().cast("array<int>").alias("order"), F.lit(0).alias("depth"), F.lit(0.0).alias("score"), F.lit(False).alias("cut")).distinct()
    made = [written(first)]
    can = (F.col("depth") < depth) & ~F.col("cut")
    waiting, open_ = None, made[0]  # open paths that wait, and those that are grown now
    mine = W.partitionBy("root")
    while True:
        new = _grown(open_, kids)
        made.append(new)
        left = new.where(can) if waiting is None else waiting.unionByName(new.where(can))
        left = left.join(kids.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(*STATE)
        foremost = left.groupBy("root").agg(F.min("order").alias("open"))
        seen = _union(made).where("not cut").groupBy("root", "node").agg(F.min("order").alias("at"))
        known = seen.join(foremost, "root", "left").groupBy("root").agg(F.count_if(F.col("open").isNull() | (F.col("at") <= F.col("open"))).alias("known"))
        left = written(left.join(known, "root").withColumn("place", F.row_number().over(mine.orderBy("order"))))
        open_ = left.where((F.col("known") < nodes) & (F.col("place") <= nodes)).select(*STATE)
        waiting = left.where((F.col("known") >= nodes) | (F.col("place") > nodes)).select(*STATE)
        if not open_.limit(1).count():
            break
    chosen = seen.withColumn("place", F.row_number().over(mine.orderBy("at"))).where(F.col("place") <= nodes)
    chosen = written(chosen.groupBy("root").agg(F.collect_list("node").alias("chosen")))  # at most ``nodes`` of each root
    along = lambda rows, n: rows.join(chosen, "root").where(F.forall(F.slice("path", 1, n), lambda x: F.array_contains("chosen", x)))
    open_ = along(waiting, F.size("path")).select(*STATE)
    while open_.limit(1).count():
        made.append(_grown(open_, kids))
        open_ = along(made[-1].where(can), F.size("path")).select(*STATE)
    rows = along(_union(made), F.size("path") - 1).withColumn("inside", F.array_contains("chosen", F.col("node")))
    followed = kids.select(F.col("src").alias("node")).distinct().withColumn("on", F.lit(True))
    any_ = e.select(F.col("src").cast("int").alias("node")).distinct().withColumn("any", F.lit(True))
    rows = rows.join(followed, "node", "left").join(any_, "node", "left")
    reason = F.when(F.col("cut"), "cycle_cut").when(~F.col("inside"), "max_nodes").when(F.col("depth") == depth, "max_depth").when(F.col("on").isNull(), F.when(F.col("any").isNull(), "leaf").otherwise("cutoff"))
    none = F.when(~F.col("cut") & F.col("inside"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(none, F.filter(F.array(reason), lambda x: x.isNotNull()))
    return Branches(written(rows.select("root", "path", "depth", "score", F.explode(reasons).alias("reason"))), scores)


def started(roots: DataFrame) -> DataFrame:
    """The state of a traversal: (node, depth, done)."""
    return written(roots.select("node", F.lit(0).alias("depth"), F.lit(False).alias("done")).distinct())


def passed(edges: DataFrame, state: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """One pass: at most ``limit`` nodes not done yet, nearest first, are followed. The new state is written; whether any node is left."""
    now = state.where("not done").orderBy("depth", "node").limit(limit).select("node", F.lit(True).alias("now"))
    marked = written(state.join(F.broadcast(now), "node", "left"))
    found = edges.join(F.broadcast(marked.where("now")).select(F.col("node").alias("src"), "depth"), "src").groupBy(F.col("dst").alias("node")).agg((F.min("depth") + 1).alias("depth"))
    new = found.join(state.select("node"), "node", "left_anti").select("node", "depth", F.lit(False).alias("done"))
    out = written(marked.select("node", "depth", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")).unionByName(new))
    return out, bool(out.where("not done").limit(1).count())
