"""Connected components by contraction; no edge or label reaches the driver.

Defined cases
    loops, repeated edges, either direction    count once
    nodes without edges                        not in the result
    empty table                                empty result
    extra columns                              not read
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonant.llm.shared import discard, written


class Forest:
    """Edges that join what was apart, of those seen lately; holds `most` nodes."""

    def __init__(self, most: int = 200_000):
        self.most, self.up = most, {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def joins(self, a: int, b: int) -> bool:
        if len(self.up) > self.most:
            self.up.clear()
        x, y = self.root(a), self.root(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges(a, b).

    Each round every node hooks to its smallest neighbour and takes that one's hook as
    its label; the edges between labels are what the next round has left, so that a
    family with many edges is small after the first. The smallest node never hooks.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = written(edges.where("a <> b").select(*ends).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    members = written(nodes.withColumn("component", F.col("node")), "components")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "hooks")
        next_up = hooks.select(F.col("node").alias("up"), F.col("up").alias("label"))
        labels = written(hooks.join(next_up, "up").select("node", "label"), "labels")
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        moved = edges.hint("merge").join(of("a"), "a").hint("merge").join(of("b"), "b")
        moved = moved.where("label_a <> label_b").select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b"))
        left = written(moved.distinct(), "edges")
        named = members.hint("merge").join(of("component"), "component", "left")
        renamed = written(named.select("node", F.coalesce("label_component", "component").alias("component")), "components")
        for old in (edges, hooks, labels, members):
            discard(old)
        edges, members = left, renamed
    return members
