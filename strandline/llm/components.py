"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each endpoint of edges(a long, b long) with the smallest id it can reach.

    Returns (node, component) for every node with an edge to another node. Each
    round points a node's neighbours at its smallest one, then replaces every
    parent by that parent's own smallest parent; both keep connectivity and the
    edge count never grows. Tables are written between rounds, so lineage stays
    short and each join reads two plain exchanges that adaptive execution can
    split when a hub holds many edges. Nulls and self-loops are ignored; an
    empty table gives an empty result. Raises if rounds run out (never partial).
    """
    e = materialize(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p"))
        .distinct(),
        "cc-edges",
    )
    for _ in range(max_rounds):
        low = materialize(
            e.groupBy("v").agg(F.min("p").alias("m"), F.count("*").alias("n")), "cc-low"
        )
        joined = e.join(low, "v")
        star = materialize(
            joined.select(
                F.when(F.col("p") == F.col("m"), F.col("v")).otherwise(F.col("p")).alias("v"),
                F.col("m").alias("p"),
            ).distinct(),
            "cc-star",
        )
        up = materialize(
            star.groupBy(F.col("v").alias("p")).agg(F.min("p").alias("g")), "cc-up"
        )
        e = materialize(
            star.join(up, "p", "left").select(
                "v", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")
            ),
            "cc-jump",
        )
        several = low.filter("n > 1").limit(1).count()
        moved = e.filter("moved").limit(1).count()
        e = e.select("v", "p").distinct()
        if not several and not moved:
            roots = e.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
            return e.select(F.col("v").alias("node"), F.col("p").alias("component")).unionByName(roots)
        e = materialize(e, "cc-edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


class Forest:
    """Union-find over integer ids, for the edges one task has seen."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self):
        """(node, smallest known member) for each node that is not its own root."""
        for x in list(self.parent):
            root = self.find(x)
            if root != x:
                yield x, root
