"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.support import join_beside_hot, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """For the nodes of `edges` (a, b): node and root, the least node of its component.

    Every round a node takes the least root among its neighbours', then the root of that root, so the rounds grow with
    the logarithm of the longest chain. Messages are reduced before they are moved; each round is a written table.
    """
    both = edges.where("a != b").select("a", "b").union(edges.where("a != b").select("b", "a")).distinct()
    graph = materialise(both, "graph")
    roots = materialise(graph.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "roots")
    while True:
        heard = graph.join(roots, graph.b == roots.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        lower = materialise(roots.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root")), "lower")
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        # A giant component has one root: its nodes are not to meet in a task to learn the root's own root.
        jumped = join_beside_hot(lower, above, "root").select("node", "was", F.least("root", "upper").alias("root"))
        written = materialise(jumped, "roots")
        roots = written.select("node", "root")
        if written.where("root != was").isEmpty():
            return roots
