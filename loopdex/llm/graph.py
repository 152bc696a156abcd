"""Connected components by minimum labels with pointer jumping; every step is a join with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopdex.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    A round sends labels along the edges (min is combined before the shuffle) and then lets each node take its
    label's label, so chains shrink geometrically. Labels are written to the shared folder after every round."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, label.node == near.a).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        step = written(step, "labels")
        up = step.select(F.col("node").alias("parent"), F.col("component").alias("parent_component"))
        moved = written(step.join(up, step.component == up.parent, "left").select("node", F.least("component", "parent_component").alias("component"), "old"), "labels")
        label = moved.select("node", "component")
        if moved.where("component <> old").limit(1).count() == 0:
            return label
