"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import written


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, label`` of every node of ``edges(a, b)``: the smallest node of its component.

    A round is two joins and a partially aggregated minimum, written to the shared folder; the number of rounds grows
    with the logarithm of the longest path.  The driver sees one flag a round.
    """
    both = edges.select("a", "b").where("a != b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        step = written(step, "cc-step")
        up = step.select(F.col("node").alias("up_node"), F.col("next").alias("up"))
        jumped = written(
            step.join(up, step.next == up.up_node).select("node", F.col("label").alias("was"), F.least("next", "up").alias("label")),
            "cc-labels",
        )
        labels = jumped.select("node", "label")
        if jumped.where("was != label").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
