"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component of every node of an edge; the component is its least node.

    Each round every node takes the least label among itself and its neighbours, then the label of that label; a long
    chain is so halved each round. Edges and labels stay in the cluster; a round's labels are written to the shared
    folder. Loops and copies of edges change nothing; edges with a null end are none; no edges give no rows.
    """
    own = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    both = cut(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    while True:
        labels = cut(labels)
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("root"))
        moved = cut(step.join(jump, "c", "left").select("node", "was", F.least("c", F.coalesce("root", "c")).alias("component")))
        if moved.filter("was <> component").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
