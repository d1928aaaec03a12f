"""Connected components of links by contraction: every round each component hooks onto its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """links(x, y), any comparable type -> (node, component): the smallest node that links reach.

    Nodes without links aren't returned. A node with very many links is pre-aggregated before each shuffle, and what
    is shuffled shrinks every round; rounds grow with the logarithm of the longest path.
    """
    links = checkpointed(links.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    nodes = links.select(F.col("x").alias("node")).union(links.select(F.col("y"))).distinct()
    labels, first = nodes.withColumn("component", F.col("node")), True
    while not links.isEmpty():
        both = links.union(links.select("y", "x"))
        parent = both.groupBy(F.col("x").alias("c")).agg(F.min("y").alias("p")).withColumn("p", F.least("c", "p"))
        while True:  # parents of parents, twice as far each time, up to the roots
            for _ in range(2):
                up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
                parent = parent.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), (F.col("pp") < F.col("p")).alias("moved"))
            parent = checkpointed(parent)
            if parent.where("moved").isEmpty():
                break
        parent = parent.drop("moved")
        if first:
            labels, first = parent.select(F.col("c").alias("node"), F.col("p").alias("component")), False
        else:
            labels = labels.join(parent, labels.component == parent.c, "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = checkpointed(labels)
        left, right = parent.select(F.col("c").alias("x"), F.col("p").alias("px")), parent.select(F.col("c").alias("y"), F.col("p").alias("py"))
        moved = links.join(left, "x").join(right, "y").where("px <> py")
        links = checkpointed(moved.select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct())
    return labels
