"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """v and root (the smallest vertex that v reaches) of every vertex of edges(a, b).

    Each round takes the smallest root among the neighbours and then the root's own root
    (pointer jumping), so that rounds grow with the logarithm of a component's width. A
    round's labels are a table in the shared folder; nothing comes to the driver but a count.
    Minima are taken before and after the shuffle, so a vertex of any degree is no hot spot.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")), "roots")
    while True:
        reached = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(reached, labels.v == reached.a).select("v", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("at"), F.col("root").alias("beyond"))
        new = materialise(nearer.join(jump, nearer.root == jump.at).select("v", "was", F.least("root", "beyond").alias("root")), "roots")
        labels = new.select("v", "root")
        if new.where("root != was").isEmpty():
            return labels
