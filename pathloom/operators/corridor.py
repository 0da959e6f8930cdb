"""Corridors: the best-ranked nodes between a topic and an answer, widened until they are connected.

All pairs and all widths of the ladder are treated in one plan: a node's place in its
pair's ranking says from which width on it belongs, an edge belongs from the larger of its
ends' widths on, and the width at which topic and answer first connect is the bottleneck of
their path in a spanning forest of least bottlenecks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from ..sources.durable import durable

LADDER = (150, 300, 500, 1000)


def top_nodes(scores: DataFrame, k: int) -> DataFrame:
    """pair, node, score and place (1 first) of the k best nodes of each pair.

    Scores that agree in their logarithm's first nine decimals tie, to the smaller node: nodes in equal
    positions have equal scores but for the order in which sums were taken.
    """
    order = F.round(F.log("score"), 9).desc_nulls_last()
    return scores.withColumn("place", best(group("pair"), order, F.col("node"))).where(F.col("place") <= k)


def ladder_nodes(scores: DataFrame, pairs: DataFrame, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """pair, node, score and width: the first rung of the ladder that takes a node in. Topic and answer are in all."""
    rung = F.lit(None)
    for k in sorted(ladder, reverse=True):
        rung = F.when(F.col("place") <= k, k).otherwise(rung)
    ranked = top_nodes(scores, max(ladder)).select("pair", "node", "score", rung.alias("width"))
    ends = pairs.select("pair", F.explode(F.array("topic", "answer")).alias("node")).join(scores, ["pair", "node"], "left")
    forced = ends.select("pair", "node", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(min(ladder)).alias("width"))
    return ranked.unionByName(forced).groupBy("pair", "node").agg(F.max("score").alias("score"), F.min("width").alias("width"))


def induced(edges: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """pair, u, v, (more,) and width of the edges between nodes(pair, node, width) of one pair."""
    u = nodes.select("pair", F.col("node").alias("u"), F.col("width").alias("_u"))
    v = nodes.select("pair", F.col("node").alias("v"), F.col("width").alias("_v"))
    return edges.join(u, "u").join(v, ["pair", "v"]).select("pair", "u", "v", *more, F.greatest("_u", "_v").alias("width"))


class Forest(NamedTuple):
    """widths: pair, topic, answer and width, the smallest rung at which topic and answer are connected, null if none does. edges: pair, u, v and width of a spanning forest of least bottlenecks, as far as it was built. rounds: tables of pointers written."""

    widths: DataFrame
    edges: DataFrame | None
    rounds: int


def _roots(pointers: DataFrame) -> tuple[DataFrame, int]:
    """pair, node and root: where the pointers (pair, node, to) end, a root pointing to itself. They are doubled until none moves."""
    rounds = 0
    while True:
        onward = pointers.select("pair", F.col("node").alias("to"), F.col("to").alias("beyond"))
        moved = durable(pointers.join(onward, ["pair", "to"]).select("pair", "node", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")), "pointers")
        pointers, rounds = moved.select("pair", "node", "to"), rounds + 1
        if moved.where("moved").isEmpty():
            return pointers.withColumnRenamed("to", "root"), rounds


def bottleneck_forest(pairs: DataFrame, edges: DataFrame) -> Forest:
    """A spanning forest of least bottlenecks for each pair's edges(pair, u, v, width), built until topic and answer are in one tree.

    Rung after rung, every tree picks the lightest edge that leaves it (ties to the smaller ends), trees point along what they picked to
    one root, and edges move to the roots of their ends; those within a tree go. Trees at least halve with each
    round, whatever the graph's diameter, and pairs whose ends have met take no further part.
    """
    rungs = sorted(r[0] for r in edges.select("width").distinct().collect())  # those of a ladder
    open_, done = pairs.select("pair", "topic", "answer", F.col("topic").alias("t"), F.col("answer").alias("a")), []
    done.append(open_.where("t = a").withColumn("width", F.lit(0)))
    open_ = durable(open_.where("t <> a"), "open")
    left = edges.where("u <> v").select("pair", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "width").groupBy("pair", "u", "v").agg(F.min("width").alias("width"))
    left = durable(left.withColumn("edge", F.struct("u", "v")).join(open_.select("pair").distinct(), "pair", "left_semi"), "edges")
    forest, rounds = None, 0
    for rung in rungs:
        while not (light := left.where(F.col("width") <= rung)).isEmpty():
            ends = light.select("pair", F.col("u").alias("node"), F.struct("width", "edge", F.col("v").alias("to")).alias("e")).union(light.select("pair", "v", F.struct("width", "edge", F.col("u"))))
            picked = durable(ends.groupBy("pair", "node").agg(F.min("e").alias("e")).select("pair", "node", "e.to", "e.edge", "e.width"), "picked")
            own = picked.select("pair", "edge.u", "edge.v", "width").distinct()
            forest = own if forest is None else forest.unionByName(own)
            # where two picked one edge between them, the smaller is the root
            back = picked.select("pair", F.col("node").alias("to"), F.col("to").alias("back"))
            pointers = picked.join(back, ["pair", "to"], "left").select("pair", "node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))
            roots, n = _roots(durable(pointers, "pointers"))
            rounds += n

            def at_root(df: DataFrame, end: str, roots: DataFrame = roots) -> DataFrame:
                own = roots.select("pair", F.col("node").alias(end), F.col("root").alias("_root"))
                return df.join(own, ["pair", end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")

            met = durable(at_root(at_root(open_, "t"), "a"), "open")
            done.append(met.where("t = a").withColumn("width", F.lit(rung)))
            open_ = met.where("t <> a")
            moved = at_root(at_root(left.join(open_.select("pair").distinct(), "pair", "left_semi"), "u"), "v").where("u <> v")
            each = moved.groupBy("pair", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("width", "edge")).alias("e"))
            left = durable(each.select("pair", "u", "v", "e.width", "e.edge"), "edges")
    widths = open_.withColumn("width", F.lit(None).cast("int"))
    for own in done:
        widths = widths.unionByName(own)
    return Forest(widths.select("pair", "topic", "answer", "width"), forest, rounds)


def connected_width(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pair, topic, answer and width: the smallest rung at which topic and answer are connected, null if none does. edges: pair, u, v, width."""
    return bottleneck_forest(pairs, edges).widths
