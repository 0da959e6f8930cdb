"""Edge weights that depend on a query, and edge costs. Both are derived columns; edges are never changed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import durable

BETA, LEAST, EPSILON, ALPHA = 0.3, 1e-6, 1e-8, 0.5


def weight(s_r: Column, s_u: Column, s_v: Column, beta: float = BETA, least: float = LEAST) -> Column:
    """A share beta of the relation's similarity and the rest of the mean of the ends', but `least` at the smallest."""
    return F.greatest(F.lit(least), F.lit(beta) * s_r + F.lit(1.0 - beta) * (s_u + s_v) / 2.0)


def edge_weights(edges: DataFrame, queries: DataFrame, node_sim: DataFrame, rel_sim: DataFrame, beta: float = BETA, least: float = LEAST) -> DataFrame:
    """query, u, v, rel_id and weight of every edge for every query.

    node_sim(query, node, sim) and rel_sim(query, rel_id, sim) hold the similarities that aren't 0. A query carries
    those of its relations (as many as a schema has) as a map, since (query, relation) would be a hot key; edges are matched
    with its similarities of nodes on (query, end).
    """
    of_relations = rel_sim.toDF("query", "rel_id", "sim").groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("rel_id", "sim"))).alias("_rels"))
    asked = edges.crossJoin(queries.select("query").join(of_relations, "query", "left"))  # the stated queries against all edges
    u, v = (node_sim.toDF("query", end, f"s_{end}") for end in ("u", "v"))
    zero = F.lit(0.0)
    each = asked.select("query", "u", "v", "rel_id", F.coalesce(F.try_element_at("_rels", F.col("rel_id")), zero).alias("s_r"))
    joined = each.join(u, ["query", "u"], "left").join(v, ["query", "v"], "left")
    return joined.select("query", "u", "v", "rel_id", weight(F.col("s_r"), F.coalesce("s_u", zero), F.coalesce("s_v", zero), beta, least).alias("weight"))


class Weighting(NamedTuple):
    """What the weights of all questions are made of: node_sim(query, node, sim) and rel_sim(query, rel_id, sim), where they aren't 0."""

    node_sim: DataFrame
    rel_sim: DataFrame
    beta: float = BETA
    least: float = LEAST

    def of(self, s_r: Column, s_u: Column, s_v: Column) -> Column:
        return weight(s_r, s_u, s_v, self.beta, self.least)


def weigh(edges: DataFrame, by: Weighting) -> DataFrame:
    """edges (query, u, v, rel_id and others) of some questions, those of a corridor say, with `weight`."""
    zero = F.lit(0.0)
    u, v = (by.node_sim.toDF("query", end, f"_s_{end}") for end in ("u", "v"))
    joined = edges.join(by.rel_sim.toDF("query", "rel_id", "_s_r"), ["query", "rel_id"], "left").join(u, ["query", "u"], "left").join(v, ["query", "v"], "left")
    return joined.select(*edges.columns, by.of(F.coalesce("_s_r", zero), F.coalesce("_s_u", zero), F.coalesce("_s_v", zero)).alias("weight"))


def classes(node_sim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and class of the nodes that are similar to some question, and query, class and sim: nodes alike in all similarities are a class, named by its smallest node."""
    sims = F.array_sort(F.collect_list(F.struct("query", "sim"))).alias("sims")
    own = durable(node_sim.toDF("query", "node", "sim").where("sim <> 0").groupBy("node").agg(sims), "own")
    named = durable(own.groupBy("sims").agg(F.min("node").alias("class")), "classes")
    return own.join(named, "sims").select("node", "class"), named.select("class", F.inline("sims")).select("query", "class", "sim")


def kinds(edges: DataFrame, marks: DataFrame, *by: str) -> DataFrame:
    """by, u_..., v_... and n: how many edges (u, v, by) are alike in `by` and in what marks(node, ...) say of their ends. Nodes without marks have nulls."""
    for end in ("u", "v"):
        edges = edges.join(marks.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in marks.columns if c != "node")), end, "left")
    return durable(edges.groupBy(*by, *(f"{end}_{c}" for end in ("u", "v") for c in marks.columns if c != "node")).agg(F.count("*").alias("n")), "kinds")


def histogram(edges: DataFrame, queries: DataFrame, by: Weighting, digits: int = 6) -> DataFrame:
    """query, rel_id, weight (rounded) and edges: how many edges of a relation weigh how much for each question.

    Edges are counted by relation and by their ends' classes before they meet a question, and then meet only the questions to which
    one of their ends is similar; the rest of a relation's edges is a difference of counts. So no edge is written for each question.
    """
    zero = F.lit(0.0)
    marks, sims = classes(by.node_sim)
    alike = kinds(edges.select("u", "v", "rel_id"), marks, "rel_id").toDF("rel_id", "u", "v", "n")
    u, v = (sims.toDF("query", end, f"s_{end}") for end in ("u", "v"))
    from_u = alike.join(u, "u").join(v, ["query", "v"], "left")
    only_v = alike.join(v, "v").join(u, ["query", "u"], "left_anti").withColumn("s_u", zero)
    both = from_u.select("query", "rel_id", F.col("s_u") + F.coalesce("s_v", zero), "n").union(only_v.select("query", "rel_id", F.col("s_u") + F.col("s_v"), "n")).toDF("query", "rel_id", "ends", "n")
    touched = both.groupBy("query", "rel_id", "ends").agg(F.sum("n").alias("edges"))
    every = queries.select("query").join(alike.groupBy("rel_id").agg(F.sum("n").alias("all")))  # questions by a schema's relations
    rest = every.join(touched.groupBy("query", "rel_id").agg(F.sum("edges").alias("_n")), ["query", "rel_id"], "left")
    rest = rest.select("query", "rel_id", zero.alias("ends"), (F.col("all") - F.coalesce("_n", F.lit(0))).alias("edges")).where("edges > 0")
    rel = by.rel_sim.toDF("query", "rel_id", "s_r")
    weighed = touched.unionByName(rest).join(rel, ["query", "rel_id"], "left")
    return weighed.groupBy("query", "rel_id", F.round(by.of(F.coalesce("s_r", zero), F.col("ends"), zero), digits).alias("weight")).agg(F.sum("edges").alias("edges"))


def best_histogram(edges: DataFrame, queries: DataFrame, by: Weighting, marks: DataFrame) -> DataFrame:
    """query, weight, the marks of both ends (u_..., v_...) and n: how many of best_edges() of all questions are alike. marks: node and others, of every node with edges.

    The edges between two nodes are one with a list of relations, of which the most similar weighs most; the questions meet counts of those alike.
    """
    zero = F.lit(0.0)
    own, sims = classes(by.node_sim)
    pairs = edges.groupBy("u", "v").agg(F.array_sort(F.collect_set("rel_id")).alias("rels"))
    alike = kinds(pairs, durable(marks.join(own, "node", "left"), "marks"), "rels")
    lists = alike.select("rels").distinct().withColumn("rel_id", F.explode("rels")).join(by.rel_sim.toDF("query", "rel_id", "sim"), "rel_id")
    top = lists.groupBy("query", "rels").agg(F.max("sim").alias("s_max"), F.count("*").alias("known"))
    top = top.select("query", "rels", F.when(F.col("known") < F.size("rels"), F.greatest("s_max", zero)).otherwise(F.col("s_max")).alias("s_r"))
    asked = alike.crossJoin(queries.select("query")).join(top, ["query", "rels"], "left")  # the stated questions against all kinds
    for end in ("u", "v"):
        asked = asked.join(sims.toDF("query", f"{end}_class", f"s_{end}"), ["query", f"{end}_class"], "left")
    weight_ = by.of(F.coalesce("s_r", zero), F.coalesce("s_u", zero), F.coalesce("s_v", zero)).alias("weight")
    return asked.select("query", weight_, *(f"{end}_{c}" for end in ("u", "v") for c in marks.columns if c != "node"), "n")


def best_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """One edge for each (keys, u, v): the heaviest, ties to the smallest rel_id."""
    return edges.groupBy(*keys, "u", "v").agg(F.max_by(F.struct("rel_id", "weight"), F.struct("weight", -F.col("rel_id"))).alias("e")).select(*keys, "u", "v", "e.rel_id", "e.weight")


def cost(mode: str, w: Column, p: Column | None = None, alpha: float = ALPHA, epsilon: float = EPSILON) -> Column:
    """Cost of an edge of weight w whose ends have the mean (max-normalised) rank score p."""
    if mode == "edge_weight":
        return 1.0 / (w + epsilon)
    if mode == "ppr_only":
        return 1.0 / (p + epsilon)
    if mode == "ppr_mix":
        return 1.0 / (F.lit(alpha) * w + F.lit(1.0 - alpha) * p + epsilon)
    raise ValueError(f"no cost mode {mode}")
