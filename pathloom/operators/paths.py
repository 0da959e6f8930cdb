"""Cheapest simple paths of a bounded number of hops, for many pairs at once.

candidates() makes what the k best need and little more. The least cost from every node to
the answer in so many hops (of any walk, so a bound from below) comes from one join for each
hop. A narrow search by cost plus bound then finds some paths, whose k-th cost bounds the
true one from above, and a second search keeps every partial path whose cost plus bound
does not exceed that. Where the narrow search finds fewer than k, nothing is left out.

enumerate_paths() makes all paths. They grow from both ends and meet in the middle: a path
of h hops is a forward half of ceil(h/2) and a backward half of floor(h/2) hops that share
one node and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from ..sources.durable import durable

MAX_HOPS = 5
#: Partial paths that the narrow search keeps for each path asked for; the result does not depend on it.
NARROW = 8
#: By how much a sum of costs may differ with its order, relative to its size.
SLACK = 1e-8


def both_ends(edges: DataFrame) -> DataFrame:
    """pair, node, other, rel_id, cost: each edge (pair, u, v, rel_id, cost) from either end, without loops."""
    there = edges.where("u <> v").select("pair", F.col("u").alias("node"), F.col("v").alias("other"), "rel_id", "cost")
    return there.unionByName(there.select("pair", F.col("other").alias("node"), F.col("node").alias("other"), "rel_id", "cost"))


def _grow(paths: DataFrame, steps: DataFrame, avoid: str) -> DataFrame:
    """Each path one hop longer, to nodes that are neither on it nor its pair's other end."""
    joined = paths.join(steps, ["pair", "node"]).where(~F.array_contains("nodes", F.col("other")) & (F.col("other") != F.col(avoid)))
    return joined.select("pair", "topic", "answer", F.col("other").alias("node"), F.array_append("nodes", F.col("other")).alias("nodes"), F.array_append("rels", F.col("rel_id")).alias("rels"), (paths.cost + steps.cost).alias("cost"))


def enumerate_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """pair, topic, answer, hop, nodes, rels and cost of every simple path of 1 to max_hops hops.

    edges: pair, u, v, rel_id, cost, one for each (pair, u, v). pairs: pair, topic, answer; equal ends have no path.
    Costs are rounded to nine decimals, so that a path costs the same in whatever order it was summed.
    """
    steps = durable(both_ends(edges), "steps")
    no_rels, no_cost = F.array().cast("array<int>"), F.lit(0.0)
    ends = pairs.where("topic <> answer").select("pair", "topic", "answer")
    forward = [ends.select("*", F.col("topic").alias("node"), F.array("topic").alias("nodes"), no_rels.alias("rels"), no_cost.alias("cost"))]
    backward = [ends.select("*", F.col("answer").alias("node"), F.array("answer").alias("nodes"), no_rels.alias("rels"), no_cost.alias("cost"))]
    for _ in range((max_hops + 1) // 2):
        # the last forward half of one hop may end in the answer; longer halves may not pass it
        forward.append(durable(_grow_to(forward[-1], steps), "forward"))
    for _ in range(max_hops // 2):
        backward.append(durable(_grow(backward[-1], steps, "topic"), "backward"))
    found = None
    for h in range(1, max_hops + 1):
        f, b = forward[(h + 1) // 2], backward[h // 2]
        if h == 1:
            complete = f.where("node = answer").select("pair", "topic", "answer", "nodes", "rels", "cost")
        else:
            left = f.where("node <> answer").select("pair", "topic", "answer", "node", F.col("nodes").alias("fn"), F.col("rels").alias("fr"), F.col("cost").alias("fc"))
            right = b.select("pair", "node", F.col("nodes").alias("bn"), F.col("rels").alias("br"), F.col("cost").alias("bc"))
            met = left.join(right, ["pair", "node"]).where(F.size(F.array_intersect("fn", "bn")) == 1)
            back = F.reverse(F.col("bn"))
            complete = met.select("pair", "topic", "answer", F.concat("fn", F.slice(back, F.lit(2), F.size("bn") - 1)).alias("nodes"), F.concat("fr", F.reverse(F.col("br"))).alias("rels"), (F.col("fc") + F.col("bc")).alias("cost"))
        complete = complete.select("pair", "topic", "answer", F.lit(h).alias("hop"), "nodes", "rels", F.round("cost", 9).alias("cost"))
        found = complete if found is None else found.unionByName(complete)
    return found


def _least(ends: DataFrame, steps: DataFrame, max_hops: int) -> DataFrame:
    """pair, left, node and least: the least cost of a walk of `left` hops from a node to the pair's answer, for 0 to max_hops - 1 hops."""
    out = at = ends.select("pair", F.col("answer").alias("node"), F.lit(0.0).alias("least")).withColumn("left", F.lit(0))
    for left in range(1, max_hops):
        back = at.select("pair", F.col("node").alias("other"), "least")
        at = durable(steps.join(back, ["pair", "other"]).groupBy("pair", "node").agg(F.min(F.col("cost") + F.col("least")).alias("least")), "least").withColumn("left", F.lit(left))
        out = out.unionByName(at)
    return durable(out, "bounds")


def _search(ends: DataFrame, steps: DataFrame, least: DataFrame, max_hops: int, keep) -> DataFrame:  # noqa: ANN001
    """All h from 1 to max_hops at once: paths of h hops grown from the topic, of which keep() leaves some at each depth. keep sees pair, hop, first (the first node after the topic), nodes and estimate."""
    hops = F.explode(F.sequence(F.lit(1), F.lit(max_hops))).alias("hop")
    at = ends.select("pair", "topic", "answer", hops).select("*", F.col("topic").alias("node"), F.array("topic").alias("nodes"), F.array().cast("array<int>").alias("rels"), F.lit(0.0).alias("cost"))
    out = None
    for depth in range(1, max_hops + 1):
        onward = at.where(F.col("hop") >= depth).join(steps.withColumnRenamed("cost", "step"), ["pair", "node"])
        last = F.col("hop") == depth
        onward = onward.where(~F.array_contains("nodes", F.col("other")) & ((F.col("other") == F.col("answer")) == last)).withColumn("left", F.col("hop") - depth)
        bound = least.select("pair", "left", F.col("node").alias("other"), "least")
        grown = onward.join(bound, ["pair", "left", "other"]).select(
            "pair", "topic", "answer", "hop", F.col("other").alias("node"), F.array_append("nodes", F.col("other")).alias("nodes"), F.array_append("rels", F.col("rel_id")).alias("rels"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("cost") + F.col("step") + F.col("least")).alias("estimate"),
        )
        at = durable(keep(grown.withColumn("first", F.get("nodes", F.lit(1)))).drop("first", "estimate"), "grown")
        done = at.where(F.col("hop") == depth)
        out = done if out is None else out.unionByName(done)
    return out.select("pair", "topic", "answer", "hop", "nodes", "rels", F.round("cost", 9).alias("cost"))


def candidates(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 5, max_hops: int = MAX_HOPS, dedup: str = "none") -> DataFrame:
    """As enumerate_paths(), but only paths that can be among the k best of their pair and hop (and so among the pair's), as by_hop() with this dedup finds them. nodes: node_id, type."""
    steps = durable(both_ends(edges), "steps")
    ends = durable(pairs.where("topic <> answer").select("pair", "topic", "answer"), "ends")
    least = _least(ends, steps, max_hops)
    # "first_type" takes the best of each type of the first node: each type has a bound of its own
    kinds = nodes.select(F.col("node_id").alias("first"), F.col("type").alias("kind"))
    kind = (lambda df: df.join(kinds, "first")) if dedup == "first_type" else (lambda df: df.withColumn("kind", F.lit("")))
    own = group("pair", "hop", "kind")
    narrow = _search(ends, steps, least, max_hops, lambda df: kind(df).withColumn("_n", best(own, F.col("estimate"), F.col("nodes"))).where(F.col("_n") <= NARROW * k).drop("_n", "kind"))
    found = kind(with_types(narrow, nodes).withColumn("first", F.get("nodes", F.lit(1))))
    if dedup == "type_sig":
        found = found.withColumn("_s", best(group("pair", "hop", "types", "rels"), F.col("cost"), F.col("nodes"))).where("_s = 1")
    kth = found.withColumn("_n", best(own, F.col("cost"), F.col("nodes"))).where(F.col("_n") == k).select("pair", "hop", "kind", (F.col("cost") + SLACK * F.greatest(F.lit(1.0), F.abs("cost"))).alias("most"))
    kth = durable(kth, "kth")
    return _search(ends, steps, least, max_hops, lambda df: kind(df).join(kth, ["pair", "hop", "kind"], "left").where(F.col("most").isNull() | (F.col("estimate") <= F.col("most"))).drop("kind", "most"))


def _grow_to(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """One hop longer from paths that haven't reached the answer."""
    joined = paths.where("node <> answer").join(steps, ["pair", "node"]).where(~F.array_contains("nodes", F.col("other")))
    return joined.select("pair", "topic", "answer", F.col("other").alias("node"), F.array_append("nodes", F.col("other")).alias("nodes"), F.array_append("rels", F.col("rel_id")).alias("rels"), (paths.cost + steps.cost).alias("cost"))


def cheapest(paths: DataFrame, k: int, *by: str) -> DataFrame:
    """The k cheapest paths of each pair (and `by`), with rank; ties to the smaller node ids."""
    return paths.withColumn("rank", best(group("pair", *by), F.col("cost"), F.col("nodes"))).where(F.col("rank") <= k)


def with_types(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths with `types`, the types of their nodes in order."""
    flat = paths.select("pair", "nodes", F.posexplode("nodes").alias("pos", "node_id")).distinct().join(nodes.select("node_id", "type"), "node_id")
    types = flat.groupBy("pair", "nodes").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]).alias("types"))
    return paths.join(types, ["pair", "nodes"])


def by_hop(paths: DataFrame, k: int = 5, dedup: str = "none") -> DataFrame:
    """The k cheapest paths of each pair and hop. dedup: "type_sig" keeps the cheapest of each (types, rels); "first_type"
    takes the cheapest of each type of the first node after the topic before others. Both read `types`."""
    if dedup == "none":
        return cheapest(paths, k, "hop")
    if dedup == "type_sig":
        once = paths.withColumn("_n", best(group("pair", "hop", "types", "rels"), F.col("cost"), F.col("nodes"))).where("_n = 1").drop("_n")
        return cheapest(once, k, "hop")
    if dedup == "first_type":
        marked = paths.withColumn("_n", best(group("pair", "hop", F.get(F.col("types"), F.lit(1))), F.col("cost"), F.col("nodes")))
        return marked.withColumn("rank", best(group("pair", "hop"), (F.col("_n") > 1), F.col("cost"), F.col("nodes"))).where(F.col("rank") <= k).drop("_n")
    raise ValueError(f"no dedup mode {dedup}")


def shown(names: str, relations: str) -> Column:
    """name -[relation]-> name ... of two parallel arrays."""
    first = F.get(F.col(names), F.lit(0))
    rest = F.zip_with(relations, F.slice(F.col(names), F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), lambda r, n: F.concat(F.lit(" →["), r, F.lit("]→ "), n))
    return F.concat(first, F.array_join(rest, ""))
