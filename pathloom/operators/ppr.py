"""Personalised PageRank over weighted undirected edges, for many seed sets at once.

`damping` is the probability to go on along an edge (0.15), so the walk is short: the
error after n rounds is 2 * damping^n. State is a table keyed by node with a column for each of
up to SLOTS runs over the same edges, so that these share a row; a round is one join with the
edges out of each node, which stay dealt by node, and one sum. Only nodes that a run has reached hold rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from ..sources.durable import durable

DAMPING, ROUNDS = 0.15, 12
#: Rounds between two tables on disk; lineage in between is short enough to plan quickly.
KEEP_EVERY = 4
#: Runs that share the rows of the state, at most.
SLOTS = 8


def transitions(directed: DataFrame, *keys: str) -> DataFrame:
    """(keys,) node, other and share: the probability of each step. directed: (keys,) node, other, weight; parallel edges add up."""
    steps = directed.groupBy(*keys, "node", "other").agg(F.sum("weight").alias("weight"))
    total = steps.groupBy(*keys, "node").agg(F.sum("weight").alias("total"))
    return steps.join(total, [*keys, "node"]).select(*keys, "node", "other", (F.col("weight") / F.col("total")).alias("share"))


def rank(seeds: DataFrame, steps: DataFrame, keys: tuple[str, ...] = (), damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """run, node and pi. seeds: run, (keys,) node, reset, the resets of a run summing to 1. steps: what transitions() returns.

    A seed without edges keeps all of its mass.
    """
    on = [*keys, "node"]
    blocks = max(1, -(-seeds.select("run").distinct().count() // SLOTS))
    dealt = seeds.select("run", *keys).distinct().withColumn("_deal", F.pmod(F.xxhash64("run"), F.lit(blocks)))
    runs = durable(dealt.withColumn("_n", best(group(*keys, "_deal"), F.col("run")) - 1), "runs")
    runs = runs.select("run", *keys, F.concat_ws(".", "_deal", F.floor(F.col("_n") / SLOTS)).alias("_block"), (F.col("_n") % SLOTS).alias("_slot"))
    width = (runs.agg(F.max("_slot")).first()[0] or 0) + 1
    shares = [f"_p{i}" for i in range(width)]
    state = ["_block", *on]
    # every round joins with all steps: they are dealt by node and sorted once and kept so; a lost part is made again
    partitions = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = steps.repartition(partitions, *on).sortWithinPartitions(*on).persist()
    edged = steps.select(*on).distinct()
    lonely = seeds.join(edged, on, "left_anti").select("run", *on, F.col("reset").alias("pi"))
    placed = seeds.join(edged, on, "left_semi").join(runs, ["run", *keys])
    start = durable(placed.groupBy(*state).agg(*(F.sum(F.when(F.col("_slot") == i, F.col("reset")).otherwise(0.0)).alias(p) for i, p in enumerate(shares))), "seeds")
    restart = start.select(*state, *((F.lit(1 - damping) * F.col(p)).alias(p) for p in shares))
    pi = start
    for n in range(1, rounds + 1):
        moved = pi.join(steps, on).select("_block", *keys, F.col("other").alias("node"), *((F.lit(damping) * F.col(p) * F.col("share")).alias(p) for p in shares))
        pi = moved.unionByName(restart).groupBy(*state).agg(*(F.sum(p).alias(p) for p in shares))
        if n % KEEP_EVERY == 0 and n < rounds:
            pi = durable(pi, "ranks")
    each = pi.select("_block", *keys, "node", F.inline(F.array(*(F.struct(F.lit(i).alias("_slot"), F.col(p).alias("pi")) for i, p in enumerate(shares)))))
    reached = each.where("pi > 0").join(runs, [*keys, "_block", "_slot"]).select("run", "node", "pi")
    out = durable(reached.unionByName(lonely.select("run", "node", "pi")), "ranks")
    steps.unpersist()
    return out


def seed_shares(weighting: str, topic_degree: Column, answer_degree: Column) -> tuple[Column, Column]:
    """Reset shares of topic and answer: half each, or by the other's degree (degree_inv), or by their own (degree_proportional)."""
    total = topic_degree + answer_degree
    half = F.lit(0.5)
    if weighting == "uniform":
        return half, half
    if weighting not in ("degree_inv", "degree_proportional"):
        raise ValueError(f"no seed weighting {weighting}")
    a, b = (answer_degree, topic_degree) if weighting == "degree_inv" else (topic_degree, answer_degree)
    return F.when(total > 0, a / total).otherwise(half), F.when(total > 0, b / total).otherwise(half)


def multi_seed(pairs: DataFrame, degree: DataFrame, weighting: str = "uniform") -> DataFrame:
    """Seeds (run = pair) with topic and answer in one run."""
    d = lambda end: degree.toDF(end, f"{end}_degree")
    both = pairs.join(d("topic"), "topic", "left").join(d("answer"), "answer", "left").fillna(0, ["topic_degree", "answer_degree"])
    t, a = seed_shares(weighting, F.col("topic_degree"), F.col("answer_degree"))
    seeds = both.select(F.col("pair").alias("run"), F.explode(F.array(F.struct(F.col("topic").alias("node"), t.alias("reset")), F.struct(F.col("answer").alias("node"), a.alias("reset")))).alias("s"))
    return seeds.groupBy("run", "s.node").agg(F.sum("s.reset").alias("reset"))


def product(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """pair, node and score: the product of the ranks seen from the topic and from the answer. pairs: pair, topic_run, answer_run."""
    t = ranks.toDF("topic_run", "node", "pi_t")
    a = ranks.toDF("answer_run", "node", "pi_a")
    return pairs.join(t, "topic_run").join(a, ["answer_run", "node"]).select("pair", "node", (F.col("pi_t") * F.col("pi_a")).alias("score"))


def rank_product(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """As product(), of the reciprocal places instead of the ranks (1 is the highest; ties, to nine decimals of the logarithm, to the smaller node)."""
    placed = ranks.withColumn("pi", F.lit(1.0) / best(group("run"), F.round(F.log("pi"), 9).desc(), F.col("node")))
    return product(pairs, placed)
