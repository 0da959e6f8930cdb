"""Personalised PageRank by pushing residuals from the seeds, over weights that are never written out by edge and question.

A run holds a residual at the nodes it has come to; a round pushes what lies at them along their edges and leaves
a share of it where it was. Only the edges of nodes with a residual are read. A node whose residual is not above
`floor` keeps it until more comes; the run ends when nothing is above, or when what is left in all is below `residual`, and
what is left stays where it is, so ranks sum to one and no rank is wrong by more than twice that.

The weight of an edge for a question is a sum, of its relation's share and of its ends' shares, unless that is under the least weight:
w = max(least, k + c s_u + c s_v). So what arrives at v from many u is

    sum x_u (k + c s_u)  +  c s_v sum x_u  +  [s_v = 0] sum over u with s_u = 0 of x_u max(least - k, 0),

three sums that need no similarity of v; it is joined once for each node that is reached, not for each edge. (An end whose similarity
is above 0 lifts an edge over the least weight. Where one is so small that it doesn't, `exact` weighs each edge by itself.)
The sum of the weights around a node, by which its residual is divided, is taken when a run first comes to it.

Up to LANES runs share a row of the state and so read an edge once, whatever their questions. The graph is a table
bucketed by node, so rounds don't shuffle it; each round's state is a table in the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from ..sources import kg
from ..sources.durable import bucketed, durable
from . import spread
from .weights import Weighting

DAMPING = 0.15
#: What may be left of a run's mass when it ends.
RESIDUAL = 2e-10
#: Runs that share a row, at most.
LANES = 8


def adjacency(edges: DataFrame) -> DataFrame:
    """node, other and rels (the relations between them, in order) from both ends of edges(u, v, rel_id), bucketed by node."""
    both = kg.both_ways(edges.select("u", "v", "rel_id"))
    return bucketed(both.groupBy("node", "other").agg(F.array_sort(F.collect_set("rel_id")).alias("rels")), "adjacency", "node")


def _lanes(seeds: DataFrame, most: int = LANES) -> tuple[DataFrame, int]:
    """run, query, block and lane of each run, dealt by hash; lanes of a block."""
    runs = durable(seeds.select("run", "query").distinct(), "runs")
    blocks = max(1, -(-runs.count() // most))
    dealt = runs.withColumn("_deal", F.pmod(F.xxhash64("run"), F.lit(blocks))).withColumn("_n", best(group("_deal"), F.col("run")) - 1)
    dealt = durable(dealt.select("run", "query", F.concat_ws(".", "_deal", F.floor(F.col("_n") / most)).alias("block"), (F.col("_n") % most).alias("lane")), "lanes")
    return dealt, (dealt.agg(F.max("lane")).first()[0] or 0) + 1


class Push:
    """Runs over one graph and weighting. seeds: run, query, node and reset, the resets of a run summing to 1. steps: what adjacency() returns."""

    def __init__(self, seeds: DataFrame, steps: DataFrame, by: Weighting, damping: float = DAMPING, residual: float = RESIDUAL, floor: float = 0.0):
        self.steps, self.by, self.damping, self.floor = steps, by, damping, floor
        self.rounds = max(1, math.ceil(math.log(residual) / math.log(damping)))
        self.half = (1.0 - by.beta) / 2.0
        self.runs, self.width = _lanes(seeds)
        self.sims = durable(self._by_lane(by.node_sim.toDF("query", "node", "sim"), "node", F.sum, "s"), "similarities")
        kinds = steps.select("rels").distinct().select("rels", F.explode("rels").alias("rel_id")).join(by.rel_sim.toDF("query", "rel_id", "sim"), "rel_id")
        self.kinds = durable(self._by_lane(kinds.withColumn("sim", F.col("sim") * by.beta), "rels", F.max, "k"), "kinds")
        tiny = by.node_sim.toDF("query", "node", "sim").where((F.col("sim") > 0) & (F.col("sim") * self.half < by.least))
        self.exact = not tiny.isEmpty()
        placed = seeds.join(self.runs, ["run", "query"])
        self.start = placed.groupBy("block", "node").agg(*(F.sum(F.when(F.col("lane") == i, F.col("reset")).otherwise(0.0)).alias(f"r{i}") for i in range(self.width)))
        #: Edges read and nodes pushed, by round, once ranks() has run.
        self.read: list[tuple[int, int]] = []

    def _cols(self, name: str) -> list[str]:
        return [f"{name}{i}" for i in range(self.width)]

    def _by_lane(self, sims: DataFrame, key: str, agg, name: str) -> DataFrame:  # noqa: ANN001
        """block, key and a column of similarities for each lane."""
        own = sims.join(self.runs.select("query", "block", "lane"), "query")
        return own.groupBy("block", key).agg(*(agg(F.when(F.col("lane") == i, F.col("sim")).otherwise(0.0)).alias(c) for i, c in enumerate(self._cols(name))))

    def _with(self, df: DataFrame, table: DataFrame, key: str, as_key: str, name: str, as_name: str) -> DataFrame:
        """df and the lanes of a table as as_name0 ...; 0 where it has none."""
        other = table.select("block", F.col(key).alias(as_key), *(F.col(c).alias(n) for c, n in zip(self._cols(name), self._cols(as_name), strict=True)))
        return df.join(other, ["block", as_key], "left").fillna(0.0, self._cols(as_name))

    def _edges(self, df: DataFrame) -> DataFrame:
        """df (block, node, ...) and each of a node's edges: other and its relations' similarity in each lane."""
        return self._with(df.join(self.steps, "node"), self.kinds, "rels", "rels", "k", "k")

    def _weight(self, i: int, end: Column) -> Column:
        return F.greatest(F.lit(self.by.least), F.col(f"k{i}") + self.half * (F.col(f"s{i}") + end))

    def _learn(self, nodes: DataFrame) -> DataFrame:
        """block, node, own similarities and the sums of the weights around nodes(block, node) that have edges."""
        own = self._with(nodes, self.sims, "node", "node", "s", "s")
        around = self._with(self._edges(own), self.sims, "node", "other", "s", "t")
        sums = [F.sum(self._weight(i, F.col(f"t{i}"))).alias(f"w{i}") for i in range(self.width)]
        return around.groupBy("block", "node").agg(F.count("*").alias("degree"), *(F.first(s).alias(s) for s in self._cols("s")), *sums)

    def _move(self, state: DataFrame) -> DataFrame:
        """block, node and r of what one push sends to each node."""
        lanes, d, least = range(self.width), F.lit(self.damping), F.lit(self.by.least)
        pushed = state.select("block", "node", *self._cols("s"), *(F.when(F.col(f"r{i}") > self.floor, F.col(f"r{i}") / F.col(f"w{i}")).otherwise(0.0).alias(f"x{i}") for i in lanes))
        edges = self._edges(pushed.where(F.greatest(F.lit(0.0), *self._cols("x")) > 0))
        if self.exact:
            near = self._with(edges, self.sims, "node", "other", "s", "t")
            return near.groupBy("block", F.col("other").alias("node")).agg(*((d * F.sum(F.col(f"x{i}") * self._weight(i, F.col(f"t{i}")))).alias(f"r{i}") for i in lanes))
        sums = []
        for i in lanes:
            x, k, s = F.col(f"x{i}"), F.col(f"k{i}"), F.col(f"s{i}")
            sums += [F.sum(x * (k + self.half * s)).alias(f"a{i}"), F.sum(x).alias(f"p{i}"), F.sum(F.when((s == 0) & (k < least), x * (least - k)).otherwise(0.0)).alias(f"f{i}")]
        arrived = self._with(edges.groupBy("block", F.col("other").alias("node")).agg(*sums), self.sims, "node", "node", "s", "t")
        return arrived.select("block", "node", *((d * (F.col(f"a{i}") + self.half * F.col(f"t{i}") * F.col(f"p{i}") + F.when(F.col(f"t{i}") == 0, F.col(f"f{i}")).otherwise(0.0))).alias(f"r{i}") for i in lanes))

    def ranks(self) -> DataFrame:
        """run, node and pi of the nodes that a run came to."""
        r = self._cols("r")
        state = durable(self.start, "residuals")
        about, closed, settled = None, False, []
        for _ in range(self.rounds):
            if not closed:
                new = state.select("block", "node")
                new = new if about is None else new.join(about.select("block", "node"), ["block", "node"], "left_anti")
                learned = durable(self._learn(new), "learned")
                closed = about is not None and learned.isEmpty()  # whatever is reached is known, and so are all neighbours
                about = learned if about is None else about if closed else about.unionByName(learned)
            known = state.join(about, ["block", "node"])
            pushed = [F.when(F.col(c) > self.floor, F.col(c)).otherwise(0.0).alias(c) for c in r]
            going = known.where(F.greatest(F.lit(self.floor), *r) > self.floor)
            nodes, edges = going.agg(F.count("*"), F.sum("degree")).first()
            if not nodes:
                break
            self.read.append((edges, nodes))
            settled.append(known.select("block", "node", *((F.lit(1.0 - self.damping) * p).alias(c) for c, p in zip(r, pushed, strict=True))))
            after = self._move(going)
            if self.floor > 0:  # what was not pushed waits
                after = after.unionByName(known.select("block", "node", *(F.when(F.col(c) > self.floor, 0.0).otherwise(F.col(c)).alias(c) for c in r))).groupBy("block", "node").agg(*(F.sum(c).alias(c) for c in r))
            if len(self.read) == 1:  # a seed without edges keeps all
                settled.append(state.join(about, ["block", "node"], "left_anti").select("block", "node", *r))
            state = durable(after, "residuals")
        if not self.read:
            settled.append(self.start)
        else:
            settled.append(state.select("block", "node", *r))
        every = settled[0]
        for more in settled[1:]:
            every = every.unionByName(more)
        total = every.groupBy("block", "node").agg(*(F.sum(c).alias(c) for c in r))
        each = total.select("block", "node", F.inline(F.array(*(F.struct(F.lit(i).alias("lane"), F.col(c).alias("pi")) for i, c in enumerate(r)))))
        return durable(each.where("pi > 0").join(self.runs.select("run", "block", "lane"), ["block", "lane"]).select("run", "node", "pi"), "ranks")


def rank(seeds: DataFrame, edges: DataFrame, by: Weighting, damping: float = DAMPING, residual: float = RESIDUAL, floor: float = 0.0) -> DataFrame:
    """run, node and pi of every run of seeds(run, query, node, reset). edges: u, v, rel_id, which may repeat. Without a floor runs reach the whole graph, so they go by blocks (spread.py)."""
    if floor == 0:
        return spread.rank(seeds, spread.links(edges), by, None, damping, max(1, math.ceil(math.log(residual) / math.log(damping))))
    return Push(seeds, adjacency(edges), by, damping, residual, floor).ranks()
