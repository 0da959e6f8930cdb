"""PageRank by blocks, held against the linear system and against pushing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import push, spread

from .test_graph import weighed


def _ranks(df):
    return {(r.run, r.node): r.pi for r in df.collect()}


def test_blocks_equal_pushing(spark):
    """Many cells, with loops, parallel edges, similarities under the least weight, more runs than share a cell, and seeds without edges."""
    graph, by, weight = weighed(np.random.default_rng(5), spark, tiny=True)
    linked = sorted({x for e in weight[1] for x in e})
    seeds = [("one", 1, linked[2], 1.0), ("both", 1, linked[0], 0.25), ("both", 1, linked[1], 0.75), ("lonely", 2, 999, 1.0), ("half", 2, 999, 0.5), ("half", 2, linked[2], 0.5)]
    seeds, steps = spark.createDataFrame(seeds, "run string, query long, node long, reset double"), push.adjacency(graph)
    runs = push._lanes(seeds, 2)[0]
    assert runs.select("block").distinct().count() > 1
    got = _ranks(spread.rank(seeds, steps, by, runs, 0.15, 4, steps.count() // 9, 3))
    want = _ranks(push.Push(seeds, steps, by, residual=1e-3).ranks())
    assert got.keys() == want.keys() and got["lonely", 999] == 1.0
    assert [got[k] for k in want] == pytest.approx(list(want.values()), rel=1e-9)


def test_what_moves_is_nodes_and_not_edges(spark):
    """Two hundred nodes, all linked: a round of runs without a floor sends rows by stripe, lane and cell, whatever the edges."""
    n = 200
    graph = spark.range(n).crossJoin(spark.range(n).toDF("v")).where("id < v").select(F.col("id").alias("u"), "v", F.lit(0).alias("rel_id"))
    by = weighed(np.random.default_rng(7), spark)[1]
    seeds = spark.createDataFrame([("a", 1, 3, 1.0), ("b", 2, 4, 1.0)], "run string, query long, node long, reset double")
    steps = push.adjacency(graph)
    grid = spread.Grid(push._lanes(seeds, spread.LANES)[0], steps, by, edges=n * n // 4, part=1000)
    assert grid.size == 2 and grid.nodes.count() == 2 and grid.filled.count() == 4
    stripes = grid.nodes.select("stripe").crossJoin(grid.lanes.select("block", "lane", "q"))
    ones = F.unhex(F.expr(f"repeat('000000000000F03F', {n // 2})"))  # 1.0, as many as a stripe has nodes
    x = stripes.join(grid.nodes.select("stripe", (F.length("nodes") / 8).alias("n")), "stripe").where(F.col("n") == n // 2).select("block", "stripe", "lane", "q", ones.alias("data"))
    assert x.count() == 4 and grid.times(x).count() == 2 * 4


def test_what_a_task_holds_is_bounded(spark):
    """A few edges for each of a thousand nodes: stripes are cut by nodes, cells of many edges are slices, runs of a question lie together; repeated edges are one, and ranks are those of pushing."""
    from pathloom.sources import kg

    n = 1000
    raw = spark.range(n).select("id", F.explode(F.array(F.lit(1), F.lit(7), F.lit(7), F.lit(400))).alias("by")).select(F.col("id").alias("src"), ((F.col("id") + F.col("by")) % n).alias("dst"), (F.col("by") % 3).cast("int").alias("rel_id"))
    by = weighed(np.random.default_rng(7), spark, tiny=True)[1]
    edges, linked = kg.undirected(raw), spread.links(kg.undirected(raw))
    assert linked.pairs.count() == kg.canonical(raw).select("u", "v").distinct().count() < edges.count()
    stripes = spread.Stripes(linked, nodes=100)
    assert 10 <= stripes.nodes.count() <= 24 and stripes.most <= 110
    seeds = spark.createDataFrame([(f"{end}{q}", q, q * 7 + i, 1.0) for q in (1, 2) for i, end in enumerate("ta")], "run string, query long, node long, reset double")
    runs = spread.dealt(seeds, spread.VALUES // 2)
    assert [r.n for r in runs.groupBy("block").agg(F.count_distinct("query").alias("n")).collect()] == [1, 1]
    grid = spread.Grid(runs, linked, by, edges=60, part=10, stripes=stripes)
    assert grid.touched.select("slice").distinct().count() > 1
    got = _ranks(spread.rank(seeds, linked, by, runs, 0.15, 3, edges=60, part=10))
    want = _ranks(push.Push(seeds, push.adjacency(kg.canonical(raw)), by, residual=1e-2).ranks())
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()), rel=1e-9)
