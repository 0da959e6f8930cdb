"""What the catalogue's queries share: the driver's tables read as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import group, max_norm
from ..operators import bm25, corridor, metapath, paths, pools, ppr, push, weights
from ..sources import kg
from ..sources.durable import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


class Graph:
    """The commerce graph of a folder: nodes, canonical edges and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.nodes, raw = kg.commerce(spark, sf_dir)
        self.raw, self.edges = raw, kg.canonical(raw)
        self.relations = kg.relations(spark, kg.RELATIONS)
        self.regions = table(spark, sf_dir, "region")

    @property
    def adjacency(self) -> DataFrame:
        return kg.both_ways(self.edges)

    @property
    def steps(self) -> DataFrame:
        return metapath.typed_steps(self.adjacency, self.nodes, self.relations)

    def steps_along(self, *names: str) -> DataFrame:
        """The steps along some relations. What makes the edges of others is not read."""
        own = [i for i, (name, _) in enumerate(kg.RELATIONS) if name in names]
        return metapath.typed_steps(kg.both_ways(kg.canonical(self.raw.where(F.col("rel_id").isin(own)))), self.nodes, self.relations)

    @property
    def named_relations(self) -> DataFrame:
        """node and relation of the relations at each node."""
        every = metapath.typed_steps(kg.both_ways(kg.undirected(self.raw)), self.nodes, self.relations)  # repeated edges go with the rest
        return every.select("node", "relation").distinct()

    @property
    def queries(self) -> DataFrame:
        """One question for each region."""
        return self.regions.select(F.col("r_regionkey").cast("long").alias("query"), F.concat(F.lower("r_name"), F.lit(" customer supplier small ring nation_"), F.col("r_regionkey"), F.lit(" lives shipped order")).alias("text"))

    @property
    def pairs(self) -> DataFrame:
        """pair, topic and answer: each region with the segment of its number."""
        key = F.col("r_regionkey").cast("long")
        return self.regions.select(key.alias("pair"), key.alias("topic"), (F.lit(kg.TYPES.index("segment") * kg.STRIDE).cast("long") + key).alias("answer"))

    def weighting(self) -> weights.Weighting:
        """What the weights of all edges for every question are made of."""
        terms = bm25.query_terms(self.queries, "query", "text")
        node_docs = self.nodes.select(F.col("node_id").alias("doc"), "name")
        node_sim = bm25.sparse_similarities(bm25.index(node_docs, "doc", "name"), terms, node_docs)
        rel_docs = self.relations.select(F.col("rel_id").alias("doc"), F.concat_ws(" ", F.replace("relation", F.lit("_"), F.lit(" ")), "description").alias("text"))
        rel_sim = bm25.sparse_similarities(bm25.index(rel_docs, "doc", "text"), terms, rel_docs)
        return weights.Weighting(durable(node_sim, "node_sim"), durable(rel_sim, "rel_sim"))

    def weighted(self) -> DataFrame:
        """query, u, v, rel_id, weight of every edge for every question, for what shows or searches all of them."""
        by = self.weighting()
        return weights.edge_weights(self.edges, self.queries, by.node_sim, by.rel_sim)

    def ranks(self, by: weights.Weighting) -> tuple[DataFrame, DataFrame]:
        """pairs with topic_run and answer_run, and the ranks of these runs."""
        runs = self.pairs.select("pair", "topic", "answer", F.concat(F.lit("t"), F.col("pair")).alias("topic_run"), F.concat(F.lit("a"), F.col("pair")).alias("answer_run"))
        one = F.lit(1.0).alias("reset")
        seeds = runs.select(F.col("topic_run").alias("run"), F.col("pair").alias("query"), F.col("topic").alias("node"), one).unionByName(runs.select(F.col("answer_run").alias("run"), F.col("pair").alias("query"), F.col("answer").alias("node"), one))
        return runs, push.rank(seeds, kg.undirected(self.raw), by)

    def corridors(self, mode: str = "ppr_mix") -> tuple[DataFrame, DataFrame, DataFrame]:
        """pairs with the width of their corridor; its nodes; its edges (pair, u, v, rel_id, cost)."""
        by = self.weighting()
        runs, ranks = self.ranks(by)
        scores = durable(ppr.product(runs, ranks), "scores")
        nodes = durable(corridor.ladder_nodes(scores, self.pairs), "ladder")
        inner = corridor.induced(kg.undirected(self.raw), nodes, "rel_id").withColumn("query", F.col("pair"))
        every = durable(weights.best_edges(weights.weigh(inner, by), "pair", "width"), "inner")  # edges that repeat are one
        widths = durable(corridor.connected_width(self.pairs, every), "widths")
        held = widths.select("pair", F.col("width").alias("_w"))
        inside = nodes.join(held, "pair").where("width <= _w").select("pair", "node", max_norm(F.col("score"), group("pair")).alias("p"))
        u, v = inside.toDF("pair", "u", "p_u"), inside.toDF("pair", "v", "p_v")
        edges = every.join(u, ["pair", "u"]).join(v, ["pair", "v"])
        cost = weights.cost(mode, F.col("weight"), (F.col("p_u") + F.col("p_v")) / 2)
        return widths, inside, edges.select("pair", "u", "v", "rel_id", cost.alias("cost"))

    def corridor_paths(self, mode: str = "ppr_mix", dedup: str = "none") -> DataFrame:
        """Typed paths through the corridor, those among which by_hop() with this dedup (and cheapest()) choose."""
        widths, _, edges = self.corridors(mode)
        return paths.with_types(paths.candidates(widths.where("width is not null"), edges, self.nodes, dedup=dedup), self.nodes)


def matching(spark: SparkSession, sf_dir: str, lexical: bool = True, typed: bool = False) -> pools.Pools:
    """Benchmark items (test) and documents (train, data_id, hop) in blocks by their vector's label. Documents without a vector of their id take no part.

    typed: an item asks for documents of the hop that is its number modulo 4, plus 1.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("topic_type"), "embedding")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tests = items.join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("test"), "topic_type", F.col("embedding").alias("vector"))
    hop = (F.col("doc_id") % 3 + 1).cast("int")
    trains = docs.join(vectors, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("train"), F.col("doc_id").alias("data_id"), hop.alias("hop"), "topic_type", F.col("embedding").alias("train_vector"))
    if typed:
        tests, trains = tests.withColumn("answer_type", (F.col("test") % 4 + 1).cast("string")), trains.withColumn("train_answer_type", F.col("hop").cast("string"))
    if not lexical:
        return pools.pools(tests, trains)
    ix = bm25.index(docs, "doc_id", "text")
    return pools.pools(tests, trains, ix, bm25.query_terms(items, "item_id", "text"))
