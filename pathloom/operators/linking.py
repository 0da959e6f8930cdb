"""Entity linking by name: exact, then by containment, then by BM25."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from ..functions.text import strip, whitespace_tokens
from ..sources.durable import durable
from . import bm25

#: Characters of a gram.
GRAM = 3


def exact(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """mention and node_id of equal names, in any case."""
    return mentions.join(nodes.select("node_id", F.lower(strip("name")).alias("key")), F.lower(strip("mention")) == F.col("key")).select("mention", "node_id")


def _grams(text: Column, size: int) -> Column:
    """The distinct strings of `size` characters in a text."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(inner: DataFrame, outer: DataFrame, size: int = GRAM) -> DataFrame:
    """inner and outer, the keys of inner(inner, s) and outer(outer, t), where s stands in t.

    The outer texts are indexed by their grams. An inner text asks for one of its grams only, the one that the fewest outer texts have
    (a text shorter than a gram asks for itself, so outer texts are indexed by shorter strings too); where one of its grams is in no
    outer text it asks for none. What is found is compared.
    """
    shorter = [_grams(F.col("t"), n) for n in range(1, size)]
    spelled = durable(outer.select("outer", "t", F.explode(F.concat(_grams(F.col("t"), size), *shorter)).alias("gram")), "grams")
    common = spelled.groupBy("gram").agg(F.count("*").alias("df"))
    own = F.when(F.length("s") < size, F.array("s")).otherwise(_grams(F.col("s"), size))
    asked = inner.select("inner", "s", F.explode(own).alias("gram")).join(common, "gram", "left")
    rarest = asked.groupBy("inner", "s").agg(F.min(F.struct("df", "gram")).alias("least"), F.count("*").alias("n"), F.count("df").alias("known")).where("n = known")
    return rarest.select("inner", "s", F.col("least.gram").alias("gram")).join(spelled, "gram").where(F.contains("t", "s")).select("inner", "outer")


def contained(mentions: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """mention, node_id and place of the k names nearest in length among the first 2k (by id) that contain a mention or stand in it."""
    own = durable(mentions.select("mention").distinct().withColumn("m", F.lower(strip("mention"))).where("m <> ''"), "mentions")
    names = durable(nodes.select("node_id", F.lower("name").alias("n")).where("n <> ''"), "names")
    in_names = containing(own.toDF("inner", "s"), names.toDF("outer", "t")).toDF("mention", "node_id")
    in_mentions = containing(names.toDF("inner", "s"), own.toDF("outer", "t")).toDF("node_id", "mention").select("mention", "node_id")
    # first by id, then the texts of those few
    found = in_names.union(in_mentions).distinct()
    first = found.withColumn("_id", best(group("mention"), F.col("node_id"))).where(F.col("_id") <= 2 * k)
    near = F.abs(F.length("n") - F.length("m"))
    return first.join(own, "mention").join(names, "node_id").withColumn("place", best(group("mention"), near, F.col("node_id"))).where(F.col("place") <= k).select("mention", "node_id", "place")


def by_bm25(mentions: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """mention, node_id and rank of the k best names by BM25 (b = 0.75, lower-cased words between white space) that score over 0."""
    ix = bm25.index(nodes, "node_id", "name", whitespace_tokens)
    scored = bm25.scores(ix, bm25.query_terms(mentions.select("mention").distinct(), "mention", "mention", whitespace_tokens), b=0.75).where("bm25 > 0")
    return bm25.top(scored, k).select(F.col("query").alias("mention"), F.col("doc").alias("node_id"), "rank")


def link(mentions: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """mention, node_id, stage and place, k at most, from the first stage that finds anything: 1 exact (by id), 2 containment, 3 BM25. A stage sees the mentions that those before left."""
    own = durable(mentions.select("mention").distinct(), "mentions")
    equal = durable(exact(own, nodes).withColumn("place", best(group("mention"), F.col("node_id"))).where(F.col("place") <= k), "exact")
    left = durable(own.join(equal, "mention", "left_anti"), "mentions")
    within = durable(contained(left, nodes, k), "contained")
    stages = [
        equal.select("mention", "node_id", F.lit(1).alias("stage"), "place"),
        within.select("mention", "node_id", F.lit(2).alias("stage"), "place"),
        by_bm25(left.join(within, "mention", "left_anti"), nodes, k).select("mention", "node_id", F.lit(3).alias("stage"), F.col("rank").alias("place")),
    ]
    return functools.reduce(DataFrame.unionByName, stages)
