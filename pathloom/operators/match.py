"""The path patterns that come with the train questions that a test question was matched with (pools.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from ..sources.durable import durable

CAPS = {1: 2, 2: 4, 3: 8}


def patterns_of(matched: DataFrame, bank: DataFrame, hops: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """test, hop, types, relations and n (how often) of the banked paths of the matched questions. matched: test, data_id, answer_type (null: any).

    The matches are a table, so that Spark knows when they are few and takes them to what the bank is made of.
    """
    matched = durable(matched, "matched")
    paths = bank.where(F.col("hop").isin(*hops)).join(matched.select("data_id"), "data_id", "left_semi")
    joined = matched.join(paths, "data_id").where("answer_type is null or element_at(types, -1) = answer_type")
    return joined.groupBy("test", "hop", "types", "relations").agg(F.count("*").alias("n"))


def capped(patterns: DataFrame, caps: dict[int, int] = CAPS, seed: int = 42) -> DataFrame:
    """At most caps[hop] patterns of each question and hop, drawn by a hash that the seed shuffles: the same draw every time.

    The hash is md5 of "seed|types|relations", so that any engine draws alike.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.array_join("types", ">"), F.array_join("relations", ">"))
    most = F.element_at(F.create_map(*[x for h, c in caps.items() for x in (F.lit(h), F.lit(c))]), F.col("hop"))
    return patterns.withColumn("_n", best(group("test", "hop"), F.md5(text))).where(F.col("_n") <= most).drop("_n")


def commonest_hop(patterns: DataFrame) -> DataFrame:
    """test and hop: the hop with most patterns, the smaller among equals."""
    counted = patterns.groupBy("test", "hop").agg(F.count("*").alias("n"))
    return counted.groupBy("test").agg(F.max_by("hop", F.struct("n", -F.col("hop"))).alias("hop"), F.max("n").alias("n"))
