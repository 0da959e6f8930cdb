"""Accuracy of answers by hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_matches, final_answer

HOPS = (1, 2, 3)


def valid_names(gold: DataFrame, nodes: DataFrame) -> DataFrame:
    """data_id, num_hops and names: of valid_answer_ids, or answer_ids, or the canonical answer's where neither resolves."""
    ids = F.when(F.size(F.coalesce("valid_answer_ids", F.array().cast("array<bigint>"))) > 0, F.col("valid_answer_ids")).otherwise(F.col("answer_ids"))
    flat = gold.select("data_id", F.explode_outer(ids).alias("node_id")).join(nodes.select("node_id", "name"), "node_id", "left")
    named = flat.groupBy("data_id").agg(F.collect_set("name").alias("names"))
    canonical = F.when(F.col("answer_entity.name").isNotNull(), F.array("answer_entity.name")).otherwise(F.array().cast("array<string>"))
    return gold.join(named, "data_id", "left").select("data_id", "num_hops", F.when(F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0, F.col("names")).otherwise(canonical).alias("names"))


def judged(results: DataFrame, gold: DataFrame) -> DataFrame:
    """data_id, num_hops and correct of the results that have a gold record. gold: data_id, num_hops, names; results: data_id, results."""
    answer = final_answer("results")
    said = F.when(answer != "", answer).otherwise(F.col("results"))
    return results.join(gold, "data_id").select("data_id", "num_hops", F.coalesce(F.exists("names", lambda n: answer_matches(said, n)), F.lit(False)).alias("correct"))


def by_hop(judgements: DataFrame, hops: tuple[int, ...] = HOPS) -> DataFrame:
    """num_hops, correct, total and percent for each hop, 0 where there are none, and for all together (num_hops null)."""
    counts = judgements.where(F.col("num_hops").isin(*hops)).rollup("num_hops").agg(F.sum(F.col("correct").cast("bigint")).alias("c"), F.count("*").alias("t"))
    wanted = judgements.sparkSession.createDataFrame([(h,) for h in (*hops, None)], "num_hops int")
    out = F.broadcast(wanted).join(counts.withColumnRenamed("num_hops", "h"), F.expr("num_hops <=> h"), "left")
    c, t = F.coalesce("c", F.lit(0)), F.coalesce("t", F.lit(0))
    return out.select("num_hops", c.alias("correct"), t.alias("total"), F.when(t > 0, F.lit(100.0) * c / t).otherwise(F.lit(0.0)).alias("percent"))
