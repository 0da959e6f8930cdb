"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, divergence, html_text, minhash, prefix_trie, sharding, suffixes, topk, toxicity, url_filter, warc
from .common import held_out, table
from .sql import ORACLES


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


#: A conversation of its own that speaks the template's control strings.
CONTROL = r"\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(chat.format_conversations(turns))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the runs of 50 repeated words, as the pipeline removes them, beside the strings of 400 bytes."""
    documents = table(spark, sf_dir, "documents")
    of_bytes, of_words = suffixes.remove(documents), suffixes.remove(documents, suffixes.PASSAGE, suffixes.WORDS, kept=False)
    return suffixes.digests(of_bytes, of_words)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).drop("text_key")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return decontaminate.digest(hits, "doc_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), ["doc_id"]), "doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_topk, op2_shards, op3_chat, op4_repeats, op5_toxicity, op6_near_duplicates, op7_main_text, op8_decontaminate, op9_bpe, op10_warc, op11_prefix_trie, op12_divergence, op13_url_filter, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
