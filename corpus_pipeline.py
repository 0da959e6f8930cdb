"""A corpus from raw documents to token ids, in five stages; part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next stage's docs. All but the last return the columns of documents, whatever further
columns there are and whatever they are called. A null doc_id is an id like others and a null text is empty; empty texts
are neither toxic nor contaminated, are copies of nothing and have no tokens; texts of any length are read whole. Of equal documents the
one with the smallest doc_id stays, a row that repeats it is its copy; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, decontaminate, minhash, suffixes, toxicity
from pathloom.llm.common import materialise, table, text_key, whole_row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, below=toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to 0.8: the one with the smallest doc_id."""
    found = minhash.near_duplicates(docs, size=5, percent=80).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_of")).distinct()
    with_key = docs.select(whole_row(docs), text_key(F.col("text")).alias("_key"))
    # a row that repeats a kept one is its copy
    return with_key.join(found, F.expr("_row.doc_id <=> _id and _key = _of")).dropDuplicates(["_id", "_of"]).select("_row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 words that stand in more than one place."""
    out = suffixes.rewrite(docs, suffixes.remove(docs, suffixes.PASSAGE, suffixes.WORDS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), docs.columns, clean_only=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the bytes that they decode to."""
    return bpe.digests(bpe.encode_decode(docs, ["doc_id"]), "doc_id")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("decontamination", drop_contaminated), ("bpe", encode)]

#: SQL can express neither the trees nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
