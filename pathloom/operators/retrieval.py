"""Scorers of the beam that ask no model: BM25 and products of vectors, of relations and of entities by their texts.

A BM25 scorer takes what a question can choose from as a corpus of its own: the candidates of a question and relation, or
the relations of a question. Words are what stands between single spaces, in their case. A text that is not known is
empty, a vector that is not known scores 0. A column `asked` of the candidates stands for the question's text.
All groups are scored in one plan; a group's statistics are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import dot
from ..functions.text import space_tokens
from . import bm25
from .beam import Scorer


def _asked(candidates: DataFrame, texts: DataFrame, *by: str) -> DataFrame:
    """by and text: what a group's candidates are held against."""
    own = F.first("asked", ignorenulls=True) if "asked" in candidates.columns else F.lit(None).cast("string")
    groups = candidates.groupBy(*by).agg(own.alias("_asked"))
    return groups.join(texts.select("question", "text"), "question", "left").select(*by, F.coalesce("_asked", "text", F.lit("")).alias("text"))


def _ranked(candidates: DataFrame, texts: DataFrame, item: str, docs: DataFrame, *by: str) -> DataFrame:
    """candidates with `raw`, the BM25 score of an item's text among those of its group. docs: item and text."""
    key = F.struct(*by).alias("doc")
    items = candidates.select(*by, item).distinct().join(docs.toDF(item, "_text"), item, "left")
    pieces = items.select(key, F.col(item).alias("pos"), F.coalesce("_text", F.lit("")).alias("piece"))
    found = bm25.own_scores(pieces, _asked(candidates, texts, *by).select(key, "text"), space_tokens)
    return candidates.join(found.select("doc.*", F.col("pos").alias(item), F.col("score").alias("raw")), [*by, item], "left").fillna(0.0, ["raw"])


def bm25_entities(texts: DataFrame, nodes: DataFrame) -> Scorer:
    """texts: question and text. nodes: node_id and text, a node's name or its description too."""
    return lambda candidates: _ranked(candidates, texts, "entity", nodes.select("node_id", "text"), "question", "relation")


def bm25_relations(texts: DataFrame, relations: DataFrame) -> Scorer:
    """relations: relation and description, if there is one."""
    docs = relations.select("relation", F.concat_ws(": ", "relation", F.nullif("description", F.lit(""))).alias("text"))
    return lambda candidates: _ranked(candidates, texts, "relation", docs, "question")


def _product(candidates: DataFrame, item: str, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    both = candidates.join(asked.toDF("question", "_v"), "question", "left").join(vectors.toDF(item, "_w"), item, "left")
    return both.withColumn("raw", F.when(F.col("_v").isNotNull() & F.col("_w").isNotNull(), dot("_v", "_w")).otherwise(0.0)).select(*candidates.columns, "raw")


def dense_entities(asked: DataFrame, vectors: DataFrame) -> Scorer:
    """asked: question and vector. vectors: node_id and vector."""
    return lambda candidates: _product(candidates, "entity", asked.select("question", "vector"), vectors.select("node_id", "vector"))


def dense_relations(asked: DataFrame, vectors: DataFrame) -> Scorer:
    """vectors: relation and vector."""
    return lambda candidates: _product(candidates, "relation", asked.select("question", "vector"), vectors.select("relation", "vector"))
