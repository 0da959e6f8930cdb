"""Okapi BM25 in relational form: postings, lexicon and document lengths.

idf = ln(N - df + 0.5) - ln(df + 0.5); a negative idf becomes a share of the mean idf over
all terms. A query token counts as often as it occurs. Unknown terms score nothing.
Scoring joins query terms with postings on the term, so only postings of asked terms move.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from ..functions.text import unicode_tokens
from ..sources.durable import durable

K1, NEGATIVE = 1.5, 0.25


class Index(NamedTuple):
    """postings(doc, term, tf, len), lexicon(term, df, idf) and totals(n, avg_len), of one row."""

    postings: DataFrame
    lexicon: DataFrame
    totals: DataFrame

    def write(self, folder: str) -> None:
        for name, df in self._asdict().items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def read(spark, folder: str) -> Index:  # noqa: ANN001
        return Index(*(spark.read.parquet(f"{folder}/{name}") for name in Index._fields))


def index(docs: DataFrame, doc: str, text: str, tokens: Callable[[Column | str], Column] = unicode_tokens, negative: float = NEGATIVE) -> Index:
    # texts are cut once, and postings are a table for whatever reads them: lexicon, mean and hits
    words = durable(docs.select(F.col(doc).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("words")), "words")
    totals = durable(words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg_len")), "totals")
    # a doc's words move together, so that they are counted where they are and no posting moves
    postings = words.repartition("doc").select("doc", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("doc", "term", "len").agg(F.count("*").alias("tf")).select("doc", "term", "tf", "len")
    postings = durable(postings, "postings")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    # one row with a fixed number of columns goes to every task
    raw = durable(terms.crossJoin(F.broadcast(totals.select("n"))), "terms").select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    lexicon = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(negative) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, lexicon, totals)


def query_terms(queries: DataFrame, query: str, text: str, tokens: Callable[[Column | str], Column] = unicode_tokens) -> DataFrame:
    """query, term and qf (occurrences) of every query."""
    words = queries.select(F.col(query).alias("query"), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return words.groupBy("query", "term").agg(F.count("*").alias("qf"))


def scores(ix: Index, terms: DataFrame, b: float = 0.0, k1: float = K1) -> DataFrame:
    """query, doc and bm25 of every pair that shares a term. The asked terms are a table: Spark knows when they are few, and then no posting moves for them."""
    asked = durable(query_weights(ix, terms), "asked")
    hits = ix.postings.join(asked, "term").crossJoin(F.broadcast(ix.totals.select("avg_len")))
    length = F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.col("avg_len")
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    return hits.groupBy("query", "doc").agg(F.sum(part).alias("bm25"))


def query_weights(ix: Index, terms: DataFrame) -> DataFrame:
    """query, term and weight: a query's side of each summand of its scores."""
    return terms.join(ix.lexicon, "term").select("query", "term", (F.col("qf") * F.col("idf")).alias("weight"))


def doc_weights(ix: Index, b: float = 0.0, k1: float = K1) -> DataFrame:
    """doc, term and weight: a doc's side. A score is the product of both sides' vectors."""
    length = F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.col("avg_len")
    return ix.postings.crossJoin(F.broadcast(ix.totals.select("avg_len"))).select("doc", "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)).alias("weight"))


def top(scored: DataFrame, k: int, score: str = "bm25") -> DataFrame:
    """The k best docs of each query, ties to the smaller doc."""
    return scored.withColumn("rank", best(group("query"), F.desc(score), F.col("doc"))).where(F.col("rank") <= k)


def sparse_similarities(ix: Index, terms: DataFrame, docs: DataFrame, b: float = 0.0, epsilon: float = 1e-8) -> DataFrame:
    """query, doc and sim, where it isn't 0, of BM25 min-max normalised over all docs, those without a hit too.

    Docs without a hit have a similarity only for the queries whose lowest score is below theirs (of a negative idf);
    docs meet these queries alone, so that what is made grows with the hits.
    """
    scored = durable(scores(ix, terms, b), "scores")
    n = docs.agg(F.count("*").alias("n"))  # one row
    ends = scored.groupBy("query").agg(F.min("bm25").alias("low"), F.max("bm25").alias("high"), F.count("*").alias("hits")).crossJoin(F.broadcast(n))
    zero, others = F.lit(0.0), F.col("hits") < F.col("n")
    ends = ends.select("query", F.when(others, F.least("low", zero)).otherwise(F.col("low")).alias("low"), F.when(others, F.greatest("high", zero)).otherwise(F.col("high")).alias("high"), others.alias("others"))
    found = scored.join(ends, "query")
    if not scored.where("bm25 < 0").isEmpty():
        missed = docs.select("doc").crossJoin(ends.where("others and low < 0")).join(scored.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("bm25", zero)
        found = found.unionByName(missed)
    return found.select("query", "doc", ((F.col("bm25") - F.col("low")) / (F.col("high") - F.col("low") + epsilon)).alias("sim")).where("sim <> 0")


def similarities(ix: Index, terms: DataFrame, queries: DataFrame, docs: DataFrame, b: float = 0.0, epsilon: float = 1e-8) -> DataFrame:
    """As sparse_similarities(), with the zeros: every doc for every one of the stated queries. A query without terms has 0 everywhere."""
    every = docs.select("doc").crossJoin(queries.select("query")).join(sparse_similarities(ix, terms, docs, b, epsilon), ["query", "doc"], "left")
    return every.select("query", "doc", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def own_scores(pieces: DataFrame, queries: DataFrame, tokens: Callable[[Column | str], Column], b: float = 0.75, k1: float = K1, negative: float = NEGATIVE) -> DataFrame:
    """doc, pos and score of the pieces of each doc that share a word with the doc's query; each doc's pieces are a corpus of their own. pieces: doc, pos, piece. queries: doc, text."""
    # a doc's pieces move once, together; whatever follows is counted where they are, and a doc's query comes to them as one row
    dealt = pieces.repartition("doc").select("doc", "pos", tokens("piece").alias("words"))
    own = group("doc")
    words = dealt.select("doc", "pos", "words", F.count(F.lit(1)).over(own).alias("n"), F.avg(F.size("words")).over(own).alias("avg_len"))
    postings = words.select("doc", "pos", "n", "avg_len", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("doc", "pos", "n", "avg_len", "len", "term").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("doc", "term", "n", "avg_len").agg(F.count("*").alias("df"), F.collect_list(F.struct("pos", "len", "tf")).alias("at"))
    raw = terms.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = raw.withColumn("idf", F.when(F.col("raw") < 0, F.lit(negative) * F.avg("raw").over(own)).otherwise(F.col("raw")))
    counted = queries.select("doc", F.explode(tokens("text")).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("qf"))
    asked = counted.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "qf"))).alias("asked"))
    hits = idf.join(asked, "doc").withColumn("qf", F.try_element_at("asked", F.col("term"))).where("qf is not null").select("doc", "avg_len", "idf", "qf", F.inline("at"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.col("avg_len")))
    return hits.groupBy("doc", "pos").agg(F.round(F.sum(part), 9).alias("score"))


def best_piece(pieces: DataFrame, queries: DataFrame, tokens: Callable[[Column | str], Column], b: float = 0.75, k1: float = K1, negative: float = NEGATIVE) -> DataFrame:
    """doc, pos, piece and score of the piece of each doc that scores best against the doc's query, as own_scores() does. The first among equals wins, so a query without hits gets the first piece."""
    found = own_scores(pieces, queries, tokens, b, k1, negative).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("pos", "score"))).alias("found"))
    every = pieces.repartition("doc").join(found, "doc", "left").select("doc", "pos", "piece", F.coalesce(F.try_element_at("found", F.col("pos")), F.lit(0.0)).alias("score"))
    return every.groupBy("doc").agg(F.max_by(F.struct("pos", "piece", "score"), F.struct("score", -F.col("pos"))).alias("b")).select("doc", "b.*")
