"""The best BM25 docs of each query without reading all postings of its terms.

A term's postings are filed by impact (what a posting adds for a weight of 1) in levels, each with its largest impact and
its number of docs; a level is rows of about BLOCK docs. A doc's own terms and impacts are a table too. A query first opens
the levels that add most, until they must hold k different docs, and scores these docs from their own terms; the kth
score is a threshold. A doc whose first term, in the order of what the query's terms can add at most, has it in some level can score
that level's part plus the most of all later terms; only levels that reach the threshold are opened, and only the docs
found there are scored. So a word of every doc costs its levels' few rows, unless the threshold is as low as what it adds.

Results are those of bm25.top(bm25.scores(...)): a query with fewer than k docs opens everything, negative weights count as
nothing in bounds and as they are in scores. Scores are compared as rounded, ties go to the smaller doc. Docs without terms, queries
without known terms and empty tables give no rows. k is at least 1.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from ..sources.durable import durable
from . import bm25

#: About how many docs a row of a level has, and levels for an impact of 1.
BLOCK, STEPS = 512, 16


class Blocks(NamedTuple):
    """postings(term, level, chunk, docs), levels(term, level, bound, n), docs(doc, words, impacts) and lexicon(term, df, idf)."""

    postings: DataFrame
    levels: DataFrame
    docs: DataFrame
    lexicon: DataFrame

    def write(self, folder: str) -> None:
        for name, df in self._asdict().items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def read(spark, folder: str) -> Blocks:  # noqa: ANN001
        return Blocks(*(spark.read.parquet(f"{folder}/{name}") for name in Blocks._fields))


def blocks(ix: bm25.Index, b: float = 0.0, k1: float = bm25.K1, size: int = BLOCK) -> Blocks:
    """An index filed by impact. Within a term, postings lie in the order of levels; a level's rows hold docs by hash, so no task sorts or gathers a term's postings."""
    filed = durable(bm25.doc_weights(ix, b, k1).withColumn("level", F.floor(F.col("weight") * STEPS).cast("int")), "filed")
    levels = filed.groupBy("term", "level").agg(F.max("weight").alias("bound"), F.count("*").alias("n"))
    # of a term of every doc the levels are few and its docs many: the chunk is part of the key before the docs move
    dealt = filed.join(levels.select("term", "level", F.ceil(F.col("n") / size).alias("_n")), ["term", "level"]).withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("_n")))
    lists = dealt.groupBy("term", "level", "chunk").agg(F.collect_list("doc").alias("docs"))
    own = filed.groupBy("doc").agg(F.collect_list(F.struct("term", "weight")).alias("own")).select("doc", F.col("own.term").alias("words"), F.col("own.weight").alias("impacts"))
    return Blocks(lists.sortWithinPartitions("term", F.desc("level")), levels, own, ix.lexicon)


def _scored(found: DataFrame, asked: DataFrame, store: Blocks, digits: int) -> DataFrame:
    """query, doc and bm25 of the found (query, doc), from the docs' own terms.

    A doc that any query found shows its terms once, whatever the number of queries; these meet the asked terms, and a pair's sum is taken where
    the doc is before it moves. That is never more than all scores of the found docs.
    """
    docs = store.docs.join(found.select("doc").distinct(), "doc", "left_semi")
    own = docs.select("doc", F.explode(F.arrays_zip("words", "impacts")).alias("x")).select("doc", F.col("x.words").alias("term"), F.col("x.impacts").alias("impact"))
    sums = own.join(asked.select("query", "term", "weight"), "term").groupBy("query", "doc").agg(F.round(F.sum(F.col("weight") * F.col("impact")), digits).alias("bm25"))
    return sums.join(found, ["query", "doc"], "left_semi")


def plan(store: Blocks, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: query, term, weight and n_terms. levels: query, term, level, n, n_terms, `part`, the most that a posting of it adds, and `reach`, the most that a doc scores whose first term this is."""
    asked = terms.join(store.lexicon, "term").select("query", "term", (F.col("qf") * F.col("idf")).alias("weight"))
    asked = durable(asked.withColumn("n_terms", F.count("*").over(group("query"))), "asked")
    most = asked.join(store.levels.groupBy("term").agg(F.max("bound").alias("bound")), "term").select("query", "term", "n_terms", F.greatest("weight", F.lit(0.0)).alias("gain"), "bound")
    later = group("query").orderBy(F.desc(F.col("gain") * F.col("bound")), "term").rowsBetween(1, Window.unboundedFollowing)
    rest = most.withColumn("rest", F.coalesce(F.sum(F.col("gain") * F.col("bound")).over(later), F.lit(0.0))).drop("bound")
    part = F.col("gain") * F.col("bound")
    return asked, durable(rest.join(store.levels, "term").select("query", "term", "level", "n", "n_terms", part.alias("part"), (part + F.col("rest")).alias("reach")), "levels")


def first_levels(levels: DataFrame, k: int) -> DataFrame:
    """query, term, level and `need`, how many docs of it are enough: the levels that add most, until k different docs must be among them (a doc is there once for each term at most)."""
    before = group("query").orderBy(F.desc("part"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    need = F.lit(k) * F.col("n_terms") - F.coalesce(F.sum("n").over(before), F.lit(0))
    return levels.withColumn("need", need).where("need > 0").select("query", "term", "level", "need")


def later_levels(levels: DataFrame, thresholds: DataFrame, digits: int) -> DataFrame:
    """query, term and level of those that can reach the query's threshold; all where it has none."""
    slack = 2 * 10.0**-digits  # scores that round to the same tie
    return levels.join(thresholds, "query", "left").where(F.col("threshold").isNull() | (F.col("reach") >= F.col("threshold") - slack)).select("query", "term", "level")


def top(store: Blocks, terms: DataFrame, k: int, digits: int = 9, size: int = BLOCK) -> DataFrame:
    """query, rank, doc and bm25 (rounded) of the k best docs of each query. terms: bm25.query_terms()."""
    asked, levels = plan(store, terms)
    # a few rows of a large level do, a row more than needed since their sizes vary
    near = first_levels(levels, k).join(store.postings, ["term", "level"]).where(F.col("chunk") <= F.ceil(F.col("need") / size))
    near = durable(near.select("query", F.explode("docs").alias("doc")).distinct(), "near")
    first = durable(_scored(near, asked, store, digits), "first")
    thresholds = first.withColumn("rank", best(group("query"), F.desc("bm25"), F.col("doc"))).where(F.col("rank") == k).select("query", F.col("bm25").alias("threshold"))
    opened = later_levels(levels, thresholds, digits).join(store.postings, ["term", "level"]).select("query", F.explode("docs").alias("doc")).distinct()
    opened = durable(opened.join(first.select("query", "doc"), ["query", "doc"], "left_anti"), "opened")
    more = _scored(opened, asked, store, digits)
    return bm25.top(first.unionByName(more), k)
