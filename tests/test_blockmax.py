"""Retrieval from blocks by impact against the scores of every doc."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import blockmax, bm25


def corpus(spark, n=300):
    r = random.Random(3)
    common, rare = ["every"], [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(common * r.randint(1, 4) + [w for w in r.choices(rare, [1 / (j + 1) for j in range(60)], k=8) for _ in range(r.randint(1, 3))])) for i in range(n)]
    docs += [(n, "alone alone"), (n + 1, ""), (n + 2, None), (n + 3, docs[0][1])]
    asked = [(0, "every w1 w40"), (1, "every"), (2, "w59 w59 w3"), (3, "alone"), (4, "nothing here"), (5, ""), (6, None), (7, "every w0 w1 w2 w30 w50"), (8, docs[0][1])]
    return spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(asked, "query long, text string")


@pytest.mark.parametrize(("k", "b", "size"), [(1, 0.0, 8), (5, 0.75, 512)])
def test_blocks_find_what_all_scores_find(spark, k, b, size, tmp_path):
    docs, asked = corpus(spark)
    ix, terms = bm25.index(docs, "doc", "text"), bm25.query_terms(asked, "query", "text")
    blockmax.blocks(ix, b, size=size).write(str(tmp_path / "store"))
    store = blockmax.Blocks.read(spark, str(tmp_path / "store"))
    row = lambda r: (r["query"], r["rank"], r["doc"], round(r["bm25"], 6))
    want = bm25.top(bm25.scores(ix, terms, b).withColumn("bm25", F.round("bm25", 6)), k)
    assert sorted(map(row, blockmax.top(store, terms, k, 6, size).collect())) == sorted(map(row, want.collect()))


def test_a_word_of_every_doc_stays_closed(spark):
    docs, asked = corpus(spark)
    store = blockmax.blocks(bm25.index(docs, "doc", "text"))
    _, levels = blockmax.plan(store, bm25.query_terms(asked.where("query = 0"), "query", "text"))
    best = blockmax.top(store, bm25.query_terms(asked.where("query = 0"), "query", "text"), 3)
    thresholds = best.where("rank = 3").select("query", F.col("bm25").alias("threshold"))
    opened = blockmax.later_levels(levels, thresholds, 9)
    assert opened.where("term = 'every'").isEmpty()
    read = opened.join(levels, ["query", "term", "level"]).agg(F.sum("n")).first()[0]
    assert read < levels.agg(F.sum("n")).first()[0] / 4


def test_an_empty_corpus(spark):
    docs, asked = corpus(spark)
    store = blockmax.blocks(bm25.index(docs.where("false"), "doc", "text"))
    assert blockmax.top(store, bm25.query_terms(asked, "query", "text"), 3).isEmpty()


def test_a_found_doc_shows_its_terms_once(spark):
    """However many queries found a doc: no list of a query's terms is searched for each of a doc's."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 9))) for i in range(40)], "doc long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q + 2}") for q in range(12)], "query long, text string")
    ix, terms = bm25.index(docs, "doc", "text"), bm25.query_terms(asked, "query", "text")
    every = bm25.scores(ix, terms).select("query", "doc", F.round("bm25", 9).alias("bm25"))
    some = every.where("(query + doc) % 3 = 0")
    scored = blockmax._scored(some.select("query", "doc"), blockmax.plan(blockmax.blocks(ix), terms)[0], blockmax.blocks(ix), 9)
    assert "array_contains" not in scored._jdf.queryExecution().toString()
    assert {(r.query, r.doc): r.bm25 for r in scored.collect()} == pytest.approx({(r.query, r.doc): r.bm25 for r in some.collect()}, abs=2e-9)
