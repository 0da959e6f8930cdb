"""Scorers of the beam that ask no model, against scores by hand."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.functions import scoring
from pathloom.operators import beam, retrieval


def okapi(docs, asked):
    """Scores of a small corpus."""
    words = [d.split(" ") for d in docs]
    df = Counter(w for d in words for w in set(d))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    average = sum(map(len, words)) / len(words)
    return [sum(n * idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / average)) for w, n in Counter(asked.split(" ")).items()) for d in words]


def test_bm25_of_candidates(spark):
    texts = spark.createDataFrame([("a", "red Red fox"), ("b", "red"), ("c", None)], "question string, text string")
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red  red", "blue", "", "Red", "fox fox fox"])] + [(6, None)], "node_id long, text string")
    groups = {("a", "r"): [0, 1, 2, 3, 6], ("a", "s"): [4, 5, 2], ("b", "r"): [0, 2, 99], ("c", "r"): [0, 1]}
    rows = [(q, r, e, p) for (q, r), own in groups.items() for e in own for p in ((1,) if e != 2 else (1, 2))]  # an entity that two parents lead to is one text
    candidates = spark.createDataFrame(rows, "question string, relation string, entity long, parent long")
    own = {0: "red fox", 1: "red  red", 2: "blue", 3: "", 4: "Red", 5: "fox fox fox", 6: "", 99: ""}
    asked = {"a": "red Red fox", "b": "red", "c": ""}
    want = {(q, r, e): s for (q, r), items in groups.items() for e, s in zip(items, okapi([own[e] for e in items], asked[q]), strict=True)}
    got = retrieval.bm25_entities(texts, nodes)(candidates).collect()
    assert len(got) == len(rows) and {(x.question, x.relation, x.entity): x.raw for x in got} == pytest.approx(want, abs=1e-8)
    put = retrieval.bm25_entities(texts, nodes)(candidates.where("question = 'b'").withColumn("asked", F.lit("blue"))).collect()
    assert {x.entity: x.raw for x in put} == pytest.approx(dict(zip([0, 2, 99], okapi(["red fox", "blue", ""], "blue"), strict=True)), abs=1e-8)


def test_scorers_in_free_exploration(spark):
    """Relations and entities by BM25, then by vectors, choose the same way through a small graph."""
    steps = spark.createDataFrame([(1, 10 + i, r, "t") for r, first in (("eats", 0), ("sees", 4), ("hears", 8), ("smells", 12)) for i in range(first, first + 4)], "node long, other long, relation string, other_type string")
    questions = spark.createDataFrame([("q", 1)], "question string, topic long")
    texts = spark.createDataFrame([("q", "what eats: berry 12 or 13")], "question string, text string")
    nodes = spark.createDataFrame([(10 + i, f"berry {10 + i}") for i in range(16)], "node_id long, text string")
    relations = spark.createDataFrame([(r, d) for r, d in (("eats", "feeds on berry"), ("sees", "looks at"), ("hears", None), ("smells", ""))], "relation string, description string")
    found = beam.explore(questions, steps, retrieval.bm25_relations(texts, relations), retrieval.bm25_entities(texts, nodes), width=3, depth=1).collect()
    assert {(r.relation, r.entity) for r in found if r.score > 0.2} == {("eats", 12), ("eats", 13)}

    asked = spark.createDataFrame([("q", [1.0, 0.0])], "question string, vector array<double>")
    of_nodes = spark.createDataFrame([(10 + i, [1.0 if i in (2, 3) else 0.0, 1.0]) for i in range(15)], "node_id long, vector array<double>")
    of_relations = spark.createDataFrame([("eats", [0.9, 0.0]), ("sees", [0.0, 5.0])], "relation string, vector array<double>")
    found = beam.explore(questions, steps, retrieval.dense_relations(asked, of_relations), retrieval.dense_entities(asked, of_nodes), width=3, depth=1).collect()
    assert {(r.relation, r.entity) for r in found} == {("eats", 12), ("eats", 13)}


@pytest.mark.parametrize("how", ["min_max", "max", "sum"])
def test_normalised_equals_the_window(spark, how):
    """Also for null keys and values, groups of zeros and a column that is already called like the result."""
    rows = [("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0), (None, 7.0), ("z", 0.0), ("z", 0.0), ("one", -2.0)]
    df = spark.createDataFrame([(k, v, i, 0.5) for i, (k, v) in enumerate(rows)], "k string, v double, i int, x double")
    window = {"min_max": scoring.min_max, "max": scoring.max_norm, "sum": scoring.sum_norm}[how](F.col("v"), scoring.group("k"))
    got = scoring.normalised(df, "v", how, "k")
    assert sorted(got.columns) == sorted(df.columns)
    assert {r.i: r.x for r in got.collect()} == {r.i: r.x for r in df.withColumn("x", window).collect()}
