"""Pool scoring in blocks against a plain computation of every pair."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.operators import bm25, pools

TESTS = "test long, topic_type string, vector array<float>, answer_type string, text string"
TRAINS = "train long, data_id string, hop int, topic_type string, train_vector array<float>, train_answer_type string, text string"


def made(seed):
    r = random.Random(seed)
    vector = lambda: [r.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)]
    words = lambda most: " ".join(r.choice("the the the gene drug path node rare odd".split()) for _ in range(r.randint(0, most)))
    kind = lambda: "hot" if r.random() < 0.8 else r.choice(["cold", "lone"])
    tests = [(i, kind(), vector(), r.choice(["x", "y", "never", None]), words(6)) for i in range(30)]
    trains = [(i, f"d{i % 40}", i % 3 + 1, "hot" if r.random() < 0.9 else "cold", vector(), r.choice(["x", "y", None]), words(12)) for i in range(120)]
    tests += [(100, None, vector(), "x", "gene"), (101, "hot", None, "x", "gene"), (102, "nowhere", vector(), "x", "gene")]
    trains += [(200, "d200", 1, "hot", None, "x", "gene"), (201, "d201", 1, None, vector(), "x", "gene")]
    return tests, trains


def scored(tests, trains):
    """test to rows (rounded hybrid, rounded dense, train, data_id, hop) of its pool."""
    docs = {t[0]: t[6].split() for t in trains}
    df = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    out = {}
    for test, topic, vector, answer, text in tests:
        if topic is None or vector is None:
            continue
        pool = [t for t in trains if t[3] == topic and t[4] is not None]
        pool = [t for t in pool if answer is not None and t[5] == answer] or pool
        if not pool:
            continue
        dense = [sum(a * b for a, b in zip(vector, t[4], strict=True)) for t in pool]
        own = []
        for t in pool:
            tf = Counter(docs[t[0]])
            own.append(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5) for w in text.split() if tf[w]))
        share = lambda xs: [(x - min(xs)) / (max(xs) - min(xs) + 1e-8) for x in xs]
        both = [0.5 * a + 0.5 * b for a, b in zip(share(dense), share(own), strict=True)]
        out[test] = [(round(h, 6) + 0.0, round(d, 6) + 0.0, t[0], t[1], t[2]) for h, d, t in zip(both, dense, pool, strict=True)]
    return out


@pytest.mark.parametrize("sizes", [(4, 7), (1000, 1000)])
def test_blocks_give_what_all_pairs_give(spark, sizes, monkeypatch):
    monkeypatch.setattr(pools, "TERMS", 3)
    tests, trains = made(sizes[0])
    a, b = spark.createDataFrame(tests, TESTS), spark.createDataFrame(trains, TRAINS)
    p = pools.pools(a, b, bm25.index(b, "train", "text"), bm25.query_terms(a, "test", "text"), sizes)
    want = scored(tests, trains)
    top, hops, near = set(), set(), set()
    for test, rows in want.items():
        each = {}
        for h, _, _, data_id, _ in rows:
            each[data_id] = max(h, each.get(data_id, -9.0))
        best = sorted((-h, d) for d, h in each.items())[:5]
        top |= {(test, d, -h + 0.0, i) for i, (h, d) in enumerate(best, 1)}
        for hop in {r[4] for r in rows}:
            h, _, train, _, _ = min((r for r in rows if r[4] == hop), key=lambda r: (-r[0], r[2]))
            hops.add((test, hop, train, h))
        near |= {(test, r[2], r[1], i) for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2]))[:3], 1)}
    assert {tuple(r) for r in pools.top_trains(p, 5, 6).select("test", "data_id", "hybrid", "rank").collect()} == top
    assert {tuple(r) for r in pools.best_per_hop(p, 6).select("test", "hop", "train", "hybrid").collect()} == hops
    assert {tuple(r) for r in pools.nearest(p, 3, 6).select("test", "train", "dense", "rank").collect()} == near


def test_pools_of_nothing(spark):
    tests, trains = made(1)
    a, b = spark.createDataFrame(tests, TESTS), spark.createDataFrame(trains, TRAINS)
    for left, right in ((a.where("false"), b), (a, b.where("false"))):
        p = pools.pools(left, right, bm25.index(right, "train", "text"), bm25.query_terms(left, "test", "text"))
        assert pools.top_trains(p).count() == pools.best_per_hop(p).count() == pools.nearest(p, 3).count() == 0


def test_no_row_for_a_pair(spark):
    """A hot type of 2,000 trains and 300 tests: the meetings are block by block, and a block is no larger than about its size."""
    a = spark.range(300).select(F.col("id").alias("test"), F.lit("hot").alias("topic_type"), F.array(F.col("id").cast("double")).alias("vector"))
    b = spark.range(2000).select(F.col("id").alias("train"), F.lit("hot").alias("topic_type"), F.array(F.col("id").cast("double")).alias("train_vector"))
    p = pools.pools(a, b, sizes=(100, 200))
    met = pools._meetings(p.tests, p.trains)
    assert met.count() == 30 and met.agg(F.max(F.size("trains"))).first()[0] < 300
    assert {r["train"] for r in pools.nearest(p, 1).where("test > 0").collect()} == {1999}
