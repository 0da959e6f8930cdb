"""Compounds of chains by full reduction, against walks over every path."""

import random

import pytest

from pathloom.operators import metapath

KINDS = ["a", "b", "c"]
NOTATIONS = [
    "(a → [r] → b → [s] → c) & (a → [t] → c)",
    "(a → [r] → b → [s] → c) & (a → [t] → b → [r] → c) & (a → [s] → a → [t] → c)",
    "(a → [r] → b ← [s] ← c) & (a → [t] → b)",
    "(a) & (a → [r] → b → [s] → a)",
    "(a ← [r] ← b) & (a → [s] → b → [t] → a)",
    "(a) & (a ← [r] ← b)",
    "(a → [none] → b) & (a → [r] → b)",
]


def brute(chain, kind, edges):
    """The (topic, answer) pairs of a chain, by following every edge."""
    walks = [(n,) for n, k in kind.items() if k == chain.type]
    for s in chain.steps:
        walks = [(*w, v) for w in walks for u, v, r in edges if u == w[-1] and r == s.relation and kind[v] == s.type]
    return {(w[0], w[chain.answer]) for w in walks}


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(5)
    kind = {i: r.choice(KINDS) for i in range(24)}
    edges = {(u, v, r.choice("rst")) for u in kind for v in kind if r.random() < 0.12}
    edges |= {(v, u, x) for u, v, x in edges}
    nodes = spark.createDataFrame(list(kind.items()), "node_id long, type string")
    steps = spark.createDataFrame([(u, v, x, kind[v]) for u, v, x in edges], "node long, other long, relation string, other_type string")
    return kind, edges, nodes, steps


@pytest.mark.parametrize("notation", NOTATIONS)
def test_compound_is_the_intersection(graph, notation):
    kind, edges, nodes, steps = graph
    chains = metapath.parse(notation)
    want = set.intersection(*(brute(c, kind, edges) for c in chains))
    got = [tuple(r) for r in metapath.compound(chains, nodes, steps).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nothing_but_what_takes_part_is_left(spark):
    """A hub whose walks end where the other chain never comes: its steps are gone before pairs are formed."""
    kind = {0: "a", 1: "a", 10: "b", 11: "b", 20: "c", 21: "c"} | {i: "b" for i in range(100, 150)} | {i: "c" for i in range(200, 250)}
    one = [(0, 10, "r"), (10, 20, "s"), (1, 11, "r"), (11, 21, "s")] + [(0, i, "r") for i in range(100, 150)] + [(i, i + 100, "s") for i in range(100, 150)]
    edges = one + [(0, 20, "t")]
    nodes = spark.createDataFrame(list(kind.items()), "node_id long, type string")
    steps = spark.createDataFrame([(u, v, x, kind[v]) for u, v, x in edges], "node long, other long, relation string, other_type string")
    chains = metapath.parse("(a → [r] → b → [s] → c) & (a → [t] → c)")
    left = metapath.reduce_chains(chains, nodes, steps)
    assert [[s.count() for s in w] for w in left.walks] == [[1, 1], [1]]
    assert [tuple(r) for r in metapath.compound(chains, nodes, steps).collect()] == [(0, 20)]
