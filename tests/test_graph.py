import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import beam, bm25, corridor, deviations, evaluate, linking, match, metapath, pairs, paths, ppr, push, weights
from pathloom.plans import catalogue, inference, pathbank
from pathloom.sources import jsonl, kg, schemas
from pathloom.streaming import results as streaming

M1 = [(1, 2, 0.5), (2, 3, 0.5), (1, 3, 0.1), (3, 4, 1.0), (2, 4, 0.2), (4, 5, 0.7), (3, 5, 0.3)]
#: Costs of the paths from 1 to 5 by hand.
COSTS = {
    "edge_weight": {"1-2-3-4-5": 6.428571, "1-2-3-5": 7.333333, "1-2-4-5": 8.428571, "1-2-4-3-5": 11.333333, "1-3-4-5": 12.42857, "1-3-5": 13.333332, "1-3-2-4-5": 18.42857},
    "ppr_mix": {"1-3-5": 4.344129, "1-3-4-5": 5.414436, "1-2-3-5": 5.983492, "1-2-3-4-5": 7.053799, "1-2-4-5": 7.968429, "1-2-4-3-5": 9.279657, "1-3-2-4-5": 9.843407},
    "ppr_only": {"1-3-5": 2.690631, "1-3-4-5": 4.968781, "1-2-3-5": 5.881069, "1-2-3-4-5": 8.159219, "1-3-2-4-5": 8.210956, "1-2-4-5": 8.267549, "1-2-4-3-5": 8.932353},
}


@pytest.fixture(scope="module")
def micro(spark):
    edges = spark.createDataFrame([(u, v, 0, w) for u, v, w in M1], "u long, v long, rel_id int, weight double")
    steps = ppr.transitions(kg.both_ways(edges, "weight").select("node", "other", "weight"))
    seeds = spark.createDataFrame([("t", 1, 1.0), ("a", 5, 1.0)], "run string, node long, reset double")
    return edges, ppr.rank(seeds, steps)


def solve(edges, seed, n, d=0.15):
    w = np.zeros((n + 1, n + 1))
    for u, v, x in edges:
        w[u, v] += x
        w[v, u] += x
    p = w[1:, 1:] / w[1:, 1:].sum(1, keepdims=True)
    e = np.zeros(n)
    e[seed - 1] = 1
    return np.linalg.solve(np.eye(n) - d * p.T, (1 - d) * e)


def test_ppr_equals_the_linear_system(spark, micro):
    got = {(r.run, r.node): r.pi for r in micro[1].collect()}
    for run, seed in (("t", 1), ("a", 5)):
        exact = solve(M1, seed, 5)
        assert [got[run, i + 1] for i in range(5)] == pytest.approx(exact.tolist(), abs=1e-9)
        assert sum(got[run, i + 1] for i in range(5)) == pytest.approx(1, abs=1e-12)
    assert [got["t", i] for i in range(1, 6)] == pytest.approx([0.856997, 0.108335, 0.028639, 0.005070, 0.000958], abs=1e-6)
    lonely = ppr.rank(spark.createDataFrame([("x", 9, 1.0)], "run string, node long, reset double"), ppr.transitions(kg.both_ways(micro[0], "weight").select("node", "other", "weight"))).collect()
    assert [tuple(r) for r in lonely] == [("x", 9, 1.0)]


@pytest.mark.parametrize("mode", list(COSTS))
def test_path_costs(spark, micro, mode):
    edges, ranks = micro
    runs = spark.createDataFrame([("p", 1, 5, "t", "a")], "pair string, topic long, answer long, topic_run string, answer_run string")
    score = {r.node: r.score for r in ppr.product(runs, ranks).collect()}
    top = max(score.values()) + 1e-8
    assert [1e4 * score[i] for i in range(1, 6)] == pytest.approx([4.9285, 3.6531, 13.2169, 4.7473, 8.2072], abs=1e-3)
    p = spark.createDataFrame([(i, s / top) for i, s in score.items()], "node long, p double")
    costed = edges.join(p.toDF("u", "a"), "u").join(p.toDF("v", "b"), "v").select(F.lit("p").alias("pair"), "u", "v", "rel_id", weights.cost(mode, F.col("weight"), (F.col("a") + F.col("b")) / 2).alias("cost"))
    found = paths.enumerate_paths(runs.select("pair", "topic", "answer"), costed).collect()
    assert {"-".join(map(str, r.nodes)): round(r.cost, 5) for r in found} == pytest.approx({k: v for k, v in COSTS[mode].items()}, abs=2e-5)
    assert len(found) == 7 and all(len(set(r.nodes)) == r.hop + 1 for r in found)


def brute_paths(edges, s, t, most):
    near = {}
    for u, v, c in edges:
        for a, b in ((u, v), (v, u)):
            if a != b:
                near.setdefault(a, {})[b] = min(c, near.get(a, {}).get(b, 1e9))
    out, stack = {}, [((s,), 0.0)]
    while stack:
        path, cost = stack.pop()
        if path[-1] == t:
            out[path] = cost
        elif len(path) <= most:
            stack += [((*path, x), cost + c) for x, c in near.get(path[-1], {}).items() if x not in path]
    return out


def test_enumeration_equals_depth_first_search(spark):
    rng = np.random.default_rng(3)
    pairs_, rows, want = [], [], {}
    for pair in range(4):
        edges = {tuple(sorted(map(int, rng.integers(0, 9, 2)))): float(rng.integers(1, 50)) for _ in range(16)}
        rows += [(pair, u, v, 0, c) for (u, v), c in edges.items()]
        for t in (8, 0):
            pairs_.append((pair * 10 + t, pair, 3, t))
            want.update({(pair * 10 + t, p): c for p, c in brute_paths([(u, v, c) for (u, v), c in edges.items()], 3, t, 5).items()})
    p = spark.createDataFrame(pairs_, "pair long, g long, topic long, answer long")
    e = spark.createDataFrame(rows, "g long, u long, v long, rel_id int, cost double").join(p.select("pair", "g"), "g").drop("g")
    got = {(r.pair, tuple(r.nodes)): r.cost for r in paths.enumerate_paths(p.drop("g"), e).collect()}
    assert got == pytest.approx(want) and len(want) > 40
    assert paths.enumerate_paths(p.drop("g").withColumn("answer", F.col("topic")), e).count() == 0


def test_dedup_modes(spark):
    rows = [("p", 2, ["a", "x", "b"], [0, 1], c, [1, c, 9]) for c in (1, 2, 3)] + [("p", 2, ["a", "y", "b"], [0, 1], c, [1, c, 9]) for c in (4, 5)]
    df = spark.createDataFrame([(p, h, t, r, float(c), n) for p, h, t, r, c, n in rows], "pair string, hop int, types array<string>, rels array<int>, cost double, nodes array<long>")
    costs = lambda mode, k: [r.cost for r in paths.by_hop(df, k, mode).orderBy("rank").collect()]
    assert costs("none", 3) == [1, 2, 3] and costs("type_sig", 3) == [1, 4] and costs("first_type", 3) == [1, 4, 2]


def test_corridor_ladder(spark):
    """A chain 0-1-...-9 whose far end ranks last: connected only by the widest rung."""
    scores = spark.createDataFrame([("p", i, 1.0 / (i + 1)) for i in range(10)] + [("q", i, 1.0 / (i + 1)) for i in range(10)], "pair string, node long, score double")
    pairs_ = spark.createDataFrame([("p", 0, 9), ("q", 0, 50)], "pair string, topic long, answer long")
    nodes = corridor.ladder_nodes(scores, pairs_, (3, 5, 20))
    assert {(r.node): r.width for r in nodes.where("pair = 'p'").collect()} == {**{i: 3 for i in range(3)}, 3: 5, 4: 5, **{i: 20 for i in range(5, 9)}, 9: 3}
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "u long, v long")
    got = {r.pair: r.width for r in corridor.connected_width(pairs_, corridor.induced(edges, nodes)).collect()}
    assert got == {"p": 20, "q": None}


def test_corridor_longer_than_64_hops(spark):
    pairs_ = spark.createDataFrame([("p", 0, 70)], "pair string, topic long, answer long")
    edges = spark.createDataFrame([("p", i, i + 1, 5) for i in range(70)], "pair string, u long, v long, width int").coalesce(1)
    assert [r.width for r in corridor.connected_width(pairs_, edges).collect()] == [5]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "aspirin treats pain"), (1, "ibuprofen treats pain and fever"), (2, "gene tp53 binds mdm2"), (3, "pain pain fever pathway")], "doc long, text string")
    asked = spark.createDataFrame([("q", "Pain, fever & PAIN?"), ("none", "")], "query string, text string")
    ix = bm25.index(docs, "doc", "text")
    idf = {r.term: r.idf for r in ix.lexicon.collect()}
    assert (idf["treats"], idf["gene"], idf["pain"]) == pytest.approx((0, 0.847298, 0.134797), abs=1e-6)
    terms = bm25.query_terms(asked, "query", "text")
    for b, want in ((0.0, {0: 0.269595, 1: 0.269595, 3: 0.385135}), (0.75, {0: 0.303769, 1: 0.242332, 3: 0.385135})):
        assert {r.doc: r.bm25 for r in bm25.scores(ix, terms, b).collect()} == pytest.approx(want, abs=1e-5)
    sims = {(r.query, r.doc): r.sim for r in bm25.similarities(ix, terms, asked, docs).collect()}
    assert sims["q", 2] == 0 and sims["q", 3] == pytest.approx(1, abs=1e-6) and sims["none", 1] == 0 and len(sims) == 8
    sparse = {(r.query, r.doc): r.sim for r in bm25.sparse_similarities(ix, terms, docs).collect()}
    assert sparse == {pair: sim for pair, sim in sims.items() if sim}


def test_index_reads_texts_once(spark):
    """Postings, lexicon and totals are read from tables, not from texts that are cut again for each; few asked terms move no postings."""
    docs = spark.createDataFrame([(1, "a b b"), (1, "a c d"), (2, ""), (3, None), (4, "a d d d")], "doc long, text string")
    ix = bm25.index(docs, "doc", "text")
    for df in ix:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "LocalRelation" not in plan and "Generate" not in plan
    assert sorted(map(tuple, ix.postings.collect())) == [(1, "a", 2, 3), (1, "b", 2, 3), (1, "c", 1, 3), (1, "d", 1, 3), (4, "a", 1, 4), (4, "d", 3, 4)]
    assert tuple(ix.totals.first()) == (5, 2.0)
    scored = bm25.scores(ix, bm25.query_terms(docs.where("doc = 4"), "doc", "text"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_similarities_of_negative_scores(spark):
    """A term in nearly all docs has a negative idf here, so docs without a hit lie above those with one."""
    docs = spark.createDataFrame([(i, "common" if i < 3 else "other") for i in range(4)], "doc long, text string")
    asked = spark.createDataFrame([("q", "common")], "query string, text string")
    ix, terms = bm25.index(docs, "doc", "text", negative=-1.0), bm25.query_terms(asked, "query", "text")
    by_hand = {r.doc: r.bm25 for r in bm25.scores(ix, terms).collect()}
    low, high = min([*by_hand.values(), 0.0]), max([*by_hand.values(), 0.0])
    want = {i: (by_hand.get(i, 0.0) - low) / (high - low + 1e-8) for i in range(4)}
    got = {r.doc: r.sim for r in bm25.similarities(ix, terms, asked, docs).collect()}
    assert got == pytest.approx(want)
    assert {r.doc: r.sim for r in bm25.sparse_similarities(ix, terms, docs).collect()} == pytest.approx({i: x for i, x in want.items() if x})


def test_linking(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "al", "ta", "mm", "lph"]
    nodes = [(i, " ".join(rng.choice(words, 2))) for i in range(60)] + [(60, None), (61, "")]
    mentions = [(w,) for w in [*words, "ALPHA beta", "  gamma ", "zzz", "delta zzz", "", None, "alpha", "alpha"]]
    n, m = spark.createDataFrame(nodes, "node_id long, name string"), spark.createDataFrame(mentions, "mention string")
    want = set()
    for (mention,) in set(mentions):
        key = (mention or "").strip().lower()
        hits = sorted((i, name.lower()) for i, name in nodes if name and key and (key in name.lower() or name.lower() in key))[:6]
        want |= {(mention, i, r + 1) for r, (i, _) in enumerate(sorted(hits, key=lambda h: (abs(len(h[1]) - len(key)), h[0]))[:3])}
    got = linking.contained(m, n)
    assert set(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    stages = {(r.mention, r.node_id): r.stage for r in linking.link(m, n).collect()}
    assert len({(mention, s) for (mention, _), s in stages.items()}) == len({mention for mention, _ in stages})  # one stage for each mention
    equal = {(mention, i) for (mention,) in mentions for i, name in nodes if mention is not None and name is not None and mention.strip().lower() == name.strip().lower()}
    assert {pair for pair, s in stages.items() if s == 1} == {(x, i) for x, i in equal if sorted(j for y, j in equal if y == x).index(i) < 3}


def test_containment_by_rarest_grams(spark):
    """Both texts of any length from one character on, with characters outside of the first plane, against all pairs."""
    rng = np.random.default_rng(8)
    text = lambda most: "".join(rng.choice(list("abé\U0001f600 "), int(rng.integers(1, most))))
    inner, outer = [(i, text(6)) for i in range(80)], [(i, text(14)) for i in range(80)]
    got = linking.containing(spark.createDataFrame(inner, "inner long, s string"), spark.createDataFrame(outer, "outer long, t string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, o) for i, s in inner for o, t in outer if s in t)


def test_weights_and_edges(spark):
    got = spark.range(1).select(weights.weight(F.lit(0.4), F.lit(0.8), F.lit(0.2)).alias("a"), weights.weight(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("b")).first()
    assert tuple(got) == pytest.approx((0.47, 1e-6))
    raw = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (1, 2, 1), (3, 3, 0)], "src long, dst long, rel_id int")
    edges = kg.canonical(raw)
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 0), (1, 2, 1), (3, 3, 0)]
    assert {r.node: r.degree for r in kg.degrees(edges).collect()} == {1: 2, 2: 2, 3: 2}
    assert kg.both_ways(edges).count() == 5


def test_metapath_notation():
    chain = metapath.parse("(disease → [associated with] → gene/protein → [carrier] → drug ← [side effect] ← effect/phenotype)")[0]
    assert chain.types == ["disease", "gene/protein", "drug", "effect/phenotype"] and chain.relations == ["associated with", "carrier", "side effect"] and chain.answer == 2
    two = metapath.parse("(drug → [indication] → disease → [indication] → drug) & (drug → [synergistic interaction] → drug)")
    assert [len(c.steps) for c in two] == [2, 1] and metapath.parse("(drug)")[0].steps == ()
    for bad in ("drug → [x] → y", "(drug → [x] ← y)", "(drug → x → y)", "()"):
        with pytest.raises(ValueError):
            metapath.parse(bad)
    assert metapath.fill("What does <drug> do to <x>?", {"drug": "aspirin"}) == "What does aspirin do to <x>?"


def test_keep_if_any_and_scores(spark):
    df = spark.createDataFrame([("a", "drug"), ("b", "disease")], "e string, t string").withColumn("g", F.lit(1))
    kept = lambda t: sorted(r.e for r in beam.keep_if_any(df, F.col("t") == t, "g").collect())
    assert kept("drug") == ["a"] and kept("pathway") == ["a", "b"]
    rows = [("q", "r1", i, float(i)) for i in range(7)] + [("q", "r2", 10, -1.0)]
    c = spark.createDataFrame(rows, "question string, relation string, entity long, raw double").withColumn("relation_score", F.lit(0.5))
    merged = {r.entity: r.score for r in beam.grouped_scores(c).collect()}
    assert merged == pytest.approx({6: 0.3, 5: 0.25, 4: 0.2, 3: 0.15, 2: 0.1, 10: 0.0})
    alone = {r.entity: r.score for r in beam.grouped_scores(c.where("relation = 'r1'")).collect()}
    assert alone == pytest.approx({6: 0.15, 5: 0.125, 4: 0.1, 3: 0.075, 2: 0.05})
    cascade = beam.cascade(spark.createDataFrame([("q", "s", 1.0, 0.5), ("q", "t", 3.0, 0.5)], "question string, source string, source_score double, raw double"))
    assert sorted(r.score for r in cascade.collect()) == [0.125, 0.375]


def test_hop_report(spark):
    gold = spark.createDataFrame([("a", 1, ["x"]), ("b", 1, ["x"]), ("c", 3, ["x"]), ("d", 4, ["x"])], "data_id string, num_hops int, names array<string>")
    said = spark.createDataFrame([("a", "{x}"), ("b", "{y}"), ("c", "X"), ("d", "x"), ("z", "x")], "data_id string, results string")
    got = {r.num_hops: (r.correct, r.total) for r in evaluate.by_hop(evaluate.judged(said, gold)).collect()}
    assert got == {1: (1, 2), 2: (0, 0), 3: (1, 1), None: (2, 3)}
    assert evaluate.by_hop(evaluate.judged(said.limit(0), gold)).count() == 4


def test_matching_caps_are_repeatable(spark):
    rows = [("t", h, [f"a{i}"], [f"r{i}"], 1) for h in (1, 2, 3) for i in range(12)]
    df = spark.createDataFrame(rows, "test string, hop int, types array<string>, relations array<string>, n long")
    draw = lambda seed: sorted((r.hop, r.types[0]) for r in match.capped(df, seed=seed).collect())
    assert draw(1) == draw(1) != draw(2) and [sum(h == k for h, _ in draw(1)) for k in (1, 2, 3)] == [2, 4, 8]
    assert match.commonest_hop(df.where("hop > 1")).first()["hop"] == 2


def test_files(spark, tmp_path):
    p = str(tmp_path / "q.jsonl")
    with open(p, "w") as f:
        f.write('{"data_id": 7, "query": "a"}\n\n{broken\n{"data_id": "7", "query": "b", "topic_entities": {"1": "x"}, "extra": 1}\n{"data_id": "8"}\n')
    back = jsonl.questions(spark, p)
    assert [(r.data_id, r.query) for r in back.orderBy("_line").collect()] == [("7", "a"), ("7", "b"), ("8", None)]
    assert {r.data_id: r.query for r in jsonl.last_of_each(back, "data_id").collect()} == {"7": "b", "8": None}
    assert jsonl.questions(spark, p, limit=1).first()["query"] == "a" and jsonl.questions(spark, p, corrupt="keep").where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        jsonl.questions(spark, p, corrupt="fail").collect()
    done = spark.createDataFrame([("7", None), (None, [1, 2])], "data_id string, path_node_ids array<bigint>")
    todo = spark.createDataFrame([("7", [5]), ("9", [1, 2]), ("10", [3]), ("11", None)], "data_id string, path_node_ids array<bigint>")
    assert sorted(r.data_id for r in jsonl.remaining(todo, done).collect()) == ["10", "11"]
    numbered = jsonl.in_order(spark.range(50).select((F.col("id") * 7 % 50).alias("x")), "x").collect()
    assert sorted(r.position - r.x for r in numbered) == [1] * 50


def test_descriptions(spark):
    fields = {"drug": kg.Fields(("a", "b"), ("c",)), "x": kg.Fields(("a",))}
    rows = [("drug", {"a": "first text", "b": "second text"}), ("drug", {"a": "nan", "b": "short", "c": " fallback text "}), ("drug", {"a": "x" * 20, "b": "y" * 20}), ("drug", None), ("other", {"a": "first text"}), ("drug", {"b": "second text", "a": "z" * 40})]
    got = spark.createDataFrame(rows, "type string, details map<string,string>").select(kg.described("type", "details", fields, 30).alias("d"), kg.described_cumulatively("type", "details", fields, 30).alias("c")).collect()
    assert [r.d for r in got] == ["first text second text", "fallback text", "x" * 20, "", "", ""]
    assert [r.c for r in got] == ["first text second text", "nan short  fallback text ", "x" * 20 + " " + "y" * 10, "", "", "z" * 30]


@pytest.fixture(scope="module")
def commerce(spark):
    nodes, raw = kg.commerce(spark, "/root/testdata/sf0.001")
    nodes = nodes.withColumn("text", F.col("name"))
    return nodes, kg.canonical(raw), kg.relations(spark, kg.RELATIONS)


def test_path_bank_and_inference(spark, commerce, tmp_path):
    nodes, edges, relations = commerce
    records = spark.createDataFrame(
        [("a", "customer in africa", {"0": "", "nope": "x"}, [7_000_000_001]), ("b", None, {"1000000003": "N"}, [6_000_000_002]), ("c", "no answer", {"1": ""}, None)],
        "data_id string, query string, topic_entities map<string,string>, answer_ids array<bigint>",
    ).select("*", F.lit(None).cast("string").alias("explicit_query"), F.lit(None).cast("struct<id:bigint,name:string,type:string>").alias("answer_entity"))
    bank = pathbank.build(records, nodes, edges, relations, pathbank.Config(ladder=(20, 50), max_hops=4))
    rows = bank.collect()
    assert {r.data_id for r in rows} == {"a", "b"} and all(len(set(r.nodes)) == r.hop + 1 == len(r.types) == len(r.relations) + 1 for r in rows)
    for _, own in itertools.groupby(sorted((r for r in rows if r.best == "overall"), key=lambda r: (r.pair, r.rank)), key=lambda r: r.pair):
        own = list(own)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and [r.cost for r in own] == sorted(r.cost for r in own) and len(own) <= 5
    out = str(tmp_path / "bank")
    jsonl.write(pathbank.export(bank, records, nodes), out)
    back = jsonl.read(spark, out, schemas.PATH_BANK)
    assert {r.data_id: r.per_topic is None for r in back.collect()} == {"a": False, "b": False, "c": True}
    loaded = jsonl.path_bank(back)
    assert loaded.count() == sum(r.best == "overall" for r in rows)

    steps = metapath.typed_steps(kg.both_ways(edges), nodes, relations)
    patterns = spark.createDataFrame([("a", 2, ["region", "nation", "customer"], ["in_region", "lives_in"]), ("a", 1, ["region", "customer"], ["lives_in"])], "data_id string, hop int, types array<string>, relations array<string>")
    tests = spark.createDataFrame([("1", "customers of asia", 2, "region", [1.0, 0.0]), ("2", "nothing known", 5_000_000_001, "order", [0.0, 1.0])], "question string, text string, topic long, topic_type string, vector array<double>")
    trains = spark.createDataFrame([("x", "a", "customers of africa", "region", [1.0, 0.0])], "train string, data_id string, text string, topic_type string, train_vector array<double>")
    raw = lambda df: df.withColumn("raw", F.lit(0.5))
    got = {r.question: r for r in inference.run(tests, trains, patterns, nodes, steps, _generator, raw, raw).collect()}
    assert (got["1"].chosen_hop, got["1"].paths_used, got["1"].paths_success, got["1"].fallback) == (2, 1, 1, False) and "→[lives_in]→" in got["1"].evidence
    assert got["2"].fallback and got["2"].evidence and got["2"].chosen_hop is None and got["1"].results == "{an answer}"


def _generator():
    return lambda prompts: ["{an answer}" if "Triples" in p else "2" for p in prompts]


def test_streamed_accuracy(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join(json.dumps({"data_id": i, "results": r}) for i, r in (("a", "{x}"), ("b", "{y}"))) + "\n{broken\n")
    gold = spark.createDataFrame([("a", 1, ["x"]), ("b", 1, ["x"])], "data_id string, num_hops int, names array<string>")
    q = streaming.accuracy(streaming.stream(spark, str(folder)), gold).writeStream.format("memory").queryName("accuracy").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    (folder / "2.jsonl").write_text(json.dumps({"data_id": "a", "results": "x"}))
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select num_hops, correct, total from accuracy").collect()] == [(1, 2, 3)]


def test_record_pairs(spark):
    records = spark.createDataFrame([("a", [1, 2, 3], 1, {"1": "x", "3": "y"}, [9])], "data_id string, path_node_ids array<bigint>, num_hops int, topic_entities map<string,string>, answer_ids array<bigint>").withColumn("answer_entity", F.lit(None).cast("struct<id:bigint,name:string,type:string>"))
    chains = pairs.chain_pairs(records)
    assert sorted((r.role, r.subpath) for r in chains.collect()) == [("chain", [1, 2]), ("direct", [3, 9])]
    triples = spark.createDataFrame([("a", 1, 2, "late", 1), ("a", 0, 2, "first", 1)], "data_id string, pos int, source long, relation string, target long")
    assert {r.role: r.relations for r in pairs.subpath_relations(chains, triples).collect()} == {"chain": ["first"], "direct": ["?"]}


def weighed(rng, spark, n=40, m=90, tiny=False):
    """A random graph with parallel edges and a loop, sparse similarities of two questions, and its edges by question and weight."""
    edges = {(min(u, v), max(u, v), r) for u, v, r in zip(*(map(int, rng.integers(0, k, m)) for k in (n, n, 3)), strict=True)} | {(3, 3, 1)}
    sims = {(q, u): 0.05 + float(rng.random()) for q in (1, 2) for u in range(n) if rng.random() < 0.3}
    if tiny:
        sims |= {(q, u): 1e-7 * (u + 1) for q in (1, 2) for u in range(0, n, 4)}
    rels = {(1, 0): 0.8, (2, 0): 0.1, (2, 2): 1e-7}
    by = weights.Weighting(spark.createDataFrame([(q, u, s) for (q, u), s in sims.items()], "query long, node long, sim double"), spark.createDataFrame([(q, r, s) for (q, r), s in rels.items()], "query long, rel_id int, sim double"))
    weight = {q: {} for q in (1, 2)}
    for q in (1, 2):
        for u, v, r in edges:
            w = max(1e-6, 0.3 * rels.get((q, r), 0) + 0.7 * (sims.get((q, u), 0) + sims.get((q, v), 0)) / 2)
            weight[q][u, v] = max(w, weight[q].get((u, v), 0))
    return spark.createDataFrame(sorted(edges), "u long, v long, rel_id int"), by, weight


@pytest.mark.parametrize("tiny", [False, True])
def test_push_equals_the_linear_system(spark, tiny):
    rng = np.random.default_rng(5)
    edges, by, weight = weighed(rng, spark, tiny=tiny)
    linked = sorted({x for e in weight[1] for x in e})
    seeds = [(f"{q}-{s}", q, s, 1.0) for q in (1, 2) for s in linked[:6]] + [("both", 1, linked[0], 0.25), ("both", 1, linked[1], 0.75), ("lonely", 2, 999, 1.0)]
    run = push.Push(spark.createDataFrame(seeds, "run string, query long, node long, reset double"), push.adjacency(edges), by)
    got = {(r.run, r.node): r.pi for r in run.ranks().collect()}
    assert run.exact == tiny and got["lonely", 999] == 1.0
    at = {x: i for i, x in enumerate(linked)}
    for q in (1, 2):
        w = np.zeros((len(at), len(at)))
        for (u, v), x in weight[q].items():
            w[at[u], at[v]] = w[at[v], at[u]] = x
        p = w / w.sum(1, keepdims=True)
        for name in {s[0] for s in seeds if s[1] == q} - {"lonely"}:
            reset = np.zeros(len(at))
            for r, _, node, x in seeds:
                if r == name:
                    reset[at[node]] += x
            exact = np.linalg.solve(np.eye(len(at)) - 0.15 * p.T, 0.85 * reset)
            assert [got.get((name, x), 0.0) for x in linked] == pytest.approx(exact.tolist(), abs=1e-9)
            assert sum(v for (r, _), v in got.items() if r == name) == pytest.approx(1, abs=1e-12)


def test_push_reads_only_edges_near_its_seeds(spark):
    """A chain of 600: few of its edges are read, and a floor keeps a run near its seed without losing mass."""
    edges = spark.createDataFrame([(i, i + 1, 0) for i in range(600)], "u long, v long, rel_id int")
    by = weights.Weighting(spark.createDataFrame([(1, 5, 1.0)], "query long, node long, sim double"), spark.createDataFrame([(1, 0, 1.0)], "query long, rel_id int, sim double"))
    seeds = spark.createDataFrame([("x", 1, 300, 1.0)], "run string, query long, node long, reset double")
    steps = push.adjacency(edges)
    full, near = push.Push(seeds, steps, by, residual=1e-4), push.Push(seeds, steps, by, residual=1e-4, floor=1e-2)
    exact, rough = ({r.node: r.pi for r in p.ranks().collect()} for p in (full, near))
    assert sum(e for e, _ in full.read) < 100 and len(exact) == 11
    assert sum(e for e, _ in near.read) < sum(e for e, _ in full.read) and sum(rough.values()) == pytest.approx(1, abs=1e-12)
    assert all(abs(exact[n] - rough.get(n, 0)) < 5e-2 for n in exact)
    plan = full._move(full.start.select("*", *(F.lit(1.0).alias(f"{c}0") for c in "sw")))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_weight_histogram_equals_weights(spark):
    edges, by, _ = weighed(np.random.default_rng(7), spark)
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query long")
    every = weights.edge_weights(edges, queries, by.node_sim, by.rel_sim)
    want = {(r.query, r.rel_id, r.w): r.n for r in every.groupBy("query", "rel_id", F.round("weight", 6).alias("w")).agg(F.count("*").alias("n")).collect()}
    got = {(r.query, r.rel_id, r.weight): r.edges for r in weights.histogram(edges, queries, by).collect()}
    assert got == want and sum(want.values()) == 3 * edges.count()
    some = edges.withColumn("query", F.lit(1).cast("long")).where("u % 2 = 0")
    assert sorted(map(tuple, weights.weigh(some, by).select("query", "u", "v", "rel_id", "weight").collect())) == sorted(map(tuple, every.where("query = 1 and u % 2 = 0").collect()))


def test_edges_are_counted_before_they_meet_questions(spark):
    """A thousand nodes alike are one class, so edges are a few kinds; best edges by kind equal best edges one by one, with parallel edges."""
    edges = spark.createDataFrame([(0, i, i % 2) for i in range(1, 1001)] + [(0, i, 2) for i in range(1, 500)], "u long, v long, rel_id int")
    by = weights.Weighting(spark.createDataFrame([(q, i, 0.25 * q) for q in (1, 2) for i in range(1, 1001)], "query long, node long, sim double"), spark.createDataFrame([(1, 2, 0.5), (2, 0, 0.75)], "query long, rel_id int, sim double"))
    own, sims = weights.classes(by.node_sim)
    assert own.select("class").distinct().count() == 1 and sims.count() == 2
    assert sorted(map(tuple, weights.kinds(edges, own, "rel_id").collect())) == [(0, None, 1, 500), (1, None, 1, 500), (2, None, 1, 499)]
    edges, by, _ = weighed(np.random.default_rng(8), spark)
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query long")
    degree = kg.degrees(edges)
    best = weights.best_edges(weights.edge_weights(edges, queries, by.node_sim, by.rel_sim), "query").join(degree.toDF("u", "a"), "u").join(degree.toDF("v", "b"), "v")
    want = {tuple(r)[:4]: r.n for r in best.groupBy("query", F.round("weight", 9).alias("w"), "a", "b").agg(F.count("*").alias("n")).collect()}
    found = weights.best_histogram(edges, queries, by, degree)
    assert {tuple(r)[:4]: r.n for r in found.groupBy("query", F.round("weight", 9).alias("w"), "u_degree", "v_degree").agg(F.sum("n").alias("n")).collect()} == want


def test_raw_paths_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows, pairs_, want = [], [], []
    for pair in range(6):
        edges = {}
        for u, v in itertools.combinations(range(7), 2):
            if rng.random() < 0.6:
                edges[u, v] = float(rng.integers(0, 5)) / 4
        rows += [(pair, u, v, u + v, c) for (u, v), c in edges.items()]
        pairs_.append((pair, 0, 6))
        found = sorted((c, p) for p, c in brute_paths([(u, v, c) for (u, v), c in edges.items()], 0, 6, 7).items())
        want += [(pair, k + 1, len(p) - 1, list(p), [a + b for a, b in zip(p, p[1:], strict=False)], c) for k, (c, p) in enumerate(found[:12])]
    e = spark.createDataFrame(rows, "pair long, u long, v long, rel_id int, cost double")
    p = spark.createDataFrame([*pairs_, (90, 1, 1), (91, 1, 2)], "pair long, topic long, answer long")
    got = deviations.raw_paths(p, e, 12).select("pair", "raw", "hop", "nodes", "rels", "cost").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 30


def test_raw_order_loses_short_dear_paths(spark):
    """Twenty long cheap paths and a short dear one: the raw order has only long ones, the order by hops finds the short one."""
    near = [(0, 1, 100.0)]
    for k in range(20):
        chain = [0, *range(100 * k + 10, 100 * k + 16), 1]
        near += [(min(a, b), max(a, b), 1.0 + k / 100) for a, b in zip(chain, chain[1:], strict=False)]
    e = spark.createDataFrame([("p", u, v, 0, c) for u, v, c in near], "pair string, u long, v long, rel_id int, cost double")
    p = spark.createDataFrame([("p", 0, 1)], "pair string, topic long, answer long")
    assert deviations.raw_paths(p, e, 15).where("hop <= 5").count() == 0
    assert [r.raw for r in deviations.raw_paths(p, e).where("hop <= 5").collect()] == [21]
    nodes = spark.createDataFrame([(int(n), "t") for n in {x for u, v, _ in near for x in (u, v)}], "node_id long, type string")
    assert [r.nodes for r in paths.cheapest(paths.candidates(p, e, nodes), 5).collect()] == [[0, 1]]


def test_bottleneck_forest(spark):
    """Rungs against a search for each threshold; a long chain takes few rounds; the forest spans and keeps bottlenecks."""
    rng = np.random.default_rng(2)
    rows = [(pair, int(u), int(v), int(w)) for pair in range(5) for u, v, w in zip(rng.integers(0, 30, 40), rng.integers(0, 30, 40), rng.choice([3, 5, 9], 40), strict=True)]
    pairs_ = [(pair, 0, t) for pair, t in zip(range(5), (7, 8, 0, 12, 99), strict=True)]

    def reached(pair, most):
        seen, todo = {0}, [0]
        while todo:
            x = todo.pop()
            new = {b for p, u, v, w in rows for a, b in ((u, v), (v, u)) if p == pair and w <= most and a == x} - seen
            seen |= new
            todo += new
        return seen

    want = {p: 0 if t == 0 else min((w for w in (3, 5, 9) if t in reached(p, w)), default=None) for p, _, t in pairs_}
    got = corridor.bottleneck_forest(spark.createDataFrame(pairs_, "pair long, topic long, answer long"), spark.createDataFrame(rows, "pair long, u long, v long, width int"))
    assert {r.pair: r.width for r in got.widths.collect()} == want
    forest = got.edges.where("pair = 4").collect()  # never connected, so built to its end
    nodes = {x for p, u, v, _ in rows if p == 4 and u != v for x in (u, v)}
    assert len(forest) == len(nodes) - len({frozenset(y for y in nodes if y in part) for part in _parts([(r.u, r.v) for r in forest], nodes)})

    order = list(map(int, rng.permutation(10_000)))
    chain = spark.createDataFrame([("c", a, b, 3) for a, b in zip(order, order[1:], strict=False)], "pair string, u long, v long, width int")
    long_ = corridor.bottleneck_forest(spark.createDataFrame([("c", order[0], order[-1])], "pair string, topic long, answer long"), chain)
    assert [r.width for r in long_.widths.collect()] == [3] and long_.edges.count() == 9_999 and long_.rounds <= 40


def _parts(edges, nodes):
    parts = {n: frozenset([n]) for n in nodes}
    for u, v in edges:
        both = parts[u] | parts[v]
        for n in both:
            parts[n] = both
    return set(parts.values())


def test_store_knows_how_its_neighbours_lie(spark, tmp_path):
    """A frontier meets the neighbours without moving them, in the session that wrote them and in one that didn't."""
    nodes = spark.createDataFrame([(i, f"n{i}", "even" if i % 2 == 0 else "odd", None) for i in range(200)], schemas.NODES)
    edges = spark.createDataFrame([(i, (i * 7 + k) % 200, k % 2) for i in range(200) for k in range(3)] + [(5, 5, 0)], schemas.EDGES)
    relations = kg.relations(spark, [("near", "a"), ("far", "b")])
    store = kg.Store(spark, f"file://{tmp_path}/store").ensure(nodes, edges, relations)
    want = sorted((r.node, r.other, r.relation, r.other_type) for r in metapath.typed_steps(kg.both_ways(store.read("edges")), nodes, relations).collect())
    frontier = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "node long")
    for _ in range(2):
        near = store.neighbours()
        assert sorted(map(tuple, near.select("node", "other", "relation", "other_type").collect())) == want
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.shuffle.partitions", store.BUCKETS)
        try:
            joined = frontier.join(near, "node")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == sum(n % 3 == 0 for n, *_ in want)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sql(f"DROP TABLE {store._table()}")  # as a session that has not written it
    assert store.complete("neighbours")


@pytest.mark.parametrize("name", ["generated_scores", "beam_first_source"])
def test_steps_along_a_relation_read_no_other(spark, name):
    read = {f.split("/")[-1] for f in catalogue.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()}
    assert read.isdisjoint({"customer.parquet", "part.parquet", "lineitem.parquet" if name == "generated_scores" else "nation.parquet"})


def test_types_of_first_neighbours(spark):
    """Groups of few neighbours, of many of one type, and of many of several types, with edges that repeat."""
    types = {n: "abc"[n % 3] for n in range(200)} | {n: "d" for n in range(200, 300)}
    edges = [(1000, n, 0) for n in range(200, 300)] + [(1001, n, 0) for n in (7, 3, 250)] + [(1002, n, 0) for n in range(150, 300)] * 2 + [(1002, 5, 1), (1003, 1003, 0)] + [(1003, n, 0) for n in range(0, 30, 3)] * 9 + [(1004, 999, 0)]
    types |= {n: "hub" for n in range(1000, 1005)}  # 999 is no node
    nodes = spark.createDataFrame(list(types.items()), "node_id long, type string")
    relations = kg.relations(spark, [("near", "a"), ("far", "b")])
    for most in (3, 50):
        around = {}
        for u, v, r in edges:
            for node, other in {(u, v), (v, u)}:
                if other in types:
                    around.setdefault((node, ("near", "far")[r]), set()).add(other)
        want = {k: sorted({types[o] for o in sorted(own)[:most]}) for k, own in around.items()}
        raw = spark.createDataFrame(edges, "src long, dst long, rel_id int")
        got = kg.relation_target_types(kg.both_ways(kg.undirected(raw)), nodes, relations, most)
        rows = [((r.node, r.relation), list(r.types)) for r in got.collect()]
        assert len(rows) == len(want) and dict(rows) == want
