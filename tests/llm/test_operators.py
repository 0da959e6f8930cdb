"""The ten operators against brute force, on small tables with the odd cases that the docstrings define."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import bpe, chat, decontaminate, html_text, minhash, sharding, suffixes, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{int(x)}" for x in rng.integers(0, vocabulary, n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white texts, a repeated row, one id for two texts, a long word, other scripts, clashing column names."""
    rows = [(1, "the quick brown fox"), (1, "the quick brown fox"), (1, "another text of this id"), (2, None), (3, ""), (4, " \n\t"), (None, "no id here"), (5, "x" * 30_000), (6, "naïve 雪 ß İ z\x85"), (7, "the quick brown fox")]
    return docs(spark, rows).withColumns({"t": F.lit(1), "k0": F.lit(2), "key": F.lit("x"), "id": F.lit(3), "n": F.lit(4), "bucket": F.lit(5), "shard": F.lit(6), "text_key": F.lit(7)})


# ---- 1 top-k -------------------------------------------------------------------------------------------------------


def brute_topk(rows, asks, k):
    own = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in own:
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in own if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [16, 10_000])
def test_topk_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 8) for i in range(20)]  # one vector many times: ties
    rows += [(300, None), (301, [float("nan")] * 8), (302, [float("inf")] + [0.0] * 7), (303, [None] + [0.0] * 7), (None, [0.1] * 8), (304, [0.1] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = topk.search(df, F.col("vec_id") % 10 == 0, 5, shard_rows=shard_rows, block_queries=7).collect()
    assert sorted(map(tuple, found)) == brute_topk([r for r in rows if r[0] != 304], lambda q: q % 10 == 0, 5)


def test_topk_of_clusters_searches_few_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (8, 6))
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(0, 0.1, 6)]) for i in range(400)] + [(400 + i, [float(x) for x in centres[0]]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = [(i, [float(np.floor(x * 256)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 10 == 0, 5, shard_rows=32, block_queries=16).collect()))
    want = []
    points = np.array([v for _, v in own], dtype=np.int64)
    for q in range(0, 500, 10):
        scores = points @ points[q]
        want += [(q, r + 1, int(i), int(scores[i])) for r, i in enumerate(sorted((i for i in range(500) if i != q), key=lambda i: (-scores[i], i))[:5])]
    assert got == sorted(want)


def test_cells_split_a_sample_and_bound_their_rows(spark):
    rng = np.random.default_rng(4)
    sample = np.concatenate([rng.integers(-1000, 1000, (600, 4)), np.full((300, 4), 7)])
    splits = topk.Splits(sample, 8)
    cell = splits.of(sample)
    assert splits.cells == 8 and set(cell) == set(range(8))
    assert len(set(cell[600:])) == 1  # equal vectors fall into one cell
    assert topk.Splits(np.full((50, 4), 3), 8).cells == 1
    df = spark.createDataFrame([(i, v.tolist(), False, i, int(c)) for i, (v, c) in enumerate(zip(sample, cell, strict=True))], "vec_id long, vector array<long>, asks boolean, salt long, cell int")
    cells, lows, highs = topk._boxes(df)
    for c, low, high in zip(cells, lows, highs, strict=True):
        assert (sample[cell == c].min(0) == low).all() and (sample[cell == c].max(0) == high).all()
    plan = topk._plan(df.withColumn("asks", F.lit(True)), 100, 50)
    assert sum(p[2] for p in plan) >= 9 and [p[1] for p in plan] == np.cumsum([0, *(p[2] for p in plan[:-1])]).tolist()
    assert all(b[3] >= a[3] + a[4] for a, b in zip(plan, plan[1:], strict=False))  # cells of over 50 queries share no block


def test_topk_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).count() == 0
    two = topk.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") % 2 == 0).collect()
    assert list(map(tuple, two)) == [(0, 1, 1, 256 * 512)]


def test_topk_of_huge_components(spark):
    rows = spark.createDataFrame([(0, [1e38, 1.0]), (1, [1e38, 0.0]), (2, [-1e38, 5.0]), (3, [1e12, 1.0])], "vec_id long, embedding array<float>")
    got = topk.search(rows, F.col("vec_id") == 0, 3).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63) + 1)]


def test_tree_prunes():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1000, (16, 8))
    points = np.concatenate([c + rng.normal(0, 1, (64, 8)) for c in centres])
    tree = topk.KDTree(points, np.arange(len(points)), leaf=32)
    assert (tree.lows <= tree.highs).all() and sum(e - s for (s, e), (a, _) in zip(tree.spans, tree.children, strict=True) if a < 0) == len(points)
    q = centres[3]
    bound = tree.bounds(q[None])[0]
    exact = sorted((-(points @ q)).tolist())[:5]
    assert [-s for s, _ in sorted(tree.search(q, bound, -1, 5, -np.inf), reverse=True)] == pytest.approx(exact, abs=1)


# ---- 2 sharding ----------------------------------------------------------------------------------------------------


def test_sharding_laws(spark, odd):
    many = docs(spark, [(i, f"text {i % 50}") for i in range(4000)])
    got = sharding.shard(many).toPandas()
    assert set(got["law"]) == {"key"} and got["shard"].between(0, 39).all()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert len(moved) and set(moved["grown_shard"]) == {40}
    assert got.groupby("shard").size().between(50, 160).all()
    first = got.iloc[0]
    text = f"text {first['doc_id'] % 50}"
    assert first["size"] == len(text) + 16 and first["text_crc32"] == zlib.crc32(text.encode())
    again = sharding.shard(odd).toPandas()
    assert len(again) == 10 and (again[again["size"] == 16]["text_crc32"] == 0).all()
    assert len(set(again[again["doc_id"] == 1]["shard"])) == 1
    assert sharding.shard(many.limit(0)).count() == 0


def test_weights_confine_movement(spark):
    keys = spark.range(5000).withColumnRenamed("id", "doc_id")
    plain = sharding.Topology()
    heavy = sharding.Topology(weights={0: 4.0})
    both = sharding.shard_of(sharding.shard_of(keys, "doc_id", plain, "a"), "doc_id", heavy, "b").toPandas()
    moved = both[both["a"] != both["b"]]
    assert len(moved) and (moved["b"] < 10).all()  # only into the region, then the rack, of the shard that grew
    assert ((moved["a"] >= 10) | (moved["b"] < 5) | (moved["a"] == moved["b"])).all()
    none = sharding.shard_of(keys, "doc_id", sharding.Topology(weights={7: 0.0}), "c").where("c = 7").count()
    assert none == 0


# ---- 3 chat --------------------------------------------------------------------------------------------------------


def test_escapes_are_reversible():
    rng = random.Random(3)
    parts = ["\\", "<", "turn", "</turn>", "<turn ", ">\n", "l", "\\l", "x", "</turn>\n", "\n"]
    for _ in range(2000):
        turns = [("".join(rng.choices(parts, k=3)), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(3)]
        assert list(chat.read_turns(chat.turn_template(turns))) == turns


def test_spans_and_rewriting():
    state = chat.Incremental(chat.turn_template, 2)
    turns = [("user", "hi"), ("assistant", "</turn> ok"), ("user", ""), ("assistant", "<turn")]
    whole = chat.turn_template(turns)
    for i, t in enumerate(turns):
        s = state.add(t)
        assert whole[s.start : s.end] == s.piece and chat.unescape(whole[s.text_start : s.text_end]) == t[1] and not s.rewrote
        assert s.end == len(chat.turn_template(turns[: i + 1]))
    forgets = chat.Incremental(lambda ts: "".join(f"[{t if i == len(ts) - 1 else ''}]" for i, (_, t) in enumerate(ts)), None)
    assert [forgets.add(t).rewrote for t in turns[:2]] == [False, True]


def test_chat_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "sys>tem\n"]), rng.choice([None, "", "a\\b", "</turn>", "long " * 50])) for _ in range(80)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((-1 if n is None else n, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        r, said = got[c], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(said), hashlib.sha256(said.encode()).hexdigest(), len(chat.turn_template(turns)))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_finds_a_template_that_rewrites_after_ten_turns(spark):
    """Whole prefixes are rendered, so a change of the first turn shows however late it comes."""

    def template(turns):
        return chat.turn_template([("user", "summed up"), *turns[1:]] if len(turns) > 10 else turns)

    rows = [(c, i, ["user", "assistant"][i % 2], f"turn {i}") for c, n in ((1, 10), (2, 14)) for i in range(n)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    assert [(r.conv_id, r.n) for r in got.where("rewrote").collect()] == [(2, 10)]
    told = {r.conv_id: (r.rewrote, r.n_turns) for r in chat.read_back(got).collect()}
    assert told == {1: (False, 10), 2: (True, 10)}


def test_chat_template_that_depends_on_far_turns(spark):
    def template(turns):
        return "".join(f"<{len(turns) - len(turns[i:])}|{turns[0][1]}|{r}>{t}" for i, (r, t) in enumerate(turns)) + ("" if len(turns) < 7 else "!")

    turns = [("system" if i == 0 else "user" if i % 2 else "assistant", f"text {i}") for i in range(9)]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).orderBy("n").collect()
    for i, r in enumerate(got):
        before, now = template(turns[:i]), template(turns[: i + 1])
        shared = chat.common_prefix(before, now)
        assert (r.piece, r.start, r.end, r.rewrote) == (now[shared:], shared, len(now), shared < len(before)), i
        if turns[i][0] == "assistant":
            assert now[r.loss_start : r.loss_end] == turns[i][1]


# ---- 4 repeated strings --------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        spans = []
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        ends = [0, *(e for _, e in spans)]
        kept = b"".join(b[e:a] for e, a in zip(ends, [*(a for a, _ in spans), len(b)], strict=True))
        out.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "q", "width"), [(40, 8, 7), (60, 16, 24)])
def test_repeats_equal_brute_force(spark, length, q, width):
    rng = np.random.default_rng(length)
    passage, page = " ".join(words(rng, 60)), "x" * 25 + " menu line of a page é "
    rows = []
    for i in range(60):
        own = " ".join(words(rng, int(rng.integers(1, 80))))
        kind = i % 6
        rows.append([own, f"{own} {passage} {own[:20]}", passage[int(rng.integers(0, 100)) :] + own, page * int(rng.integers(1, 9)), own * 2, "ab" * int(rng.integers(1, 90))][kind])
    rows += [rows[1], rows[1], "", None, "short", passage, "é" * 200, "z" * 500, "z" * 70]
    got = suffixes.digests(suffixes.remove(docs(spark, list(enumerate(rows))).withColumn("key", F.lit(1)), length, suffixes.Unit(False, q, width))).orderBy("doc_id").collect()
    want = brute_repeats([(t or "").encode() for t in rows], length)
    assert [tuple(r)[1:] for r in got] == want
    assert sum(w[1] > 0 for w in want) > 20


def brute_passages(texts, length):
    """Bytes and number of the runs of words that repeated strings of `length` words cover, and what stays."""
    cut = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for t in texts]
    of = lambda w, i: tuple(x for _, _, x in w[i : i + length])
    count = Counter(of(w, i) for w in cut for i in range(len(w) - length + 1))
    out = []
    for t, w in zip(texts, cut, strict=True):
        spans = []
        for i in range(len(w) - length + 1):
            if count[of(w, i)] > 1:
                if spans and i < spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        joined = []
        for a, b in spans:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        bounds = [(w[a][0], w[b - 1][1]) for a, b in joined]
        ends = [0, *(b for _, b in bounds)]
        out.append((sum(b - a for a, b in bounds), len(bounds), b"".join(t[e:a] for e, a in zip(ends, [*(a for a, _ in bounds), len(t)], strict=True))))
    return out


@pytest.mark.parametrize(("length", "q", "cell"), [(12, 4, 3), (50, 8, 6)])
def test_repeated_passages_of_words_equal_brute_force(spark, length, q, cell):
    rng = np.random.default_rng(length)
    passage = words(rng, 60)
    rows = []
    for i in range(90):
        own = words(rng, int(rng.integers(1, 80)), 9000)
        at = int(rng.integers(0, 9))
        kind = [own, [*own, *passage, *own[:5]], [*passage[at : at + length - 1], *own], ["le"] * int(rng.integers(1, 90)), [*own, *own], [*own, *passage[: length + 3]]][i % 6]
        rows.append(str(rng.choice([" ", "\n", " \t "])).join(kind))
    rows += ["", None, "  ", "\n" + " ".join(passage), "é" * 300, " ".join(passage[:length]) + "\x85x"]
    removal = suffixes.remove(docs(spark, list(enumerate(rows))), length, suffixes.Unit(True, q, cell))
    got = suffixes.digests(removal, removal).orderBy("doc_id").collect()
    want = brute_passages([(t or "").encode() for t in rows], length)
    assert [(r.passage_bytes, r.n_passages, r.kept_sha256) for r in got] == [(a, b, hashlib.sha256(k).hexdigest()) for a, b, k in want]
    assert sum(w[0] > 0 for w in want) > 20 and [r.n_removed for r in got] == [r.passage_bytes for r in got]


def test_names_at_a_few_positions_need_no_pass_over_the_text():
    names = suffixes.Names(suffixes.symbols(bytes(np.random.default_rng(4).integers(97, 100, 900, dtype=np.uint8)), suffixes.BYTES))
    for length in (1, 2, 3, 32, 33, 377, 400, 423, 512):
        start = np.array([0, 5, 900 - length])
        own = names.one(start, length)
        assert length & (length - 1) == 0 or length not in names.by_length
        assert (own == names.of(length)[start]).all()


def test_passages_without_what_stays(spark):
    rows = docs(spark, [(1, "a b c d e f x"), (2, "y a b c d e f"), (3, "p q r s"), (4, "t u v w t2 u2"), (5, "t u v w t2 u2")])
    full, spans = (suffixes.remove(rows, 4, suffixes.Unit(True, 2, 2), kept=k).texts for k in (True, False))
    assert sorted((r.key, r.spans) for r in spans.collect()) == sorted((r.key, r.spans) for r in full.collect())
    assert spans.where("kept is not null").isEmpty() and full.where("kept is null").isEmpty()


def test_repeats_odd_rows(spark, odd):
    got = suffixes.digests(suffixes.remove(odd, 10, suffixes.Unit(False, 4, 3))).toPandas()
    assert len(got) == 10 and (got[got["doc_id"] == 7]["n_removed"] == 19).all()
    out = suffixes.rewrite(odd, suffixes.remove(odd, 10, suffixes.Unit(False, 4, 3)))
    assert out.columns == odd.columns and out.where("doc_id = 7").first()["text"] == ""
    assert suffixes.remove(odd.limit(0)).rows.count() == 0


# ---- 5 toxicity ----------------------------------------------------------------------------------------------------


def test_isotonic_is_monotone_and_best():
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    at, level = toxicity.isotonic(x, (x + rng.normal(size=300) > 0).astype(float))
    assert (np.diff(level) >= 0).all() and (np.diff(at) > 0).all()
    assert toxicity.isotonic(np.array([1.0, 2, 3]), np.array([0.0, 1, 0]))[1].tolist() == [0, 0.5]


def test_disguises_count():
    i = toxicity.FEATURES.index("obfuscated")
    for t in ("you idi0t", "what an i.d.i.o.t", "stuuupid", "m0ron", "st*pid fool", "$tupid"):
        assert toxicity.features(t)[i] > 0, t
    for t in ("version 1.0 of 2024", "a.b.c", "hello", "", None):
        assert toxicity.features(t)[i] == 0, t


def test_toxicity_on_held_out_rows(spark, odd):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(600):
        own = words(rng, 60)
        toxic = i % 5 == 0
        if toxic:
            own[3:50:12] = ["you", "idiot", "pathetic", "scum"]
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    table = docs(spark, rows)
    marks = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marks)
    got = {r.doc_id: r.toxic_score for r in toxicity.score(table, model, ["doc_id"]).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    few = toxicity.sample(table, marks, most=50)
    assert len(few[1]) == 50
    assert toxicity.score(odd, model, odd.columns).count() == 10
    kept = toxicity.score(table, model, table.columns, below=toxicity.THRESHOLD)
    assert kept.columns == table.columns and kept.count() == 480
    assert toxicity.score(docs(spark, []), toxicity.train(docs(spark, []), marks), ["doc_id"]).count() == 0
    nothing = toxicity.train(table, marks.limit(0))
    assert {r.toxic_score for r in toxicity.score(table, nothing, ["doc_id"]).collect()} == {0.0}


def brute_features(text, learned):
    """The features of a text without disguises, counted one by one."""
    words = re.findall(r"[^\W_]+", text.lower())
    n, groups = len(words), {g: set(w.split()) for g, w in toxicity.LEXICON.items()}
    every = set().union(*groups.values())
    near = sum(1 for i, w in enumerate(words) if w in every and any(words[j] in toxicity.SECOND_PERSON for j in range(max(0, i - 5), min(n, i + 6))))
    hits = sum(w in every for w in words)
    own = [learned[w] for w in words if w in learned]
    begun = [max(x) for w in words if (x := [learned[w[:k] + "*"] for k in (4, 5, 6) if len(w) > k and w[:k] + "*" in learned])]
    signs = sum(c in "!?.,;:#$%&*" for c in text)
    marks = [y for x in (own, begun) for y in (1000 * len(x) / n, np.log1p(len(x)), 1000 * sum(x) / n, np.log1p(sum(x)))]
    pronouns = sum(w in toxicity.SECOND_PERSON for w in words)
    return [
        *(1000 * sum(w in g for w in words) / n for g in groups.values()), 1000 * hits / n, np.log1p(hits), 1000 * near / n, 1000 * pronouns / n, sum(c.isupper() for c in text) / len(text), 0, text.count("!") / n, text.count("?") / n,
        signs / len(text), 0, 0, sum(len(w) > 2 and any(c.isdigit() for c in w) for w in text.split()) / n, 0, np.log1p(n), *marks,
    ]


def brute_score(model, x):
    """The trees walked node by node, then the calibration between its two nearest steps."""
    margin = model.trees.start
    for feature, cut, value in model.trees.trees:
        node = 0
        while feature[node] >= 0:
            edges = model.trees.edges[feature[node]]
            node = 2 * node + 1 + (sum(e < x[feature[node]] for e in edges) > cut[node])
        margin += value[node]
    at, level = list(model.at), list(model.level)
    if margin <= at[0]:
        return level[0]
    if margin >= at[-1]:
        return level[-1]
    i = max(k for k in range(len(at)) if at[k] <= margin)
    return level[i] + (level[i + 1] - level[i]) * (margin - at[i]) / (at[i + 1] - at[i])


def test_toxic_words_outside_the_fixed_list_are_learned(spark):
    rng = np.random.default_rng(16)
    rows, labels = [], []
    for i in range(600):
        own = words(rng, 60)
        if i % 5 == 0:
            # two words as they are, two beginnings with endings of their own
            own[3:50:12] = [str(rng.choice(["schnarpel", "klomp"])), str(rng.choice(["zwurbel", "fniedrig"])), *(f"{rng.choice(['quabb', 'dromp'])}{i}x{j}" for j in range(2))]
        elif i % 7 == 0:
            own[5] = "klomp"  # once, and harmless
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(i % 5 == 0)))
    table = docs(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marks)
    got = {r.doc_id: r.toxic_score for r in toxicity.score(table, model, ["doc_id"]).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    for i, t in rows[:40]:
        assert got[i] == pytest.approx(brute_score(model, brute_features(t, model.learned)), abs=1e-9)
    # what stands in held-out rows only isn't learned, and a fold's rows don't lend words to their own features
    odd_one = docs(spark, [(i, f"{t} secret") if i in held else (i, f"{t} own{i}") for i, t in rows])
    x, y, fold, learned = toxicity.sample(odd_one, marks)
    assert len(x) == len(y) == len(fold) == 600 - len(held) and set(fold) == set(range(toxicity.FOLDS))
    assert "secret" not in learned and not any(w.startswith("own") for w in learned) and {"schnarpel", "quabb*"} <= set(learned)
    for r in rows[:60]:
        assert np.allclose(toxicity.features(r[1], toxicity.Weights(learned)), brute_features(r[1], learned))


# ---- 6 near duplicates ---------------------------------------------------------------------------------------------


def brute_near(rows, size, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d if d is not None else -1), len(s), c if (c := least.get(top(i)) if s else d) is not None else -1, d == c) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_rows(rng, n):
    rows, passage = [], words(rng, 60)
    for i in range(n):
        kind = i % 7
        own = words(rng, int(rng.integers(1, 90)), 5000)
        if kind in (0, 1) and rows:
            own = list(rows[int(rng.integers(0, len(rows)))])
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = f"edit{rng.integers(0, 99)}"
        if kind == 2:
            own = passage + own[:20]
        if kind == 3:
            own = passage[:50] + own[: int(rng.integers(1, 14))]
        rows.append(own)
    return [(i * 3 % n, " ".join(w).upper() if i % 2 else "  ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("bucket", [2000, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    rows = near_rows(np.random.default_rng(7), 250)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "one\x85two"), (None, rows[0][1]), (906, rows[0][1]), (906, rows[0][1])]
    got = minhash.near_duplicates(docs(spark, rows).withColumn("c", F.lit(1)), 4).drop("text_key").collect()
    clean = lambda x: -1 if x is None else x
    assert sorted((clean(r.doc_id), r.n_shingles, clean(r.component_id), r.kept) for r in got) == brute_near(rows, 4)


def test_outliers_of_a_tight_group_larger_than_a_task(spark, monkeypatch):
    """Each outlier is linked with one member only, and the group's members have nearly all bands in common."""
    monkeypatch.setattr(minhash, "BUCKET", 5)
    rng = np.random.default_rng(17)
    base = words(rng, 600, 100_000)
    group = [[*base[: 2 * i + 5], f"own{i}", *base[2 * i + 6 :]] for i in range(60)]
    rows = [(100 + i, " ".join(own)) for i, own in enumerate(group)]
    for k in range(7):
        own = list(group[7 * k + 5])
        own[130 + 65 * k : 193 + 65 * k] = [f"out{k}x{j}" for j in range(63)]
        rows.append((k, " ".join(own)))
    want = brute_near(rows, 4)
    assert {r[2] for r in want} == {0}
    assert sorted(map(tuple, minhash.near_duplicates(docs(spark, rows), 4).drop("text_key").collect())) == want


def test_star_of_near_copies(spark):
    """Copies that are alike enough only to their base are found through it, whichever member stands in the middle."""
    rng = np.random.default_rng(8)
    base = words(rng, 300, 10_000)
    rows = [(10, " ".join(base))]
    for i in range(40):
        own = list(base)
        for at in rng.choice(300, 8, replace=False):
            own[at] = f"e{i}x{at}"
        rows.append((11 + i, " ".join(own)))
    got = minhash.near_duplicates(docs(spark, rows), 4).drop("text_key").collect()
    assert sorted(map(tuple, got)) == brute_near(rows, 4)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(9)
    for n in (1, 3, 40, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        s = minhash.sketch(a)
        assert (s < np.iinfo(np.uint64).max).all()
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rng.integers(0, 2**63, max(1, n // 9)).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.sketch(b) == s).mean() - true) < 0.2 or n < 40
    assert minhash.near_duplicates.__doc__


def test_near_duplicates_of_nothing(spark, odd):
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    assert minhash.near_duplicates(odd.where("doc_id in (2, 3)")).count() == 2


# ---- 7 html --------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>First <b>bold</b>ly&nbsp;put.<p>Second,\n  spaced.</article><footer>&copy; us</footer>", "Title & more First boldly put. Second, spaced."),
    ("<body><header><h1>Site</h1></header><main><aside>See also</aside><p>Only this.</p><form><label>Mail</label><input></form><section id=comments><p>I liked this a lot, really a lot.</p></section></main>", "Only this."),
    ("<div class=cookie-notice>We use cookies</div><div id=content><p>" + "Plenty of running text in here. " * 5 + "</p><p>Short.</p><p>" + "And more running text after it. " * 5 + "</p></div><div class='sidebar'><ul><li><a href=a>link</a></ul></div>", ("Plenty of running text in here. " * 5).strip() + " Short. " + ("And more running text after it. " * 5).strip()),
    ("<article><p>a<br>b<script>var x='</p>';</script><style>p{}</style><!-- c --><p>x &lt;y&gt; &#233;&eacute; &bogus;</article><div class=ad>Buy</div>", "a b x <y> éé &bogus;"),
    ("<main><article><p>One story.</p></article><article class='comment'><p>A reader says so.</p></article></main>", "One story."),
    ("<nav><ul><li><a href=x>x</a><article><p>Menu never closed.</p></article>", "Menu never closed."),
    ("<body class='with-sidebar'><div class='sidebar no-print'>Links of the side.</div><article><p>In the middle.</p></article>", "In the middle."),
    ("<form action=/><div class=menu>Menu</div><article><p>All in one form.</p><form><label>Your name</label></form></article><div id=footer>Foot</div></form>", "All in one form."),
    ("<form><div class=nav>Menu</div><div><p>No landmark, one form for the page.</p></div></form>", "No landmark, one form for the page."),
    ("<p>Seen <span class=ad>Buy this</span> again.</p><form>Mail <input></form>", "Seen again."),
    ("just text", "just text"), ("", ""), (None, ""), ("<p>", ""), ("<article><p>unclosed <b>bold <i>text", "unclosed bold text"), ("</div></p>stray<p>end</body>", "stray end"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def built_page(rng, landmark):
    """A page and the text that stands in its content."""
    text = lambda lo, hi: " ".join(words(rng, int(rng.integers(lo, hi)), 5000)).capitalize() + "."
    dress = lambda t: " ".join(str(rng.choice([w, w, w, f"<b>{w}</b>", f"<a href=/{w}>{w}</a>", f"{w}<!-- {w} -->"])) for w in t.split())
    around = [
        lambda: "<nav><ul>" + "".join(f"<li><a href=/{i}>{text(1, 3)}</a></li>" for i in range(6)) + "</ul></nav>", lambda: f"<div class='ad box'>{text(3, 40)}</div>", lambda: f"<aside><p>{text(3, 30)}</p></aside>", lambda: f"<script>var a = '<p>{text(3, 9)}';</script>",
        lambda: f"<form><label>{text(1, 3)}</label><input><button>{text(1, 2)}</button></form>", lambda: f"<div id=cookie-notice>{text(5, 30)}</div>", lambda: f"<section class=comments><p>{text(5, 60)}</p></section>",
    ]
    some = lambda: "".join(around[int(i)]() for i in rng.integers(0, len(around), int(rng.integers(0, 5))))
    parts = [text(2, 7), *(text(25, 80) if not landmark or rng.random() < 0.6 else text(1, 10) for _ in range(int(rng.integers(2, 7))))]
    blocks = [f"<h1>{dress(parts[0])}</h1>", *(f"<p>{dress(p)}" + str(rng.choice(["", "</p>"])) for p in parts[1:])]
    if landmark:
        blocks.insert(2, some())
    head, tail = {"article": ("<article>", "</article>"), "main": ("<main><div>", "</div></main>"), "": ("<div id=content>", "</div>")}[landmark]
    return f"<html><head><title>{parts[0]}</title></head><body>{some()}{head}{''.join(blocks)}{tail}{some()}<footer>&copy; {text(2, 9)}</footer></body></html>", " ".join(parts)


@pytest.mark.parametrize("landmark", ["article", "main", ""])
def test_main_text_of_built_pages(landmark):
    rng = np.random.default_rng(18)
    for _ in range(150):
        html, text = built_page(rng, landmark)
        assert html_text.main_text(html) == text, html


def brute_clusters(lines):
    """Threshold and smoothing written out over arrays."""
    weight = np.array([(len(x.text) - x.linked) * (0.1 if x.mark else 8 if x.landmark else 1) / max(1, x.tags) for x in lines])
    k = np.exp(-np.arange(-2, 3) ** 2 / 2)
    i = np.arange(len(weight))
    near = [(j, w) for j, w in zip(range(-2, 3), k, strict=True)]
    total = sum(np.where((i + j >= 0) & (i + j < len(i)), weight[np.clip(i + j, 0, len(i) - 1)] * w, 0) for j, w in near)
    smooth = total / sum(np.where((i + j >= 0) & (i + j < len(i)), w, 0) for j, w in near)
    over = smooth >= min(smooth.std() / 2, smooth.max())
    return [n for n, x in enumerate(lines) if over[n] and 2 * x.linked <= len(x.text)]


def test_clusters_equal_brute_force():
    rng = np.random.default_rng(19)
    for landmark in ("article", "main", "") * 20:
        lines, *_ = html_text.lines_of(built_page(rng, landmark)[0])
        got = html_text.clusters(lines, [0] * len(lines))
        assert [i for c in got for i in c] == brute_clusters(lines)


def test_smoothing_decides(monkeypatch):
    long, short = "Running text of the article itself. " * 6, "<p>Short.</p>"
    html = f"<body><p>Teaser that is somewhat longer than the others are.</p>{short * 8}<p>{long}</p>{short}<p>{long}</p>{short * 2}<p>{long}</p>{short * 8}<p>Last words about this site and what it is for.</p></body>"
    smooth = html_text.main_text(html)
    assert smooth.count("itself.") == 18 and "Teaser" not in smooth and "Last" not in smooth and "Short." in smooth
    monkeypatch.setattr(html_text, "smoothed", lambda values: values)
    assert html_text.main_text(html) != smooth


def test_extract_rows(spark):
    rows = [(i if i else None, "u", h, 1) for i, (h, _) in enumerate(PAGES)] * 2
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, t int"), ["page_id", "url"]).collect()
    assert sorted((r.text, r.n_chars) for r in got) == sorted((t, len(t)) for _, t in PAGES * 2)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), ["page_id"]).count() == 0


# ---- 8 decontamination ---------------------------------------------------------------------------------------------


def brute_hits(rows, items, m=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(m, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        found.discard(None)
        out.append((-1 if d is None else d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, block):
    rng = np.random.default_rng(10)
    items = [(i, " ".join(words(rng, int(rng.integers(1, 25)), 30))) for i in range(20)] + [(20, None), (21, "!?"), (3, "again w1 w2 w3"), (None, "w4 w5 w6"), (22, "Snow雪 3D")]
    rows = [(i, ", ".join([*words(rng, 30, 30), *items[i % 20][1].upper().split()[: 14], *words(rng, 5, 30)])) for i in range(80)] + [(90, None), (91, ""), (None, items[0][1]), (92, "snow雪-3d"), (92, "snow雪-3d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.decontaminate(docs(spark, rows).withColumn("hit", F.lit(1)), bench, ["doc_id"], block_bytes=block), "doc_id").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == brute_hits(rows, items)
    clean = decontaminate.decontaminate(docs(spark, rows), bench, ["doc_id", "text"], clean_only=True, block_bytes=block)
    assert clean.count() == sum(not r[-1] for r in brute_hits(rows, items)) and clean.columns == ["doc_id", "text"]
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0), ["doc_id"]).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs(spark, []), bench, ["doc_id"]).count() == 0


# ---- 9 BPE ---------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, odd):
    import tiktoken

    tokens = bpe.read_ranks(bpe.default_vocabulary())
    theirs = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(11)
    letters = [*"abc  \n\t'sre1!é雪\x1c\x85\xa0", "İ", "\U0001f600", "<|endoftext|>"]
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(300)] + [(r.doc_id, r.text) for r in odd.collect()]
    got = bpe.encode_decode(docs(spark, rows), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.input_ids) == theirs.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    d = bpe.digests(bpe.encode_decode(odd, ["doc_id"]), "doc_id").where("doc_id = 5").first()
    ids = theirs.encode_ordinary("x" * 30_000)
    assert (d.n_tokens, d.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode_decode(odd.limit(0), ["doc_id"]).count() == 0


# ---- 10 WARC -------------------------------------------------------------------------------------------------------


def test_framing_and_segments():
    payload = bytes(range(256)) * 300
    assert warc.dechunked(warc.chunked(payload, 1000)) == payload and warc.dechunked(warc.chunked(b"")) == b""
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(payload)
    archive = b"".join(warc.segmented("response", "<urn:a>", {"X": 1}, block, 5000))
    parts = list(warc.records(archive))
    assert [h["warc-type"] for h, _ in parts] == ["response"] + ["continuation"] * (len(parts) - 1) and int(parts[-1][0]["warc-segment-total-length"]) == len(block)
    assert warc.payload_of(b"".join(b for _, b in parts))[1] == payload
    assert list(warc.records(gzip.decompress(gzip.compress(archive)))) == parts
    with pytest.raises(ValueError):
        list(warc.records(archive.replace(b"WARC/1.1", b"WORC/1.1")))


def test_warc_round_trip(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate([None, "", "a", "a", "é" * 70_000, "é" * 70_000, "b" * 65_500, "\r\n\r\n0\r\n\r\n", "a", "c"])] + [(None, None, "c"), (None, None, "only"), (9, "http://x/9", "c"), (12, " sp ace\n", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "t": F.lit(2), "first": F.lit(3)})
    got = sorted(((-1 if r.page_id is None else r.page_id), r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in warc.read(warc.write(df)).collect())
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b, i = (h or "").encode(), -1 if i is None else i
        same = last[h or ""] == i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", -1 if same else last[h or ""]))
    assert got == sorted(want)
    named = spark.createDataFrame([("a b\n%é", "u", "x"), ("z", "u", "x"), (None, "u", "x")], "page_id string, url string, html string")
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.read(warc.write(named), "string").collect()} == {("z", "response", None), ("a b\n%é", "revisit", "z"), (None, "revisit", "z")}
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_names_of_hulls_are_made_at_once(monkeypatch):
    """Hulls of any number of windows take no pass each over the text's cells."""
    rng = np.random.default_rng(4)
    calls = []
    one = suffixes.Names.one
    monkeypatch.setattr(suffixes.Names, "one", lambda self, start, length: calls.append(length) or one(self, start, length))
    for unit, length in ((suffixes.BYTES, suffixes.LENGTH), (suffixes.WORDS, suffixes.PASSAGE)):
        names = suffixes.Names(rng.integers(1, 2**63, 3000, dtype=np.uint64))
        found = suffixes.cells(names, *suffixes.filed(names, length, unit.q), length, unit.cell)
        assert len(set((found["last"] - found["start"]).tolist())) > 2
        assert len(calls) <= 1
        calls.clear()
    start, lengths = np.arange(40), np.arange(1, 41)
    assert names.each(start, lengths).tolist() == [int(one(names, start[i : i + 1], int(n))[0]) for i, n in enumerate(lengths)]
