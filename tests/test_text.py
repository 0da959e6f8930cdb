import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pathloom.functions import scoring, text as T
from pathloom.operators import generate


def one(spark, expression, **columns):
    return spark.range(1).withColumns({k: v if not isinstance(v, (str, int, float)) else F.lit(v) for k, v in columns.items()}).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "final", "reasoned"),
    [("{Yes}. so {a b}", "a b", "Yes"), ("no braces", "", ""), ("{no}", "no", "no"), ("}x{", "", ""), ("{ a } {b}", "a", "a"), ("{No} {\tx\n}", "x", "No"), ("{}", "", ""), ("{yes} {} {z}", "z", "yes"), (None, "", "")],
)
def test_answers(spark, text, final, reasoned):
    assert one(spark, T.final_answer("t"), t=F.lit(text)) == final
    assert one(spark, T.reasoning_answer("t"), t=F.lit(text)) == reasoned


@pytest.mark.parametrize(("a", "b", "same"), [("TP53", "tp 53", True), ("the gene TP53", "TP53", True), ("TP53", "BRCA1", False), ("", "x", False), (" ", "x", False), (None, "x", False)])
def test_matching_is_symmetric(spark, a, b, same):
    assert one(spark, T.answer_matches("a", "b"), a=F.lit(a), b=F.lit(b)) is same
    assert one(spark, T.answer_matches("b", "a"), a=F.lit(a), b=F.lit(b)) is same


@pytest.mark.parametrize(("text", "n", "scores"), [("0.35, 0.35, 0.2, 0.1", 4, [0.35, 0.35, 0.2, 0.1]), ("1, 0", 2, [0.5, 0.5]), ("0.9", 2, [0.5, 0.5]), (None, 2, [0.5, 0.5])])
def test_score_list(spark, text, n, scores):
    assert one(spark, T.score_list("t", F.lit(n)), t=F.lit(text)) == scores


def test_parsers(spark):
    known = F.array(F.lit("side effect"), F.lit("target"))
    got = one(spark, T.relation_scores("t", known), t="1. {side effect (Score: 0.8)}: x 2. {bogus (Score: 0.1)}: y")
    assert [tuple(r) for r in got] == [("side effect", 0.8)]
    assert one(spark, T.relation_scores("t", known), t="{bogus (Score: 0.1)}") is None
    assert one(spark, T.json_list("t"), t='x ["a", "b"] ["c"]') == ["a", "b"] and one(spark, T.json_list("t"), t="x [") == [] and one(spark, T.json_list("t"), t="[nope") == []
    assert tuple(one(spark, T.subquery("t"), t='say {"subquery": " q ", "target_type": ""} ok')) == ("q", None)
    assert tuple(one(spark, T.subquery("t"), t="{bad")) == (None, None)
    assert one(spark, T.without_choices("t"), t="Which?\nA: a\nB: b\nC: c\nD: d") == "Which?" and one(spark, T.without_choices("t"), t="Which?\nA: a") == "Which?\nA: a"
    assert one(spark, T.answer_type("t"), t="a DISEASE or drug") == "drug" and one(spark, T.answer_type("t"), t="none") is None
    assert one(spark, T.first_hop("t", F.array(F.lit(2), F.lit(3))), t="1 or 3 or 2") == 3 and one(spark, T.first_hop("t", F.array(F.lit(2))), t="7") is None
    assert one(spark, T.first_mentioned("t", known), t="the TARGET is") == "target" and one(spark, T.first_mentioned("t", known), t="") == "side effect"
    assert one(spark, T.says_yes("t"), t=" Y es\n") is True and one(spark, T.says_yes("t"), t="no") is False


def test_tokenizers(spark):
    rng = random.Random(1)
    for _ in range(30):
        t = "".join(rng.choices("abc XYZ  _-,.é雪ß\n\t1½'", k=40))
        assert one(spark, T.unicode_tokens("t"), t=t) == re.sub(r"[^\w\s]", " ", t.lower()).split()
        assert one(spark, T.ascii_tokens("t"), t=t) == re.findall("[a-z0-9]+", t.lower())
        assert one(spark, T.space_tokens("t"), t=t) == t.split(" ")
        assert one(spark, T.whitespace_tokens("t"), t=t) == t.lower().split()
        assert one(spark, T.sentences("t"), t=t) == [s.strip() for s in t.replace("\n", ". ").split(". ") if len(s.strip()) > 10]


def test_chunks_cover_the_text(spark):
    def brute(text, most=150, least=50):
        out = []
        for s in re.split(r"(?<=[.;])\s+", text):
            s = s.strip()
            while len(s) > most:
                at = s[:most].rfind(", ")
                at = most if at < least else at
                out.append(s[:at].strip())
                s = s[at:].strip(", ")
            if s:
                out.append(s)
        return out

    rng = random.Random(2)
    pieces = ["word", "longer", ", ", " ", "; ", ". ", "x" * 20, "é", "\n", ",", "   ", "😀"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["", "a", "x" * 450, ("word, " * 60), ("y" * 49 + ", ") * 9, ", " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.chunks("t").alias("c"))
    got = {r.i: r.c for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_norms(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, 0.0), (3, 0.0)], "g int, x double")
    own = scoring.group("g")
    got = sorted(map(tuple, df.select("g", "x", scoring.min_max(F.col("x"), own), scoring.max_norm(F.col("x"), own), scoring.sum_norm(F.col("x"), own)).collect()))
    assert [r[2] for r in got] == pytest.approx([0, 1, 0, 0, 0], abs=1e-7)
    assert [r[3] for r in got] == pytest.approx([1 / 3, 1, 1, 0, 0], abs=1e-7)
    assert [r[4] for r in got] == pytest.approx([0.25, 0.75, 1, 0.5, 0.5])


def test_generation_retries_and_falls_back(spark, monkeypatch):
    def factory():
        generate.PAUSE = 0
        calls = []

        def call(prompts):
            calls.append(1)
            if len(calls) % 3:
                raise RuntimeError("busy")
            return ["{yes}" if "Question: a" in p else "unsure" for p in prompts]

        return call

    df = spark.createDataFrame([("a", ""), ("b", "")], "question string, evidence string").coalesce(1)
    got = {r.question: r for r in generate.answer_with_fallback(df, factory).collect()}
    assert got["a"].results == "{yes}" and not got["a"].cot_fallback_used
    assert got["b"].results_original == "unsure" and got["b"].cot_fallback_used
    assert one(spark, generate.entity_shares(F.lit("0.2, 0.6"), F.array(F.lit(0.9), F.lit(0.1)))) == pytest.approx([0.25, 0.75])
    assert one(spark, generate.entity_shares(F.lit("nothing"), F.array(F.lit(0.9), F.lit(0.1)))) == [0.9, 0.1]


def test_the_shares_of_a_long_response_are_read_once(spark):
    n = 12_000
    response = ", ".join(f"0.{i % 7 + 1}" for i in range(n))
    start = time.monotonic()
    shares = one(spark, generate.entity_shares(F.lit(response), F.array_repeat(F.lit(1.0) / n, n)))
    total = sum((i % 7 + 1) / 10 for i in range(n))
    assert shares == pytest.approx([(i % 7 + 1) / 10 / total for i in range(n)])
    assert time.monotonic() - start < 15  # read again for each score: about n * n numbers
