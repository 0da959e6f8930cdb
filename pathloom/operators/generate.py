"""Language-model calls as a stage of a plan.

A generator is any function from a list of prompts to a list of texts. It is made once in
each worker process by a factory that is sent there, and is fed in batches. What surrounds
the call (prompts, parsing, fallbacks, normalisation) are Column expressions.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import unit
from ..sources.durable import durable
from . import beam, bm25
from .memo import Remembered

Generator = Callable[[list[str]], list[str]]
Factory = Callable[[], Generator]
#: From texts to vectors, made in a worker like a generator.
Encoder = Callable[[list[str]], list[list[float]]]

#: Tries of a call and seconds between two.
TRIES, PAUSE = 3, 1.0
#: Texts that an encoder gets at once.
ENCODED = 256
_made: dict[str, Callable] = {}


def encode(df: DataFrame, factory: Callable[[], Encoder], text: str = "text", vector: str = "vector", batch: int = ENCODED) -> DataFrame:
    """df with the vector of each text (null: the empty text), scaled to length 1."""
    columns, key = df.columns, f"{factory.__module__}.{getattr(factory, '__qualname__', 'factory')}"
    fields = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{vector}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made[key] = factory()
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                out = _made[key]([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float64()))], [*columns, vector])

    return df.mapInArrow(run, fields).withColumn(vector, unit(vector))


def letter_encoder() -> Encoder:
    """A deterministic stand-in: how often each of eight letters stands in a text."""
    return lambda texts: [[float(t.lower().count(c)) for c in "aeinorst"] for t in texts]


def generate(df: DataFrame, factory: Factory | Remembered, prompt: str = "prompt", response: str = "response", name: str | None = None, batch: int = 64, error: str | None = None) -> DataFrame:
    """df with the response to each prompt; '' where every try failed or the prompt is null.

    name: generators of one name are made once in a worker process. error: a column for what the last try failed with, null where one
    succeeded. A Remembered factory is asked only for prompts that its memo does not have.
    """
    if isinstance(factory, Remembered):
        return factory.memo.answer(df, lambda rows: generate(rows, factory.factory, "prompt", "response", name, batch, "error"), prompt, response)
    columns = df.columns
    key = name or f"{factory.__module__}.{getattr(factory, '__qualname__', 'factory')}"
    fields = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{response}` string", *([f"`{error}` string"] if error else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made[key] = factory()
        call = _made[key]
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                prompts = [p or "" for p in part.column(prompt).to_pylist()]
                out, why = [""] * len(prompts), None
                for n in range(TRIES):
                    try:
                        out, why = call(prompts), None
                        break
                    except Exception as e:  # noqa: BLE001  a model server may fail in any way
                        why = f"{type(e).__name__}: {e}"
                        if n + 1 < TRIES:
                            time.sleep(PAUSE)
                more = [pa.array([why] * len(prompts), pa.string())] if error else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string()), *more], [*columns, response, *([error] if error else [])])

    return df.mapInArrow(run, fields)


def echo_generator() -> Generator:
    """A deterministic stand-in: scores the items after the last "Candidates:" by the words they share with the "Question:" line."""

    def words(s: str) -> set[str]:
        return set(re.findall(r"[a-z0-9]+", s.lower()))

    def one(prompt: str) -> str:
        asked = words(next(iter(re.findall(r"Question: (.*)", prompt)), ""))
        items = [x.strip() for x in prompt.rpartition("Candidates:")[2].split(";") if x.strip()]
        if not items:
            return f"{{{' '.join(sorted(asked)[:3])}}}"
        shares = [len(asked & words(x)) for x in items]
        total = sum(shares)
        return ", ".join(f"{s / total if total else 1 / len(items):.4f}" for s in shares)

    return lambda prompts: [one(p) for p in prompts]


# ---- Prompts: our own wording --------------------------------------------------------------------------------------


def score_prompt(question: Column, relation: Column, names: Column) -> Column:
    return F.concat(F.lit("Give each candidate a share of 1 by how much it helps to answer.\nQuestion: "), question, F.lit("\nRelation: "), relation, F.lit("\nCandidates: "), F.array_join(names, "; "))


def relation_prompt(question: Column, relations: Column) -> Column:
    return F.concat(F.lit("Name up to three relations worth following, each as {relation (Score: x)}.\nQuestion: "), question, F.lit("\nCandidates: "), F.array_join(relations, "; "))


def answer_prompt(question: Column, evidence: Column) -> Column:
    return F.concat(F.lit("Answer from the triples and your knowledge; put the answer in braces.\nQuestion: "), question, F.lit("\nTriples: "), evidence)


def enough_prompt(question: Column, evidence: Column) -> Column:
    return F.concat(F.lit("Do the triples suffice to answer? Begin with {Yes} or {No}.\nQuestion: "), question, F.lit("\nTriples: "), evidence)


def type_prompt(question: Column) -> Column:
    return F.concat(F.lit("Which of these types has the answer: "), F.lit(", ".join(T.NODE_TYPES)), F.lit("?\nQuestion: "), question)


def hop_prompt(question: Column, examples: Column) -> Column:
    return F.concat(F.lit("How many hops does the question need? Reply with one number.\nQuestion: "), question, F.lit("\n"), examples)


def subquery_prompt(question: Column, evidence: Column, hop: Column, hops: Column) -> Column:
    return F.concat(F.lit('Write the sub-question of this hop as {"subquery": ..., "target_type": ...}.\nQuestion: '), T.without_choices(question), F.lit("\nHop "), hop, F.lit(" of "), hops, F.lit("\nPath: "), evidence)


def direct_prompt(question: Column) -> Column:
    return F.concat(F.lit("Think step by step and put the answer in braces.\nQuestion: "), question)


# ---- What is made of the responses ---------------------------------------------------------------------------------


def effective_query(query: Column, sub: Column) -> Column:
    return F.when(sub.isNotNull() & (sub != ""), F.concat(query, F.lit("\nAt this step: "), sub)).otherwise(query)


def entity_shares(response: Column, dense: Column) -> Column:
    """A response's scores as shares; the dense scores where the response is uniform, as it is if it can't be read."""
    scores = T.score_list(response, F.size(dense))
    read = F.struct(scores.alias("scores"), F.aggregate(scores, F.lit(0.0), lambda a, s: a + s).alias("total"), F.size(dense).alias("n"))

    def shares(r: Column) -> Column:
        even = F.lit(1.0) / r["n"]
        uniform = F.forall(r["scores"], lambda s: F.abs(s - even) < 1e-6)
        return F.when(uniform, dense).when(r["total"] > 0, F.transform(r["scores"], lambda s: s / r["total"])).otherwise(F.array_repeat(even, r["n"]))

    # bound as a variable, the response is read once; in a lambda over the scores it would be for each of them
    return F.get(F.transform(F.array(read), shares), F.lit(0))


def chosen_hop(response: Column, available: Column, commonest: Column) -> Column:
    return F.coalesce(T.first_hop(response, available), commonest)


def is_sufficient(response: Column) -> Column:
    return T.says_yes(T.reasoning_answer(response))


def answer_with_fallback(questions: DataFrame, factory: Factory, question: str = "question", evidence: str = "evidence") -> DataFrame:
    """questions with results, results_original and cot_fallback_used: answered from the evidence, and asked
    directly where that response has no braced answer. Only those rows are asked twice."""
    first = generate(questions.withColumn("prompt", answer_prompt(F.col(question), F.col(evidence))), factory, response="results_original").drop("prompt")
    bare = T.final_answer("results_original") == ""
    done = first.where(~bare).select("*", F.col("results_original").alias("results"), F.lit(False).alias("cot_fallback_used"))
    again = generate(first.where(bare).withColumn("prompt", direct_prompt(F.col(question))), factory, response="results").drop("prompt").withColumn("cot_fallback_used", F.lit(True))
    return done.unionByName(again)


# ---- Scorers and stops of the beam that ask a model ---------------------------------------------------------------------


def described(candidates: DataFrame, nodes: DataFrame, texts: DataFrame, mode: str = "none") -> DataFrame:
    """Candidates with `shown`, what a prompt says of each: the name alone ("none"), or with the node's description, whole ("full") or its clause that scores best against the question ("chunk").

    candidates: question, entity and name. nodes: node_id and description. texts: question and text.
    """
    if mode == "none":
        return candidates.withColumn("shown", F.col("name"))
    if mode not in ("full", "chunk"):
        raise ValueError(f"no description mode {mode}")
    about = candidates.select("question", "entity").distinct().join(nodes.select(F.col("node_id").alias("entity"), "description"), "entity").withColumn("doc", F.concat_ws("|", "question", "entity"))
    if mode == "chunk":
        about = durable(about, "about")
        pieces = about.select("doc", F.posexplode(T.chunks("description")).alias("pos", "piece"))
        best = bm25.best_piece(pieces, about.join(texts, "question").select("doc", "text"), T.ascii_tokens)
        about = about.drop("description").join(best.select("doc", F.col("piece").alias("description")), "doc", "left")
    added = F.when(F.coalesce("description", F.lit("")) == "", F.col("name")).otherwise(F.concat("name", F.lit(": "), "description"))
    return candidates.join(about.drop("doc"), ["question", "entity"], "left").withColumn("shown", added).drop("description")


def relation_scorer(texts: DataFrame, factory: Factory) -> beam.Scorer:
    """Scores relations(question, relation) by a model's response; relations that it doesn't name score 0. texts: question and text."""

    def score(relations: DataFrame) -> DataFrame:
        asked = relations.groupBy("question").agg(F.array_sort(F.collect_set("relation")).alias("names")).join(texts, "question", "left").fillna("", ["text"])
        said = durable(generate(asked.withColumn("prompt", relation_prompt(F.col("text"), F.col("names"))), factory, response="said"), "relations")
        found = said.select("question", F.inline(T.relation_scores("said", "names"))).groupBy("question", "relation").agg(F.max("score").alias("raw"))
        return relations.join(found, ["question", "relation"], "left").fillna(0.0, ["raw"])

    return score


def entity_scorer(texts: DataFrame, nodes: DataFrame, factory: Factory, description: str = "none", seed: int = 42) -> beam.Scorer:
    """Scores candidates by a model's shares, group by group in the order of their names; groups of 20 or more are sampled first.

    A column `asked` of the candidates stands for the question's text. Where a response can't be read all of the group score alike.
    """

    def score(candidates: DataFrame) -> DataFrame:
        few = durable(beam.by_name(beam.random_sample(candidates, seed=seed), nodes), "few")
        own = few.join(texts, "question", "left").withColumn("text", F.coalesce(*([F.col("asked")] if "asked" in few.columns else []), F.col("text"), F.lit("")))
        shown = described(own, nodes, texts, description)
        lists = F.array_sort(F.collect_list(F.struct("ord", "entity", "shown")))
        grouped = shown.groupBy("question", "relation").agg(F.first("text").alias("text"), lists.alias("listed"))
        prompted = grouped.withColumn("prompt", score_prompt(F.col("text"), F.col("relation"), F.col("listed.shown")))
        said = durable(generate(prompted, factory, response="said"), "scores")
        even = F.array_repeat(F.lit(1.0) / F.size("listed"), F.size("listed"))
        shares = said.select("question", "relation", F.inline(F.arrays_zip(F.col("listed.entity").alias("entity"), entity_shares(F.col("said"), even).alias("raw"))))
        return few.join(shares, ["question", "relation", "entity"]).drop("name", "ord")

    return score


def sufficiency(texts: DataFrame, nodes: DataFrame, factory: Factory) -> beam.Enough:
    """The questions whose triples a model finds sufficient."""

    def enough(triples: DataFrame) -> DataFrame:
        asked = beam.evidence(triples, nodes).join(texts, "question")
        said = generate(asked.withColumn("prompt", enough_prompt(F.col("text"), F.col("evidence"))), factory, response="said")
        return said.where(is_sufficient(F.col("said"))).select("question")

    return enough


def subquestions(paths: DataFrame, nodes: DataFrame, factory: Factory) -> beam.Ask:
    """The question as put at each depth, with the sub-question that a model writes for it. paths: question ("question#path"), text and hops."""

    def ask(triples: DataFrame | None, depth: int) -> DataFrame:
        asked = paths.where(F.col("hops") >= depth)
        asked = asked.withColumn("evidence", F.lit("")) if triples is None else asked.join(beam.evidence(triples, nodes), "question", "left").fillna("", ["evidence"])
        said = generate(asked.withColumn("prompt", subquery_prompt(F.col("text"), F.col("evidence"), F.lit(str(depth)), F.col("hops").cast("string"))), factory, response="said")
        return durable(said.select("question", effective_query(F.col("text"), T.subquery("said")["subquery"]).alias("asked")), "asked")

    return ask


def stop_half(triples: DataFrame, depth: int) -> DataFrame:
    """What was found when a search ends early: the triples up to a depth."""
    return triples.where(F.col("depth") <= depth)
