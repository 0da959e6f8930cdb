"""Guided inference: match a test question with train questions, run their path patterns over the graph, ask a model for the answer.

Model calls are stages with a pluggable generator; everything else is joins and windows
over all questions at once. Gold answers and paths are no inputs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import beam, bm25, generate, match, metapath, pairs, pools
from ..sources import kg
from ..sources.durable import durable
from ..sources.result_log import ResultLog


@dataclass(frozen=True)
class Config:
    """The reference's defaults."""

    matched: int = 5
    hops: tuple[int, ...] = (1, 2, 3)
    width: int = 3
    depth: int = 3
    seed: int = 42
    #: Free exploration ends where a model finds the triples sufficient; paths get a sub-question for each hop.
    sufficiency: bool = True
    subqueries: bool = False
    #: What a prompt says of a candidate besides its name: none, chunk or full. The latter need nodes with a description.
    description: str = "none"


def run(tests: DataFrame, trains: DataFrame, bank: DataFrame, nodes: DataFrame, steps: DataFrame, factory: generate.Factory, score: beam.Scorer | None = None, relation_score: beam.Scorer | None = None, config: Config = Config()) -> DataFrame:
    """question, results, results_original, cot_fallback_used, answer_type, chosen_hop, paths_used, paths_success, fallback, evidence, paths_by_hop,
    triplets_before_dedup and triplets_after_dedup of every test question.

    tests: question, text, topic, topic_type, vector. trains: train, data_id, text, topic_type, train_vector and, if known, train_answer_type.
    bank: data_id, hop, types, relations. score, relation_score: scorers of entities and relations; without them the model scores.
    """
    typed = generate.generate(tests.withColumn("prompt", generate.type_prompt(F.col("text"))), factory, response="said").withColumn("answer_type", T.answer_type("said")).drop("prompt", "said")
    typed = durable(typed, "typed")
    ix = bm25.index(trains, "train", "text")
    asked = typed.select(F.col("question").alias("test"), "topic_type", "vector", "answer_type")
    top = pools.top_trains(pools.pools(asked, trains, ix, bm25.query_terms(typed, "question", "text")), config.matched)
    patterns = match.patterns_of(top.join(typed.select(F.col("question").alias("test"), "answer_type"), "test"), bank, config.hops)

    # patterns that the topic cannot follow go before the cap
    numbered = durable(patterns.withColumn("pattern", F.xxhash64("types", "relations")), "patterns")
    topics = typed.select(F.col("question").alias("test"), "topic")
    wanted = numbered.join(topics, "test").select("topic", "pattern", "types", "relations").distinct()
    alive = metapath.traversable(wanted.select("topic").distinct(), wanted.select("pattern", "types", "relations").distinct(), nodes, steps, max(config.hops))
    followed = numbered.join(topics, "test").join(alive, ["topic", "pattern"], "left_semi").drop("topic")
    capped = durable(match.capped(followed, seed=config.seed), "capped")

    available = capped.groupBy("test").agg(F.array_sort(F.collect_set("hop")).alias("available")).join(match.commonest_hop(capped).select("test", F.col("hop").alias("commonest")), "test")
    examples = capped.groupBy("test").agg(F.array_join(F.slice(F.array_sort(F.collect_list(F.concat(F.col("hop").cast("string"), F.lit(": "), F.array_join("relations", " > ")))), 1, 9), "\n").alias("examples"))
    asked = available.join(examples, "test").join(typed.select(F.col("question").alias("test"), "text"), "test").withColumn("prompt", generate.hop_prompt(F.col("text"), F.col("examples")))
    hops = generate.generate(asked, factory, response="said").select("test", generate.chosen_hop(F.col("said"), F.col("available"), F.col("commonest")).alias("hop"))
    hops = durable(hops, "hops")

    number = F.dense_rank().over(_per_test())
    chosen = durable(capped.join(hops, ["test", "hop"]).withColumn("path", number).join(topics, "test").select(F.col("test").cast("string").alias("question"), "path", "topic", "types", "relations"), "chosen")
    every = durable(typed.select(F.col("question").cast("string").alias("question"), "topic", "text", "answer_type"), "every")
    on_path = F.concat_ws("#", "question", "path").alias("question")
    paths = chosen.join(every.select("question", "text"), "question").select(on_path, "text", F.size("relations").alias("hops"))
    texts = durable(every.select("question", "text").unionByName(paths.select("question", "text")), "texts")
    score = score or generate.entity_scorer(texts, nodes, factory, config.description, config.seed)
    relation_score = relation_score or generate.relation_scorer(texts, factory)
    ask = generate.subquestions(durable(paths, "paths"), nodes, factory) if config.subqueries else None
    guided = durable(beam.run_pattern(chosen, steps, steps.select("node", "relation"), score, config.width, config.depth, relation_score, ask), "guided")
    won = durable(beam.succeeded(guided, chosen), "won")
    counts = won.groupBy("question").agg(F.count("*").alias("paths_used"), F.count_if("success").alias("paths_success"))

    # questions without a path that succeeded explore freely
    enough = generate.sufficiency(texts, nodes, factory) if config.sufficiency else None
    lost = every.join(counts.where("paths_success > 0"), "question", "left_anti").select("question", "topic")
    kept = guided.join(won.where("success"), ["question", "path"], "left_semi").drop("path")
    triples = durable(kept.unionByName(beam.explore(lost, steps, relation_score, score, config.width, config.depth, enough)), "triples")
    evidence = beam.evidence(triples, nodes)
    found = triples.groupBy("question").agg(F.count("*").alias("triplets_before_dedup"))
    distinct = beam.distinct_triples(triples).groupBy("question").agg(F.count("*").alias("triplets_after_dedup"))
    by_hop = capped.groupBy("test", "hop").agg(F.count("*").cast("int").alias("n")).groupBy(F.col("test").cast("string").alias("question")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("hop").cast("string"), "n")))).alias("paths_by_hop"))
    ready = every.join(evidence, "question", "left").fillna("", ["evidence"]).join(counts, "question", "left").fillna(0, ["paths_used", "paths_success"])
    ready = ready.join(hops.select(F.col("test").cast("string").alias("question"), F.col("hop").alias("chosen_hop")), "question", "left").withColumn("fallback", F.col("paths_success") == 0)
    ready = ready.join(by_hop, "question", "left").join(found, "question", "left").join(distinct, "question", "left").fillna(0, ["triplets_before_dedup", "triplets_after_dedup"])
    answered = generate.answer_with_fallback(ready, factory, "text", "evidence")
    return answered.select("question", "results", "results_original", "cot_fallback_used", "answer_type", "chosen_hop", "paths_used", "paths_success", "fallback", "evidence", "paths_by_hop", "triplets_before_dedup", "triplets_after_dedup")


def records(answers: DataFrame, tests: DataFrame) -> DataFrame:
    """What run() returns as records of schemas.RESULT that a result file holds. tests: question and text."""
    named = answers.join(tests.select(F.col("question").cast("string").alias("question"), F.col("text").alias("_text")), "question", "left")
    return named.select(
        F.col("question").alias("data_id"), F.col("_text").alias("question"), "results", F.col("chosen_hop").alias("pathbank_chosen_hop"), F.col("paths_by_hop").alias("pathbank_paths_by_hop"), F.col("paths_used").cast("int").alias("pathbank_paths_used"),
        F.col("paths_success").cast("int").alias("pathbank_paths_success"), F.col("fallback").alias("pathbank_fallback"), F.col("triplets_before_dedup").cast("int").alias("triplets_before_dedup"), F.col("triplets_after_dedup").cast("int").alias("triplets_after_dedup"),
        F.col("answer_type").alias("predicted_answer_type"), "results_original", "cot_fallback_used",
    )


def asked(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """data_id, text, topic and topic_type of every question that has a node as its topic: the one with the smallest id. answer_type is that of its answer, if known."""
    topics = records.select("data_id", pairs.query_text().alias("text"), F.col("answer_entity.type").alias("answer_type"), F.explode(F.map_keys("topic_entities")).alias("key")).withColumn("topic", F.col("key").try_cast("bigint"))
    known = topics.join(nodes.select(F.col("node_id").alias("topic"), F.col("type").alias("topic_type")), "topic")
    return known.groupBy("data_id", "text", "answer_type").agg(F.min(F.struct("topic", "topic_type")).alias("t")).select("data_id", "text", "t.topic", "t.topic_type", "answer_type")


def logged(log: ResultLog, tests: DataFrame, trains: DataFrame, bank: DataFrame, nodes: DataFrame, store: kg.Store, factory: generate.Factory, encoder: Callable[[], generate.Encoder], batches: int = 1, config: Config = Config()) -> int:
    """Answers to the questions of tests, added to the log in batches; how many were run, those that the log has left out. tests, trains: records of questions; bank: what jsonl.path_bank() returns."""
    steps = store.neighbours().select("node", "relation", "other", "other_type")
    questions = durable(generate.encode(asked(tests, nodes).withColumnRenamed("data_id", "question").drop("answer_type"), encoder), "questions")
    known = asked(trains, nodes).select(F.col("data_id").alias("train"), "data_id", "text", "topic_type", F.col("answer_type").alias("train_answer_type"))
    known = durable(generate.encode(known, encoder, vector="train_vector"), "trains")
    patterns = durable(bank.select("data_id", "hop", "types", "relations"), "bank")
    return log.run(questions, lambda part: records(run(part, known, patterns, nodes, steps, factory, config=config), part), "question", batches)


def _per_test():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("test").orderBy("pattern")
