"""Typed beam search over a graph: pattern-guided execution and free exploration.

A frontier is a table (question, path, entity, score, ...). A step joins it with the
edges, filters, scores and keeps the best few of each question; it knows neither gold
answers nor gold paths. Each depth's frontier is a table, so only the edges around it are moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group, sum_norm
from ..sources.durable import durable

WIDTH, DEPTH, TOP, CANDIDATES = 3, 3, 5, 10
#: A scorer adds the column `raw` to candidates (question, relation, entity, ...).
Scorer = Callable[[DataFrame], DataFrame]
#: From triples(question, depth, source, relation, entity, score) so far: the table(question) of those that need no more.
Enough = Callable[[DataFrame], DataFrame]
#: From the triples so far (question is "question#path"; None at the first depth) and the depth to come: question and `asked`, the text put to a scorer.
Ask = Callable[[DataFrame | None, int], DataFrame]


def near(steps: DataFrame, at: DataFrame) -> DataFrame:
    """The steps from the nodes of at(node). Where these are known to be few (a table), Spark takes them to the edges, so that only theirs are made distinct and get a type."""
    return steps.join(at.select("node"), "node", "left_semi")


def keep_if_any(candidates: DataFrame, fits: Column, *by: str) -> DataFrame:
    """The candidates that fit; all of a group of which none does."""
    return candidates.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_any", F.max("_fits").over(group(*by))).where("_fits or not _any").drop("_fits", "_any")


def leading_on(candidates: DataFrame, relations: DataFrame, wanted: str, *by: str) -> DataFrame:
    """The candidates that have the relation of column `wanted`; all of a group of which none has. relations: node, relation.

    Only the relations asked for are looked up, and only at candidates; their names are a handful of a schema's.
    """
    asked = candidates.where(F.col(wanted).isNotNull())
    names = F.broadcast(asked.select(F.col(wanted).alias("relation")).distinct())
    pairs = asked.select(F.col("entity").alias("node"), F.col(wanted).alias("relation"))
    found = relations.join(names, "relation", "left_semi").join(pairs.select("node"), "node", "left_semi").join(pairs, ["node", "relation"], "left_semi")
    have = found.select(F.col("node").alias("entity"), F.col("relation").alias(wanted), F.lit(True).alias("_has")).distinct()
    return keep_if_any(candidates.join(have, ["entity", wanted], "left"), F.col("_has"), *by).drop("_has")


def without_explored(relations: DataFrame, explored: DataFrame) -> DataFrame:
    """Relations that did not lead to the frontier. Both: question, relation."""
    return relations.join(explored, ["question", "relation"], "left_anti")


def prune(candidates: DataFrame, width: int = WIDTH, *by: str) -> DataFrame:
    """The `width` best candidates of each question, ties in their order `ord`; then without those that score 0."""
    return candidates.withColumn("rank", best(group(*(by or ("question",))), F.desc("score"), F.col("ord"))).where((F.col("rank") <= width) & (F.col("score") != 0))


def grouped_scores(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """Scores from raw ones: the `top` best of each (question, relation) group, negatives as 0, as shares of the group's sum times the relation's score.

    If a question has several groups and one has fewer than `top` candidates, shares are of the question's sum and the relation's score does not count.
    """
    by_group, by_question = group("question", "relation"), group("question")
    counted = candidates.withColumn("_size", F.count(F.lit(1)).over(by_group)).withColumn("_place", best(by_group, F.desc("raw"), F.col("entity")))
    merged = F.min("_size").over(by_question) < top
    counted = counted.withColumn("_first", (F.col("_place") == 1).cast("int")).withColumn("_merged", merged & (F.sum("_first").over(by_question) > 1))
    kept = counted.where(F.col("_place") <= top).withColumn("raw", F.greatest("raw", F.lit(0.0)))
    score = F.when(F.col("_merged"), sum_norm(F.col("raw"), by_question)).otherwise(sum_norm(F.col("raw"), by_group) * F.col("relation_score"))
    return kept.withColumn("score", score).drop("_size", "_place", "_first", "_merged")


def parent_scores(candidates: DataFrame) -> DataFrame:
    """Raw scores times the parent's, or the parent's alone where it has one candidate; equal shares where all are 0."""
    own = group("question", "relation", "parent")
    n = F.count(F.lit(1)).over(own)
    share = F.when(F.sum("raw").over(own) > 0, F.col("raw")).otherwise(F.lit(1.0) / n)
    return candidates.withColumn("score", F.when(n == 1, F.col("parent_score")).otherwise(share * F.col("parent_score")))


def relation_choice(relations: DataFrame, width: int = WIDTH) -> DataFrame:
    """Relations with their score: all at equal shares if a question has at most `width`, else the `width` best raw ones; equal shares if all of these are 0."""
    own = group("question")
    ranked = relations.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_place", best(own, F.desc("raw"), F.col("relation"))).where(F.col("_place") <= width)
    kept = F.count(F.lit(1)).over(own)
    score = F.when(F.col("_n") <= width, F.lit(1.0) / F.col("_n")).when(F.sum("raw").over(own) == 0, F.lit(1.0) / kept).otherwise(F.col("raw"))
    return ranked.withColumn("score", score).drop("_n", "_place")


def down_sample(candidates: DataFrame, most: int = CANDIDATES, from_size: int = 20, *by: str) -> DataFrame:
    """The `most` best raw candidates of groups of `from_size` or more; other groups whole."""
    own = group(*(by or ("question", "relation")))
    sized = candidates.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_place", best(own, F.desc("raw"), F.col("entity")))
    return sized.where((F.col("_n") < from_size) | (F.col("_place") <= most)).drop("_n", "_place")


def random_sample(candidates: DataFrame, most: int = CANDIDATES, from_size: int = 20, seed: int = 42, *by: str) -> DataFrame:
    """`most` candidates of groups of `from_size` or more, drawn by md5 of "seed|question|relation|entity": the same draw every time. Other groups whole.

    A sampling operator: what it leaves out is its purpose.
    """
    own = group(*(by or ("question", "relation")))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), "question", "relation", F.col("entity").cast("string")))
    sized = candidates.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_place", best(own, drawn, F.col("entity")))
    return sized.where((F.col("_n") < from_size) | (F.col("_place") <= most)).drop("_n", "_place")


def by_name(candidates: DataFrame, nodes: DataFrame, *by: str) -> DataFrame:
    """Candidates with their `name` and the place `ord` that names, then ids, give them in their question and relation: the order in which a prompt lists them."""
    named = candidates.join(nodes.select(F.col("node_id").alias("entity"), "name"), "entity")
    return named.withColumn("ord", best(group(*(by or ("question", "relation"))), F.col("name"), F.col("entity")))


def dense_scores(candidates: DataFrame) -> DataFrame:
    """Scores of all candidates from raw ones (products of vectors): negatives as 0, as shares of the (question, relation) group's sum, times the relation's score."""
    raised = candidates.withColumn("raw", F.greatest("raw", F.lit(0.0)))
    return raised.withColumn("score", sum_norm(F.col("raw"), group("question", "relation")) * F.col("relation_score"))


def run_pattern(questions: DataFrame, steps: DataFrame, relations: DataFrame, score: Scorer, width: int = WIDTH, depth: int = DEPTH, free: Scorer | None = None, ask: Ask | None = None) -> DataFrame:
    """question, path, depth, source, relation, entity and score of the triples that pattern-guided search keeps.

    questions: question, path (a pattern's number), topic, types, relations. Each depth forces the pattern's relation,
    keeps the type's candidates and those that lead on (unless none does), scores and prunes.
    free: scores relations(question, relation) of the paths whose frontier lacks the pattern's relation; the best are followed
    instead, to any type. Without it such a path ends. ask: the question as put at a depth, see Ask.
    """
    # tables tell Spark that frontiers are small, see near()
    asked = durable(questions.select(F.concat_ws("#", "question", "path").alias("q"), "topic", "types", "relations"), "asked")
    frontier = asked.select("q", F.col("topic").alias("node"), F.lit(1.0).alias("parent_score"))
    out = None
    for i in range(depth):
        goal = asked.where(F.size("relations") > i).select("q", F.get("relations", F.lit(i)).alias("relation"), F.get("types", F.lit(i + 1)).alias("wanted_type"), F.get("relations", F.lit(i + 1)).alias("next"))
        aimed = durable(frontier.join(goal, "q"), "aimed")
        onward = aimed.join(near(steps, aimed), ["node", "relation"])
        if free is not None:
            onward = durable(onward, "onward")
            lost = aimed.join(onward.select("q").distinct(), "q", "left_anti").drop("relation")
            lost = durable(lost.join(near(steps, durable(lost, "lost")), "node"), "around")
            chosen = relation_choice(free(lost.select(F.col("q").alias("question"), "relation").distinct()), width).select(F.col("question").alias("q"), "relation")
            onward = onward.unionByName(lost.join(chosen, ["q", "relation"]).withColumn("wanted_type", F.col("other_type")))
        found = onward.select("q", F.col("node").alias("parent"), "relation", "wanted_type", "next", F.col("other").alias("entity"), "other_type")
        found = durable(keep_if_any(found, F.col("other_type") == F.col("wanted_type"), "q", "parent"), "found")
        found = leading_on(found, relations, "next", "q", "parent")
        # one row for an entity that several parents reach: the first
        once = found.groupBy("q", "relation", "entity").agg(F.min("parent").alias("parent"))
        once = once.withColumnRenamed("q", "question")
        scored = grouped_scores(score(once if ask is None else once.join(ask(out, i + 1), "question", "left")).withColumn("relation_score", F.lit(1.0)))
        kept = prune(scored.withColumn("ord", F.col("entity")), width)
        block = durable(kept.select("question", F.lit(i + 1).alias("depth"), F.col("parent").alias("source"), "relation", "entity", "score"), "kept")
        out = block if out is None else out.unionByName(block)
        frontier = block.select(F.col("question").alias("q"), F.col("entity").alias("node"), F.col("score").alias("parent_score"))
    split = F.split("question", "#")
    return out.select(F.get(split, F.lit(0)).alias("question"), F.get(split, F.lit(1)).cast("int").alias("path"), "depth", "source", "relation", "entity", "score")


def explore(questions: DataFrame, steps: DataFrame, relation_score: Scorer, score: Scorer, width: int = WIDTH, depth: int = DEPTH, enough: Enough | None = None) -> DataFrame:
    """question, depth, source, relation, entity and score of free exploration from questions(question, topic).

    At each depth the frontier's relations but those that led to it are scored and the best chosen, their neighbours scored and pruned.
    enough: the questions that the triples so far suffice for; they go no deeper.
    """
    frontier = durable(questions.select("question", F.col("topic").alias("node")), "frontier")
    came_by = questions.select("question", F.lit(None).cast("string").alias("relation")).where("1 = 0")
    out = None
    for i in range(depth):
        around = durable(frontier.join(near(steps, frontier), "node").select("question", "node", "relation", "other"), "around")
        open_ = without_explored(around.select("question", "relation").distinct(), came_by)
        chosen = relation_choice(relation_score(open_), width).select("question", "relation", F.col("score").alias("relation_score"))
        found = around.join(chosen, ["question", "relation"]).groupBy("question", "relation", "relation_score", F.col("other").alias("entity")).agg(F.min("node").alias("parent"))
        kept = prune(grouped_scores(score(found)).withColumn("ord", F.col("entity")), width)
        block = durable(kept.select("question", F.lit(i + 1).alias("depth"), F.col("parent").alias("source"), "relation", "entity", "score"), "kept")
        out = block if out is None else out.unionByName(block)
        frontier, came_by = block.select("question", F.col("entity").alias("node")).distinct(), block.select("question", "relation").distinct()
        if enough is not None and i + 1 < depth:
            frontier = frontier.join(durable(enough(out), "enough"), "question", "left_anti")  # what a model is asked is asked once
    return out


def succeeded(triples: DataFrame, patterns: DataFrame) -> DataFrame:
    """question, path and success: whether a pattern's every depth kept a triple. patterns: question, path, relations."""
    reached = triples.groupBy("question", "path").agg(F.countDistinct("depth").alias("depths"))
    return patterns.join(reached, ["question", "path"], "left").select("question", "path", (F.coalesce("depths", F.lit(0)) == F.size("relations")).alias("success"))


def explored(triples: DataFrame) -> DataFrame:
    """question, entity and its largest score."""
    return triples.groupBy("question", "entity").agg(F.max("score").alias("score"))


def distinct_triples(triples: DataFrame) -> DataFrame:
    """One row for each triple of a question, at its first depth."""
    return triples.groupBy("question", "source", "relation", "entity").agg(F.min("depth").alias("depth"))


def assembled(blocks: list[DataFrame]) -> DataFrame:
    """Paths put together from triples by depth: a path goes on with the triples whose source is its end, in any case; one that has none stays as it is.

    blocks: question, source, relation, target for each depth.
    """
    first = blocks[0].select("question", F.array(F.struct("source", "relation", "target")).alias("path"), F.lower("target").alias("end"))
    for block in blocks[1:]:
        nxt = block.select("question", F.lower("source").alias("end"), F.struct("source", "relation", "target").alias("t"))
        first = first.join(nxt, ["question", "end"], "left").select("question", F.when(F.col("t").isNotNull(), F.array_append("path", F.col("t"))).otherwise(F.col("path")).alias("path"), F.when(F.col("t").isNotNull(), F.lower("t.target")).otherwise(F.col("end")).alias("end"))
    return first.select("question", "path")


def first_source(candidates: DataFrame) -> DataFrame:
    """question, entity and the source that produced it first."""
    return candidates.groupBy("question", "entity").agg(F.min_by("source", "ord").alias("source"))


def advance(states: DataFrame, survivors: DataFrame) -> DataFrame:
    """states(question, origin, current_hop, total_hops) with the hop one on, once, where an origin has a survivor, up to the total."""
    alive = survivors.select("question", "origin").distinct().withColumn("_on", F.lit(1))
    return states.join(alive, ["question", "origin"], "left").withColumn("current_hop", F.least(F.col("current_hop") + F.coalesce("_on", F.lit(0)), F.col("total_hops"))).drop("_on")


def leading_relations(steps: DataFrame, frontier: DataFrame, wanted_type: str) -> DataFrame:
    """question and relation of the frontier's relations that lead to a node of the type; all of them where none does. frontier: question, node."""
    found = frontier.join(steps, "node").groupBy("question", "relation").agg(F.max(F.col("other_type") == wanted_type).alias("leads"))
    return keep_if_any(found, F.col("leads"), "question").select("question", "relation")


def cascade(candidates: DataFrame) -> DataFrame:
    """Candidates of several sources scored together: the raw score times the source's share of the question's source scores. Columns: question, source, source_score, raw."""
    sources = candidates.select("question", "source", "source_score").distinct()
    shares = sources.withColumn("_share", sum_norm(F.col("source_score"), group("question"))).drop("source_score")
    return candidates.join(shares, ["question", "source"]).withColumn("score", F.col("raw") * F.col("_share")).drop("_share")


def evidence(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """question and evidence: its distinct triples with the nodes' names, by depth, as numbered lines."""
    named = distinct_triples(triples).join(nodes.select(F.col("node_id").alias("source"), F.col("name").alias("s")), "source").join(nodes.select(F.col("node_id").alias("entity"), F.col("name").alias("t")), "entity")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("depth", F.col("s").alias("source"), "relation", F.col("t").alias("target")))), lambda x: F.struct(x["source"].alias("source"), x["relation"].alias("relation"), x["target"].alias("target")))
    return named.groupBy("question").agg(ordered.alias("triples")).select("question", numbered("triples").alias("evidence"))


def numbered(triples: str) -> Column:
    """An array of struct<source, relation, target> as numbered lines."""
    return F.array_join(F.transform(F.col(triples), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t["source"], F.lit(" →["), t["relation"], F.lit("]→ "), t["target"])), "\n")
