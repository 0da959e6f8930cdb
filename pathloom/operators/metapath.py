"""Metapaths: typed relation chains, parsed from their notation and run as joins."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import durable


@dataclass(frozen=True)
class Step:
    relation: str
    forward: bool  # the arrow's direction; the graph itself has none
    type: str


@dataclass(frozen=True)
class Chain:
    """A first node type and the steps from it. An arrow back marks that what follows leads to a second topic."""

    type: str
    steps: tuple[Step, ...]

    @property
    def types(self) -> list[str]:
        return [self.type, *(s.type for s in self.steps)]

    @property
    def relations(self) -> list[str]:
        return [s.relation for s in self.steps]

    @property
    def answer(self) -> int:
        """Position of the answer node: before the first backward step, or the end."""
        return next((i for i, s in enumerate(self.steps) if not s.forward), len(self.steps))


_step = re.compile(r"\s*(→|←)\s*\[([^\]]+)\]\s*(→|←)\s*([^→←]+?)\s*(?=[→←]|$)")


def parse(notation: str) -> list[Chain]:
    """The chains of a pattern "(type → [relation] → type ...) & (...)"."""
    chains = []
    for part in re.split(r"\s*&\s*", notation.strip()):
        if not (part.startswith("(") and part.endswith(")")):
            raise ValueError(f"a chain stands in parentheses: {part}")
        body = part[1:-1]
        start = re.match(r"\s*([^→←]+?)\s*(?=[→←]|$)", body)
        steps, at = [], start.end() if start else 0
        while start and at < len(body.rstrip()):
            m = _step.match(body, at)
            if not m or m[1] != m[3]:
                raise ValueError(f"no step at {body[at:]!r}")
            steps.append(Step(m[2], m[1] == "→", m[4]))
            at = m.end()
        if not start:
            raise ValueError(f"no type in {part!r}")
        chains.append(Chain(start[1], tuple(steps)))
    return chains


def fill(template: str, slots: dict[str, str]) -> str:
    """A query template with <type> slots replaced, each by its name."""
    return re.sub(r"<([^<>]+)>", lambda m: slots.get(m[1], m[0]), template)


def filled(template: Column | str, slots: Column | str) -> Column:
    """fill() as an expression: slots maps types to names; what has no name stays."""
    t, names = (F.col(x) if isinstance(x, str) else x for x in (template, slots))
    pieces, found = F.split(t, "<[^<>]+>"), F.regexp_extract_all(t, F.lit("<([^<>]+)>"), F.lit(1))
    put = F.transform(found, lambda x: F.coalesce(F.try_element_at(names, x), F.concat(F.lit("<"), x, F.lit(">"))))
    return F.array_join(F.zip_with(pieces, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def typed_steps(adjacency: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """node, other, relation and other_type of every directed edge: what chains are joined with."""
    named = adjacency.join(F.broadcast(relations.select("rel_id", "relation")), "rel_id")  # a row for each relation of the schema
    return named.join(nodes.select(F.col("node_id").alias("other"), F.col("type").alias("other_type")), "other").select("node", "other", "relation", "other_type")


def instances(chain: Chain, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """n0, n1, ... of every instance of a chain; nodes may repeat. Each step filters before it joins."""
    out = nodes.where(F.col("type") == chain.type).select(F.col("node_id").alias("n0"))
    for i, s in enumerate(chain.steps, 1):
        own = steps.where((F.col("relation") == s.relation) & (F.col("other_type") == s.type)).select(F.col("node").alias(f"n{i - 1}"), F.col("other").alias(f"n{i}"))
        out = out.join(own, f"n{i - 1}")
    return out


def answers(chain: Chain, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """topic, (second_topic,) answer and paths: how many instances lead from the topics to the answer.

    Walks are summed by their end after each step, so a chain's cost follows its pairs, not its instances.
    """
    out = nodes.where(F.col("type") == chain.type).select(F.col("node_id").alias("topic"), F.col("node_id").alias("at"), F.lit(1).cast("bigint").alias("paths"))
    if chain.answer == 0:
        out = out.withColumn("answer", F.col("topic"))
    for i, s in enumerate(chain.steps, 1):
        own = steps.where((F.col("relation") == s.relation) & (F.col("other_type") == s.type)).select(F.col("node").alias("at"), F.col("other").alias("to"))
        keys = ["topic", *(["answer"] if i > chain.answer else [])]
        out = out.join(own, "at").groupBy(*keys, F.col("to").alias("at")).agg(F.sum("paths").alias("paths"))
        if i == chain.answer:
            out = out.withColumn("answer", F.col("at"))
    if chain.answer < len(chain.steps):
        return out.select("topic", F.col("at").alias("second_topic"), "answer", "paths")
    return out.select("topic", "answer", "paths")


def exists(chain: Chain, topics: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """The topics (topic) from which the chain has an instance: semi-joins from the chain's end to its start, no instance is built."""
    reached = None
    for s in reversed(chain.steps):
        own = steps.where((F.col("relation") == s.relation) & (F.col("other_type") == s.type))
        if reached is not None:
            own = own.join(reached, own.other == reached.at, "left_semi")
        reached = own.select(F.col("node").alias("at")).distinct()
    own = topics.join(nodes.where(F.col("type") == chain.type).select(F.col("node_id").alias("topic")), "topic", "left_semi")
    return own if reached is None else own.join(reached, own.topic == reached.at, "left_semi")


def _semi(df: DataFrame, column: str, kept: DataFrame) -> DataFrame:
    """The rows of df whose column is an `at` of kept."""
    return df.join(kept.select(F.col("at").alias(column)), column, "left_semi").select(*df.columns)


class Reduced(NamedTuple):
    """What can take part in a pair of several chains: topics and ends (at), both tables, and for each chain that leads on from its topic the (node, other) of its steps to the answer."""

    topics: DataFrame
    ends: DataFrame | None
    walks: list[list[DataFrame]]


def reduce_chains(chains: list[Chain], nodes: DataFrame, steps: DataFrame, rounds: int = 1) -> Reduced:
    """Semi-joins along all chains before any pair is formed: back from the ends, then `rounds` times on from the topics that all chains leave and back from the ends that all reach.

    What a chain has behind its answer is a condition on the answer. More rounds can only take away more, since chains that meet at
    both ends are a cycle; the pairs are the same. Each pass writes only steps that the last one left, so tables shrink.
    """
    used = {(s.relation, s.type) for c in chains for s in c.steps}
    named = [(F.col("relation") == r) & (F.col("other_type") == t) for r, t in sorted(used)]
    pool = durable(steps.where(functools.reduce(operator.or_, named, F.lit(False))), "steps")
    kinds = functools.reduce(operator.and_, [F.col("type") == c.type for c in chains])
    topics, ends = nodes.where(kinds).select(F.col("node_id").alias("at")), None
    for c in chains:
        if c.answer < len(c.steps):
            rest = exists(Chain(c.types[c.answer], c.steps[c.answer :]), nodes.select(F.col("node_id").alias("topic")), nodes, pool).select(F.col("topic").alias("at"))
            ends = rest if ends is None else _semi(ends, "at", rest)
            topics = topics if c.answer else _semi(topics, "at", rest)
    walks = [[pool.where((F.col("relation") == s.relation) & (F.col("other_type") == s.type)).select("node", "other") for s in c.steps[: c.answer]] for c in chains if c.answer]

    def back() -> None:
        nonlocal topics
        for walk in walks:
            at = ends
            for i in reversed(range(len(walk))):
                walk[i] = walk[i] if at is None else durable(_semi(walk[i], "other", at), "back")
                at = walk[i].select(F.col("node").alias("at")).distinct()
            topics = _semi(topics, "at", at)
        topics = durable(topics, "topics")

    ends = durable(ends, "ends") if ends is not None else None
    back()
    for _ in range(rounds):
        for walk in walks:
            at = topics
            for i in range(len(walk)):
                walk[i] = durable(_semi(walk[i], "node", at), "on")
                at = walk[i].select(F.col("other").alias("at")).distinct()
            ends = at if ends is None else _semi(ends, "at", at)
        ends = durable(ends, "ends") if ends is not None else None
        back()
    return Reduced(topics, ends, walks)


def compound(chains: list[Chain], nodes: DataFrame, steps: DataFrame, rounds: int = 1) -> DataFrame:
    """topic and answer of the pairs that every chain connects.

    The chains are reduced first (reduce_chains). The chain with the fewest steps left forms pairs, from whichever end has fewer nodes;
    the others only confirm pairs, walking from those nodes that still have one.
    """
    left = reduce_chains(chains, nodes, steps, rounds)
    if not left.walks:
        return left.topics.select(F.col("at").alias("topic"), F.col("at").alias("answer"))
    turned = left.ends.count() < left.topics.count()
    start, end, a, b = ("other", "node", "answer", "topic") if turned else ("node", "other", "topic", "answer")
    pairs = None
    for walk in sorted(left.walks, key=lambda w: sum(step.count() for step in w)):
        walk = walk[::-1] if turned else walk
        first = walk[0].select(F.col(start).alias(a), F.col(end).alias("at")).distinct()
        out = first if pairs is None else first.join(pairs.select(a).distinct(), a, "left_semi")
        for step in walk[1:]:
            out = out.join(step.select(F.col(start).alias("at"), F.col(end).alias("to")), "at").select(a, F.col("to").alias("at")).distinct()
        out = out.withColumnRenamed("at", b)
        pairs = durable(out if pairs is None else pairs.join(out, [a, b], "left_semi"), "pairs")
    if len(left.walks) < len(chains):  # a chain that leads nowhere has its topic as the answer
        pairs = pairs.where("topic = answer")
    return pairs.select("topic", "answer")


def traversable(topics: DataFrame, patterns: DataFrame, nodes: DataFrame, steps: DataFrame, longest: int = 3) -> DataFrame:
    """The rows of topics(topic) x patterns(pattern, types, relations) of which the topic has an instance of the pattern.

    One plan for all patterns: the frontier holds distinct (pattern, topic, node).
    """
    typed = topics.join(nodes.select(F.col("node_id").alias("topic"), F.col("type").alias("t0")), "topic")
    at = typed.join(patterns, F.col("t0") == F.get(F.col("types"), F.lit(0))).select("topic", "pattern", "types", "relations", F.col("topic").alias("node"))
    done = at.where(F.size("relations") == 0).select("topic", "pattern")
    for i in range(longest):
        wanted = at.where(F.size("relations") > i).select("topic", "pattern", "types", "relations", "node", F.get(F.col("relations"), F.lit(i)).alias("relation"), F.get(F.col("types"), F.lit(i + 1)).alias("other_type"))
        at = wanted.join(steps, ["node", "relation", "other_type"]).select("topic", "pattern", "types", "relations", F.col("other").alias("node")).distinct()
        done = done.unionByName(at.where(F.size("relations") == i + 1).select("topic", "pattern").distinct())
    return done
