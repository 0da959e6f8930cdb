"""Frontiers reach the edges before these are made distinct or meet their types."""

from pyspark.sql import functions as F

from pathloom.operators import beam, match
from pathloom.plans.setting import Graph
from pathloom.sources.durable import durable

SF = "/root/testdata/sf0.001"


def _depths(plan: str, word: str) -> list[int]:
    """How deep in a plan's tree the lines with a word stand."""
    return [len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if word in line]


def test_near_filters_edges_below_their_distinct(spark):
    g = Graph(spark, SF)
    frontier = durable(g.nodes.where("type = 'region'").select(F.col("node_id").alias("node")), "frontier")
    found = beam.near(g.steps, frontier)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert min(_depths(plan, "LeftSemi")) > min(_depths(plan, "Aggregate ["))
    assert {r.node for r in found.collect()} == {r.node for r in frontier.collect()}


def test_explore_keeps_a_table_of_what_is_around(spark, monkeypatch):
    """Each depth reads the edges once, from a frontier of known size."""
    made = []
    monkeypatch.setattr(beam, "durable", lambda df, label: made.append(label) or durable(df, label))
    g = Graph(spark, SF)
    asked = g.regions.select(F.col("r_regionkey").cast("string").alias("question"), F.col("r_regionkey").cast("long").alias("topic"))
    out = beam.explore(asked, g.steps, lambda r: r.withColumn("raw", F.lit(1.0)), lambda c: c.withColumn("raw", F.lit(1.0)), depth=2)
    assert out.count() and made == ["frontier", "around", "kept", "around", "kept"]


def test_leading_on_with_repeated_relations(spark):
    """Relations may repeat, and a candidate that asks for none is not looked up."""
    candidates = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("p", 3, None)], "q string, entity long, next string")
    relations = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "a")], "node long, relation string")
    assert sorted(tuple(r) for r in beam.leading_on(candidates, relations, "next", "q").select("q", "entity").collect()) == [("p", 3), ("q", 1)]


def test_matches_reach_what_the_bank_is_made_of(spark):
    """The bank's joins are of the matched questions' rows only, and the counts are those of all."""
    orders = durable(spark.range(100).select("id", (F.col("id") % 5).alias("data_id")), "orders")
    lines = durable(spark.range(300).select((F.col("id") % 100).alias("id"), F.array(F.lit("a"), F.lit("b")).alias("types"), F.array(F.lit("r")).alias("relations"), F.lit(1).alias("hop")), "lines")
    bank = orders.join(lines, "id").select("data_id", "hop", "types", "relations")
    matched = spark.createDataFrame([(1, 3, None)], "test int, data_id long, answer_type string")
    found = match.patterns_of(matched, bank)
    lines_ = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = next(i for i, line in enumerate(lines_) if "LeftSemi" in line)
    assert sum("Join Inner" in line for line in lines_[:semi]) == 2  # below the meeting with the matches and the bank's own join
    assert [r.n for r in found.collect()] == [60]
