"""Pool scoring in blocks: the test questions of a topic type against the train questions of that type, as matrix products.

Tests and trains of a type are dealt by hash into blocks; a block is one row, with its vectors and its BM25 weights. A test
block goes to each train block of its type, a train block is shuffled once, and their pairs exist only as a matrix in a
worker. The first pass gives a test's extremes in each train block, the second its best trains there; both are merged by
test. What is shuffled beside the blocks is a few rows for each test and train block, never one for each pair. A type that
holds most of the rows is as many keys as it has train blocks.

Tests and trains without a type or a vector take no part; ids are distinct; the vectors of a type have one length. A text
without words has a BM25 score of 0 everywhere. Empty inputs give empty results. Scores are compared as rounded (`digits`), so that the order of
their sums decides nothing; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import EPSILON, best, group
from ..sources.durable import durable
from . import bm25

#: About how many questions a block has.
TESTS, TRAINS = 128, 512
#: Terms whose weights are a matrix at once.
TERMS = 4096
DIGITS = 9


class Pools(NamedTuple):
    """tests: topic_type, block and the question (test, wanted, vector, terms). trains: topic_type, block and rows, its questions. Tables both."""

    tests: DataFrame
    trains: DataFrame


def pools(tests: DataFrame, trains: DataFrame, ix: bm25.Index | None = None, terms: DataFrame | None = None, sizes: tuple[int, int] = (TESTS, TRAINS)) -> Pools:
    """tests: test, topic_type, vector and, if one is predicted, answer_type. trains: train, topic_type, train_vector and, as needed, data_id, hop and train_answer_type.

    ix and terms (query_terms() of the tests) are for hybrid scores. Where some train of the type has a test's answer_type, its pool is these; else it is all of the type.
    """
    tests, trains = tests.where("topic_type is not null and vector is not null"), trains.where("topic_type is not null and train_vector is not null")
    wanted = F.lit(None).cast("string").alias("wanted")
    if {"answer_type"} <= set(tests.columns) and "train_answer_type" in trains.columns:
        have = trains.select("topic_type", F.col("train_answer_type").alias("answer_type")).distinct().withColumn("_has", F.lit(True))
        tests, wanted = tests.join(have, ["topic_type", "answer_type"], "left"), F.when(F.col("_has"), F.col("answer_type").cast("string")).alias("wanted")
    left = _dealt(tests.select("test", "topic_type", wanted, F.col("vector").cast("array<double>").alias("vector")), "test", sizes[0])
    fields = {"data_id": F.col("train"), "hop": F.lit(None).cast("int"), "train_answer_type": F.lit(None).cast("string")}
    own = [F.col(c) if c in trains.columns else other.alias(c) for c, other in fields.items()]
    right = _dealt(trains.select("train", "topic_type", *own, F.col("train_vector").cast("array<double>").alias("vector")).withColumn("train_answer_type", F.col("train_answer_type").cast("string")), "train", sizes[1])
    if ix:
        asked = terms.select("term").distinct()  # no other term of a train counts
        left = _with_terms(left, "test", bm25.query_weights(ix, terms).withColumnRenamed("query", "test"))
        right = _with_terms(right, "train", bm25.doc_weights(ix).join(asked, "term", "left_semi").withColumnRenamed("doc", "train"))
    else:
        left, right = _with_terms(left, "test", None), _with_terms(right, "train", None)
    question = F.struct("train", "data_id", "hop", "train_answer_type", "vector", "terms")
    return Pools(durable(left, "pool_tests"), durable(right.groupBy("topic_type", "blocks", "block").agg(F.collect_list(question).alias("rows")), "pool_trains"))


def _dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with the number of blocks of their type and the block that the key's hash picks."""
    counted = rows.groupBy("topic_type").agg(F.ceil(F.count("*") / size).alias("blocks"))
    return rows.join(counted, "topic_type").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))


def _with_terms(rows: DataFrame, key: str, weights: DataFrame | None) -> DataFrame:
    """rows with `terms`, the weighted terms of the key's text."""
    none = F.array().cast("array<struct<term:string,weight:double>>")
    if weights is None:
        return rows.withColumn("terms", none)
    lists = weights.join(rows.select(key), key, "left_semi").groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    return rows.join(lists, key, "left").withColumn("terms", F.coalesce("terms", none))


def _meetings(tests: DataFrame, trains: DataFrame) -> DataFrame:
    """tests and trains: a row for each test block and train block of a type. tests: rows of Pools.tests, perhaps with more columns."""
    columns = [c for c in tests.columns if c not in ("topic_type", "blocks", "block")]
    packed = tests.groupBy("topic_type", "block").agg(F.collect_list(F.struct(*columns)).alias("tests"))
    counts = trains.groupBy("topic_type").agg(F.max("blocks").alias("blocks"))
    spread = packed.join(counts, "topic_type").select("topic_type", "tests", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return spread.join(trains.select("topic_type", "block", F.col("rows").alias("trains")), ["topic_type", "block"]).select("tests", "trains")


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lexical(tests: pa.StructArray, trains: pa.StructArray) -> np.ndarray:
    """BM25 of every pair: the product of the tests' weights and the trains' weights of the terms that tests have, some terms at a time."""
    sides = []
    for side in (tests, trains):
        terms = side.field("terms")
        every = terms.flatten()
        sides.append((np.repeat(np.arange(len(side)), terms.value_lengths().to_numpy(zero_copy_only=False)), every.field("term"), every.field("weight").to_numpy(zero_copy_only=False)))
    words = pc.unique(sides[0][1])
    at = [pc.fill_null(pc.index_in(term, value_set=words), -1).to_numpy(zero_copy_only=False) for _, term, _ in sides]
    out = np.zeros((len(tests), len(trains)))
    for start in range(0, len(words), TERMS):
        parts = []
        for (row, _, weight), column, n in zip(sides, at, out.shape, strict=True):
            here = (column >= start) & (column < start + TERMS)
            part = np.zeros((n, min(TERMS, len(words) - start)))
            np.add.at(part, (row[here], column[here] - start), weight[here])
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _mask(tests: pa.StructArray, trains: pa.StructArray) -> np.ndarray:
    """Which trains are in the pool of which test."""
    wanted, have = tests.field("wanted"), trains.field("train_answer_type")
    kinds = pc.unique(wanted.drop_null())
    a, b = (pc.fill_null(pc.index_in(x, value_set=kinds), other).to_numpy(zero_copy_only=False) for x, other in ((wanted, -1), (have, -2)))
    return (a[:, None] == -1) | (a[:, None] == b[None, :])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, pa.StructArray]]:
    for rows in batches:
        for i in range(rows.num_rows):
            yield rows.column("tests")[i].values, rows.column("trains")[i].values


def extremes(p: Pools) -> DataFrame:
    """test, dense_low, dense_high, bm25_low and bm25_high over each test's pool."""
    names = ["dense_low", "dense_high", "bm25_low", "bm25_high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tests, trains in _each(batches):
            mask = _mask(tests, trains)
            some = mask.any(axis=1)
            columns = []
            for scores in (_matrix(tests.field("vector")) @ _matrix(trains.field("vector")).T, _lexical(tests, trains)):
                columns += [np.where(mask, scores, np.inf).min(axis=1)[some], np.where(mask, scores, -np.inf).max(axis=1)[some]]
            yield pa.RecordBatch.from_arrays([tests.field("test").filter(pa.array(some)), *map(pa.array, columns)], ["test", *names])

    found = _meetings(p.tests, p.trains).mapInArrow(run, f"test {dict(p.tests.dtypes)['test']}, " + ", ".join(f"{n} double" for n in names))
    return found.groupBy("test").agg(*((F.min if n.endswith("low") else F.max)(n).alias(n) for n in names))


def _hybrid(tests: pa.StructArray, trains: pa.StructArray) -> np.ndarray:
    out = 0.0
    for name, scores in (("dense", _matrix(tests.field("vector")) @ _matrix(trains.field("vector")).T), ("bm25", _lexical(tests, trains))):
        low, high = (tests.field(f"{name}_{end}").to_numpy(zero_copy_only=False)[:, None] for end in ("low", "high"))
        out = out + 0.5 * ((scores - low) / (high - low + EPSILON))
    return out


def _dense(tests: pa.StructArray, trains: pa.StructArray) -> np.ndarray:
    return _matrix(tests.field("vector")) @ _matrix(trains.field("vector")).T


def _best(tests: DataFrame, trains: DataFrame, scorer: Callable[[pa.StructArray, pa.StructArray], np.ndarray], name: str, identity: str, k: int, digits: int, by_hop: bool) -> DataFrame:
    """test, (hop,) identity, the score's name and rank: the k best different ids of each test (and hop) by rounded score, from the k best of each train block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _each(batches):
            scores, mask = np.round(scorer(left, right), digits) + 0.0, _mask(left, right)
            ids = pc.rank(right.field(identity), sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype("int64")
            hops = right.field("hop").to_numpy(zero_copy_only=False) if by_hop else np.zeros(len(right), "int8")
            test, train = [], []
            for t in range(len(left)):
                order = np.lexsort((ids, -scores[t]))
                order = order[mask[t, order]]
                for hop in np.unique(hops):
                    own = order[hops[order] == hop]
                    first = np.sort(np.unique(ids[own], return_index=True)[1])[:k]
                    test.append(np.full(len(first), t))
                    train.append(own[first])
            t, c = np.concatenate(test), np.concatenate(train)
            out = [left.field("test").take(pa.array(t)), *([right.field("hop").take(pa.array(c))] if by_hop else []), right.field(identity).take(pa.array(c)), pa.array(scores[t, c])]
            yield pa.RecordBatch.from_arrays(out, ["test", *(["hop"] if by_hop else []), identity, name])

    kinds = dict(tests.dtypes) | {f.name: f.dataType.simpleString() for f in trains.schema["rows"].dataType.elementType.fields}
    keys = ["test", "hop"] if by_hop else ["test"]
    found = _meetings(tests, trains).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, identity]) + f", {name} double")
    each = found.groupBy(*keys, identity).agg(F.max(name).alias(name))
    return each.withColumn("rank", best(group(*keys), F.desc(name), F.col(identity))).where(F.col("rank") <= k)


def top_trains(p: Pools, k: int = 5, digits: int = DIGITS) -> DataFrame:
    """test, data_id, hybrid and rank: the k best distinct train questions of each test's pool, by half the min-max normalised dense score and half the BM25 score's."""
    return _best(p.tests.join(extremes(p), "test"), p.trains, _hybrid, "hybrid", "data_id", k, digits, False)


def best_per_hop(p: Pools, digits: int = DIGITS) -> DataFrame:
    """test, hop, train and hybrid: the best train question of each test and hop (not null)."""
    return _best(p.tests.join(extremes(p), "test"), p.trains, _hybrid, "hybrid", "train", 1, digits, True).where("hop is not null").drop("rank")


def nearest(p: Pools, k: int, digits: int = DIGITS) -> DataFrame:
    """test, train, dense and rank: the k trains of each test's pool with the largest product of vectors."""
    return _best(p.tests, p.trains, _dense, "dense", "train", k, digits, False)
