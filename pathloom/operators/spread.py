"""Personalised PageRank of runs that reach the whole graph: products of blocks of weights with blocks of ranks.

push.py reads only the edges near its seeds. A run without a floor has reached every node of a connected graph after a few rounds, and from
then on a row for each edge and round is what it costs. Here nodes are dealt into stripes by ranges of their ids (ids of one kind
lie together, so many pairs of stripes have no edges), a cell is the edges between two stripes as places within these, and a
run's ranks in a stripe are arrays of PIECE nodes. A round sends the pieces of both stripes in which a cell has ends to the cell, which weighs its
edges once for both directions and sums what arrives, and sums what cells send to a piece: what moves are nodes and not edges. Cells are a bucketed table and don't move.

What a task holds is bounded, whatever the graph: a cell has EDGES edges at most (larger ones are slices), a stripe NODES nodes, and the runs that share a
cell have VALUES ranks in a stripe. No row is longer than a piece.

Weights are made from their parts in each round and never written: a relation's share, the ends' shares, the least weight. p = reset + d P p from p = the seeds
is what pushing gives: ranks sum to one and after n rounds no rank is wrong by more than 2 d^n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best, group
from ..sources.durable import bucketed, durable
from .weights import Weighting

#: Edges of a cell, about, if a stripe's edges lead to all stripes alike, and at most; of a cell of a graph of fewer stripes than FEW, which are cut finer so that
#: several tasks work; edges that are made into places at a time; runs that share a cell, at most.
EDGES, FINE, FEW, PART, LANES = 12_000_000, 1_000_000, 4, 2_000_000, 16
#: Nodes of a stripe, ranks of a cell's runs in a stripe (but one run's) and numbers in a row, at most.
NODES, VALUES, PIECE = 2_000_000, 4_000_000, 131_072

_ROW = "block string, stripe int, piece int, lane int, q int, data binary"
_CELL = ("block", "bu", "bv", "slice")


def _schema(kinds: str) -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, types[t]) for n, t in (x.split() for x in kinds.split(", "))])


def _table(rows: list[tuple], kinds: str) -> pa.Table:
    schema = _schema(kinds)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _floats(data) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(data.as_buffer(), "<f8")


def _rows(table: pa.Table, *names: str) -> Iterator[tuple]:
    """The rows of a few large values, as Python values but for `data`, which stays where it is."""
    for i in range(table.num_rows):
        yield tuple(table[n][i] if n in ("data", "nodes") else table[n][i].as_py() for n in names)


def _cut(a: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The pieces of an array that aren't all 0, by number."""
    for i in range(0, len(a), PIECE):
        own = a[i : i + PIECE]
        if own.any():
            yield i // PIECE, own.tobytes()


def _put(into: np.ndarray, piece: int, data: np.ndarray) -> None:
    into[piece * PIECE : piece * PIECE + len(data)] = data


def _meet(left: DataFrame, right: DataFrame, keys: list[str], run, kinds: str) -> DataFrame:  # noqa: ANN001
    """run(key, left's rows, right's rows) of each key of both."""
    left, right = (df.toDF(*df.columns).groupBy(*keys) for df in (left, right))  # names of its own, where both are made of one table
    return left.cogroup(right).applyInArrow(run, kinds)


def dealt(seeds: DataFrame, nodes: int) -> DataFrame:
    """run, query, block and lane: runs of one query lie together, as many in a block as may share a cell of stripes of so many nodes."""
    most = max(1, min(LANES, VALUES // max(1, nodes)))
    runs = durable(seeds.select("run", "query").distinct(), "runs")
    deals = max(1, runs.count() // 1000)
    placed = runs.withColumn("_deal", F.pmod(F.xxhash64("query"), F.lit(deals))).withColumn("_n", best(group("_deal"), F.col("query"), F.col("run")) - 1)
    return durable(placed.select("run", "query", F.concat_ws(".", "_deal", F.floor(F.col("_n") / most)).alias("block"), (F.col("_n") % most).alias("lane")), "lanes")


class Links(NamedTuple):
    """pairs: u, v (not before u) and code of the nodes with edges between them, each pair once. lists: code and rels, the relations between them; as many as a schema's relations make."""

    pairs: DataFrame
    lists: DataFrame


def links(edges: DataFrame) -> Links:
    """The links of edges(u, v, rel_id), which may repeat. Relations are bits while they are gathered, so edges move once and no list is made for a pair."""
    known = sorted(r[0] for r in edges.select("rel_id").distinct().collect())  # a schema's relations
    words = {f"_m{i // 62}": known[i : i + 62] for i in range(0, len(known), 62)} or {"_m0": []}
    bits = lambda own: F.coalesce(*(F.when(F.col("rel_id") == r, F.lit(1 << i).cast("long")) for i, r in enumerate(own)), F.lit(0).cast("long"))
    made = durable(edges.repartition("v").groupBy("u", "v").agg(*(F.bit_or(bits(own)).alias(m) for m, own in words.items())), "links")
    each = [F.when(F.col(m).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(r)) for m, own in words.items() for i, r in enumerate(own)]
    rels = F.array_compact(F.array(*each)).cast(f"array<{dict(edges.dtypes)['rel_id']}>")
    lists = durable(made.select(*words).distinct().select(*words, rels.alias("rels"), (best(group(F.lit(0)), *map(F.col, words)) - 1).alias("code")), "lists")
    return Links(made.join(F.broadcast(lists.drop("rels")), [*words]).select("u", "v", "code"), lists.select("code", "rels"))


def _links_of(steps: DataFrame) -> Links:
    """Links of what push.adjacency() returns."""
    lists = durable(steps.select("rels").distinct().withColumn("code", best(group(F.lit(0)), F.col("rels")) - 1), "lists")
    return Links(steps.where("node <= other").join(F.broadcast(lists), "rels").select(F.col("node").alias("u"), F.col("other").alias("v"), "code"), lists)


def _sum(own: list[Column]) -> Column:
    """Their sum, as a tree that isn't deep."""
    half = len(own) // 2
    return own[0] if len(own) == 1 else _sum(own[:half]) + _sum(own[half:])


class Stripes:
    """The stripes of a graph: size by its edges, cuts by ids, and nodes: stripe and nodes, the ids of its nodes in order; a node's place among them is its number. most: nodes of the largest."""

    def __init__(self, linked: Links, edges: int = EDGES, nodes: int = NODES):
        ends = linked.pairs.select("u").union(linked.pairs.select("v")).toDF("node")
        n = linked.pairs.agg(F.count("*") + F.count_if(F.col("u") != F.col("v"))).first()[0]
        self.size = max(1, math.ceil(math.sqrt(n / edges)), min(FEW, math.ceil(math.sqrt(n / FINE))))
        cuts = ends.agg(F.percentile_approx("node", [i / self.size for i in range(1, self.size)], 10_000)).first()[0] if self.size > 1 else []
        self.cuts = sorted(set(cuts or []))  # a few numbers, fewer than stripes
        ids = self.ids = durable(ends.distinct(), "ids")
        # stripes of many nodes of few edges are cut again
        fine = 256
        own = ids.groupBy(self.of("node").alias("stripe")).agg(F.count("*").alias("n"), F.percentile_approx("node", [i / fine for i in range(1, fine)], 10_000).alias("at")).collect()
        for r in own:
            k = min(fine, math.ceil(r.n / nodes))
            self.cuts += [r["at"][round(i * fine / k) - 1] for i in range(1, k)]
        self.cuts = sorted(set(self.cuts))
        self.nodes = durable(self._numbered(ids), "nodes", wide=True)
        self.most = self.nodes.agg(F.max(F.length("nodes") / 8).cast("long")).first()[0] or 0

    def of(self, node: str) -> Column:
        return _sum([(F.col(node) > c).cast("int") for c in self.cuts]) if self.cuts else F.lit(0)

    def _numbered(self, ids: DataFrame) -> DataFrame:
        def sort(table: pa.Table) -> pa.Table:
            return _table([(table["stripe"][0].as_py(), np.sort(table["node"].to_numpy()).astype("<i8").tobytes())], "stripe int, nodes binary")

        return ids.select(self.of("node").alias("stripe"), "node").groupBy("stripe").applyInArrow(sort, "stripe int, nodes binary")

    def pieces(self) -> DataFrame:
        """stripe, piece and data: the ids of a piece's nodes."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = np.frombuffer(batch["nodes"][i].as_buffer(), "<i8")
                    for a in range(0, len(ids), PIECE):
                        yield from _table([(batch["stripe"][i].as_py(), a // PIECE, ids[a : a + PIECE].tobytes())], "stripe int, piece int, data binary").to_batches()

        return self.nodes.mapInArrow(cut, "stripe int, piece int, data binary")


class Grid:
    """The graph as cells of stripes, with what some questions' weights are made of. runs: run, query, block and lane. steps: what links() or push.adjacency() returns."""

    def __init__(self, runs: DataFrame, steps: Links | DataFrame, by: Weighting, edges: int = EDGES, part: int = PART, stripes: Stripes | None = None):
        self.by, self.runs = by, runs
        linked = steps if isinstance(steps, Links) else _links_of(steps)
        self.stripes = stripes or Stripes(linked, edges)
        self.size, self.nodes = self.stripes.size, self.stripes.nodes
        asked = durable(runs.select("block", "query").distinct().withColumn("q", best(group("block"), F.col("query")) - 1), "asked")
        self.lanes = durable(runs.join(asked, ["block", "query"]), "lanes")
        # an edge is there once, at its smaller end, whose stripe is not after the other's
        placed = linked.pairs.select(self.stripes.of("u").alias("bu"), self.stripes.of("v").alias("bv"), F.col("u").alias("node"), F.col("v").alias("other"), "code")
        counted = placed.groupBy("bu", "bv").agg(F.count("*").alias("n"))
        counted = durable(counted.select("bu", "bv", F.ceil(F.col("n") / part).cast("int").alias("parts"), F.ceil(F.col("n") / edges).cast("int").alias("slices")), "filled")
        self.filled = counted.select("bu", "bv").union(counted.where("bu <> bv").select("bv", "bu"))
        dealt = placed.join(F.broadcast(counted), ["bu", "bv"]).withColumn("part", F.pmod(F.hash("node", "other"), "parts"))
        packed = self._packed(dealt.withColumn("slice", F.pmod("part", "slices")).drop("parts", "slices"), counted)
        #: bu, bv, slice, end, stripe and piece: where a cell has ends.
        self.touched = durable(packed.where("what in ('u', 'v')").select("bu", "bv", "slice", F.col("what").alias("end"), F.when(F.col("what") == "u", F.col("bu")).otherwise(F.col("bv")).alias("stripe"), F.col("at").alias("piece")).distinct(), "touched")
        blocks, slices = asked.select("block").distinct(), packed.select("bu", "bv", "slice").distinct()
        columns = [*_CELL, "what", "at", "piece", "data"]
        shares = self._shares(linked.lists).join(asked, "query").crossJoin(slices).select("block", "bu", "bv", "slice", F.lit("k").alias("what"), F.col("q").alias("at"), F.lit(0).alias("piece"), "data")
        sims = durable(self._dense(asked).join(asked, "query"), "similarities", wide=True)
        own = sims.join(self.touched, ["stripe", "piece"]).select("block", "bu", "bv", "slice", F.col("end").alias("what"), F.col("q").alias("at"), "piece", "data")
        every = packed.where("what in ('e', 'n')").withColumn("piece", F.lit(0)).crossJoin(F.broadcast(blocks)).select(*columns).unionByName(shares).unionByName(own)
        self.cells = bucketed(every, "cells", *_CELL, wide=True)

    def _packed(self, edges: DataFrame, counted: DataFrame) -> DataFrame:
        """bu, bv, slice, what, at and data: the places of some starts, their ends and the codes of their relations, by end (e); the sizes of the stripes (n); the pieces of either stripe that have ends (u, v)."""
        kinds = "bu int, bv int, slice int, what string, at int, data binary"

        def pack(key: tuple, own: pa.Table, ids: pa.Table) -> pa.Table:
            bu, bv, slice_, part = (k.as_py() for k in key)
            if not own.num_rows:
                return _table([], kinds)
            ends = {w: np.frombuffer(d.as_buffer(), "<i8") for w, d in _rows(ids, "end", "nodes")}
            u, v = (np.searchsorted(ends[e], own[c].to_numpy()).astype("<i4") for e, c in (("u", "node"), ("v", "other")))
            order = np.lexsort((u, v))
            u, v, code = u[order], v[order], own["code"].to_numpy()[order].astype("<i4")
            rows = [(bu, bv, slice_, "e", part, np.concatenate([a[i : i + PIECE] for a in (u, v, code)]).tobytes()) for i in range(0, len(u), PIECE)]
            rows += [(bu, bv, slice_, e, p, None) for e, a in (("u", u), ("v", v)) for p in np.unique(a // PIECE).tolist()]
            sizes = np.array([len(ends["u"]), len(ends["v"])], "<i8").tobytes()
            return _table([*rows, (bu, bv, slice_, "n", part, sizes)], kinds)

        parts = counted.select("bu", "bv", "slices", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("bu", "bv", F.pmod("part", "slices").alias("slice"), "part")
        ids = [parts.join(self.nodes.withColumnRenamed("stripe", s), s).select(*parts.columns, F.lit(w).alias("end"), "nodes") for s, w in (("bu", "u"), ("bv", "v"))]
        return durable(_meet(edges, ids[0].unionByName(ids[1]), parts.columns, lambda key, a, b: pack(key, a, b), kinds), "packed", wide=True)

    def _shares(self, lists: DataFrame) -> DataFrame:
        """query and data: the relations' share in a weight, by the code of a list of relations. The best of a list counts."""
        n = lists.count()
        best_of = lists.select("code", F.explode("rels").alias("rel_id")).join(self.by.rel_sim.toDF("query", "rel_id", "sim"), "rel_id").groupBy("query", "code").agg(F.max("sim").alias("sim"))
        kind, beta = dict(best_of.dtypes)["query"], self.by.beta

        def dense(key: tuple, own: pa.Table) -> pa.Table:
            out = np.zeros(n)
            out[own["code"].to_numpy()] = np.maximum(0.0, beta * own["sim"].to_numpy())
            return pa.table({"query": pa.array([key[0].as_py()], own.schema.field("query").type), "data": pa.array([out.astype("<f8").tobytes()], pa.binary())})

        return best_of.groupBy("query").applyInArrow(lambda key, own: dense(key, own), f"query {kind}, data binary")

    def _dense(self, asked: DataFrame) -> DataFrame:
        """query, stripe, piece and data: the similarities of a stripe's nodes."""
        sims = self.by.node_sim.toDF("query", "node", "sim").join(asked.select("query").distinct(), "query", "left_semi").withColumn("stripe", self.stripes.of("node"))
        ids = sims.select("query", "stripe").distinct().join(self.nodes, "stripe").select("query", "stripe", "nodes")
        kind = dict(sims.dtypes)["query"]

        def dense(key: tuple, own: pa.Table, ids: pa.Table) -> pa.Table:
            made = []
            if own.num_rows and ids.num_rows:
                nodes = np.frombuffer(ids["nodes"][0].as_buffer(), "<i8")
                at = np.searchsorted(nodes, own["node"].to_numpy())
                known = (at < len(nodes)) & (nodes[np.minimum(at, len(nodes) - 1)] == own["node"].to_numpy())  # not every node has edges
                out = np.zeros(len(nodes))
                np.add.at(out, at[known], own["sim"].to_numpy()[known])
                made = list(_cut(out))
            keys = [[k.as_py()] * len(made) for k in key]
            pieces, data = [p for p, _ in made], [d for _, d in made]
            return pa.table({"query": pa.array(keys[0], own.schema.field("query").type), "stripe": pa.array(keys[1], pa.int32()), "piece": pa.array(pieces, pa.int32()), "data": pa.array(data, pa.binary())})

        return _meet(sims, ids, ["query", "stripe"], lambda key, a, b: dense(key, a, b), f"query {kind}, stripe int, piece int, data binary")

    def around(self) -> DataFrame:
        """block, stripe, piece, lane (-1), q and data: the sums of the weights around a stripe's nodes, by cell."""
        weighed = _weighed(self.by)

        def run(key: tuple, own: pa.Table) -> pa.Table:
            block, bu, bv, _ = (k.as_py() for k in key)
            cell = _Cell(own)
            sums = {q: [np.zeros(n) for n in cell.n] for q in range(lanes[block])}
            for u, v, code in cell.parts():
                for q, (at_u, at_v) in sums.items():
                    w = weighed(cell, q, u, v, code)
                    _add(at_v, v, w)
                    np.add.at(at_u, u, w if bu != bv else np.where(u == v, 0.0, w))  # a loop is one step
            return _table([(block, s, p, -1, q, data) for q, both in sums.items() for s, a in zip((bu, bv), both, strict=True) for p, data in _cut(a)], _ROW)

        lanes = {r.block: r.n for r in self.lanes.groupBy("block").agg((F.max("q") + 1).alias("n")).collect()}  # a number for LANES runs
        return self.cells.groupBy(*_CELL).applyInArrow(lambda key, own: run(key, own), _ROW)

    def times(self, x: DataFrame) -> DataFrame:
        """What reaches each stripe's nodes from the nodes of another, by cell: block, stripe, piece, lane, q and data, as in x. An x without pieces has stripes of one."""
        weighed = _weighed(self.by)

        def run(key: tuple, sent: pa.Table, own: pa.Table) -> pa.Table:
            block, bu, bv, _ = (k.as_py() for k in key)
            if not (sent.num_rows and own.num_rows):
                return _table([], _ROW)
            cell, asked = _Cell(own), {}
            for lane, q, end, piece, data in _rows(sent, "lane", "q", "end", "piece", "data"):
                both = asked.setdefault(q, {}).setdefault(lane, {})
                _put(both.setdefault(end, np.zeros(cell.n[end == "v"])), piece, _floats(data))
            out = {(lane, q, end): np.zeros(cell.n[end == "u"]) for q, ranks in asked.items() for lane, both in ranks.items() for end in both}
            for u, v, code in cell.parts():
                for q, ranks in asked.items():
                    w = weighed(cell, q, u, v, code)
                    back = w if bu != bv else np.where(u == v, 0.0, w)  # a loop is one step
                    for lane, both in ranks.items():
                        if "u" in both:
                            _add(out[lane, q, "u"], v, both["u"][u] * w)
                        if "v" in both:
                            np.add.at(out[lane, q, "v"], u, both["v"][v] * back)
            if bu == bv:  # both directions end in one stripe
                for lane, q in {k[:2] for k in out if k[2] == "v"}:
                    out[lane, q, "u"] = out[lane, q, "u"] + out.pop((lane, q, "v"))
            return _table([(block, bv if end == "u" else bu, p, lane, q, data) for (lane, q, end), a in out.items() for p, data in _cut(a)], _ROW)

        x = x if "piece" in x.columns else x.withColumn("piece", F.lit(0))
        sent = x.join(self.touched, ["stripe", "piece"]).select(*_CELL, "end", "piece", "lane", "q", "data")
        return _meet(sent, self.cells, [*_CELL], lambda key, a, b: run(key, a, b), _ROW)


def _add(to: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """Adds x at places in order."""
    low, high = int(at[0]), int(at[-1]) + 1
    to[low:high] += np.bincount(at - low, x, high - low)


class _Cell:
    """A cell's rows: sizes n of its stripes, parts of its edges, and shares."""

    def __init__(self, rows: pa.Table):
        self.edges, self.shares, ends = [], {}, []
        for what, at, piece, data in _rows(rows, "what", "at", "piece", "data"):
            if what == "e":
                self.edges.append(data)
            elif what == "n":
                self.n = tuple(np.frombuffer(data.as_buffer(), "<i8").tolist())
            elif what == "k":
                self.shares[what, at] = _floats(data)
            else:
                ends.append((what, at, piece, data))
        for what, at, piece, data in ends:
            _put(self.shares.setdefault((what, at), np.zeros(self.n[what == "v"])), piece, _floats(data))

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for data in self.edges:
            places = np.frombuffer(data.as_buffer(), "<i4")
            yield tuple(places.reshape(3, -1))


def _weighed(by: Weighting):  # noqa: ANN202
    half, least = (1.0 - by.beta) / 2.0, by.least

    def weighed(cell: _Cell, q: int, u: np.ndarray, v: np.ndarray, code: np.ndarray) -> np.ndarray:
        w = cell.shares["k", q][code] if ("k", q) in cell.shares else np.zeros(len(u))
        ends = [cell.shares[e, q][at] for e, at in (("u", u), ("v", v)) if (e, q) in cell.shares]
        for s in ends[1:]:
            ends[0] += s
        return np.maximum(least, w + half * ends[0] if ends else w)

    return weighed


def rank(seeds: DataFrame, steps: Links | DataFrame, by: Weighting, runs: DataFrame | None, damping: float, rounds: int, edges: int = EDGES, part: int = PART) -> DataFrame:
    """run, node and pi of the nodes that a run came to. runs: run, query, block and lane; None deals them by what a task may hold."""
    linked = steps if isinstance(steps, Links) else _links_of(steps)
    stripes = Stripes(linked, edges)
    grid = Grid(dealt(seeds, stripes.most) if runs is None else runs, linked, by, edges, part, stripes)
    known = durable(stripes.ids.join(seeds.select("node").distinct(), "node", "left_semi"), "known")
    placed = durable(seeds.join(known, "node", "left_semi").join(grid.lanes, ["run", "query"]).select("block", stripes.of("node").alias("stripe"), "lane", "q", "node", "reset"), "placed")
    lonely = seeds.join(known, "node", "left_anti").groupBy("run", "node").agg(F.sum("reset").alias("pi"))

    def places(key: tuple, own: pa.Table, ids: pa.Table) -> pa.Table:
        rows = []
        if own.num_rows:
            nodes = np.frombuffer(ids["nodes"][0].as_buffer(), "<i8")
            at = np.searchsorted(nodes, own["node"].to_numpy())
            by_lane = {}
            for block, lane, q, i, reset in zip(*(own[c].to_pylist() for c in ("block", "lane", "q")), at.tolist(), own["reset"].to_numpy(), strict=True):
                by_lane.setdefault((block, i // PIECE, lane, q), []).append((i % PIECE, reset))
            rows = [(block, key[0].as_py(), piece, lane, q, np.array(x, "<f8").tobytes()) for (block, piece, lane, q), x in by_lane.items()]
        return _table(rows, _ROW)

    resets = _meet(placed, grid.nodes, ["stripe"], lambda key, a, b: places(key, a, b), _ROW)

    def total(key: tuple, own: pa.Table) -> pa.Table:
        sums = {}
        for q, data in _rows(own, "q", "data"):
            sums[q] = sums[q] + _floats(data) if q in sums else _floats(data)
        return _table([(*(k.as_py() for k in key), -1, q, a.tobytes()) for q, a in sums.items()], _ROW)

    keys = ["block", "stripe", "piece"]
    about = grid.around().groupBy(*keys).applyInArrow(lambda key, own: total(key, own), _ROW)
    about = bucketed(about.unionByName(resets), "about", *keys, wide=True)

    def after(arrived: pa.Table, own: pa.Table, go: float, stay: float) -> tuple[dict, dict]:
        """Ranks of a piece by lane and question, a share of the reset and of what arrives, and the weights around its nodes."""
        sums, ranks, resets = {}, {}, []
        for lane, q, data in _rows(own, "lane", "q", "data"):
            if lane < 0:
                sums[q] = _floats(data)
            else:
                resets.append((lane, q, _floats(data).reshape(-1, 2)))
        for lane, q, data in _rows(arrived, "lane", "q", "data"):
            if lane >= 0:
                here = ranks.setdefault((lane, q), np.zeros(len(sums[q])))
                here += _floats(data)
        for a in ranks.values():
            a *= go
        for lane, q, seeds in resets:
            np.add.at(ranks.setdefault((lane, q), np.zeros(len(sums[q]))), seeds[:, 0].astype(int), stay * seeds[:, 1])
        return ranks, sums

    def step(arrived: DataFrame, go: float, stay: float) -> DataFrame:
        """Ranks by the weights around a node, for the round that follows."""

        def run(key: tuple, arrived: pa.Table, own: pa.Table) -> pa.Table:
            ranks, sums = after(arrived, own, go, stay)
            return _table([(*(k.as_py() for k in key), lane, q, (a / sums[q]).tobytes()) for (lane, q), a in ranks.items()], _ROW)

        return durable(_meet(arrived, about, keys, lambda key, a, b: run(key, a, b), _ROW), "ranks", wide=True)

    state = step(about.where("false"), 0.0, 1.0)
    for _ in range(1, rounds):
        state = step(grid.times(state), damping, 1.0 - damping)
    kinds = "block string, lane int, node long, pi double"

    def named(key: tuple, arrived: pa.Table, own: pa.Table) -> pa.Table:
        ranks, _ = after(arrived, own, damping, 1.0 - damping)
        nodes = [np.frombuffer(data.as_buffer(), "<i8") for lane, data in _rows(arrived, "lane", "data") if lane < 0]
        tables = [_table([], kinds)]
        for (lane, _), pi in ranks.items():
            some = np.flatnonzero(pi > 0)
            zeros = pa.array(np.zeros(len(some), "<i4"))
            tables.append(pa.table([pa.array([key[0].as_py()], pa.string()).take(zeros), pa.array([lane], pa.int32()).take(zeros), pa.array(nodes[0][some]), pa.array(pi[some])], schema=_schema(kinds)))
        return pa.concat_tables(tables)

    ids = stripes.pieces().crossJoin(grid.lanes.select("block").distinct()).select(*keys, F.lit(-1).alias("lane"), F.lit(0).alias("q"), "data")
    reached = _meet(grid.times(state).unionByName(ids), about, keys, lambda key, a, b: named(key, a, b), kinds)
    reached = reached.join(F.broadcast(grid.lanes.select("run", "block", "lane")), ["block", "lane"]).select("run", "node", "pi")
    return durable(reached.unionByName(lonely), "ranks")
