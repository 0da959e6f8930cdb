"""Exact top-k search by inner product with a KD-tree for each shard.

Space is cut into cells by median splits of a bounded sample; every row falls into one cell, and a cell of many rows
(or of one vector many times) is dealt over several shards of bounded size by hash. Each shard builds a KD-tree
(median splits along the widest dimension, tight bounding boxes), and a query goes through a tree best first: the bound
of a box is the largest inner product that any point of it can have, and boxes whose bound is below the query's kth score
so far are left out. The kth score is propagated: a query first searches its own shard, and with the score found
there it goes on only to the cells whose tight box (over all of their rows) has a bound that reaches it.

Queries meet shards in blocks of bounded size, of neighbouring cells; a task holds one shard and one block, and only
the shards and blocks that have something to search are brought together.

Vectors that are null or empty, hold null or non-finite components, or have another length
than the commonest one, take no part. Equal scores go to the smaller
vec_id. A vec_id that repeats is one query, by the smallest of its vectors, and its rows are candidates of their own for
every other query. Rows of a null vec_id take no part. Components stop at the
64-bit range, and so do scores. Empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

#: Rows of a shard, queries of a block, rows of a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 8192, 4096, 128
#: Vectors from which the splits of space are taken (twice as many at most, as a hash draws them), and cells, at most: both are held by the driver.
SAMPLE_ROWS, CELLS = 16_384, 1024
#: Scores beyond this are given as this.
LARGEST = 2**63 - 1


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double; null for a vector that takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)), whole)


class Splits:
    """Median splits of a sample along its widest dimensions, until there are `cells` cells or nothing is left to split; cells count from left to right."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, int, int, int] | int] = []  # (dimension, cut, left, right), or a cell
        self.cells = 0
        self._grow(sample, cells)

    def _grow(self, sample: np.ndarray, cells: int) -> int:
        node = len(self.nodes)
        self.nodes.append(-1)
        widths = [high - low for low, high in zip(sample.min(0).tolist(), sample.max(0).tolist(), strict=True)] if cells > 1 and len(sample) else [0]
        if not max(widths):
            self.nodes[node] = self.cells
            self.cells += 1
            return node
        wide = widths.index(max(widths))
        column = sample[:, wide]
        above = column[column > column.min()]
        cut = max(int(np.partition(column, len(column) // 2)[len(column) // 2]), int(above.min()))
        left = self._grow(sample[column < cut], cells // 2)
        self.nodes[node] = (wide, cut, left, self._grow(sample[column >= cut], cells - cells // 2))
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, stack = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            split = self.nodes[node]
            if isinstance(split, int):
                out[rows] = split
                continue
            wide, cut, left, right = split
            below = points[rows, wide] < cut
            stack += [(left, rows[below]), (right, rows[~below])]
        return out


def box_bounds(queries: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Largest inner product of each query with any point of each box."""
    return np.maximum(queries, 0) @ highs.T + np.minimum(queries, 0) @ lows.T


class KDTree:
    """Points as integers, in leaves of consecutive rows; nodes as boxes."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        lows, highs, children, spans = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            own = points[order[start:end]]
            low, high = own.min(0), own.max(0)
            node = len(lows)
            lows.append(low)
            highs.append(high)
            children.append([-1, -1])
            spans.append((start, end))
            if parent >= 0:
                children[parent][side] = node
            wide = int(np.argmax(high - low))
            if end - start > leaf and high[wide] > low[wide]:
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own[:, wide], middle)]
                stack += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
        self.points, self.ids = points[order], ids[order]
        self.lows, self.highs = np.array(lows), np.array(highs)
        self.children, self.spans = children, spans
        self.keep = np.ones(len(ids), bool)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each box."""
        return box_bounds(queries, self.lows, self.highs)

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, kth: float) -> list[tuple[int, int]]:
        """(score, id) of the k best points but those of id `own`, among those that score `kth` at least."""
        best: list[tuple[float, int]] = []  # smallest first: (score, -id)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            start, end = self.spans[node]
            scores, ids = self.points[start:end] @ query, self.ids[start:end]
            keep = (scores >= kth) & (ids != own)
            if not keep.any():
                continue
            scores, ids = scores[keep], ids[keep]
            if len(ids) > k:
                first = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[first], ids[first]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(int(s), -i) for s, i in best]


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _search_block(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """All of one shard against one block of queries."""
    out: list[tuple[int, int, int]] = []
    if candidates.num_rows and queries.num_rows:
        dimension = len(queries.column("vector")[0])
        points, asked = (_matrix(t.column("vector").combine_chunks(), dimension) for t in (candidates, queries))
        kths = [-math.inf if kth is None else kth for kth in queries.column("kth").to_pylist()]
        largest = [max(1.0, float(np.abs(x.astype(np.float64)).max())) for x in (points, asked)]
        most = largest[0] * largest[1] * dimension
        if most >= 2**62:  # beyond 64 bits: exact, without a tree
            return _found(_exactly(points.tolist(), candidates.column("vec_id").to_pylist(), asked.tolist(), queries.column("vec_id").to_pylist(), k))
        if most < 2**53:  # products are exact in float64, and much faster there
            points, asked = points.astype(np.float64), asked.astype(np.float64)
        tree = KDTree(points, candidates.column("vec_id").to_numpy())
        for start in range(0, len(asked), 512):
            bounds = tree.bounds(asked[start : start + 512])
            for i, (query, kth) in enumerate(zip(queries.column("vec_id").to_pylist()[start : start + 512], kths[start : start + 512], strict=True)):
                out += [(query, i2, s) for s, i2 in tree.search(asked[start + i], bounds[i], query, k, kth)]
    return _found(out)


def _found(rows: list[tuple[int, int, int]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _exactly(points: list[list[int]], ids: list[int], asked: list[list[int]], own: list[int], k: int) -> list[tuple[int, int, int]]:
    """As the tree's search, in integers of any size."""
    out = []
    for query, q in zip(own, asked, strict=True):
        scored = heapq.nsmallest(k, ((-sum(map(operator.mul, p, q)), i) for p, i in zip(points, ids, strict=True) if i != query))
        out += [(query, i, max(-LARGEST, min(LARGEST, -s))) for s, i in scored]
    return out


def search(vectors: DataFrame, query_filter: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row that query_filter selects, among all rows but those of its own vec_id."""
    bounded_batches(vectors)
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding)).alias("vector"), F.coalesce(query_filter, F.lit(False)).alias("asks")).where("vector is not null")
    # a dimension that differs cannot be multiplied: the commonest one takes part (the larger, if two are as common)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d"), F.sum("count").alias("n")).first()
    n, dimension = sizes["n"] or 0, sizes["d"] or 0
    wanted = min(CELLS, max(1, math.ceil(n / shard_rows)))
    rows = rows.where(F.size("vector") == dimension)
    placed = materialise(_in_cells(rows, _splits(rows, n, wanted, dimension), dimension), "vectors", scanned=True)
    boxes = _boxes(placed)
    plan = _plan(placed, shard_rows, block_queries)
    cells = placed.sparkSession.createDataFrame(plan, "cell int, first_shard int, parts int, first_block int, subs int").hint("broadcast")  # CELLS rows at most
    rows = placed.join(cells, "cell").select("vec_id", "vector", "asks", "cell", (F.col("first_shard") + F.pmod("salt", F.col("parts"))).cast("int").alias("shard"))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("vector", "shard", "cell")).alias("q"))
    asked = asked.select("vec_id", "q.vector", F.col("q.shard").alias("home"), F.col("q.cell").alias("cell")).join(cells, "cell")
    block = F.col("first_block") + F.pmod(F.xxhash64("vec_id"), F.col("subs"))
    asked = materialise(asked.select("vec_id", "vector", "home", block.cast("int").alias("block")), "queries")
    schema = "query_id long, vec_id long, score long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search_block(left, right, k)

    def meet(points: DataFrame, queries: DataFrame) -> DataFrame:
        # columns of their own on either side, which may come from one table
        left, right = points.select("vec_id", "vector", "shard", "block"), queries.select("vec_id", "vector", "kth", "shard", "block")
        return left.toDF(*left.columns).groupBy("shard", "block").cogroup(right.toDF(*right.columns).groupBy("shard", "block")).applyInArrow(run, schema)

    at_home = asked.select("vec_id", "vector", F.lit(None).cast("long").alias("kth"), F.col("home").alias("shard"), F.lit(0).alias("block"))
    found = materialise(meet(rows.withColumn("block", F.lit(0)), at_home), "home")
    if sum(c[2] for c in plan) > 1:
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        bounded = asked.join(kth, asked.vec_id == kth.query_id, "left").select("vec_id", "vector", "kth", "home", "block")
        reached = _reached(bounded, boxes).join(cells.select("cell", "first_shard", "parts"), "cell")
        sent = reached.withColumn("shard", F.explode(F.expr("sequence(first_shard, first_shard + parts - 1)"))).where("shard != home")
        sent = materialise(sent.select("vec_id", "kth", "shard", "block"), "sent")
        elsewhere = sent.join(asked.select("vec_id", "vector"), "vec_id")
        found = found.unionByName(meet(rows.join(sent.select("shard", "block").distinct(), "shard"), elsewhere))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _splits(rows: DataFrame, n: int, cells: int, dimension: int) -> Splits:
    """Splits by a sample of about 32 rows a cell or SAMPLE_ROWS, whichever is less, chosen by hash; never more than twice as many."""
    most = min(SAMPLE_ROWS, 32 * cells)
    if cells == 1:
        return Splits(np.zeros((0, dimension), np.int64), 1)
    share = min(1.0, most / n)
    chosen = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = chosen.select("vector").limit(2 * most).toArrow()
    return Splits(_matrix(sample.column("vector").combine_chunks(), dimension), cells)


def _in_cells(rows: DataFrame, splits: Splits, dimension: int) -> DataFrame:
    """rows with their cell and a salt that parts equal rows."""
    salted = rows.withColumn("salt", F.xxhash64("vec_id", "vector", F.monotonically_increasing_id()))
    if splits.cells == 1:
        return salted.withColumn("cell", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(splits.of(_matrix(batch.column("vector"), dimension)), pa.int32()))

    return salted.mapInArrow(run, "vec_id long, vector array<long>, asks boolean, salt long, cell int")


def _boxes(placed: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The cells that have rows, and the least and the largest component of all of their rows in each dimension."""
    ends = placed.select("cell", F.posexplode("vector").alias("pos", "x")).groupBy("cell", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    found = ends.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("e")).select("cell", "e.low", "e.high").collect()  # CELLS rows at most
    return [r["cell"] for r in found], np.array([r["low"] for r in found], np.int64), np.array([r["high"] for r in found], np.int64)


def _plan(placed: DataFrame, shard_rows: int, block_queries: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first shard, shards, first block, blocks) of each cell. Neighbouring cells share a block while their queries fit in it."""
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).orderBy("cell").collect()  # CELLS rows at most
    plan, shards, block, held = [], 0, 0, 0
    for r in counts:
        parts, subs = math.ceil(r["n"] / shard_rows), max(1, math.ceil(r["asks"] / block_queries))
        if held and held + r["asks"] > block_queries:
            block, held = block + 1, 0
        plan.append((r["cell"], shards, parts, block, subs))
        shards, block, held = shards + parts, block + subs - 1, held + r["asks"] if subs == 1 else block_queries
    return plan


def _reached(queries: DataFrame, boxes: tuple[list[int], np.ndarray, np.ndarray]) -> DataFrame:
    """vec_id, kth, home, block and each cell whose bound reaches the query's kth score; all of them for a query without one."""
    cells, lows, highs = boxes
    most = max((max(abs(int(x.min())), abs(int(x.max()))) for x in (lows, highs) if x.size), default=0) ** 2 * (lows.shape[1] if lows.ndim == 2 else 0)
    schema = "vec_id long, kth long, home int, block int, cells array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, asked = batch.drop_columns(["vector"]), _matrix(batch.column("vector"), lows.shape[1])
            kths = batch.column("kth").to_pylist()
            for start in range(0, len(asked), 512):
                own = asked[start : start + 512]
                if most >= 2**62:  # bounds would not fit in 64 bits: no cell is left out
                    reach = np.ones((len(own), len(cells)), bool)
                else:
                    exact = np.float64 if most < 2**53 else np.int64
                    reach = box_bounds(own.astype(exact), lows.astype(exact), highs.astype(exact)) >= np.array([-(2**63) if x is None else x for x in kths[start : start + 512]], exact)[:, None]
                lists = pa.array([[cells[c] for c in np.flatnonzero(r)] for r in reach], pa.list_(pa.int32()))
                yield rows.slice(start, 512).append_column("cells", lists)

    return queries.select("vec_id", "vector", "kth", "home", "block").mapInArrow(run, schema).withColumn("cell", F.explode("cells")).drop("cells")
