"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws
-ln(u) / weight with u hashed from the key and the child's name, and the smallest draw
wins, so that a child wins in proportion to its weight, which is the sum of the shards
below it. A change of weight changes only the draws of the subtrees on its path: rows
move only into or out of those, and between two others never. Growth adds a shard in a
region of its own, so that rows move into the new shard and nowhere else.

The law that holds is `key`: doc_id and the topology alone decide.

Everything is DataFrame functions. Texts are read once and never shuffled: the digest
columns are written to the shared folder with the number of the input partition, and
slots are counted within (shard, input partition), so that no key, however common,
gathers in one task.

A null doc_id hashes as a key of its own; null text has size 16 and crc32 0; a text of any length is read
once for its size and crc32; of equal draws the first child wins; repeated rows share a shard and get slots of their own, in the order of doc_id, size and crc32;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, utf8_bytes

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Topology:
    """regions x racks x shards, in this order, then `extra` shards that growth added, each in a region of its own.

    weights: of shards that don't weigh 1.
    """

    regions: int = 4
    racks: int = 2
    shards: int = 5
    extra: int = 0
    weights: dict[int, float] = field(default_factory=dict)

    @property
    def count(self) -> int:
        return self.regions * self.racks * self.shards + self.extra

    def grown(self) -> Topology:
        return replace(self, extra=self.extra + 1)

    def tree(self) -> list[list[list[int]]]:
        n = iter(range(self.count))
        own = [[[next(n) for _ in range(self.shards)] for _ in range(self.racks)] for _ in range(self.regions)]
        return own + [[[next(n)]] for _ in range(self.extra)]

    def weight(self, node: list | int) -> float:
        return sum(map(self.weight, node)) if isinstance(node, list) else self.weights.get(node, 1.0)


def draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of rate `weight`, hashed from key and name: the top 52 bits of the hash make u in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def winner(key: Column, names: list[str], weights: list[float]) -> Column:
    """Position of the child with the smallest draw; ties go to the first. A child of no weight never wins."""
    drawn = [(i, w) for i, w in enumerate(weights) if w > 0]
    if len(drawn) == 1:
        return F.lit(drawn[0][0])
    draws = F.array(*[draw(key, names[i], w) for i, w in drawn])
    return F.element_at(F.array(*[F.lit(i) for i, _ in drawn]), F.array_position(draws, F.array_min(draws)).cast("int"))


def shard_of(df: DataFrame, key: str, topology: Topology, out: str) -> DataFrame:
    """df with the column `out`: the shard of each key. One projection for each level, so that a level is drawn once."""
    tree, k = topology.tree(), F.col(key)
    names = lambda prefix, nodes: [f"{prefix}.{i}" for i in range(len(nodes))]
    df = df.withColumn("_region", winner(k, names("region", tree), [topology.weight(r) for r in tree]))

    def choose(column: Column, cases: list[Column]) -> Column:
        chosen = cases[-1]
        for i in range(len(cases) - 2, -1, -1):
            chosen = F.when(column == i, cases[i]).otherwise(chosen)
        return chosen

    rack = choose(F.col("_region"), [winner(k, names(f"region.{i}/rack", r), [topology.weight(x) for x in r]) for i, r in enumerate(tree)])
    df = df.withColumn("_rack", rack)
    leaves = [choose(F.col("_rack"), [F.element_at(F.array(*map(F.lit, x)), winner(k, [f"shard.{s}" for s in x], [topology.weight(s) for s in x]) + 1) for x in r]) for r in tree]
    return df.withColumn(out, choose(F.col("_region"), leaves)).drop("_region", "_rack")


def shard(df: DataFrame, topology: Topology | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard with one shard more) of every row."""
    topology = topology or Topology()
    rows = df.select(F.col(key).alias("doc_id"), (utf8_bytes(F.col(text)) + ROW_BYTES).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
    rows = shard_of(shard_of(rows, "doc_id", topology, "shard"), "doc_id", topology.grown(), "grown_shard")
    rows = materialise(rows, "shards", scanned=True)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(within))
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place") - 1).alias("slot"), "grown_shard")
    )
