"""Every draw of the hash tree, made again outside of Spark."""

import math
import struct
from collections import defaultdict

import pytest
import xxhash

from pathloom.llm import sharding


def drawn(key: int, name: str, weight: float) -> float:
    h = xxhash.xxh64_intdigest(name.encode(), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42))
    return -math.log(((h >> 12) + 0.5) / 2**52) / weight


def placed(key: int, topology: sharding.Topology) -> int:
    """The shard of a key by descending the tree: the child with the smallest draw, the first of equals."""
    node, path = topology.tree(), []
    for level in range(3):
        if level < 2:
            names = [f"region.{i}" if level == 0 else f"region.{path[0]}/rack.{i}" for i in range(len(node))]
        else:
            names = [f"shard.{s}" for s in node]
        open_ = [(drawn(key, n, topology.weight(c)), i) for i, (n, c) in enumerate(zip(names, node, strict=True)) if topology.weight(c) > 0]
        path.append(min(open_)[1])
        node = node[path[-1]]
    return node


@pytest.mark.parametrize("topology", [sharding.Topology(), sharding.Topology(3, 2, 2, extra=2, weights={0: 0.0, 5: 3.0, 13: 0.5})])
def test_shards_equal_draws_made_again(spark, topology):
    rows = [(i * 977 - 5000, f"text {i}") for i in range(400)] + [(7, "t" * 200_000), (7, None)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), topology).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard) == (placed(r.doc_id, topology), placed(r.doc_id, topology.grown()))
        assert r.grown_shard in (r.shard, topology.count)  # growth moves rows into the new shard alone
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
