"""A trie of conversation prefixes by partition refinement.

Every conversation is rebuilt first: it takes the first h turns of its base (the first conversation of
its block of five) and goes on with its own turns after its first h; h is drawn from its id.

Conversations with equal sequences of turns are one class member with a weight, found by sums over
(position, turn) that need no order. Then one class holds all members, and round after round the classes
that still hold two or more are split by their members' next turn. A class of one member retires: the rest
of its turns is a chain of nodes with one child each, made for all retired classes at once. Last, the
levels are folded back from the deepest one: what a node's subtree holds is added to its parent.

A turn is a 256-bit digest of role and text, so texts are read once and never shuffled. Turns are
numbered within (conversation, range of the sorted turns), so that a conversation of any length is
dealt out; counts and minima are taken before and after each shuffle, so that a first turn
which a third of all conversations share is one row a task. Ids that end at one node are hashed as they stream by,
joined beforehand into pieces of about a MB, so a group of any number of copies holds one piece in memory. Rounds
are as many as the longest prefix that two different conversations share; each leaves a table in the shared folder.

Rows without conv_id belong to no conversation. Null turns come first; turns of one number are in the order of their
digests, repeated rows are turns of their own. Null or empty roles and texts are empty; texts of any length are one digest.
A remainder has the sign of its dividend. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, compact, materialise, utf8_bytes

#: Conversations of a block, whose first is the others' base; a conversation takes fewer turns of it than this.
BLOCK, TAKEN = 5, 9
#: Bytes of joined ids that are hashed at once.
PIECE = 1 << 20
NONE = hashlib.sha256(b"").hexdigest()
#: Sums that tell sequences apart, 64 bits each.
LANES = 3
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_key(role: Column, text: Column) -> Column:
    """256 bits of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), key and bytes (of the text) of every turn."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = df.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_key(r, t).alias("key"), utf8_bytes(t).alias("bytes"))
    dealt = materialise(rows, "turns", scanned=True).repartitionByRange("conv_id", F.asc_nulls_first("turn"), "key")
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()), "dealt", scanned=True)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("conv_id", "part").count().select("conv_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "key"))
    return dealt.withColumn("place", place).join(starts, ["conv_id", "part"]).select("conv_id", (F.col("start") + F.col("place")).alias("pos"), "key", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id and length of every rebuilt conversation, those without a turn too; conv_id, pos, key and bytes of their turns."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    own = lengths.select("*", (F.crc32(F.col("conv_id").cast("string")) % TAKEN).alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    bases = lengths.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least(F.coalesce("base_n", F.lit(0)), "h")
    convs = materialise(own.join(bases, "base", "left").select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    taken = turns.where((F.col("pos") < TAKEN) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("pos <= h")
    rest = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    return convs.select("conv_id", "length"), taken.select("conv_id", "pos", "key", "bytes").unionByName(rest.select("conv_id", "pos", "key", "bytes"))


def classes_of_equals(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rep (the smallest conv_id), length and k of each class of equal sequences; rep and conv_id of the members of those with two or more."""
    lanes = [f"x{i}" for i in range(LANES)]
    sums = turns.groupBy("conv_id").agg(*(F.bit_xor(F.xxhash64(F.lit(i), "pos", "key")).alias(x) for i, x in enumerate(lanes)))
    told = materialise(convs.join(sums, "conv_id", "left").fillna(0, lanes), "sequences")
    same = ["length", *lanes]
    groups = materialise(told.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count("*").alias("k")), "classes")
    return groups.select("rep", "length", "k"), told.join(groups.where("k > 1"), same).select("rep", "conv_id")


def ids_sha256(members: DataFrame) -> DataFrame:
    """rep and sha256 of the comma-joined, ascending ids of its members(rep, conv_id)."""
    bounded_batches(members)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, first, held, size = None, None, [], 0
        for batch in batches:
            done = []
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (r != rep or size >= PIECE):
                    done.append((rep, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    rep, first = r, c
                held.append(str(c))
                size += len(held[-1]) + 1
            if done:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()))), ["rep", "first", "ids"])
        if held:
            yield pa.RecordBatch.from_pydict({"rep": [rep], "first": [first], "ids": [",".join(held)]})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for batch in batches:
            done = []
            for r, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is not None and r == rep:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done, strict=True), (pa.int64(), pa.string()))), ["rep", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_pydict({"rep": [rep], "sha256": [state.hexdigest()]})

    joined = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(pieces, "rep long, first long, ids string")
    return joined.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(digests, "rep long, sha256 string")


def refine(reps: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """By depth: the nodes (conv_id, parent_conv_id, m members of different sequences, n_convs, bytes, length of a lone member), and the members (rep, cls, k, length) of those with m > 1."""
    root = materialise(reps.agg(F.min("rep").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.count("*").alias("m"), F.sum("k").alias("n_convs"), F.lit(0).cast("long").alias("bytes"), F.max("length").alias("length")).where("m > 0"), "root")
    split = root.where("m > 1").select(F.col("conv_id").alias("cls"))
    levels, active = [root], [materialise(reps.crossJoin(split).select("rep", "cls", "k", "length"), "active")]  # the root is one row
    while not active[-1].isEmpty():
        step = active[-1].join(turns.where(F.col("pos") == len(levels)), "rep").select("rep", "cls", "k", "length", "key", "bytes")
        level = materialise(step.groupBy("cls", "key").agg(F.min("rep").alias("conv_id"), F.count("*").alias("m"), F.sum("k").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("length").alias("length")), "level")
        large = level.where("m > 1").select("cls", "key", F.col("conv_id").alias("next"))
        active.append(materialise(step.join(large, ["cls", "key"]).select("rep", F.col("next").alias("cls"), "k", "length"), "active"))
        levels.append(level.select("conv_id", F.col("cls").alias("parent_conv_id"), "m", "n_convs", "bytes", "length"))
    return levels, active


def tails(levels: list[DataFrame], turns: DataFrame) -> DataFrame:
    """Nodes of the classes that retired, from the depth at which they had one member (`top`) to their last turn, with the member's length and top."""
    alone = [level.where("m = 1").select(F.col("conv_id").alias("rep"), "parent_conv_id", F.col("n_convs").alias("k"), "length", F.lit(d).cast("long").alias("top")) for d, level in enumerate(levels)]
    retired = alone[0]
    for more in alone[1:]:
        retired = retired.unionByName(more)
    retired = materialise(retired, "retired")
    # the root has no turn of its own
    at = turns.select("rep", "pos", "bytes").unionByName(retired.where("top = 0").select("rep", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("bytes")))
    chain = at.join(retired, "rep").where("pos >= top")
    below = F.sum((F.col("k") - 1) * F.col("bytes")).over(Window.partitionBy("rep").orderBy(F.desc("pos")))
    saved = chain.where("k > 1").withColumn("saved", below).unionByName(chain.where("k = 1").withColumn("saved", F.lit(0).cast("long")))
    parent = F.when(F.col("pos") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("rep"))
    node = saved.select(F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), parent.alias("parent_conv_id"), F.col("k").alias("n_convs"), (F.col("pos") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "length", "top")
    return materialise(node, "tails")


def fold(levels: list[DataFrame], chains: DataFrame) -> list[DataFrame]:
    """Nodes of the classes that were split, by depth, each with the sums of its subtree."""
    tops = chains.where("depth = top")
    out: list[DataFrame] = []
    below = None
    for d in reversed(range(len(levels))):
        children = tops.where(F.col("depth") == d + 1).select("parent_conv_id", "n_leaves", "saved_tokens")
        if below is not None:
            children = children.unionByName(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        node = levels[d].where("m > 1").drop("length").join(sums, "conv_id")  # two sequences at least: one of them goes on
        below = materialise(node.select("conv_id", F.lit(d).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes") + F.col("saved")).alias("saved_tokens")), "folded")
        out.append(below)
    return out[::-1]


@compact
def trie(df: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    convs, turns = rebuilt(materialise(numbered(df), "numbered"))
    turns = materialise(turns, "rebuilt")
    reps, members = classes_of_equals(convs, turns)
    turns = materialise(turns.withColumnRenamed("conv_id", "rep").join(reps.select("rep"), "rep").select("rep", "pos", "key", "bytes"), "different")
    levels, active = refine(reps, turns)
    chains = tails(levels, turns)
    inner = fold(levels, chains)
    hashes = materialise(ids_sha256(members), "hashes")

    def with_ends(nodes: DataFrame, rep: str, k: str) -> DataFrame:
        """`rep`: the class of the conversations that end at a node, k of them; null where none does."""
        own = F.when(F.col(rep).isNull(), F.lit(NONE)).when(F.col(k) == 1, F.sha2(F.col(rep).cast("string").cast("binary"), 256)).otherwise(F.col("_sha256"))
        return nodes.join(hashes.toDF("_rep", "_sha256"), F.col(rep) == F.col("_rep"), "left").select(*NODE, own.alias("ends_sha256"))

    last = chains.where("depth = length")
    out = chains.where("depth < length").select(*NODE, F.lit(NONE).alias("ends_sha256")).unionByName(with_ends(last.withColumn("_ending", F.col("conv_id")), "_ending", "n_convs"))
    for d, (nodes, at) in enumerate(zip(inner, active, strict=True)):
        ending = at.where(F.col("length") == d).select(F.col("cls").alias("conv_id"), F.col("rep").alias("_ending"), F.col("k").alias("_k"))
        out = out.unionByName(with_ends(nodes.join(ending, "conv_id", "left"), "_ending", "_k"))
    return out
