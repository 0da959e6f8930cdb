"""Near-duplicates by fast similarity sketches, banding and exact verification.

A document is its set of distinct word shingles, each shingle 64 bits mixed from its
words. Documents of equal sets form a class first; everything after works on classes.

The sketch has T coordinates. In round i < T each shingle is hashed to one coordinate
and to a value in [i, i+1); in round T + j every shingle is placed in coordinate j. A
coordinate keeps its smallest value and the rounds stop when all are filled, which the
last T rounds guarantee; the share of equal coordinates estimates the similarity, with
the concentration of T independent draws. Bands of ROWS coordinates are the buckets.

Links are confirmed on full sets. A bucket is not expanded into pairs: its members are
first compared with its smallest member; while a bucket still spans several components of
confirmed links, these are joined by their most alike members. Only where a bucket still spans several components are pairs across them sought,
by the sketches and by bitmaps that bound the intersection, and confirmed. A bucket with too many members for a task is dealt
as blocks: the members outside its largest component, a block at a time, meet all members, a block at a time. Links
between members of one component would change nothing and are not looked for.

Null, empty and wordless texts have no shingles and are linked with nothing (their
component is their own doc_id). Texts of any length are read whole. Fewer words than a shingle are one shingle. Repeated
rows fall into one class; null ids count as larger than any; an empty table gives an
empty table; other columns are not read. With 32 bands of 4 rows a pair at the
threshold 0.8 escapes all buckets with a probability of 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, compact, materialise, raw, slices, text_key
from .graph import components

T, ROWS = 128, 4
BANDS = T // ROWS
#: Bits of the map that bounds the intersection of two sets.
BITS = 2048
#: Equal coordinates (of T) below which a pair at 0.8 lies with a probability of 3e-7: five deviations.
ALIKE = 80
#: Members of a bucket that one task compares (about; larger buckets are dealt as blocks of half as many); members that one task compares with a smallest member.
BUCKET, STAR = 2000, 2000
#: Pairs that a task compares at once.
PAIRS = 16_384
#: What a member is in a task: compared with others, compared to, outside its bucket's largest component.
FIRST, SECOND, MINOR = 1, 2, 4
#: Times that a bucket's components are joined by their most alike members before all pairs across them are sought.
ROUNDS = 4
#: A-Z to lower case, nothing else.
LOWER = bytes(b | 0x20 if 65 <= b <= 90 else b for b in range(256))

_a, _b, _c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_s30, _s27, _s31, _s57, _s56, _s7, _s8 = (np.uint64(x) for x in (30, 27, 31, 57, 56, 7, 8))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _s30)) * _b
    x = (x ^ (x >> _s27)) * _c
    return x ^ (x >> _s31)


class WordHashes(dict):
    """64 bits of each word, remembered for half a million words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_hashes = WordHashes()


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The set of shingles, ascending."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > 500_000:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _a + h[i : len(words) - n + 1 + i])
    return np.unique(out)


_seeds = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * _a)
#: Hashes that are drawn at once: of a small set those of several rounds.
DRAWN = 1024


def sketch(elements: np.ndarray) -> np.ndarray:
    """T coordinates; the round is in a value's top byte, so that earlier rounds always win, in whatever order they are drawn."""
    none = np.iinfo(np.uint64).max
    out = np.full(T, none, np.uint64)
    at_once = max(1, DRAWN // len(elements))
    for i in range(0, T, at_once):
        rounds = np.arange(i, min(T, i + at_once), dtype=np.uint64)[:, None]
        h = mix(elements ^ _seeds[i : i + len(rounds), None])
        # the coordinate is in the top 7 bits, the value in those below
        np.minimum.at(out, (h >> _s57).astype(np.intp), (h << _s7 >> _s8) | rounds << _s56)
        if out.max() < none:
            return out
    for j in np.flatnonzero(out == none).tolist():
        out[j] = (mix(elements ^ _seeds[T + j]).min() >> _s8) | np.uint64(T + j << 56)
    return out


_powers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_band_seeds = mix(np.arange(101, 101 + BANDS, dtype=np.uint64) * _b)


def bands(coordinates: np.ndarray) -> np.ndarray:
    return mix((mix(coordinates).reshape(BANDS, ROWS) * _powers).sum(1, dtype=np.uint64) ^ _band_seeds).astype(np.int64)


def key_of(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def bitmap(elements: np.ndarray) -> bytes:
    """BITS bits, one set for each shingle's name: a bit that only one of two sets has stands for an element that only it has."""
    bits = np.zeros(BITS, np.uint8)
    bits[(elements % np.uint64(BITS)).astype(np.intp)] = 1
    return np.packbits(bits).tobytes()


def may_link(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can be linked: a bound on the intersection, so no link is lost. x, y: rows of 64-bit words."""
    shared = np.minimum(n_x - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), n_y - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))
    return 100 * shared >= percent * (n_x + n_y - shared)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketches(documents: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    source = documents.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets = [shingles(t, size) for t in raw(batch.column("t"))]
            drawn = [sketch(s) if len(s) else None for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([key_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([None if d is None else bands(d) for d in drawn], pa.list_(pa.int64())), pa.array([None if d is None else d.astype(np.uint8).tobytes() for d in drawn], pa.binary()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], ["doc_id", "text_key", "n", "key", "bands", "small", "bits"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, text_key binary, n long, key binary, bands array<long>, small binary, bits binary")


def sets_of(documents: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """c and elements (the set, 8 bytes each) of the classes in wanted(c, rep, key)."""
    source = documents.select(F.col(doc_id).alias("rep"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    joined = source.join(wanted.withColumnRenamed("rep", "r"), F.expr("rep <=> r")).select("c", "key", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets = [shingles(t, size) for t in raw(batch.column("t"))]
            # a doc_id may stand for several texts: the one of the class is meant
            ok = [bool(len(s)) and key_of(s) == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, o in zip(batch.column("c").to_pylist(), ok, strict=True) if o], pa.int64()), pa.array([s.tobytes() for s, o in zip(sets, ok, strict=True) if o], pa.binary())], ["c", "elements"])

    return materialise(joined.mapInArrow(run, "c long, elements binary").dropDuplicates(["c"]), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked. Each a's set meets its b's as a stream; an a with many b's is dealt over several tasks."""
    many = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / STAR).cast("int").alias("tasks"))
    dealt = pairs.join(many, "a").withColumn("task", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int"))
    firsts = many.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).join(sets, many.a == sets.c).select("a", "task", F.lit(None).cast("long").alias("b"), "elements")
    others = dealt.join(sets, dealt.b == sets.c).select("a", "task", "b", "elements")
    source = firsts.unionByName(others).repartition("a", "task").sortWithinPartitions("a", "task", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.empty(0, np.uint64)
        for batch in slices(batches, "elements"):
            out = []
            for a, b, e in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("elements").to_pylist(), strict=True):
                own = np.frombuffer(e, np.uint64)
                if b is None:
                    first = own
                elif linked(first, own, percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return materialise(source.mapInArrow(run, "a long, b long"), "links")


def similar(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link and whose sketches agree in ALIKE coordinates."""
    side = classes.select("c", "n", "small", "bits")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    source = pairs.join(side.toDF("a", "n_a", "small_a", "bits_a"), "a").join(side.toDF("b", "n_b", "small_b", "bits_b"), "b").where(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, T) for k in ("small_a", "small_b"))
            p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, BITS // 64) for k in ("bits_a", "bits_b"))
            n, m = (batch.column(k).to_numpy() for k in ("n_a", "n_b"))
            yield batch.select(["a", "b"]).filter(pa.array(((x == y).sum(1) >= ALIKE) & may_link(p, q, n, m, percent)))

    return source.mapInArrow(run, "a long, b long")


def across(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of members(bucket, part, band, c, root, role, n, bands, small, bits) that share a bucket, have different roots, bitmaps that allow a link and sketches that agree in ALIKE coordinates.

    forest: of each part of a bucket only the pairs that join its roots by the most alike sketches, fewer than it has members.
    Else all of them, each named only in the bucket of its first common band, so at most once.
    A task reads the parts one after another, so it holds a batch and the part that the batch leaves open.
    """
    columns = ["bucket", "part", "c", "root", "role", "n", "small", "bits", *([] if forest else ["band", "bands"])]

    def compared(rows: pa.Table) -> pa.RecordBatch:
        start, end, group = parts_of(rows)
        c, root, n, role = (rows.column(k).to_numpy() for k in ("c", "root", "n", "role"))
        second, minor, whole = (role & SECOND) > 0, (role & MINOR) > 0, role == FIRST | SECOND | MINOR
        small = np.frombuffer(b"".join(rows.column("small").to_pylist()), np.uint64).reshape(len(c), T // 8)
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(c), BITS // 64)
        # a member's partners: in a part that is a whole bucket those after it, else all of the part
        low = np.where(whole, np.arange(1, len(c) + 1), start)
        held = np.where((role & FIRST) > 0, end - low, 0)
        found = []
        for own in chunks(held, PAIRS):
            lengths = held[own]
            i = np.repeat(np.arange(own.start, own.stop), lengths)
            j = np.arange(len(i)) - np.repeat(np.cumsum(lengths) - lengths - low[own], lengths)
            # two minor members meet in two parts and are compared in one
            ok = (root[i] != root[j]) & (whole[i] | second[j] & ((c[j] > c[i]) | ~minor[j]))
            ok &= np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            same = (small[i].view(np.uint8) == small[j].view(np.uint8)).sum(1)
            ok = same >= ALIKE
            ok[ok] = may_link(bits[i[ok]], bits[j[ok]], n[i[ok]], n[j[ok]], percent)
            found.append((i[ok], j[ok], same[ok]))
        i, j, same = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(3))
        if forest:
            chosen = np.array(joining(i, j, group[i], root, np.lexsort((np.arange(len(i)), -same, group[i]))), np.int64)
        else:
            bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            chosen = np.flatnonzero((bands[i] == bands[j]).argmax(1) == rows.column("band").to_numpy()[i]) if len(i) else i
        return pa.RecordBatch.from_arrays([pa.array(c[x[chosen]], pa.int64()) for x in (i, j)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(parts_of(pa.Table.from_batches([batch]))[0][-1])
            if last or held and any(batch.column(k)[0] != held[0].column(k)[0] for k in ("bucket", "part")):
                yield compared(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield compared(pa.Table.from_batches(held))

    dealt = members.select(*columns).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "c")
    return dealt.mapInArrow(run, "a long, b long")


def parts_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the part of each row starts and ends, and its number, in rows sorted by bucket and part."""
    keys = [rows.column(k).to_numpy() for k in ("bucket", "part")]
    new = np.concatenate([[True], np.logical_or(*(k[1:] != k[:-1] for k in keys))])
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    return first[group], np.append(first[1:], len(new))[group], group


def chunks(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose counts come to about `most` together, one row at least."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


def joining(i: np.ndarray, j: np.ndarray, group: np.ndarray, root: np.ndarray, order: np.ndarray) -> list[int]:
    """Of the pairs (i, j), taken in this order, those that join two trees of roots of their part."""
    chosen: list[int] = []
    above: dict[int, int] = {}
    part = -1

    def top(r: int) -> int:
        while (up := above.get(r, r)) != r:
            above[r] = r = above.get(up, up)
        return r

    for k, g, p, q in zip(order.tolist(), group[order].tolist(), root[i[order]].tolist(), root[j[order]].tolist(), strict=True):
        if g != part:
            part = g
            above.clear()
        p, q = top(p), top(q)
        if p != q:
            above[q] = p
            chosen.append(k)
    return chosen


@compact
def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (smallest doc_id reachable) and kept (doc_id = component_id) of every row."""
    bounded_batches(documents)
    rows = materialise(sketches(documents, doc_id, text, size), "sketches", scanned=True)
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("small").alias("small"), F.first("bits").alias("bits"))
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    reps = classes.select("c", "rep", "key")

    # buckets of several classes, and each member with the smallest
    flat = classes.select("c", F.explode("bands").alias("bucket"))
    hubs = flat.groupBy("bucket").agg(F.min("c").alias("a"), F.max("c").alias("high")).where("a != high").select("bucket", "a")
    members = materialise(flat.join(hubs, "bucket"), "members")
    stars = materialise(similar(members.where("a != c").select("a", F.col("c").alias("b")).distinct(), classes, percent), "stars")
    sets = sets_of(documents, reps.join(ends(stars), "c"), doc_id, text, size)
    edges = confirm(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent)

    banded = classes.select("c", F.posexplode("bands").alias("band", "bucket")).join(hubs.select("bucket"), "bucket").select("bucket", "band", "c")

    def parted(roots: DataFrame) -> DataFrame:
        """Members, with root, role and sketch, of the buckets that have several roots; larger ones dealt as blocks against blocks, so that each pair of different roots meets in a part."""
        held = banded.join(roots, banded.c == roots.v, "left").select("bucket", "band", "c", F.coalesce("root", "c").alias("root"))
        mixed = held.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held")).where("low != high").select("bucket", "held")
        left = materialise(held.join(mixed, "bucket"), "left")
        larger = left.where(F.col("held") > BUCKET)
        parts = left.where(F.col("held") <= BUCKET).select("bucket", F.lit(0).cast("long").alias("part"), "band", "c", "root", F.lit(FIRST | SECOND | MINOR).alias("role"))
        if not larger.isEmpty():
            parts = parts.unionByName(blocks(larger))
        return parts.join(classes.select("c", "n", "bands", "small", "bits"), "c")

    def further(pairs: DataFrame) -> DataFrame:
        nonlocal sets
        missing = reps.join(ends(pairs), "c").join(sets, "c", "left_anti")
        if not missing.isEmpty():
            sets = sets.unionByName(sets_of(documents, missing, doc_id, text, size))
        return confirm(pairs, sets, percent)

    # while components meet in a bucket, the pairs that join them by the most alike sketches
    roots = components(edges)
    for _ in range(ROUNDS):
        more = further(materialise(across(parted(roots), percent, forest=True).distinct(), "forest"))
        if more.isEmpty():
            break
        roots = joined(roots, more)
    # then every pair of different components whose sketches are alike
    pairs = materialise(across(parted(roots), percent, forest=False), "across")
    if not pairs.isEmpty():
        roots = joined(roots, further(pairs))

    placed = classes.join(roots, classes.c == roots.v, "left").select("key", "rep", F.coalesce("root", "c").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component"))
    found = placed.join(smallest, "root").select("key", "component")
    out = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "key").join(found, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id")).select("doc_id", "text_key", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def blocks(larger: DataFrame) -> DataFrame:
    """bucket, part, band, c, root and role of larger(bucket, band, c, root, held): a bucket's members outside its largest root, in blocks, against all its members, in blocks. A part is a pair of blocks."""
    size = max(1, BUCKET // 2)
    largest = larger.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("largest"))
    count = lambda members: F.ceil(members / size).cast("long")
    dealt = larger.join(largest, "bucket").select("bucket", "band", "c", "root", (F.col("root") != F.col("largest.root")).alias("minor"), count(F.col("held") - F.col("largest.count")).alias("rows"), count(F.col("held")).alias("columns"))
    dealt = dealt.withColumn("row", F.when(F.col("minor"), F.pmod(F.xxhash64("c"), "rows"))).withColumn("column", F.pmod(F.xxhash64(F.lit("column"), "c"), "columns"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    minor = F.when(F.col("minor"), MINOR).otherwise(0)
    # a member that is in both blocks of a part is there once
    firsts = dealt.where("minor").withColumn("q", every("columns")).where(F.col("q") != F.col("column")).withColumn("p", F.col("row")).withColumn("role", F.lit(FIRST | MINOR))
    seconds = dealt.withColumn("p", every("rows")).withColumn("q", F.col("column")).withColumn("role", minor + SECOND + F.when(F.col("p") == F.col("row"), FIRST).otherwise(0))
    return firsts.unionByName(seconds).select("bucket", (F.col("p") * F.col("columns") + F.col("q")).alias("part"), "band", "c", "root", "role")


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The roots after further links; what was found before enters as one link for each vertex."""
    return components(roots.where("v != root").select(F.col("root").alias("a"), F.col("v").alias("b")).unionByName(more))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
