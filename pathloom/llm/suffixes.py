"""Removal of repeated strings by bucket-pointer refinement.

A text is a row of symbols: its bytes, or its words (BYTES, WORDS: runs of other bytes
than white space). A symbol goes if a string of `length` symbols that covers it also
starts anywhere else; of words, what stands between those that go goes too. As in
bucket-pointer refinement, positions stand in buckets by their first q symbols and are
refined by the bucket of a later offset: bucket_2h(p) = (bucket_h(p), bucket_h(p + h)),
with each round's buckets reused by the next, up to the length. A bucket's pointer is
a 64-bit name computed from its content, so positions of all documents are refined
alike without exchanging ranks, and a position is settled as soon as its bucket is single:

1. Every window of `length` symbols is filed under one initial bucket, that of the smallest
   name of q symbols in it. Positions whose initial bucket is single are dropped.
2. The windows of a place are taken in cells. A cell whose common core has a single
   bucket holds no repeat; one whose hull has a bucket of two or more holds nothing else.
3. The rest is refined to single windows, along with one cell of each repeated hull that
   shares a core with it; windows with a bucket of two or more repeat.

Buckets are counted by partial aggregates of names, so a passage that any number of
documents share is one key with a count, never a group in a task. Documents with equal
texts are one text with a number of copies.

Null and empty texts have no symbols and lose none; texts of any length are read whole. Repeated rows are copies of each
other. Null ids pass through. An empty table gives an empty table; other columns are
not read. Names are of 64 bits at each length; a false match needs two names to collide
within one initial bucket's key, at a rate of about one in 2^64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, compact, discard, materialise, raw, slices, text_key, utf8_bytes, whole_row



class Unit(NamedTuple):
    """What a text is cut into: by words or by bytes; symbols of an initial bucket's names, and windows of a cell."""

    words: bool
    q: int
    cell: int


BYTES, WORDS = Unit(False, 32, 24), Unit(True, 8, 6)
#: Bytes of a string that must not repeat; words of a passage that must not.
LENGTH, PASSAGE = 400, 50

_m1, _m2, _m3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_s29 = np.uint64(29)
#: Names of single bytes.
_bytes = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def refined(names: np.ndarray, later: int) -> np.ndarray:
    """Names of pairs: of each position and the one `later` bytes on."""
    return paired(names[:-later], names[later:])


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _m1 + b * _m2
    return (x ^ (x >> _s29)) * _m3


#: Bytes that part words.
_space = np.isin(np.arange(256), [32, *range(9, 14)])
#: Names of bytes of words; white space has none.
_letters = np.where(_space, np.uint64(0), _bytes)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _s29)) * _m3
    return (x ^ (x >> _s29)) * _m1


def places(n: int) -> np.ndarray:
    """Numbers for the first n places of a word."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _m2)


_places = places(256)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    inside = np.concatenate([[False], ~_space[np.frombuffer(text, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def symbols(text: bytes, unit: Unit) -> np.ndarray:
    """The name of each symbol: of a word, a sum of its bytes' names, each times a number for its place."""
    own = np.frombuffer(text, np.uint8)
    if not unit.words:
        return _bytes[own]
    start, end = word_bounds(text)
    if not len(start):
        return np.empty(0, np.uint64)
    own, begin = own[start[0] :], start - start[0]
    lengths = np.diff(begin, append=len(own))
    numbers = _places if (longest := int(lengths.max())) <= len(_places) else places(longest)
    parts = _letters[own] * numbers[np.arange(len(own)) - np.repeat(begin, lengths)]
    return mixed(np.add.reduceat(parts, begin) + (end - start).astype(np.uint64) * _m2)


class Names:
    """Names of all strings of a row of symbols, length by length, each from the length below."""

    def __init__(self, of_symbols: np.ndarray):
        self.by_length = {1: of_symbols}

    def of(self, length: int) -> np.ndarray:
        """Names of the strings of `length` symbols at every position that has one."""
        if length not in self.by_length:
            half = 1 << (length - 1).bit_length() - 1  # the largest power of two below the length
            self.by_length[length] = refined(self.of(half), length - half)
        return self.by_length[length]

    def one(self, start: np.ndarray, length: int) -> np.ndarray:
        """Names of the strings at some positions: only the lengths that are powers of two are named everywhere."""
        half = 1 << (length - 1).bit_length() - 1 if length > 1 else 1
        own = self.of(half)
        return own[start] if half == length else paired(own[start], own[start + (length - half)])

    def each(self, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """As one(), of a length of its own at each position; those between the same powers of two are named at once."""
        halves = [1 << (int(n) - 1).bit_length() - 1 if n > 1 else 1 for n in ((lengths.min(), lengths.max()) if len(lengths) else ())]
        if len(set(halves)) == 1 and halves[0] < lengths.min():
            own = self.of(halves[0])
            return paired(own[start], own[start + (lengths - halves[0])])
        out = np.empty(len(start), np.uint64)
        for length in np.unique(lengths):
            at = lengths == length
            out[at] = self.one(start[at], int(length))
        return out


def sliding(of: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least (np.minimum) or greatest (np.maximum) of each `width` in a row."""
    h = 1
    while 2 * h <= width:
        x = of(x[:-h], x[h:])
        h *= 2
    return of(x[: len(x) - (width - h)], x[width - h :]) if h < width else x


def filed(names: Names, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts filed under one place: first start, end, bucket, place.

    A window's bucket is its least name, its place the first that has this name in it, so
    that equal windows have the same bucket at the same distance.
    """
    if len(names.by_length[1]) < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    own, width = names.of(q), length - q + 1
    least = sliding(np.minimum, own, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end, bucket = np.append(first[1:], len(least)), least[first]
    # a place is least in some window if the greatest least of the windows that hold it is its own name
    none = np.zeros(width - 1, np.uint64)
    greatest = sliding(np.maximum, np.concatenate([none, least, none]), width)
    place = np.flatnonzero(own == greatest)
    if len(place) == len(first):
        return first, end, bucket, place
    out: list[tuple] = []  # some name repeats within a window: a run has several places
    for a, e, b in zip(first.tolist(), end.tolist(), bucket, strict=True):
        for at in (np.flatnonzero(own[a : e + width - 1] == b) + a).tolist():
            if a < e:
                out.append((a, min(e, at + 1), b, at))
                a = min(e, at + 1)
    columns = list(zip(*out, strict=True))
    return tuple(np.array(c, np.uint64 if k == 2 else np.int64) for k, c in enumerate(columns))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keys(bucket: np.ndarray, kind: int, low: np.ndarray, high: np.ndarray, names: np.ndarray) -> np.ndarray:
    x = bucket * _m1 + names * _m2 + (low.astype(np.int64) * 1024 + high.astype(np.int64) * 4 + kind).view(np.uint64) * _m3
    x = (x ^ (x >> _s29)) * _m1
    return _signed(x ^ (x >> np.uint64(32)))


def cells(names: Names, first: np.ndarray, end: np.ndarray, bucket: np.ndarray, place: np.ndarray, length: int, width: int) -> dict[str, np.ndarray]:
    """Cells of the runs: start and end of their windows, the key of their core and of their hull.

    Cells lie on a grid counted from the bucket's place, so that equal strings are cut alike.
    """
    grid_low, grid_high = (first - place) // width, (end - 1 - place) // width
    counts = grid_high - grid_low + 1
    run = np.repeat(np.arange(len(first)), counts)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts) + grid_low[run]
    p, b = place[run], bucket[run]
    from_, to = p + nth * width, p + (nth + 1) * width - 1  # windows of the whole cell
    start, last = np.maximum(from_, first[run]), np.minimum(to, end[run] - 1)
    # what all windows of the whole cell have in common; every window of it holds that, so it lies in the text
    core = _keys(b, 0, nth, nth, names.one(to, length - width + 1))
    hull = _keys(b, 1, start - p, last - p, names.each(start, length + last - start))
    return {"start": start, "last": last, "core": core, "hull": hull}


def _grouped_rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(raw(batch.column("t")), *(batch.column(k).to_pylist() for k in columns), strict=True)


def _repeat(values: list[int], counts: list[int]) -> pa.Array:
    return pa.array(np.repeat(np.array(values, np.int64), counts))


class Removal(NamedTuple):
    """rows: doc_id, n (bytes), key and sha256 of the text of every document. texts: key, spans (array<struct<a, b>> of
    the bytes that go, byte offsets for words too) and kept (the bytes that stay) of every text that loses something."""

    rows: DataFrame
    texts: DataFrame


@compact
def remove(documents: DataFrame, length: int = LENGTH, unit: Unit = BYTES, doc_id: str = "doc_id", text: str = "text", kept: bool = True) -> Removal:
    """What the strings of `length` symbols that start more than once leave of every document. kept: whether the bytes that stay are asked for; else they are null."""
    bounded_batches(documents)
    # so many bytes have texts of `length` symbols at least
    least = 2 * length - 1 if unit.words else length
    t = F.coalesce(F.col(text), F.lit(""))
    source = documents.select(F.col(doc_id).alias("doc_id"), utf8_bytes(F.col(text)).alias("n"), text_key(F.col(text)).alias("key"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("sha256"), F.when(utf8_bytes(F.col(text)) >= least, t).alias("t"))
    kind = dict(source.dtypes)["doc_id"]
    id_columns = ["doc_id", "n", "key", "sha256"]

    def file_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            named = [symbols(t, unit) if t else None for t in raw(batch.column("t"))]
            sizes = pa.array([0 if x is None else len(x) for x in named], pa.int64())
            runs = [None if x is None or len(x) < length else filed(Names(x), length, unit.q) for x in named]
            firsts, ends, places = (pa.array([None if r is None else r[k] for r in runs], pa.list_(pa.int32())) for k in (0, 1, 3))
            buckets = pa.array([None if r is None else _signed(r[2]) for r in runs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in id_columns], sizes, firsts, ends, buckets, places], [*id_columns, "size", *RUNS])

    filed_rows = materialise(source.mapInArrow(file_windows, f"doc_id {kind}, n long, key binary, sha256 binary, size long, firsts array<int>, ends array<int>, buckets array<long>, places array<int>"), "windows", scanned=True)
    rows = filed_rows.select(*id_columns)
    # an equal text in several rows is one text
    once = filed_rows.where(f"size >= {length}").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"), *[F.first(k).alias(k) for k in RUNS])
    once = materialise(once.withColumn("id", F.monotonically_increasing_id()), "texts")
    flat = once.select("id", F.explode(F.arrays_zip(*RUNS)).alias("r")).select("id", "r.*").toDF("id", "first", "end", "bucket", "place")
    # names that repeat are tables, so that a join with them is one of two plain shuffles, whose hot keys Spark splits
    shared = materialise(flat.groupBy("bucket").count().where("count > 1").select("bucket"), "shared")
    runs = flat.join(shared, "bucket", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "end", "bucket", "place"))).alias("runs"))
    wanted = once.select("id", F.col("key").alias("k"), "rep", "copies").join(runs, "id")
    wanted = wanted.select("id", "k", "rep", "copies", F.col("runs.first").alias("firsts"), F.col("runs.end").alias("ends"), F.col("runs.bucket").alias("buckets"), F.col("runs.place").alias("places"))
    texts = source.where("t is not null").select("key", "doc_id", "t").join(wanted, F.expr("key = k and doc_id <=> rep")).dropDuplicates(["id"])
    candidates = materialise(texts.select("id", "key", "copies", *RUNS, "t"), "candidates")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            ids, found = [], []
            for t, i, *runs in _grouped_rows(batch, "id", *RUNS):
                ids.append(i)
                first, end, bucket, place = (np.array(x, np.int64) for x in runs)
                found.append(cells(Names(symbols(t, unit)), first, end, bucket.view(np.uint64), place, length, unit.cell))
            columns = [pa.array(np.concatenate([x[k] for x in found])) for k in CELLS]
            yield pa.RecordBatch.from_arrays([_repeat(ids, [len(x["start"]) for x in found]), *columns], ["id", *CELLS])

    cut_up = materialise(candidates.select("id", *RUNS, "t").mapInArrow(cut, ", ".join(f"{k} long" for k in ("id", *CELLS))), "cells")
    cores = materialise(cut_up.groupBy("core").count().where("count > 1").select("core"), "cores")
    hulls = materialise(cut_up.groupBy("hull").count().where("count > 1").select("hull", F.lit(True).alias("whole")), "hulls")
    settled = cut_up.join(cores, "core", "left_semi").join(hulls, "hull", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    settled = materialise(settled, "settled")
    discard(cut_up)
    # a run may begin or end within a cell that is settled elsewhere: of each such hull one cell is refined along with the open cells
    open_cores = materialise(settled.where("not whole").select("core").distinct(), "open")
    one_each = settled.where("whole").join(open_cores, "core", "left_semi").groupBy("hull").agg(F.min(F.struct("id", "start", "last")).alias("c")).select("c.*")
    refine = settled.where("not whole").select("id", "start", "last").unionByName(one_each)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            found: list[tuple] = []
            for t, i, todo, firsts, buckets, places in _grouped_rows(batch, "id", "todo", "firsts", "buckets", "places"):
                start = np.concatenate([np.arange(x["start"], x["last"] + 1) for x in todo])
                run = np.searchsorted(np.array(firsts, np.int64), start, side="right") - 1
                bucket, delta = np.array(buckets, np.int64).view(np.uint64)[run], start - np.array(places, np.int64)[run]
                own = Names(symbols(t, unit)).one(start, length)
                found.append((np.full(len(start), i), start, _keys(bucket, 2, delta, delta, own), _signed(own)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["id", "start", "one", "two"])

    todo = refine.groupBy("id").agg(F.collect_list(F.struct("start", "last")).alias("todo"))
    windows = materialise(candidates.select("id", *RUNS, "t").join(todo, "id").mapInArrow(single, "id long, start long, one long, two long"), "single")
    again = materialise(windows.groupBy("one", "two").count().where("count > 1").select("one", "two"), "again")
    repeated = windows.join(again, ["one", "two"], "left_semi").select("id", "start", F.col("start").alias("last"))
    repeated = repeated.unionByName(settled.where("whole").select("id", "start", "last"))
    spans = repeated.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "last"))).alias("found"))

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            cuts, left = [], []
            for t, found in _grouped_rows(batch, "found"):
                joined: list[list[int]] = []
                for x in found:
                    if joined and x["start"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], x["last"] + length)
                    else:
                        joined.append([x["start"], x["last"] + length])
                if unit.words:
                    starts, ends = word_bounds(t)
                    joined = [[int(starts[a]), int(ends[b - 1])] for a, b in joined]
                ends = [0, *(e for _, e in joined)]
                cuts.append([{"a": a, "b": b} for a, b in joined])
                left.append(b"".join(t[e:a] for e, a in zip(ends, [*(a for a, _ in joined), len(t)], strict=True)) if kept else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cuts, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(left, pa.binary())], ["key", "spans", "kept"])

    part = candidates.where("copies = 1").select("id", "key", "t").join(spans, "id").select("key", "found", "t").mapInArrow(leave, "key binary, spans array<struct<a:bigint,b:bigint>>, kept binary")
    # a text that several rows have repeats as a whole
    whole = once.where("copies > 1").select("key", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("spans"), F.lit(b"" if kept else None).cast("binary").alias("kept"))
    return Removal(rows, part.unionByName(whole))


RUNS = ("firsts", "ends", "buckets", "places")
CELLS = ("start", "last", "core", "hull")


def lost() -> list[Column]:
    """Bytes and number of the spans."""
    return [F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]), F.size("spans").cast("long")]


def digests(removal: Removal, passages: Removal | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with `passages`, another removal from the same documents, also its passage_bytes and n_passages."""
    n_removed, n_spans = lost()
    texts = removal.texts.select("key", n_removed.alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept", 256).alias("own"))
    found = removal.rows.join(texts, "key", "left")
    none = F.lit(0).cast("long")
    columns = ["doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("own", F.lower(F.hex("sha256"))).alias("kept_sha256")]
    if passages is not None:
        found = found.join(passages.texts.select("key", n_removed.alias("passage_bytes"), n_spans.alias("n_passages")), "key", "left")
        columns += [F.coalesce(k, none).alias(k) for k in ("passage_bytes", "n_passages")]
    return found.select(*columns)


def rewrite(documents: DataFrame, removal: Removal, text: str = "text") -> DataFrame:
    """The documents with the kept bytes as their text. Removal may cut a character in two; what is left of it goes too."""
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_kept"):
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array([x.decode(errors="ignore") for x in batch.column("_kept").to_pylist()], pa.string())], ["_key", "_new"])

    new = removal.texts.select(F.col("key").alias("_key"), F.col("kept").alias("_kept")).mapInArrow(repair, "_key binary, _new string")
    rows = documents.select(whole_row(documents), text_key(F.col(text)).alias("_k"))  # whatever its columns are called
    found = rows.join(new, F.col("_k") == F.col("_key"), "left")
    return found.select(*(F.coalesce("_new", F.col(f"_row.`{c}`")).alias(c) if c == text else F.col(f"_row.`{c}`") for c in documents.columns))
