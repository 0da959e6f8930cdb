"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are cut into words (A-Z lower-cased; ASCII white space and signs part words);
the patterns are the windows of the benchmark items. For each pattern length m a search
machine holds a shift table of the blocks of two neighbouring words: how far a window
that ends in this block may jump, m - 1 words for a block that no pattern has. Where the
shift is 0, the block's bucket lists the patterns that end in it, and comparing all of
their words confirms an occurrence. Items with fewer words than a window are one window
of their own length. Patterns of one word need no block; they are looked up.

The benchmark is taken in blocks of at most BLOCK_BYTES of text, one broadcast and one
pass over the documents each, so that what is broadcast is bounded however large the
benchmark: a machine takes some 85 times its text, 350 MB a worker. A pass is written to the
shared folder before the next, so no task holds two machines; hits of all blocks are
gathered within the row. Documents are not shuffled.

Null and empty texts have no words; an item without words matches nothing; items with
equal ids count once; items with a null id mark words but are not named. Repeated rows
pass through, one output row for each. An empty benchmark gives no hits. Other columns
are not read. Texts of any length are searched whole; of texts that tie nothing is chosen, so ties don't arise. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, raw, slices

#: Words of a window; bytes of benchmark text in one broadcast.
WINDOW, BLOCK_BYTES = 10, 4 << 20
#: Bytes to words: A-Z to lower case, every other ASCII character but a-z and 0-9 to a space.
TO_WORDS = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


class Machine:
    """Patterns of one length, at least two words."""

    def __init__(self, length: int):
        self.length = length
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[tuple[bytes, ...], set]] = {}

    def add(self, pattern: tuple[bytes, ...], item: int | None) -> None:
        m = self.length
        for j in range(1, m):
            block = pattern[j - 1] + b" " + pattern[j]
            self.shift[block] = min(self.shift.get(block, m - 1), m - 1 - j)
        self.bucket.setdefault(pattern[-2] + b" " + pattern[-1], {}).setdefault(pattern, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """First word and items of each occurrence."""
        m, shift, bucket = self.length, self.shift.get, self.bucket
        end, n, jump = m - 1, len(words), m - 1
        while end < n:
            block = words[end - 1] + b" " + words[end]
            s = shift(block, jump)
            if s:
                end += s
                continue
            start = end - m + 1
            items = bucket[block].get(tuple(words[start : end + 1]))
            if items:
                yield start, items
            end += 1


class Searcher:
    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        self.machines: dict[int, Machine] = {}
        self.single: dict[bytes, set] = {}
        for item, text in items:
            words = words_of(text)
            m = min(window, len(words))
            if m == 1:
                self.single.setdefault(words[0], set()).add(item)
            elif m:
                machine = self.machines.setdefault(m, Machine(m))
                for i in range(len(words) - m + 1):
                    machine.add(tuple(words[i : i + m]), item)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words (first, end) of all occurrences, and the items."""
        spans, found = [], set()
        for m, machine in self.machines.items():
            for start, items in machine.search(words):
                spans.append((start, start + m))
                found |= items
        if self.single:
            for i, w in enumerate(words):
                if w in self.single:
                    spans.append((i, i + 1))
                    found |= self.single[w]
        return spans, found


def blocks_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The items in blocks of at most `most` bytes, a larger item alone; the driver holds one at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(item_id), F.encode(F.col(text), "UTF-8").alias("t")).where("octet_length(t) > 0").toLocalIterator():
        held.append((row[0], bytes(row[1])))
        size += len(row[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


RESULT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "array<long>"}


def decontaminate(documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, clean_only: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns `keep`, n_words, n_hit (words inside an occurrence), n_items and items (ids of the items that occur, ascending) of every row.

    clean_only: columns `keep` of the rows without a hit.
    """
    bounded_batches(documents)
    sc = documents.sparkSession.sparkContext
    inner = [f"k{i}" for i in range(len(keep))]
    base = documents.select(*[F.col(k).alias(i) for k, i in zip(keep, inner, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("t"))
    types = dict(base.dtypes)
    schema = ", ".join([*[f"{i} {types[i]}" for i in inner], "t string", "hit binary", "items array<long>"])

    def one_pass(df: DataFrame, shared) -> DataFrame:  # noqa: ANN001
        """df with the spans and the items of one block of the benchmark added to those before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, window)
            for batch in slices(batches, "t"):
                hits, items = [], []
                for t, h, x in zip(raw(batch.column("t")), batch.column("hit").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    spans, found = searcher.search(words_of(t))
                    hits.append((h or b"") + np.array(spans, np.int64).tobytes() if spans else h)
                    items.append(sorted({*(x or ()), *(i for i in found if i is not None)}))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in inner], batch.column("t"), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64()))], [*inner, "t", "hit", "items"])

        return df.mapInArrow(run, schema)

    def last(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, window)
            for batch in slices(batches, "t"):
                words, hit, items = [], [], []
                before = zip(batch.column("hit").to_pylist(), batch.column("items").to_pylist(), strict=True) if "hit" in batch.schema.names else None
                for t in raw(batch.column("t")):
                    own = words_of(t)
                    spans, found = searcher.search(own)
                    found.discard(None)
                    if before is not None:
                        h, x = next(before)
                        spans += np.frombuffer(h or b"", np.int64).reshape(-1, 2).tolist()
                        found |= set(x or ())
                    words.append(len(own))
                    hit.append(covered(spans))
                    items.append(sorted(found))
                columns = [*[batch.column(i) for i in inner], pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(items, pa.list_(pa.int64()))]
                out = pa.RecordBatch.from_arrays(columns, [*inner, *RESULT])
                yield out.filter(pa.array([not h for h in hit])) if clean_only else out

        return run

    blocks = [sc.broadcast(b) for b in blocks_of(benchmark, most=block_bytes)] or [sc.broadcast([])]
    df = base if len(blocks) == 1 else base.withColumns({"hit": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<long>")})
    for shared in blocks[:-1]:
        df = materialise(one_pass(df, shared), "pass", scanned=True)  # so that one machine is in memory at a time
    out = df.mapInArrow(last(blocks[-1]), ", ".join([*[f"{i} {types[i]}" for i in inner], *[f"{k} {t}" for k, t in RESULT.items()]]))
    out = out.select(*inner) if clean_only else out
    return out.withColumnsRenamed(dict(zip(inner, keep, strict=True)))


def covered(spans: list) -> int:
    total, reached = 0, 0
    for start, end in sorted(spans):
        if end > reached:
            total += end - max(start, reached)
            reached = end
    return total


def digest(hits: DataFrame, *keys: str) -> DataFrame:
    """The fixed columns of the query; items_sha256 is of the ids as sorted strings, joined by commas."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select(*keys, "n_words", "n_hit", "n_items", F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
