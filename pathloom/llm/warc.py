"""WARC archives: records written from pages, read back by segment reassembly.

Writing: a page whose payload no other page has, or that has the largest page_id of
those that share its payload, is a response record with an HTTP block in chunked
transfer framing; the others are revisit records that name it and keep only the HTTP
header. A block longer than a segment goes into a first record and continuation
records (WARC 1.1). Archives are blobs of whole records in a Parquet table, so that
writing and reading need nothing but Spark's own access to the store.

Reading: blobs are parsed record by record; segments are grouped by the identifier of
the record that they continue, ordered by segment number and checked against the
total length; then the chunked framing is decoded and length and digest are taken from
the payload, and compared with the header.

An identifier of any type is written as text and read back as read() is told to.
Null and empty html are empty payloads; payloads of any length are written whole. Repeated rows are records of their own; of
equal payloads every row with the largest page_id is a response. A null page_id is
smaller than any other. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices, utf8_bytes

#: Bytes of a block in one record, of a chunk of the transfer framing, and of an archive blob (one record more at most).
SEGMENT, CHUNK, ARCHIVE = 64 << 10, 16 << 10, 2 << 20
END = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(END, at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != END:
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at : at + n])
        at += n + 2


def record(kind: str, identifier: str, headers: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END * 2 + block + END * 2


def segmented(kind: str, identifier: str, headers: dict[str, object], block: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """One record, or a first one and its continuations."""
    if len(block) <= size:
        yield record(kind, identifier, headers, block)
        return
    parts = [block[i : i + size] for i in range(0, len(block), size)]
    yield record(kind, identifier, {**headers, "WARC-Segment-Number": 1}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        own = {"WARC-Segment-Origin-ID": identifier, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": len(block) if n == len(parts) else None}
        yield record("continuation", f"{identifier[:-1]}:{n}>", own, part)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(archive):
        head = archive.index(END * 2, at)
        version, *lines = archive[at:head].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record starts here")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = head + 4
        end = start + int(headers["content-length"])
        if archive[end : end + 4] != END * 2:
            raise ValueError("a record does not end where its length says")
        yield headers, archive[start:end]
        at = end + 4


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(END * 2)
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    return headers, dechunked(body) if headers.get("transfer-encoding") == "chunked" else body


def sha1_of(html: Column) -> Column:
    return F.unhex(F.sha1(html))


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives of the pages: blob binary, written to the shared folder."""
    bounded_batches(pages)
    body = F.coalesce(F.col(html), F.lit(""))
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("t"), sha1_of(body).alias("digest"))
    # which page answers for a payload: digests only, so that the html is dealt out once, for the join
    # (a table, so that the join is of two plain shuffles, whose hot keys Spark splits)
    firsts = materialise(pages.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"), "firsts")
    source = pages.join(firsts, "digest", "left").select(F.col("page_id").cast("string"), "url", "t", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first").cast("string")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, held, bytes_held = TaskContext.get().partitionId(), 0, [], 0
        for batch in slices(batches, "t"):
            for page, at, payload, digest, first in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist(), batch.column("digest").to_pylist(), batch.column("first").to_pylist(), strict=True):
                identifier = f"<urn:page:{task}:{n}>"
                n += 1
                headers = {"WARC-Target-URI": None if at is None else "".join(at.split()), "X-Page-ID": None if page is None else quote(page), "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}", "Content-Type": "application/http; msgtype=response"}
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if first is None:
                    out = segmented("response", identifier, headers, http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload))
                else:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": quote(first)}
                    out = segmented("revisit", identifier, headers, http + b"Content-Length: %d\r\n\r\n" % len(payload))
                for x in out:
                    held.append(x)
                    bytes_held += len(x)
                    if bytes_held >= ARCHIVE:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["blob"])
                        held, bytes_held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["blob"])

    return materialise(source.mapInArrow(run, "blob binary"), "archives")


READ = {"origin": "string", "segment": "long", "total": "long", "record_type": "string", "page_id": "string", "refers_to": "string", "header_digest": "string", "payload_bytes": "long", "payload_digest": "string", "block": "binary"}


def _decoded(block: bytes) -> tuple[int, str]:
    payload = payload_of(block)[1]
    return len(payload), base32_sha1(payload)


def read(archives: DataFrame, kind: str = "long") -> DataFrame:
    """page_id (of type `kind`), payload_bytes, payload_digest, record_type and refers_to of every record of the archives.

    Only segments of long records carry their block through the shuffle.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                rows = []
                for h, block in records(blob):
                    whole = "warc-segment-number" not in h
                    n = digest = None
                    if h["warc-type"] == "revisit":
                        n, digest = int(payload_of(block)[0]["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                    elif whole:
                        n, digest = _decoded(block)
                    text = lambda k, h=h: unquote(h[k]) if k in h else None
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), number("warc-segment-number"), number("warc-segment-total-length"), h["warc-type"], text("x-page-id"), text("x-refers-to-page"), h.get("warc-payload-digest", "").removeprefix("sha1:"), n, digest, None if whole else block))
                yield pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, t in zip(zip(*rows, strict=True), READ.values(), strict=True)], list(READ))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = row["parts"]
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"segments of {row['origin']} are missing")
                n, digest = _decoded(block)
                first = parts[0]
                yield pa.RecordBatch.from_arrays([pa.array([x], TYPES[t]) for x, t in ((first["page_id"], "string"), (first["refers_to"], "string"), (first["header_digest"], "string"), (n, "long"), (digest, "string"))], ["page_id", "refers_to", "header_digest", "payload_bytes", "payload_digest"])

    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "header_digest"]
    parsed = materialise(archives.mapInArrow(parse, ", ".join(f"{k} {t}" for k, t in READ.items())), "records")
    whole = parsed.where("segment is null").select(*columns)
    grouped = parsed.where("segment is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "total", "page_id", "refers_to", "header_digest", "block"))).alias("parts"))
    long = grouped.mapInArrow(assemble, "page_id string, refers_to string, header_digest string, payload_bytes long, payload_digest string").withColumn("record_type", F.lit("response")).select(*columns)
    out = whole.unionByName(long)
    return out.select(F.col("page_id").cast(kind), "payload_bytes", F.when(F.col("payload_digest") == F.col("header_digest"), F.col("payload_digest")).alias("payload_digest"), "record_type", F.col("refers_to").cast(kind))


TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
