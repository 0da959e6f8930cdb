"""Byte-level BPE through sentencepiece.

A rank vocabulary (base64 token, rank) becomes a sentencepiece BPE model that is
serialised here field by field: each token's bytes are mapped to 256 code points,
its score is its negative rank, normalisation is the identity. Merging the pair
whose joined piece scores best is then the same rule as merging the pair of the
lowest rank. Texts are cut by the vocabulary's pattern first and each pre-token is
encoded alone; a pre-token that is itself in the vocabulary is that one id. Decoding
maps ids back to bytes by the inverse table.

Null and empty texts have no ids and decode to no bytes; texts of any length are encoded whole; of
equally ranked pairs the first in the text is merged; an empty table gives an empty table. Repeated rows and null ids
pass through, one output row for each input row; other columns are not read.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

#: The code point of byte 0; bytes follow in order. None of the 256 is white space.
FIRST_CODE_POINT = 0x100
#: Pre-tokens whose ids a worker remembers before it starts afresh. It bounds memory, not what is encoded.
REMEMBERED = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which must be 0, 1, 2 ..."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens = dict((int(rank), base64.b64decode(token)) for token, rank in rows)
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must be gapless from 0")
    return [tokens[i] for i in range(len(tokens))]


def mapped(token: bytes) -> str:
    return "".join(chr(FIRST_CODE_POINT + b) for b in token)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks; one unknown piece follows them."""
    # Field numbers and enum values of the public sentencepiece_model.proto.
    piece_text, piece_score, piece_type, unknown = 1, 2, 3, 2
    pieces, trainer, normaliser = 1, 2, 3
    model_type, bpe, vocab_size, unk_id, bos_id, eos_id, pad_id = 3, 2, 4, 40, 41, 42, 43
    name, dummy_prefix, extra_white_space, escape_white_space = 1, 3, 4, 5
    out = [
        _block(pieces, _block(piece_text, mapped(t).encode()) + _varint(piece_score << 3 | 5) + struct.pack("<f", -rank))
        for rank, t in enumerate(tokens)
    ]
    out.append(_block(pieces, _block(piece_text, b"<unk>") + _number(piece_type, unknown)))
    none = (1 << 64) - 1  # -1
    out.append(
        _block(trainer, _number(model_type, bpe) + _number(vocab_size, len(tokens) + 1) + _number(unk_id, len(tokens)) + _number(bos_id, none) + _number(eos_id, none) + _number(pad_id, none))
    )
    out.append(_block(normaliser, _block(name, b"identity") + _number(dummy_prefix, 0) + _number(extra_white_space, 0) + _number(escape_white_space, 0)))
    return b"".join(out)


class Codec(dict):
    """Ids of pre-tokens, found when first asked for; encode() and decode() for whole texts."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        super().__init__()
        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(model)
        self.split = regex.compile(pattern).findall

    def __missing__(self, pre_token: str) -> list[int]:
        as_bytes = pre_token.encode()
        rank = self.whole.get(as_bytes)
        ids = [rank] if rank is not None else self.processor.EncodeAsIds(mapped(as_bytes))
        self[pre_token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(tokens: list[bytes], model: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    key = (hash(model), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(tokens, model, pattern)
    return _codecs[key]


def encode_decode(df: DataFrame, keys: list[str], text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """keys, input_ids array<int> and decoded binary (the bytes that the ids stand for) of every row.

    The vocabulary file is read by the driver and goes to the workers in a broadcast of
    a few MB, whatever the size of the data.
    """
    bounded_batches(df)
    tokens = read_ranks(vocabulary or default_vocabulary())
    shared = df.sparkSession.sparkContext.broadcast((tokens, serialise(tokens)))
    pattern = pattern or default_pattern()
    # positional names, so that no key clashes with the text or the results
    inner = [f"k{i}" for i in range(len(keys))]
    source = df.select(*[F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value, pattern)
        for batch in slices(batches, "t", 1 << 20):
            ids = [codec.encode(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in inner], pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.binary())],
                [*inner, "input_ids", "decoded"],
            )

    types = dict(source.dtypes)
    out = source.mapInArrow(run, ", ".join([*[f"{i} {types[i]}" for i in inner], "input_ids array<int>", "decoded binary"]))
    return out.withColumnsRenamed(dict(zip(inner, keys, strict=True)))


def digests(encoded: DataFrame, *keys: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of what encode_decode() returned."""
    return encoded.select(
        *keys,
        F.size("input_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("input_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
