"""Byte-level BPE through a sentencepiece model serialised straight from a rank file.

Every vocabulary entry becomes one piece whose characters stand for its bytes (byte b is U+0100 + b), scored
by its negative rank, under identity normalisation; sentencepiece's own merge loop then picks the lowest rank
first and the leftmost on ties. Pre-tokens (matches of the pattern) are encoded one by one; decoding maps
pieces back to bytes.

Defined results: null texts are empty and have no ids; repeated rows are encoded alike; an empty table
gives an empty result; ids out of the vocabulary raise ValueError when decoded; other columns pass through.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewater.llm.common import sliced, tidy
from tidewater.llm.pieces import TextEncoder

_SHIFT = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protocol-buffer field: text and bytes by length, floats in 4 bytes, the rest as varints."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece id = rank + 1, and piece 0 is the unknown piece.

    Ranks without an entry are filled by unused pieces, so ids stay aligned.
    """
    normal, unknown, unused = 1, 2, 5
    by_rank = {rank: token for token, rank in ranks.items()}
    pieces = [_field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)]
    for rank in range(max(by_rank, default=-1) + 1):
        if rank in by_rank:
            piece = "".join(chr(_SHIFT + b) for b in by_rank[rank])
            pieces.append(_field(1, piece) + _field(2, -float(rank)) + _field(3, normal))
        else:
            pieces.append(_field(1, f"<gap{rank}>") + _field(2, -float(rank)) + _field(3, unused))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(  # model type 2 is BPE
        _varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43)  # no bos, eos or pad id
    )
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class PieceDecoder:
    """Ids back to bytes; needs the ranks alone."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        by_rank = {rank: token for token, rank in ranks.items()}
        self.table = pa.array([by_rank.get(i) for i in range(max(by_rank, default=-1) + 1)], pa.binary())

    def decode(self, column: pa.BinaryArray) -> pa.BinaryArray:
        """The bytes of each row of little-endian unsigned 32-bit ids."""
        bounds = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy()))) // 4
        ids = np.frombuffer(b"".join(column.to_pylist()), "<u4")
        if len(ids) and ids.max() >= len(self.table):
            raise ValueError("an id is out of the vocabulary")
        found = self.table.take(pa.array(ids))
        if found.null_count:
            raise ValueError("an id is out of the vocabulary")
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(found) + 1] if len(found) else np.zeros(1, np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends[bounds].astype(np.int32)), data])


class PieceEncoder:
    """Texts to ids through the sentencepiece model of one rank file, pre-token by pre-token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.pattern = regex.compile(pattern)
        self.texts = TextEncoder(self._encode_many)
        self._mapped = [chr(_SHIFT + b) for b in range(256)]

    def _encode_many(self, chunks: list[str]) -> list[bytes]:
        mapped = self._mapped
        split = [self.pattern.findall(c) for c in chunks]
        pretokens = list(dict.fromkeys(t for tokens in split for t in tokens))
        encoded = self.model.encode(["".join([mapped[b] for b in t.encode()]) for t in pretokens], num_threads=1)
        known = {t: struct.pack(f"<{len(ids)}I", *[i - 1 for i in ids]) for t, ids in zip(pretokens, encoded, strict=True)}
        return [b"".join([known[t] for t in tokens]) for tokens in split]

    def encode(self, texts: list[str | None] | pa.Array) -> pa.BinaryArray:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.texts.encode(texts)


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(read_ranks(ranks_path), pattern)


@functools.lru_cache(maxsize=2)
def decoder(ranks_path: str) -> PieceDecoder:
    return PieceDecoder(read_ranks(ranks_path))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Adds (or replaces) a binary column of little-endian unsigned 32-bit ids.

    With `decoded_col` the same pass also decodes the ids, so a round trip needs one Python worker a core.
    """
    added = [ids_col] if decoded_col is None else [ids_col, decoded_col]
    fields = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*fields, *[T.StructField(c, T.BinaryType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch in sliced(batches, 10_000, text_col, 4 << 20):
            table = {f.name: batch.column(f.name) for f in fields}
            table[ids_col] = own.encode(batch.column(text_col))
            if decoded_col is not None:
                table[decoded_col] = decoder(ranks_path).decode(table[ids_col])
            yield pa.RecordBatch.from_pydict(table)

    return docs.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds (or replaces) a binary column of the bytes that the ids stand for; null ids are empty."""
    fields = [f for f in encoded.schema.fields if f.name != bytes_col]
    schema = T.StructType([*fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(ranks_path)
        for batch in sliced(batches, 10_000, ids_col):
            table = {f.name: batch.column(f.name) for f in fields}
            table[bytes_col] = own.decode(pc.fill_null(batch.column(ids_col), b""))
            yield pa.RecordBatch.from_pydict(table)

    return encoded.mapInArrow(tidy(run), schema)
