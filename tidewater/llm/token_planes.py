"""Token ids as files: bit-plane shuffled blocks, each plane compressed with zstandard, and a chunk index.

Documents are dealt by ranges of their id and sorted, so shard files in order of their number hold the corpus
in ascending id order. A task writes one shard, block by block, under a temporary name and renames it when
complete; a repeated attempt writes the same bytes to the same name. Shards live in a folder that driver and
executors share.

File: MAGIC; blocks (planes back to back); index (one zstandard frame of JSON and arrays); its offset, its
size, MAGIC. A block has `block` ids (the last one fewer); bit b of all its ids is plane b. The index has each
block's offset, id count and plane sizes, and the documents' ids and lengths.

Defined results: a null text is empty and has only the end id; null document ids sort first; repeated ids are
ordered by text; an empty table writes no shard and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import sliced, tidy
from tidewater.llm.pieces import TextEncoder

MAGIC = b"TWPLANE1"
BLOCK = 1 << 16
_NULL = -(1 << 63)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and path for a folder that Spark names by URI or by local path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


# --- blocks -------------------------------------------------------------------------------------


def pack_block(ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> list[bytes]:
    """The block's bit planes, lowest bit first, each compressed; as many as the largest id needs."""
    n_planes = max(1, int(ids.max(initial=0)).bit_length())
    n_bytes = -(-n_planes // 8)
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :n_bytes]
    bits = np.unpackbits(np.ascontiguousarray(raw), axis=1, bitorder="little")[:, :n_planes]
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return [compressor.compress(p.tobytes()) for p in planes]


def unpack_block(planes: list[bytes], n_ids: int, decompressor: zstandard.ZstdDecompressor) -> np.ndarray:
    size = -(-n_ids // 8)
    packed = np.frombuffer(b"".join(decompressor.decompress(p, max_output_size=size) for p in planes), np.uint8)
    bits = np.unpackbits(packed.reshape(len(planes), size), axis=1, count=n_ids, bitorder="little")
    raw = np.zeros((n_ids, 4), np.uint8)
    n_bytes = -(-len(planes) // 8)
    padded = np.zeros((8 * n_bytes, n_ids), np.uint8)
    padded[: len(planes)] = bits
    raw[:, :n_bytes] = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little")
    return raw.view("<u4").ravel()


class ShardWriter:
    """Streams documents into one shard; at most one block of ids is held."""

    def __init__(self, out, block: int = BLOCK, level: int = 3) -> None:
        self.out, self.block = out, block
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC) and len(MAGIC)
        self.blocks: list[list[int]] = []
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_many([doc_id], ids, np.array([len(ids)]))

    def add_many(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents in order: their ids back to back, and how many each has."""
        self.doc_ids += [_NULL if d is None else d for d in doc_ids]
        self.lengths += lengths.tolist()
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(flat) if last else len(flat) // self.block * self.block
        for a in range(0, end, self.block):
            part = flat[a : min(a + self.block, end)]
            planes = pack_block(part, self.compressor)
            self.blocks.append([self.at, len(part), *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.held, self.n_held = [flat[end:]], len(flat) - end

    def close(self) -> int:
        self._flush(last=True)
        head = json.dumps({"block": self.block, "blocks": self.blocks, "docs": len(self.doc_ids)}).encode()
        body = struct.pack("<Q", len(head)) + head + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()
        index = self.compressor.compress(body)
        self.out.write(index + struct.pack("<QQ", self.at, len(index)) + MAGIC)
        return sum(self.lengths)


class ShardReader:
    """Random access to a shard: documents by position, reading only the blocks they touch."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail = struct.calcsize("<QQ") + len(MAGIC)
        end = source.read_at(tail, size - tail)
        if source.read_at(len(MAGIC), 0) != MAGIC or end[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a complete shard")
        at, n = struct.unpack("<QQ", end[:16])
        self.decompressor = zstandard.ZstdDecompressor()
        body = self.decompressor.decompressobj().decompress(source.read_at(n, at))
        (n_head,) = struct.unpack_from("<Q", body)
        head = json.loads(body[8 : 8 + n_head])
        self.blocks, n_docs = head["blocks"], head["docs"]
        self.doc_ids = np.frombuffer(body, "<i8", n_docs, 8 + n_head)
        self.lengths = np.frombuffer(body, "<u8", n_docs, 8 + n_head + 8 * n_docs).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        at, n_ids, *sizes = self.blocks[k]
        raw = self.source.read_at(sum(sizes), at)
        planes, a = [], 0
        for s in sizes:
            planes.append(raw[a : a + s])
            a += s
        return unpack_block(planes, n_ids, self.decompressor)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, ids) in file order, holding one block and the current document."""
        rest, k = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.doc_ids.tolist(), self.lengths.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            flat = np.concatenate(parts) if len(parts) > 1 else rest
            yield None if doc_id == _NULL else doc_id, flat[:n]
            rest = flat[n:]


# --- tokenizer ------------------------------------------------------------------------------------


class ChunkEncoder:
    """A tokenizers-library encoder that meets a distinct piece once while a memo holds it.

    Texts that hold the string of an added token go to the library whole, in its default call; with
    `special_as_text` such strings are ordinary text. Tokenizers that don't cut by the byte-level pattern
    encode whole texts.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.texts = TextEncoder(self._encode_many) if plain and not spec.get("normalizer") else None
        self.added = [t["content"] for t in spec.get("added_tokens") or [] if not (special_as_text and t.get("special"))]

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encoded]

    def encode(self, texts: list[str | None] | pa.Array) -> pa.BinaryArray:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = np.full(len(column), self.texts is None)
        for token in self.added:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.texts.encode(column)
        rest, apart = np.flatnonzero(~whole), np.flatnonzero(whole)
        parts = [pa.array(self._encode_many(column.take(pa.array(apart)).to_pylist()), pa.binary())]
        if len(rest):
            parts.append(self.texts.encode(column.take(pa.array(rest))))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate((apart, rest)), kind="stable")))


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str, special_as_text: bool = False) -> ChunkEncoder:
    return ChunkEncoder(path, special_as_text)


# --- the operator -----------------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", block: int = BLOCK) -> list[dict]:
    """Encodes and writes all documents; returns one manifest entry a shard (number, documents, ids), in order."""
    dealt = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = TaskContext.get().partitionId(), chunk_encoder(tokenizer_path)
        fs, root = open_folder(folder)
        draft, writer, out, n_docs = f"{root}/.draft-{number:06d}-{uuid.uuid4().hex}", None, None, 0
        for batch in batches:
            if batch.num_rows and writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(draft)
                writer = ShardWriter(out, block)
            for part in sliced([batch], 10_000, "text"):
                encoded = own.encode(part.column("text"))
                lengths = pc.binary_length(encoded).to_numpy() // 4
                flat = np.frombuffer(b"".join(encoded.to_pylist()), "<u4")
                writer.add_many(part.column("id").to_pylist(), np.insert(flat, np.cumsum(lengths), end_id), lengths + 1)
                n_docs += part.num_rows
        if writer is not None:
            n_ids = writer.close()
            out.close()
            fs.move(draft, f"{root}/shard-{number:06d}.planes")
            yield pa.RecordBatch.from_pydict({"shard": [number], "docs": [n_docs], "ids": [n_ids]},
                                             schema=pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    manifest = dealt.mapInArrow(tidy(run), "shard long, docs long, ids long")
    return [r.asDict() for r in sorted(manifest.collect(), key=lambda r: r.shard)]


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def read_shards(spark: SparkSession, folder: str, manifest: list[dict], with_ids: bool = True) -> DataFrame:
    """One row a document, from the files: where its ids start in the corpus, how many, their crc32, and the ids."""
    if not manifest:
        return spark.createDataFrame([], READ_SCHEMA if with_ids else READ_SCHEMA.rpartition(",")[0])
    base, entries = 0, []
    for m in manifest:
        entries.append((m["shard"], base))
        base += m["ids"]
    schema = _READ if with_ids else _READ.remove(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                shard, start = entries[k]
                with fs.open_input_file(f"{root}/shard-{shard:06d}.planes") as source:
                    rows: list[tuple] = []
                    size = 0
                    for doc_id, ids in ShardReader(source).documents():
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw))
                        start += len(ids)
                        size += len(raw)
                        if size > 8_000_000:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, schema)

    out = READ_SCHEMA if with_ids else READ_SCHEMA.rpartition(",")[0]
    return spark.range(0, len(entries), 1, len(entries)).mapInArrow(tidy(run), out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
    )
