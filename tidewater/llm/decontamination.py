"""Benchmark decontamination: an FM-index per training shard, searched for every benchmark window.

A task turns its documents into shards of bounded size. Word ids come from the benchmark's vocabulary;
a word outside it, or a run of inside words shorter than the shortest window, cannot take part in any
occurrence and becomes a separator before the index is built, so the index stays exact and small.
Occurrences are located, widened to word spans and merged per document.

The benchmark is read in blocks of at most `block_chars` characters, a bound that holds for what is
broadcast at a time; each block is one more narrow pass over the documents.

Defined results: null or empty texts have no words and no spans; benchmark texts without words have no
window; an item with fewer words than a window is one window; repeated documents and repeated items are
each judged alike; empty tables give empty results or no spans; other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from tidewater.llm.common import sliced, tidy
from tidewater.llm.fm_index import FMIndex

WINDOW = 10
#: A-Z fold to a-z, digits and all bytes from 0x80 stay, anything else separates words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class WindowSet:
    """Distinct windows of a block of items as padded id rows, and the items that own each."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    owners: list[list]

    @classmethod
    def of(cls, items: list[tuple], window: int = WINDOW) -> WindowSet:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(item)
        lengths = np.array([len(p) for p in owners], np.int64)
        patterns = np.zeros((len(owners), int(lengths.max(initial=1))), np.int64)
        for row, p in enumerate(owners):
            patterns[row, : len(p)] = p
        return cls(vocabulary, patterns, lengths, [sorted(x, key=str) for x in owners.values()])


def _search_shard(ids: list[np.ndarray], windows: WindowSet) -> tuple[list[list[tuple[int, int]]], list[set]]:
    """Merged word spans and owning items of each document of a shard."""
    spans: list[list[tuple[int, int]]] = [[] for _ in ids]
    items: list[set] = [set() for _ in ids]
    if not len(windows.lengths) or not ids:
        return spans, items
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in ids])))
    flat = np.zeros(int(starts[-1]), np.int64)
    for at, x in zip(starts, ids, strict=False):
        flat[at : at + len(x)] = x
    # keep runs of vocabulary words that could hold the shortest window, each closed by one separator
    inside = np.concatenate(([0], (flat > 0).astype(np.int8), [0]))
    edges = np.diff(inside)
    run_at, run_end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long_enough = run_end - run_at >= windows.lengths.min()
    run_at, run_end = run_at[long_enough], run_end[long_enough]
    if not len(run_at):
        return spans, items
    mark = np.zeros(len(flat) + 1, np.int32)
    np.add.at(mark, run_at, 1)
    np.add.at(mark, run_end + 1, -1)
    origin = np.flatnonzero(np.cumsum(mark[:-1]) > 0)  # the position after each run is a separator in `flat`
    text = flat[origin]
    text[np.isin(origin, run_end, assume_unique=True)] = 0
    index = FMIndex(text, len(windows.vocabulary))
    low, high = index.search(windows.patterns, windows.lengths)
    hit = np.flatnonzero(low < high)
    if not len(hit):
        return spans, items
    counts = (high - low)[hit]
    which = np.repeat(hit, counts)
    rows = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = origin[index.locate(rows)]
    doc = np.searchsorted(starts, at, side="right") - 1
    for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
        items[d].update(windows.owners[p])
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + windows.lengths[which], -1)
    edges = np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        d = int(np.searchsorted(starts, a, side="right") - 1)
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    return spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching or overlapping spans become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def annotate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_chars: int = 32_000_000,
    shard_words: int = 4_000_000, prefix: str = "__",
) -> DataFrame:
    """Adds `__n_words` (long), `__spans` (merged word spans hit) and `__items` (ids of items hit, as strings).

    Columns that have these names are replaced; another `prefix` keeps them.
    """
    n_words, spans_col, items_col = (prefix + n for n in ("n_words", "spans", "items"))
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    out = docs.withColumns(
        {
            n_words: F.lit(0).cast("long"),
            spans_col: F.array().cast("array<struct<start:long,end:long>>"),
            items_col: F.array().cast("array<string>"),
        }
    )
    for block in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else bench
        shared = spark.sparkContext.broadcast(WindowSet.of([(r.item or "", r.text) for r in part.collect()], window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            get = windows.vocabulary.get
            held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []

            def flush() -> Iterator[pa.RecordBatch]:
                spans, items = _search_shard([x for _, ids in held for x in ids], windows)
                k = 0
                for batch, ids in held:
                    m = len(ids)
                    table = {n: batch.column(n) for n in batch.schema.names}
                    old_spans, old_items = table[spans_col].to_pylist(), table[items_col].to_pylist()
                    table[n_words] = pa.array([len(x) for x in ids], pa.int64())
                    joined = [
                        [{"start": a, "end": b} for a, b in merge([(s["start"], s["end"]) for s in old] + new)]
                        for old, new in zip(old_spans, spans[k : k + m], strict=True)
                    ]
                    table[spans_col] = pa.array(joined, _SPANS)
                    listed = [sorted({*old, *new}) for old, new in zip(old_items, items[k : k + m], strict=True)]
                    table[items_col] = pa.array(listed, pa.list_(pa.string()))
                    k += m
                    yield pa.RecordBatch.from_pydict(table)
                held.clear()

            size = 0
            for batch in sliced(batches, 4096, text_col):
                ids = []
                for t in batch.column(text_col).to_pylist():
                    w = words(t)
                    ids.append(np.fromiter((get(x, 0) for x in w), np.int32, len(w)))
                held.append((batch, ids))
                size += sum(map(len, ids)) + batch.num_rows
                if size >= shard_words:
                    yield from flush()
                    size = 0
            if held:
                yield from flush()

        out = out.mapInArrow(tidy(run), out.schema)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with every hit span cut from the text; all columns and rows stay."""
    names, prefix = docs.columns, "__"
    while any(c.lower() in (f"{prefix}n_words", f"{prefix}spans", f"{prefix}items") for c in names):
        prefix += "_"
    marked = annotate(docs, benchmark, text_col, window, prefix=prefix)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096, text_col):
            texts = batch.column(text_col).to_pylist()
            for row, spans in enumerate(batch.column(f"{prefix}spans").to_pylist()):
                if spans:
                    raw = texts[row].encode()
                    at = [m.span() for m in _WORD.finditer(raw)]
                    kept, last = [], 0
                    for s in spans:
                        kept.append(raw[last : at[s["start"]][0]])
                        last = at[s["end"] - 1][1]
                    texts[row] = b"".join([*kept, raw[last:]]).decode()
            table = {n: batch.column(n) for n in names}
            table[text_col] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(table)

    return marked.mapInArrow(tidy(cut), docs.schema)
