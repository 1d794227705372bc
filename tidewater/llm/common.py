"""Small helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut, discard, shared_dir

__all__ = ["crc_fold", "cut", "discard", "forget", "let", "shared_dir", "sliced", "table", "tidy"]

#: Word separators of the length rules and the shingle join: space and the ASCII controls 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row, even where the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4; fold 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256, column: str | None = None, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a batch grows to stays small.

    With a text or binary `column`, a batch also ends where its values pass `size` bytes; one value may be larger.
    """
    for batch in batches:
        if column is None:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = min(rows, max(1, int(np.searchsorted(ends[at:], before + size, side="right"))))
            yield batch.slice(at, n)
            at += n


def forget(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of finished queries now, before a query that needs the disk."""
    gc.collect()
    spark._jvm.System.gc()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same batch function; at a task's end the Python worker, which Spark keeps, gives freed memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only some C libraries can
                ctypes.CDLL(None).malloc_trim(0)

    return tidied
