"""A bounded sample of labelled documents for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import crc_fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> list[tuple[str, int]]:
    """(text, label) of at most `max_rows` labelled documents outside the held-out fold, drawn by a hash of the id.

    The bound is the only thing that reaches the driver; the broadcast side of the join has as many ids.
    Null labels and ids are left out; repeated rows count as often as they stand, in the same order of hashes
    up to the bound, so the sample is the same on every run.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 2))
        .select(F.col("doc_id").alias("__lid"), F.col(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__lid"), "__lid", "__label")
        .limit(max_rows)
    )
    joined = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("__lid"))
    named = joined.select("__lid", "__label", F.coalesce("text", F.lit("")).alias("text"))
    rows = named.orderBy(F.xxhash64("__lid"), "__lid", "__label", F.xxhash64("text")).limit(max_rows).collect()
    return [(r.text, r["__label"]) for r in sorted(rows, key=lambda r: (r["__lid"], r["__label"], r.text))]
