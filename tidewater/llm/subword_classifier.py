"""Quality classifier: supervised subword embeddings, averaged per document, softmax output.

A document's features are its hashed words, its hashed pairs of adjacent words, and its hashed character
n-grams. Each feature has a learnt vector; a document is the mean of its features' vectors; a linear layer and
a softmax give the class. Training is plain numpy stochastic gradient descent over a bounded sample, done
again at a quarter of the rate should it diverge. As the mean and the layer are linear, scoring gathers one
number a feature.

Defined results: null and empty texts have no features and get the softmax of the biases; repeated rows score
alike; without labels of both kinds every score is 0.5; scores are always finite; an empty table gives an
empty result; other columns pass through, and a column with the score's name is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import tidy
from pyspark.sql import types as T


@dataclass(frozen=True)
class SubwordSpec:
    """Three tables of 2**bits vectors: words, pairs of words, character n-grams."""

    bits: int = 16
    grams: tuple[int, ...] = (3, 4)
    dim: int = 8
    epochs: int = 8
    rate: float = 0.5
    seed: int = 7


_MUL = np.uint32(2654435761)


def features(text: str | None, spec: SubwordSpec) -> np.ndarray:
    """Feature slots of a text: words in the first table, pairs of adjacent words in the second, character n-grams in the third."""
    text = text or ""
    shift, size = np.uint32(32 - spec.bits), np.uint32(1 << spec.bits)
    words = text.encode().split()
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) * _MUL
    out = [h >> shift, size + (((h[:-1] * np.uint32(31) + h[1:]) * _MUL) >> shift)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    for n in spec.grams:
        if len(codes) >= n:
            g = np.full(len(codes) - n + 1, n, np.uint32)
            for i in range(n):
                g = g * np.uint32(16777619) + codes[i : len(codes) - n + 1 + i]
            out.append(2 * size + ((g * _MUL) >> shift))
    return np.concatenate(out).astype(np.int64)


@dataclass
class SubwordModel:
    spec: SubwordSpec
    #: one number a slot: the difference of the two classes' logits that its vector contributes
    slots: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        f = features(text, self.spec)
        logit = self.bias + (float(self.slots[f].mean()) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def train(rows: list[tuple[str, int]], spec: SubwordSpec | None = None) -> SubwordModel:
    """Stochastic gradient descent, one document a step, with a linearly falling rate."""
    spec = spec or SubwordSpec()
    if len({y for _, y in rows}) < 2:
        return SubwordModel(spec, np.zeros(3 << spec.bits, np.float32), 0.0)
    held = []
    for text, y in rows:
        f = features(text, spec)
        slot, count = np.unique(f, return_counts=True)
        held.append((slot.astype(np.int32), (count / max(1, len(f))).astype(np.float32), int(y)))
    rate = spec.rate
    while True:
        slots, bias = _descend(held, spec, rate)
        if np.isfinite(slots).all() and np.isfinite(bias):
            return SubwordModel(spec, slots, bias)
        rate /= 4


def _descend(held: list[tuple[np.ndarray, np.ndarray, int]], spec: SubwordSpec, first_rate: float) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(spec.seed)
    vectors = rng.uniform(-1 / spec.dim, 1 / spec.dim, (3 << spec.bits, spec.dim)).astype(np.float32)
    layer, bias = np.zeros((2, spec.dim), np.float32), np.zeros(2, np.float32)
    steps, done = spec.epochs * len(held), 0
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(spec.epochs):
            for k in rng.permutation(len(held)):
                slot, share, y = held[k]
                rate = first_rate * (1 - done / steps)
                done += 1
                hidden = share @ vectors[slot]
                logits = layer @ hidden + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[y] -= 1
                back = layer.T @ p
                layer -= rate * np.outer(p, hidden)
                bias -= rate * 0.1 * p
                # the mean's gradient, scaled as if every feature took a full step of its share
                vectors[slot] -= (rate * spec.dim * 10) * np.outer(share, back)
            if not np.isfinite(layer).all():
                break
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model: SubwordModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds (or replaces) the score column: the probability of label 1."""
    fields = [f for f in docs.schema.fields if f.name != score_col]
    schema = T.StructType([*fields, T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            table = {f.name: batch.column(f.name) for f in fields}
            table[score_col] = pa.array([own.score(t) for t in batch.column(text_col).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_pydict(table)

    return docs.mapInArrow(tidy(run), schema)
