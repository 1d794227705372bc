"""Exact Shapley attributions of boosted trees (TreeSHAP's path-dependent values), in one pass over the rows.

A tree's leaf counts for a row as far as the row takes its path. For a set of known features the path's other splits
count by their cover, the share of training weight that went that way; the Shapley value of a feature is what it adds to
the leaf, averaged over all orders. For each leaf this is a small polynomial over the features of its path, evaluated for
a whole batch of rows at once. The values of a row and the bias add up to the trees' raw margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.columns import pattern_columns
from tidewater.session import shared_dir

BIAS = "bias"


@dataclass
class Leaf:
    """A leaf's weighted value, and for each feature of its path the interval (low, high] that leads on and its cover."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    cover: list[float]

    @property
    def expected(self) -> float:
        return self.value * math.prod(self.cover)


def leaves_of(model: GBTClassificationModel) -> list[Leaf]:
    """The leaves of all trees; categorical splits are refused, as the contract's columns are numbers.

    The nodes are read from the saved model: asking the JVM for each of a hundred deep trees takes longer than a pass over the rows.
    """
    spark = SparkSession.active()
    path = shared_dir(spark, "trees")
    model.write().save(path)
    nodes = {(r.treeID, r.id): r for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()}
    out: list[Leaf] = []

    def walk(tree: int, node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if node.leftChild < 0:
            names = list(path)
            low, high, cover = (list(x) for x in zip(*path.values(), strict=True)) if path else ([], [], [])
            out.append(Leaf(weight * node.prediction, names, low, high, cover))
            return
        if node.split.numCategories != -1:
            raise ValueError("only numeric splits are attributed")
        f, (at,) = node.split.featureIndex, node.split.leftCategoriesOrThreshold
        low, high, cover = path.get(f, (-math.inf, math.inf, 1.0))
        for child, a, b in ((node.leftChild, low, min(high, at)), (node.rightChild, max(low, at), high)):
            below = nodes[tree, child]
            walk(tree, below, weight, path | {f: (a, b, cover * below.impurityStats[0] / node.impurityStats[0])})  # the first is the rows' weight

    for tree, weight in enumerate(model.treeWeights):
        walk(tree, nodes[tree, 0], weight, {})
    return out


def shapley(x: np.ndarray, leaves: list[Leaf], n_features: int) -> np.ndarray:
    """(row, feature): the attributions of a batch of rows."""
    out = np.zeros((n_features, len(x)))
    for leaf in leaves:
        m = len(leaf.features)
        if not m or not leaf.value:
            continue
        takes = [((x[:, f] > a) & (x[:, f] <= b)).astype(float) for f, a, b in zip(leaf.features, leaf.low, leaf.high, strict=True)]
        share = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
        for i, f in enumerate(leaf.features):
            # coefficient k: the weight of the path when k of the other features are known
            known = [np.ones(len(x))]
            for j in range(m):
                if j != i:
                    nothing = np.zeros(len(x))
                    known = [leaf.cover[j] * a + takes[j] * b for a, b in zip([*known, nothing], [nothing, *known], strict=True)]
            out[f] += leaf.value * (takes[i] - leaf.cover[i]) * sum(w * c for w, c in zip(share, known, strict=True))
    return out.T


def contributions(df: DataFrame, model: GBTClassificationModel, columns: list[str], key: str = "transaction_id") -> DataFrame:
    """(key, one column a feature, bias): signed attributions of the raw margin; nulls are -1, as in scoring."""
    leaves = leaves_of(model)
    shared, bias = df.sparkSession.sparkContext.broadcast(leaves), sum(leaf.expected for leaf in leaves)
    filled = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in columns])
    schema = T.StructType([filled.schema[key], *[T.StructField(c, T.DoubleType()) for c in (*columns, BIAS)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in columns]) if batch.num_rows else np.zeros((0, len(columns)))
            made = shapley(x, shared.value, len(columns))
            arrays = [batch.column(key), *[pa.array(made[:, i]) for i in range(len(columns))], pa.array(np.full(len(x), bias))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return filled.mapInArrow(run, schema)


def labels(columns: list[str]) -> dict[str, str]:
    """What a reader is told for a column: the pattern columns' text, or the name."""
    known = dict(pattern_columns(("amount", "timestamp")))
    return {c: known.get(c, c) for c in columns}
