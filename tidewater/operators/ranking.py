"""Ranks, cascades, ensembles, subjects and bootstrap intervals over score tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.metrics import budget_size, flag_top
from tidewater.operators.quantiles import quantiles
from tidewater.session import global_position


def rank(df: DataFrame, score: str = "score", raw: str | None = None) -> DataFrame:
    """Adds `rank` from 1: by score, then raw score, then row position; dealt over ranges of the score."""
    order = [(score, False), *([(raw, False)] if raw else []), ("row_pos", True)]
    return global_position(df, order, "rank").withColumn("rank", F.col("rank") + 1)


def rank01(df: DataFrame, score: str, name: str) -> DataFrame:
    """Adds the 0..1 rank of a score, ties by row position."""
    n = df.count()
    placed = global_position(df, [(score, True), ("row_pos", True)], name)
    return placed.withColumn(name, F.col(name) / F.lit(max(n - 1, 1)))


def cascade(df: DataFrame, tier0: str, tier1: str, share: float = 0.05) -> DataFrame:
    """Adds `selected` and `combined`: rejected rows in [0, 0.5) by tier 0, kept rows in [0.5, 1] by tier 1."""
    if not 0 < share <= 1:
        raise ValueError("the share must lie in (0, 1]")
    marked = flag_top(df, share, tier0).withColumnRenamed("flagged", "selected")
    low = rank01(marked.filter("NOT selected"), tier0, "__r").withColumn("combined", F.col("__r") * 0.5)
    high = rank01(marked.filter("selected"), tier1, "__r").withColumn("combined", 0.5 + F.col("__r") * 0.5)
    return low.unionByName(high).drop("__r")


def cascade_throughput(rate0: float, rate1: float, share: float) -> float:
    return 1 / (1 / rate0 + share / rate1)


def rank_ensemble(df: DataFrame, a: str, b: str, weight: float = 0.5) -> DataFrame:
    """Adds `ensemble`: the weighted mean of two scores' ranks."""
    both = rank01(rank01(df, a, "__ra"), b, "__rb")
    return both.withColumn("ensemble", F.col("__ra") * weight + F.col("__rb") * (1 - weight)).drop("__ra", "__rb")


def subjects(ranked: DataFrame, n: int = 10, alert: str = "alert") -> DataFrame:
    """One case an account, best rank first, alerts only, at most n."""
    best = Window.partitionBy("source_account").orderBy("rank")
    firsts = ranked.filter(alert).withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")
    return firsts.orderBy("rank").limit(n)


def top_reasons(contributions: DataFrame, features: list[str], k: int = 3, labels: dict[str, str] | None = None) -> DataFrame:
    """(transaction_id, top_features): the k largest positive contributions of each row as text, under their labels."""
    labels = labels or {}
    pairs = F.array(*[F.struct((-F.col(f)).alias("neg"), F.lit(labels.get(f, f)).alias("f")) for f in features])
    best = F.slice(F.array_sort(F.filter(pairs, lambda x: x["neg"] < 0)), 1, k)
    return contributions.select("transaction_id", F.array_join(F.transform(best, lambda x: F.format_string("%s (+%.3f)", x["f"], -x["neg"])), "; ").alias("top_features"))


#: Fixed values of the replicate weights: a 32-bit mixer's steps and factor, and the distribution function of Poisson(1).
_STEP, _FACTOR = 2654435769, 73244475
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8))


def replicate_weights(unit: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(unit, 1 + replicates): how often each unit is drawn; replicate 0 is the data as they are.

    Poisson(1) weights from a hash of unit, replicate and seed: the same wherever a row is, and for both arms.
    """
    low = np.uint64(0xFFFFFFFF)
    x = (unit.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(_STEP) + np.uint64(seed)) & low
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(_FACTOR)) & low
    x ^= x >> np.uint64(16)
    drawn = np.searchsorted(np.array(POISSON), x.astype(float) / 2.0**32, side="right")
    return np.concatenate((np.ones((len(unit), 1), np.int64), drawn), axis=1)


def bootstrap(df: DataFrame, a: str, b: str, label: str, unit: str, replicates: int = 2000, seed: int = 11, parts: int = 32, block: int = 512) -> DataFrame:
    """One row: average precision of two scores of the same units, their difference, and 95 % percentile intervals.

    `df` has a row a unit (an account). Every replicate draws the units for both scores at once, so the difference is
    paired; replicates with fewer than two positives are left out. Rows are dealt by ranges of the score and sorted; one
    pass sums up the ranges' weights, the next walks each range in blocks of (row, replicate) weights from what precedes it.
    To the driver go `parts` rows a score, of one number a replicate.
    """
    cuts = quantiles(df, {c: [i / parts for i in range(1, parts)] for c in (a, b)})
    key = F.conv(F.substring(F.md5(F.col(unit).cast("string")), 1, 8), 16, 10).cast("long")

    def arm(k: int, c: str):
        part = F.lit(0)
        for e in sorted(set(cuts[c] or [])):
            part = part + F.when(F.col(c) < e, 1).otherwise(0)
        return F.struct(F.lit(k).alias("arm"), part.alias("part"), F.col(c).cast("double").alias("s"), F.col(label).cast("long").alias("y"), key.alias("u"))

    tall = df.select(F.explode(F.array(arm(0, a), arm(1, b))).alias("x")).select("x.*")
    dealt = tall.repartition("arm", "part").sortWithinPartitions("arm", "part", F.desc("s"))

    def walk(batches: Iterator[pa.RecordBatch], before: dict | None) -> Iterator[pa.RecordBatch]:
        """Sums of weights of each range, or with those of the ranges before it, its part of the average precision."""
        held: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                arms, of, s, y, u = (rows.column(c).to_numpy() for c in ("arm", "part", "s", "y", "u"))
                w = replicate_weights(u, replicates, seed)
                edge = np.flatnonzero((np.diff(arms) != 0) | (np.diff(of) != 0)) + 1
                for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(s)], strict=True):
                    k = (int(arms[lo]), int(of[lo]))
                    if k not in held:
                        n0, t0 = before.get(k, (0, 0)) if before is not None else (0, 0)
                        held[k] = [np.zeros(replicates + 1, np.int64) + n0, np.zeros(replicates + 1, np.int64) + t0, np.zeros(replicates + 1), None, 0]
                    state, wk = held[k], w[lo:hi]
                    if before is None:
                        state[0] += wk.sum(axis=0)
                        state[1] += (wk * y[lo:hi, None]).sum(axis=0)
                        continue
                    # [rows so far, hits so far, precision so far, open score, its hits]
                    for i in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(s[lo:hi])) + 1):
                        if state[3] is not None and s[i[0]] != state[3]:
                            _close(state)
                        hits = (w[i] * y[i, None]).sum(axis=0)
                        state[0] += w[i].sum(axis=0)
                        state[1] += hits
                        state[3], state[4] = s[i[0]], state[4] + hits
        for (k, p), state in held.items():
            if before is None:
                yield pa.RecordBatch.from_pydict({"arm": [k], "part": [p], "n": [state[0].tolist()], "tp": [state[1].tolist()]})
            else:
                _close(state)
                yield pa.RecordBatch.from_pydict({"arm": [k], "ap": [state[2].tolist()]})

    sums = dealt.mapInArrow(lambda x: walk(x, None), "arm long, part long, n array<long>, tp array<long>").collect()
    before, totals = {}, {}
    for k in (0, 1):
        n, tp = np.zeros(replicates + 1, np.int64), np.zeros(replicates + 1, np.int64)
        for r in sorted((r for r in sums if r.arm == k), key=lambda r: r.part):
            before[k, r.part] = (n, tp)
            n, tp = n + np.array(r.n), tp + np.array(r.tp)
        totals[k] = (n, tp)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(before)
    ap = np.zeros((2, replicates + 1))
    for r in dealt.mapInArrow(lambda x: walk(x, shared.value), "arm long, ap array<double>").collect():
        ap[r.arm] += r.ap
    positives = totals[0][1]
    ap = ap / np.maximum(positives, 1)
    used = np.flatnonzero(positives[1:] >= 2) + 1
    spread = lambda x: [float(v) for v in np.percentile(x[used], [2.5, 97.5])] if len(used) else [None, None]
    delta = ap[1] - ap[0]
    point = lambda x: float(x[0]) if positives[0] else None
    row = [int(totals[0][0][0]), int(positives[0]), len(used), point(ap[0]), *spread(ap[0]), point(ap[1]), *spread(ap[1]), point(delta), *spread(delta), float((delta[used] > 0).mean()) if len(used) else None]
    names = "n long, positives long, replicates long, a double, a_low double, a_high double, b double, b_low double, b_high double, delta double, delta_low double, delta_high double, favouring_b double"
    return spark.createDataFrame([tuple(row)], names)


def _close(state: list) -> None:
    """Takes up the hits of the score just passed: recall step times precision."""
    state[2] += np.where(state[0] > 0, state[4] * state[1] / np.maximum(state[0], 1), 0.0)
    state[4] = 0


def hash_sample(df: DataFrame, n: int, key: str = "transaction_id", seed: int = 0) -> DataFrame:
    """n rows without replacement, the same whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key))), key).limit(n)


__all__ = ["bootstrap", "budget_size", "cascade", "cascade_throughput", "hash_sample", "rank", "rank01", "rank_ensemble", "subjects", "top_reasons"]
