"""Pair counts over a stream, with a warm start: the past comes as a batch table of counts, without replay.

Pairs are dealt by hash into a fixed number of groups, and a group is one state, so that a trigger pays the round trip to
the state store once a group, not once a pair. A pair has two counts, and its transfers of the last `late_us` (of the last
instant, without), so that neither a transfer of the same instant nor a later one is seen. It stays for good, as the
counts have no window. The state store has to be RocksDB: `spark.sql.streaming.stateStore.providerClass`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "row_pos long, bh_pair_n_prior long, bh_reverse_pair_n_prior long"
#: A group's pairs with their counts, and the transfers that are kept, each with the place of its pair.
STATE = "pairs array<string>, n_low array<long>, n_all array<long>, recent array<int>, times array<long>, lows array<boolean>"
#: Groups of pairs; a checkpoint keeps the number that it began with.
GROUPS = 4096


class _Pairs(StatefulProcessor):
    def __init__(self, late_us: int) -> None:
        self.late_us = late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pairs", STATE)

    def _held(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pairs, *rest = self.state.get() if self.state.exists() else ([],) * 6
        return list(pairs), *(np.asarray(x, kind) for x, kind in zip(rest, ("int64", "int64", "int64", "int64", bool), strict=True))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        pairs, n_low, n_all, *recent = self._held()  # a group may come in several frames
        code, names = pd.factorize(np.asarray([*pairs, *initialState["pair"]], object))
        add = lambda held, c: np.bincount(code, np.concatenate([held, initialState[c].to_numpy("int64")]), len(names)).astype("int64")
        self.state.update((names.tolist(), add(n_low, "n_low").tolist(), add(n_all, "n_all").tolist(), *(x.tolist() for x in recent)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        pairs, n_low, n_all, recent, times, lows = self._held()
        new = pd.concat(list(rows))
        known = len(pairs)
        code, names = pd.factorize(np.asarray([*pairs, *new["pair"]], object))  # pairs held keep their places
        fresh = np.zeros(len(names) - known, "int64")
        n_low, n_all = np.concatenate([n_low, fresh]), np.concatenate([n_all, fresh])
        pair, t = np.concatenate([recent, code[known:]]), np.concatenate([times, new["t_us"].to_numpy("int64")])
        low = np.concatenate([lows, new["low_first"].to_numpy(bool)])
        order = np.lexsort((t, pair))
        pair, t, low = pair[order], t[order], low[order]
        opens = np.append(True, (pair[1:] != pair[:-1]) | (t[1:] != t[:-1]))
        before = np.maximum.accumulate(np.where(opens, np.arange(len(t)), 0))  # the first row of the instant
        start, end = np.searchsorted(pair, pair, "left"), np.searchsorted(pair, pair, "right")
        seen = np.concatenate([[0], np.cumsum(low)])
        counts = np.empty((2, len(t)), "int64")
        counts[:, order] = n_low[pair] + seen[before] - seen[start], n_all[pair] + before - start  # strictly earlier
        as_low, every = counts[:, len(recent) :]
        same = np.where(new["low_first"].to_numpy(bool), as_low, every - as_low)
        yield pd.DataFrame({"row_pos": new["row_pos"].to_numpy("int64"), "bh_pair_n_prior": same, "bh_reverse_pair_n_prior": np.where(new["own"], same, every - same)})
        settled = t < t[end - 1] - self.late_us
        n_all = n_all + np.bincount(pair[settled], minlength=len(names))
        n_low = n_low + np.bincount(pair[settled & low], minlength=len(names))
        kept = (x[~settled].tolist() for x in (pair, t, low))
        self.state.update((names.tolist(), n_low.tolist(), n_all.tolist(), *kept))

    def close(self) -> None:
        pass


def _keyed(tx: DataFrame) -> DataFrame:
    """Transfers by unordered pair, with the direction and whether both ends are one account; no pair where an end is unknown."""
    s, d = F.col("source_account"), F.col("destination_account")
    known = tx.filter(s.isNotNull() & d.isNotNull())
    return known.select(F.least(s, d).alias("a"), F.greatest(s, d).alias("b"), "row_pos", "t_us", (s <= d).alias("low_first"), (s == d).alias("own"))


def past_counts(tx: DataFrame) -> DataFrame:
    """What a stream starts from: each pair's transfers so far, by direction; a plain aggregation, combined before its shuffle."""
    return _keyed(tx).groupBy("a", "b").agg(F.count_if("low_first").alias("n_low"), F.count("*").alias("n_all"))


def _grouped(df: DataFrame, groups: int) -> GroupedData:
    """By group of pairs; `pair` is one string, in which the length of the first name tells where the second begins."""
    group = F.pmod(F.xxhash64("a", "b"), F.lit(groups)).cast("int").alias("group")
    pair = F.concat_ws("|", F.length("a").cast("string"), "a", "b").alias("pair")
    return df.select(group, pair, *[c for c in df.columns if c not in ("a", "b")]).groupBy("group")


def pair_history(stream: DataFrame, past: DataFrame | None = None, late_us: int = 0, groups: int = GROUPS) -> DataFrame:
    """(row_pos, bh_pair_n_prior, bh_reverse_pair_n_prior) of each transfer, equal to the batch columns.

    `past` is a table of `past_counts` over transfers before the stream's first; it is read when the query starts for the
    first time and ignored when it resumes from a checkpoint. An event later than others by up to `late_us` is counted
    from its own time. A group's state and its transfers of one micro-batch are in memory together: `groups`, and the
    trigger's size, bound them.
    """
    initial = None if past is None else _grouped(past.select("a", "b", "n_low", "n_all"), groups)
    return _grouped(_keyed(stream), groups).transformWithStateInPandas(_Pairs(late_us), OUTPUT, "append", "None", initial)
