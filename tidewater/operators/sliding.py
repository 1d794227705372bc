"""One pass over each account's events in time order, for sums, distinct counts and order statistics of sliding windows.

Events are sorted by Spark and read in Arrow batches. A window sum is the difference of two prefix sums; a count of
distinct counterparties adds one where the last event with the same counterparty is older than the window and takes
one off where an event is not renewed in time; order statistics keep a window's values in sorted blocks. None of them
adds a window up again for each row, and what is kept between batches is the current account's last window.

Accounts of more than `HUB_ROWS` events are cut into slices of `SLICES` windows, so that a hub is spread over many tasks;
a slice also reads the events of the window before it. Other accounts are one slice.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import cut

#: Events of an account from which it is cut into slices, and the windows of a slice.
HUB_ROWS, SLICES = 4_000_000, 8
#: Rows taken up at a time, at least; more where a window holds more.
CHUNK = 1 << 16


def hubs(df: DataFrame, limit: int) -> DataFrame | None:
    """The accounts with more than `limit` events at either end, written; None without any.

    A table with fewer rows than half of that has none, which its row count tells.
    """
    if 2 * df.count() <= limit:
        return None
    ends = df.select(F.explode(F.array("source_account", "destination_account")).alias("account"))
    found = ends.groupBy("account").count().filter(F.col("count") > limit).select("account")
    return None if found.isEmpty() else cut(found, "hubs")


def mark_hubs(df: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Adds `src_hub` and `dst_hub`; Spark picks the join by the size of `hot`, which has a row a hub."""
    if hot is None:
        return df.withColumns({"src_hub": F.lit(False), "dst_hub": F.lit(False)})
    flag = lambda name: hot.select(F.col("account").alias(name), F.lit(True).alias(f"{name}_hot"))
    j = df.join(flag("source_account"), "source_account", "left").join(flag("destination_account"), "destination_account", "left")
    on = lambda name: F.coalesce(f"{name}_hot", F.lit(False))
    return j.withColumns({"src_hub": on("source_account"), "dst_hub": on("destination_account")}).drop("source_account_hot", "destination_account_hot")


def account_rows(df: DataFrame, width_us: int, carry: list[str], other: bool = False, ties: bool = False) -> DataFrame:
    """Both ends of each transfer, dealt by (account, slice), sorted by time: account, [other], is_out, [slice, live], t_us, row_pos.

    A hub's event in the last window of a slice is also read, not reported (`live`), by the next one. `ties` also orders
    the rows of an instant, by `row_pos`; `other` adds the counterparty.
    """
    length = SLICES * width_us
    hub = "src_hub" in df.columns

    def end(account: str, counterparty: str, out: bool, flag: str, ahead: int) -> Column:
        fields = [F.col(account).alias("account"), F.lit(out).alias("is_out")]
        if other:
            fields.append(F.col(counterparty).alias("other"))
        if hub:
            slice_ = F.when(F.col(flag), F.floor(F.col("t_us") / length).cast("long") + ahead).otherwise(F.lit(0).cast("long"))
            fields += [slice_.alias("slice"), F.lit(not ahead).alias("live")]
        return F.struct(*fields)

    two = (("source_account", "destination_account", True, "src_hub"), ("destination_account", "source_account", False, "dst_hub"))
    rows = [end(*e, 0) for e in two]
    if hub:
        reaches = F.pmod(F.col("t_us"), F.lit(length)) >= length - width_us
        rows += [F.when(F.col(e[3]) & reaches, end(*e, 1)) for e in two]
    carry = [c for c in carry if c != "t_us"]
    tall = df.select("row_pos", "t_us", *carry, F.explode(F.array(*rows)).alias("e"))
    tall = (tall.filter("e IS NOT NULL") if hub else tall).select("e.*", "t_us", "row_pos", *carry)
    keys = ["account", "slice"] if hub else ["account"]
    return tall.repartition(*keys).sortWithinPartitions(*keys, "t_us", *(["row_pos"] if ties else []))


class Frame:
    """A run of sorted rows with the bounds of their windows."""

    def __init__(self, table: pa.Table, known: int, width_us: int, last_out: int | None = None) -> None:
        self.table, self.width, self.known, self.earlier_out = table, width_us, known, last_out
        n = len(table)
        self.t = table.column("t_us").to_numpy()
        opens = np.ones(n, bool)
        if n > 1:
            opens[1:] = False
            for key in [table.column(c) for c in ("account", "slice") if c in table.column_names]:
                opens[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy()
        starts = np.flatnonzero(opens)
        self.group = np.cumsum(opens) - 1
        self.start = starts[self.group]
        # times since the group's first, shifted apart by group, are one sorted array
        since = self.t - self.t[self.start]
        step = np.concatenate(([0], np.cumsum(since[np.append(starts[1:], n) - 1] + width_us + 1)[:-1])) if n else starts
        self.key = since + step[self.group]
        self.out = table.column("is_out").to_numpy()
        fresh = np.arange(n) >= known
        self.emitted = np.flatnonzero(fresh & table.column("live").to_numpy() if "live" in table.column_names else fresh)

    def values(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def since(self, width_us: int) -> np.ndarray:
        """The first row of each row's window, which reaches back to t - width, that instant included."""
        return np.maximum(np.searchsorted(self.key, self.key - width_us, "left"), self.start)

    def instant(self) -> np.ndarray:
        """The first row of each row's instant."""
        return np.searchsorted(self.key, self.key, "left")

    def window_sum(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))
        return total[high] - total[low]

    def last_out(self, high: np.ndarray) -> np.ndarray:
        """The time of the account's last row as a sender before row `high`; NaN without one."""
        at = np.maximum.accumulate(np.where(self.out, np.arange(len(self.t)), -1))
        at = np.where(high > 0, at[high - 1], -1)
        found = np.where(at >= self.start, self.t[at].astype(float), np.nan)
        if self.known and self.earlier_out is not None:  # the first account went on from the rows before
            found = np.where((self.group == 0) & np.isnan(found), float(self.earlier_out), found)
        return found

    def out_before(self, row: int) -> int | None:
        """The last time as a sender of the last account, before a row of it that is kept for the next run."""
        begin = int(self.start[-1])
        outs = np.flatnonzero(self.out[begin:row])
        if len(outs):
            return int(self.t[begin + outs[-1]])
        return self.earlier_out if self.known and self.group[-1] == 0 else None

    def distinct(self, role: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many different counterparties the window up to each row holds, among rows of a role."""
        other = pc.dictionary_encode(self.table.column("other")).combine_chunks()
        other = (other.chunk(0) if isinstance(other, pa.ChunkedArray) else other).indices.to_numpy()
        at = np.flatnonzero(role)
        order = at[np.lexsort((at, other[at], self.group[at]))]
        follows = (self.group[order[1:]] == self.group[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
        renewed = follows & (self.key[order[1:]] - self.key[order[:-1]] <= self.width)
        enters, leaves = np.zeros(len(self.t), np.int64), np.zeros(len(self.t), np.int64)
        enters[order] = 1
        enters[order[1:][renewed]] = 0
        leaves[order] = 1
        leaves[order[:-1][renewed]] = 0
        inside = self.window_sum(enters, self.start, np.arange(1, len(self.t) + 1))
        return inside - self.window_sum(leaves, self.start, low)


def before(df: DataFrame, keys: list[str], sums: list[str], hot: Column | None, length_us: int) -> DataFrame:
    """Adds what strictly earlier rows of the same keys sum up to, over all time.

    Rows that are `hot` are summed inside time slices, and what came before a slice is joined to it.
    """
    slice_ = F.lit(0).cast("long") if hot is None else F.when(hot, F.floor(F.col("t_us") / length_us).cast("long")).otherwise(F.lit(0).cast("long"))
    df = df.withColumn("__slice", slice_)
    inside = Window.partitionBy(*keys, "__slice").orderBy("t_us").rangeBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    own = df.withColumns({c: F.coalesce(F.sum(c).over(inside), zero) for c in sums})
    if hot is None:
        return own.drop("__slice")
    part = df.filter(hot).groupBy(*keys, "__slice").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = part.select(*keys, "__slice", *[F.sum(c).over(earlier).alias(f"__{c}") for c in sums])
    j = own.join(carried, [*keys, "__slice"], "left")
    return j.withColumns({c: F.col(c) + F.coalesce(f"__{c}", zero) for c in sums}).drop("__slice", *[f"__{c}" for c in sums])


def slide(rows: DataFrame, width_us: int, compute: Callable[[Frame], dict[str, np.ndarray]], fields: list[T.StructField], kept: list[str]) -> DataFrame:
    """`compute` over the rows of `account_rows`; its arrays, one value a row of the frame, become columns of the live rows."""
    by_name, chunk = {f.name: f for f in rows.schema.fields}, CHUNK
    schema = T.StructType([*[by_name[c] for c in kept], *fields])

    def step(held: list[pa.Table], known: int, last_out: int | None) -> tuple[pa.RecordBatch, pa.Table, int | None]:
        table = pa.concat_tables(held).combine_chunks()
        frame = Frame(table, known, width_us, last_out)
        made = compute(frame)
        emitted = pa.array(frame.emitted)
        arrays = [table.column(c).take(emitted).combine_chunks() for c in kept] + [pa.array(made[f.name][frame.emitted], from_pandas=True) for f in fields]
        last = np.flatnonzero((frame.group == frame.group[-1]) & (frame.t >= frame.t[-1] - width_us))
        out = pa.RecordBatch.from_arrays(arrays, [*kept, *[f.name for f in fields]])
        return out, table.slice(int(last[0])), frame.out_before(int(last[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, n, last_out = [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= max(chunk, known):
                out, tail, last_out = step(held, known, last_out)
                yield out
                held, known, n = [tail], len(tail), 0
        if n:
            yield step(held, known, last_out)[0]

    return rows.mapInArrow(run, schema)


def power_sums(frame: Frame, x: np.ndarray, role: np.ndarray, low: np.ndarray, high: np.ndarray, top: int = 4) -> list[np.ndarray]:
    """Window sums of the first powers of integers, exact before they become doubles."""
    out, largest = [], float(np.abs(x).max(initial=0))
    for k in range(1, top + 1):
        fits = largest**k * len(x) < 2.0**62
        powers = np.where(role, x, 0).astype(np.int64 if fits else object) ** k
        out.append(frame.window_sum(powers, low, high).astype(float))
    return out


def order_summaries(frame: Frame, x: np.ndarray) -> dict[str, np.ndarray]:
    """Least, greatest, middle and mean of both roles' values in the window up to each row; NaN without any."""
    names = [f"{role}_{s}" for role in ("out", "in") for s in ("min", "max", "median", "mean")]
    found = np.full((len(names), len(x)), np.nan)
    values, roles, low, group = x.tolist(), frame.out.tolist(), frame.since(frame.width).tolist(), frame.group.tolist()
    held = {True: SortedBlocks(), False: SortedBlocks()}
    front = 0
    for i, value in enumerate(values):
        if i and group[i] != group[i - 1]:
            held, front = {True: SortedBlocks(), False: SortedBlocks()}, i
        while front < low[i]:
            held[roles[front]].remove(values[front])
            front += 1
        held[roles[i]].add(value)
        if i >= frame.known:
            if held[True].n:
                found[:4, i] = held[True].summary()
            if held[False].n:
                found[4:, i] = held[False].summary()
    return dict(zip(names, found, strict=True))


class SortedBlocks:
    """A multiset of numbers in sorted blocks: adding, removing and reading by rank cost a search and a short move."""

    SIZE = 512

    def __init__(self) -> None:
        self.blocks: list[list] = []
        self.n, self.total = 0, 0

    def _block(self, x) -> int:
        low, high = 0, len(self.blocks) - 1
        while low < high:
            middle = (low + high) // 2
            if self.blocks[middle][-1] < x:
                low = middle + 1
            else:
                high = middle
        return low

    def add(self, x) -> None:
        self.n += 1
        self.total += x
        if not self.blocks:
            self.blocks.append([x])
            return
        i = self._block(x)
        insort(self.blocks[i], x)
        if len(self.blocks[i]) > 2 * self.SIZE:
            self.blocks[i : i + 1] = [self.blocks[i][: self.SIZE], self.blocks[i][self.SIZE :]]

    def remove(self, x) -> None:
        i = self._block(x)
        block = self.blocks[i]
        del block[bisect_left(block, x)]
        self.n -= 1
        self.total -= x
        if not block:
            del self.blocks[i]

    def at(self, rank: int):
        for block in self.blocks:
            if rank < len(block):
                return block[rank]
            rank -= len(block)
        raise IndexError(rank)

    def summary(self) -> tuple:
        """Least, greatest, middle (two middles halved) and mean of one value or more."""
        middle = (self.at((self.n - 1) // 2) + self.at(self.n // 2)) / 2
        return self.blocks[0][0], self.blocks[-1][-1], middle, self.total / self.n
