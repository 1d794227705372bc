"""Exact quantiles of many columns by refining histograms, without sorting the rows or gathering them in one task.

Every pass counts the values of the ranges still open in `BUCKETS` buckets of equal width, with each bucket's least and
greatest value; the wanted ranks then lie in one bucket each, which is the next range. A range ends when its values are all
the same, or few enough to be counted one by one. What reaches the driver is bounded by buckets and ranks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 512
#: A range of so few rows is counted value by value.
FEW = 2048


@dataclass
class _Range:
    low: float
    high: float
    below: int
    rows: int
    ranks: set[int] = field(default_factory=set)

    def bucket(self, v: Column) -> Column:
        scale = BUCKETS / (self.high - self.low) if self.high > self.low else 0.0
        if self.rows <= FEW or not 0 < scale < math.inf:
            return v
        return F.least(F.floor((v - self.low) * scale), F.lit(BUCKETS - 1)).cast("double")


def finite(c: str | Column) -> Column:
    """The column as a double, null where it is not a finite number."""
    v = (F.col(f"`{c}`") if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != math.inf), v)


def order_statistics(df: DataFrame, ranks: dict[str, list[float]]) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column the number of its finite values, and the values at the 0-based ranks next to each share of them.

    `ranks` gives shares in [0, 1]; share p asks for the two ranks around p * (n - 1).
    """
    names = list(ranks)
    if not names:
        return {}
    first = df.select(*[finite(c).alias(f"v{i}") for i, c in enumerate(names)])
    ends = first.agg(*[f(f"v{i}").alias(f"{f.__name__}{i}") for i in range(len(names)) for f in (F.count, F.min, F.max)]).first()
    found: dict[str, tuple[int, dict[int, float]]] = {}
    ranges: dict[int, list[_Range]] = {}
    for i, c in enumerate(names):
        n = ends[f"count{i}"]
        found[c] = (n, {})
        if n:
            wanted = {min(n - 1, int(x) + k) for p in ranks[c] for x in [p * (n - 1)] for k in (0, 1)}
            ranges[i] = [_Range(ends[f"min{i}"], ends[f"max{i}"], 0, n, wanted)]
    while True:
        for i in list(ranges):
            for r in ranges[i]:
                if r.low == r.high:
                    found[names[i]][1].update(dict.fromkeys(r.ranks, r.low))
            ranges[i] = [r for r in ranges[i] if r.low != r.high]
            if not ranges[i]:
                del ranges[i]
        if not ranges:
            return found
        cells = []
        for i, open_ in ranges.items():
            v, cell = F.col(f"v{i}"), None
            for k, r in enumerate(open_):
                here = F.struct(F.lit(i).alias("c"), F.lit(k).alias("k"), r.bucket(v).alias("b"), v.alias("v"))
                inside = (v >= r.low) & (v <= r.high)
                cell = F.when(inside, here) if cell is None else cell.when(inside, here)
            cells.append(cell)
        tall = first.select(F.explode(F.array(*cells)).alias("x")).filter("x IS NOT NULL").select("x.*")
        counted = tall.groupBy("c", "k", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        by_range: dict[tuple[int, int], list] = {}
        for row in counted:
            by_range.setdefault((row.c, row.k), []).append(row)
        nxt: dict[int, list[_Range]] = {}
        for (i, k), rows in by_range.items():
            old = ranges[i][k]
            below, wanted = old.below, sorted(old.ranks)
            for row in sorted(rows, key=lambda r: r.low):
                mine = {x for x in wanted if below <= x < below + row.n}
                if mine:
                    nxt.setdefault(i, []).append(_Range(row.low, row.high, below, row.n, mine))
                below += row.n
        ranges = nxt


def quantiles(df: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[float] | None]:
    """Quantiles of each column, interpolated between neighbours as SQL's continuous percentile; None without values."""
    out: dict[str, list[float] | None] = {}
    for c, (n, values) in order_statistics(df, shares).items():
        if not n:
            out[c] = None
            continue
        made = []
        for p in shares[c]:
            x = p * (n - 1)
            low = int(x)
            a, b = values[low], values[min(n - 1, low + 1)]
            made.append(a if x == low or a == b else (low + 1 - x) * a + (x - low) * b)
        out[c] = made
    return out
