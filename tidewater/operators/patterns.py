"""The pattern block of a transfer: size histograms of the patterns it closes and statistics of both ends, in contract order.

The columns, their order and their labels come from one list (`columns.pattern_columns`). Search windows are
clamped by the window of the graph itself, as nothing older is in it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import DAY_US, HOUR_US, pattern_columns
from tidewater.operators import graph
from tidewater.session import cut


@dataclass(frozen=True)
class PatternParams:
    """Windows in microseconds, the longest simple cycle, and the columns that statistics are made of."""

    window: int = 10 * DAY_US
    fan: int = DAY_US
    degree: int = DAY_US
    statistics: int = 2 * DAY_US
    scatter_gather: int = 2 * DAY_US
    temporal_cycle: int = 3 * DAY_US
    simple_cycle: int = 3 * DAY_US
    longest: int = 10
    longest_temporal: int | None = None
    stat_columns: tuple[str, ...] = ("amount",)

    def clamped(self) -> PatternParams:
        names = ("fan", "degree", "statistics", "scatter_gather", "temporal_cycle", "simple_cycle")
        return replace(self, **{n: min(getattr(self, n), self.window) for n in names})


#: The three parameter sets. Every window of a set is clamped by its first one.
PARAMETER_SETS = {
    "default": PatternParams(),
    "windowed": PatternParams(window=2 * DAY_US),
    "paper": PatternParams(
        window=DAY_US, scatter_gather=6 * HOUR_US, temporal_cycle=DAY_US, simple_cycle=DAY_US, statistics=DAY_US, stat_columns=("timestamp", "amount")
    ),
}

_ENDS = {"src": "sender", "dst": "receiver"}
_WAYS = {"out": "outgoing", "in": "incoming"}


def _counts(found: DataFrame, size: str, family: str, top: int) -> DataFrame:
    """(row_pos, a struct with a column a bin): how many patterns of each size a transfer closes; the last bin is open.

    One struct, as most transfers close none: its absence is a word of a joined row, not a word a bin.
    """
    at = lambda b: F.col(size) >= b if b == top else F.col(size) == b
    bins = [F.coalesce(F.sum(F.when(at(b), F.col("n"))), F.lit(0)).alias(f"pat_{family}_{b}") for b in range(2, top + 1)]
    return found.groupBy("row_pos").agg(F.struct(*bins).alias(family))


def _statistics(df: DataFrame, p: PatternParams, column: str, first: bool) -> DataFrame:
    """The end statistics under their names; counts and ratios come with the first column only."""
    if column == "amount":
        s = graph.vertex_statistics(df, p.statistics)
    else:
        s = graph.vertex_statistics(df.withColumn("t_s", F.expr("t_us div 1000000")), p.statistics, "t_s", unit=1)
    out = ["row_pos"]
    for end, party in _ENDS.items():
        for role, way in _WAYS.items():
            base = f"pat_{party}_{way}"
            if first:
                out += [F.col(f"{end}_{role}_{c}").alias(f"{base}_{n}") for c, n in (("cp", "counterparties"), ("n", "count"), ("ratio", "ratio"))]
            out += [F.col(f"{end}_{role}_{m}").alias(f"{base}_{column}_{m}") for m in ("mean", "sum", "variance", "skew", "kurtosis")]
    return s.select(*out)


def pattern_block(df: DataFrame, params: PatternParams) -> DataFrame:
    """(row_pos, columns of `pattern_columns`): 215 columns over amounts, 235 with timestamps too.

    Bins are one-hot for fan and degree sizes and counts for the searched patterns; self-transfers are outside the graph
    and get no row. Sizes are joined, and become bins last. The transfers' columns are written once, as every part reads them.
    """
    p = params.clamped()
    df = cut(df.select("row_pos", "t_us", "cents", "source_account", "destination_account"), "pattern-transfers")
    block = graph.fan_degree(df, p.fan)
    if p.degree != p.fan:
        block = block.drop("degree_in", "degree_out").join(graph.fan_degree(df, p.degree).drop("fan_in", "fan_out"), "row_pos")
    block = block.join(_counts(graph.scatter_gather(df, p.scatter_gather), "size", "scatter_gather", 30), "row_pos", "left")
    block = block.join(_counts(graph.cycles(df, p.temporal_cycle, p.longest_temporal, ordered=True), "length", "temporal_cycle", 30), "row_pos", "left")
    block = block.join(_counts(graph.cycles(df, p.simple_cycle, p.longest, ordered=False), "length", "lc_cycle", 10), "row_pos", "left")
    for k, column in enumerate(p.stat_columns):
        block = block.join(_statistics(df, p, column, k == 0), "row_pos")
    made = {}
    for c in ("fan_in", "fan_out", "degree_in", "degree_out"):
        made |= {f"pat_{c}_{b}": F.when(F.col(c) >= b if b == 30 else F.col(c) == b, 1).otherwise(0) for b in range(2, 31)}
    for c, top in (("scatter_gather", 30), ("temporal_cycle", 30), ("lc_cycle", 10)):
        made |= {f"pat_{c}_{b}": F.coalesce(F.col(c)[f"pat_{c}_{b}"], F.lit(0)) for b in range(2, top + 1)}
    return block.select("row_pos", *[made[c].alias(c) if c in made else F.col(c) for c, _ in pattern_columns(p.stat_columns)])
