"""Time-respecting fund traces of many seeds at once.

Each hop is one equi-join of the frontier with the edges by account, a time condition, and a rank that keeps
the soonest (backwards: the latest) `degree_cap` edges of a vertex. An edge keeps the depth at which it was
first met; a vertex may be expanded again at a later depth, from its best arrival at that depth. Over
budget, edges are kept in the order (depth, arrival, account, t, pos).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import cut


class TraceError(ValueError):
    """Raised when a trace cannot be started as asked."""


@dataclass(frozen=True)
class TraceLimits:
    degree_cap: int = 64
    edge_budget: int = 10_000
    max_gap_us: int | None = None


@dataclass(frozen=True)
class Trace:
    """`edges`: (seed, row_pos, ..., depth); `status`: one row a seed; `terminals`: (seed, account)."""

    edges: DataFrame
    status: DataFrame
    terminals: DataFrame

    def per_hop(self) -> DataFrame:
        ends = self.edges.select("seed", "depth", "row_pos", "cents", F.explode(F.array("src", "dst")).alias("a"))
        return ends.groupBy("seed", "depth").agg(
            F.count_distinct("row_pos").alias("n"), F.count_distinct("a").alias("accounts"), (F.sum("cents") / 2).cast("long").alias("cents")
        )


def trace(df: DataFrame, seeds: DataFrame, direction: str = "forward", horizon: int = 3, limits: TraceLimits | None = None, durable: bool = False) -> Trace:
    """Walks from `seeds` (seed string, at_us long; a null anchor means the start or end of time).

    `durable` writes each hop's frontier to the shared folder, for long horizons on large inputs.
    """
    if direction not in ("forward", "backward"):
        raise TraceError("direction must be 'forward' or 'backward'")
    if horizon < 1:
        raise TraceError("horizon must be at least 1")
    if missing := [c for c in ("row_pos", "t_us", "cents", "source_account", "destination_account") if c not in df.columns]:
        raise TraceError(f"missing columns: {', '.join(missing)}")
    limits = limits or TraceLimits()
    ahead = direction == "forward"
    near, far = ("src", "dst") if ahead else ("dst", "src")
    e = df.select("row_pos", "t_us", "cents", F.col("source_account").alias("src"), F.col("destination_account").alias("dst"))
    start = -(1 << 62) if ahead else 1 << 62
    frontier = seeds.select("seed", F.col("seed").alias("vertex"), F.coalesce("at_us", F.lit(start)).alias("arrival"), (F.col("at_us").isNull()).alias("free"))
    hops, capped = [], []
    best = F.min if ahead else F.max
    for depth in range(1, horizon + 1):
        fits = (F.col("t_us") >= F.col("arrival")) if ahead else (F.col("t_us") <= F.col("arrival"))
        if limits.max_gap_us is not None:
            gap = (F.col("t_us") - F.col("arrival")) if ahead else (F.col("arrival") - F.col("t_us"))
            fits = fits & ((gap <= limits.max_gap_us) | F.col("free"))
        met = frontier.join(e, frontier["vertex"] == e[near]).filter(fits)
        order = Window.partitionBy("seed", "vertex").orderBy(F.col("t_us").asc() if ahead else F.col("t_us").desc(), "row_pos")
        ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limits.degree_cap + 1)
        capped.append(ranked.filter(F.col("rank") > limits.degree_cap).select("seed", "vertex").distinct())
        taken = ranked.filter(F.col("rank") <= limits.degree_cap).withColumn("depth", F.lit(depth))
        if durable:
            taken = cut(taken, "trace-hop")
        hops.append(taken)
        frontier = taken.groupBy("seed", F.col(far).alias("vertex")).agg(best("t_us").alias("arrival")).withColumn("free", F.lit(False))
    every = reduce(DataFrame.unionByName, hops)
    first = Window.partitionBy("seed", "row_pos").orderBy("depth", "arrival", "vertex")
    edges = every.withColumn("k", F.row_number().over(first)).filter("k = 1")
    within = Window.partitionBy("seed").orderBy("depth", "arrival", "vertex", "t_us", "row_pos")
    edges = edges.withColumn("place", F.row_number().over(within))
    kept = edges.filter(F.col("place") <= limits.edge_budget).select("seed", "row_pos", "t_us", "cents", "src", "dst", "depth")
    full = edges.groupBy("seed").agg((F.max("place") > limits.edge_budget).alias("exhausted"))
    cut_off = reduce(DataFrame.union, capped).groupBy("seed").agg(F.array_sort(F.collect_set("vertex")).alias("capped"))
    status = (
        seeds.select("seed").join(full, "seed", "left").join(cut_off, "seed", "left")
        .select("seed", F.coalesce("exhausted", F.lit(False)).alias("exhausted"), F.coalesce("capped", F.array().cast("array<string>")).alias("capped"))
        .withColumn("complete", ~F.col("exhausted") & (F.size("capped") == 0))
    )
    reached = kept.select("seed", F.col(far).alias("account")).distinct()
    terminals = reached.join(kept.select("seed", F.col(near).alias("account")).distinct(), ["seed", "account"], "left_anti")
    return Trace(kept, status, terminals)
