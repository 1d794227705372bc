"""Account history: what an account and a pair did strictly before each transfer.

Every transfer becomes two events, one for each end's account, so that one sorted pass per account answers
questions about either role; no range join is needed. Sliding sums are differences of running totals (`sliding`), and
hubs are cut into time slices, so a hub is neither one task nor quadratic. Transfers at the same instant do not see
each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.columns import DAY_US, HOUR_US
from tidewater.operators.sliding import HUB_ROWS, SLICES, Frame, account_rows, before, hubs, mark_hubs, slide

BEHAVIOUR = (
    "bh_src_out_n_1h bh_src_out_n_24h bh_src_out_cents_24h bh_src_in_n_24h bh_src_passthrough_24h bh_dst_in_n_24h "
    "bh_dst_out_n_24h bh_src_secs_since_out bh_pair_n_prior bh_reverse_pair_n_prior"
).split()


def account_events(df: DataFrame, *carry: str) -> DataFrame:
    """Two rows a transfer: (account, role, other, ...) for the sender ('out') and the receiver ('in')."""
    ends = F.array(
        F.struct(F.col("source_account").alias("account"), F.lit("out").alias("role"), F.col("destination_account").alias("other")),
        F.struct(F.col("destination_account").alias("account"), F.lit("in").alias("role"), F.col("source_account").alias("other")),
    )
    return df.select("row_pos", "t_us", "cents", *carry, F.explode(ends).alias("e")).select("row_pos", "t_us", "cents", *carry, "e.*")


#: What a hub's pairs, and its last payment, are cut into where no window bounds them.
LIFE_US = 64 * DAY_US


def _ends(df: DataFrame, width_us: int, sums: dict[str, tuple[bool, str | None, int]], last_out: bool = False) -> DataFrame:
    """(row_pos, is_out, t_us, cents, sums...): both ends' sums over strictly earlier transfers, of hubs also the account.

    `sums` says for each name which role counts, what is added up (None: rows), and how far back; `last_out` adds the
    time of the account's last earlier payment, however old.
    """

    def compute(frame: Frame) -> dict[str, np.ndarray]:
        high, low, out = frame.instant(), {}, {}
        for name, (role, value, width) in sums.items():
            if width not in low:
                low[width] = frame.since(width)
            x = np.where(frame.out == role, 1 if value is None else frame.values(value), 0).astype(np.int64)
            out[name] = frame.window_sum(x, low[width], high)
        if last_out:
            out["last_out"] = frame.last_out(high)
        return out

    fields = [T.StructField(n, T.LongType()) for n in sums] + [T.StructField("last_out", T.DoubleType())] * last_out
    kept = ["account"] if "src_hub" in df.columns else []
    return slide(account_rows(df, width_us, ["cents"]), width_us, compute, fields, ["row_pos", "is_out", "t_us", "cents", *kept])


def _of(out: bool, c: str) -> Column:
    return F.max(F.when(F.col("is_out") == out, F.col(c)))


def behaviour(df: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """The ten history columns, keyed by row_pos."""
    base = df.select("row_pos", "t_us", "cents", "source_account", "destination_account")
    hot = hubs(base, hub_rows)
    base = base if hot is None else mark_hubs(base, hot)
    sums = {"out_1h": (True, None, HOUR_US), "out_24h": (True, None, DAY_US), "in_24h": (False, None, DAY_US),
            "out_cents": (True, "cents", DAY_US), "in_cents": (False, "cents", DAY_US)}
    seen = _ends(base, DAY_US, sums, last_out=True)
    if hot is not None:  # a slice of a hub may start after the last payment
        sent = base.filter("src_hub").groupBy("source_account", F.floor(F.col("t_us") / (SLICES * DAY_US)).alias("s")).agg(F.max("t_us").alias("m"))
        earlier = Window.partitionBy("source_account").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        sent = sent.select(F.col("source_account").alias("account"), "s", F.max("m").over(earlier).cast("double").alias("m"))
        seen = seen.withColumn("s", F.floor(F.col("t_us") / (SLICES * DAY_US))).join(sent, ["account", "s"], "left")
        seen = seen.withColumn("last_out", F.coalesce("last_out", "m"))
    since = F.when(F.col("is_out"), (F.col("t_us") - F.col("last_out")) / 1_000_000)
    ends = seen.groupBy("row_pos").agg(
        _of(True, "out_1h").alias("bh_src_out_n_1h"), _of(True, "out_24h").alias("bh_src_out_n_24h"),
        _of(True, "out_cents").alias("bh_src_out_cents_24h"), _of(True, "in_24h").alias("bh_src_in_n_24h"),
        F.max(F.when(F.col("is_out") & (F.col("in_cents") > 0), F.col("cents") / F.col("in_cents"))).alias("bh_src_passthrough_24h"),
        _of(False, "in_24h").alias("bh_dst_in_n_24h"), _of(False, "out_24h").alias("bh_dst_out_n_24h"),
        F.max(since).alias("bh_src_secs_since_out"),
    )
    low, high = F.least("source_account", "destination_account"), F.greatest("source_account", "destination_account")
    forward = F.col("source_account") == F.col("a")
    flag = [] if hot is None else [(F.col("src_hub") & F.col("dst_hub")).alias("hot")]
    pairs = base.select("row_pos", "t_us", "source_account", low.alias("a"), high.alias("b"), *flag)
    pairs = pairs.select("row_pos", "t_us", "a", "b", forward.alias("forward"), forward.cast("long").alias("low_first"), F.lit(1).cast("long").alias("all"), *(["hot"] if flag else []))
    pairs = before(pairs, ["a", "b"], ["low_first", "all"], F.col("hot") if flag else None, LIFE_US)
    back = F.col("all") - F.col("low_first")
    prior = F.when(F.col("forward"), F.col("low_first")).otherwise(back)
    reverse = F.when(F.col("a") == F.col("b"), F.col("all")).when(F.col("forward"), back).otherwise(F.col("low_first"))
    pairs = pairs.select("row_pos", prior.alias("bh_pair_n_prior"), reverse.alias("bh_reverse_pair_n_prior"))
    return ends.join(pairs, "row_pos").select("row_pos", *BEHAVIOUR)


def graph_lite(df: DataFrame, width_us: int = 2 * DAY_US, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Trailing two-day counts and sums of both ends, in both roles."""
    base = df.select("row_pos", "t_us", "cents", "source_account", "destination_account")
    hot = hubs(base, hub_rows)
    sums = {"n_out": (True, None, width_us), "n_in": (False, None, width_us), "c_out": (True, "cents", width_us), "c_in": (False, "cents", width_us)}
    seen = _ends(base if hot is None else mark_hubs(base, hot), width_us, sums)
    return seen.groupBy("row_pos").agg(
        _of(True, "n_out").alias("gl_src_out_n"), _of(True, "n_in").alias("gl_src_in_n"), _of(False, "n_out").alias("gl_dst_out_n"),
        _of(False, "n_in").alias("gl_dst_in_n"), _of(True, "c_out").alias("gl_src_out_cents"), _of(False, "c_in").alias("gl_dst_in_cents"),
    )


def previous_out(df: DataFrame) -> DataFrame:
    """As-of lookup: the time of the sender's last strictly earlier transfer, and its largest row position."""
    w = Window.partitionBy("source_account").orderBy("t_us").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("t_us", "row_pos")).over(w)
    return df.select("row_pos", last["t_us"].alias("prev_t_us"), last["row_pos"].alias("prev_row_pos"))


def emit(features: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """Rows to report, both ends inclusive; to be applied after the windows, so that the rest stays history."""
    keep = F.lit(True)
    if start_us is not None:
        keep = keep & (F.col("t_us") >= start_us)
    if end_us is not None:
        keep = keep & (F.col("t_us") <= end_us)
    return features.filter(keep)
