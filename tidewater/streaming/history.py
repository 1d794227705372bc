"""Account history over a stream: per-account state, events ordered by time inside each micro-batch.

An account's state is its events of the last day (and of `late_us` before it) and the time of its last outgoing
transfer before those. Without `idle_us` one small state an account stays for good, as the last outgoing time must;
with it, an account without events for so long is forgotten. An event never sees a later one, or one of the same
instant. To start warm, replay the past as the first micro-batches under the same checkpoint; a restart resumes from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.functions.columns import DAY_US, HOUR_US
from tidewater.operators.history import account_events

OUTPUT = "row_pos long, role string, n_out_1h long, n_out_24h long, cents_out_24h long, n_in_24h long, cents_in_24h long, passthrough_24h double, secs_since_out double"
STATE = "times array<long>, outgoing array<boolean>, cents array<long>, last_out long"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def account_history(stream: DataFrame, late_us: int = 0, idle_us: int | None = None) -> DataFrame:
    """Two rows a transfer, one for each end's account: what that account did strictly before it, in both roles.

    Equal to the batch windows for events in time order; an event later than others by up to `late_us` still sees its
    whole day, though those before it are not corrected. `idle_us` needs the watermarked column `at`.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({c: [] for c in NAMES})
            return
        old_t, old_out, old_cents, last = state.get if state.exists else ([], [], [], None)
        rows = pd.concat(list(frames)).sort_values(["t_us", "row_pos"])
        at = rows["t_us"].to_numpy("int64")
        times = np.concatenate([np.asarray(old_t, "int64"), at])
        outgoing = np.concatenate([np.asarray(old_out, bool), (rows["role"] == "out").to_numpy(bool)])
        cents = np.concatenate([np.asarray(old_cents, "int64"), rows["cents"].to_numpy("int64")])
        order = np.argsort(times, kind="stable")
        times, outgoing, cents = times[order], outgoing[order], cents[order]
        end, hour, day = (np.searchsorted(times, at - width, "left") for width in (0, HOUR_US, DAY_US))
        before = lambda values: np.concatenate([[0], np.cumsum(values)])
        n_out, n_in, c_out, c_in = (before(v) for v in (outgoing, ~outgoing, cents * outgoing, cents * ~outgoing))
        came = c_in[end] - c_in[day]
        outs = np.concatenate([np.asarray([] if last is None else [last], "int64"), times[outgoing]])
        place = np.searchsorted(outs, at, "left") - 1
        since = np.where(place >= 0, (at - outs[place]) / 1e6, np.nan) if len(outs) else np.full(len(at), np.nan)
        paid = (rows["role"] == "out").to_numpy(bool) & (came > 0)
        through = np.where(paid, rows["cents"].to_numpy("float64") / np.where(came > 0, came, 1), np.nan)
        yield pd.DataFrame(dict(zip(NAMES, (
            rows["row_pos"].to_numpy("int64"), rows["role"].to_numpy(), n_out[end] - n_out[hour], n_out[end] - n_out[day], c_out[end] - c_out[day],
            n_in[end] - n_in[day], came, through, since,
        ), strict=True)))
        first = int(np.searchsorted(times, times[-1] - DAY_US - late_us, "left"))
        gone = times[:first][outgoing[:first]]
        last = int(gone[-1]) if len(gone) else last
        state.update((times[first:].tolist(), outgoing[first:].tolist(), cents[first:].tolist(), last))
        if idle_us is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(times[-1]) // 1000) + idle_us // 1000)

    carry = () if idle_us is None else ("at",)
    timeout = GroupStateTimeout.NoTimeout if idle_us is None else GroupStateTimeout.EventTimeTimeout
    return account_events(stream, *carry).groupBy("account").applyInPandasWithState(advance, OUTPUT, STATE, "append", timeout)


def outgoing_history(stream: DataFrame) -> DataFrame:
    """The sender's own history of each transfer, under the names of the batch columns."""
    mine = account_history(stream).filter("role = 'out'")
    return mine.select("row_pos", F.col("n_out_1h").alias("bh_src_out_n_1h"), F.col("n_out_24h").alias("bh_src_out_n_24h"),
                       F.col("cents_out_24h").alias("bh_src_out_cents_24h"), F.col("secs_since_out").alias("bh_src_secs_since_out"))


def by_transfer(ends: DataFrame) -> DataFrame:
    """One row a transfer of both ends' rows (a table that the stream wrote), under the names of the batch columns."""
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    return ends.groupBy("row_pos").agg(
        of("out", "n_out_1h").alias("bh_src_out_n_1h"), of("out", "n_out_24h").alias("bh_src_out_n_24h"), of("out", "cents_out_24h").alias("bh_src_out_cents_24h"),
        of("out", "n_in_24h").alias("bh_src_in_n_24h"), of("out", "passthrough_24h").alias("bh_src_passthrough_24h"), of("in", "n_in_24h").alias("bh_dst_in_n_24h"),
        of("in", "n_out_24h").alias("bh_dst_out_n_24h"), of("out", "secs_since_out").alias("bh_src_secs_since_out"),
    )


def with_event_time(tx: DataFrame, late: str = "1 hour") -> DataFrame:
    return tx.withColumn("at", F.timestamp_micros("t_us")).withWatermark("at", late)


def tumbling(tx: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and payment type; batch and stream alike (a stream needs `with_event_time`)."""
    t = tx if "at" in tx.columns else tx.withColumn("at", F.timestamp_micros("t_us"))
    g = t.groupBy(F.window("at", width).alias("w"), "payment_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "payment_type", "n", "cents")


def sessions(tx: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sender sessions: bursts of transfers with gaps below the bound."""
    t = tx if "at" in tx.columns else tx.withColumn("at", F.timestamp_micros("t_us"))
    g = t.groupBy(F.session_window("at", gap).alias("w"), "source_account").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "source_account", "n", "cents")


def two_hops(first: DataFrame, second: DataFrame, within: str = "6 hours") -> DataFrame:
    """Stream-stream (or batch) interval join: money that leaves an account soon after it came in.

    Both sides need the `at` column; as streams, watermarked, so that state is bounded by the interval.
    """
    a = first.select(F.col("row_pos").alias("in_pos"), F.col("destination_account").alias("mid"), F.col("at").alias("in_at"))
    b = second.select(F.col("row_pos").alias("out_pos"), F.col("source_account").alias("out_mid"), F.col("at").alias("out_at"))
    when = (F.col("out_at") > F.col("in_at")) & (F.col("out_at") <= F.col("in_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("mid") == F.col("out_mid")) & when).select("in_pos", "out_pos")
