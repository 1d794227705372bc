"""Windowed subgraph features of each transfer, the transfer itself included.

Replay order is (t_us, row_pos): a transfer sees earlier ones and itself, never later ones at the same
instant. Windows are closed at `t - width`. Self-transfers are outside the graph and get no row. Cycle and
scatter-gather searches join on (account, time bucket), so that no window scans an account's whole life.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.columns import DAY_US, HOUR_US, degree_bucket
from tidewater.operators.sliding import HUB_ROWS, Frame, account_rows, hubs, mark_hubs, order_summaries, power_sums, slide
from tidewater.operators.quantiles import quantiles
from tidewater.session import cut, global_running


def edges(df: DataFrame) -> DataFrame:
    return df.filter("source_account <> destination_account").select(
        "row_pos", "t_us", "cents", F.col("source_account").alias("src"), F.col("destination_account").alias("dst")
    )


def _both_ends(df: DataFrame, width_us: int, carry: list[str], compute, fields: list[T.StructField], hub_rows: int, other: bool = True) -> DataFrame:
    """(row_pos, is_out, fields...): `compute` over each end's account, self-transfers left out."""
    e = df.filter("source_account <> destination_account").select("row_pos", "t_us", *carry, "source_account", "destination_account")
    hot = hubs(e, hub_rows)
    rows = account_rows(e if hot is None else mark_hubs(e, hot), width_us, carry, other, ties=True)
    return slide(rows, width_us, compute, fields, ["row_pos", "is_out"])


def _upto(frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """The window of each row: back to t - width, and the row itself."""
    return frame.since(frame.width), np.arange(1, len(frame.t) + 1)


def fan_degree(df: DataFrame, width_us: int = DAY_US, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Fan and degree sizes that each edge closes: into the receiver, out of the sender."""

    def compute(frame: Frame) -> dict[str, np.ndarray]:
        low, high = _upto(frame)
        fan, degree = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for role in (frame.out, ~frame.out):
            fan = np.where(role, frame.distinct(role, low), fan)
            degree = np.where(role, frame.window_sum(role.astype(np.int64), low, high), degree)
        return {"fan": fan, "degree": degree}

    seen = _both_ends(df, width_us, [], compute, [T.StructField("fan", T.LongType()), T.StructField("degree", T.LongType())], hub_rows)
    of = lambda out, c: F.max(F.when(F.col("is_out") == out, F.col(c)))
    return seen.groupBy("row_pos").agg(
        of(False, "fan").alias("fan_in"), of(True, "fan").alias("fan_out"), of(False, "degree").alias("degree_in"), of(True, "degree").alias("degree_out"),
    )


def histogram(sizes: DataFrame, column: str, top: int = 30, low: int = 2) -> DataFrame:
    """One-hot bins of a size: `low` to `top`, the last one open."""
    bins = [F.when(F.col(column) == b, 1).otherwise(0).alias(f"pat_{column}_{b}") for b in range(low, top)]
    return sizes.select("row_pos", *bins, F.when(F.col(column) >= top, 1).otherwise(0).alias(f"pat_{column}_{top}"))


def vertex_statistics(df: DataFrame, width_us: int = DAY_US, value: str = "cents", hub_rows: int = HUB_ROWS, unit: int = 100) -> DataFrame:
    """For both ends and both roles: distinct counterparties, count, ratio, mean, sum, variance, skew, kurtosis.

    Moments come from integer power sums of `value`, exact before they are divided; population forms.
    Sums and means are in units of `unit`, variance in their square.
    """
    names = ("cp", "n", "s1", "s2", "s3", "s4")

    def compute(frame: Frame) -> dict[str, np.ndarray]:
        (low, high), x, out = _upto(frame), frame.values(value).astype(np.int64), {}
        for name, role in (("out", frame.out), ("in", ~frame.out)):
            sums = power_sums(frame, x, role, low, high)
            made = [frame.distinct(role, low), frame.window_sum(role.astype(np.int64), low, high), *sums]
            out |= {f"{name}_{c}": m for c, m in zip(names, made, strict=True)}
        return out

    kind = lambda c: T.LongType() if c in ("cp", "n") else T.DoubleType()
    fields = [T.StructField(f"{role}_{c}", kind(c)) for role in ("out", "in") for c in names]
    seen = _both_ends(df, width_us, [value], compute, fields, hub_rows).withColumn("end", F.when(F.col("is_out"), "out").otherwise("in"))
    blocks = []
    for end, name in (("out", "src"), ("in", "dst")):
        for role in ("out", "in"):
            pick = lambda c, end=end: F.max(F.when(F.col("end") == end, F.col(c)))
            blocks += [pick(f"{role}_{c}").alias(f"{name}_{role}_{c}") for c in ("cp", "n", "s1", "s2", "s3", "s4")]
    one = seen.groupBy("row_pos").agg(*blocks)
    out = [F.col("row_pos")]
    for name in ("src", "dst"):
        for role in ("out", "in"):
            p = f"{name}_{role}"
            n, s1, s2, s3, s4 = (F.col(f"{p}_{c}") for c in ("n", "s1", "s2", "s3", "s4"))
            mean = s1 / F.nullif(n, F.lit(0))
            var = s2 / F.nullif(n, F.lit(0)) - mean * mean
            m3 = s3 / F.nullif(n, F.lit(0)) - 3 * mean * s2 / F.nullif(n, F.lit(0)) + 2 * mean * mean * mean
            m4 = s4 / F.nullif(n, F.lit(0)) - 4 * mean * s3 / F.nullif(n, F.lit(0)) + 6 * mean * mean * s2 / F.nullif(n, F.lit(0)) - 3 * mean * mean * mean * mean
            spread = F.when(n > 1, F.when(var > 0.5, var))  # below half a squared unit of an integer there is none
            out += [
                F.col(f"{p}_cp"), n, (F.col(f"{p}_cp") / F.nullif(n, F.lit(0))).alias(f"{p}_ratio"), (mean / unit).alias(f"{p}_mean"),
                (s1 / unit).alias(f"{p}_sum"), F.when(n > 0, F.greatest(var, F.lit(0.0)) / (unit * unit)).alias(f"{p}_variance"),
                (m3 / F.pow(spread, F.lit(1.5))).alias(f"{p}_skew"), (m4 / (spread * spread) - 3).alias(f"{p}_kurtosis"),
            ]
    return one.select(*out)


def order_statistics(df: DataFrame, value: str = "cents", width_us: int = DAY_US, hub_rows: int = HUB_ROWS) -> DataFrame:
    """For both ends and both roles: least, greatest, middle (two middles halved) and mean of an integer column.

    Null where a window has no value. An account's window is held in sorted blocks, so memory follows the window.
    """
    names = [f"{role}_{s}" for role in ("out", "in") for s in ("min", "max", "median", "mean")]
    fields = [T.StructField(c, T.DoubleType()) for c in names]
    seen = _both_ends(df, width_us, [value], lambda frame: order_summaries(frame, frame.values(value).astype(np.int64)), fields, hub_rows, other=False)
    pick = lambda out, c: F.max(F.when(F.col("is_out") == out, F.col(c)))
    return seen.groupBy("row_pos").agg(*[pick(out, c).alias(f"{name}_{c}") for out, name in ((True, "src"), (False, "dst")) for c in names])


def timestamp_statistics(df: DataFrame, width_us: int = DAY_US) -> DataFrame:
    """`order_statistics` of the transfers' own times, in whole seconds since the epoch."""
    return order_statistics(df.withColumn("t_s", F.expr("t_us div 1000000")), "t_s", width_us)


# --- joins on (account, time bucket) -----------------------------------------------------------------


def _bucketed(e: DataFrame, width_us: int) -> DataFrame:
    return e.withColumn("bucket", F.floor(F.col("t_us") / width_us).cast("long"))


def _probe(frontier: DataFrame, width_us: int) -> DataFrame:
    """The frontier, once for each bucket that its window [t - width, t] can touch."""
    b = F.floor(F.col("t_us") / width_us).cast("long")
    return frontier.withColumn("bucket", F.explode(F.array(b - 1, b)))


def cycles(df: DataFrame, width_us: int = DAY_US, longest: int | None = 4, ordered: bool = True) -> DataFrame:
    """(row_pos, length, n): simple cycles that each edge closes, over edges of the window before it.

    `ordered`: times rise strictly along the cycle and the closing edge is last; otherwise any earlier edges
    (in replay order) count. Paths grow backwards from the closing edge's sender and die at the window's edge.
    `longest` None goes on until no path is left. Each length's paths are written to the shared folder, so that
    the next starts from files. Edges out of accounts that receive nothing are left out first, as no cycle has one; the
    rest is written too, so that no length reads the transfers again.
    """
    e = edges(df).drop("cents")
    e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "cycle-edges")
    hop = _bucketed(e, width_us).select(
        F.col("src").alias("h_src"), F.col("dst").alias("h_dst"), F.col("t_us").alias("h_t"), F.col("row_pos").alias("h_pos"), F.col("bucket").alias("h_bucket")
    )
    path = e.select("row_pos", "t_us", F.col("dst").alias("goal"), F.col("src").alias("head"), F.col("t_us").alias("limit_t"), F.array("src", "dst").alias("seen"))
    found, length = None, 2
    while True:
        if ordered:
            when = (F.col("h_t") < F.col("limit_t")) & (F.col("h_t") >= F.col("t_us") - width_us)
        else:
            earlier = (F.col("h_t") < F.col("t_us")) | ((F.col("h_t") == F.col("t_us")) & (F.col("h_pos") < F.col("row_pos")))
            when = earlier & (F.col("h_t") >= F.col("t_us") - width_us)
        step = _probe(path, width_us).join(hop, (F.col("head") == F.col("h_dst")) & (F.col("bucket") == F.col("h_bucket")) & when)
        step = step.filter("h_src = goal OR NOT array_contains(seen, h_src)")
        if length != longest:
            step = cut(step.select("row_pos", "t_us", "goal", "seen", "h_src", "h_t"), "cycle-paths")
        closed = step.filter("h_src = goal").groupBy("row_pos").agg(F.count("*").alias("n")).select("row_pos", F.lit(length).alias("length"), "n")
        found = closed if found is None else found.unionByName(closed)
        if length == longest:
            return found
        path = step.filter("h_src <> goal").select(
            "row_pos", "t_us", "goal", F.col("h_src").alias("head"), F.col("h_t").alias("limit_t"), F.concat("seen", F.array("h_src")).alias("seen")
        )
        if path.isEmpty():
            return found
        length += 1


def scatter_gather(df: DataFrame, width_us: int = 6 * HOUR_US) -> DataFrame:
    """(row_pos, size, n): for the gather edge m -> w, the pairs (u, w) by number of intermediaries, 2 or more.

    An intermediary has u -> m' in the window, then m' -> w at the same time or later, up to this edge. Paths u -> m -> w are
    found once, written, and joined with each other on both of their ends, so that gathers of other senders never meet.
    """
    e = edges(df)
    s = _bucketed(e, width_us).select(F.col("src").alias("u"), F.col("dst").alias("m"), F.col("t_us").alias("s_t"), F.col("row_pos").alias("s_pos"), "bucket")
    g = _probe(e.select("row_pos", "t_us", F.col("src").alias("m"), F.col("dst").alias("w")), width_us)
    scattered = (F.col("s_t") <= F.col("t_us")) & (F.col("s_t") >= F.col("t_us") - width_us) & (F.col("u") != F.col("w"))
    ahead = (F.col("s_t") < F.col("t_us")) | (F.col("s_pos") < F.col("row_pos"))
    # a gather with a scatter before it, and the latest such scatter: an earlier one is in no window that this one has left
    paths = g.join(s, ["m", "bucket"]).filter(scattered).groupBy("row_pos", "t_us", "m", "w", "u").agg(F.max("s_t").alias("s_t"), F.bool_or(ahead).alias("closes"))
    paths = cut(paths, "scatter-gather-paths")
    closing = _probe(paths.filter("closes").select("row_pos", "t_us", "m", "w", "u"), width_us)
    other = _bucketed(paths, width_us).select("u", "w", "bucket", F.col("m").alias("m2"), F.col("t_us").alias("g_t"), F.col("row_pos").alias("g_pos"), F.col("s_t").alias("s2_t"))
    before = (F.col("g_t") < F.col("t_us")) | ((F.col("g_t") == F.col("t_us")) & (F.col("g_pos") < F.col("row_pos")))
    pairs = closing.join(other, ["u", "w", "bucket"]).filter(before & (F.col("s2_t") >= F.col("t_us") - width_us) & (F.col("m2") != F.col("m")))
    sizes = pairs.groupBy("row_pos", "u").agg((F.count_distinct("m2") + 1).alias("size"))
    return sizes.groupBy("row_pos", "size").agg(F.count("*").alias("n"))


def degree_profile(df: DataFrame, top: int = 5, hub_share: int = 10_000) -> DataFrame:
    """One row: vertices, edges, mean, quantiles and maximum of the accounts' degrees, the largest few, and the hubs' share.

    A degree counts an account's ends of transfers; `share` is what the busiest account in `hub_share` (at least one) hold.
    """
    d = df.select(F.explode(F.array("source_account", "destination_account")).alias("a")).groupBy("a").agg(F.count("*").alias("degree"))
    shares = [0.5, 0.99, 0.999, 0.9999]
    q = quantiles(d, {"degree": shares})["degree"] or [None] * len(shares)
    sizes = d.groupBy("degree").agg(F.count("*").alias("c"))
    whole = sizes.agg(F.sum("c").alias("vertices"), (F.sum(F.col("c") * F.col("degree")) / 2).cast("long").alias("edges"), F.max("degree").alias("max_degree"))
    run = global_running(sizes, [("degree", False)], {"upto": "c"}).crossJoin(F.broadcast(whole.select(F.greatest(F.floor(F.col("vertices") / hub_share), F.lit(1)).alias("hubs"))))
    held = run.agg(F.sum(F.col("degree") * F.greatest(F.least("c", F.col("hubs") - (F.col("upto") - F.col("c"))), F.lit(0))).alias("held"))
    first = d.orderBy(F.desc("degree")).limit(top).agg(F.array_join(F.reverse(F.array_sort(F.collect_list("degree"))), ",").alias("top_degrees"))
    one = whole.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(first))  # one row each
    return one.select(
        "vertices", "edges", (2 * F.col("edges") / F.col("vertices")).alias("mean"),
        *[F.lit(v).cast("double").alias(n) for n, v in zip(("p50", "p99", "p999", "p9999"), q, strict=True)],
        "max_degree", "top_degrees", (F.col("held") / (2 * F.col("edges"))).alias("share"),
    )


def cadence(df: DataFrame) -> DataFrame:
    """(account, n, variation): population deviation over mean of the gaps of senders with four transfers or more."""
    w = Window.partitionBy("source_account").orderBy("t_us")
    gaps = df.select("source_account", (F.col("t_us") - F.lag("t_us").over(w)).alias("gap"))
    return (
        gaps.groupBy(F.col("source_account").alias("account"))
        .agg(F.count("*").alias("n"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mean"))
        .filter("n >= 4 AND mean <> 0").select("account", "n", (F.col("sd") / F.col("mean")).alias("variation"))
    )


def pair_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_account", "destination_account").agg(F.count("*").alias("n"))


def reciprocal_pairs(df: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n, back): pairs with at least `least` transfers each way."""
    p = pair_counts(df).filter(F.col("n") >= least)
    back = p.select(F.col("source_account").alias("b"), F.col("destination_account").alias("a"), F.col("n").alias("back"))
    return p.select(F.col("source_account").alias("a"), F.col("destination_account").alias("b"), "n").join(back, ["a", "b"])


def hard_negatives(df: DataFrame, quantile: float = 0.99, least_fan: int = 5, least_reciprocal: int = 3) -> DataFrame:
    """Benign transfers of structurally busy accounts, with one flag a family."""
    benign = df.filter("is_laundering = 0")
    out = benign.groupBy(F.col("source_account").alias("a")).agg(F.count_distinct("destination_account").alias("fan"), F.count("*").alias("sent"))
    into = benign.groupBy(F.col("destination_account").alias("b")).agg(F.count_distinct("source_account").alias("fan"))
    q = quantiles(out, {"fan": [quantile], "sent": [quantile]})
    at = lambda x: x[0] if x else 0.0
    cuts = max(float(least_fan), at(q["fan"])), at(q["sent"])
    in_cut = max(float(least_fan), at(quantiles(into, {"fan": [quantile]})["fan"]))
    steady = cadence(benign).filter("variation < 0.5").select(F.col("account").alias("a"), F.lit(True).alias("steady"))
    mutual = reciprocal_pairs(benign, least_reciprocal).select("a").distinct().withColumn("mutual", F.lit(True))
    senders = out.select("a", (F.col("fan") >= cuts[0]).alias("high_fan_out"), (F.col("sent") >= cuts[1]).alias("high_volume")).join(steady, "a", "left").join(mutual, "a", "left")
    receivers = into.select("b", (F.col("fan") >= in_cut).alias("high_fan_in"))
    no = F.lit(False)
    flagged = benign.join(senders, benign["source_account"] == F.col("a"), "left").join(receivers, benign["destination_account"] == F.col("b"), "left").select(
        "transaction_id", F.coalesce("high_fan_out", no).alias("high_fan_out"), F.coalesce("high_fan_in", no).alias("high_fan_in"),
        F.coalesce("high_volume", no).alias("high_volume"), (F.coalesce("high_fan_out", no) & F.coalesce("steady", no)).alias("regular_cadence"),
        F.coalesce("mutual", no).alias("reciprocal"),
    )
    return flagged.filter("high_fan_out OR high_fan_in OR high_volume OR regular_cadence OR reciprocal")


def adaptive(train: DataFrame, df: DataFrame) -> DataFrame:
    """Degree-normalised features of `df` by what was fitted on `train`."""
    return with_adaptive(train, df, {"": F.lit(True)}).select("transaction_id", *ADAPTIVE)


ADAPTIVE = (
    "adp_out_degree_log adp_in_degree_log adp_degree_asymmetry adp_amount_vs_own_median adp_amount_vs_peer_median adp_amount_peer_z "
    "adp_amount_per_counterparty adp_source_unseen adp_dest_unseen"
).split()


def with_adaptive(train: DataFrame, df: DataFrame, fits: dict[str, Column]) -> DataFrame:
    """`df` with the degree-normalised features of several fits, named by the fits' prefixes.

    A fit is a condition on the rows of `train`. All fits share one pass over the pairs, one over the senders' sorted
    amounts and one over the peers' amounts, and each end of `df` is joined once.
    """
    rows = train.select("source_account", "destination_account", "amount", *[F.coalesce(on, F.lit(False)).alias(f"__in{i}") for i, on in enumerate(fits.values())])
    seen = [(i, F.col(f"__in{i}")) for i in range(len(fits))]
    medians = quantiles(rows.select(*[F.when(on, F.col("amount")).alias(f"m{i}") for i, on in seen]), {f"m{i}": [0.5] for i, _ in seen})
    everyone = [(medians[f"m{i}"] or [0.0])[0] for i, _ in seen]

    pairs = rows.groupBy("source_account", "destination_account").agg(*[F.bool_or(on).alias(f"__in{i}") for i, on in seen])
    pairs = cut(pairs, "adaptive-pairs")
    degree = lambda of, name: [F.when(F.bool_or(on), F.count_if(on & F.col(of).isNotNull())).alias(f"__{name}{i}") for i, on in seen]
    out = pairs.groupBy(F.col("source_account").alias("__a")).agg(*degree("destination_account", "out"))
    into = cut(pairs.groupBy(F.col("destination_account").alias("__b")).agg(*degree("source_account", "into")), "adaptive-receivers")
    out = out.join(_own_medians(rows, seen), "__a", "left").withColumns({f"__bucket{i}": degree_bucket(F.coalesce(f"__out{i}", F.lit(0))) for i, _ in seen})
    out = cut(out, "adaptive-senders")
    peers = _peers(rows, out, seen)

    j = df.join(out, df["source_account"] == F.col("__a"), "left").join(into, df["destination_account"] == F.col("__b"), "left")
    j, names = j.withColumns({f"__bucket{i}": F.coalesce(f"__bucket{i}", degree_bucket(F.lit(0))) for i, _ in seen}), list(df.columns)
    for (i, _), prefix in zip(seen, fits, strict=True):  # a join between two fits' columns: one generated method for both would be too long to be compiled
        of = peers.filter(F.col("fit") == i).select(F.col("bucket").alias(f"__bucket{i}"), F.col("median").alias(f"__pm{i}"), F.col("sd").alias(f"__ps{i}"))
        j = j.join(F.broadcast(of), f"__bucket{i}", "left")  # at most eleven buckets
        j = j.select("*", *[c.alias(f"{prefix}{name}") for name, c in zip(ADAPTIVE, _adaptive_columns(i, everyone[i]), strict=True)])
        names += [f"{prefix}{name}" for name in ADAPTIVE]
    return j.select(*names)


def _own_medians(rows: DataFrame, fits: list[tuple[int, Column]]) -> DataFrame:
    """(__a, __own<i>): each sender's middle amount in each fit, from one sort of the rows by sender and amount."""
    order = Window.partitionBy("source_account").orderBy("amount")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = rows.filter("amount IS NOT NULL").select("source_account", "amount", *[c for i, on in fits for c in (
        F.when(on, F.count_if(on).over(upto)).alias(f"k{i}"), F.count_if(on).over(whole).alias(f"n{i}"))])
    at = lambda i, place: F.max(F.when(F.expr(f"k{i} = {place}"), F.col("amount")))
    g = ranked.groupBy(F.col("source_account").alias("__a"))
    return g.agg(*[_middle(at(i, f"(n{i} + 1) div 2"), at(i, f"n{i} div 2 + 1")).alias(f"__own{i}") for i, _ in fits])


def _middle(low: Column, high: Column) -> Column:
    return F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)


def _peers(rows: DataFrame, out: DataFrame, fits: list[tuple[int, Column]]) -> DataFrame:
    """(fit, bucket, median, sd) of the amounts sent from each bucket of degrees.

    Equal amounts are counted first and the counts are summed along their order, so that no bucket is gathered in one task.
    """
    cells = [F.when(on, F.struct(F.lit(i).alias("fit"), F.col(f"__bucket{i}").alias("bucket"))) for i, on in fits]
    tall = rows.filter("amount IS NOT NULL").join(out, rows["source_account"] == F.col("__a")).select("amount", F.explode(F.array(*cells)).alias("e"))
    keys = ["fit", "bucket"]
    counts = cut(tall.filter("e IS NOT NULL").select("e.*", "amount").groupBy(*keys, "amount").agg(F.count("*").alias("n")), "adaptive-amounts")
    groups = counts.groupBy(*keys).agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("amount")) / F.sum("n")).alias("mean"))  # a row a bucket and fit
    run = global_running(counts, [("amount", True)], {"upto": "n"}, keys).join(F.broadcast(groups), keys)
    at = lambda place: F.min(F.when(F.expr(f"upto >= {place}"), F.col("amount")))
    spread = F.sum(F.col("n") * F.pow(F.col("amount") - F.col("mean"), F.lit(2.0)))
    return run.groupBy(*keys).agg(_middle(at("(all + 1) div 2"), at("all div 2 + 1")).alias("median"), F.sqrt(spread / F.nullif(F.first("all") - 1, F.lit(0))).alias("sd"))


def _adaptive_columns(i: int, everyone: float) -> list[Column]:
    """The columns of one fit, in the order of `ADAPTIVE`."""
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    amount, zero = F.col("amount"), F.lit(0)
    od, id_, med = F.coalesce(f"__out{i}", zero), F.coalesce(f"__into{i}", zero), F.coalesce(f"__own{i}", F.lit(everyone))
    pm, ps = F.coalesce(f"__pm{i}", F.lit(everyone)), F.coalesce(f"__ps{i}", F.lit(0.0))
    return [
        F.log1p(od), F.log1p(id_), F.when(od + id_ > 0, (od - id_) / (od + id_)).otherwise(0.0),
        F.log1p(clip(F.when(med > 0, amount / med).otherwise(1.0), 0.0, 1e6)), F.log1p(clip(F.when(pm > 0, amount / pm).otherwise(1.0), 0.0, 1e6)),
        clip(F.when(ps > 0, (amount - pm) / ps).otherwise(0.0), -50.0, 50.0), F.log1p(F.when(od > 0, amount / od).otherwise(amount)),
        F.when(F.col(f"__out{i}").isNull(), 1).otherwise(0), F.when(F.col(f"__into{i}").isNull(), 1).otherwise(0),
    ]
