"""Chronological splits, folds and corpus windowing; boundaries are observed times, so no instant spans one."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import when_
from tidewater.operators.contract import daily_profile
from tidewater.session import global_running


class SplitError(ValueError):
    """Raised when a split cannot be formed as asked."""


@dataclass(frozen=True)
class SplitSpec:
    train: float = 0.7
    val: float = 0.15
    policy: str = "hard_cut"
    buffer_us: int | None = None

    def __post_init__(self) -> None:
        if not (0 < self.train < 1 and 0 < self.val < 1 and self.train + self.val < 1):
            raise SplitError("fractions must lie in (0, 1) and sum to less than 1")
        if self.policy not in ("hard_cut", "purge", "pattern_start"):
            raise SplitError(f"unknown policy {self.policy!r}")


def trim_sparse_tail(df: DataFrame, least_density: float = 0.05) -> tuple[DataFrame, dict]:
    """Drops the trailing run of days with fewer rows than `least_density` of the third quartile; reports what went."""
    days = daily_profile(df).select("day", "rows")
    cut = days.agg(F.percentile("rows", 0.75).alias("q"), F.count("*").alias("n")).first()
    if cut["n"] < 2:
        return df, {"threshold": None, "last_day": None}
    threshold = cut["q"] * least_density
    last = days.filter(F.col("rows") >= threshold).agg(F.max("day")).first()[0]
    return df.filter(F.to_date(when_()) <= F.lit(last)), {"threshold": threshold, "last_day": last}


def _boundaries(df: DataFrame, positions: list[int]) -> list[int]:
    """The observed time at each 0-based position of the sorted times: counts per distinct time, then running totals."""
    counts = df.groupBy("t_us").agg(F.count("*").alias("n"))
    run = global_running(counts, [("t_us", True)], {"upto": "n"})
    found = run.agg(*[F.min(F.when(F.col("upto") > p, F.col("t_us"))).alias(f"b{i}") for i, p in enumerate(positions)]).first()
    return [found[f"b{i}"] for i in range(len(positions))]


def boundaries(df: DataFrame, spec: SplitSpec) -> tuple[int, int]:
    """The last instants of the train and of the validation part; where the second is the last of all, the test part is empty."""
    n = df.count()
    if n < 3:
        raise SplitError("need at least three rows")
    place = lambda f: min(max(int(_half_even(n * f)), 1), n - 1) - 1
    first, second = _boundaries(df, [place(spec.train), place(spec.train + spec.val)])
    if not first < second:
        raise SplitError("boundaries collapse; times are too coarse")
    return first, second


def _half_even(x: float) -> int:
    return round(x)


def pattern_key(df: DataFrame) -> str | None:
    """The column that names pattern instances: scenario_id where it has values, else pattern_type, else none."""
    for c in ("scenario_id", "pattern_type"):
        if c in df.columns and df.agg(F.count(c)).first()[0]:
            return c
    return None


def pattern_spans(df: DataFrame, key: str = "scenario_id") -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count("*").alias("n"))


def chronological_split(df: DataFrame, spec: SplitSpec | None = None) -> DataFrame:
    """Adds `split`: train, val or test; only the purge policy drops rows."""
    spec = spec or SplitSpec()
    b1, b2 = boundaries(df, spec)
    name = lambda t: F.when(t <= b1, "train").when(t <= b2, "val").otherwise("test")
    if spec.policy == "hard_cut":
        return df.withColumn("split", name(F.col("t_us")))
    key = pattern_key(df)
    if spec.policy == "purge":
        buffer = spec.buffer_us
        if buffer is None:
            if key is None:
                raise SplitError("purge needs a pattern column or a buffer")
            buffer = pattern_spans(df, key).agg(F.max(F.col("last_us") - F.col("first_us"))).first()[0]
        inside = F.lit(False)
        for b in (b1, b2):
            inside = inside | ((F.col("t_us") > b - buffer) & (F.col("t_us") <= b + buffer))
        return df.filter(~inside).withColumn("split", name(F.col("t_us")))
    if key is None:
        return df.withColumn("split", name(F.col("t_us")))
    starts = pattern_spans(df, key).select(F.col(key).alias("__k"), "first_us")
    joined = df.join(starts, df[key] == F.col("__k"), "left")
    return joined.withColumn("split", name(F.coalesce("first_us", "t_us"))).drop("__k", "first_us")


def spanning_patterns(df: DataFrame, spec: SplitSpec, key: str = "scenario_id") -> int:
    b1, b2 = boundaries(df, spec)
    spans = pattern_spans(df, key)
    crosses = lambda b: (F.col("first_us") <= b) & (F.col("last_us") > b)
    return spans.filter(crosses(b1) | crosses(b2)).count()


def assign_unseen(df: DataFrame, held_out: list[str]) -> DataFrame:
    """Positives of the held-out typologies are test; other positives train; negatives are halved by a hash of the id."""
    half = F.when(F.pmod(F.conv(F.substring(F.md5("transaction_id"), 1, 8), 16, 10).cast("long"), F.lit(2)) == 0, "train").otherwise("test")
    positive = F.when(F.coalesce(F.col("pattern_type").isin(held_out), F.lit(False)), "test").otherwise("train")
    return df.withColumn("split", F.when(F.col("is_laundering") == 1, positive).otherwise(half))


def unseen_typology_split(df: DataFrame, held_out: list[str] | None = None, n_held_out: int = 2, seed: int = 42) -> DataFrame:
    """`assign_unseen` over typologies that the data hold.

    Without `held_out`, `n_held_out` typologies are drawn by a seeded hash, one at least staying in training.
    Refused: a frame without annotations, a typology it does not hold, and holding out all of them.
    """
    known = sorted(r[0] for r in df.filter("is_laundering = 1 AND pattern_type IS NOT NULL").select("pattern_type").distinct().collect())  # a handful of names
    if not known:
        raise SplitError("no positive is annotated, so no typology can be held out")
    if held_out is None:
        drawn = sorted(known, key=lambda t: hashlib.md5(f"{seed}:{t}".encode()).hexdigest())
        held_out = sorted(drawn[: min(n_held_out, max(1, len(known) - 1))])
    if unknown := sorted(set(held_out) - set(known)):
        raise SplitError(f"typologies that the data do not hold: {', '.join(unknown)}")
    if not set(known) - set(held_out):
        raise SplitError("one typology at least must stay in training")
    return assign_unseen(df, held_out)


def annotation_coverage(df: DataFrame) -> DataFrame:
    return df.filter("is_laundering = 1").agg(F.avg(F.col("pattern_type").isNotNull().cast("int")).alias("coverage"))


def rolling_origin(df: DataFrame, n_folds: int = 3, least_train: float = 0.4) -> DataFrame:
    """(fold, train_end_us, val_end_us, n_train, n_val): forward-walking folds; collapsed ones are left out."""
    if n_folds < 1:
        raise SplitError("need at least one fold")
    n = df.count()
    start = int(n * least_train)
    block = (n - start) // n_folds
    if block < 1 or start < 1:
        raise SplitError("folds would be empty")
    ends = [start + i * block - 1 for i in range(n_folds + 1)]
    at = _boundaries(df, ends)
    folds = [(i, a, b) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
    if not folds:
        raise SplitError("no usable folds; times are too coarse")
    table = df.sparkSession.createDataFrame(folds, "fold int, train_end_us long, val_end_us long")
    sizes = [F.count_if(F.col("t_us") <= a).alias(f"t{i}") for i, a, _ in folds] + [F.count_if((F.col("t_us") > a) & (F.col("t_us") <= b)).alias(f"v{i}") for i, a, b in folds]
    counted = df.agg(*sizes).first()
    rows = [(i, a, b, counted[f"t{i}"], counted[f"v{i}"]) for i, a, b in folds]
    return table.sparkSession.createDataFrame(rows, "fold int, train_end_us long, val_end_us long, n_train long, n_val long")


def proxy_labels(df: DataFrame, illicit: DataFrame, percent: int = 30) -> DataFrame:
    """Transfers with a weak label from train-side illicit accounts; eval-side accounts are for scoring only.

    `illicit` has account_id; an account is on the eval side by a hash of its id.
    """
    from tidewater.functions.columns import in_account_holdout

    train = illicit.filter(~in_account_holdout("account_id", percent)).select("account_id").distinct()
    s = train.select(F.col("account_id").alias("__s"), F.lit(True).alias("__hs"))
    d = train.select(F.col("account_id").alias("__d"), F.lit(True).alias("__hd"))
    j = df.join(s, df["source_account"] == F.col("__s"), "left").join(d, df["destination_account"] == F.col("__d"), "left")
    hit = F.coalesce("__hs", F.lit(False)) | F.coalesce("__hd", F.lit(False))
    return j.withColumn("proxy_label", hit.cast("int")).drop("__s", "__hs", "__d", "__hd")


def time_buckets(df: DataFrame, n: int = 5) -> DataFrame:
    """Adds `bucket`: 0 to n-1, equal slices of the time span, the last one closed."""
    lo, hi = df.agg(F.min("t_us"), F.max("t_us")).first()
    if lo is None or hi == lo:
        return df.withColumn("bucket", F.lit(0).cast("long"))
    return df.withColumn("bucket", F.least(F.floor((F.col("t_us") - lo) * n / (hi - lo)), F.lit(n - 1)).cast("long"))


