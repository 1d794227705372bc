"""Pure column builders: row features, rules, keys, buckets, names. Nothing here starts a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def when_(t_us: str | Column = "t_us") -> Column:
    return F.timestamp_micros(_c(t_us))


# --- row features -------------------------------------------------------------------------------


def amount_log(amount: str | Column = "amount") -> Column:
    return F.log1p(F.greatest(_c(amount), F.lit(0.0)))


def is_round(amount: str | Column, unit: int) -> Column:
    return F.when(F.pmod(_c(amount), F.lit(float(unit))) == 0, 1).otherwise(0)


def decimals(amount: str | Column = "amount") -> Column:
    """Half-even hundredths of the fractional part; 99.996 gives 100."""
    return F.rint(F.pmod(_c(amount), F.lit(1.0)) * 100).cast("smallint")


def amount_ratio(amount: str | Column = "amount", received: str | Column = "amount_received") -> Column:
    a, r = _c(amount), _c(received)
    return F.least(F.greatest(F.when(a > 0, r / a).otherwise(1.0), F.lit(0.0)), F.lit(1e6))


def cross_currency(a: str | Column = "currency", b: str | Column = "currency_received") -> Column:
    """1 where the legs differ; a null on one side differs, two nulls do not."""
    return F.when(_c(a).eqNullSafe(_c(b)), 0).otherwise(1)


def row_feature_columns(payment_type: bool = True) -> list[Column]:
    """The row-local features; day of week is left out on purpose."""
    t = when_()
    block = [
        amount_log().alias("tx_amount_log"),
        is_round("amount", 1000).alias("tx_amount_is_round_1k"),
        is_round("amount", 100).alias("tx_amount_is_round_100"),
        decimals().alias("tx_amount_decimals"),
        F.hour(t).alias("tx_hour"),
        (F.hour(t) * 60 + F.minute(t)).alias("tx_minute_of_day"),
        F.col("is_self_transfer").cast("int").alias("tx_is_self_transfer"),
        amount_log("amount_received").alias("tx_amount_received_log"),
        amount_ratio().alias("tx_amount_ratio"),
        cross_currency().alias("tx_is_cross_currency"),
    ]
    return [*block, F.col("payment_type").alias("tx_payment_type")] if payment_type else block


def row_features(df: DataFrame, payment_type: bool = True) -> DataFrame:
    """The row-local feature block, keyed by transaction."""
    return df.select("transaction_id", *row_feature_columns(payment_type))


def category_codes(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Adds `<column>_code`: alphabetical codes fitted on `train`; unseen and null values are -1."""
    from tidewater.session import global_position

    values = global_position(train.select(F.col(column).alias("__v")).filter("__v IS NOT NULL").distinct(), [("__v", True)], "__code")
    joined = df.join(values, df[column] == F.col("__v"), "left")
    return joined.withColumn(f"{column}_code", F.coalesce(F.col("__code"), F.lit(-1)).cast("long")).drop("__v", "__code")


# --- rules --------------------------------------------------------------------------------------

#: Rule names and weights.
RULE_WEIGHTS = {
    "large_amount": 1.0,
    "very_large_amount": 1.5,
    "cross_currency": 0.75,
    "round_amount": 0.5,
    "odd_hour": 0.25,
    "non_self_transfer": 0.25,
}


def rule_columns(columns: list[str], q99: float, q999: float) -> dict[str, Column]:
    """The rules that the columns present allow, as Booleans."""
    rules: dict[str, Column] = {}
    if "amount" in columns:
        rules["large_amount"] = F.col("amount") > q99
        rules["very_large_amount"] = F.col("amount") > q999
        rules["round_amount"] = F.pmod(F.col("amount"), F.lit(1000.0)) == 0
    if "t_us" in columns:
        hour = F.hour(when_())
        rules["odd_hour"] = (hour < 6) | (hour >= 22)
    if {"currency", "currency_received"} <= set(columns):
        rules["cross_currency"] = cross_currency() == 1
    if "is_self_transfer" in columns:
        rules["non_self_transfer"] = F.col("is_self_transfer") == 0
    return rules


def rule_score(rules: dict[str, Column]) -> Column:
    """Weight of the rules that fire over the weight of those applicable."""
    total = sum(RULE_WEIGHTS[n] for n in rules)
    fired = F.lit(0.0)
    for n, c in rules.items():
        fired = fired + F.when(c, RULE_WEIGHTS[n]).otherwise(0.0)
    return fired / F.lit(total)


# --- keys, hashes, buckets -------------------------------------------------------------------------


def account_id(bank: str | Column, account: str | Column) -> Column:
    """`bank:account` with the bank as a plain integer; a bank that isn't a number raises under ANSI."""
    return F.concat_ws(":", _c(bank).cast("long").cast("string"), _c(account))


def iso(t_us: str | Column = "t_us") -> Column:
    return F.date_format(when_(t_us), "yyyy-MM-dd'T'HH:mm:ss'Z'")


NATURAL_KEY = ("t_us", "source_account", "destination_account", "cents", "currency", "payment_type")


def schema_hash(columns: list[str]) -> str:
    import hashlib

    return hashlib.sha256("|".join(columns).encode()).hexdigest()[:16]


def case_id(ids: Column, root: Column) -> Column:
    """A stable short name from the transactions of a case, or from its root account when there are none."""
    text = F.when(F.size(ids) > 0, F.array_join(ids, "|")).otherwise(root)
    return F.concat(F.lit("CASE-"), F.substring(F.sha2(text, 256), 1, 8))


def hash_percent(key: str | Column) -> Column:
    """0 to 99 from the first 32 bits of the key's md5."""
    return F.pmod(F.conv(F.substring(F.md5(_c(key)), 1, 8), 16, 10).cast("long"), F.lit(100))


def in_account_holdout(key: str | Column, percent: int = 30) -> Column:
    return hash_percent(key) < percent


def reason_code(feature: str | Column, contribution: str | Column) -> Column:
    return F.concat(F.upper(_c(feature)), F.when(_c(contribution) > 0, "_RAISED").otherwise("_LOWERED"))


def family(feature: str | Column) -> Column:
    return F.substring_index(_c(feature), "_", 1)


def hour_band(hour: str | Column) -> Column:
    h = _c(hour)
    return F.when(h <= 5, "night").when(h <= 11, "morning").when(h <= 17, "afternoon").otherwise("evening")


def pattern_position(rank: Column, size: Column) -> Column:
    at = (rank - 1) / size
    return F.when(at <= 0.33, "early").when(at <= 0.66, "middle").otherwise("late")


#: Lower edges of the degree buckets.
DEGREE_EDGES = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256)


def degree_bucket(degree: str | Column) -> Column:
    """1-based bucket of left-closed edges; a negative degree is bucket 0."""
    d = _c(degree)
    out = F.lit(0)
    for e in DEGREE_EDGES:
        out = out + F.when(d >= e, 1).otherwise(0)
    return out


# --- plain-English labels of feature columns ----------------------------------------------------------


def pattern_columns(stat_columns: tuple[str, ...] = ("amount",)) -> list[tuple[str, str]]:
    """(column, label) of the graph-pattern block in layout order, made from the bins and frames."""
    out: list[tuple[str, str]] = []
    for name, label in (
        ("fan_in", "distinct senders into the receiver"), ("fan_out", "distinct receivers from the sender"),
        ("degree_in", "transfers into the receiver"), ("degree_out", "transfers out of the sender"),
        ("scatter_gather", "scatter-gather patterns by intermediaries"), ("temporal_cycle", "cycles in time order by length"),
    ):
        out += [(f"pat_{name}_{b}", f"{label}: {b}{' or more' if b == 30 else ''}") for b in range(2, 31)]
    out += [(f"pat_lc_cycle_{b}", f"simple cycles by length: {b}{' or more' if b == 10 else ''}") for b in range(2, 11)]
    for end in ("sender", "receiver"):
        for way in ("outgoing", "incoming"):
            base = f"pat_{end}_{way}"
            out += [(f"{base}_counterparties", f"{end}: distinct {way} counterparties"), (f"{base}_count", f"{end}: {way} transfers"),
                    (f"{base}_ratio", f"{end}: {way} fan/degree ratio")]
            for s in stat_columns:
                out += [(f"{base}_{s}_{m}", f"{end}: {m} of {way} {s}") for m in ("mean", "sum", "variance", "skew", "kurtosis")]
    return out


def timestamp_stat_columns(stat_columns: tuple[str, ...] = ("amount", "timestamp")) -> list[str]:
    return [c for c, label in pattern_columns(stat_columns) if "timestamp" in label]
