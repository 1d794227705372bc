"""The transaction contract: label isolation, validation, summaries, capabilities, pattern and account joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.columns import NATURAL_KEY, when_
from tidewater.session import more_partitions

FORBIDDEN = ("is_laundering", "scenario_id", "pattern_type")
REQUIRED = {
    "transaction_id": T.StringType, "t_us": T.LongType, "source_account": T.StringType, "destination_account": T.StringType,
    "amount": T.DoubleType, "currency": T.StringType, "is_laundering": T.IntegralType,
}
OPTIONAL = {
    "row_pos", "cents", "payment_type", "scenario_id", "pattern_type", "amount_received", "currency_received", "is_self_transfer",
}


class ContractError(ValueError):
    """Raised when a frame breaks the transaction contract."""


def feature_view(df: DataFrame) -> DataFrame:
    return df.drop(*FORBIDDEN)


def label_view(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", *[c for c in FORBIDDEN if c in df.columns])


def assert_label_blind(df: DataFrame) -> None:
    found = [c for c in FORBIDDEN if c in df.columns]
    if found:
        raise ContractError(f"label columns reached a feature extractor: {', '.join(found)}")


def validate_schema(df: DataFrame) -> None:
    """Metadata first, then one aggregate for the labels; raises ContractError."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if missing := [c for c in REQUIRED if c not in kinds]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    if wrong := [c for c, k in REQUIRED.items() if not isinstance(kinds[c], k)]:
        raise ContractError(f"wrong types: {', '.join(wrong)}")
    if unknown := [c for c in kinds if c not in REQUIRED and c not in OPTIONAL]:
        raise ContractError(f"unknown columns: {', '.join(unknown)}")
    bad = df.agg(F.count_if(F.col("is_laundering").isNull() | ~F.col("is_laundering").isin(0, 1)).alias("n")).first()["n"]
    if bad:
        raise ContractError(f"{bad} labels are null or not 0/1")


def summarise(df: DataFrame) -> DataFrame:
    """One row: rows, accounts over both ends, positives, base rate, time span."""
    ends = df.select(F.explode(F.array("source_account", "destination_account")).alias("a")).agg(F.count_distinct("a").alias("accounts"))
    main = df.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("is_laundering"), F.lit(0)).cast("long").alias("positives"),
        F.avg("is_laundering").alias("base_rate"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
    )
    return main.crossJoin(F.broadcast(ends))  # one row by one row


def daily_profile(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date(when_()).alias("day")).agg(
        F.count("*").alias("rows"), F.sum("is_laundering").cast("long").alias("positives"), F.avg("is_laundering").alias("rate")
    )


def duplicates(df: DataFrame, key: tuple[str, ...], rows: int = 0) -> DataFrame:
    """One row: rows beyond the first of each key. `rows`, where it is known, bounds what one task groups."""
    if more := more_partitions(df.sparkSession, rows):
        df = df.select(*key).repartition(*more, *key)
    counts = df.groupBy(*key).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def findings(df: DataFrame) -> DataFrame:
    """(check, severity, n): content checks as rows; two aggregates over keys, one over rows."""
    one = df.agg(
        F.count_if(F.col("t_us").isNull()).alias("null_time"),
        F.count_if(F.col("amount") < 0).alias("negative_amount"),
        F.count_if(F.col("source_account").isNull() | F.col("destination_account").isNull()).alias("null_endpoint"),
        F.coalesce(F.sum("is_laundering"), F.lit(0)).cast("long").alias("positives"),
        F.count_if(F.col("amount") == 0).alias("zero_amount"),
        F.count_if(F.col("source_account") == F.col("destination_account")).alias("self_transfer"),
        F.count_if(~F.col("currency").eqNullSafe(F.col("currency_received"))).alias("cross_currency"),
        (F.floor((F.max("t_us") - F.min("t_us")) / 86_400_000_000)).cast("long").alias("span_days"),
        F.count_distinct("t_us").alias("distinct_times"),
    )
    one = one.crossJoin(F.broadcast(duplicates(df, ("transaction_id",)).withColumnRenamed("duplicates", "duplicate_id")))
    one = one.crossJoin(F.broadcast(duplicates(df, NATURAL_KEY).withColumnRenamed("duplicates", "duplicate_key")))
    errors = ("duplicate_id", "null_time", "negative_amount", "null_endpoint")
    warnings = ("zero_amount", "duplicate_key")
    notes = ("positives", "self_transfer", "cross_currency", "span_days", "distinct_times")
    rows = [F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.col(c).alias("n"))
            for s, group in (("error", errors), ("warning", warnings), ("info", notes)) for c in group]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def capabilities(df: DataFrame) -> DataFrame:
    """(capability, present, coverage) from content: an all-null or constant column gives no capability."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    one = df.agg(
        F.struct((F.max("is_laundering") == 1).alias("present"), share("is_laundering").alias("coverage")).alias("labels"),
        F.struct((F.count("scenario_id") > 0).alias("present"), share("scenario_id").alias("coverage")).alias("scenarios"),
        F.struct((F.count("pattern_type") > 0).alias("present"), share("pattern_type").alias("coverage")).alias("typology"),
        F.struct((F.count_distinct("currency") > 1).alias("present"), share("currency").alias("coverage")).alias("cross_currency"),
        F.struct((F.count_distinct("payment_type") > 1).alias("present"), share("payment_type").alias("coverage")).alias("payment_type"),
        F.struct((F.count_if(F.col("source_account") == F.col("destination_account")) > 0).alias("present"), share("source_account").alias("coverage")).alias("self_transfers"),
    )
    rows = [F.struct(F.lit(c).alias("capability"), F.coalesce(F.col(c)["present"], F.lit(False)).alias("present"), F.col(c)["coverage"].alias("coverage")) for c in one.columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_capabilities(found: DataFrame, needed: set[str]) -> list[str]:
    """What a consumer needs and the data lacks, sorted: the consumer is then skipped and reported."""
    have = {r.capability for r in found.filter("present").collect()}  # a handful of rows
    return sorted(needed - have)


def attach_patterns(df: DataFrame, patterns: DataFrame, key: tuple[str, ...] = NATURAL_KEY) -> DataFrame:
    """Left join on the natural key; keys whose pattern rows disagree stay null and are flagged ambiguous.

    `patterns` has the key columns, scenario_id and pattern_type.
    """
    sides = patterns.groupBy(*key).agg(
        F.count_distinct(F.struct("scenario_id", "pattern_type")).alias("__n"),
        F.min("scenario_id").alias("__s"), F.min("pattern_type").alias("__p"),
    )
    base = df.drop("scenario_id", "pattern_type").alias("l")
    matched = base.join(sides.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key], "left")
    return matched.select(
        "l.*", F.when(F.col("__n") == 1, F.col("__s")).alias("scenario_id"), F.when(F.col("__n") == 1, F.col("__p")).alias("pattern_type"),
        F.coalesce(F.col("__n") > 1, F.lit(False)).alias("ambiguous"),
    )


def unmatched_patterns(df: DataFrame, patterns: DataFrame, key: tuple[str, ...] = NATURAL_KEY) -> DataFrame:
    """Pattern rows without a transaction."""
    l, r = patterns.alias("l"), df.alias("r")
    return l.join(r, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key], "left_anti")


def orphan_accounts(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct endpoints that the account table lacks."""
    ends = df.select(F.explode(F.array("source_account", "destination_account")).alias("account_id")).distinct()
    return ends.join(accounts.select("account_id"), "account_id", "left_anti")


def varying_columns(df: DataFrame) -> DataFrame:
    """(column, varies) for numeric columns, from one aggregate of minima and maxima."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    one = df.agg(*[F.coalesce(F.max(c) > F.min(c), F.lit(False)).alias(c) for c in numeric])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("varies")) for c in numeric]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
