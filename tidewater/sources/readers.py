"""Readers: raw transfer and account CSV, pattern block files, edge tables, generic tables and feature parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import account_id
from tidewater.session import cut, global_position

RAW_COLUMNS = (
    "timestamp from_bank from_account to_bank to_account amount_received receiving_currency amount_paid payment_currency payment_format is_laundering"
).split()
ACCOUNT_COLUMNS = {"Bank Name": "bank_name", "Bank ID": "bank_id", "Account Number": "account", "Entity ID": "entity_id", "Entity Name": "entity_name"}
TIME_FORMAT = "yyyy/MM/dd HH:mm"


class SourceError(ValueError):
    """Raised when a file isn't laid out as its reader expects."""


def _canonical(raw: DataFrame, amount_side: str) -> DataFrame:
    if amount_side not in ("paid", "received"):
        raise SourceError("amount_side must be 'paid' or 'received'")
    paid, got = (F.col("amount_paid").cast("double"), F.col("payment_currency")), (F.col("amount_received").cast("double"), F.col("receiving_currency"))
    (amount, currency), (other, other_currency) = (paid, got) if amount_side == "paid" else (got, paid)
    source, destination = account_id("from_bank", "from_account"), account_id("to_bank", "to_account")
    return raw.select(
        "row_pos", F.format_string("TX%010d", "row_pos").alias("transaction_id"), F.unix_micros(F.to_timestamp("timestamp", TIME_FORMAT)).alias("t_us"),
        source.alias("source_account"), destination.alias("destination_account"), amount.alias("amount"), F.rint(amount * 100).cast("long").alias("cents"),
        currency.alias("currency"), F.col("is_laundering").cast("int").alias("is_laundering"), F.col("payment_format").alias("payment_type"),
        other.alias("amount_received"), other_currency.alias("currency_received"), F.when(source == destination, 1).otherwise(0).alias("is_self_transfer"),
    )


def load_transactions(spark: SparkSession, path: str, amount_side: str = "paid", nrows: int | None = None) -> DataFrame:
    """The 11-column raw layout, by position, as its header repeats a name; ids come from the place in the file.

    Rows are numbered by file name, then by position in the file: Spark deals files by size, but one file's
    splits keep their order. Rows are numbered per partition and offset, never in one task.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first or len(first[0].value.split(",")) != len(RAW_COLUMNS):
        raise SourceError(f"expected {len(RAW_COLUMNS)} columns")
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    placed = cut(raw.withColumn("__file", F.input_file_name()).withColumn("__m", F.monotonically_increasing_id()), "raw-rows")
    numbered = global_position(placed, [("__file", True), ("__m", True)], "row_pos").drop("__file", "__m")
    if nrows is not None:
        numbered = numbered.filter(F.col("row_pos") < nrows)
    return _canonical(numbered, amount_side)


def load_accounts(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    if missing := [c for c in ACCOUNT_COLUMNS if c not in raw.columns]:
        raise SourceError(f"missing columns: {', '.join(missing)}")
    return raw.select(
        account_id(F.col("`Bank ID`"), F.col("`Account Number`")).alias("account_id"), F.col("`Bank ID`").cast("long").alias("bank_id"),
        F.col("`Bank Name`").alias("bank_name"), F.col("`Entity ID`").alias("entity_id"), F.col("`Entity Name`").alias("entity_name"),
    )


_BEGIN, _END = r"^BEGIN LAUNDERING ATTEMPT - (.*)$", r"^END LAUNDERING ATTEMPT"


def parse_patterns(spark: SparkSession, path: str, amount_side: str = "paid") -> DataFrame:
    """Blocks of an annotation file as pattern rows; raises SourceError for broken blocks.

    An annotation file is one small text (one window over its lines), unlike the corpus it annotates.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("no", "line")).filter("trim(line) <> ''")
    w = Window.orderBy("no")
    begin, end = F.col("line").rlike(_BEGIN), F.col("line").rlike(_END)
    marked = lines.select(
        "no", "line", begin.alias("begin"), end.alias("end"), F.sum(begin.cast("int")).over(w).alias("opened"), F.sum(end.cast("int")).over(w).alias("closed")
    )
    depth = F.col("opened") - F.col("closed")
    bad = marked.agg(
        F.count("*").alias("n"), F.count_if(F.col("begin") & (depth > 1)).alias("nested"), F.count_if(F.col("end") & (depth < 0)).alias("stray"),
        (F.max("opened") - F.max("closed")).alias("open"), F.count_if(~F.col("begin") & ~F.col("end") & (depth < 1)).alias("outside"),
        F.count_if(~F.col("begin") & ~F.col("end") & (F.size(F.split("line", ",")) != len(RAW_COLUMNS))).alias("malformed"),
    ).first()
    faults = [k for k in ("nested", "stray", "open", "outside", "malformed") if bad[k]]
    if faults or not bad["n"]:
        raise SourceError("empty file" if not bad["n"] else f"broken blocks: {', '.join(faults)}")
    names = marked.filter("begin").select("opened", F.split(F.regexp_extract("line", _BEGIN, 1), ":")[0].alias("name"))
    body = marked.filter("NOT begin AND NOT end").join(names, "opened")
    fields = F.split("line", ",")
    raw = body.select("opened", "name", F.col("no").cast("long").alias("row_pos"), *[fields[i].alias(c) for i, c in enumerate(RAW_COLUMNS)])
    keyed = _canonical(raw, amount_side).select("row_pos", "t_us", "source_account", "destination_account", "cents", "currency", "payment_type")
    typology = F.upper(F.regexp_replace(F.trim("name"), " ", "_"))
    scenario = F.format_string("SC%06d", F.col("opened") - 1)
    return keyed.join(raw.select("row_pos", scenario.alias("scenario_id"), typology.alias("pattern_type")), "row_pos").drop("row_pos")


def load_edges(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transfers, account labels) from an edge table (src, dst, seconds, amount) and node flags (account, isp)."""
    placed = global_position(edges, [("seconds", True), ("src", True), ("dst", True), ("amount", True)], "row_pos")
    tx = placed.select(
        "row_pos", F.format_string("E%09d", "row_pos").alias("transaction_id"), (F.col("seconds") * 1_000_000).cast("long").alias("t_us"),
        F.col("src").alias("source_account"), F.col("dst").alias("destination_account"), "amount", F.rint(F.col("amount") * 100).cast("long").alias("cents"),
        F.lit("ETH").alias("currency"), F.lit(0).alias("is_laundering"), F.when(F.col("src") == F.col("dst"), 1).otherwise(0).alias("is_self_transfer"),
    )
    return tx, labels.select(F.col("account").alias("account_id"), F.col("isp").cast("int").alias("is_illicit"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, CSV or JSON by extension (Parquet without one), with the projection pushed to the scan."""
    kind = (re.search(r"\.(parquet|csv|json|orc)/?$", path) or [None, "parquet"])[1]
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    df = reader.format(kind).load(path)
    return df.select(*columns) if columns else df


SCORING = ("transaction_id", "timestamp", "source_account", "destination_account", "amount", "currency", "amount_received", "currency_received")


def read_scoring_input(spark: SparkSession, path: str) -> DataFrame:
    """Transfers to be scored, with the derived columns, numbered by time and id (one range shuffle)."""
    df = read_table(spark, path)
    if missing := [c for c in SCORING if c not in df.columns]:
        raise SourceError(f"missing columns: {', '.join(missing)}")
    df = df.withColumns({"t_us": F.unix_micros(F.col("timestamp").cast("timestamp")), "cents": F.rint(F.col("amount") * 100).cast("long")})
    if "is_self_transfer" not in df.columns:
        df = df.withColumn("is_self_transfer", F.when(F.col("source_account") == F.col("destination_account"), 1).otherwise(0))
    return global_position(df, [("t_us", True), ("transaction_id", True)], "row_pos")


def read_feature_parts(spark: SparkSession, path: str, rows: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Feature parts, restricted to `rows` (row_pos) and to given columns, or to those that vary over all parts."""
    from tidewater.operators.contract import varying_columns

    df = spark.read.parquet(path)
    if columns is None:
        columns = [r.column for r in varying_columns(df.drop("row_pos")).filter("varies").collect()]  # one entry a column
    df = df.select("row_pos", *columns)
    return df.join(rows.select("row_pos"), "row_pos", "left_semi") if rows is not None else df


def cache_is_complete(spark: SparkSession, path: str, rows: int) -> bool:
    """Whether the parts hold as many rows as expected, from the files' footers."""
    try:
        return spark.read.parquet(path).count() == rows
    except Exception as e:  # a missing folder is an incomplete cache; anything else is not ours to hide
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
