"""Sinks: tables, feature parts, ranked scores, case documents, summaries and a run registry."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators.cases import as_text, from_text


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_feature_parts(df: DataFrame, path: str, rows_per_part: int = 250_000) -> None:
    """Parts of bounded size; an overwrite removes stale ones first."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_part).parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """CSV parts in rank order: parts are ranges of the rank, each sorted."""
    scores.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").option("header", True).csv(path)


def write_cases(cases: DataFrame, path: str) -> None:
    """One line of JSON a case, top fields in alphabetical order; `read_cases` refuses what was changed."""
    as_text(cases).select("value").write.mode("overwrite").text(path)


def read_cases(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return from_text(spark.read.text(path), schema)


def run_summary(scores: DataFrame, **facts: object) -> str:
    """Counts of a scoring run, with the given facts, as sorted JSON."""
    r = scores.agg(F.count("*").alias("n_transactions"), F.count_if("alert").alias("n_alerts")).first()
    return json.dumps(r.asDict() | facts, sort_keys=True, indent=2, default=str)


def dataset_summary(df: DataFrame, path: str | None = None) -> dict:
    """Counts, the daily profile and, with a path, a checksum a source file."""
    from tidewater.operators.contract import daily_profile, summarise

    out = summarise(df).first().asDict()
    out["days"] = [r.asDict() for r in daily_profile(df).orderBy("day").collect()]  # one row a day
    if path:
        files = df.sparkSession.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
        out["files"] = {r.path.rpartition("/")[2]: r.sha256 for r in files.collect()}
    return out


def register_run(runs: DataFrame, path: str) -> None:
    """Appends run rows to the registry table."""
    runs.write.mode("append").parquet(path)
