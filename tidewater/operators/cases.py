"""Case documents: nested, self-consistent records of traced money around each alerted account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.functions.columns import case_id, iso, reason_code
from tidewater.operators.ranking import subjects
from tidewater.operators.trace import Trace, TraceLimits, trace

#: The reach and the limits of a case's trace.
CASE_HORIZON = 3
CASE_LIMITS = TraceLimits(16, 200)


class CaseError(ValueError):
    """Raised when stored case documents cannot be trusted."""


def build(trace: Trace, rails: DataFrame, risk: DataFrame) -> DataFrame:
    """One nested document a seed.

    `rails`: (row_pos, transaction_id, payment_type); `risk`: (seed, score, rank). Aggregates come from the
    path itself. A trace is within its budget, so a case's arrays are bounded by it.
    """
    path = trace.edges.join(rails, "row_pos")
    step = F.struct(
        "depth", "t_us", "row_pos", F.col("transaction_id"), F.col("src").alias("from"), F.col("dst").alias("to"), "cents",
        iso().alias("at"), F.coalesce("payment_type", F.lit("unknown")).alias("payment_type"),
    )
    steps = path.groupBy("seed").agg(F.array_sort(F.collect_list(step)).alias("path"))
    hops = trace.per_hop().groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("depth", "n", "accounts", "cents"))).alias("per_hop"))
    kinds = path.groupBy("seed", F.coalesce("payment_type", F.lit("unknown")).alias("rail")).agg(F.count("*").alias("n"))
    coverage = kinds.groupBy("seed").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rail", "n")))).alias("rails"))
    ends = trace.terminals.groupBy("seed").agg(F.array_sort(F.collect_set("account")).alias("terminals"))
    j = risk.join(steps, "seed", "left").join(hops, "seed", "left").join(coverage, "seed", "left").join(ends, "seed", "left").join(trace.status, "seed", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    ids = F.coalesce(F.transform("path", lambda p: p["transaction_id"]), F.array().cast("array<string>"))
    accounts = F.array_sort(F.array_distinct(F.concat(F.array("seed"), F.coalesce(F.flatten(F.transform("path", lambda p: F.array(p["from"], p["to"]))), F.array().cast("array<string>")))))
    return j.select(
        case_id(ids, F.col("seed")).alias("case_id"), "seed", F.struct("score", "rank").alias("risk"), ids.alias("transaction_ids"), accounts.alias("accounts"),
        "path", F.struct("per_hop", none(F.col("terminals"), "array<string>").alias("terminals"), F.struct("exhausted", "capped", "complete").alias("truncation")).alias("trace"),
        F.struct("rails").alias("coverage"), F.array().cast("array<string>").alias("investigator_notes"), F.lit("open").alias("disposition"),
    )


def reasons(trace: Trace, ids: DataFrame, contribs: DataFrame, features: list[str], top: int = 8) -> DataFrame:
    """(seed, reasons): the largest summed contributions over a case's transfers, with the transfers that drive each."""
    rows = trace.edges.select("seed", "row_pos").join(ids, "row_pos").join(contribs, "transaction_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("c")) for f in features]))
    tall = rows.select("seed", "transaction_id", pairs.alias("x")).select("seed", "transaction_id", "x.*")
    total = tall.groupBy("seed", "feature").agg(
        F.sum("c").alias("total"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("c")).alias("w"), "transaction_id"))), 1, 5), lambda x: x["transaction_id"]).alias("driven_by")
    )
    w = Window.partitionBy("seed").orderBy(F.desc(F.abs("total")), "feature")
    best = total.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top)
    return best.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("k", "feature", reason_code("feature", "total").alias("code"), "total", "driven_by"))).alias("reasons"))


def inconsistencies(cases: DataFrame) -> DataFrame:
    """(case_id, fault): documents whose stated aggregates differ from their path; none when all agree."""
    p = F.coalesce("path", F.array().cast(cases.schema["path"].dataType))
    hop_sum = lambda of: F.aggregate(F.coalesce("trace.per_hop", F.array().cast(cases.schema["trace"].dataType["per_hop"].dataType)), F.lit(0).cast("long"), lambda a, h: a + h[of])
    faults = F.array_compact(F.array(
        F.when(F.col("transaction_ids") != F.transform(p, lambda x: x["transaction_id"]), "transaction_ids"),
        F.when(F.size(F.array_except(F.flatten(F.transform(p, lambda x: F.array(x["from"], x["to"]))), F.col("accounts"))) > 0, "accounts"),
        F.when(hop_sum("n") != F.size(p), "per_hop_count"),
        F.when(hop_sum("cents") != F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["cents"]), "per_hop_sum"),
        F.when(F.aggregate(F.coalesce(F.map_values("coverage.rails"), F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, n: a + n) != F.size(p), "rails"),
        F.when(F.col("case_id") != case_id(F.col("transaction_ids"), F.col("seed")), "case_id"),
    ))
    return cases.select("case_id", F.explode(faults).alias("fault"))


def export(df: DataFrame, ranked: DataFrame, n: int = 10) -> DataFrame:
    """Documents of the n best-ranked alerted accounts, each traced forward from its best alert.

    `ranked`: transfers with score, rank and alert. An account's alert is a transfer of its own, so its trace holds
    that one at least; at most n seeds reach the trace.
    """
    best = subjects(ranked, n).select(F.col("source_account").alias("seed"), F.col("t_us").alias("at_us"), "score", "rank")
    rails = df.select("row_pos", "transaction_id", "payment_type")
    return build(trace(df, best.select("seed", "at_us"), "forward", CASE_HORIZON, CASE_LIMITS), rails, best.select("seed", "score", "rank"))


def rail_coverage(cases: DataFrame) -> DataFrame:
    """(case_id, n, n_unknown, warning): how many of a case's transfers have no payment type; a warning if any."""
    rails = F.coalesce("coverage.rails", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<long>")))
    total = F.aggregate(F.map_values(rails), F.lit(0).cast("long"), lambda a, n: a + n)
    unknown = F.coalesce(F.try_element_at(rails, F.lit("unknown")), F.lit(0).cast("long"))
    warning = F.when(unknown > 0, F.format_string("%d of %d transfers have no payment type", unknown, total))
    return cases.select("case_id", total.alias("n"), unknown.alias("n_unknown"), warning.alias("warning"))


def as_text(cases: DataFrame) -> DataFrame:
    """(case_id, value): a document as one line of JSON, its top fields in alphabetical order; nulls are left out."""
    return cases.select("case_id", F.to_json(F.struct(*sorted(cases.columns))).alias("value"))


def from_text(lines: DataFrame, schema: StructType) -> DataFrame:
    """Documents of `value` lines. Raises CaseError unless every line, written again, is the same line.

    So unknown fields, other types, broken lines and another field order are refused. `schema` is that of the written
    documents. The check is one pass that brings one line at most to the driver.
    """
    ordered = StructType(sorted(schema.fields, key=lambda f: f.name))
    parsed = lines.select("value", F.from_json("value", ordered).alias("doc"))
    bad = parsed.filter(~F.to_json("doc").eqNullSafe(F.col("value"))).select("value").first()
    if bad is not None:
        raise CaseError(f"not a document as written: {(bad.value or '')[:120]}")
    return parsed.select("doc.*").select(*schema.names)
