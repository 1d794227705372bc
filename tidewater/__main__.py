"""Command line: python -m tidewater ingest | baseline | graph | train | score | validate | ablation | transfer, each over canonical transfers.

`ingest` makes canonical transfers of a raw file; the other commands read its `transactions` folder. Every command
writes Parquet tables (score: CSV and JSON lines as well) below --out and prints one line of JSON.
"""

from __future__ import annotations

import argparse
import json

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.columns import DAY_US
from tidewater.operators import ablation, cases, checks, contract, gates, graph, history, metrics, model, splits
from tidewater.plans.data import with_score
from tidewater.plans.models import features
from tidewater.session import local_session
from tidewater.sources import readers, writers

BUDGETS = (0.001, 0.005, 0.01, 0.05)


def ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Raw transfers, checked, without the sparse tail, with patterns where a pattern file is given."""
    tx = readers.load_transactions(spark, a.raw, a.amount_side, a.nrows)
    contract.validate_schema(tx)
    tx, trimmed = splits.trim_sparse_tail(tx, a.min_density)
    if a.patterns:
        tx = contract.attach_patterns(tx, readers.parse_patterns(spark, a.patterns, a.amount_side))
    writers.write_table(tx, f"{a.out}/transactions")
    done = spark.read.parquet(f"{a.out}/transactions")
    writers.write_table(contract.findings(done), f"{a.out}/findings")
    return writers.dataset_summary(done, None if a.no_checksum else a.raw) | {"trimmed": trimmed}


def baseline(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Rule scores with amount limits fitted on the train part, metrics of the test part and its budget points."""
    tx = splits.chronological_split(read(spark, a))
    tx = with_score(tx, fitted_on=tx.filter("split = 'train'"))
    writers.write_table(tx.select("row_pos", "transaction_id", "is_laundering", "score", "split"), f"{a.out}/rule_scores")
    test = spark.read.parquet(f"{a.out}/rule_scores").filter("split = 'test'")
    writers.write_table(metrics.budget_points(test, BUDGETS), f"{a.out}/budget_points")
    return facts(metrics.evaluate(test))


def graph_features(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Feature parts of fan and degree, vertex statistics and account history over windows of --window-days."""
    tx, width = read(spark, a), int(a.window_days * DAY_US)
    parts = {"fan_degree": graph.fan_degree(tx, width), "vertex": graph.vertex_statistics(tx, width), "order": graph.order_statistics(tx, "cents", width)}
    if not a.drop_timestamp_stats:
        parts["timestamp"] = graph.timestamp_statistics(tx, width)
    for name, frame in (parts | {"behaviour": history.behaviour(tx)}).items():
        writers.write_feature_parts(frame, f"{a.out}/{name}")
    return {"parts": sorted([*parts, "behaviour"]), "window_days": a.window_days}


def train(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A package fitted on the train part and calibrated on the validation part, with its test metrics."""
    split, columns = prepared(spark, a)
    part = lambda s: split.filter(F.col("split") == s)
    package = model.fit(part("train"), part("val"), columns, threshold=a.threshold, iterations=a.iterations, depth=a.depth, seed=a.seed)
    package.save(spark, f"{a.out}/package")
    return facts(metrics.evaluate(model.score(part("test"), package))) | {"schema_hash": package.schema_hash}


def score(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Ranked scores and the best alerts' case documents by a saved package; --from and --until bound what is reported."""
    tx, package = read(spark, a), model.Package.load(spark, a.package)
    rows = history.emit(features(tx)[0], a.emit_from, a.emit_until)
    scored = model.score(rows, package).join(tx.select("row_pos", "source_account", "destination_account"), "row_pos")
    out = scored.select("rank", "row_pos", "transaction_id", "t_us", "source_account", "destination_account", "raw_score", "score", "alert")
    writers.write_table(out, f"{a.out}/score_table")
    done = spark.read.parquet(f"{a.out}/score_table")
    writers.write_scores(done, f"{a.out}/scores")
    if a.cases:
        writers.write_cases(cases.export(tx, done, a.cases), f"{a.out}/cases")
    return json.loads(writers.run_summary(done, schema_hash=package.schema_hash, threshold=package.threshold))


def validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Whether a score may be believed: every gate of a fit, with the null baselines, drift and a readable report."""
    split, columns = prepared(spark, a)
    tx = read(spark, a)
    fit = lambda train, val, seed: model.fit(train, val, columns, threshold=a.threshold, iterations=a.iterations, depth=a.depth, seed=seed)
    tables = {
        "gates": gates.evaluate_gates(tx, split, columns, fit, tuple(range(a.seed, a.seed + a.seeds))), "null_baselines": checks.null_baselines(with_score(tx)),
        "drift": checks.drift_table(split.filter("split = 'train'"), split.filter("split = 'test'"), columns),
    }
    for name, frame in tables.items():
        writers.write_table(frame, f"{a.out}/{name}")
    done = spark.read.parquet(f"{a.out}/gates")
    text = spark.createDataFrame([(gates.markdown(done),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{a.out}/report")
    counts = {r.status: r["count"] for r in done.groupBy("status").count().collect()}
    return {"tables": sorted(tables), "voided": done.first().voided, "gates": counts}


def ablate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Every arm over every seed on one split, with the verdict of each comparison against the seeds' deviation."""
    data, available = ablation.table(read(spark, a), int(a.window_days * DAY_US))
    arms = [x for x in ablation.ARMS if not a.arms or x.name in a.arms]
    runs = ablation.run(data, available, arms, a.seeds, ablation.trees(a.iterations, a.depth), at_once=a.at_once)
    writers.write_table(runs, f"{a.out}/runs")
    writers.write_table(ablation.by_arm(spark.read.parquet(f"{a.out}/runs")), f"{a.out}/arms")
    done = spark.read.parquet(f"{a.out}/arms")
    writers.write_table(ablation.compare(done), f"{a.out}/comparisons")
    verdicts = {f"{r.better} - {r.worse}": r.verdict for r in spark.read.parquet(f"{a.out}/comparisons").collect()}  # a row a pair of arms
    return {"arms": [x.name for x in arms], "seeds": list(a.seeds), "verdicts": verdicts}


def transfer(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A package on transfers that it was not fitted on: metrics of a time slice, what came before it being history alone."""
    tx, package = read(spark, a), model.Package.load(spark, a.package)
    rows = history.emit(features(tx)[0], a.slice_start, a.slice_end)
    kept = model.score(rows, package).select("row_pos", "transaction_id", "t_us", "is_laundering", "raw_score", "score", "rank", "alert")
    writers.write_table(kept.join(tx.select("row_pos", "payment_type", "pattern_type"), "row_pos"), f"{a.out}/scores")
    scored = spark.read.parquet(f"{a.out}/scores")
    flagged = metrics.flag_top(scored, a.budget)
    for name, frame in {"budget_points": metrics.budget_points(scored, BUDGETS), "diagnosis": checks.transfer_diagnosis(flagged)}.items():
        writers.write_table(frame, f"{a.out}/{name}")
    return facts(metrics.evaluate(scored)) | {"schema_hash": package.schema_hash, "budget": a.budget}


def read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    tx = readers.read_table(spark, a.transactions)
    if "row_pos" not in tx.columns:
        tx = readers.read_scoring_input(spark, a.transactions)
    absent = {"is_laundering": "int", "payment_type": "string", "pattern_type": "string"}
    return tx.withColumns({c: F.lit(None).cast(kind) for c, kind in absent.items() if c not in tx.columns})


def prepared(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    """Features of all transfers with their part, written once and reread, as several passes use them."""
    f, columns = features(read(spark, a))
    writers.write_table(splits.chronological_split(f), f"{a.out}/features")
    return spark.read.parquet(f"{a.out}/features"), columns


def facts(one_row: DataFrame) -> dict:
    return one_row.first().asDict()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewater", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments, transactions=True):
        c = sub.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        if transactions:
            c.add_argument("--transactions", required=True)
        c.add_argument("--out", required=True)
        for flags, options in arguments:
            c.add_argument(flags, **options)

    command("ingest", ingest, ("--raw", {"required": True}), ("--patterns", {}), ("--amount-side", {"default": "paid", "choices": ["paid", "received"]}),
            ("--nrows", {"type": int}), ("--min-density", {"type": float, "default": 0.05}), ("--no-checksum", {"action": "store_true"}), transactions=False)
    command("baseline", baseline)
    command("graph", graph_features, ("--window-days", {"type": float, "default": 1.0}), ("--drop-timestamp-stats", {"action": "store_true"}))
    command("train", train, ("--threshold", {"type": float, "default": 0.5}), ("--iterations", {"type": int, "default": 20}), ("--depth", {"type": int, "default": 4}),
            ("--seed", {"type": int, "default": 7}))
    command("score", score, ("--package", {"required": True}), ("--cases", {"type": int, "default": 10}),
            ("--emit-from", {"type": int, "help": "microseconds since the epoch"}), ("--emit-until", {"type": int}))
    command("validate", validate, ("--threshold", {"type": float, "default": 0.5}), ("--iterations", {"type": int, "default": 20}), ("--depth", {"type": int, "default": 4}),
            ("--seed", {"type": int, "default": 7}), ("--seeds", {"type": int, "default": 1}))
    command("ablation", ablate, ("--seeds", {"type": int, "nargs": "*", "default": list(ablation.SEEDS)}), ("--arms", {"nargs": "*", "choices": [x.name for x in ablation.ARMS]}),
            ("--iterations", {"type": int, "default": 20}), ("--depth", {"type": int, "default": 4}), ("--window-days", {"type": float, "default": 1.0}),
            ("--at-once", {"type": int, "default": 4}))
    command("transfer", transfer, ("--package", {"required": True}), ("--budget", {"type": float, "default": 0.01}),
            ("--slice-start", {"type": int, "help": "microseconds since the epoch"}), ("--slice-end", {"type": int}))
    return p


def session() -> SparkSession:
    """The session that spark-submit describes; a local one where no master is set."""
    if SparkConf().get("spark.master"):
        return SparkSession.builder.getOrCreate()
    return local_session("tidewater", "*")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(arguments)
    spark = spark or session()
    out = a.run(spark, a)
    print(json.dumps(out, sort_keys=True, default=str))
    return out


if __name__ == "__main__":
    main()
