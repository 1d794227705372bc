"""Ablation: arms that differ in one thing each, fitted over several seeds, and whether their differences outgrow the seeds.

Fits run as concurrent Spark jobs over one written table. Each scores the test part once; all scores together are one table of
(arm, seed) groups, which is measured in one plan whatever the number of arms and seeds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import columns as C
from tidewater.operators import checks, contract, graph, history, metrics, model, splits
from tidewater.session import cut, global_running

SEEDS = (42, 7, 123, 2024, 31337)

#: Takes train, validation and test rows, the arm's columns and a seed; returns the test rows with `score`.
FitPredict = Callable[[DataFrame, DataFrame, DataFrame, list[str], int], DataFrame]


@dataclass(frozen=True)
class Arm:
    """What one arm sees: the columns of these names or prefixes (ending in `_`), and which column names its parts."""

    name: str
    description: str
    blocks: tuple[str, ...]
    split: str = "split"

    def columns(self, available: Sequence[str]) -> list[str]:
        return [c for c in available if any(c == b or (b.endswith("_") and c.startswith(b)) for b in self.blocks)]


#: The split column of a deliberate leak: parts drawn at random, so that later transfers of an account are trained on.
LEAK = "leak_split"
RAIL = "rail_code"
ARMS = (
    Arm("A1", "transaction features with the payment type", ("tx_", RAIL)),
    Arm("A2", "transaction features without the payment type", ("tx_",)),
    Arm("A3", "with graph features and the payment type", ("tx_", RAIL, "bh_", "gr_")),
    Arm("A4", "with graph features, without the payment type", ("tx_", "bh_", "gr_")),
    Arm("A5", "with the adaptive neighbourhood, no graph", ("tx_", "adp_")),
    Arm("A6", "with graph features and the adaptive neighbourhood", ("tx_", "bh_", "gr_", "adp_")),
    Arm("E_LEAK", "deliberate leak: random parts, encodings fitted on all rows", ("tx_", "all_adp_"), LEAK),
)
COMPARISONS = (
    ("A1", "A2", "what the payment type adds"),
    ("A3", "A1", "graph features, payment type present"),
    ("A4", "A2", "graph features, payment type removed"),
    ("A5", "A2", "adaptive neighbourhood alone"),
    ("A6", "A4", "adaptive neighbourhood on top of the graph"),
    ("E_LEAK", "A2", "what a leak would seem to add"),
)


def random_parts(df: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42, name: str = LEAK) -> DataFrame:
    """Adds parts drawn by a hash of the transaction, whatever its time: a control that leaks on purpose, never a protocol."""
    u = checks.hash_unit(seed=seed)
    return df.withColumn(name, F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def table(tx: DataFrame, window_us: int = C.DAY_US) -> tuple[DataFrame, list[str]]:
    """Every arm's columns by transfer, with both splits, written once: each fitted encoding from the train part alone.

    The columns of `all_adp_` are fitted on all rows; only the leaking arm reads them.
    """
    rows = random_parts(splits.chronological_split(tx))
    own = ["row_pos", "transaction_id", "t_us", "is_laundering", "split", LEAK]
    read = ["source_account", "destination_account", "amount", "cents", "currency", "payment_type", "amount_received", "currency_received", "is_self_transfer"]
    parts = cut(rows.select(*own, *read), "ablation-parts")
    blind = contract.feature_view(parts)
    fan = graph.fan_degree(blind, window_us)
    fan = fan.select("row_pos", *[F.col(c).alias(f"gr_{c}") for c in fan.columns if c not in ("row_pos", "transaction_id")])
    early = F.col("split") == "train"
    out = parts.select(*own, "source_account", "destination_account", "amount", "payment_type", *C.row_feature_columns(payment_type=False))
    out = C.category_codes(parts.filter(early), out, "payment_type").withColumnRenamed("payment_type_code", RAIL)
    out = graph.with_adaptive(parts, out, {"": early, "all_": F.lit(True)})
    block = lambda *of: [c for c in out.columns if c.startswith(of)]
    out = out.select(*own, RAIL, *block("tx_"), *block("adp_", "all_adp_"))
    out = out.join(history.behaviour(blind), "row_pos").join(fan, "row_pos", "left")  # self-transfers are outside the graph
    made = cut(out, "ablation-table")
    return made, [c for c in made.columns if c == RAIL or c.startswith(("tx_", "bh_", "gr_", "adp_", "all_adp_"))]


@dataclass(frozen=True)
class Trees:
    """Boosted trees whose seed draws rows, so that seeds differ; the score is the raw one, so nothing is calibrated."""

    iterations: int
    depth: int
    subsample: float
    patience: int

    def prepare(self, data: DataFrame, columns: list[str]) -> DataFrame:
        return model.assembled(data, columns)

    def fit(self, train: DataFrame, val: DataFrame, columns: list[str], seed: int) -> model.Package:
        return model.fit(train, val, columns, iterations=self.iterations, depth=self.depth, seed=seed, subsample=self.subsample, calibrate=False, patience=self.patience)

    def __call__(self, train: DataFrame, val: DataFrame, test: DataFrame, columns: list[str], seed: int) -> DataFrame:
        return model.margin(test, self.fit(train, val, columns, seed)).withColumn("score", F.col("raw_score"))


def trees(iterations: int = 300, depth: int = 6, subsample: float = 0.8, patience: int = 100) -> Trees:
    return Trees(iterations, depth, subsample, patience)


def at_once_map(spark: SparkSession, f: Callable, items: Sequence, at_once: int = 4) -> list:
    """`f` of each item, as concurrent Spark jobs; tags and local properties follow into the threads."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(spark)(f), items))


def rates(prior: float = 10.0, sample: float = 0.8) -> FitPredict:
    """The smoothed positive rate of the train rows with the same values; a seed draws its share of them by hash."""

    def fit_predict(train: DataFrame, val: DataFrame, test: DataFrame, columns: list[str], seed: int) -> DataFrame:
        return checks.rate_scorer(columns, prior=prior)(train.filter(checks.hash_unit(seed=seed) < sample), test)

    return fit_predict


def run(
    data: DataFrame, available: Sequence[str], arms: Sequence[Arm] = ARMS, seeds: Sequence[int] = SEEDS, fit_predict: FitPredict | None = None,
    budget: float = 0.01, at_once: int = 4, label: str = "is_laundering",
) -> DataFrame:
    """(arm, description, n_features, seed, average_precision, recall): one row a fit, recall within the budget.

    `data` has `row_pos`, the label and the split columns. Rows of equal score are taken by position. A part without
    positives gives null. `at_once` bounds the jobs in flight. A `fit_predict` with a method `prepare` (rows, columns) is
    given its parts from what that returns, which all seeds of an arm share.
    """
    fit_predict = fit_predict or trees()
    chosen = {a.name: a.columns(available) for a in arms}
    if empty := [name for name, cols in chosen.items() if not cols]:
        raise ValueError(f"arms without columns: {', '.join(empty)}")

    def prepared(arm: Arm) -> DataFrame:
        cols = chosen[arm.name]
        return fit_predict.prepare(data.select("row_pos", label, arm.split, *cols), cols) if hasattr(fit_predict, "prepare") else data

    def one(task: tuple[Arm, int]) -> DataFrame:
        arm, seed = task
        part = lambda s: ready[arm.name].filter(F.col(arm.split) == s)
        scored = fit_predict(part("train"), part("val"), part("test"), chosen[arm.name], seed)
        return scored.select(F.lit(arm.name).alias("arm"), F.lit(seed).cast("long").alias("seed"), "row_pos", F.col(label).cast("long").alias(label), "score")

    spark = data.sparkSession
    ready = dict(zip(chosen, at_once_map(spark, prepared, arms, at_once), strict=True))
    scored = at_once_map(spark, one, [(a, s) for a in arms for s in seeds], at_once)
    all_scored = cut(reduce(DataFrame.unionByName, scored), "ablation-scores")
    keys = ["arm", "seed"]
    measured = metrics.evaluate(all_scored, label, by=keys).select(*keys, "n", "positives", "average_precision")
    k = F.greatest(F.lit(1), F.bround(F.col("n") * budget)).cast("long")
    ordered = global_running(all_scored.withColumn("one", F.lit(1)), [("score", False), ("row_pos", True)], {"place": "one", "hits": label}, keys)
    recall = ordered.join(F.broadcast(measured.select(*keys, k.alias("k"), "positives")), keys).filter("place = k")  # a row a fit
    recall = recall.select(*keys, (F.col("hits") / F.nullif("positives", F.lit(0))).alias("recall"))
    facts = spark.createDataFrame([(a.name, a.description, len(chosen[a.name])) for a in arms], "arm string, description string, n_features int")
    out = measured.join(recall, keys, "left").join(F.broadcast(facts), "arm")
    return out.select("arm", "description", "n_features", "seed", "average_precision", "recall")


def by_arm(runs: DataFrame) -> DataFrame:
    """(arm, description, n_features, seeds, mean, sd, mean_recall); a single seed deviates by 0."""
    g = runs.groupBy("arm", "description", "n_features")
    return g.agg(F.count("average_precision").alias("seeds"), F.avg("average_precision").alias("mean"),
                 F.coalesce(F.stddev_samp("average_precision"), F.lit(0.0)).alias("sd"), F.avg("recall").alias("mean_recall"))


def compare(arms: DataFrame, pairs: Sequence[tuple[str, str, str]] = COMPARISONS) -> DataFrame:
    """(better, worse, label, delta, two_sigma, verdict) of the named pairs whose arms are both there.

    The bar is twice the mean of the arms' deviations above 0, one for all pairs; a difference beyond it in either
    direction is real. Null where an arm has no average precision; without any deviation the bar is 0.
    """
    asked = arms.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "place int, better string, worse string, label string")
    bar = arms.filter("sd > 0").agg(F.coalesce(2 * F.avg("sd"), F.lit(0.0)).alias("two_sigma"))  # arms are a handful of rows
    a = arms.select(F.col("arm").alias("better"), F.col("mean").alias("m1"))
    b = arms.select(F.col("arm").alias("worse"), F.col("mean").alias("m2"))
    j = asked.join(a, "better").join(b, "worse").crossJoin(F.broadcast(bar)).withColumn("delta", F.col("m1") - F.col("m2"))
    verdict = F.when(F.col("delta").isNotNull(), F.when(F.abs("delta") > F.col("two_sigma"), "real").otherwise("within noise"))
    return j.select("better", "worse", "label", "delta", "two_sigma", verdict.alias("verdict"))


def stability(ranked: DataFrame, run: str = "run", feature: str = "feature", place: str = "place", top: int = 10) -> DataFrame:
    """(run, overlap, kept_in_all): the share of each run's first `top` features that the first run has too, and how many every run has.

    `place` counts from 1 inside a run; the first run is the one that sorts first. A run with fewer features is still
    measured against `top`.
    """
    best = ranked.filter(F.col(place) <= top).select(F.col(run).alias("run"), F.col(feature).alias("feature")).distinct()
    runs = best.agg(F.count_distinct("run").alias("runs"), F.min("run").alias("first"))
    every = best.groupBy("feature").agg(F.count("*").alias("times"), F.min("run").alias("seen_first"))
    j = best.join(every, "feature").crossJoin(F.broadcast(runs))
    return j.groupBy("run").agg(
        (F.count_if(F.col("seen_first") == F.col("first")) / top).alias("overlap"), F.count_if(F.col("times") == F.col("runs")).alias("kept_in_all"),
    )


def appearances(ranked: DataFrame, run: str = "run", feature: str = "feature", place: str = "place", top: int = 10) -> DataFrame:
    """(feature, times, best_place): in how many runs a feature is among the first `top`."""
    best = ranked.filter(F.col(place) <= top)
    return best.groupBy(F.col(feature).alias("feature")).agg(F.count_distinct(run).alias("times"), F.min(place).alias("best_place"))
