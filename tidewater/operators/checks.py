"""Whether a score may be believed: null baselines, shuffled labels, fixed thresholds, drift, gates, and who is missed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import metrics
from tidewater.operators.quantiles import quantiles
from tidewater.session import global_position

#: A population stability index above this is drift; a null score may reach this multiple of the base rate.
PSI_SIGNIFICANT, NULL_TOLERANCE = 0.25, 2.0


def hash_unit(key: str = "transaction_id", seed: int = 42) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of seed and key; the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def f1_at(df: DataFrame, threshold: float, label: str = "is_laundering", score: str = "score") -> DataFrame:
    """One row (threshold, predicted, positives, tp, f1): F1 of `score >= threshold`; 0 where nothing is predicted or positive."""
    hit = F.col(score) >= threshold
    counts = df.agg(F.count_if(hit).alias("predicted"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(hit & (F.col(label) == 1)).alias("tp"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("positives")), F.lit(0.0))
    return counts.select(F.lit(float(threshold)).alias("threshold"), "*", f1.alias("f1"))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, label: str = "is_laundering", score: str = "score") -> DataFrame:
    """(budget, threshold, alerts, hits): thresholds chosen elsewhere, applied as they are; ties at a threshold are in.

    One pass: a threshold is one column of a single aggregate, as there are as many as review budgets.
    """
    chosen = [(r.budget, r.threshold) for r in thresholds.select("budget", "threshold").orderBy("budget").collect()]
    if not chosen:
        return df.sparkSession.createDataFrame([], "budget double, threshold double, alerts long, hits long")
    per = [
        F.struct(F.lit(b).alias("budget"), F.lit(t).alias("threshold"), F.count_if(F.col(score) >= t).alias("alerts"), F.count_if((F.col(score) >= t) & (F.col(label) == 1)).alias("hits"))
        for b, t in chosen
    ]
    return df.agg(F.array(*per).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def null_baselines(df: DataFrame, label: str = "is_laundering", tolerance: float = NULL_TOLERANCE, seed: int = 42) -> DataFrame:
    """(name, average_precision, ceiling, passed): a random and a constant score must stay near the base rate.

    Labels of one kind have no average precision and pass.
    """
    pairs = F.array(F.struct(F.lit("constant").alias("name"), F.lit(0.5).alias("score")), F.struct(F.lit("random").alias("name"), hash_unit(seed=seed).alias("score")))
    tall = df.select(F.col(label).alias("is_laundering"), F.explode(pairs).alias("x")).select("is_laundering", "x.*")
    return _verdict(metrics.evaluate(tall, by=["name"]), tolerance).select("name", "average_precision", "ceiling", "passed")


def _verdict(evaluated: DataFrame, tolerance: float) -> DataFrame:
    ceiling = F.col("base_rate") * tolerance
    return evaluated.withColumn("ceiling", ceiling).withColumn("passed", F.coalesce(F.col("average_precision") <= ceiling, F.lit(True)))


def shuffled_labels(df: DataFrame, label: str = "is_laundering", seed: int = 42) -> DataFrame:
    """The rows with their labels permuted: the k-th row by position gets the label of the k-th row by hash."""
    order = [("__u", True), ("transaction_id", True)]
    dealt = global_position(df.select("transaction_id", F.col(label).alias("__label"), hash_unit(seed=seed).alias("__u")), order, "__k").select("__k", "__label")
    placed = global_position(df.drop(label), [("row_pos", True)], "__k")
    return placed.join(dealt, "__k").withColumnRenamed("__label", label).drop("__k")


def shuffled_label_test(
    train: DataFrame, test: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], label: str = "is_laundering", tolerance: float = NULL_TOLERANCE, seed: int = 42
) -> DataFrame:
    """One row (average_precision, ceiling, passed): what `fit_predict(train, test)` reaches from permuted labels.

    `fit_predict` returns the test rows with `score`; anything above the ceiling says that labels leak.
    """
    scored = fit_predict(shuffled_labels(train, label, seed), test)
    return _verdict(metrics.evaluate(scored, label), tolerance).select("average_precision", "ceiling", "passed")


def rate_scorer(keys: list[str], label: str = "is_laundering", prior: float = 10.0) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A smallest possible model: the smoothed positive rate of the train rows with the same keys."""

    def fit_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        rates = train.groupBy(*keys).agg(((F.sum(label) + 0.01 * prior) / (F.count("*") + prior)).alias("score"))
        return test.drop("score").join(rates, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.01)))

    return fit_predict


def drift_table(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, psi, ks, significant, place): drift of each column, the largest index first, names breaking ties.

    Indices are compared after rounding to nine places: sums of doubles differ in their last bits from run to run.
    """
    both = metrics.psi_table(reference, current, columns).join(metrics.ks_table(reference, current, columns), "feature")
    finite = F.when(~F.isnan("psi"), F.round("psi", 9))
    # as many rows as columns were asked for
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(finite), "feature"))
    return both.select("feature", "psi", "ks", F.coalesce(finite > PSI_SIGNIFICANT, F.lit(False)).alias("significant"), place.alias("place"))


def monotone_decline(windows: DataFrame) -> DataFrame:
    """One row (windows, passed): fails when average precision never rises over three or more judged windows.

    `windows` has a row a time slice (bucket, average_precision), a handful by construction.
    """
    judged = windows.filter("average_precision IS NOT NULL")
    before = judged.withColumn("last", F.lag("average_precision").over(Window.orderBy("bucket")))
    seen = before.agg(F.count("*").alias("windows"), F.count_if(F.col("average_precision") > F.col("last")).alias("rises"))
    return seen.select("windows", ((F.col("windows") < 3) | (F.col("rises") > 0)).alias("passed"))


def gate_report(gates: DataFrame) -> DataFrame:
    """The gates with `voided`: true on every row when a correctness gate failed, whatever the performance ones say."""
    void = gates.agg(F.coalesce(F.bool_or((F.col("kind") == "correctness") & (F.col("status") == "fail")), F.lit(False)).alias("voided"))
    return gates.crossJoin(F.broadcast(void))


def two_sigma(df: DataFrame, arm: str, run: str, value: str) -> DataFrame:
    """(better, worse, delta, two_sigma, verdict) for every two arms, from one value a run.

    The bar is twice the mean of the arms' sample deviations (those above 0); a larger difference is real. An arm
    is a row by then, so pairs of arms are few.
    """
    runs = df.groupBy(arm, run).agg(F.avg(value).alias("v"))
    arms = runs.groupBy(F.col(arm).alias("arm")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    bar = arms.filter("sd > 0").agg((2 * F.avg("sd")).alias("two_sigma"))
    a, b = arms.select(F.col("arm").alias("better"), F.col("mean").alias("m1")), arms.select(F.col("arm").alias("worse"), F.col("mean").alias("m2"))
    pairs = a.join(b, (F.col("m1") > F.col("m2")) | ((F.col("m1") == F.col("m2")) & (F.col("better") < F.col("worse"))))
    delta = F.col("m1") - F.col("m2")
    return pairs.crossJoin(F.broadcast(bar)).select("better", "worse", delta.alias("delta"), "two_sigma", F.when(delta > F.col("two_sigma"), "real").otherwise("within noise").alias("verdict"))


def cutoff(df: DataFrame, budget: float, score: str = "score") -> float | None:
    """The k-th largest score of a review budget; callers take `>=`, so ties are all in."""
    k = metrics.budget_size(df.count(), budget)
    return df.select(score).filter(F.col(score).isNotNull()).orderBy(F.desc(score)).limit(k).agg(F.min(score)).first()[0]


def false_positive_enrichment(scored: DataFrame, hard: DataFrame, budget: float, label: str = "is_laundering", score: str = "score") -> DataFrame:
    """One row: how much oftener hard negatives (by transaction_id) pass the whole set's cutoff than benign rows do.

    Null rates and enrichment where a side has no row.
    """
    edge = cutoff(scored, budget, score)
    marked = scored.join(hard.select("transaction_id").distinct().withColumn("__hard", F.lit(True)), "transaction_id", "left")
    over, benign = F.col(score) >= F.lit(edge), F.col(label) == 0
    c = marked.agg(
        F.count_if("__hard").alias("n"), F.count_if(F.col("__hard") & over).alias("flagged"), F.count_if(benign).alias("b"), F.count_if(benign & over).alias("bf"),
    )
    rate, base = F.try_divide("flagged", "n"), F.try_divide("bf", "b")
    return c.select("n", F.lit(budget).alias("budget"), "flagged", rate.alias("false_positive_rate"), base.alias("baseline_benign_rate"), F.try_divide(rate, base).alias("enrichment"))


def amount_bands(df: DataFrame, bands: int = 5, column: str = "amount") -> Column:
    """Quantile bands 1..n of a column as a string, right-closed, the first one with the minimum; equal edges merge."""
    q = quantiles(df, {column: [i / bands for i in range(bands + 1)]})[column] or []
    inner = sorted(set(q))[1:-1]
    out = F.lit(1)
    for e in inner:
        out = out + F.when(F.col(column) > e, 1).otherwise(0)
    return F.when(F.col(column).isNotNull(), out.cast("string"))


def missed_typologies(df: DataFrame, label: str = "is_laundering", score: str = "score") -> DataFrame:
    """(pattern_type, positives, median_pct, best_pct, recall_1, recall_5): where each typology's positives rank."""
    pct = metrics.percentile_rank(df, score)
    pos = df.filter((F.col(label) == 1) & F.col("pattern_type").isNotNull()).select("transaction_id", "pattern_type").join(pct, "transaction_id")
    share = lambda top: F.avg((F.col("pct") > 1 - top).cast("int"))
    return pos.groupBy("pattern_type").agg(
        F.count("*").alias("positives"), F.median("pct").alias("median_pct"), F.max("pct").alias("best_pct"), share(0.01).alias("recall_1"), share(0.05).alias("recall_5"),
    )


def transfer_diagnosis(df: DataFrame, label: str = "is_laundering", score: str = "score") -> DataFrame:
    """(structured, payment_type, positives, caught, recall, median_pct) of flagged positives: with a typology or not, by rail."""
    pct = metrics.percentile_rank(df, score)
    pos = df.filter(F.col(label) == 1).select("transaction_id", F.col("pattern_type").isNotNull().alias("structured"), "payment_type", "flagged").join(pct, "transaction_id")
    return pos.groupBy("structured", "payment_type").agg(
        F.count("*").alias("positives"), F.count_if("flagged").alias("caught"), F.avg(F.col("flagged").cast("int")).alias("recall"), F.median("pct").alias("median_pct"),
    )


def blend_sweep(df: DataFrame, a: str, b: str, weights: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), label: str = "is_laundering") -> DataFrame:
    """(weight, average_precision) of weighted ranks of two scores. Only a diagnosis: the weight is chosen on what is measured."""
    ranks = metrics.percentile_rank(df, a).withColumnRenamed("pct", "pa").join(metrics.percentile_rank(df, b).withColumnRenamed("pct", "pb"), "transaction_id")
    mixed = F.array(*[F.struct(F.lit(w).alias("weight"), F.round((1 - w) * F.col("pa") + w * F.col("pb"), 9).alias("score")) for w in weights])
    tall = df.select("transaction_id", F.col(label).alias("is_laundering")).join(ranks, "transaction_id").select("is_laundering", F.explode(mixed).alias("x")).select("is_laundering", "x.*")
    return metrics.evaluate(tall, by=["weight"]).select("weight", "average_precision")


def best_caught(df: DataFrame, edges: tuple[int, int] = (2, 60), top: int = 3) -> DataFrame:
    """(pattern_type, scenario_id, size, caught): each typology's scenario with the most flagged transfers, the best few.

    Scenarios smaller or larger than `edges` are left out; more caught first, then the smaller id.
    """
    s = df.filter("scenario_id IS NOT NULL").groupBy("pattern_type", "scenario_id").agg(F.count("*").alias("size"), F.count_if("flagged").alias("caught"))
    fit = s.filter(F.col("size").between(*edges) & (F.col("caught") > 0))
    best = fit.groupBy("pattern_type").agg(F.min(F.struct((-F.col("caught")).alias("c"), "scenario_id", "size")).alias("s"))
    return best.select("pattern_type", "s.scenario_id", "s.size", (-F.col("s.c")).alias("caught")).orderBy(F.desc("caught"), "scenario_id").limit(top)


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row (classes, macro_f1): the mean F1 of the classes that occur in the truth; a class never hit counts 0."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    tall = cells.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("r"), F.lit(0).cast("long").alias("q"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("h")),
                                          F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("r"), F.col("n").alias("q"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    per = tall.groupBy("k").agg(F.sum("r").alias("r"), F.sum("q").alias("q"), F.sum("h").alias("h")).filter("k IS NOT NULL AND r > 0")
    return per.agg(F.count("*").alias("classes"), F.avg(2 * F.col("h") / (F.col("r") + F.col("q"))).alias("macro_f1"))


def scaling_blocks(progress: DataFrame) -> DataFrame:
    """(rows, block_seconds, ratio) from cumulative (rows, seconds) marks of one run: each block's time, and over the first block's."""
    w = Window.orderBy("rows")
    block = progress.select("rows", (F.col("seconds") - F.coalesce(F.lag("seconds").over(w), F.lit(0.0))).alias("block_seconds"))
    return block.select("rows", "block_seconds", (F.col("block_seconds") / F.first("block_seconds").over(w)).alias("ratio"))


def typologies(df: DataFrame) -> DataFrame:
    """The distinct typologies that occur."""
    return df.filter("pattern_type IS NOT NULL").select("pattern_type").distinct()
