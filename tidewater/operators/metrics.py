"""Exact ranking metrics, thresholds, drift and slices, grouped so that many sets are scored in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.quantiles import finite, quantiles
from tidewater.session import global_running


def score_table(df: DataFrame, label: str = "is_laundering", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by..., score, n, tp): one row a distinct score, which is what every curve needs."""
    return df.groupBy(*(by or []), F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("tp"))


def curve(df: DataFrame, label: str = "is_laundering", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Running counts over falling scores: adds `rows` and `hits` up to and with each distinct score.

    Runs over ranges of (group, score), so a group with as many scores as the table is spread too.
    """
    return global_running(score_table(df, label, score, by), [("score", False)], {"rows": "n", "hits": "tp"}, by)


def evaluate(df: DataFrame, label: str = "is_laundering", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by..., n, positives, base_rate, average_precision, roc_auc, best_f1, best_threshold, lift).

    Average precision sums precision over recall steps at distinct scores; ROC-AUC counts ties half. Groups of
    one class have null metrics.
    """
    c = curve(df, label, score, by)
    keys = by or []
    totals = c.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.sum("tp").alias("p_all"))
    j = c.join(totals, keys) if keys else c.crossJoin(F.broadcast(totals))
    pos, neg = F.col("p_all"), F.col("n_all") - F.col("p_all")
    f1 = 2 * F.col("hits") / (F.col("rows") + pos)
    j = j.withColumns(
        {
            "ap": F.col("tp") / F.nullif(pos, F.lit(0)) * F.col("hits") / F.col("rows"),
            # negatives strictly below, and half of those at, each positive's score
            "auc": F.col("tp") * ((neg - (F.col("rows") - F.col("hits"))) + 0.5 * (F.col("n") - F.col("tp"))),
            "f1": f1,
        }
    )
    both = (F.col("p_all") > 0) & (F.col("p_all") < F.col("n_all"))
    out = j.groupBy(*keys).agg(
        F.first("n_all").alias("n"), F.first("p_all").alias("positives"), F.sum("ap").alias("ap"), F.sum("auc").alias("auc"),
        F.max(F.struct("f1", "score")).alias("best"),
    )
    p, n = F.col("positives"), F.col("n")
    both = (p > 0) & (p < n)
    return out.select(
        *keys, "n", "positives", (p / n).alias("base_rate"), F.when(both, F.col("ap")).alias("average_precision"),
        F.when(both, F.col("auc") / (p * (n - p))).alias("roc_auc"), F.when(both, F.col("best.f1")).alias("best_f1"),
        F.when(both, F.col("best.score")).alias("best_threshold"), F.when(both, F.col("ap") / (p / n)).alias("lift"),
    )


def budget_size(n: int, budget: float) -> int:
    """Rows within a review budget: half-even rounding, at least one."""
    return max(1, round(n * budget))


def budget_points(df: DataFrame, budgets: tuple[float, ...], label: str = "is_laundering", score: str = "score") -> DataFrame:
    """(budget, k, threshold, hits, precision, recall): the top k rows by score, ties by row position."""
    n, positives = df.agg(F.count("*"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "budget double, k long, threshold double, hits long, precision double, recall double")
    sizes = {b: budget_size(n, b) for b in budgets}
    top = df.select("row_pos", F.col(score).alias("score"), F.col(label).cast("long").alias("y")).orderBy(F.desc("score"), "row_pos").limit(max(sizes.values()))
    # the kept rows are a budget's worth; their numbering follows ranges of the score
    ranked = global_running(top.withColumn("one", F.lit(1)), [("score", False), ("row_pos", True)], {"place": "one", "hit": "y"})
    at = ranked.filter(F.col("place").isin(sorted(set(sizes.values()))))
    b = df.sparkSession.createDataFrame([(b, k) for b, k in sizes.items()], "budget double, k long")
    j = b.join(at, F.col("k") == F.col("place"))
    return j.select("budget", "k", F.col("score").alias("threshold"), F.col("hit").alias("hits"), (F.col("hit") / F.col("k")).alias("precision"),
                    (F.col("hit") / F.nullif(F.lit(positives), F.lit(0))).alias("recall"))


def select_thresholds(df: DataFrame, budgets: tuple[float, ...], partition: str = "val") -> DataFrame:
    """Budget thresholds with where they came from; a threshold is never chosen on the test partition."""
    if partition == "test":
        raise ValueError("thresholds are not chosen on the test partition")
    return budget_points(df, budgets).withColumn("chosen_on", F.lit(partition))


def flag_top(df: DataFrame, budget: float, score: str = "score") -> DataFrame:
    """Adds `flagged`: within the budget by score, ties by row position."""
    k = budget_size(df.count(), budget)
    edge = df.select(score, "row_pos").orderBy(F.desc(score), "row_pos").limit(k).agg(F.min(F.struct(F.col(score).alias("s"), (-F.col("row_pos")).alias("p"))).alias("e")).first()["e"]
    if edge is None:
        return df.withColumn("flagged", F.lit(False))
    return df.withColumn("flagged", (F.col(score) > edge["s"]) | ((F.col(score) == edge["s"]) & (-F.col("row_pos") >= edge["p"])))


def recall_by(df: DataFrame, group: Column, name: str, label: str = "is_laundering") -> DataFrame:
    """(slice, value, positives, caught, recall) of flagged rows; null groups are skipped."""
    pos = df.filter(F.col(label) == 1).withColumn("__g", group).filter("__g IS NOT NULL")
    return pos.groupBy(F.col("__g").cast("string").alias("value")).agg(
        F.count("*").alias("positives"), F.count_if("flagged").alias("caught")
    ).select(F.lit(name).alias("slice"), "value", "positives", "caught", (F.col("caught") / F.col("positives")).alias("recall"))


def recall_slices(df: DataFrame, groups: dict[str, Column], label: str = "is_laundering") -> DataFrame:
    """All slices from one pass: each row once a slice column, then one aggregate."""
    named = df.filter(F.col(label) == 1).select("flagged", *[g.cast("string").alias(f"g_{n}") for n, g in groups.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), F.col(f"g_{n}").alias("value")) for n in groups]))
    tall = named.select("flagged", pairs.alias("p")).select("flagged", "p.*").filter("value IS NOT NULL")
    return tall.groupBy("slice", "value").agg(F.count("*").alias("positives"), F.count_if("flagged").alias("caught")).withColumn(
        "recall", F.col("caught") / F.col("positives")
    )


def confusion(df: DataFrame, label: str = "is_laundering") -> DataFrame:
    y = F.col(label) == 1
    return df.agg(F.count_if(y & F.col("flagged")).alias("tp"), F.count_if(~y & F.col("flagged")).alias("fp"),
                  F.count_if(y & ~F.col("flagged")).alias("fn"), F.count_if(~y & ~F.col("flagged")).alias("tn"))


def error_profiles(df: DataFrame, label: str = "is_laundering") -> DataFrame:
    """(outcome, n, median_amount, self_share, top_rails): the kinds of outcome, and their three commonest payment types."""
    y = F.col(label) == 1
    kind = F.when(y & F.col("flagged"), "tp").when(F.col("flagged"), "fp").when(y, "fn").otherwise("tn")
    t = df.withColumn("outcome", kind)
    main = t.groupBy("outcome").agg(F.count("*").alias("n"), F.median("amount").alias("median_amount"), F.avg("is_self_transfer").alias("self_share"))
    w = Window.partitionBy("outcome").orderBy(F.desc("c"), "payment_type")
    rails = t.groupBy("outcome", "payment_type").agg(F.count("*").alias("c")).withColumn("r", F.row_number().over(w)).filter("r <= 3")
    listed = rails.groupBy("outcome").agg(F.array_sort(F.collect_list(F.struct("r", "payment_type", "c"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["payment_type"], x["c"])), ",")
    return main.join(listed.select("outcome", text.alias("top_rails")), "outcome")


def account_scores(df: DataFrame, score: str = "score", k: int = 3) -> DataFrame:
    """(account, max_score, mean_score, topk_mean, n) over both ends; a self-transfer counts twice."""
    ends = df.select(F.explode(F.array("source_account", "destination_account")).alias("account"), F.col(score).alias("s"), "row_pos")
    counts = ends.groupBy("account", "s").agg(F.count("*").alias("c"))  # equal scores combine before the window
    w = Window.partitionBy("account").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    taken = counts.withColumn("upto", F.sum("c").over(w)).withColumn("use", F.greatest(F.least("c", F.lit(k) - (F.col("upto") - F.col("c"))), F.lit(0)))
    return taken.groupBy("account").agg(
        F.max("s").alias("max_score"), (F.sum(F.col("s") * F.col("c")) / F.sum("c")).alias("mean_score"),
        (F.sum(F.col("s") * F.col("use")) / F.sum("use")).alias("topk_mean"), F.sum("c").cast("long").alias("n"),
    )


def evaluate_accounts(df: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """(aggregation, metrics...) of account scores against account labels; unlabelled accounts are left out."""
    scored = account_scores(df, k=k).join(labels.dropDuplicates(["account"]), "account")
    tall = scored.select(
        F.col("is_illicit").alias("is_laundering"),
        F.explode(F.array(*[F.struct(F.lit(a).alias("aggregation"), F.col(c).alias("score")) for a, c in (("max", "max_score"), ("mean", "mean_score"), ("topk", "topk_mean"))])).alias("x"),
    ).select("is_laundering", "x.*")
    return evaluate(tall, by=["aggregation"])


def _tall(reference: DataFrame, current: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """(feature, v, r): a cell a column of both sides' rows, nulls left out; r is 1 for the reference."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), v.alias("v")) for c, v in cells.items()]))
    side = lambda df, r: df.select(each.alias("x")).select("x.*", F.lit(r).cast("long").alias("r"))
    return side(reference, 1).unionByName(side(current, 0)).filter("v IS NOT NULL")


def _features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")


def psi_table(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(feature, psi): the population stability index by the reference's quantile bins, over finite values.

    Constant columns have 0; NaN where a side has no finite value. All columns are counted in one pass.
    """
    cuts = quantiles(reference, {c: [i / bins for i in range(bins + 1)] for c in columns})
    cells, shape = {}, []
    for c in columns:
        inner = sorted(set(cuts[c] or []))[1:-1]
        bucket = F.lit(0)
        for e in inner:
            bucket = bucket + F.when(F.col(f"`{c}`") >= e, 1).otherwise(0)
        cells[c] = F.when(finite(c).isNotNull(), bucket)
        shape.append((c, len(inner)))
    counts = _tall(reference, current, cells).groupBy("feature", F.col("v").alias("b")).agg(F.sum("r").alias("r"), F.sum(1 - F.col("r")).alias("c"))
    spark = reference.sparkSession
    every = spark.createDataFrame(shape, "feature string, edges int").select("feature", "edges", F.explode(F.sequence(F.lit(0), "edges")).alias("b"))
    full = every.join(counts, ["feature", "b"], "left").na.fill(0, ["r", "c"])
    totals = full.groupBy("feature").agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"))
    p = lambda x, t: F.greatest(F.try_divide(F.col(x), F.col(t)), F.lit(1e-6))
    term = (p("c", "ct") - p("r", "rt")) * F.log(p("c", "ct") / p("r", "rt"))
    some = (F.col("rt") > 0) & (F.col("ct") > 0)
    value = F.when(~some, F.lit(float("nan"))).when(F.col("edges") == 0, 0.0).otherwise(term)
    return full.join(totals, "feature").groupBy("feature").agg(F.sum(value).alias("psi"))


def ks_table(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, ks): the largest distance of the two empirical distributions, over distinct finite values of all columns at once."""
    counts = _tall(reference, current, {c: finite(c) for c in columns}).groupBy("feature", "v").agg(F.sum("r").alias("r"), F.sum(1 - F.col("r")).alias("c"))
    run = global_running(counts, [("v", True)], {"rr": "r", "cc": "c"}, ["feature"])
    totals = run.groupBy("feature").agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"))
    apart = F.abs(F.try_divide("rr", "rt") - F.try_divide("cc", "ct"))
    found = run.join(totals, "feature").groupBy("feature").agg(F.max(apart).alias("ks"))
    return _features(reference, columns).join(found, "feature", "left").select("feature", F.coalesce("ks", F.lit(float("nan"))).alias("ks"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """`psi_table` of one column."""
    return psi_table(reference, current, [column], bins)


def ks(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """`ks_table` of one column."""
    return ks_table(reference, current, [column])


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over equal bins (lo, hi]."""
    b = df.select(F.ceil(F.col(confidence) * bins).alias("b"), F.col(confidence).alias("p"), F.col(correct).cast("double").alias("y")).filter("b > 0")
    g = b.groupBy("b").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def percentile_rank(df: DataFrame, score: str = "score") -> DataFrame:
    """(transaction_id, pct): average-rank percentile, from one running count over distinct scores."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"))
    run = global_running(counts, [("s", True)], {"upto": "c"})
    n = run.agg(F.sum("c")).first()[0]
    pct = run.select("s", ((F.col("upto") - (F.col("c") - 1) / 2) / F.lit(n)).alias("pct"))
    return df.join(pct, df[score] == F.col("s")).select("transaction_id", "pct")


def single_feature(df: DataFrame, columns: list[str], label: str = "is_laundering", top: int = 5) -> DataFrame:
    """(feature, average_precision): each column alone as a score, constant ones skipped, the best few."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("score")) for c in columns]))
    tall = df.select(F.col(label), pairs.alias("x")).select(label, "x.*")
    varying = tall.groupBy("feature").agg((F.max("score") > F.min("score")).alias("v")).filter("v").select("feature")
    scored = evaluate(tall.join(F.broadcast(varying), "feature"), label, by=["feature"])
    return scored.orderBy(F.desc("average_precision"), "feature").limit(top).select("feature", "average_precision")


def score_histogram(df: DataFrame, bins: int = 60, label: str = "is_laundering", score: str = "score") -> DataFrame:
    return df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long").alias("bin"), F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n"))


def seed_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(gate, kind, status, measured, threshold); `limits` has gate, kind, metric, relation, threshold."""
    j = limits.join(metrics, "metric", "left")
    ok = F.when(F.col("relation") == ">=", F.col("measured") >= F.col("threshold")).otherwise(F.col("measured") <= F.col("threshold"))
    return j.select("gate", "kind", F.when(F.col("measured").isNull(), "not_run").when(ok, "pass").otherwise("fail").alias("status"), "measured", "threshold")
