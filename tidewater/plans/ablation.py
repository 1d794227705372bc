"""Queries over ablation arms and the stability of rankings, each with its SQL; the model is a table of smoothed rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import when_
from tidewater.operators import ablation, model, splits
from tidewater.operators.ablation import Arm
from tidewater.plans.checks import _UNIT
from tidewater.plans.data import query, split_bounds
from tidewater.plans.evaluation import _EVAL
from tidewater.session import cut
from tidewater.sources.views import EVENTS_CTE as EV

_SEEDS = (42, 7, 123)
_ARMS = (
    Arm("R1", "currency and payment type", ("currency", "payment_type")), Arm("R2", "currency", ("currency",)),
    Arm("R3", "currency and hour", ("currency", "hour")), Arm("R_LEAK", "accounts over random parts", ("source_account",), ablation.LEAK),
)
_PAIRS = (("R1", "R2", "payment type"), ("R3", "R2", "hour"), ("R_LEAK", "R2", "leak"), ("R1", "R9", "an arm that was not run"))


def _rate_arms(tx: DataFrame) -> DataFrame:
    rows = ablation.random_parts(splits.chronological_split(tx.withColumn("hour", F.hour(when_()))))
    keep = rows.select("row_pos", "transaction_id", "is_laundering", "source_account", "currency", "payment_type", "hour", "split", ablation.LEAK)
    available = ["source_account", "currency", "payment_type", "hour"]
    return ablation.by_arm(ablation.run(cut(keep, "rate-arms"), available, _ARMS, _SEEDS, ablation.rates(), budget=0.05))


def _sql() -> str:
    """One scored block an arm and seed, then average precision and recall of each, then the arms."""
    u = _UNIT.format(seed=42)
    head = f"""{split_bounds(EV)}, s AS (SELECT tx.*, hour(make_timestamp(t_us)) AS hour, CASE WHEN t_us <= b1 THEN 'train' WHEN t_us <= b2 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.85 THEN 'val' ELSE 'test' END AS leak_split FROM tx, b)"""
    blocks = []
    for arm in _ARMS:
        keys = ", ".join(arm.blocks)
        for seed in _SEEDS:
            rates = f"SELECT {keys}, (sum(is_laundering) + 0.1::DOUBLE) / (count(*) + 10.0::DOUBLE) AS score FROM s WHERE {arm.split} = 'train' AND {_UNIT.format(seed=seed)} < 0.8 GROUP BY ALL"
            blocks.append(f"SELECT '{arm.name}' AS arm, {seed} AS seed, row_pos, is_laundering, coalesce(score, 0.01::DOUBLE) AS score FROM s LEFT JOIN ({rates}) USING ({keys}) WHERE {arm.split} = 'test'")
    counts = ", ".join(f"('{a.name}', '{a.description}', {len(a.blocks)})" for a in _ARMS)
    return f"""{head}, t AS ({' UNION ALL '.join(blocks)}), {_EVAL.format(by='arm, seed', src='t')},
  ranked AS (SELECT *, row_number() OVER w AS k, sum(is_laundering) OVER w AS h, count(*) OVER (PARTITION BY arm, seed) AS c FROM t WINDOW w AS (PARTITION BY arm, seed ORDER BY score DESC, row_pos ROWS UNBOUNDED PRECEDING)),
  rc AS (SELECT arm, seed, h FROM ranked WHERE k = greatest(1, round_even(c * 0.05, 0))), names(arm, description, n_features) AS (VALUES {counts}),
  fits AS (SELECT arm, seed, CASE WHEN positives > 0 AND positives < n THEN ap END AS ap, h / nullif(positives, 0) AS recall FROM m JOIN rc USING (arm, seed)),
  arms AS (SELECT arm, description, n_features, count(ap) AS seeds, avg(ap) AS mean, coalesce(stddev_samp(ap), 0) AS sd, avg(recall) AS mean_recall FROM fits JOIN names USING (arm) GROUP BY ALL)"""


@query("k18_ablation_arms", f"WITH {_sql()} SELECT arm, description, n_features, seeds, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean_recall, 6) AS mean_recall FROM arms")
def _(tx):
    return _rate_arms(tx).withColumns({c: F.round(c, 6) for c in ("mean", "sd", "mean_recall")})


_ASKED = ", ".join(f"('{b}', '{w}', '{label}')" for b, w, label in _PAIRS)


@query("i11_k18_verdicts", f"""WITH {_sql()}, asked(better, worse, label) AS (VALUES {_ASKED}), bar AS (SELECT coalesce(2 * avg(sd), 0) AS two_sigma FROM arms WHERE sd > 0)
SELECT better, worse, label, round(x.mean - y.mean, 6) AS delta, round(two_sigma, 6) AS two_sigma,
  CASE WHEN abs(x.mean - y.mean) > two_sigma THEN 'real' WHEN x.mean - y.mean IS NOT NULL THEN 'within noise' END AS verdict
FROM asked JOIN arms x ON x.arm = better JOIN arms y ON y.arm = worse, bar""")
def _(tx):
    return ablation.compare(cut(_rate_arms(tx), "rate-arm-means"), _PAIRS).withColumns({c: F.round(c, 6) for c in ("delta", "two_sigma")})


@query("k18_ablation_trees")
def _(tx):
    data, available = ablation.table(tx)
    return ablation.by_arm(ablation.run(data, available, at_once=8))


# a run is a fifth of the time, a feature a sending account, its place that of its sum among the slice's accounts
_PLACES = f"""{EV}, lim AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM tx), z AS (SELECT CAST(least(floor((t_us - lo) * 5 / (hi - lo)), 4) AS BIGINT) AS run, source_account AS feature, sum(cents) AS total FROM tx, lim GROUP BY ALL),
best AS (SELECT run, feature, place FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY total DESC, feature) AS place FROM z) WHERE place <= 20)"""


def _places(tx: DataFrame) -> DataFrame:
    totals = splits.time_buckets(tx).groupBy(F.col("bucket").alias("run"), F.col("source_account").alias("feature")).agg(F.sum("cents").alias("total"))
    order = Window.partitionBy("run").orderBy(F.desc("total"), "feature")
    return totals.withColumn("place", F.row_number().over(order)).filter("place <= 20").select("run", "feature", "place")  # pruned to 20 a task before the shuffle


@query("e25_stability", f"""WITH {_PLACES}, every AS (SELECT feature, count(*) AS times, min(run) AS seen_first FROM best GROUP BY 1)
SELECT run, count(*) FILTER (seen_first = (SELECT min(run) FROM best)) / 20.0::DOUBLE AS overlap, count(*) FILTER (times = (SELECT count(DISTINCT run) FROM best)) AS kept_in_all FROM best JOIN every USING (feature) GROUP BY 1""")
def _(tx):
    return ablation.stability(_places(tx), top=20)


@query("e25_appearances", f"WITH {_PLACES} SELECT feature, count(*) AS times, min(place) AS best_place FROM best GROUP BY 1")
def _(tx):
    return ablation.appearances(_places(tx), top=20)


@query("e25_attribution_stability")
def _(tx):
    data, available = ablation.table(tx)
    columns, seeds, trees = next(a for a in ablation.ARMS if a.name == "A4").columns(available), ablation.SEEDS, ablation.trees()
    early = trees.prepare(data.filter("split <> 'test'").select("is_laundering", "split", *columns), columns)
    part = lambda s: early.filter(F.col("split") == s)
    packages = ablation.at_once_map(data.sparkSession, lambda seed: trees.fit(part("train"), part("val"), columns, seed), seeds, len(seeds))
    runs = []
    for seed, package in zip(seeds, packages, strict=True):
        mean = model.mean_absolute(model.contributions(data.filter("split = 'test'"), package), columns)
        place = F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature"))  # a row a feature
        runs.append(mean.select(F.lit(seed).alias("run"), "feature", place.alias("place")))
    return ablation.stability(cut(reduce(DataFrame.unionByName, runs), "attribution-places"), top=10)
