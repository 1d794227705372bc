"""Queries over the model layer, case documents and stream-shaped windows."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import columns as C
from tidewater.operators import ablation, cases, contract, gates, history, model, ranking, splits, typology
from tidewater.operators.trace import TraceLimits, trace
from tidewater.plans.data import SCORED, query, with_score
from tidewater.session import cut
from tidewater.sources.views import EVENTS_CTE as EV
from tidewater.streaming import history as stream


def features(tx: DataFrame) -> tuple[DataFrame, list[str]]:
    """Row and history features with labels and times, and the feature columns in contract order; `split` too, where `tx` has it."""
    blind = contract.feature_view(tx)
    rows = C.row_features(blind, payment_type=False)
    facts = tx.select("row_pos", "t_us", "transaction_id", "is_laundering", *[c for c in ("split", "pattern_type") if c in tx.columns])
    joined = facts.join(rows, "transaction_id").join(history.behaviour(blind), "row_pos")
    return joined, [c for c in joined.columns if c.startswith(("tx_", "bh_"))]


def _split_features(tx: DataFrame) -> tuple[DataFrame, list[str]]:
    """The features with their parts, written once; the parts come from the transfers, so that the features are not made to find them."""
    f, columns = features(splits.chronological_split(tx.drop("pattern_type")))
    return cut(f, "features"), columns


def _fitted(tx: DataFrame) -> tuple[model.Package, DataFrame]:
    """A package fitted on the train and validation parts, and the test part."""
    split, columns = _split_features(tx)
    part = lambda s: split.filter(F.col("split") == s)
    return model.fit(part("train"), part("val"), columns, threshold=0.05, iterations=5, depth=3), part("test")


@query("j13_score_table")
def _(tx):
    package, test = _fitted(tx)
    return model.score_table(test, package).select("transaction_id", "raw_score", "score", "rank", "alert", "top_features")


@query("k15_model_gates")
def _(tx):
    split, columns = _split_features(tx)
    fit = lambda train, val, seed: model.fit(train, val, columns, threshold=0.05, iterations=300, depth=6, seed=seed, subsample=0.8, patience=100)
    report = gates.evaluate_gates(tx, split, columns, fit, seeds=ablation.SEEDS)
    return report.select("gate", "kind", "description", "status", "voided")


@query("j7_contributions")
def _(tx):
    package, test = _fitted(tx)
    return model.contributions(test, package)


@query("e18_mean_absolute")
def _(tx):
    package, test = _fitted(tx)
    return model.mean_absolute(model.contributions(test, package), package.columns)


# the isotonic fit at s is the greatest, over starts up to s, of the least mean of any run from there to s or beyond
@query("j4_isotonic", f"""WITH {SCORED}, g AS (SELECT score AS s, count(*) AS n, sum(is_laundering) AS y FROM scored GROUP BY 1),
runs AS (SELECT a.s AS a, b.s AS b, sum(g.y) * 1.0::DOUBLE / sum(g.n) AS m FROM g a JOIN g b ON a.s <= b.s JOIN g ON g.s BETWEEN a.s AND b.s GROUP BY 1, 2),
least_of AS (SELECT g.s, runs.a, min(runs.m) AS m FROM g JOIN runs ON runs.a <= g.s AND runs.b >= g.s GROUP BY 1, 2)
SELECT round(s, 9) AS s, round(max(m), 9) AS calibrated FROM least_of GROUP BY least_of.s""")
def _(tx):
    data = with_score(tx).select(F.col("score").cast("double").alias("s"), F.col("is_laundering").cast("double").alias("y"))
    iso = IsotonicRegression(featuresCol="s", labelCol="y").fit(data)
    xs, ys = [float(x) for x in iso.boundaries], [float(v) for v in iso.predictions]
    return data.select("s").distinct().select(F.round("s", 9).alias("s"), F.round(model.piecewise(F.col("s"), xs, ys), 9).alias("calibrated"))


def documents(tx: DataFrame) -> DataFrame:
    scored = with_score(tx)
    alert = F.struct("score", -F.col("row_pos"))  # an account's case starts at its best transfer, the first of equals
    best = scored.groupBy("source_account").agg(F.max("score").alias("score"), F.max_by("t_us", alert).alias("at_us")).orderBy(F.desc("score"), "source_account").limit(10)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source_account")).cast("long"))  # the ten kept rows
    seeds = best.select(F.col("source_account").alias("seed"), "at_us")
    t = trace(tx, seeds, "forward", 3, TraceLimits(16, 200))
    return cases.build(t, tx.select("row_pos", "transaction_id", "payment_type"), best.select(F.col("source_account").alias("seed"), "score", "rank"))


@query("j15_bundle")
def _(tx):
    d = documents(tx)
    return d.select("case_id", "seed", F.size("transaction_ids").alias("n"), F.to_json(F.struct(*sorted(d.columns))).alias("document"))


@query("j9_typology_hint")
def _(tx):
    f, columns = features(splits.chronological_split(tx))
    positives = cut(f.filter("is_laundering = 1"), "positives")  # each pass of the forest would make every history again
    hinter = typology.fit(positives.filter("split = 'train'"), columns, trees=20, depth=4)
    return hinter.hint(positives.filter("split = 'test'")).select("transaction_id", "hint", "confidence")


@query("j14_export")
def _(tx):
    ranked = ranking.rank(with_score(tx)).withColumn("alert", F.col("rank") <= 100)
    d = cases.export(tx, ranked)
    return d.select("case_id", "seed", "risk.rank", F.size("transaction_ids").alias("n"), F.size("accounts").alias("n_accounts"))


@query("e16_rail_coverage")
def _(tx):
    return cases.rail_coverage(documents(tx))


def _tampered() -> dict[str, dict]:
    """What is changed in every document of a copy, by the fault it must be found by."""
    return {
        "transaction_ids": {"transaction_ids": F.concat("transaction_ids", F.array(F.lit("TX-none")))},
        "accounts": {"accounts": F.array().cast("array<string>")},
        "rails": {"coverage": F.struct(F.create_map(F.lit("unknown"), F.lit(999_999).cast("long")).alias("rails"))},
        "case_id": {"case_id": F.lit("CASE-00000000")},
    }


@query("j15_bundle_consistency", f"""WITH {SCORED}, best AS (SELECT source_account FROM scored GROUP BY 1 ORDER BY max(score) DESC, source_account LIMIT 10),
copies(copy, fault) AS (VALUES ('whole', NULL), ('transaction_ids', 'case_id'), ('transaction_ids', 'transaction_ids'), ('accounts', 'accounts'), ('rails', 'rails'), ('case_id', 'case_id'))
SELECT copy, fault, count(*) AS documents FROM copies, best WHERE fault IS NOT NULL GROUP BY copy, fault""")
def _(tx):
    whole = cut(documents(tx), "case-documents")
    out = cases.inconsistencies(whole).withColumn("copy", F.lit("whole"))
    for name, change in _tampered().items():
        out = out.unionByName(cases.inconsistencies(whole.withColumns(change)).withColumn("copy", F.lit(name)))
    return out.groupBy("copy", "fault").agg(F.count("*").alias("documents"))


@query("l5_tumbling", f"WITH {EV} SELECT t_us - t_us % 3600000000 AS start_us, payment_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM tx GROUP BY ALL")
def _(tx):
    return stream.tumbling(tx)


@query("l5_session", f"""WITH {EV}, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM tx WINDOW w AS (PARTITION BY source_account ORDER BY t_us)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY source_account ORDER BY t_us) AS k FROM g) SELECT min(t_us) AS start_us, source_account, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY source_account, k""")
def _(tx):
    return stream.sessions(tx)


@query("l1_two_hops", f"WITH {EV} SELECT a.row_pos AS in_pos, b.row_pos AS out_pos FROM tx a JOIN tx b ON a.destination_account = b.source_account AND b.t_us > a.t_us AND b.t_us <= a.t_us + 21600000000")
def _(tx):
    t = tx.withColumn("at", F.timestamp_micros("t_us"))
    return stream.two_hops(t, t)
