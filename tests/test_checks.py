"""Baselines, thresholds, gates and misses against hand values, and on empty or one-sided tables."""

import math

import pytest
from pyspark.sql import functions as F

from tidewater.operators import checks, metrics

ROWS = "row_pos long, transaction_id string, is_laundering int, score double, pattern_type string, scenario_id string, payment_type string, flagged boolean"


def scored(spark, values):
    """Rows of (label, score[, typology, scenario])."""
    out = [(i, f"T{i:03d}", y, s, *(rest + [None, None])[:2], "ACH", s >= 0.5) for i, (y, s, *rest) in enumerate(values)]
    return spark.createDataFrame(out, ROWS)


def test_fixed_thresholds(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.1)])
    r = checks.f1_at(df, 0.4).first()
    assert (r.predicted, r.positives, r.tp) == (3, 2, 2) and r.f1 == pytest.approx(0.8)
    assert checks.f1_at(df.limit(0), 0.4).first().f1 == 0 and checks.f1_at(df.filter("is_laundering = 0"), 2).first().f1 == 0
    th = spark.createDataFrame([(0.25, 0.8), (0.5, 0.4)], "budget double, threshold double")
    assert [tuple(x) for x in checks.apply_thresholds(df, th).orderBy("budget").collect()] == [(0.25, 0.8, 2, 1), (0.5, 0.4, 3, 2)]
    assert checks.apply_thresholds(df, th.limit(0)).count() == 0
    assert checks.cutoff(scored(spark, [(0, 0.5)] * 3 + [(0, 0.1)]), 0.25) == 0.5 and checks.cutoff(df.limit(0), 0.1) is None


def test_null_and_shuffled_baselines(spark):
    df = scored(spark, [(int(i % 50 == 0), 0.0) for i in range(2000)])
    got = {r.name: r for r in checks.null_baselines(df).collect()}
    assert got["constant"].average_precision == pytest.approx(0.02) and got["constant"].passed and got["random"].passed
    assert all(r.passed and r.average_precision is None for r in checks.null_baselines(df.filter("is_laundering = 0")).collect())
    mixed = checks.shuffled_labels(df.repartition(5))
    assert mixed.agg(F.sum("is_laundering"), F.count("*")).first()[:2] == (40, 2000)
    assert mixed.filter("is_laundering = 1").join(df.filter("is_laundering = 1"), "row_pos").count() < 10
    perfect = lambda train, test: test.withColumn("score", F.col("is_laundering").cast("double"))
    assert not checks.shuffled_label_test(df, df, perfect).first().passed  # a model that knows the test labels
    assert checks.shuffled_label_test(df, df, checks.rate_scorer(["payment_type"])).first().passed


def test_drift_of_odd_sides(spark):
    x = spark.range(200).select(F.col("id").cast("double").alias("v"))
    odd = x.union(spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (None,)], "v double"))
    assert metrics.psi(x, odd, "v").first().psi == pytest.approx(0) and metrics.ks(odd, x, "v").first().ks == 0
    for a, b in ((x.limit(0), x), (x, x.limit(0))):
        assert math.isnan(metrics.psi(a, b, "v").first().psi) and math.isnan(metrics.ks(a, b, "v").first().ks)
    both = x.withColumn("w", F.lit(1.0))
    got = {r.feature: r for r in checks.drift_table(both, both.withColumn("v", F.col("v") + 500), ["w", "v"]).collect()}
    assert (got["v"].place, got["v"].significant, got["w"].significant, got["w"].psi) == (1, True, False, 0.0)


def test_gates_and_declines(spark):
    w = lambda *v: spark.createDataFrame(list(enumerate(v)), "bucket long, average_precision double")
    assert not checks.monotone_decline(w(0.9, 0.5, 0.5, None, 0.1)).first().passed
    assert checks.monotone_decline(w(0.9, 0.5, 0.6)).first().passed and checks.monotone_decline(w(0.9, 0.1)).first().passed
    g = spark.createDataFrame([("C1", "correctness", "fail"), ("P1", "performance", "pass")], "gate string, kind string, status string")
    assert {r.voided for r in checks.gate_report(g).collect()} == {True}
    assert {r.voided for r in checks.gate_report(g.filter("gate = 'P1'")).collect()} == {False}
    runs = spark.createDataFrame([("a", i, 1.0 + 0.01 * i) for i in range(3)] + [("b", i, 0.5 + 0.01 * i) for i in range(3)] + [("c", i, 0.505 + 0.01 * i) for i in range(3)], "arm string, run int, v double")
    got = {(r.better, r.worse): r.verdict for r in checks.two_sigma(runs, "arm", "run", "v").collect()}
    assert got == {("a", "b"): "real", ("a", "c"): "real", ("c", "b"): "within noise"}


def test_misses(spark):
    df = scored(spark, [(1, 0.95, "CYCLE", "S1"), (1, 0.9, "CYCLE", "S1"), (1, 0.2, "STACK", "S2"), (1, 0.3, "STACK", "S2"), (0, 0.6), (0, 0.1)])
    m = {r.pattern_type: r for r in checks.missed_typologies(df).collect()}
    assert (m["CYCLE"].positives, m["CYCLE"].best_pct, m["STACK"].best_pct) == (2, 1.0, pytest.approx(0.5))
    assert [(r.pattern_type, r.scenario_id, r.size, r.caught) for r in checks.best_caught(df).collect()] == [("CYCLE", "S1", 2, 2)]
    e = checks.false_positive_enrichment(df, df.filter("row_pos = 4"), 0.5).first()
    assert (e.n, e.flagged, e.false_positive_rate, e.enrichment) == (1, 1, 1.0, 2.0)  # the third score, 0.6, is the cutoff
    empty = checks.false_positive_enrichment(df, df.limit(0), 0.5).first()
    assert (empty.n, empty.false_positive_rate) == (0, None)
    f = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", None)], "t string, p string")
    assert checks.macro_f1(f, "t", "p").first().macro_f1 == pytest.approx((2 / 3 + 2 / 4) / 2)
    marks = spark.createDataFrame([(100, 2.0), (200, 6.0)], "rows long, seconds double")
    assert [tuple(r) for r in checks.scaling_blocks(marks).orderBy("rows").collect()] == [(100, 2.0, 1.0), (200, 4.0, 2.0)]
    bands = spark.createDataFrame([(float(i),) for i in range(1, 11)], "amount double")
    assert [r.b for r in bands.select(checks.amount_bands(bands).alias("b")).collect()] == list("1122334455")
