"""Exact quantiles by refining histograms, running totals of groups that span partitions, and drift of many columns at once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import checks, metrics, quantiles
from tidewater.session import global_position, global_running

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 0.999, 0.9999, 1.0]


def columns(rng, n):
    return {
        "even": [rng.random() for _ in range(n)], "tail": [math.exp(rng.gauss(0, 12)) for _ in range(n)], "few": [float(rng.randint(0, 3)) for _ in range(n)],
        "one": [7.5] * n, "tiny": [rng.choice([5e-324, 1e-323, 0.0, -5e-324]) for _ in range(n)], "huge": [rng.choice([-1.7e308, 1.7e308, 0.0, 3.0]) for _ in range(n)],
    }


@pytest.mark.parametrize("n,few,buckets", [(5000, 2048, 512), (5000, 3, 4), (1, 2048, 512), (2, 1, 2)])
def test_quantiles_are_exact(spark, monkeypatch, n, few, buckets):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    data = columns(random.Random(n + few), n)
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data)).repartition(4)
    got = quantiles.quantiles(df, dict.fromkeys(data, SHARES))
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, SHARES))).alias(c) for c in data]).first()
    for c in data:
        assert got[c] == pytest.approx(want[c], rel=1e-14, abs=0), c


def test_only_finite_values_count(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,), (3.0,)], "v double").withColumn("none", F.lit(None).cast("double"))
    assert quantiles.quantiles(df, {"v": [0.5], "none": [0.5]}) == {"v": [2.0], "none": None}
    assert quantiles.quantiles(df.limit(0), {"v": [0.5]}) == {"v": None} and quantiles.quantiles(df, {}) == {}


def test_running_totals_of_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randint(0, 9), None if rng.random() < 0.1 else 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, x long, y long").repartition(5)
    got = {(r.g, r.k): (r.sx, r.sy) for r in global_running(df, [("k", True)], {"sx": "x", "sy": "y"}, ["g"]).collect()}
    totals: dict = {}
    for g, k, x, y in sorted(rows, key=lambda r: r[1]):
        a, b = totals.get(g, (0, 0))
        totals[g] = (a + x, b + (y or 0))
        assert got[g, k] == totals[g]
    placed = {r.k: r.at for r in global_position(df, [("k", False)], "at", ["k"], dealt_by=1).collect()}
    assert placed == {k: 1999 - k for k in range(2000)}


def test_a_grouped_curve_equals_single_ones(spark):
    rng = random.Random(8)
    rows = [(g, round(rng.random(), 2), int(rng.random() < 0.2)) for g in ("x", "y", "z") for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, score double, is_laundering int")
    for r in metrics.evaluate(df, by=["g"]).collect():
        one = metrics.evaluate(df.filter(F.col("g") == r.g)).first()
        assert [r[c] for c in one.asDict()] == pytest.approx([one[c] for c in one.asDict()])


def test_drift_of_equal_columns_ties_by_name(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=3000)], "b double").withColumns({"a": F.col("b"), "c": F.lit(1.0), "d": F.lit(None).cast("double")})
    later = df.withColumns({"a": F.col("b") + 0.1, "b": F.col("b") + 0.1})
    for parts in (1, 7):
        got = {r.feature: r for r in checks.drift_table(df.repartition(parts), later.repartition(parts), ["d", "c", "b", "a"]).collect()}
        assert [got[c].place for c in "abcd"] == [1, 2, 3, 4] and got["a"].psi == pytest.approx(got["b"].psi) and got["c"].psi == 0
        assert math.isnan(got["d"].psi) and math.isnan(got["d"].ks) and got["a"].ks == pytest.approx(got["b"].ks)
