"""Gates measured on a split: what passes, what fails, and what was not run."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import ablation, gates, model, splits
from tidewater.plans import catalog
from tidewater.plans.models import features
from tidewater.session import cut
from tidewater.sources import views


def test_two_sigma_verdicts():
    status = lambda *a, **k: gates.two_sigma("P1", *a, **k).row()[3]
    assert status([0.5, 0.52], [0.1, 0.12]) == "pass" and status([0.1, 0.12], [0.5, 0.52]) == "fail"
    assert status([0.5, 0.52], [0.5, 0.51], may_be_equal=True) == "inconclusive" and status([0.5, 0.52], [0.5, 0.51]) == "fail"
    assert status([0.5], [0.1]) == status(None, [0.1]) == status([0.5, 0.6], []) == "not_run"


@pytest.fixture(scope="module")
def prepared(spark):
    labelled = F.expr("if(row_pos % 25 < 2, 1, 0)")  # so many that every part has some
    tx = cut(views.tx_events(spark, "/root/testdata/sf0.001").withColumn("is_laundering", labelled), "tx")
    f, columns = features(tx)
    return tx, cut(splits.chronological_split(f), "split"), columns[:6]


def test_every_gate_has_a_verdict(prepared):
    tx, split, columns = prepared
    fit = lambda train, val, seed: model.fit(train, val, columns, threshold=0.05, iterations=2, depth=2, seed=seed)
    report = gates.evaluate_gates(tx, split, columns, fit, (7, 8), {"E1": [0.0, 0.001], "E0": [0.0, 0.002]}, rows_per_second=5000.0, peak_gb=11.0, headline=0.5)
    got = {r.gate: r for r in report.collect()}
    assert list(sorted(got)) == sorted([*gates.CORRECTNESS, *gates.PERFORMANCE])
    assert all(got[g].status == "pass" for g in ("C1", "C4", "C5", "C7", "P8")), {g: (r.status, r.detail) for g, r in got.items()}
    assert got["C6"].status == "fail" and got["P9"].status == "fail" and got["P3"].status == "not_run"
    assert got["C1"].measured == 0 and 0 < got["C8"].measured <= 1 and got["C2"].threshold == pytest.approx(got["C3"].threshold)
    assert all(r.voided for r in got.values())  # the headline is not reproduced
    text = gates.markdown(report)
    assert text.startswith("Result VOIDED") and text.count("\n| C") == 8 and text.count("\n| P") == 9


def test_a_history_that_sees_the_future_is_found(prepared, monkeypatch):
    tx, _, _ = prepared
    middle = tx.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY t_us)")).first()[0]
    assert gates.leakage(tx, middle) == 0
    own = gates.history.behaviour
    peeking = lambda df: own(df).drop("bh_pair_n_prior").crossJoin(df.agg(F.count("*").alias("bh_pair_n_prior")))
    monkeypatch.setattr(gates.history, "behaviour", peeking)
    assert gates.leakage(tx, middle) == tx.filter(F.col("t_us") <= middle).count()


def test_gates_judge_whole_fits(spark, monkeypatch):
    """Five seeds, the first once more, and one of permuted labels, each of up to 300 rounds."""
    asked, own = [], model.fit

    def quick(train, val, columns, threshold=0.5, **settings):
        asked.append(settings)
        return own(train, val, columns, threshold, **settings | {"iterations": 1, "depth": 1})

    monkeypatch.setattr(model, "fit", quick)
    assert catalog.QUERIES["k15_model_gates"](spark, "/root/testdata/sf0.001").count() == 17
    assert sorted(s["seed"] for s in asked) == sorted([*ablation.SEEDS, *[ablation.SEEDS[0]] * 2])
    assert all([s.get(k) for k in ("iterations", "depth", "subsample", "patience")] == [300, 6, 0.8, 100] for s in asked)
