"""Ablation arms against a loop in plain Python, verdicts and stability worked out by hand."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewater.operators import ablation, model
from tidewater.operators.ablation import Arm
from tidewater.plans import catalog
from tidewater.session import cut
from tidewater.sources import views


def average_precision(rows):
    """Over distinct scores, from the highest; rows are (score, label)."""
    total, hits, seen, out = sum(y for _, y in rows), 0, 0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        at = [y for x, y in rows if x == s]
        hits, seen = hits + sum(at), seen + len(at)
        out += sum(at) / total * hits / seen
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(i, f"T{i}", rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"]), rng.choice(["train", "train", "val", "test"])) for i in range(600)]
    made = [(*r, int(rng.random() < {"a": 0.4, "b": 0.1}.get(r[2], 0.02))) for r in made]
    df = spark.createDataFrame(made, "row_pos long, transaction_id string, k_one string, k_two string, split string, is_laundering int")
    return made, cut(df, "ablation-rows")


def keyed(train, val, test, columns, seed):
    """A score that plain Python can repeat: the positive count of the keys' train rows, plus the seed's share of the key's length."""
    counts = train.groupBy(*columns).agg((F.sum("is_laundering") + F.lit(seed) % 3).cast("double").alias("score"))
    return test.join(counts, columns, "left").fillna(0.0, ["score"])


def test_runs_equal_a_loop(rows):
    made, df = rows
    arms = (Arm("one", "the first key", ("k_one",)), Arm("both", "all keys", ("k_",)))
    got = {(r.arm, r.seed): r for r in ablation.run(df, ["k_one", "k_two"], arms, (1, 2), keyed, budget=0.1).collect()}
    assert set(got) == {("one", 1), ("one", 2), ("both", 1), ("both", 2)}
    for (arm, seed), r in got.items():
        key = (lambda m: m[2]) if arm == "one" else (lambda m: None if m[2] is None else (m[2], m[3]))
        counts = {}
        for m in made:
            if m[4] == "train" and key(m) is not None:
                counts[key(m)] = counts.get(key(m), 0) + m[5]
        test = [(float(counts[key(m)] + seed % 3) if key(m) in counts else 0.0, m[5], m[0]) for m in made if m[4] == "test"]
        k = max(1, round(len(test) * 0.1))
        top = sorted(test, key=lambda x: (-x[0], x[2]))[:k]
        assert r.average_precision == pytest.approx(average_precision([t[:2] for t in test]))
        assert r.recall == pytest.approx(sum(t[1] for t in top) / sum(t[1] for t in test)) and r.n_features == (1 if arm == "one" else 2)


def test_arms_without_columns_are_refused(rows):
    with pytest.raises(ValueError, match="A3"):
        ablation.run(rows[1], ["other"], [Arm("A3", "", ("tx_",))])


def test_a_part_without_positives_has_no_precision(rows):
    none = rows[1].withColumn("is_laundering", F.when(F.col("split") == "test", 0).otherwise(F.col("is_laundering")))
    r = ablation.run(none, ["k_one"], [Arm("one", "", ("k_one",))], (1,), keyed).first()
    assert r.average_precision is None and r.recall is None
    arms = ablation.by_arm(ablation.run(none, ["k_one"], [Arm("one", "", ("k_one",)), Arm("two", "", ("k_one",))], (1,), keyed))
    assert [(x.delta, x.verdict) for x in ablation.compare(arms, [("one", "two", "")]).collect()] == [(None, None)]


def test_verdicts_by_hand(spark):
    values = {"A1": [0.30, 0.32, 0.34], "A2": [0.20, 0.21, 0.22], "A5": [0.205, 0.215, 0.225], "flat": [0.5]}
    runs = spark.createDataFrame([(a, "", 1, i, v, 0.5) for a, vs in values.items() for i, v in enumerate(vs)],
                                 "arm string, description string, n_features int, seed int, average_precision double, recall double")
    arms = ablation.by_arm(runs)
    assert {r.arm: r.seeds for r in arms.collect()} == {"A1": 3, "A2": 3, "A5": 3, "flat": 1}
    got = {(r.better, r.worse): r for r in ablation.compare(arms, [("A1", "A2", "l"), ("A5", "A2", "l"), ("A2", "A1", "l"), ("A1", "missing", "l")]).collect()}
    bar = 2 * statistics.mean([statistics.stdev(values[a]) for a in ("A1", "A2", "A5")])
    assert set(got) == {("A1", "A2"), ("A5", "A2"), ("A2", "A1")} and got["A1", "A2"].two_sigma == pytest.approx(bar)
    assert [got[k].verdict for k in (("A1", "A2"), ("A5", "A2"), ("A2", "A1"))] == ["real", "within noise", "real"]  # either direction


def test_stability_by_hand(spark):
    order = {1: "abcd", 2: "abxy", 3: "baqc"}
    ranked = spark.createDataFrame([(run, f, i + 1) for run, fs in order.items() for i, f in enumerate(fs)], "run int, feature string, place int")
    got = {r.run: (r.overlap, r.kept_in_all) for r in ablation.stability(ranked, top=3).collect()}
    assert got == {1: (1.0, 2), 2: (pytest.approx(2 / 3), 2), 3: (pytest.approx(2 / 3), 2)}
    times = {r.feature: (r.times, r.best_place) for r in ablation.appearances(ranked, top=3).collect()}
    assert times == {"a": (3, 1), "b": (3, 1), "c": (1, 3), "x": (1, 3), "q": (1, 3)}


def test_the_table_fits_encodings_on_train_alone(spark):
    tx = views.tx_events(spark, "/root/testdata/sf0.001")
    data, available = ablation.table(tx)
    assert data.count() == tx.count() and not {"is_laundering", "payment_type"} & set(available)
    assert {a.name for a in ablation.ARMS if not a.columns(available)} == set()
    late = tx.withColumn("amount", F.when(F.col("row_pos") > 0.9 * tx.count(), F.col("amount") * 50).otherwise(F.col("amount")))
    again, _ = ablation.table(late)  # later transfers change nothing that was fitted before them
    early = lambda df, prefix: df.filter("split = 'train'").select("row_pos", *[c for c in available if c.startswith(prefix)])
    assert early(data, "adp_").exceptAll(early(again, "adp_")).count() == 0
    assert early(data, "all_adp_").exceptAll(early(again, "all_adp_")).count() > 0  # the control arm does leak


def test_commands(spark, tmp_path):
    from tidewater.__main__ import main

    labelled = F.expr("if(row_pos % 25 < 2, 1, 0)")
    views.tx_events(spark, "/root/testdata/sf0.001").withColumn("is_laundering", labelled).write.parquet(f"file://{tmp_path}/tx")
    given = ["--transactions", f"file://{tmp_path}/tx", "--out"]
    quick = ["--iterations", "1", "--depth", "2"]
    got = main(["ablation", *given, f"file://{tmp_path}/ablation", "--seeds", "1", "2", "--arms", "A1", "A2", *quick], spark)
    assert got["verdicts"].keys() == {"A1 - A2"} and spark.read.parquet(f"file://{tmp_path}/ablation/runs").count() == 4

    main(["train", *given, f"file://{tmp_path}/fit", *quick], spark)
    middle = spark.read.parquet(f"file://{tmp_path}/tx").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY t_us)")).first()[0]
    got = main(["transfer", *given, f"file://{tmp_path}/transfer", "--package", f"file://{tmp_path}/fit/package", "--slice-start", str(int(middle)), "--budget", "0.1"], spark)
    scores = spark.read.parquet(f"file://{tmp_path}/transfer/scores")
    assert got["n"] == scores.count() and scores.agg(F.min("t_us")).first()[0] == middle
    assert spark.read.parquet(f"file://{tmp_path}/transfer/diagnosis").agg(F.sum("positives")).first()[0] == got["positives"]


@pytest.fixture
def fits(monkeypatch):
    """The settings of every fit that is asked for; one round of depth 1 is made for each set of columns."""
    asked, made, own = [], {}, model.fit

    def quick(train, val, columns, threshold=0.5, **settings):
        asked.append((tuple(columns), settings))
        if tuple(columns) not in made:
            made[tuple(columns)] = own(train, val, columns, threshold, **settings | {"iterations": 1, "depth": 1})
        return made[tuple(columns)]

    monkeypatch.setattr(model, "fit", quick)
    return asked


def whole(settings):
    return [settings.get(k) for k in ("iterations", "depth", "subsample", "patience")] == [300, 6, 0.8, 100]


def test_a_fit_goes_on_after_a_round_that_gains_little(spark):
    """Labels of no feature: Spark's rule keeps a round or two, patience the rounds up to four after the best one."""
    rng = random.Random(2)
    made = [(i, int(rng.random() < 0.2), rng.random(), rng.random()) for i in range(900)]
    df = cut(spark.createDataFrame(made, "row_pos long, is_laundering int, a double, b double").repartition(3), "patience")
    train, val = df.filter("row_pos < 600"), df.filter("row_pos >= 600")
    settings = {"iterations": 12, "depth": 2, "seed": 3, "subsample": 0.8, "calibrate": False}
    full, some = (model.fit(train, val, ["a", "b"], patience=p, **settings).model for p in (12, 4))
    weighted = val.withColumn("label", F.col("is_laundering").cast("double")).withColumn("weight", F.lit(1.0))
    assert full.getNumTrees == 12 and 5 <= some.getNumTrees <= 12 and some.numFeatures == 2
    assert [t.toDebugString.split("\n")[1:] for t in full.trees][: some.getNumTrees] == [t.toDebugString.split("\n")[1:] for t in some.trees]
    assert model.margin(weighted, model.Package(some, ["a", "b"], [], [], 0.5)).count() == 300
    nobody = val.withColumn("is_laundering", F.lit(0))  # nothing to stop on
    assert model.fit(train, nobody, ["a", "b"], patience=1, **settings).model.getNumTrees == 12


def test_attributions_are_compared_over_every_seed(spark, fits):
    runs = {r.run for r in catalog.QUERIES["e25_attribution_stability"](spark, "/root/testdata/sf0.001").collect()}
    assert runs == set(ablation.SEEDS) == {s["seed"] for _, s in fits} and all(whole(s) for _, s in fits)


def test_every_arm_is_fitted_over_every_seed(spark, fits, monkeypatch):
    runs, own = [], ablation.run
    monkeypatch.setattr(ablation, "run", lambda *a, **k: runs.append(own(*a, **k)) or runs[0])
    arms = {r.arm: r.seeds for r in catalog.QUERIES["k18_ablation_trees"](spark, "/root/testdata/sf0.001").collect()}
    names = {a.name for a in ablation.ARMS}
    assert set(arms) == names and len(names) == 7
    assert {(r.arm, r.seed) for r in runs[0].select("arm", "seed").collect()} == {(a, s) for a in names for s in ablation.SEEDS}
    assert len(fits) == 35 and all(whole(s) for _, s in fits)
