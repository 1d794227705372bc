"""Shapley attributions against brute force over subsets, and the paired bootstrap against a naive loop."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewater.operators import attribution, model, ranking


@pytest.fixture(scope="module")
def package(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        x = [rng.random() for _ in range(4)]
        rows.append((f"T{i}", *x, int(x[0] > 0.6 and x[1] < 0.5 or x[2] > 0.9 or rng.random() < 0.05)))
    df = spark.createDataFrame(rows, "transaction_id string, a double, b double, c double, d double, is_laundering int").withColumn("row_pos", F.monotonically_increasing_id())
    return df, model.fit(df.limit(300), df, ["a", "b", "c", "d"], threshold=0.1, iterations=6, depth=4)


def tree_value(node, x, known):
    """What a tree says when only some features are known: the others' splits by cover."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split, whole = node.split(), node.impurityStats().count()
    left, right = node.leftChild(), node.rightChild()
    if split.featureIndex() in known:
        return tree_value(left if x[split.featureIndex()] <= split.threshold() else right, x, known)
    return sum(c.impurityStats().count() / whole * tree_value(c, x, known) for c in (left, right))


def test_attributions_match_all_subsets(spark, package):
    df, p = package
    rows = df.limit(12).collect()
    got = {r.transaction_id: r for r in model.contributions(df.limit(12), p).collect()}
    trees = [(t._call_java("rootNode"), w) for t, w in zip(p.model.trees, p.model.treeWeights, strict=True)]
    for r in rows:
        x = [r.a, r.b, r.c, r.d]
        value = {s: sum(w * tree_value(t, x, s) for t, w in trees) for n in range(5) for s in map(frozenset, itertools.combinations(range(4), n))}
        for f, name in enumerate("abcd"):
            want = sum(
                math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value[s | {f}] - value[s]) for s in value if f not in s
            )
            assert got[r.transaction_id][name] == pytest.approx(want, abs=1e-9)
        assert got[r.transaction_id].bias == pytest.approx(value[frozenset()])


def test_attributions_add_up_to_the_margin(package):
    df, p = package
    margins = {r.transaction_id: r.m for r in p.model.transform(model.assemble(df, p.columns)).select("transaction_id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    for r in model.contributions(df.repartition(3), p).collect():
        assert sum(r[c] for c in (*p.columns, "bias")) == pytest.approx(margins[r.transaction_id], abs=1e-6)
    odd = df.limit(2).withColumn("a", F.lit(None).cast("double"))
    assert model.contributions(odd, p).count() == 2 and model.contributions(df.limit(0), p).count() == 0
    shares = model.mean_absolute(model.contributions(df, p), p.columns).collect()
    assert sum(r.share for r in shares) == pytest.approx(1) and max(shares, key=lambda r: r.share).feature in "abc"


def test_alerts_carry_their_reasons(package):
    df, p = package
    rows = model.score_table(df, p).collect()
    assert len(rows) == 400 and any(r.alert for r in rows)
    assert all((r.top_features != "") <= r.alert for r in rows) and all(len(r.top_features.split("; ")) <= 3 for r in rows)
    assert any("(+" in r.top_features for r in rows)


def naive_ap(y, s, w):
    order = sorted(set(s), reverse=True)
    n = tp = ap = 0
    positives = sum(w * y)
    for v in order:
        at = s == v
        hits = (w * y)[at].sum()
        n, tp = n + w[at].sum(), tp + hits
        ap += hits / positives * tp / n if n else 0
    return ap


@pytest.mark.parametrize("parts", [1, 5])
def test_bootstrap_equals_a_loop(spark, parts):
    rng = random.Random(2)
    rows = [(f"U{i}", int(rng.random() < 0.2), round(rng.random(), 1), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "u string, y int, a double, b double").repartition(4)
    got = ranking.bootstrap(df, "a", "b", "y", "u", replicates=60, seed=5, parts=parts, block=37).first()
    import hashlib

    unit = np.array([int(hashlib.md5(r[0].encode()).hexdigest()[:8], 16) for r in rows])
    y, a, b = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    w = ranking.replicate_weights(unit, 60, 5)
    assert w[:, 1:].mean() == pytest.approx(1, abs=0.05) and (w[:, 0] == 1).all()
    pairs = [(naive_ap(y, a, w[:, k]), naive_ap(y, b, w[:, k])) for k in range(61)]
    delta = np.array([q - p for p, q in pairs])
    assert (got.n, got.positives, got.replicates) == (500, y.sum(), 60)
    assert (got.a, got.b, got.delta) == pytest.approx((*pairs[0], delta[0]))
    assert (got.delta_low, got.delta_high) == pytest.approx(tuple(np.percentile(delta[1:], [2.5, 97.5])))
    assert (got.a_low, got.b_high) == pytest.approx((np.percentile([p for p, _ in pairs[1:]], 2.5), np.percentile([q for _, q in pairs[1:]], 97.5)))
    assert got.favouring_b == pytest.approx((delta[1:] > 0).mean())


def test_bootstrap_without_positives_or_rows(spark):
    df = spark.createDataFrame([("x", 0, 1.0, 2.0), ("y", 0, 1.0, 3.0)], "u string, y int, a double, b double")
    got = ranking.bootstrap(df, "a", "b", "y", "u", replicates=5).first()
    assert (got.n, got.replicates, got.delta, got.favouring_b) == (2, 0, None, None)
    assert ranking.bootstrap(df.limit(0), "a", "b", "y", "u", replicates=5).first().n == 0
