"""The model layer on pyspark.ml: boosted trees, isotonic calibration, attributions, packages and scoring."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.columns import schema_hash
from tidewater.operators import attribution
from tidewater.operators.contract import assert_label_blind
from tidewater.operators.ranking import rank, top_reasons
from tidewater.session import cut, shared_dir

#: Train rows that one task of a patient fit holds, at least about: a round is a job a level, and small tasks cost more than they do.
FIT_ROWS = 50_000


def piecewise(value: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation over break points, flat outside; a chain of built-in expressions."""
    if not xs:
        return value
    out = F.lit(float(ys[-1]))
    for x0, x1, y0, y1 in reversed(list(zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True))):
        inner = F.lit(float(y0)) if x1 == x0 else F.lit(float(y0)) + (value - float(x0)) * ((y1 - y0) / (x1 - x0))
        out = F.when(value <= float(x1), inner).otherwise(out)
    return F.when(value <= float(xs[0]), float(ys[0])).otherwise(out)


@dataclass
class Package:
    """What scoring needs: the trees, the calibrator's break points, the ordered columns, and the threshold."""

    model: GBTClassificationModel
    columns: list[str]
    xs: list[float]
    ys: list[float]
    threshold: float

    @property
    def schema_hash(self) -> str:
        return schema_hash(self.columns)

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        facts = {"columns": self.columns, "schema_hash": self.schema_hash, "threshold": self.threshold, "xs": self.xs, "ys": self.ys}
        spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Package:
        facts = json.loads(spark.read.text(f"{path}/facts").first().value)
        if facts["schema_hash"] != schema_hash(facts["columns"]):
            raise ValueError("the package's columns do not match their hash")
        return cls(GBTClassificationModel.load(f"{path}/model"), facts["columns"], facts["xs"], facts["ys"], facts["threshold"])


FEATURES = "__features"


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """The contract's columns, exactly and in order, as one vector; nulls become -1 only here. A frame from `assembled` is returned as it is."""
    if FEATURES in df.columns:
        held = [a["name"].removeprefix("__f_") for a in df.schema[FEATURES].metadata["ml_attr"]["attrs"]["numeric"]]
        if held != list(columns):
            raise ValueError(f"the vector holds other features: {', '.join(held)}")
        return df
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"features are missing and are not filled: {', '.join(missing)}")
    filled = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"__f_{c}") for c in columns])
    return VectorAssembler(inputCols=[f"__f_{c}" for c in columns], outputCol=FEATURES).transform(filled).drop(*[f"__f_{c}" for c in columns])


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with the columns as one vector, written once: a fit passes over its rows many times, and several fits may share them."""
    assert_label_blind(df.select(*columns))
    return cut(assemble(df, columns).drop(*columns), "assembled")


def fit(train: DataFrame, val: DataFrame, columns: list[str], threshold: float = 0.5, iterations: int = 20, depth: int = 4, seed: int = 7, subsample: float = 1.0, calibrate: bool = True, patience: int | None = None) -> Package:
    """Boosted trees with the rarer class weighted up, stopped on the validation rows, calibrated on them; each tree sees `subsample` of the rows.

    Without `calibrate` the package's score is its raw score. The parts may come from `assembled`. With `patience` rounds
    go on for so many after the best one; without it, Spark's own rule stops at the first that gains less than one percent.
    """
    if FEATURES not in train.columns:
        assert_label_blind(train.select(*columns))
    y = F.col("is_laundering").cast("double")
    counts = train.agg(F.sum(y).alias("p"), F.count("*").alias("n")).first()
    up = (counts["n"] - counts["p"]) / counts["p"] if counts["p"] else 1.0
    parts = [assemble(df, columns).withColumns({"label": y, "weight": F.when(y == 1, up).otherwise(1.0), "__val": F.lit(held)}) for df, held in ((train, False), (val, True))]
    trees = GBTClassifier(featuresCol=FEATURES, labelCol="label", weightCol="weight", maxIter=iterations, maxDepth=depth, seed=seed, subsamplingRate=subsample)
    if patience is None:
        model = trees.setValidationIndicatorCol("__val").fit(parts[0].unionByName(parts[1], allowMissingColumns=True))
    else:
        model = _patient(trees, parts[0].coalesce(max(1, -(-counts["n"] // FIT_ROWS))), parts[1], patience)
    if not calibrate:
        return Package(model, columns, [], [], threshold)
    raw = _raw(model, assemble(val, columns)).withColumn("label", y)
    iso = IsotonicRegression(featuresCol="raw_score", labelCol="label").fit(raw.select("raw_score", "label"))
    xs, ys = [float(x) for x in iso.boundaries], [min(1.0, max(0.0, float(v))) for v in iso.predictions]
    return Package(model, columns, xs, ys, threshold)


def _patient(trees: GBTClassifier, train: DataFrame, val: DataFrame, patience: int) -> GBTClassificationModel:
    """The rounds up to `patience` after the one of least weighted loss on the validation rows; all of them where those have no positive.

    A round's rows are drawn by its number, so that fewer rounds are the beginning of more: a shorter fit is tried first.
    """
    context, rounds = train.sparkSession.sparkContext, trees.getMaxIter()
    if context.getCheckpointDir() is None:  # a round's lineage holds all earlier ones
        context.setCheckpointDir(shared_dir(train.sparkSession, "fits"))
    watched = not val.filter("label = 1").isEmpty()
    for tried in sorted({min(rounds, patience + patience // 4), rounds} if watched else {rounds}):
        model = trees.copy({trees.maxIter: tried}).fit(train)
        loss = model.evaluateEachIteration(val) if watched else []
        keep = min(loss.index(min(loss)) + patience + 1, rounds) if watched else rounds
        if keep <= tried:
            break
    return _first(trees, model, keep)


def _first(trees: GBTClassifier, model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first rounds alone; Python has no constructor for it."""
    context, whole = SparkContext._active_spark_context, model._java_obj
    spark_ml, parts = context._jvm.org.apache.spark.ml, []
    for kind, values in ((spark_ml.regression.DecisionTreeRegressionModel, whole.trees()), (context._jvm.double, whole.treeWeights())):
        parts.append(context._gateway.new_array(kind, rounds))
        for i in range(rounds):
            parts[-1][i] = values[i]
    made = spark_ml.classification.GBTClassificationModel(whole.uid(), *parts, whole.numFeatures(), whole.numClasses())
    return trees._copyValues(GBTClassificationModel(made))


def _raw(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("raw_score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", FEATURES)


def margin(df: DataFrame, package: Package) -> DataFrame:
    """Adds raw_score alone, which orders rows as the calibrated score does but for its ties."""
    return _raw(package.model, assemble(df, package.columns))


def score(df: DataFrame, package: Package) -> DataFrame:
    """Adds raw_score, score, rank and alert."""
    scored = margin(df, package).withColumn("score", piecewise(F.col("raw_score"), package.xs, package.ys))
    return rank(scored, "score", "raw_score").withColumn("alert", F.col("score") >= package.threshold)


def importances(package: Package, top: int = 20) -> list[tuple[str, float]]:
    pairs = zip(package.columns, package.model.featureImportances.toArray().tolist(), strict=True)
    return sorted(pairs, key=lambda x: (-x[1], x[0]))[:top]


def contributions(df: DataFrame, package: Package) -> DataFrame:
    """(transaction_id, one column a feature, bias): Shapley attributions that add up to the trees' raw margin."""
    return attribution.contributions(df, package.model, package.columns)


def score_table(df: DataFrame, package: Package, reasons: int = 3) -> DataFrame:
    """`score` with `top_features`: for alerts alone, what pushed the score up most; empty for the rest."""
    scored = score(df, package)
    why = top_reasons(contributions(scored.filter("alert"), package), package.columns, reasons, attribution.labels(package.columns))
    return scored.join(why, "transaction_id", "left").withColumn("top_features", F.coalesce("top_features", F.lit("")))


def mean_absolute(contribs: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, family, mean_abs, share) over a table of contributions."""
    one = contribs.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0.0)).alias("total")
    rows = one.select(total, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs")) for c in columns])).alias("r")).select("total", "r.*")
    return rows.select("feature", F.substring_index("feature", "_", 1).alias("family"), "mean_abs", (F.col("mean_abs") / F.nullif(F.col("total"), F.lit(0.0))).alias("share"))


def random_search(train_val: list[tuple[DataFrame, DataFrame]], columns: list[str], space: dict[str, list], trials: int = 4, seed: int = 3) -> list[tuple[dict, float]]:
    """Distinct random settings by mean average precision over folds, best first."""
    import random

    from tidewater.operators.metrics import evaluate

    rng, seen, out = random.Random(seed), set(), []
    limit = 1
    for v in space.values():
        limit *= len(v)
    while len(seen) < min(trials, limit):
        seen.add(tuple((k, rng.choice(v)) for k, v in sorted(space.items())))
    for pick in sorted(seen, key=str):
        values = []
        for train, val in train_val:
            values.append(evaluate(score(val, fit(train, val, columns, **dict(pick)))).first()["average_precision"] or 0.0)
        out.append((dict(pick), sum(values) / len(values)))
    return sorted(out, key=lambda x: -x[1])
