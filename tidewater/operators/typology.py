"""A hint at the typology of a transfer: a forest over the feature columns that may answer `unclassified`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.contract import assert_label_blind
from tidewater.operators.model import assemble

#: The answer below the floor, and the floor.
UNCLASSIFIED = "unclassified"
CONFIDENCE_FLOOR = 0.40


class TypologyError(ValueError):
    """Raised when no typology can be learnt."""


@dataclass
class TypologyHinter:
    model: RandomForestClassificationModel
    classes: list[str]
    columns: list[str]
    floor: float = CONFIDENCE_FLOOR

    def hint(self, df: DataFrame) -> DataFrame:
        """Adds `hint`, `confidence` and `distribution` (a map of class to probability); equal classes go to the first by name."""
        raw = self.model.transform(assemble(df, self.columns)).withColumn("__p", vector_to_array("probability"))
        best = F.array_max("__p")
        label = F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("__p", best).cast("int"))
        return raw.withColumns({
            "hint": F.when(best >= self.floor, label).otherwise(UNCLASSIFIED), "confidence": best,
            "distribution": F.map_from_arrays(F.array(*map(F.lit, self.classes)), F.col("__p")),
        }).drop("__p", "__features", "rawPrediction", "probability", "prediction")


def fit(train: DataFrame, columns: list[str], typology: str = "pattern_type", trees: int = 50, depth: int = 6, least_rows: int = 5, seed: int = 7) -> TypologyHinter:
    """Learns from annotated rows alone: the typology of the others is unknown, not absent. Two classes at least."""
    assert_label_blind(train.select(*columns))
    known = train.filter(F.col(typology).isNotNull())
    classes = sorted(r[0] for r in known.select(typology).distinct().collect())  # one row a typology
    if len(classes) < 2:
        raise TypologyError(f"two typologies at least are needed; the rows hold {len(classes)}")
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(typology)) - 1
    ready = assemble(known, columns).withColumn("label", place.cast("double"))
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=least_rows, seed=seed)
    return TypologyHinter(forest.fit(ready), classes, columns)
