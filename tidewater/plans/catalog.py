"""All queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators import history, metrics, ranking
from tidewater.plans import ablation, checks, data, evaluation, graph, models, resume, streams  # noqa: F401  (each module registers its queries)
from tidewater.sources import views

QUERIES = data.QUERIES
ORACLES = data.ORACLES


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History features, rule score and rank of the top percent of transfers."""
    tx = views.tx_events(spark, sf_dir)
    ranked = ranking.rank(metrics.flag_top(data.with_score(tx), 0.01).filter("flagged"))
    return ranked.select("row_pos", "transaction_id", "score", "rank").join(history.behaviour(tx), "row_pos")
