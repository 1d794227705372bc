"""Queries that run a stream over the given tables to its end and compare what it wrote with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import splits
from tidewater.plans.data import query, split_bounds
from tidewater.session import cut, shared_dir
from tidewater.sources.views import EVENTS_CTE as EV
from tidewater.streaming import pairs

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query("l4_pair_warm_start", f"""WITH {split_bounds(EV)}, late AS (SELECT tx.* FROM tx, b WHERE t_us > b1 AND source_account IS NOT NULL AND destination_account IS NOT NULL)
SELECT x.row_pos, count(*) FILTER (y.source_account = x.source_account AND y.destination_account = x.destination_account) AS bh_pair_n_prior,
  count(*) FILTER (y.source_account = x.destination_account AND y.destination_account = x.source_account) AS bh_reverse_pair_n_prior
FROM late x LEFT JOIN tx y ON least(y.source_account, y.destination_account) = least(x.source_account, x.destination_account)
  AND greatest(y.source_account, y.destination_account) = greatest(x.source_account, x.destination_account) AND y.t_us < x.t_us GROUP BY 1""")
def _(tx):
    """The train part is the past, as counts; what comes after it is streamed from files."""
    spark = tx.sparkSession
    keep = ("row_pos", "t_us", "source_account", "destination_account")
    split = cut(splits.chronological_split(tx).select(*keep, "split"), "streamed")
    at = shared_dir(spark, "pair-stream")
    later = split.filter("split <> 'train'").select(*keep)
    later.write.parquet(f"{at}/in")
    past = cut(pairs.past_counts(split.filter("split = 'train'")), "past-pairs")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, pairs.ROCKSDB)
    try:
        rows = pairs.pair_history(spark.readStream.schema(later.schema).parquet(f"{at}/in"), past)
        q = rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(rows.schema).parquet(f"{at}/out").select("row_pos", *[F.col(c) for c in rows.columns[1:]])
