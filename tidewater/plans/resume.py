"""Queries over resumable extraction: a run that is cut short and goes on with later transfers equals one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import DAY_US
from tidewater.operators import graph
from tidewater.plans import graph as _graph_plans  # noqa: F401  (registers h1, whose SQL the extraction must equal)
from tidewater.plans.data import ORACLES, query, split_bounds
from tidewater.session import cut, shared_dir
from tidewater.sources import resume
from tidewater.sources.views import EVENTS_CTE as EV

_PARTS = 6


def _size(tx: DataFrame) -> int:
    return tx.count() // _PARTS + 1


@query("a14_resumed_extraction", ORACLES["h1_fan_degree"])
def _(tx):
    """One batch of the earlier transfers' parts, then the run over all of them, which keeps what the first one made."""
    path, size, last = shared_dir(tx.sparkSession, "resumed"), _size(tx), tx.agg(F.max("t_us")).first()[0]
    asked = {"compute": graph.fan_degree, "path": path, "rows_per_part": size, "reach_us": DAY_US, "settings": "fan_degree 1 day", "at_once": 3}
    if last is not None:
        resume.extract(tx.filter(F.col("t_us") < last), jobs=1, **asked)
    resume.extract(tx, **asked)
    return resume.read(tx, path, size, DAY_US, asked["settings"]) if last is not None else graph.fan_degree(tx)


@query("a14_part_plan", f"""WITH {EV}, c AS (SELECT t_us, count(*) AS n FROM tx GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY t_us) - n AS before FROM c),
s AS (SELECT t_us, n, before // ((SELECT count(*) FROM tx) // {_PARTS} + 1) AS slot FROM r)
SELECT CAST(dense_rank() OVER (ORDER BY slot) - 1 AS BIGINT) AS part, min(t_us) AS first_us, max(t_us) AS last_us, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY slot""")
def _(tx):
    parts = resume.plan(tx, _size(tx), DAY_US)
    ranges = tx.sparkSession.createDataFrame([(p.part, p.first_us, p.last_us) for p in parts], "part long, first_us long, last_us long")  # a row a part
    counts = resume.assigned(tx.select("t_us"), [p.first_us for p in parts]).groupBy("part").agg(F.count("*").alias("n"))
    return ranges.join(counts, "part")


@query("a14_stale_parts", f"""WITH {split_bounds(EV)}, c AS (SELECT t_us, count(*) AS n FROM tx GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY t_us) - n AS before FROM c),
s AS (SELECT t_us, before // ((SELECT count(*) FROM tx) // {_PARTS} + 1) AS slot FROM r), p AS (SELECT CAST(dense_rank() OVER (ORDER BY slot) - 1 AS BIGINT) AS part, min(t_us) AS lo, max(t_us) AS hi FROM s GROUP BY slot),
hit AS (SELECT part, lo, hi FROM p, (SELECT min(t_us) AS t FROM tx, b WHERE t_us > b1) x WHERE t >= lo AND t <= hi)
SELECT p.part FROM p JOIN hit ON p.part >= hit.part AND (p.part = hit.part OR hit.hi >= p.lo - {DAY_US})""")
def _(tx):
    """What one changed transfer, the first after the train part, makes stale: its part and those that look back on it."""
    from tidewater.operators import splits

    size, spark = _size(tx), tx.sparkSession
    first = cut(splits.chronological_split(tx), "stale").filter("split <> 'train'").agg(F.min(F.struct("t_us", "row_pos")).alias("m")).first().m
    before = {p.part: p.source for p in resume.plan(tx, size, DAY_US)}
    changed = tx if first is None else tx.withColumn("amount", F.when(F.col("row_pos") == first.row_pos, F.col("amount") + 1).otherwise(F.col("amount")))
    stale = [(p.part,) for p in resume.plan(changed, size, DAY_US) if p.source != before[p.part]]
    return spark.createDataFrame(stale, "part long")
