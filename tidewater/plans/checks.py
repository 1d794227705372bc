"""Queries over baselines, thresholds, drift, gates and misses, each with its SQL; the score is the rule score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import checks, graph, splits
from tidewater.operators import metrics as M
from tidewater.plans import graph as _graph_plans  # noqa: F401  (registers h18, whose SQL h19 extends)
from tidewater.plans.data import ORACLES, SCORED, query, split_bounds, with_score
from tidewater.plans.evaluation import _EVAL
from tidewater.sources.views import EVENTS_CTE as EV

_RANKED = f"{SCORED}, pr AS (SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS pct, row_number() OVER (ORDER BY score DESC, row_pos) AS place, count(*) OVER () AS nn FROM scored)"
_UNIT = "CAST(concat('0x', substr(md5(concat('{seed}|', transaction_id)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _flagged(tx: DataFrame, budget: float = 0.05) -> DataFrame:
    return M.flag_top(with_score(tx), budget)


@query("k5_f1_at_threshold", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (score >= 0.3) AS predicted, count(*) FILTER (is_laundering = 1) AS positives, count(*) FILTER (score >= 0.3 AND is_laundering = 1) AS tp FROM scored)
SELECT 0.3::DOUBLE AS threshold, predicted, positives, tp, round(2 * tp / (predicted + positives), 6) AS f1 FROM c""")
def _(tx):
    return _round(checks.f1_at(with_score(tx), 0.3), "f1")


@query("k4_threshold_apply", f"""WITH {split_bounds(SCORED)}, v AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_pos) AS k, count(*) OVER () AS n FROM scored, b WHERE t_us > b1 AND t_us <= b2),
th AS (SELECT budget, score AS threshold FROM v JOIN (SELECT unnest([0.01, 0.05]::DOUBLE[]) AS budget) ON k = greatest(1, round_even(n * budget, 0)))
SELECT budget, round(threshold, 6) AS threshold, count(*) FILTER (score >= threshold) AS alerts, count(*) FILTER (score >= threshold AND is_laundering = 1) AS hits FROM scored, b, th WHERE t_us > b2 GROUP BY budget, threshold""")
def _(tx):
    s = splits.chronological_split(with_score(tx))
    chosen = M.select_thresholds(s.filter("split = 'val'"), (0.01, 0.05))
    return _round(checks.apply_thresholds(s.filter("split = 'test'"), chosen), "threshold")


@query("k6_null_baselines", f"""WITH {EV}, t AS (SELECT is_laundering, 'constant' AS name, 0.5::DOUBLE AS score FROM tx UNION ALL SELECT is_laundering, 'random', {_UNIT.format(seed=42)} FROM tx),
{_EVAL.format(by='name', src='t')} SELECT name, round(ap, 6) AS average_precision, round(2.0 * positives / n, 6) AS ceiling, ap <= 2.0 * positives / n AS passed FROM m""")
def _(tx):
    return _round(checks.null_baselines(tx), "average_precision", "ceiling")


@query("k7_shuffled_labels", f"""WITH {split_bounds(EV)}, tr AS (SELECT tx.* FROM tx, b WHERE t_us <= b1), d AS (SELECT is_laundering AS y, row_number() OVER (ORDER BY {_UNIT.format(seed=42)}, transaction_id) AS k FROM tr),
z AS (SELECT payment_type, currency, d.y FROM (SELECT *, row_number() OVER (ORDER BY row_pos) AS k FROM tr) JOIN d USING (k)),
rates AS (SELECT payment_type, currency, (sum(y) + 0.01 * 10) / (count(*) + 10) AS score FROM z GROUP BY ALL),
t AS (SELECT 1 AS one, is_laundering, coalesce(score, 0.01) AS score FROM (SELECT tx.* FROM tx, b WHERE t_us > b2) x LEFT JOIN rates USING (payment_type, currency)), {_EVAL.format(by='one', src='t')}
SELECT round(ap, 6) AS average_precision, round(2.0 * positives / n, 6) AS ceiling, ap <= 2.0 * positives / n AS passed FROM m""")
def _(tx):
    s = splits.chronological_split(tx)
    found = checks.shuffled_label_test(s.filter("split = 'train'"), s.filter("split = 'test'"), checks.rate_scorer(["payment_type", "currency"]))
    return _round(found, "average_precision", "ceiling")


_DRIFTING = ("amount", "amount_received", "cents")


def _drift_sql(column: str) -> str:
    return f"""SELECT '{column}' AS feature, (SELECT sum((q - p) * ln(q / p)) FROM (SELECT bkt, greatest(sum(r) / (SELECT count(*) FROM part WHERE side = 1), 1e-6) AS p, greatest(sum(1 - r) / (SELECT count(*) FROM part WHERE side = 0), 1e-6) AS q
  FROM (SELECT side AS r, list_count(list_filter(list_distinct(e), lambda x: CASE WHEN {column} >= x THEN TRUE END)) AS bkt FROM part,
    (SELECT quantile_cont({column}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM part WHERE side = 1)) GROUP BY bkt)) AS psi,
  (SELECT max(abs(x - y)) FROM (SELECT sum(r) OVER (ORDER BY v) / (SELECT count(*) FROM part WHERE side = 1) AS x, sum(c) OVER (ORDER BY v) / (SELECT count(*) FROM part WHERE side = 0) AS y
    FROM (SELECT {column}::DOUBLE AS v, sum(side) AS r, sum(1 - side) AS c FROM part GROUP BY 1))) AS ks"""


@query("k12_drift_table", f"""WITH {split_bounds(EV)}, part AS (SELECT CASE WHEN t_us <= b1 THEN 1 ELSE 0 END AS side, amount, amount_received * CASE WHEN t_us > b2 THEN 3 ELSE 1 END AS amount_received, cents FROM tx, b WHERE t_us <= b1 OR t_us > b2),
u AS ({' UNION ALL '.join(map(_drift_sql, _DRIFTING))}) SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, psi > 0.25 AS significant, CAST(row_number() OVER (ORDER BY round(psi, 9) DESC, feature) AS INT) AS place FROM u""")
def _(tx):
    s = splits.chronological_split(tx)
    later = s.filter("split = 'test'").withColumn("amount_received", F.col("amount_received") * 3)  # one column is made to drift
    return _round(checks.drift_table(s.filter("split = 'train'"), later, list(_DRIFTING)), "psi", "ks")


@query("k9_monotone_decline", f"""WITH {SCORED}, lim AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM scored), s AS (SELECT scored.*, CAST(least(floor((t_us - lo) * 5 / (hi - lo)), 4) AS BIGINT) AS bucket FROM scored, lim),
{_EVAL.format(by='bucket', src='s')}, w AS (SELECT ap, lag(ap) OVER (ORDER BY bucket) AS before FROM m WHERE positives > 0 AND positives < n) SELECT count(*) AS windows, count(*) < 3 OR count(*) FILTER (ap > before) > 0 AS passed FROM w""")
def _(tx):
    return checks.monotone_decline(M.evaluate(splits.time_buckets(with_score(tx)), by=["bucket"]))


_LIMITS = [("C1", "correctness", "rows", ">=", 1.0), ("C2", "correctness", "self_share", "<=", 0.0), ("P1", "performance", "positives", ">=", 1.0), ("P2", "performance", "latency", "<=", 1.0)]


@query("k15_gate_report", f"""WITH {EV}, me AS (SELECT unnest(['rows', 'self_share', 'positives']) AS metric, unnest([count(*), avg(is_self_transfer), sum(is_laundering)]::DOUBLE[]) AS measured FROM tx),
l(gate, kind, metric, relation, threshold) AS (VALUES {', '.join(f"('{g}', '{k}', '{m}', '{r}', {t}::DOUBLE)" for g, k, m, r, t in _LIMITS)}),
s AS (SELECT gate, kind, CASE WHEN measured IS NULL THEN 'not_run' WHEN CASE WHEN relation = '>=' THEN measured >= threshold ELSE measured <= threshold END THEN 'pass' ELSE 'fail' END AS status,
  round(measured, 6) AS measured, threshold FROM l LEFT JOIN me USING (metric)) SELECT *, (SELECT count(*) > 0 FROM s WHERE kind = 'correctness' AND status = 'fail') AS voided FROM s""")
def _(tx):
    one = tx.agg(F.count("*").cast("double").alias("rows"), F.avg("is_self_transfer").alias("self_share"), F.sum("is_laundering").cast("double").alias("positives"))
    measured = one.unpivot([], ["rows", "self_share", "positives"], "metric", "measured")
    limits = tx.sparkSession.createDataFrame(_LIMITS, "gate string, kind string, metric string, relation string, threshold double")
    return _round(checks.gate_report(M.gates(measured, limits)), "measured")


@query("e19_two_sigma", f"""WITH {SCORED}, runs AS (SELECT payment_type, row_pos % 5 AS run, avg(score) AS v FROM scored GROUP BY ALL), arms AS (SELECT payment_type AS arm, avg(v) AS mean, stddev_samp(v) AS sd FROM runs GROUP BY 1),
bar AS (SELECT 2 * avg(sd) AS two_sigma FROM arms WHERE sd > 0)
SELECT x.arm AS better, y.arm AS worse, round(x.mean - y.mean, 6) AS delta, round(two_sigma, 6) AS two_sigma, CASE WHEN x.mean - y.mean > two_sigma THEN 'real' ELSE 'within noise' END AS verdict
FROM arms x JOIN arms y ON x.mean > y.mean OR (x.mean = y.mean AND x.arm < y.arm), bar""")
def _(tx):
    return _round(checks.two_sigma(with_score(tx).withColumn("run", F.col("row_pos") % 5), "payment_type", "run", "score"), "delta", "two_sigma")


@query("h19_false_positive_enrichment", f"""{ORACLES['h18_hard_negatives'].replace(EV, SCORED, 1).replace("SELECT * FROM f WHERE", ", hard AS (SELECT transaction_id FROM f WHERE", 1)}),
ro AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k, count(*) OVER () AS n FROM scored), edge AS (SELECT min(score) AS edge FROM ro WHERE k <= greatest(1, round_even(n * 0.05, 0))),
z AS (SELECT count(*) FILTER (h) AS n, count(*) FILTER (h AND score >= edge) AS flagged, count(*) FILTER (is_laundering = 0) AS b, count(*) FILTER (is_laundering = 0 AND score >= edge) AS bf
  FROM (SELECT *, transaction_id IN (SELECT transaction_id FROM hard) AS h FROM scored), edge)
SELECT n, 0.05::DOUBLE AS budget, flagged, round(flagged / n, 6) AS false_positive_rate, round(bf / b, 6) AS baseline_benign_rate, round((flagged / n) / (bf / b), 6) AS enrichment FROM z""")
def _(tx):
    return _round(checks.false_positive_enrichment(with_score(tx), graph.hard_negatives(tx), 0.05), "false_positive_rate", "baseline_benign_rate", "enrichment")


@query("e12_amount_bands", f"""WITH {_RANKED}, qs AS (SELECT list_distinct(quantile_cont(amount, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM scored), f AS (SELECT pr.*, place <= greatest(1, round_even(nn * 0.05, 0)) AS flagged,
  1 + list_count(list_filter(list_sort(e)[2:len(e) - 1], lambda x: CASE WHEN amount > x THEN TRUE END)) AS band FROM pr, qs)
SELECT 'amount_band' AS slice, CAST(band AS VARCHAR) AS value, count(*) AS positives, count(*) FILTER (flagged) AS caught, round(count(*) FILTER (flagged) / count(*), 6) AS recall FROM f WHERE is_laundering = 1 GROUP BY band""")
def _(tx):
    flagged = _flagged(tx)
    return _round(M.recall_by(flagged, checks.amount_bands(tx), "amount_band"), "recall")


@query("k19_missed_typologies", f"""WITH {_RANKED} SELECT pattern_type, count(*) AS positives, round(median(pct), 6) AS median_pct, round(max(pct), 6) AS best_pct, round(avg(CAST(pct > 0.99 AS INT)), 6) AS recall_1, round(avg(CAST(pct > 0.95 AS INT)), 6) AS recall_5
FROM pr WHERE is_laundering = 1 AND pattern_type IS NOT NULL GROUP BY 1""")
def _(tx):
    return _round(checks.missed_typologies(with_score(tx)), "median_pct", "best_pct", "recall_1", "recall_5")


@query("k16_transfer_diagnosis", f"""WITH {_RANKED}, f AS (SELECT *, place <= greatest(1, round_even(nn * 0.05, 0)) AS flagged FROM pr WHERE is_laundering = 1)
SELECT pattern_type IS NOT NULL AS structured, payment_type, count(*) AS positives, count(*) FILTER (flagged) AS caught, round(avg(CAST(flagged AS INT)), 6) AS recall, round(median(pct), 6) AS median_pct FROM f GROUP BY ALL""")
def _(tx):
    return _round(checks.transfer_diagnosis(_flagged(tx)), "recall", "median_pct")


@query("k20_blend_sweep", f"""WITH {_RANKED}, am AS (SELECT *, (rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2) / count(*) OVER () AS pb FROM pr),
t AS (SELECT is_laundering, w AS weight, round((1 - w) * pct + w * pb, 9) AS score FROM am, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS w)), {_EVAL.format(by='weight', src='t')} SELECT weight, round(ap, 6) AS average_precision FROM m""")
def _(tx):
    return _round(checks.blend_sweep(with_score(tx), "score", "amount"), "average_precision")


@query("k22_best_caught", f"""WITH {_RANKED}, s AS (SELECT pattern_type, scenario_id, count(*) AS size, count(*) FILTER (place <= greatest(1, round_even(nn * 0.05, 0))) AS caught FROM pr WHERE scenario_id IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM s WHERE size BETWEEN 2 AND 60 AND caught > 0 QUALIFY row_number() OVER (PARTITION BY pattern_type ORDER BY caught DESC, scenario_id) = 1) SELECT * FROM best ORDER BY caught DESC, scenario_id LIMIT 3""")
def _(tx):
    return checks.best_caught(_flagged(tx))


@query("e24_macro_f1", f"""WITH {EV}, k AS (SELECT payment_type, pattern_type AS guess FROM tx WHERE pattern_type IS NOT NULL GROUP BY payment_type, pattern_type QUALIFY row_number() OVER (PARTITION BY payment_type ORDER BY count(*) DESC, pattern_type) = 1),
p AS (SELECT pattern_type AS t, guess AS p FROM tx JOIN k USING (payment_type) WHERE pattern_type IS NOT NULL), c AS (SELECT t AS k, count(*) AS r FROM p GROUP BY 1)
SELECT count(*) AS classes, round(avg(2 * (SELECT count(*) FROM p WHERE p.t = c.k AND p.p = c.k) / (r + (SELECT count(*) FROM p WHERE p.p = c.k))), 6) AS macro_f1 FROM c""")
def _(tx):
    known = tx.filter("pattern_type IS NOT NULL")
    common = known.groupBy("payment_type", "pattern_type").agg(F.count("*").alias("n")).groupBy("payment_type").agg(F.min(F.struct((-F.col("n")).alias("n"), "pattern_type"))["pattern_type"].alias("guess"))
    return _round(checks.macro_f1(known.select("payment_type", "pattern_type").join(common, "payment_type"), "pattern_type", "guess"), "macro_f1")


@query("k21_confusion_at_two", f"""WITH {SCORED}, th AS (SELECT unnest([0.2, 0.4]::DOUBLE[]) AS threshold) SELECT threshold, is_laundering AS y, CAST(score >= threshold AS INT) AS predicted, count(*) AS n FROM scored, th GROUP BY ALL""")
def _(tx):
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("score") >= t).cast("int").alias("predicted")) for t in (0.2, 0.4)]))
    return with_score(tx).select(F.col("is_laundering").alias("y"), pairs.alias("x")).select("y", "x.*").groupBy("threshold", "y", "predicted").agg(F.count("*").alias("n"))


@query("g17_typologies", f"WITH {EV} SELECT DISTINCT pattern_type FROM tx WHERE pattern_type IS NOT NULL")
def _(tx):
    return checks.typologies(tx)


@query("d10_scores_with_labels", f"WITH {SCORED}, lab AS (SELECT transaction_id, 1 AS y FROM tx WHERE is_laundering = 1) SELECT transaction_id, round(score, 6) AS score, coalesce(y, 0) AS y FROM scored LEFT JOIN lab USING (transaction_id)")
def _(tx):
    labels = tx.filter("is_laundering = 1").select("transaction_id", F.lit(1).alias("y"))
    return _round(with_score(tx).select("transaction_id", "score").join(labels, "transaction_id", "left").withColumn("y", F.coalesce("y", F.lit(0))), "score")
