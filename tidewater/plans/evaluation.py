"""Queries over splits, metrics, drift and ranking, each with its SQL; the score is the rule score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import columns as C
from tidewater.operators import metrics as M
from tidewater.operators import ranking, splits
from tidewater.plans.data import SCORED, query, split_bounds, with_score
from tidewater.sources import views
from tidewater.sources.views import EVENTS_CTE as EV
from tidewater.sources.views import LINEITEM_CTE as LI


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


# --- splits --------------------------------------------------------------------------------------

_TRIM = """d AS (SELECT CAST(make_timestamp(t_us) AS DATE) AS day, count(*) AS rows FROM tx GROUP BY 1), q AS (SELECT quantile_cont(rows, 0.75) AS q FROM d),
l AS (SELECT max(day) AS last_day FROM d, q WHERE rows >= q * {density})"""


@query("i1_trim_tail", f"WITH {LI}, {_TRIM.format(density=0.5)} SELECT count(*) AS kept, (SELECT count(*) FROM tx) - count(*) AS dropped, max(t_us) AS last_us FROM tx, l WHERE CAST(make_timestamp(t_us) AS DATE) <= last_day")
def _(spark: SparkSession, sf_dir: str):
    tx = views.tx_lineitem(spark, sf_dir).withColumn("is_laundering", F.lit(0))
    kept, _report = splits.trim_sparse_tail(tx, 0.5)
    total = tx.agg(F.count("*").alias("n"))
    return kept.agg(F.count("*").alias("kept"), F.max("t_us").alias("last_us")).crossJoin(F.broadcast(total)).select("kept", (F.col("n") - F.col("kept")).alias("dropped"), "last_us")


_NAME = "CASE WHEN {t} <= b1 THEN 'train' WHEN {t} <= b2 THEN 'val' ELSE 'test' END"


@query("i2_split_hard_cut", f"WITH {split_bounds(EV)} SELECT transaction_id, {_NAME.format(t='t_us')} AS split FROM tx, b")
def _(tx):
    return splits.chronological_split(tx).select("transaction_id", "split")


@query("i2_split_ties", f"WITH {split_bounds(LI)} SELECT {_NAME.format(t='t_us')} AS split, count(*) AS n, count(DISTINCT t_us) AS instants, min(t_us) AS lo, max(t_us) AS hi FROM tx, b GROUP BY 1")
def _(spark: SparkSession, sf_dir: str):
    s = splits.chronological_split(views.tx_lineitem(spark, sf_dir))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("t_us").alias("instants"), F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))


_SPANS = "p AS (SELECT scenario_id AS k, min(t_us) AS lo, max(t_us) AS hi, count(*) AS n FROM tx WHERE scenario_id IS NOT NULL GROUP BY 1)"


@query("i3_spanning_patterns", f"""WITH {split_bounds(EV)}, {_SPANS} SELECT count(*) FILTER (lo <= b1 AND hi > b1 OR lo <= b2 AND hi > b2) AS spanning, count(*) AS patterns FROM p, b""")
def _(tx):
    spanning, patterns = splits.spanning_patterns(tx, splits.SplitSpec()), splits.pattern_spans(tx).count()
    return tx.sparkSession.createDataFrame([(spanning, patterns)], "spanning long, patterns long")


@query("i4_split_purge", f"""WITH {split_bounds(EV)}, {_SPANS}, w AS (SELECT max(hi - lo) AS buf FROM p) SELECT transaction_id, {_NAME.format(t='t_us')} AS split
  FROM tx, b, w WHERE NOT (t_us > b1 - buf AND t_us <= b1 + buf) AND NOT (t_us > b2 - buf AND t_us <= b2 + buf)""")
def _(tx):
    return splits.chronological_split(tx, splits.SplitSpec(policy="purge")).select("transaction_id", "split")


@query("i5_split_pattern_start", f"WITH {split_bounds(EV)}, {_SPANS} SELECT transaction_id, {_NAME.format(t='coalesce(lo, t_us)')} AS split FROM tx LEFT JOIN p ON p.k = scenario_id, b")
def _(tx):
    return splits.chronological_split(tx, splits.SplitSpec(policy="pattern_start")).select("transaction_id", "split")


@query("i7_unseen_pattern", f"""WITH {EV} SELECT transaction_id, CASE WHEN is_laundering = 1 THEN CASE WHEN coalesce(pattern_type IN ('CYCLE', 'STACK'), FALSE) THEN 'test' ELSE 'train' END
  WHEN CAST(concat('0x', substr(md5(transaction_id), 1, 8)) AS BIGINT) % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM tx""")
def _(tx):
    return splits.assign_unseen(tx, ["CYCLE", "STACK"]).select("transaction_id", "split")


@query("i8_annotation_coverage", f"WITH {EV} SELECT round(avg(CASE WHEN pattern_type IS NOT NULL THEN 1 ELSE 0 END), 6) AS coverage FROM tx WHERE is_laundering = 1")
def _(tx):
    return _round(splits.annotation_coverage(tx), "coverage")


@query("i9_rolling_origin", f"""WITH {LI}, o AS (SELECT t_us, row_number() OVER (ORDER BY t_us) - 1 AS k FROM tx), c AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.4) AS BIGINT) AS s FROM tx),
f AS (SELECT i AS fold, (SELECT t_us FROM o WHERE k = s + i * ((n - s) // 3) - 1) AS train_end_us, (SELECT t_us FROM o WHERE k = s + (i + 1) * ((n - s) // 3) - 1) AS val_end_us
  FROM c, (SELECT unnest([0, 1, 2]) AS i))
SELECT CAST(fold AS INT) AS fold, train_end_us, val_end_us, (SELECT count(*) FROM tx WHERE t_us <= train_end_us) AS n_train,
  (SELECT count(*) FROM tx WHERE t_us > train_end_us AND t_us <= val_end_us) AS n_val FROM f WHERE train_end_us < val_end_us""")
def _(spark: SparkSession, sf_dir: str):
    return splits.rolling_origin(views.tx_lineitem(spark, sf_dir))


@query("i10_proxy_labels", f"""WITH {EV}, ill AS (SELECT DISTINCT source_account AS a FROM tx WHERE is_laundering = 1),
tr AS (SELECT a FROM ill WHERE NOT CAST(concat('0x', substr(md5(a), 1, 8)) AS BIGINT) % 100 < 30)
SELECT transaction_id, CASE WHEN source_account IN (SELECT a FROM tr) OR destination_account IN (SELECT a FROM tr) THEN 1 ELSE 0 END AS proxy_label FROM tx""")
def _(tx):
    illicit = tx.filter("is_laundering = 1").select(F.col("source_account").alias("account_id")).distinct()
    return splits.proxy_labels(tx, illicit).select("transaction_id", "proxy_label")


@query("e20_pattern_spans", f"WITH {EV}, {_SPANS} SELECT k AS scenario_id, lo AS first_us, hi AS last_us, n FROM p")
def _(tx):
    return splits.pattern_spans(tx)


# --- metrics ---------------------------------------------------------------------------------------

_EVAL = """g AS (SELECT {by}, score, count(*) AS n, sum(is_laundering) AS tp FROM {src} GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS rows, sum(tp) OVER w AS hits, sum(n) OVER (PARTITION BY {by}) AS nn, sum(tp) OVER (PARTITION BY {by}) AS pp FROM g
  WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT {by}, CAST(any_value(nn) AS BIGINT) AS n, CAST(any_value(pp) AS BIGINT) AS positives, sum(tp / nullif(pp, 0) * hits / rows) AS ap,
  sum(tp * (nn - pp - (rows - hits) + 0.5 * (n - tp))) AS auc, max(2 * hits / (rows + pp)) AS f1, arg_max(score, (2 * hits / (rows + pp), score)) AS th FROM r GROUP BY {by})"""
_COLUMNS = """n, positives, round(positives / n, 6) AS base_rate, CASE WHEN positives > 0 AND positives < n THEN round(ap, 6) END AS average_precision,
 CASE WHEN positives > 0 AND positives < n THEN round(auc / (positives * (n - positives)), 6) END AS roc_auc, CASE WHEN positives > 0 AND positives < n THEN round(f1, 6) END AS best_f1,
 CASE WHEN positives > 0 AND positives < n THEN round(th, 6) END AS best_threshold, CASE WHEN positives > 0 AND positives < n THEN round(ap / (positives / n), 6) END AS lift"""
_METRICS = ("base_rate", "average_precision", "roc_auc", "best_f1", "best_threshold", "lift")


@query("k1_evaluate", f"WITH {SCORED}, {_EVAL.format(by='1::INT AS one', src='scored').replace('PARTITION BY 1::INT AS one', 'PARTITION BY one').replace('GROUP BY 1::INT AS one', 'GROUP BY one').replace('m AS (SELECT 1::INT AS one', 'm AS (SELECT one')} SELECT {_COLUMNS} FROM m")
def _(tx):
    return _round(M.evaluate(with_score(tx)), *_METRICS)


@query("k1_evaluate_by_rail", f"WITH {SCORED}, {_EVAL.format(by='payment_type', src='scored')} SELECT payment_type, {_COLUMNS} FROM m")
def _(tx):
    return _round(M.evaluate(with_score(tx), by=["payment_type"]), *_METRICS)


_BUDGETS = (0.001, 0.005, 0.01, 0.05)


def _budget_sql(tail: str = "") -> str:
    return f"""WITH {SCORED}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_pos) AS k, sum(is_laundering) OVER (ORDER BY score DESC, row_pos ROWS UNBOUNDED PRECEDING) AS h,
  count(*) OVER () AS n, sum(is_laundering) OVER () AS p FROM scored), b AS (SELECT unnest([{', '.join(map(str, _BUDGETS))}]::DOUBLE[]) AS budget)
SELECT budget, k, round(score, 6) AS threshold, CAST(h AS BIGINT) AS hits, round(h / k, 6) AS precision, round(h / nullif(p, 0), 6) AS recall{tail} FROM b JOIN o ON k = greatest(1, round_even(n * budget, 0))"""


@query("g2_budget_points", _budget_sql())
def _(tx):
    return _round(M.budget_points(with_score(tx), _BUDGETS), "threshold", "precision", "recall")


@query("k3_thresholds", _budget_sql(", 'val' AS chosen_on"))
def _(tx):
    return _round(M.select_thresholds(with_score(tx), _BUDGETS), "threshold", "precision", "recall")


_FLAGGED = f"""{SCORED}, flagged AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_pos) <= greatest(1, round_even(count(*) OVER () * 0.05, 0)) AS flagged,
  row_number() OVER (PARTITION BY scenario_id ORDER BY t_us, row_pos) AS place, count(*) OVER (PARTITION BY scenario_id) AS size FROM scored)"""


def _flagged(tx: DataFrame) -> DataFrame:
    return M.flag_top(with_score(tx), 0.05)


@query("e11_recall_per_typology", f"""WITH {_FLAGGED} SELECT 'typology' AS slice, pattern_type AS value, count(*) AS positives, count(*) FILTER (flagged) AS caught,
  round(count(*) FILTER (flagged) / count(*), 6) AS recall FROM flagged WHERE is_laundering = 1 AND pattern_type IS NOT NULL GROUP BY pattern_type""")
def _(tx):
    return _round(M.recall_by(_flagged(tx), F.col("pattern_type"), "typology"), "recall")


_BAND = "CASE WHEN hour(make_timestamp(t_us)) <= 5 THEN 'night' WHEN hour(make_timestamp(t_us)) <= 11 THEN 'morning' WHEN hour(make_timestamp(t_us)) <= 17 THEN 'afternoon' ELSE 'evening' END"
_POS = "CASE WHEN scenario_id IS NULL THEN NULL WHEN (place - 1) / size <= 0.33 THEN 'early' WHEN (place - 1) / size <= 0.66 THEN 'middle' ELSE 'late' END"


def _with_position(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("scenario_id")
    inside = df.filter("scenario_id IS NOT NULL").select(
        "row_pos", C.pattern_position(F.row_number().over(w.orderBy("t_us", "row_pos")), F.count("*").over(w)).alias("position")
    )
    return df.join(inside, "row_pos", "left")


@query("e12_recall_slices", f"""WITH {_FLAGGED}, t AS (SELECT flagged, unnest(['typology', 'hour_band', 'rail', 'position']) AS slice, unnest([pattern_type, {_BAND}, payment_type, {_POS}]) AS value
  FROM flagged WHERE is_laundering = 1)
SELECT slice, value, count(*) AS positives, count(*) FILTER (flagged) AS caught, round(count(*) FILTER (flagged) / count(*), 6) AS recall FROM t WHERE value IS NOT NULL GROUP BY ALL""")
def _(tx):
    groups = {"typology": F.col("pattern_type"), "hour_band": C.hour_band(F.hour(C.when_())), "rail": F.col("payment_type"), "position": F.col("position")}
    return _round(M.recall_slices(_with_position(_flagged(tx)), groups), "recall")


@query("f12_pattern_position", f"WITH {_FLAGGED} SELECT transaction_id, {_POS} AS position FROM flagged WHERE scenario_id IS NOT NULL")
def _(tx):
    return _with_position(tx).filter("scenario_id IS NOT NULL").select("transaction_id", "position")


@query("e13_confusion", f"""WITH {_FLAGGED} SELECT count(*) FILTER (is_laundering = 1 AND flagged) AS tp, count(*) FILTER (is_laundering = 0 AND flagged) AS fp,
  count(*) FILTER (is_laundering = 1 AND NOT flagged) AS fn, count(*) FILTER (is_laundering = 0 AND NOT flagged) AS tn FROM flagged""")
def _(tx):
    return M.confusion(_flagged(tx))


@query("e14_profiles", f"""WITH {_FLAGGED}, k AS (SELECT *, CASE WHEN is_laundering = 1 AND flagged THEN 'tp' WHEN flagged THEN 'fp' WHEN is_laundering = 1 THEN 'fn' ELSE 'tn' END AS outcome FROM flagged),
c AS (SELECT outcome, payment_type, count(*) AS c FROM k GROUP BY outcome, payment_type QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY count(*) DESC, payment_type) <= 3),
l AS (SELECT outcome, string_agg(payment_type || ':' || c, ',' ORDER BY c DESC, payment_type) AS top_rails FROM c GROUP BY 1)
SELECT outcome, count(*) AS n, round(median(amount), 6) AS median_amount, round(avg(is_self_transfer), 6) AS self_share, any_value(top_rails) AS top_rails FROM k JOIN l USING (outcome) GROUP BY outcome""")
def _(tx):
    return _round(M.error_profiles(_flagged(tx)), "median_amount", "self_share")


@query("k8_single_feature_ap", f"""WITH {EV}, t AS (SELECT is_laundering, unnest(['amount', 'cents', 'is_self_transfer', 'amount_received']) AS feature,
  unnest([amount, cents, is_self_transfer, amount_received]::DOUBLE[]) AS score FROM tx), {_EVAL.format(by='feature', src='t')} SELECT feature, round(ap, 6) AS average_precision FROM m""")
def _(tx):
    return _round(M.single_feature(tx.withColumn("fixed", F.lit(1)), ["amount", "cents", "is_self_transfer", "amount_received", "fixed"]), "average_precision")


@query("k9_subwindows", f"""WITH {SCORED}, b AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM scored), s AS (SELECT scored.*, CAST(least(floor((t_us - lo) * 5 / (hi - lo)), 4) AS BIGINT) AS bucket FROM scored, b),
{_EVAL.format(by='bucket', src='s')} SELECT bucket, n, positives, round(ap, 6) AS average_precision FROM m""")
def _(tx):
    e = M.evaluate(splits.time_buckets(with_score(tx)), by=["bucket"])
    return _round(e, "average_precision").select("bucket", "n", "positives", "average_precision")


_HALVES = "ref AS (SELECT amount AS v FROM tx, b WHERE t_us <= b1), cur AS (SELECT amount * 1.2 AS v FROM tx, b WHERE t_us > b2)"


def _halves(tx):
    """The train part as reference, the test part (shifted) as current."""
    split = splits.chronological_split(tx)
    return split.filter("split = 'train'").select("amount"), split.filter("split = 'test'").select((F.col("amount") * 1.2).alias("amount"))


@query("k10_psi", f"""WITH {split_bounds(EV)}, {_HALVES}, q AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM ref),
a AS (SELECT list_count(list_filter(list_distinct(e), lambda x: CASE WHEN v >= x THEN TRUE END)) AS b, 1 AS r FROM ref, q UNION ALL
  SELECT list_count(list_filter(list_distinct(e), lambda x: CASE WHEN v >= x THEN TRUE END)), 0 FROM cur, q),
c AS (SELECT b, greatest(sum(r) / (SELECT count(*) FROM ref), 1e-6) AS p, greatest(sum(1 - r) / (SELECT count(*) FROM cur), 1e-6) AS q FROM a GROUP BY b)
SELECT 'amount' AS feature, round(sum((q - p) * ln(q / p)), 6) AS psi FROM c""")
def _(tx):
    return _round(M.psi(*_halves(tx), "amount"), "psi")


@query("k11_ks", f"""WITH {split_bounds(EV)}, {_HALVES}, u AS (SELECT v, 1 AS r FROM ref UNION ALL SELECT v, 0 FROM cur), g AS (SELECT v, sum(r) AS r, sum(1 - r) AS c FROM u GROUP BY v),
s AS (SELECT sum(r) OVER (ORDER BY v) / (SELECT count(*) FROM ref) AS x, sum(c) OVER (ORDER BY v) / (SELECT count(*) FROM cur) AS y FROM g) SELECT 'amount' AS feature, round(max(abs(x - y)), 6) AS ks FROM s""")
def _(tx):
    return _round(M.ks(*_halves(tx), "amount"), "ks")


@query("e23_ece", f"""WITH {SCORED}, b AS (SELECT ceil(score * 10) AS b, score, is_laundering AS y FROM scored WHERE score > 0), g AS (SELECT b, count(*) AS n, avg(score) AS p, avg(y) AS y FROM b GROUP BY b)
SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM g""")
def _(tx):
    return _round(M.calibration_error(with_score(tx), "score", "is_laundering"), "ece")


@query("f15_percentile_rank", f"WITH {SCORED} SELECT transaction_id, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER (), 6) AS pct FROM scored")
def _(tx):
    return _round(M.percentile_rank(with_score(tx)), "pct")


_ACCOUNTS = f"""{SCORED}, ends AS (SELECT source_account AS account, score FROM scored UNION ALL SELECT destination_account, score FROM scored),
acc AS (SELECT account, max(score) AS max_score, avg(score) AS mean_score, list_avg(list_reverse_sort(list(score))[1:3]) AS topk_mean, count(*) AS n FROM ends GROUP BY account)"""


@query("e10_account_scores", f"WITH {_ACCOUNTS} SELECT account, round(max_score, 6) AS max_score, round(mean_score, 6) AS mean_score, round(topk_mean, 6) AS topk_mean, n FROM acc")
def _(tx):
    return _round(M.account_scores(with_score(tx)), "max_score", "mean_score", "topk_mean")


@query("k14_account_eval", f"""WITH {_ACCOUNTS}, lab AS (SELECT account, CASE WHEN CAST(substr(account, 2) AS INT) % 7 = 0 THEN 1 ELSE 0 END AS is_laundering FROM (SELECT DISTINCT account FROM ends)),
t AS (SELECT is_laundering, unnest(['max', 'mean', 'topk']) AS aggregation, unnest([round(max_score, 9), round(mean_score, 9), round(topk_mean, 9)]) AS score FROM acc JOIN lab USING (account)),
{_EVAL.format(by='aggregation', src='t')} SELECT aggregation, n, positives, round(ap, 6) AS average_precision, round(auc / (positives * (n - positives)), 6) AS roc_auc FROM m""")
def _(tx):
    ends = tx.select(F.explode(F.array("source_account", "destination_account")).alias("account")).distinct()
    number = F.substring("account", 2, 20).cast("int")
    labels = ends.select("account", F.when(number % 7 == 0, 1).otherwise(0).alias("is_illicit"))
    scored = M.account_scores(with_score(tx)).join(labels, "account")
    tall = scored.select(F.col("is_illicit").alias("is_laundering"), F.explode(F.array(*[
        F.struct(F.lit(a).alias("aggregation"), F.round(c, 9).alias("score")) for a, c in (("max", "max_score"), ("mean", "mean_score"), ("topk", "topk_mean"))])).alias("x"))
    e = M.evaluate(tall.select("is_laundering", "x.*"), by=["aggregation"])
    return _round(e, "average_precision", "roc_auc").select("aggregation", "n", "positives", "average_precision", "roc_auc")


@query("k21_pr_curve", f"""WITH {SCORED}, g AS (SELECT score, count(*) AS n, sum(is_laundering) AS tp FROM scored GROUP BY 1), r AS (SELECT score, sum(n) OVER w AS rows, sum(tp) OVER w AS hits, sum(tp) OVER () AS p, sum(n) OVER () AS nn FROM g WINDOW w AS (ORDER BY score DESC))
SELECT round(score, 6) AS score, round(hits / rows, 6) AS precision, round(hits / p, 6) AS recall, round((rows - hits) / (nn - p), 6) AS false_positive_rate FROM r""")
def _(tx):
    c = M.curve(with_score(tx))
    t = c.agg(F.sum("tp").alias("p"), F.sum("n").alias("nn"))
    c = c.crossJoin(F.broadcast(t))
    return c.select(F.round("score", 6).alias("score"), F.round(F.col("hits") / F.col("rows"), 6).alias("precision"), F.round(F.col("hits") / F.col("p"), 6).alias("recall"),
                    F.round((F.col("rows") - F.col("hits")) / (F.col("nn") - F.col("p")), 6).alias("false_positive_rate"))


@query("k21_score_histogram", f"WITH {SCORED} SELECT CAST(least(floor(score * 60), 59) AS BIGINT) AS bin, is_laundering AS y, count(*) AS n FROM scored GROUP BY ALL")
def _(tx):
    return M.score_histogram(with_score(tx))


@query("e19_seed_summary", f"WITH {SCORED} SELECT payment_type, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, count(*) AS n FROM scored GROUP BY 1")
def _(tx):
    return _round(M.seed_summary(with_score(tx), "payment_type", "score"), "mean", "sd")


# --- ranking ----------------------------------------------------------------------------------------


@query("f13_rank", f"WITH {SCORED} SELECT transaction_id, row_number() OVER (ORDER BY score DESC, row_pos) AS rank FROM scored")
def _(tx):
    return ranking.rank(with_score(tx)).select("transaction_id", "rank")


@query("g5_cascade", f"""WITH {SCORED}, s AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_pos) <= greatest(1, round_even(count(*) OVER () * 0.05, 0)) AS selected FROM scored)
SELECT transaction_id, selected, round(CASE WHEN selected THEN 0.5 + 0.5 * (row_number() OVER (PARTITION BY selected ORDER BY amount, row_pos) - 1) / greatest(count(*) OVER (PARTITION BY selected) - 1, 1)
  ELSE 0.5 * (row_number() OVER (PARTITION BY selected ORDER BY score, row_pos) - 1) / greatest(count(*) OVER (PARTITION BY selected) - 1, 1) END, 6) AS combined FROM s""")
def _(tx):
    return _round(ranking.cascade(with_score(tx), "score", "amount"), "combined").select("transaction_id", "selected", "combined")


@query("g7_subjects", f"""WITH {SCORED}, r AS (SELECT source_account, transaction_id, row_number() OVER (ORDER BY score DESC, row_pos) AS rank FROM scored)
SELECT source_account, transaction_id, rank FROM r WHERE rank <= 100 QUALIFY row_number() OVER (PARTITION BY source_account ORDER BY rank) = 1 ORDER BY rank LIMIT 10""")
def _(tx):
    r = ranking.rank(with_score(tx)).withColumn("alert", F.col("rank") <= 100)
    return ranking.subjects(r).select("source_account", "transaction_id", "rank")


@query("g16_rank_ensemble", f"""WITH {SCORED} SELECT transaction_id, round(0.5 * (row_number() OVER (ORDER BY score, row_pos) - 1) / (count(*) OVER () - 1)
  + 0.5 * (row_number() OVER (ORDER BY amount, row_pos) - 1) / (count(*) OVER () - 1), 6) AS ensemble FROM scored""")
def _(tx):
    return _round(ranking.rank_ensemble(with_score(tx), "score", "amount"), "ensemble").select("transaction_id", "ensemble")


@query("g13_hash_sample", f"WITH {EV} SELECT transaction_id FROM tx ORDER BY md5(concat_ws('|', '7', transaction_id)), transaction_id LIMIT 100")
def _(tx):
    return ranking.hash_sample(tx, 100, seed=7).select("transaction_id")


_BOUNDS = ", ".join(f"{p!r}::DOUBLE" for p in ranking.POISSON)
_MIX = "CAST((xor(x, x >> 16) * 73244475) % 4294967296 AS BIGINT)"


def _arm(score: str) -> str:
    """Average precision of each replicate: hits at a score times precision down to it, over the positives."""
    return f"""(SELECT r, sum(tp * hits / nullif(upto, 0)) / nullif(max(hits), 0) AS ap FROM (SELECT r, tp, sum(tp) OVER w AS hits, sum(n) OVER w AS upto
  FROM (SELECT r, {score} AS s, sum(w) AS n, sum(w * y) AS tp FROM drawn GROUP BY 1, 2) WINDOW w AS (PARTITION BY r ORDER BY s DESC)) GROUP BY r)"""


@query("g14_bootstrap", f"""WITH {SCORED}, acc AS (SELECT source_account AS u, max(is_laundering) AS y, max(score) AS a, max(amount) AS b, CAST(concat('0x', substr(md5(source_account), 1, 8)) AS BIGINT) AS h FROM scored GROUP BY 1),
m0 AS (SELECT *, (h + r * 2654435769 + 11) % 4294967296 AS x FROM acc, range(1, 2001) t(r)), m1 AS (SELECT * REPLACE ({_MIX} AS x) FROM m0), m2 AS (SELECT * REPLACE ({_MIX} AS x) FROM m1),
drawn AS (SELECT u, y, a, b, 0 AS r, 1 AS w FROM acc UNION ALL SELECT u, y, a, b, r, len(list_filter([{_BOUNDS}], lambda p: p <= xor(x, x >> 16) / 4294967296.0::DOUBLE)) AS w FROM m2),
positives AS (SELECT r, sum(w * y) AS p FROM drawn GROUP BY r),
paired AS (SELECT r, x.ap AS a, y.ap AS b, y.ap - x.ap AS d FROM {_arm('a')} x JOIN {_arm('b')} y USING (r) JOIN positives USING (r) WHERE r = 0 OR p >= 2),
point AS (SELECT * FROM paired WHERE r = 0), reps AS (SELECT * FROM paired WHERE r > 0)
SELECT (SELECT count(*) FROM acc) AS n, CAST((SELECT sum(y) FROM acc) AS BIGINT) AS positives, (SELECT count(*) FROM reps) AS replicates,
  {', '.join(f"round((SELECT {c} FROM point), 6) AS {n}, round((SELECT quantile_cont({c}, 0.025) FROM reps), 6) AS {n}_low, round((SELECT quantile_cont({c}, 0.975) FROM reps), 6) AS {n}_high" for c, n in (('a', 'a'), ('b', 'b'), ('d', 'delta')))},
  round((SELECT avg(CASE WHEN d > 0 THEN 1 ELSE 0 END) FROM reps), 6) AS favouring_b""")
def _(tx):
    accounts = with_score(tx).groupBy("source_account").agg(F.max("is_laundering").alias("y"), F.max("score").alias("a"), F.max("amount").alias("b"))
    found = ranking.bootstrap(accounts, "a", "b", "y", "source_account")
    return _round(found, *[f"{c}{s}" for c in ("a", "b", "delta") for s in ("", "_low", "_high")], "favouring_b")


@query("g8_top_reasons", f"""WITH {EV}, c AS (SELECT transaction_id, unnest(['amount_log', 'self', 'cross']) AS f, unnest([ln(1 + amount) - 3, is_self_transfer - 0.5, CASE WHEN currency <> currency_received THEN 1 ELSE -1 END]) AS v FROM tx)
SELECT transaction_id, coalesce(string_agg(printf('%s (+%.3f)', f, v), '; ' ORDER BY v DESC, f) FILTER (v > 0), '') AS top_features FROM c GROUP BY 1""")
def _(tx):
    c = tx.select("transaction_id", (F.log1p("amount") - 3).alias("amount_log"), (F.col("is_self_transfer") - 0.5).alias("self"),
                  F.when(F.col("currency") != F.col("currency_received"), 1.0).otherwise(-1.0).alias("cross"))
    return ranking.top_reasons(c, ["amount_log", "self", "cross"])
