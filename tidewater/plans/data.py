"""Queries over data quality, row features and account history, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import columns as C
from tidewater.operators import contract, history, splits
from tidewater.operators.quantiles import quantiles
from tidewater.sources import views
from tidewater.sources.views import EVENTS_CTE as EV
from tidewater.sources.views import LINEITEM_CTE as LI

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the events view (or, with two parameters, of session and folder)."""

    def add(f):
        two = f.__code__.co_argcount == 2
        QUERIES[name] = f if two else lambda spark, sf_dir: f(views.tx_events(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def with_score(tx: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """Transfers with the rule score, its amount limits fitted on `fitted_on` (without it, on all rows)."""
    q = quantiles(tx if fitted_on is None else fitted_on, {"amount": [0.99, 0.999]})["amount"] or [0.0, 0.0]
    return tx.withColumn("score", C.rule_score(C.rule_columns(tx.columns, float(q[0]), float(q[1]))))


SCORED = f"""{EV}, q AS (SELECT quantile_cont(amount, 0.99) AS q99, quantile_cont(amount, 0.999) AS q999 FROM tx),
rules AS (SELECT tx.*, amount > q99 AS large_amount, amount > q999 AS very_large_amount, currency IS DISTINCT FROM currency_received AS cross_currency,
    amount % 1000 = 0 AS round_amount, hour(make_timestamp(t_us)) < 6 OR hour(make_timestamp(t_us)) >= 22 AS odd_hour,
    is_self_transfer = 0 AS non_self_transfer FROM tx, q),
scored AS (SELECT *, (CAST(large_amount AS INT) * 1.0::DOUBLE + CAST(very_large_amount AS INT) * 1.5::DOUBLE + CAST(cross_currency AS INT) * 0.75::DOUBLE
    + CAST(round_amount AS INT) * 0.5::DOUBLE + CAST(odd_hour AS INT) * 0.25::DOUBLE + CAST(non_self_transfer AS INT) * 0.25::DOUBLE)
    / 4.25::DOUBLE AS score FROM rules)"""


def split_bounds(cte: str) -> str:
    """The rows with `b`, the last instants of the train and of the validation part."""
    at = lambda f: f"(SELECT t_us FROM o WHERE k = least(greatest(CAST(round_even(n * {f}, 0) AS BIGINT), 1), n - 1) - 1)"
    return f"""{cte}, o AS (SELECT t_us, row_number() OVER (ORDER BY t_us) - 1 AS k, count(*) OVER () AS n FROM tx), b AS (SELECT {at(0.7)} AS b1, {at(0.85)} AS b2)"""


# --- data -------------------------------------------------------------------------------------


@query("e1_summary", f"""WITH {EV} SELECT count(*) AS rows, (SELECT count(DISTINCT a) FROM (SELECT source_account AS a FROM tx UNION ALL
  SELECT destination_account FROM tx)) AS accounts, CAST(sum(is_laundering) AS BIGINT) AS positives, round(avg(is_laundering), 6) AS base_rate,
  min(t_us) AS first_us, max(t_us) AS last_us FROM tx""")
def _(tx):
    return contract.summarise(tx).withColumn("base_rate", F.round("base_rate", 6))


@query("e2_daily_profile", f"""WITH {EV} SELECT CAST(make_timestamp(t_us) AS DATE) AS day, count(*) AS rows,
  CAST(sum(is_laundering) AS BIGINT) AS positives, round(avg(is_laundering), 6) AS rate FROM tx GROUP BY 1""")
def _(tx):
    return contract.daily_profile(tx).withColumn("rate", F.round("rate", 6))


_KEY = "t_us, source_account, destination_account, cents, currency, payment_type"


@query("e3_validation", f"""WITH {EV}, m AS (SELECT count(*) FILTER (t_us IS NULL) AS null_time, count(*) FILTER (amount < 0) AS negative_amount,
  count(*) FILTER (source_account IS NULL OR destination_account IS NULL) AS null_endpoint, CAST(sum(is_laundering) AS BIGINT) AS positives,
  count(*) FILTER (amount = 0) AS zero_amount, count(*) FILTER (source_account = destination_account) AS self_transfer,
  count(*) FILTER (currency IS DISTINCT FROM currency_received) AS cross_currency, (max(t_us) - min(t_us)) // 86400000000 AS span_days,
  count(DISTINCT t_us) AS distinct_times, count(*) - count(DISTINCT transaction_id) AS duplicate_id FROM tx),
d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_KEY} FROM tx)) AS duplicate_key FROM tx)
SELECT "check", CASE WHEN "check" IN ('duplicate_id', 'null_time', 'negative_amount', 'null_endpoint') THEN 'error'
  WHEN "check" IN ('zero_amount', 'duplicate_key') THEN 'warning' ELSE 'info' END AS severity, n
FROM (SELECT * FROM m, d) UNPIVOT (n FOR "check" IN (duplicate_id, null_time, negative_amount, null_endpoint, zero_amount, duplicate_key,
  positives, self_transfer, cross_currency, span_days, distinct_times))""")
def _(tx):
    return contract.findings(tx)


@query("e4_duplicate_natural_key", f"""WITH {LI} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS n FROM tx GROUP BY t_us, source_account, destination_account, payment_type)""")
def _(spark: SparkSession, sf_dir: str):
    key = ("t_us", "source_account", "destination_account", "payment_type")
    return contract.duplicates(views.tx_lineitem(spark, sf_dir, numbered=False), key, views.table(spark, sf_dir, "lineitem").count())


@query("e5_capabilities", f"""WITH {EV} SELECT 'labels' AS capability, max(is_laundering) = 1 AS present, 1.0::DOUBLE AS coverage FROM tx
  UNION ALL SELECT 'scenarios', count(scenario_id) > 0, round(count(scenario_id) / count(*), 6) FROM tx
  UNION ALL SELECT 'typology', count(pattern_type) > 0, round(count(pattern_type) / count(*), 6) FROM tx
  UNION ALL SELECT 'cross_currency', count(DISTINCT currency) > 1, round(count(currency) / count(*), 6) FROM tx
  UNION ALL SELECT 'payment_type', count(DISTINCT payment_type) > 1, round(count(payment_type) / count(*), 6) FROM tx
  UNION ALL SELECT 'self_transfers', count(*) FILTER (source_account = destination_account) > 0, round(count(source_account) / count(*), 6) FROM tx""")
def _(tx):
    return contract.capabilities(tx).withColumn("coverage", F.round("coverage", 6))


def _patterns(tx: DataFrame) -> DataFrame:
    """Pattern rows as an annotation file would give them: each annotated transfer, some claimed twice."""
    own = tx.filter("scenario_id IS NOT NULL").select(*C.NATURAL_KEY, "scenario_id", "pattern_type", "row_pos")
    twice = own.filter("row_pos % 4 = 0").withColumn("scenario_id", F.lit("SC999999"))
    lost = own.filter("row_pos % 5 = 0").withColumn("cents", F.lit(-1).cast("long"))
    return own.union(twice).union(lost).drop("row_pos")


_PATTERNS = f"""own AS (SELECT {_KEY}, scenario_id, pattern_type, row_pos FROM tx WHERE scenario_id IS NOT NULL),
pat AS (SELECT * EXCLUDE row_pos FROM own UNION ALL SELECT {_KEY}, 'SC999999', pattern_type FROM own WHERE row_pos % 4 = 0
  UNION ALL SELECT t_us, source_account, destination_account, -1, currency, payment_type, scenario_id, pattern_type FROM own WHERE row_pos % 5 = 0)"""


@query("d1_pattern_attach", f"""WITH {EV}, {_PATTERNS}, k AS (SELECT {_KEY}, count(DISTINCT scenario_id || '/' || pattern_type) AS n,
  min(scenario_id) AS s, min(pattern_type) AS p FROM pat GROUP BY ALL)
SELECT transaction_id, CASE WHEN n = 1 THEN s END AS scenario_id, CASE WHEN n = 1 THEN p END AS pattern_type, coalesce(n > 1, FALSE) AS ambiguous
FROM tx LEFT JOIN k USING ({_KEY})""")
def _(tx):
    return contract.attach_patterns(tx, _patterns(tx)).select("transaction_id", "scenario_id", "pattern_type", "ambiguous")


@query("d2_unmatched_patterns", f"WITH {EV}, {_PATTERNS} SELECT * FROM pat p WHERE NOT EXISTS (SELECT 1 FROM tx WHERE " + " AND ".join(f"tx.{k} = p.{k}" for k in C.NATURAL_KEY) + ")")
def _(tx):
    return contract.unmatched_patterns(tx, _patterns(tx))


@query("d3_orphan_endpoints", f"""WITH {LI} SELECT DISTINCT a AS account_id FROM (SELECT source_account AS a FROM tx UNION ALL
  SELECT destination_account FROM tx) WHERE a NOT IN (SELECT concat('C', c_custkey) FROM customer WHERE c_custkey % 10 > 0
  UNION ALL SELECT concat('S', s_suppkey) FROM supplier WHERE s_suppkey % 10 > 0)""")
def _(spark: SparkSession, sf_dir: str):
    known = views.accounts(spark, sf_dir).filter("account_id NOT LIKE '%0'")
    return contract.orphan_accounts(views.tx_lineitem(spark, sf_dir, numbered=False), known)


@query("a12_varying_columns", """SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount',
  'l_tax', 'fixed']) AS "column", unnest([max(l_orderkey) > min(l_orderkey), max(l_partkey) > min(l_partkey), max(l_suppkey) > min(l_suppkey),
  max(l_linenumber) > min(l_linenumber), max(l_quantity) > min(l_quantity), max(l_extendedprice) > min(l_extendedprice),
  max(l_discount) > min(l_discount), max(l_tax) > min(l_tax), FALSE]) AS varies FROM lineitem""")
def _(spark: SparkSession, sf_dir: str):
    return contract.varying_columns(views.table(spark, sf_dir, "lineitem").withColumn("fixed", F.lit(1)))


@query("a17_stride_sample", f"WITH {EV} SELECT transaction_id, t_us, cents FROM tx WHERE row_pos % 50 = 0")
def _(tx):
    return tx.filter("row_pos % 50 = 0").select("transaction_id", "t_us", "cents")


@query("a17_head_sample", f"WITH {EV} SELECT transaction_id, t_us FROM tx ORDER BY row_pos LIMIT 100")
def _(tx):
    return tx.orderBy("row_pos").limit(100).select("transaction_id", "t_us")


@query("a20_time_slice", f"WITH {EV}, b AS (SELECT min(t_us) AS lo FROM tx) SELECT transaction_id FROM tx, b WHERE t_us >= lo + 86400000000 AND t_us < lo + 3 * 86400000000")
def _(tx):
    low = tx.agg(F.min("t_us")).first()[0]
    return tx.filter((F.col("t_us") >= low + C.DAY_US) & (F.col("t_us") < low + 3 * C.DAY_US)).select("transaction_id")


@query("c20_account_partition", f"""WITH {EV} SELECT a AS account, CAST(concat('0x', substr(md5(a), 1, 8)) AS BIGINT) % 100 < 30 AS held_out
  FROM (SELECT DISTINCT source_account AS a FROM tx UNION SELECT destination_account FROM tx)""")
def _(tx):
    ends = tx.select(F.explode(F.array("source_account", "destination_account")).alias("account")).distinct()
    return ends.select("account", C.in_account_holdout("account").alias("held_out"))


@query("c18_natural_key_text", f"""WITH {EV} SELECT transaction_id, concat_ws('|', t_us, source_account, destination_account, cents, currency, payment_type) AS natural_key,
  strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%SZ') AS at, substr(sha256(transaction_id), 1, 16) AS hash FROM tx""")
def _(tx):
    return tx.select("transaction_id", F.concat_ws("|", *[F.col(k).cast("string") for k in C.NATURAL_KEY]).alias("natural_key"),
                     C.iso().alias("at"), F.substring(F.sha2("transaction_id", 256), 1, 16).alias("hash"))


# --- rows ----------------------------------------------------------------------------------------


@query("c3_tx_features", f"""WITH {EV} SELECT transaction_id, round(ln(1 + greatest(amount, 0)), 6) AS tx_amount_log,
  CASE WHEN amount % 1000 = 0 THEN 1 ELSE 0 END AS tx_amount_is_round_1k, CASE WHEN amount % 100 = 0 THEN 1 ELSE 0 END AS tx_amount_is_round_100,
  CAST(round_even((amount % 1) * 100, 0) AS SMALLINT) AS tx_amount_decimals, CAST(hour(make_timestamp(t_us)) AS INT) AS tx_hour,
  CAST(hour(make_timestamp(t_us)) * 60 + minute(make_timestamp(t_us)) AS INT) AS tx_minute_of_day, is_self_transfer AS tx_is_self_transfer,
  round(ln(1 + greatest(amount_received, 0)), 6) AS tx_amount_received_log,
  round(least(greatest(CASE WHEN amount > 0 THEN amount_received / amount ELSE 1 END, 0), 1e6), 6) AS tx_amount_ratio,
  CASE WHEN currency IS DISTINCT FROM currency_received THEN 1 ELSE 0 END AS tx_is_cross_currency, payment_type AS tx_payment_type FROM tx""")
def _(tx):
    f = C.row_features(contract.feature_view(tx))
    return f.withColumns({c: F.round(c, 6) for c in ("tx_amount_log", "tx_amount_received_log", "tx_amount_ratio")})


@query("c11_categorical_codes", f"""WITH {split_bounds(EV)}, v AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (
  SELECT DISTINCT payment_type AS v FROM tx, b WHERE t_us <= b1 AND payment_type <> 'signup'))
SELECT transaction_id, coalesce(code, -1) AS payment_type_code FROM tx LEFT JOIN v ON v = payment_type""")
def _(tx):
    # one type is left out of the train part, so that the code of an unseen one is met
    train = splits.chronological_split(tx).filter("split = 'train' AND payment_type <> 'signup'")
    return C.category_codes(train, tx, "payment_type").select("transaction_id", "payment_type_code")


@query("c13_rules_fired", f"WITH {SCORED} SELECT transaction_id, large_amount, very_large_amount, cross_currency, round_amount, odd_hour, non_self_transfer FROM scored")
def _(tx):
    q = quantiles(tx, {"amount": [0.99, 0.999]})["amount"] or [0.0, 0.0]
    rules = C.rule_columns(tx.columns, *q)
    return tx.select("transaction_id", *[c.alias(n) for n, c in rules.items()])


@query("j1_rule_score", f"WITH {SCORED} SELECT transaction_id, round(score, 6) AS score FROM scored")
def _(tx):
    return with_score(tx).select("transaction_id", F.round("score", 6).alias("score"))


@query("e9_rule_thresholds", f"WITH {EV} SELECT round(quantile_cont(amount, 0.99), 6) AS q99, round(quantile_cont(amount, 0.999), 6) AS q999 FROM tx")
def _(tx):
    q = quantiles(tx, {"amount": [0.99, 0.999]})["amount"] or [None, None]
    return tx.sparkSession.createDataFrame([(q[0], q[1])], "q99 double, q999 double").select(F.round("q99", 6).alias("q99"), F.round("q999", 6).alias("q999"))


@query("c27_bands", f"""WITH {EV}, d AS (SELECT source_account AS account, count(DISTINCT destination_account) AS degree FROM tx GROUP BY 1)
SELECT account, degree, CAST(list_count(list_filter([0, 1, 2, 4, 8, 16, 32, 64, 128, 256], lambda e: CASE WHEN degree >= e THEN TRUE END)) AS INT) AS bucket FROM d""")
def _(tx):
    d = tx.groupBy(F.col("source_account").alias("account")).agg(F.count_distinct("destination_account").alias("degree"))
    return d.withColumn("bucket", C.degree_bucket("degree"))


def _labels_sql(columns: tuple[str, ...] = ("amount",)) -> str:
    """The pattern columns and their labels, made from bins and frames."""
    of = ", ".join(f"('{c}')" for c in columns)
    return f"""WITH size_of(name, text, top) AS (VALUES ('fan_in', 'distinct senders into the receiver', 30), ('fan_out', 'distinct receivers from the sender', 30),
  ('degree_in', 'transfers into the receiver', 30), ('degree_out', 'transfers out of the sender', 30), ('scatter_gather', 'scatter-gather patterns by intermediaries', 30),
  ('temporal_cycle', 'cycles in time order by length', 30), ('lc_cycle', 'simple cycles by length', 10)),
bins AS (SELECT name, text, top, unnest(range(2, top + 1)) AS b FROM size_of),
frames AS (SELECT e, w FROM (VALUES ('sender'), ('receiver')) x(e), (VALUES ('outgoing'), ('incoming')) y(w)),
moments AS (SELECT s, m FROM (VALUES {of}) x(s), (VALUES ('mean'), ('sum'), ('variance'), ('skew'), ('kurtosis')) y(m)),
c AS (SELECT concat('pat_', name, '_', b) AS "column", concat(text, ': ', b, CASE WHEN b = top THEN ' or more' ELSE '' END) AS label FROM bins
  UNION ALL SELECT concat('pat_', e, '_', w, '_counterparties'), concat(e, ': distinct ', w, ' counterparties') FROM frames
  UNION ALL SELECT concat('pat_', e, '_', w, '_count'), concat(e, ': ', w, ' transfers') FROM frames
  UNION ALL SELECT concat('pat_', e, '_', w, '_ratio'), concat(e, ': ', w, ' fan/degree ratio') FROM frames
  UNION ALL SELECT concat('pat_', e, '_', w, '_', s, '_', m), concat(e, ': ', m, ' of ', w, ' ', s) FROM frames, moments)
SELECT "column", label FROM c"""


# --- history -------------------------------------------------------------------------------------


def _within(a: str, b: str, lo: str) -> str:
    return f"(SELECT count(*) FROM tx p WHERE p.{a} = tx.{b} AND p.t_us < tx.t_us AND p.t_us >= tx.t_us - {lo})"


_DAY, _HOUR = "86400000000", "3600000000"
S, D = "source_account", "destination_account"


def _behaviour_sql(cte: str) -> str:
    cents = lambda a, b: _within(a, b, _DAY).replace("count(*)", "coalesce(sum(p.cents), 0)")
    return f"""WITH {cte}, f AS (SELECT row_pos, cents, {_within(S, S, _HOUR)} AS bh_src_out_n_1h, {_within(S, S, _DAY)} AS bh_src_out_n_24h,
  CAST({cents(S, S)} AS BIGINT) AS bh_src_out_cents_24h, {_within(D, S, _DAY)} AS bh_src_in_n_24h, {cents(D, S)} AS in_cents,
  {_within(D, D, _DAY)} AS bh_dst_in_n_24h, {_within(S, D, _DAY)} AS bh_dst_out_n_24h,
  (t_us - (SELECT max(p.t_us) FROM tx p WHERE p.{S} = tx.{S} AND p.t_us < tx.t_us)) / 1000000 AS bh_src_secs_since_out,
  (SELECT count(*) FROM tx p WHERE p.{S} = tx.{S} AND p.{D} = tx.{D} AND p.t_us < tx.t_us) AS bh_pair_n_prior,
  (SELECT count(*) FROM tx p WHERE p.{S} = tx.{D} AND p.{D} = tx.{S} AND p.t_us < tx.t_us) AS bh_reverse_pair_n_prior FROM tx)
SELECT * EXCLUDE (cents, in_cents) REPLACE (round(bh_src_secs_since_out, 6) AS bh_src_secs_since_out),
  CASE WHEN in_cents > 0 THEN round(cents / in_cents, 6) END AS bh_src_passthrough_24h FROM f"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("bh_src_passthrough_24h", "bh_src_secs_since_out")})


@query("f_behaviour", _behaviour_sql(EV))
def _(tx):
    return _rounded(history.behaviour(contract.feature_view(tx)))


@query("f_behaviour_ties", _behaviour_sql(LI))
def _(spark: SparkSession, sf_dir: str):
    return _rounded(history.behaviour(views.written_lineitem(spark, sf_dir)))


@query("f11_graph_lite", f"""WITH {EV}, s AS (SELECT row_pos, {_within(S, S, '172800000000')} AS gl_src_out_n, {_within(D, S, '172800000000')} AS gl_src_in_n,
  {_within(S, D, '172800000000')} AS gl_dst_out_n, {_within(D, D, '172800000000')} AS gl_dst_in_n,
  CAST({_within(S, S, '172800000000').replace('count(*)', 'coalesce(sum(p.cents), 0)')} AS BIGINT) AS gl_src_out_cents,
  CAST({_within(D, D, '172800000000').replace('count(*)', 'coalesce(sum(p.cents), 0)')} AS BIGINT) AS gl_dst_in_cents FROM tx) SELECT * FROM s""")
def _(tx):
    return history.graph_lite(tx)


@query("d12_asof_prev_out", f"""WITH {LI} SELECT row_pos, p.t_us AS prev_t_us, p.last AS prev_row_pos FROM tx
  ASOF LEFT JOIN (SELECT source_account, t_us, max(row_pos) AS last FROM tx GROUP BY ALL) p
  ON tx.source_account = p.source_account AND tx.t_us > p.t_us""")
def _(spark: SparkSession, sf_dir: str):
    return history.previous_out(views.tx_lineitem(spark, sf_dir))


@query("c15_emit_window", f"""WITH {EV}, b AS (SELECT quantile_disc(t_us, 0.5) AS mid FROM tx),
 f AS (SELECT row_pos, t_us, {_within(S, S, _DAY)} AS n FROM tx) SELECT row_pos, n FROM f, b WHERE t_us >= mid""")
def _(tx):
    mid = tx.agg(F.percentile_disc("t_us", 0.5) if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY t_us)")).first()[0]
    f = history.behaviour(tx).join(tx.select("row_pos", "t_us"), "row_pos")
    return history.emit(f, int(mid), None).select("row_pos", F.col("bh_src_out_n_24h").alias("n"))
