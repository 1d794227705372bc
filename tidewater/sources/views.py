"""Canonical transaction views projected from the driver tables, and the same projection as DuckDB CTEs.

Columns: row_pos, transaction_id, t_us (UTC microseconds), source_account, destination_account, amount, cents,
currency, is_laundering, payment_type, scenario_id, pattern_type, amount_received, currency_received,
is_self_transfer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut, global_position, more_partitions

#: The typology names of annotated positives, and the currencies of the projected view.
TYPOLOGIES = ("FAN_OUT", "FAN_IN", "CYCLE", "GATHER_SCATTER", "SCATTER_GATHER", "STACK", "RANDOM", "BIPARTITE")
CURRENCIES = ("US Dollar", "Euro", "Yuan", "Yen", "Rupee")

COLUMNS = (
    "row_pos transaction_id t_us source_account destination_account amount cents currency is_laundering payment_type "
    "scenario_id pattern_type amount_received currency_received is_self_transfer"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(values: tuple[str, ...], index: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(index) + 1).cast("int"))


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: unique microsecond times, a multigraph with cycles and self-transfers."""
    e = table(spark, sf_dir, "events").withColumn("id", F.col("event_id"))
    switched = F.expr("id % 7 = 0")
    return e.select(
        F.col("id").alias("row_pos"),
        F.format_string("TX%010d", "id").alias("transaction_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("source_account"),
        F.concat(F.lit("A"), F.get_json_object("props", "$.k")).alias("destination_account"),
        F.col("value").alias("amount"),
        F.rint(F.col("value") * 100).cast("long").alias("cents"),
        _literal(CURRENCIES, "id % 5").alias("currency"),
        F.expr("if(id % 250 < 5, 1, 0)").alias("is_laundering"),
        F.col("event_type").alias("payment_type"),
        F.when(F.expr("id % 500 < 5"), F.format_string("SC%06d", F.expr("id div 500"))).alias("scenario_id"),
        F.when(F.expr("id % 500 < 5"), _literal(TYPOLOGIES, "(id div 500) % 8")).alias("pattern_type"),
        F.when(switched, F.col("value") * 2).otherwise(F.col("value")).alias("amount_received"),
        F.when(switched, _literal(CURRENCIES, "(id + 1) % 5")).otherwise(_literal(CURRENCIES, "id % 5")).alias("currency_received"),
        F.expr("if(cast(user_id as string) = get_json_object(props, '$.k'), 1, 0)").alias("is_self_transfer"),
    )


def _sql_literal(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} AS INT) + 1]"


EVENTS_CTE = f"""tx AS (
  SELECT event_id AS row_pos, printf('TX%010d', event_id) AS transaction_id, epoch_us(ts) AS t_us,
    concat('A', user_id) AS source_account, concat('A', json_extract_string(props, '$.k')) AS destination_account,
    value AS amount, CAST(round_even(value * 100, 0) AS BIGINT) AS cents, {_sql_literal(CURRENCIES, "event_id % 5")} AS currency,
    CASE WHEN event_id % 250 < 5 THEN 1 ELSE 0 END AS is_laundering, event_type AS payment_type,
    CASE WHEN event_id % 500 < 5 THEN printf('SC%06d', event_id // 500) END AS scenario_id,
    CASE WHEN event_id % 500 < 5 THEN {_sql_literal(TYPOLOGIES, "(event_id // 500) % 8")} END AS pattern_type,
    CASE WHEN event_id % 7 = 0 THEN value * 2 ELSE value END AS amount_received,
    CASE WHEN event_id % 7 = 0 THEN {_sql_literal(CURRENCIES, "(event_id + 1) % 5")} ELSE {_sql_literal(CURRENCIES, "event_id % 5")} END
      AS currency_received,
    CASE WHEN CAST(user_id AS VARCHAR) = json_extract_string(props, '$.k') THEN 1 ELSE 0 END AS is_self_transfer
  FROM events)"""


def tx_lineitem(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """One row a line item: day-resolution times with heavy ties, bipartite, no natural unique key.

    `row_pos` is a position under a total order of all line columns, made by a range sort and two passes of
    counts rather than by one window over everything. Not `numbered`, the view goes without it and `transaction_id`, and
    nothing is sorted.
    """
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    used = ["l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount"]
    rows = line.count()  # the files' own figures
    if numbered:
        line = global_position(line, [(c, True) for c in sorted(line.columns)], "row_pos", used, dealt_by=3, rows=rows)
    if more := more_partitions(spark, rows):
        line = line.repartition(*more, "l_orderkey")
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        *(["row_pos", F.format_string("TX%010d", "row_pos").alias("transaction_id")] if numbered else []),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t_us"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source_account"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("destination_account"),
        F.col("l_extendedprice").alias("amount"),
        F.rint(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("o_orderpriority").alias("payment_type"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_received"),
    )


LINEITEM_CTE = """tx AS (
  SELECT row_pos, printf('TX%010d', row_pos) AS transaction_id, epoch_us(l_shipdate) AS t_us,
    concat('C', o_custkey) AS source_account, concat('S', l_suppkey) AS destination_account, l_extendedprice AS amount,
    CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS cents, o_orderpriority AS payment_type,
    l_extendedprice * (1 - l_discount) AS amount_received
  FROM (SELECT *, row_number() OVER (ORDER BY l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey,
      l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) - 1 AS row_pos FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey)"""


def written_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What histories and graphs read of `tx_lineitem`, written once: they read it several times, and each would join the orders again."""
    return cut(tx_lineitem(spark, sf_dir).select("row_pos", "t_us", "cents", "source_account", "destination_account"), "line-transfers")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account dimension: customers and suppliers."""
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("account_id"), F.col("c_nationkey").cast("long").alias("bank_id")
    )
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("account_id"), F.col("s_nationkey").cast("long").alias("bank_id")
    )
    return c.union(s)
