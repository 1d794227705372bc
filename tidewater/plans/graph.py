"""Queries over windowed subgraphs and fund traces, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import columns as C
from tidewater.functions.columns import DAY_US, HOUR_US
from tidewater.operators import graph, patterns, splits
from tidewater.operators.trace import TraceLimits, trace
from tidewater.plans.data import ORACLES, _labels_sql, query, split_bounds
from tidewater.sources import views
from tidewater.sources.views import EVENTS_CTE as EV
from tidewater.sources.views import LINEITEM_CTE as LI

E = "e AS (SELECT row_pos, t_us, cents, source_account AS src, destination_account AS dst FROM tx WHERE source_account <> destination_account)"
_SEEN = "(p.t_us < e.t_us OR (p.t_us = e.t_us AND p.row_pos <= e.row_pos)) AND p.t_us >= e.t_us - {w}"


def _agg(what: str, where: str, width: int = DAY_US) -> str:
    return f"(SELECT {what} FROM e p WHERE {where} AND {_SEEN.format(w=width)})"


def _fan_sql(cte: str) -> str:
    return f"""WITH {cte}, {E} SELECT row_pos, {_agg('count(DISTINCT p.src)', 'p.dst = e.dst')} AS fan_in,
  {_agg('count(DISTINCT p.dst)', 'p.src = e.src')} AS fan_out, {_agg('count(*)', 'p.dst = e.dst')} AS degree_in,
  {_agg('count(*)', 'p.src = e.src')} AS degree_out FROM e"""


@query("h1_fan_degree", _fan_sql(EV))
def _(tx):
    return graph.fan_degree(tx)


@query("h2_fan_degree_ties", _fan_sql(LI))
def _(spark: SparkSession, sf_dir: str):
    return graph.fan_degree(views.written_lineitem(spark, sf_dir))


@query("h3_fan_histogram", f"""WITH f AS ({_fan_sql(EV)}) SELECT row_pos, """ + ", ".join(f"CASE WHEN fan_in = {b} THEN 1 ELSE 0 END AS pat_fan_in_{b}" for b in range(2, 30)) + ", CASE WHEN fan_in >= 30 THEN 1 ELSE 0 END AS pat_fan_in_30 FROM f")
def _(tx):
    return graph.histogram(graph.fan_degree(tx), "fan_in")


def _stats_sql() -> str:
    parts, final = [], []
    for name, v in (("src", "src"), ("dst", "dst")):
        for role, own, other in (("out", "src", "dst"), ("in", "dst", "src")):
            p = f"{name}_{role}"
            parts.append(f"""{p} AS (SELECT e.row_pos, count(p.row_pos) AS n, count(DISTINCT p.{other}) AS cp,
  {', '.join(f"CAST(coalesce(sum({' * '.join(['CAST(p.cents AS HUGEINT)'] * k)}), 0) AS DOUBLE) AS s{k}" for k in range(1, 5))}
  FROM e LEFT JOIN e p ON p.{own} = e.{v} AND {_SEEN.format(w=DAY_US)} GROUP BY e.row_pos)""")
            n = f"nullif({p}.n, 0)"
            mean = f"({p}.s1 / {n})"
            var = f"({p}.s2 / {n} - {mean} * {mean})"
            spread = f"(CASE WHEN {p}.n > 1 AND {var} > 0.5 THEN {var} END)"
            m3 = f"({p}.s3 / {n} - 3 * {mean} * {p}.s2 / {n} + 2 * {mean} * {mean} * {mean})"
            m4 = f"({p}.s4 / {n} - 4 * {mean} * {p}.s3 / {n} + 6 * {mean} * {mean} * {p}.s2 / {n} - 3 * {mean} * {mean} * {mean} * {mean})"
            final.append(f"""{p}.cp AS {p}_cp, {p}.n AS {p}_n, round({p}.cp / {n}, 6) AS {p}_ratio, round({mean} / 100 + 1e-9, 4) AS {p}_mean, round({p}.s1 / 100, 4) AS {p}_sum,
  CASE WHEN {p}.n > 0 THEN round(greatest({var}, 0) / 10000 + 1e-9, 4) END AS {p}_variance, round({m3} / pow({spread}, 1.5), 4) AS {p}_skew,
  round({m4} / ({spread} * {spread}) - 3, 4) AS {p}_kurtosis""")
    return f"WITH {EV}, {E}, {', '.join(parts)} SELECT src_out.row_pos, {', '.join(final)} FROM src_out JOIN src_in USING (row_pos) JOIN dst_out USING (row_pos) JOIN dst_in USING (row_pos)"


def _bins_sql(inner: str, size: str, top: int) -> str:
    bins = [f"CASE WHEN {size} = {b} THEN 1 ELSE 0 END AS pat_{size}_{b}" for b in range(2, top)]
    return f"WITH f AS ({inner}) SELECT row_pos, {', '.join(bins)}, CASE WHEN {size} >= {top} THEN 1 ELSE 0 END AS pat_{size}_{top} FROM f"


def _add_histogram(size: str) -> None:
    @query(f"h3_{size}_histogram", _bins_sql(_fan_sql(EV), size, 30))
    def _(tx):
        return graph.histogram(graph.fan_degree(tx), size)


for _size in ("fan_out", "degree_in", "degree_out"):
    _add_histogram(_size)


def _order_sql(value: str, scale: int) -> str:
    parts, final = [], []
    for name, v in (("src", "src"), ("dst", "dst")):
        for role, own in (("out", "src"), ("in", "dst")):
            p = f"{name}_{role}"
            parts.append(f"""{p} AS (SELECT e.row_pos, min(p.v) AS lo, max(p.v) AS hi, median(p.v) AS mid, CAST(sum(p.v) AS DOUBLE) / nullif(count(p.v), 0) AS mean
  FROM e LEFT JOIN (SELECT *, {value} AS v FROM e) p ON p.{own} = e.{v} AND {_SEEN.format(w=DAY_US)} GROUP BY e.row_pos)""")
            final += [f"round(CAST({p}.{c} AS DOUBLE) / {scale} + 1e-9, 3) AS {p}_{s}" for c, s in (("lo", "min"), ("hi", "max"), ("mid", "median"), ("mean", "mean"))]
    return f"WITH {EV}, {E}, {', '.join(parts)} SELECT src_out.row_pos, {', '.join(final)} FROM src_out JOIN src_in USING (row_pos) JOIN dst_out USING (row_pos) JOIN dst_in USING (row_pos)"


def _scaled(df: DataFrame, scale: int) -> DataFrame:
    # exact ties at the last digit are lifted, as engines round them differently
    return df.select("row_pos", *[F.round(F.col(c) / scale + 1e-9, 3).alias(c) for c in df.columns if c != "row_pos"])


@query("h7_vertex_order_stats", _order_sql("cents", 100))
def _(tx):
    return _scaled(graph.order_statistics(tx), 100)


@query("h8_timestamp_stats", _order_sql("t_us // 1000000", 1))
def _(tx):
    return _scaled(graph.timestamp_statistics(tx), 1)


@query("h7_vertex_stats", _stats_sql())
def _(tx):
    s = graph.vertex_statistics(tx)
    # exact ties at the last digit are lifted, as engines round them differently
    nudge = lambda c: F.col(c) + (1e-9 if c.endswith(("mean", "variance")) else 0.0)
    return s.withColumns({c: F.round(nudge(c), 6 if c.endswith("ratio") else 4) for c in s.columns if c.endswith(("ratio", "mean", "sum", "variance", "skew", "kurtosis"))})


def _cycles_sql(when: str, more: str = "") -> str:
    """Paths grown backwards from every edge, over edges of the day before it, until they close or die."""
    return f"""WITH RECURSIVE {EV}, {E}, p AS (SELECT row_pos, t_us AS t0, dst AS goal, src AS head, t_us AS last_t, [src, dst] AS seen, 1 AS length FROM e
UNION ALL SELECT p.row_pos, p.t0, p.goal, h.src, h.t_us, list_append(p.seen, h.src), p.length + 1 FROM p JOIN e h ON h.dst = p.head AND {when} AND h.t_us >= p.t0 - {DAY_US}
  WHERE p.head <> p.goal {more} AND (h.src = p.goal OR NOT list_contains(p.seen, h.src)))
SELECT row_pos, length, count(*) AS n FROM p WHERE head = goal GROUP BY row_pos, length"""


@query("h5_temporal_cycle", _cycles_sql("h.t_us < p.last_t"))
def _(tx):
    return graph.cycles(tx, DAY_US, None, ordered=True)


@query("h6_lc_cycle", _cycles_sql("(h.t_us < p.t0 OR (h.t_us = p.t0 AND h.row_pos < p.row_pos))", "AND p.length < 10"))
def _(tx):
    return graph.cycles(tx, DAY_US, 10, ordered=False)


_W6 = 6 * HOUR_US


@query("h4_scatter_gather", f"""WITH {EV}, {E}, roots AS (SELECT DISTINCT c.row_pos, c.t_us, c.src AS mid, c.dst AS w, s.src AS u FROM e c JOIN e s ON s.dst = c.src
  WHERE (s.t_us < c.t_us OR (s.t_us = c.t_us AND s.row_pos < c.row_pos)) AND s.t_us >= c.t_us - {_W6} AND s.src <> c.dst),
mids AS (SELECT r.row_pos, r.u, count(DISTINCT g.src) + 1 AS size FROM roots r JOIN e g ON g.dst = r.w JOIN e s ON s.src = r.u AND s.dst = g.src
  WHERE (g.t_us < r.t_us OR (g.t_us = r.t_us AND g.row_pos < r.row_pos)) AND g.t_us >= r.t_us - {_W6} AND g.src <> r.u AND g.src <> r.mid
  AND s.t_us <= g.t_us AND s.t_us >= r.t_us - {_W6} GROUP BY ALL)
SELECT row_pos, size, count(*) AS n FROM mids GROUP BY ALL""")
def _(tx):
    return graph.scatter_gather(tx)


def _block_sql() -> str:
    """Every column's label, and how often and how much the transfers have of it; statistics are counted only."""
    sized = " UNION ALL ".join(f"SELECT '{c}' AS family, row_pos, {c} AS size, 1 AS n FROM f" for c in ("fan_in", "fan_out", "degree_in", "degree_out"))
    ends = [(p, w, f"{e}_{r}") for e, p in (("src", "sender"), ("dst", "receiver")) for r, w in (("out", "outgoing"), ("in", "incoming"))]
    stats = [(f"pat_{p}_{w}_{n}", f"{c}_{m}") for p, w, c in ends for n, m in (("counterparties", "cp"), ("count", "n"), ("ratio", "ratio"))]
    stats += [(f"pat_{p}_{w}_amount_{m}", f"{c}_{m}") for p, w, c in ends for m in ("mean", "sum", "variance", "skew", "kurtosis")]
    counted = ", ".join(f"count({c}) AS \"{n}\"" for n, c in stats)
    return f"""WITH labels AS ({_labels_sql()}), f AS ({_fan_sql(EV)}), sg AS ({ORACLES['h4_scatter_gather']}), tc AS ({ORACLES['h5_temporal_cycle']}), lc AS ({ORACLES['h6_lc_cycle']}),
sizes AS ({sized} UNION ALL SELECT 'scatter_gather', row_pos, size, n FROM sg UNION ALL SELECT 'temporal_cycle', row_pos, length, n FROM tc UNION ALL SELECT 'lc_cycle', row_pos, length, n FROM lc),
binned AS (SELECT concat('pat_', family, '_', least(size, CASE family WHEN 'lc_cycle' THEN 10 ELSE 30 END)) AS "column", count(DISTINCT row_pos) AS rows, CAST(sum(n) AS BIGINT) AS total FROM sizes WHERE size >= 2 GROUP BY 1),
s AS (SELECT {counted} FROM ({_stats_sql()})), stats AS (UNPIVOT s ON * INTO NAME "column" VALUE rows)
SELECT "column", label, coalesce(b.rows, t.rows, 0) AS rows, coalesce(b.total, 0) AS total FROM labels LEFT JOIN binned b USING ("column") LEFT JOIN stats t USING ("column")"""


@query("d4_pattern_block", _block_sql())
def _(tx):
    params = patterns.PatternParams(window=DAY_US, statistics=DAY_US, scatter_gather=_W6)
    block = patterns.pattern_block(tx, params)
    labels = C.pattern_columns()
    binned = [c for c, _ in labels[:183]]
    each = [F.struct(F.lit(c).alias("column"), F.lit(label).alias("label"), F.count_if(F.col(c) > 0).alias("rows"), F.sum(c).cast("long").alias("total")) if c in binned
            else F.struct(F.lit(c).alias("column"), F.lit(label).alias("label"), F.count(c).alias("rows"), F.lit(0).cast("long").alias("total")) for c, label in labels]
    return block.agg(F.array(*each).alias("a")).select(F.explode("a").alias("a")).select("a.*")


# --- traces ------------------------------------------------------------------------------------------

CAP = 16


def _seeds(tx):
    """The ten accounts with the most transfers out, without an anchor."""
    top = tx.groupBy("source_account").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_account").limit(10)
    return top.select(F.col("source_account").alias("seed"), F.lit(None).cast("long").alias("at_us"))


def _trace_sql(ahead: bool, tail: str, horizon: int = 3, gap: int = 2 * DAY_US) -> str:
    near, far, up = ("src", "dst", "ASC") if ahead else ("dst", "src", "DESC")
    parts = [f"""seeds AS (SELECT source_account AS seed FROM tx GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
a AS (SELECT row_pos, t_us, cents, source_account AS src, destination_account AS dst FROM tx),
f0 AS (SELECT seed, seed AS vertex, {'-' if ahead else ''}(1::BIGINT << 62) AS arrival, TRUE AS free FROM seeds)"""]
    for d in range(1, horizon + 1):
        cond = f"a.t_us {'>=' if ahead else '<='} f.arrival AND (f.free OR {'a.t_us - f.arrival' if ahead else 'f.arrival - a.t_us'} <= {gap})"
        parts.append(f"""x{d} AS (SELECT f.seed, f.vertex, f.arrival, a.*, row_number() OVER (PARTITION BY seed, vertex ORDER BY a.t_us {up}, row_pos) AS rk
  FROM f{d - 1} f JOIN a ON a.{near} = f.vertex WHERE {cond}), h{d} AS (SELECT *, {d} AS depth FROM x{d} WHERE rk <= {CAP}),
f{d} AS (SELECT seed, {far} AS vertex, {'min' if ahead else 'max'}(t_us) AS arrival, FALSE AS free FROM h{d} GROUP BY 1, 2)""")
    every = " UNION ALL ".join(f"SELECT seed, vertex, arrival, row_pos, t_us, cents, src, dst, depth FROM h{d}" for d in range(1, horizon + 1))
    parts.append(f"""firsts AS (SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY seed, row_pos ORDER BY depth, arrival, vertex) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, arrival, vertex, t_us, row_pos) AS place FROM firsts),
kept AS (SELECT seed, row_pos, t_us, cents, src, dst, depth FROM placed WHERE place <= 200)""")
    return f"WITH {EV}, {', '.join(parts)} {tail}"


def _trace(tx, direction: str):
    return trace(tx, _seeds(tx), direction, 3, TraceLimits(CAP, 200, 2 * DAY_US))


_CAPPED = " UNION ALL ".join(f"SELECT seed, vertex FROM x{d} WHERE rk > {CAP}" for d in range(1, 4))


@query("h12_trace_forward", _trace_sql(True, "SELECT seed, row_pos, depth FROM kept"))
def _(tx):
    return _trace(tx, "forward").edges.select("seed", "row_pos", "depth")


@query("h12_trace_backward", _trace_sql(False, "SELECT seed, row_pos, depth FROM kept"))
def _(tx):
    return _trace(tx, "backward").edges.select("seed", "row_pos", "depth")


@query("h15_terminals", _trace_sql(True, "SELECT DISTINCT seed, dst AS account FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.seed = k.seed AND o.src = k.dst)"))
def _(tx):
    return _trace(tx, "forward").terminals.select("seed", "account")


@query("h16_trace_status", _trace_sql(True, f"""SELECT seed, coalesce(max(place) > 200, FALSE) AS exhausted, coalesce(any_value(c.capped), '') AS capped,
  NOT coalesce(max(place) > 200, FALSE) AND coalesce(any_value(c.capped), '') = '' AS complete FROM seeds LEFT JOIN placed USING (seed)
  LEFT JOIN (SELECT seed, string_agg(DISTINCT vertex, ',' ORDER BY vertex) AS capped FROM ({_CAPPED}) GROUP BY seed) c USING (seed) GROUP BY seed"""))
def _(tx):
    return _trace(tx, "forward").status.withColumn("capped", F.array_join("capped", ","))


@query("h17_per_hop", _trace_sql(True, """SELECT seed, depth, count(DISTINCT row_pos) AS n, count(DISTINCT a) AS accounts, CAST(sum(cents) / 2 AS BIGINT) AS cents
  FROM (SELECT *, unnest([src, dst]) AS a FROM kept) GROUP BY ALL"""))
def _(tx):
    return _trace(tx, "forward").per_hop()


# --- structure ------------------------------------------------------------------------------------------


@query("e21_degree_profile", f"""WITH {EV}, d AS (SELECT a, count(*) AS degree FROM (SELECT source_account AS a FROM tx UNION ALL SELECT destination_account FROM tx) GROUP BY a),
hubs AS (SELECT degree FROM d ORDER BY degree DESC LIMIT (SELECT greatest(count(*) // 10000, 1) FROM d)), first5 AS (SELECT degree FROM d ORDER BY degree DESC LIMIT 5)
SELECT count(*) AS vertices, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(avg(degree), 6) AS mean, round(quantile_cont(degree, 0.5), 6) AS p50, round(quantile_cont(degree, 0.99), 6) AS p99,
  round(quantile_cont(degree, 0.999), 6) AS p999, round(quantile_cont(degree, 0.9999), 6) AS p9999, max(degree) AS max_degree,
  (SELECT string_agg(degree, ',' ORDER BY degree DESC) FROM first5) AS top_degrees, round((SELECT sum(degree) FROM hubs) / sum(degree), 6) AS share FROM d""")
def _(tx):
    p = graph.degree_profile(tx)
    return p.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p99", "p999", "p9999", "share")})


_CADENCE = """(SELECT source_account AS account, count(*) AS n, stddev_pop(gap) / nullif(avg(gap), 0) AS variation FROM (SELECT source_account,
  t_us - lag(t_us) OVER (PARTITION BY source_account ORDER BY t_us) AS gap FROM {tx}) GROUP BY 1 HAVING count(*) >= 4 AND avg(gap) <> 0)"""


@query("e22_cadence", f"WITH {EV} SELECT account, n, round(variation, 6) AS variation FROM {_CADENCE.format(tx='tx')}")
def _(tx):
    return graph.cadence(tx).withColumn("variation", F.round("variation", 6))


@query("e27_pair_counts", f"WITH {EV} SELECT source_account, destination_account, count(*) AS n FROM tx GROUP BY ALL")
def _(tx):
    return graph.pair_counts(tx)


@query("d11_reciprocal_pairs", f"""WITH {EV}, p AS (SELECT source_account AS a, destination_account AS b, count(*) AS n FROM tx GROUP BY ALL HAVING count(*) >= 3)
SELECT p.a, p.b, p.n, q.n AS back FROM p JOIN p q ON q.a = p.b AND q.b = p.a""")
def _(tx):
    return graph.reciprocal_pairs(tx)


@query("h18_hard_negatives", f"""WITH {EV}, benign AS (SELECT * FROM tx WHERE is_laundering = 0),
o AS (SELECT source_account AS a, count(DISTINCT destination_account) AS fan, count(*) AS sent FROM benign GROUP BY 1),
i AS (SELECT destination_account AS b, count(DISTINCT source_account) AS fan FROM benign GROUP BY 1),
c AS (SELECT greatest(5, quantile_cont(fan, 0.99)) AS fan_cut, quantile_cont(sent, 0.99) AS vol_cut FROM o), ic AS (SELECT greatest(5, quantile_cont(fan, 0.99)) AS in_cut FROM i),
steady AS (SELECT account FROM {_CADENCE.format(tx='benign')} WHERE variation < 0.5),
p AS (SELECT source_account AS a, destination_account AS b FROM benign GROUP BY ALL HAVING count(*) >= 3), mutual AS (SELECT DISTINCT p.a FROM p JOIN p q ON q.a = p.b AND q.b = p.a),
f AS (SELECT transaction_id, o.fan >= fan_cut AS high_fan_out, i.fan >= in_cut AS high_fan_in, o.sent >= vol_cut AS high_volume,
  o.fan >= fan_cut AND source_account IN (SELECT account FROM steady) AS regular_cadence, source_account IN (SELECT a FROM mutual) AS reciprocal
  FROM benign JOIN o ON o.a = source_account JOIN i ON i.b = destination_account, c, ic)
SELECT * FROM f WHERE high_fan_out OR high_fan_in OR high_volume OR regular_cadence OR reciprocal""")
def _(tx):
    return graph.hard_negatives(tx)


@query("h20_adaptive", f"""WITH {split_bounds(EV)}, tr AS (SELECT tx.* FROM tx, b WHERE t_us <= b1), outs AS (SELECT source_account AS a, count(DISTINCT destination_account) AS od, median(amount) AS own FROM tr GROUP BY 1),
i AS (SELECT destination_account AS b, count(DISTINCT source_account) AS id FROM tr GROUP BY 1), g AS (SELECT median(amount) AS med FROM tr),
bk AS (SELECT *, list_count(list_filter([0, 1, 2, 4, 8, 16, 32, 64, 128, 256], lambda e: CASE WHEN od >= e THEN TRUE END)) AS bucket FROM outs),
peers AS (SELECT bucket, median(amount) AS pm, stddev_samp(amount) AS ps FROM tr JOIN bk ON a = source_account GROUP BY 1),
j AS (SELECT tx.*, outs.a, i.b, coalesce(od, 0) AS od, coalesce(id, 0) AS id, coalesce(own, med) AS med, med AS everyone FROM tx LEFT JOIN outs ON outs.a = source_account LEFT JOIN i ON i.b = destination_account, g),
k AS (SELECT j.*, coalesce(pm, everyone) AS pm, coalesce(ps, 0) AS ps FROM (SELECT *, list_count(list_filter([0, 1, 2, 4, 8, 16, 32, 64, 128, 256], lambda e: CASE WHEN od >= e THEN TRUE END)) AS bucket FROM j) j LEFT JOIN peers USING (bucket))
SELECT transaction_id, round(ln(1 + od), 6) AS adp_out_degree_log, round(ln(1 + id), 6) AS adp_in_degree_log,
  round(CASE WHEN od + id > 0 THEN (od - id) / (od + id) ELSE 0 END, 6) AS adp_degree_asymmetry,
  round(ln(1 + least(greatest(CASE WHEN med > 0 THEN amount / med ELSE 1 END, 0), 1e6)), 6) AS adp_amount_vs_own_median,
  round(ln(1 + least(greatest(CASE WHEN pm > 0 THEN amount / pm ELSE 1 END, 0), 1e6)), 6) AS adp_amount_vs_peer_median,
  round(least(greatest(CASE WHEN ps > 0 THEN (amount - pm) / ps ELSE 0 END, -50), 50), 6) AS adp_amount_peer_z,
  round(ln(1 + CASE WHEN od > 0 THEN amount / od ELSE amount END), 6) AS adp_amount_per_counterparty,
  CASE WHEN a IS NULL THEN 1 ELSE 0 END AS adp_source_unseen, CASE WHEN b IS NULL THEN 1 ELSE 0 END AS adp_dest_unseen FROM k""")
def _(tx):
    train = splits.chronological_split(tx).filter("split = 'train'")
    a = graph.adaptive(train.drop("split"), tx)
    return a.withColumns({c: F.round(c, 6) for c in a.columns if c != "transaction_id" and "unseen" not in c})
