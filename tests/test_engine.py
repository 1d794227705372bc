"""Hand-built graphs and tables with known answers, causality invariants, sources and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import columns as C
from tidewater.operators import cases, contract, graph, history, metrics, model, ranking, splits, typology
from tidewater.operators.trace import TraceError, TraceLimits, trace
from tidewater.plans import catalog, models
from tidewater.session import global_position, global_running
from tidewater.sources import readers, writers
from tidewater.streaming import history as streaming

BASE = 1_767_225_600_000_000  # 2026-01-01
MIN = 60_000_000
TX = (
    "row_pos long, transaction_id string, t_us long, source_account string, destination_account string, amount double, cents long, currency string, "
    "is_laundering int, payment_type string, scenario_id string, pattern_type string, amount_received double, currency_received string, is_self_transfer int"
)


def frame(spark, rows, labels=None, scenarios=None):
    """Rows of (src, dst, minute[, amount])."""
    out = []
    for i, (s, d, m, *a) in enumerate(rows):
        amount = float(a[0]) if a else 100.0
        sc = (scenarios or {}).get(i)
        out.append((i, f"TX{i:010d}", BASE + int(m * MIN), s, d, amount, round(amount * 100), "USD", int(i in (labels or ())), "ACH", sc, sc and "CYCLE", amount, "USD", int(s == d)))
    return spark.createDataFrame(out, TX)


def by_pos(df):
    return {r.row_pos: r for r in df.collect()}


MARKET = [("shop", "mill", 0, 300), ("farm", "shop", 30, 200), ("shop", "farm", 45, 60), ("mill", "shop", 50, 140), ("shop", "mill", 100, 510)]


def test_behaviour_hand_values(spark):
    """The last row: shop sent at 0 and 45, got 200 and 140, and mill has got one payment and made one."""
    r = by_pos(history.behaviour(frame(spark, MARKET)))[4]
    assert (r.bh_src_out_n_1h, r.bh_src_out_n_24h, r.bh_src_out_cents_24h, r.bh_src_in_n_24h) == (1, 2, 36000, 2)
    assert (r.bh_src_passthrough_24h, r.bh_src_secs_since_out, r.bh_pair_n_prior, r.bh_reverse_pair_n_prior) == (1.5, 3300, 1, 1)
    assert (r.bh_dst_in_n_24h, r.bh_dst_out_n_24h) == (1, 1)


@pytest.mark.parametrize("block", [history.behaviour, history.graph_lite, history.previous_out, graph.fan_degree, graph.vertex_statistics])
def test_later_rows_change_nothing_earlier(spark, block):
    rng = random.Random(3)
    rows = [(f"N{rng.randrange(8)}", f"N{rng.randrange(8)}", 10 * i, rng.randint(1, 900)) for i in range(60)]
    early = by_pos(block(frame(spark, rows[:40])))
    late = by_pos(block(frame(spark, rows).repartition(7)))
    assert all(late[k] == v for k, v in early.items())


def test_one_instant_is_blind_to_itself(spark):
    got = by_pos(history.behaviour(frame(spark, [("quay", "port", 7, 31), ("quay", "port", 7, 62), ("quay", "port", 7, 31)])))
    assert all((r.bh_pair_n_prior, r.bh_src_out_n_1h, r.bh_src_secs_since_out) == (0, 0, None) for r in got.values())


def test_fan_in_counts_each_edge_once(spark):
    tx = frame(spark, [(a, "HUB", i) for i, a in enumerate("ABCD")])
    fan = by_pos(graph.fan_degree(tx))[3]
    assert (fan.fan_in, fan.degree_in, fan.fan_out) == (4, 4, 1)
    assert by_pos(graph.histogram(graph.fan_degree(tx), "fan_in"))[3]["pat_fan_in_4"] == 1
    s = by_pos(graph.vertex_statistics(tx))[3]
    assert (s.dst_in_n, s.dst_in_sum, s.dst_in_variance) == (4, 400.0, 0.0)


def test_self_transfers_stay_out_of_the_graph(spark):
    got = by_pos(graph.fan_degree(frame(spark, [("A", "A", 0), ("A", "A", 5), ("A", "B", 10)])))
    assert set(got) == {2} and got[2].degree_out == 1


def test_ties_see_earlier_rows_only(spark):
    got = by_pos(graph.fan_degree(frame(spark, [("A", "H", 1), ("B", "H", 1), ("C", "H", 1)])))
    assert [got[i].fan_in for i in range(3)] == [1, 2, 3]


def test_cycles(spark):
    tx = frame(spark, [("1", "2", 10), ("2", "3", 20), ("3", "1", 30), ("4", "5", 40), ("6", "5", 45), ("7", "5", 50)])
    assert [tuple(r) for r in graph.cycles(tx).collect()] == [(2, 3, 1)]
    # out of time order: only the unordered form closes
    tx = frame(spark, [("2", "3", 10), ("1", "2", 20), ("3", "1", 30)])
    assert graph.cycles(tx).count() == 0
    assert [tuple(r) for r in graph.cycles(tx, ordered=False).collect()] == [(2, 3, 1)]


def brute_cycles(rows, ordered, longest):
    """Simple cycles by depth-first search back from each closing edge; rows of (src, dst, minute)."""
    found = {}

    def back(c, head, last, seen, length):
        if longest and length > longest:
            return
        for i, (s, d, m) in enumerate(rows):
            before = m < last if ordered else (m, i) < (rows[c][2], c)
            if s != d and d == head and before and m >= rows[c][2] - 1440:
                if s == rows[c][1]:
                    found[c, length] = found.get((c, length), 0) + 1
                elif s not in seen:
                    back(c, s, m, seen | {s}, length + 1)

    for c, (s, d, m) in enumerate(rows):
        if s != d:
            back(c, s, m, {s, d}, 2)
    return found


@pytest.mark.parametrize(("name", "ordered", "longest"), [("h5_temporal_cycle", True, None), ("h6_lc_cycle", False, 10)])
def test_long_cycles_match_brute_force(spark, tmp_path, name, ordered, longest):
    rng = random.Random(5)
    ring = [(k, k % 12 + 1, 100 * k) for k in range(1, 13)] + [(20 + k, 20 + (k + 1) % 6, 230 * k) for k in range(6)]
    rows = sorted(ring + [(rng.randrange(40, 47), rng.randrange(40, 47), 60 * i + 5) for i in range(36)] + [(99, 1, 1200)], key=lambda r: r[2])
    got = {(r.row_pos, r.length): r.n for r in catalog.QUERIES[name](spark, events(spark, tmp_path, [(*r, 10) for r in rows])).collect()}
    want = brute_cycles(rows, ordered, longest)
    assert got == want and max(n for _, n in want) >= (12 if ordered else 6)


def test_the_pattern_block_counts_cycles_of_every_length(spark, tmp_path):
    """A ring of 12 in the order of time, one of 11 against it (too long for a simple cycle), and one of 6."""
    ring = [(k, k % 12 + 1, 100 * k) for k in range(1, 13)] + [(20 + (k + 1) % 11, 20 + k, 50 * k + 7) for k in range(11, 0, -1)] + [(40 + k, 40 + (k + 1) % 6, 230 * (5 - k)) for k in range(6)]
    rows = sorted(ring + [(1, 7, 3), (12, 3, 1204)], key=lambda r: r[2])
    found = catalog.QUERIES["d4_pattern_block"](spark, events(spark, tmp_path, [(*r, 10) for r in rows]))
    got = {r["column"]: r.total for r in found.filter("column LIKE '%cycle%' AND total > 0").collect()}
    want = {}
    for family, top, ordered, longest in (("temporal_cycle", 30, True, None), ("lc_cycle", 10, False, 10)):
        for (_, length), n in brute_cycles(rows, ordered, longest).items():
            key = f"pat_{family}_{min(length, top)}"
            want[key] = want.get(key, 0) + n
    assert got == want and {"pat_temporal_cycle_12", "pat_lc_cycle_6"} < set(want)


def test_scatter_gather(spark):
    tx = frame(spark, [("U", "M1", 0), ("U", "M2", 1), ("U", "M3", 2), ("M1", "W", 5), ("M2", "W", 6), ("M3", "W", 7)])
    assert sorted(tuple(r) for r in graph.scatter_gather(tx).collect()) == [(4, 2, 1), (5, 3, 1)]


#: Ore goes to the smelter and on to the press, the port and the scrap heap; the last two rows come too early to follow.
FLOW = [("ore", "smelter", 50, 720), ("smelter", "press", 65, 640), ("smelter", "scrap", 70, 55), ("press", "port", 90, 610), ("press", "smelter", 40, 33), ("quay", "port", 30, 8)]


def seeds(spark, account, minute=None):
    return spark.createDataFrame([(account, None if minute is None else BASE + minute * MIN)], "seed string, at_us long")


def test_trace_chain(spark):
    tx = frame(spark, FLOW)
    t = trace(tx, seeds(spark, "ore"), horizon=3)
    assert {r.row_pos: r.depth for r in t.edges.collect()} == {0: 1, 1: 2, 2: 2, 3: 3}
    assert sorted(r.account for r in t.terminals.collect()) == ["port", "scrap"]
    assert {r.depth: r.cents for r in t.per_hop().collect()} == {1: 72000, 2: 69500, 3: 61000}
    assert trace(tx, seeds(spark, "ore"), horizon=2).edges.count() == 3
    assert trace(tx, seeds(spark, "ore", 60)).edges.count() == 0
    back = {r.row_pos for r in trace(tx, seeds(spark, "port"), "backward", horizon=3).edges.collect()}
    assert back == {0, 1, 3, 4, 5}  # the press paid the smelter before the smelter paid it back


def test_trace_limits_and_refusals(spark):
    star = frame(spark, [("core", f"ray{i}", 2 * i) for i in range(70)])
    capped = trace(star, seeds(spark, "core"), limits=TraceLimits(degree_cap=6))
    assert capped.edges.count() == 6 and capped.status.first().capped == ["core"] and not capped.status.first().complete
    spent = trace(star, seeds(spark, "core"), limits=TraceLimits(degree_cap=70, edge_budget=20))
    assert spent.edges.count() == 20 and spent.status.first().exhausted
    ring = frame(spark, [("p", "q", 3), ("q", "r", 8), ("r", "s", 9), ("s", "p", 11)])
    assert trace(ring, seeds(spark, "p"), horizon=6).edges.count() == 4
    gap = frame(spark, [("p", "q", 0), ("q", "r", 3 * 1440)])
    assert trace(gap, seeds(spark, "p"), limits=TraceLimits(max_gap_us=2 * C.DAY_US)).edges.count() == 1
    for bad in ({"direction": "sideways"}, {"horizon": 0}):
        with pytest.raises(TraceError):
            trace(star, seeds(spark, "core"), **bad)
    assert trace(star, seeds(spark, "nobody")).edges.count() == 0


def test_splits(spark):
    tx = frame(spark, [("A", "B", 1440 * (i // 25)) for i in range(300)], scenarios={200: "S", 260: "S"})
    for policy in ("hard_cut", "pattern_start"):
        s = splits.chronological_split(tx, splits.SplitSpec(policy=policy))
        assert s.count() == 300
    s = splits.chronological_split(tx)
    assert s.groupBy("t_us").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    edge = {r.split: (r.lo, r.hi) for r in s.groupBy("split").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi")).collect()}
    assert edge["train"][1] < edge["val"][0] and edge["val"][1] < edge["test"][0]
    assert splits.chronological_split(tx, splits.SplitSpec(policy="purge")).count() < 300
    folds = splits.rolling_origin(tx, 3).collect()
    assert [f.n_train for f in folds] == sorted(f.n_train for f in folds) and all(f.train_end_us < f.val_end_us for f in folds)
    with pytest.raises(splits.SplitError):
        splits.SplitSpec(train=0.9, val=0.2)
    with pytest.raises(splits.SplitError):
        splits.chronological_split(frame(spark, [("A", "B", 0)] * 10))


def test_only_a_trailing_sparse_run_is_trimmed(spark):
    days = [500, 5, 500, 500, 5, 5]
    tx = frame(spark, [("A", "B", 1440 * d + i % 60) for d, n in enumerate(days) for i in range(n)])
    kept, _ = splits.trim_sparse_tail(tx)
    assert kept.count() == 1505


def test_contract(spark):
    tx = frame(spark, MARKET)
    contract.validate_schema(tx)
    for column in contract.FORBIDDEN:
        with pytest.raises(contract.ContractError):
            contract.assert_label_blind(tx.select(column))
    for bad in (tx.drop("amount"), tx.withColumn("odd", F.lit(1)), tx.withColumn("is_laundering", F.lit(2)), tx.withColumn("t_us", F.lit("x"))):
        with pytest.raises(contract.ContractError):
            contract.validate_schema(bad)
    found = {r.capability: r.present for r in contract.capabilities(tx).collect()}
    assert found["typology"] is False and found["cross_currency"] is False
    assert contract.missing_capabilities(contract.capabilities(tx), {"typology"}) == ["typology"]


def test_row_features(spark):
    tx = frame(spark, [("A", "B", 61, 1000), ("A", "B", 0, 99.996), ("A", "A", 0, 0)])
    r = [x for x in C.row_features(tx).orderBy("transaction_id").collect()]
    assert (r[0].tx_amount_is_round_1k, r[0].tx_hour, r[0].tx_minute_of_day) == (1, 1, 61)
    assert r[1].tx_amount_decimals == 100 and r[2].tx_amount_ratio == 1.0
    codes = C.category_codes(spark.createDataFrame([("b",), ("a",), (None,)], "v string"), spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string"), "v")
    assert {x.v: x.v_code for x in codes.collect()} == {"a": 0, "b": 1, "c": -1, None: -1}
    assert len(C.pattern_columns(("amount",))) == 215 and len(C.pattern_columns(("amount", "timestamp"))) == 235


def test_metrics(spark):
    rows = [(i, 1 if i < 10 else 0, 1.0 if i < 10 else 0.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_pos long, is_laundering int, score double")
    e = metrics.evaluate(df).first()
    assert (e.average_precision, e.roc_auc, e.best_f1) == (1.0, 1.0, 1.0)
    one = metrics.evaluate(df.filter("is_laundering = 0")).first()
    assert one.average_precision is None and one.roc_auc is None
    assert [r.k for r in metrics.budget_points(df, (0.0025, 0.0035)).orderBy("budget").collect()] == [2, 4]  # half-even
    assert metrics.flag_top(df, 0.01).filter("flagged").count() == 10
    with pytest.raises(ValueError, match="test"):
        metrics.select_thresholds(df, (0.01,), partition="test")
    x = spark.range(2000).select((F.col("id") / 100).alias("v"))
    assert metrics.psi(x, x, "v").first().psi == 0 and metrics.ks(x, x, "v").first().ks == 0
    assert metrics.psi(x, x.select((F.col("v") + 15).alias("v")), "v").first().psi > 0.25


def test_account_scores(spark):
    tx = frame(spark, [("k", "l", 0), ("l", "m", 1), ("k", "m", 2), ("m", "n", 3), ("n", "l", 4)])
    scored = tx.withColumn("score", F.element_at(F.array(*map(F.lit, (0.2, 0.8, 0.2, 0.6, 0.2))), (F.col("row_pos") + 1).cast("int")))
    got = {r.account: (r.max_score, r.mean_score, r.topk_mean, r.n) for r in metrics.account_scores(scored, k=2).collect()}
    want = {"k": (0.2, 0.2, 0.2, 2), "l": (0.8, 0.4, 0.5, 3), "m": (0.8, 1.6 / 3, 0.7, 3), "n": (0.6, 0.4, 0.4, 2)}
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(w) for a, w in want.items())


def test_cascade_and_ranks(spark):
    df = spark.range(100).select(F.col("id").alias("row_pos"), F.col("id").cast("double").alias("t0"), (100 - F.col("id")).cast("double").alias("t1"))
    got = {r.row_pos: r for r in ranking.cascade(df, "t0", "t1", 0.05).collect()}
    assert {k for k, r in got.items() if r.selected} == set(range(95, 100))
    assert max(r.combined for r in got.values() if not r.selected) <= min(r.combined for r in got.values() if r.selected)
    placed = {r.row_pos: r.place for r in global_position(df.repartition(9), [("t1", True), ("row_pos", True)], "place").collect()}
    assert placed == {i: 99 - i for i in range(100)}
    run = {r.row_pos: r.upto for r in global_running(df.repartition(5), [("row_pos", True)], {"upto": "t0"}).collect()}
    assert run[99] == 4950 and run[3] == 6
    with pytest.raises(ValueError, match="share"):
        ranking.cascade(df, "t0", "t1", 0)


def test_cases_agree_and_tampering_shows(spark):
    tx = frame(spark, FLOW)
    t = trace(tx, seeds(spark, "ore"), horizon=3)
    docs = cases.build(t, tx.select("row_pos", "transaction_id", "payment_type"), spark.createDataFrame([("ore", 0.9, 1)], "seed string, score double, rank long")).cache()
    assert cases.inconsistencies(docs).count() == 0
    assert docs.first().accounts == ["ore", "port", "press", "scrap", "smelter"] and docs.first().trace.terminals == ["port", "scrap"]
    faults = lambda d: {r.fault for r in cases.inconsistencies(d).collect()}
    assert "accounts" in faults(docs.withColumn("accounts", F.array(F.lit("ore"))))
    assert {"transaction_ids", "case_id"} <= faults(docs.withColumn("transaction_ids", F.array(F.lit("TX9"))))
    hops = lambda change: docs.withColumn("trace", F.col("trace").withField("per_hop", F.transform("trace.per_hop", change)))
    assert faults(hops(lambda h: h.withField("n", h["n"] + 1))) == {"per_hop_count"}
    assert faults(hops(lambda h: h.withField("cents", h["cents"] - 1))) == {"per_hop_sum"}
    assert faults(docs.withColumn("coverage", F.col("coverage").withField("rails", F.map_from_arrays(F.array(F.lit("ACH")), F.array(F.lit(9).cast("long")))))) == {"rails"}
    gains = [(0.05, 0.4, -0.05), (-0.2, 0.3, -0.1), (0.1, -0.1, -0.1), (0.3, 0.2, -0.05)]
    contribs = spark.createDataFrame([(f"TX{i:010d}", *g) for i, g in enumerate(gains)], "transaction_id string, size double, ring double, night double")
    r = cases.reasons(t, tx.select("row_pos", "transaction_id"), contribs, ["size", "ring", "night"]).first().reasons
    assert [x.feature for x in r] == ["ring", "night", "size"] and r[1].code == "NIGHT_LOWERED"
    assert [x.total for x in r] == pytest.approx([0.8, -0.3, 0.25]) and r[0].driven_by[0] == "TX0000000000"


def test_cases_read_back_and_refused(spark, tmp_path):
    tx = frame(spark, FLOW).withColumn("payment_type", F.when(F.col("row_pos") > 0, F.col("payment_type")))
    ranked = ranking.rank(tx.withColumn("score", F.lit(1.0) - F.col("row_pos") / 10)).withColumn("alert", F.col("source_account") == "ore")
    docs = cases.export(tx, ranked, 3).cache()
    one = docs.first()
    assert docs.count() == 1 and one.seed == "ore" and one.risk.rank == 1 and cases.inconsistencies(docs).count() == 0
    cover = cases.rail_coverage(docs).first()
    assert cover.n == len(one.path) and cover.n_unknown == 1 and cover.warning == f"1 of {cover.n} transfers have no payment type"
    path = f"file://{tmp_path}/cases"
    writers.write_cases(docs, path)
    assert writers.read_cases(spark, path, docs.schema).collect() == docs.collect()
    line = cases.as_text(docs).first().value
    for changed in (line[:-1] + ',"extra":1}', line[:-5], line.replace('"open"', "7"), ""):
        with pytest.raises(cases.CaseError):
            cases.from_text(spark.createDataFrame([(changed,)], "value string"), docs.schema)


def test_order_statistics_by_hand(spark):
    # shop pays mill 300 at 0 and 510 at 100 minutes, farm 60 at 45
    r = by_pos(graph.order_statistics(frame(spark, MARKET)))[4]
    assert (r.src_out_min, r.src_out_max, r.src_out_median, r.src_out_mean) == (6000, 51000, 30000, 29000)
    assert (r.src_in_median, r.dst_in_min, r.dst_in_median) == (17000, 30000, 40500)
    first = by_pos(graph.order_statistics(frame(spark, MARKET)))[0]
    assert first.src_in_min is None and first.src_out_median == 30000
    t = by_pos(graph.timestamp_statistics(frame(spark, MARKET)))[4]
    assert t.src_out_max - t.src_out_min == 6000 and t.src_out_median - t.src_out_min == 2700


def test_unseen_typologies_are_refused(spark):
    tx = frame(spark, MARKET, labels={1, 2}, scenarios={1: "a"})
    for held, f in ((["STACK"], tx), (["CYCLE"], tx), (None, frame(spark, MARKET, labels={1}))):
        with pytest.raises(splits.SplitError):
            splits.unseen_typology_split(f, held)


def test_ids_follow_file_names(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("\n".join([HEADER, RAW[0]]) + "\n")
    (tmp_path / "raw" / "b.csv").write_text("\n".join([HEADER, *RAW[1:] * 40]) + "\n")
    tx = readers.load_transactions(spark, f"file://{tmp_path}/raw").orderBy("row_pos").collect()
    assert len(tx) == 81 and tx[0].source_account == "7:AB12" and tx[1].destination_account == "9:EF56" and tx[2].currency == "Koruna"


#: The header of the raw transfer file and, below, the marks of a pattern block.
HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
RAW = [
    "2023/03/07 13:45,007,AB12,007,AB12,50.00,Franc,50.00,Franc,Transfer,0",
    "2023/03/07 13:50,0042,CD34,0009,EF56,12.5,Franc,12.5,Franc,Card,0",
    "2023/03/07 13:30,0311,GH78,0650,IJ90,910.00,Peso,45.60,Koruna,Wire,1",
]


def test_raw_transfers_and_patterns(spark, tmp_path):
    (tmp_path / "tx.csv").write_text("\n".join([HEADER, *RAW]) + "\n")
    tx = readers.load_transactions(spark, f"file://{tmp_path}/tx.csv").orderBy("row_pos").collect()
    assert [r.transaction_id for r in tx] == [f"TX{i:010d}" for i in range(3)]
    assert (tx[0].source_account, tx[0].is_self_transfer, tx[1].destination_account) == ("7:AB12", 1, "9:EF56")
    assert (tx[2].amount, tx[2].currency, tx[2].amount_received) == (45.60, "Koruna", 910.0)
    assert readers.load_transactions(spark, f"file://{tmp_path}/tx.csv", nrows=2).count() == 2
    a, b = RAW[1], RAW[2]
    text = f"BEGIN LAUNDERING ATTEMPT - BIPARTITE\n{a}\n{b}\nEND LAUNDERING ATTEMPT - BIPARTITE\n\nBEGIN LAUNDERING ATTEMPT - RANDOM:  Max 4 hops\n{b}\nEND LAUNDERING ATTEMPT - RANDOM\n"
    (tmp_path / "p.txt").write_text(text)
    patterns = readers.parse_patterns(spark, f"file://{tmp_path}/p.txt")
    got = {r.row_pos: r for r in contract.attach_patterns(readers.load_transactions(spark, f"file://{tmp_path}/tx.csv"), patterns).collect()}
    assert (got[1].pattern_type, got[1].scenario_id) == ("BIPARTITE", "SC000000")
    assert got[2].scenario_id is None and got[2].ambiguous and got[0].scenario_id is None
    for bad in ("", f"BEGIN LAUNDERING ATTEMPT - X\n{a}\n", "END LAUNDERING ATTEMPT - X\n", "BEGIN LAUNDERING ATTEMPT - X\n1,2\nEND LAUNDERING ATTEMPT - X\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(readers.SourceError):
            readers.parse_patterns(spark, f"file://{tmp_path}/bad.txt")
    (tmp_path / "short.csv").write_text("a,b\n1,2\n")
    with pytest.raises(readers.SourceError):
        readers.load_transactions(spark, f"file://{tmp_path}/short.csv")
    (tmp_path / "acc.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nHarbour,007,AB12,E7,Pier\n")
    assert readers.load_accounts(spark, f"file://{tmp_path}/acc.csv").first().account_id == "7:AB12"


def test_sinks(spark, tmp_path):
    tx = frame(spark, MARKET)
    writers.write_feature_parts(history.behaviour(tx), f"file://{tmp_path}/parts", 2)
    part = readers.read_feature_parts(spark, f"file://{tmp_path}/parts", tx.filter("row_pos > 1"))
    assert part.count() == 3 and "bh_src_out_n_24h" in part.columns
    assert readers.cache_is_complete(spark, f"file://{tmp_path}/parts", 5) and not readers.cache_is_complete(spark, f"file://{tmp_path}/none", 4)
    writers.write_table(tx, f"file://{tmp_path}/t.csv", "csv")
    assert readers.read_table(spark, f"file://{tmp_path}/t.csv", ["row_pos"]).count() == 5
    ranked = ranking.rank(tx.withColumn("score", F.col("amount"))).withColumn("alert", F.col("rank") <= 1)
    writers.write_scores(ranked, f"file://{tmp_path}/scores")
    assert '"n_alerts": 1' in writers.run_summary(ranked, model_id="m")
    assert writers.dataset_summary(tx)["rows"] == 5


def test_model_package(spark, tmp_path):
    rng = random.Random(1)
    tx = frame(spark, [(f"A{rng.randrange(5)}", "B", i, 900 if i % 7 == 0 else rng.randint(1, 500)) for i in range(210)], labels={i for i in range(0, 210, 7)})
    f = C.row_features(contract.feature_view(tx), payment_type=False).join(tx.select("transaction_id", "row_pos", "is_laundering"), "transaction_id")
    columns = ["tx_amount_log", "tx_hour"]
    package = model.fit(f.filter("row_pos < 150"), f.filter("row_pos >= 150"), columns, iterations=3, depth=2)
    scored = model.score(f.filter("row_pos >= 150"), package)
    assert metrics.evaluate(scored).first().average_precision > 0.9
    package.save(spark, f"file://{tmp_path}/pkg")
    again = model.Package.load(spark, f"file://{tmp_path}/pkg")
    assert again.columns == columns and again.schema_hash == package.schema_hash
    with pytest.raises(ValueError, match="missing"):
        model.score(f.drop("tx_hour"), again)
    with pytest.raises(contract.ContractError):
        model.fit(f, f, ["is_laundering"])
    c = model.contributions(f.limit(5), package)
    assert c.columns == ["transaction_id", *columns, "bias"] and c.count() == 5


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"N{rng.randrange(5)}", f"N{rng.randrange(5)}", 30 * (i // 2), rng.randint(1, 900)) for i in range(120)]
    tx = frame(spark, rows)
    for k in range(3):
        tx.filter((F.col("row_pos") >= 40 * k) & (F.col("row_pos") < 40 * k + 40)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(tx.schema).parquet(f"file://{tmp_path}/in")
        q = (streaming.outgoing_history(stream).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp")
             .trigger(availableNow=True).start(f"file://{tmp_path}/out"))
        q.awaitTermination()
    got = by_pos(spark.read.parquet(f"file://{tmp_path}/out"))
    want = by_pos(history.behaviour(tx))
    assert len(got) == 120
    for k, r in got.items():
        assert (r.bh_src_out_n_1h, r.bh_src_out_n_24h, r.bh_src_out_cents_24h, r.bh_src_secs_since_out) == (
            want[k].bh_src_out_n_1h, want[k].bh_src_out_n_24h, want[k].bh_src_out_cents_24h, want[k].bh_src_secs_since_out)


def test_stream_of_both_ends_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    tx = streaming.with_event_time(frame(spark, [(f"N{rng.randrange(5)}", f"N{rng.randrange(5)}", 50 * (i // 2), rng.randint(1, 900)) for i in range(90)]))
    for k in range(3):
        tx.filter((F.col("row_pos") >= 30 * k) & (F.col("row_pos") < 30 * k + 30)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = streaming.with_event_time(spark.readStream.schema(tx.schema).parquet(f"file://{tmp_path}/in"))
        ends = streaming.account_history(stream, idle_us=30 * 86_400_000_000)
        ends.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    got = by_pos(streaming.by_transfer(spark.read.parquet(f"file://{tmp_path}/out")))
    for k, want in by_pos(history.behaviour(tx)).items():
        for c in got[k].asDict():
            assert getattr(got[k], c) == pytest.approx(getattr(want, c)), (k, c)
    assert len(got) == 90


def events(spark, path, rows):
    """An events table of (sender, receiver, minute, value) in a folder of its own."""
    data = [(i, BASE + int(m * MIN), s, "view", float(v), '{"k": %d}' % d) for i, (s, d, m, v) in enumerate(rows)]
    e = spark.createDataFrame(data, "event_id long, us long, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.timestamp_micros("us")).drop("us").write.mode("overwrite").parquet(f"{path}/events.parquet")
    return str(path)


def test_drift_reads_the_whole_table(spark, tmp_path):
    """The reference is all of the first 70 percent: rows from 5,000 on count, and so do odd ones."""
    values = [1 + (i * 7919) % 1000 if i < 5000 else 5000 + (i * 104729) % 3000 for i in range(10_000)]
    at = events(spark, tmp_path, [(1, 2, i, v) for i, v in enumerate(values)])
    ref, cur = values[:7000], [v * 1.2 for v in values[8500:]]
    ks = max(abs(sum(r <= v for r in ref) / len(ref) - sum(c <= v for c in cur) / len(cur)) for v in sorted(set(cur))[::50] + [7999])
    got = catalog.QUERIES["k11_ks"](spark, at).first().ks
    assert ks - 1e-6 <= got <= ks + 0.05 and got < 0.95
    edges = sorted({float(x) for x in np.quantile(ref, [i / 10 for i in range(1, 10)])})
    share = lambda vs: np.maximum(np.bincount(np.searchsorted(edges, vs, side="right"), minlength=len(edges) + 1) / len(vs), 1e-6)
    p, q = share(ref), share(cur)
    assert abs(catalog.QUERIES["k10_psi"](spark, at).first().psi - float(((q - p) * np.log(q / p)).sum())) < 1e-5


def test_adaptive_is_fitted_on_a_share_of_all_rows(spark, tmp_path):
    """Accounts that appear only after row 6,000, but within the first 70 percent, are known."""
    at = events(spark, tmp_path, [(1 if i < 6200 else 50, 2 if i < 6200 else 60 + i % 3, i, 10) for i in range(10_000)])
    got = {r.transaction_id: r for r in catalog.QUERIES["h20_adaptive"](spark, at).filter("transaction_id >= 'TX0000009990'").collect()}
    assert len(got) == 10 and all((r.adp_source_unseen, r.adp_dest_unseen) == (0, 0) and r.adp_out_degree_log == round(math.log(4), 6) for r in got.values())


def test_case_documents_have_the_whole_trace(spark, tmp_path):
    """Cases start at the alert and keep 16 edges a vertex, the third hop, and hops more than a day apart."""
    hub = [(1, 2, 0, 10)] + [(1, 10 + i, 60 + i, 100_000 if i == 0 else 10) for i in range(12)]
    far = [(10, 30, 3000, 10), (30, 31, 6000, 10), (31, 32, 9000, 10)]
    at = events(spark, tmp_path, hub + far)
    tx = catalog.data.views.tx_events(spark, at)
    d = next(r for r in models.documents(tx).collect() if r.seed == "A1")
    assert {(p["from"], p["to"], p["depth"]) for p in d.path} == {("A1", f"A{10 + i}", 1) for i in range(12)} | {("A10", "A30", 2), ("A30", "A31", 3)}
    assert {(r.copy, r.fault) for r in catalog.QUERIES["j15_bundle_consistency"](spark, at).collect()} == {
        ("transaction_ids", "transaction_ids"), ("transaction_ids", "case_id"), ("accounts", "accounts"), ("rails", "rails"), ("case_id", "case_id")}  # the documents as written have none


def test_every_account_is_evaluated(spark, tmp_path):
    rows = [(i % 15, (i * 7 + 1) % 15, i, 1 + (i * 31) % 97) for i in range(60)]
    got = catalog.QUERIES["k14_account_eval"](spark, events(spark, tmp_path, rows)).collect()
    assert len(got) == 3 and all((r.n, r.positives) == (15, 3) for r in got)


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 80


def test_rule_weights_by_hand(spark):
    """Each rule alone over the weight of those applicable (4.25 in all)."""
    base = {"amount": 10.5, "t_us": 12 * 3_600_000_000, "currency": "EUR", "currency_received": "EUR", "is_self_transfer": 1}
    alone = [({"amount": 150.5}, 1.0), ({"amount": 1500.5}, 2.5), ({"currency_received": "USD"}, 0.75), ({"amount": 0.0}, 0.5), ({"t_us": 0}, 0.25), ({"is_self_transfer": 0}, 0.25)]
    rows = [base, *[{**base, **change} for change, _ in alone]]
    df = spark.createDataFrame(rows, "amount double, t_us long, currency string, currency_received string, is_self_transfer int").coalesce(1)
    got = [r.s for r in df.select(C.rule_score(C.rule_columns(df.columns, 100.0, 1000.0)).alias("s")).collect()]
    assert got == pytest.approx([0.0, *[w / 4.25 for _, w in alone]])
    part = df.select("amount", "is_self_transfer")  # rules without their columns leave the total as well
    assert part.select(C.rule_score(C.rule_columns(part.columns, 100.0, 1000.0)).alias("s")).collect()[6].s == pytest.approx(0.25 / 3.25)


def test_typology_hints(spark):
    rows = [(("big", 900.0 + i, "STACK") if i % 3 == 0 else ("small", 10.0 + i, "CYCLE") if i % 3 == 1 else ("any", 400.0, None)) for i in range(120)]
    df = spark.createDataFrame([(f"T{i}", *r) for i, r in enumerate(rows)], "transaction_id string, kind string, tx_amount double, pattern_type string")
    hinter = typology.fit(df, ["tx_amount"], trees=10, depth=2)
    got = hinter.hint(df.filter("kind <> 'any'")).collect()
    assert hinter.classes == ["CYCLE", "STACK"] and all(r.hint == r.pattern_type and set(r.distribution) == {"CYCLE", "STACK"} for r in got)
    hinter.floor = 1.1
    assert {r.hint for r in hinter.hint(df).collect()} == {typology.UNCLASSIFIED}
    for few in (df.filter("kind = 'any'"), df.filter("kind = 'big'")):
        with pytest.raises(typology.TypologyError):
            typology.fit(few, ["tx_amount"])


def test_command_line(spark, tmp_path):
    from tidewater.__main__ import main

    rows = [f"2023/03/{1 + i // 40:02d} {i % 24:02d}:{i % 60:02d},00{i % 7},A{i % 7},00{(i + 3) % 9},A{(i + 3) % 9},{10 + i}.00,Franc,{10 + i}.00,Franc,Wire,{int(i % 11 == 0)}" for i in range(400)]
    (tmp_path / "raw.csv").write_text("\n".join([HEADER, *rows]) + "\n")
    out = f"file://{tmp_path}/out"
    run = lambda *a: main([*a, "--out", out], spark)
    tx = ("--transactions", f"{out}/transactions")
    assert run("ingest", "--raw", f"file://{tmp_path}/raw.csv")["rows"] == 400
    assert run("baseline", *tx)["n"] == 60
    assert run("graph", *tx)["parts"] == ["behaviour", "fan_degree", "order", "timestamp", "vertex"]
    trained = run("train", *tx, "--iterations", "2", "--depth", "2", "--threshold", "0.05")
    scored = run("score", *tx, "--package", f"{out}/package", "--cases", "2")
    assert scored["n_transactions"] == 400 and scored["schema_hash"] == trained["schema_hash"]
    assert spark.read.text(f"{out}/cases").count() == min(2, scored["n_alerts"])
    verdict = run("validate", *tx, "--iterations", "2", "--depth", "2")
    assert verdict["tables"] == ["drift", "gates", "null_baselines"] and sum(verdict["gates"].values()) == 17
    with pytest.raises(SystemExit):
        main(["score", "--out", out], spark)
