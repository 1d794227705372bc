"""Sliding sums, distinct counts and order statistics: hubs cut into slices and chunks of rows give the plain results."""

import random
import statistics

import pytest

from tidewater.functions.columns import DAY_US, HOUR_US
from tidewater.operators import graph, history, sliding

START = 1_700_000_000_000_000


def transfers(spark, n=600, accounts=6, seed=3, self_transfers=True):
    rng = random.Random(seed)
    rows, t = [], START
    for i in range(n):
        t += rng.choice([0, 0, 1, HOUR_US // 2, HOUR_US, DAY_US // 8, DAY_US, DAY_US])
        a = "hub" if rng.random() < 0.5 else f"a{rng.randrange(accounts)}"
        b = "hub" if rng.random() < 0.3 else f"a{rng.randrange(accounts)}"
        if a == b and not self_transfers:
            b = "other"
        rows.append((i, t, rng.randint(1, 500), a, b))
    df = spark.createDataFrame(rows, "row_pos long, t_us long, cents long, source_account string, destination_account string").repartition(3)
    return rows, df


def sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("hub_rows,chunk", [(10, 1 << 16), (10**9, 7), (10, 7)])
def test_hubs_and_chunks_change_nothing(spark, monkeypatch, hub_rows, chunk):
    _, df = transfers(spark)
    jobs = [history.behaviour, history.graph_lite, graph.fan_degree, graph.vertex_statistics, graph.order_statistics]
    plain = [sorted_rows(job(df)) for job in jobs]
    monkeypatch.setattr(sliding, "CHUNK", chunk)
    for job, want in zip(jobs, plain, strict=True):
        assert str(sorted_rows(job(df, hub_rows=hub_rows))) == str(want), job.__name__


def test_behaviour_matches_a_loop(spark):
    rows, df = transfers(spark, 300)
    got = {r.row_pos: r for r in history.behaviour(df, hub_rows=20).collect()}
    for i, t, cents, a, b in rows:
        past = [r for r in rows if r[1] < t]
        near = lambda width, t=t, past=past: [r for r in past if r[1] >= t - width]
        sent = lambda x, width, near=near: [r for r in near(width) if r[3] == x]
        taken = lambda x, width, near=near: [r for r in near(width) if r[4] == x]
        into = sum(r[2] for r in taken(a, DAY_US))
        last = max((r[1] for r in past if r[3] == a), default=None)
        want = (len(sent(a, HOUR_US)), len(sent(a, DAY_US)), sum(r[2] for r in sent(a, DAY_US)), len(taken(a, DAY_US)), cents / into if into else None,
                len(taken(b, DAY_US)), len(sent(b, DAY_US)), None if last is None else (t - last) / 1_000_000,
                sum(r[3:] == (a, b) for r in past), sum(r[3:] == (b, a) for r in past))
        assert tuple(got[i])[1:] == want


def test_fan_and_order_statistics_match_a_loop(spark):
    rows, df = transfers(spark, 300, self_transfers=False)
    rows = [r for r in rows if r[3] != r[4]]
    fan = {r.row_pos: r for r in graph.fan_degree(df, hub_rows=20).collect()}
    order = {r.row_pos: r for r in graph.order_statistics(df, hub_rows=20).collect()}
    for i, t, _, a, b in rows:
        seen = [r for r in rows if (r[1], r[0]) <= (t, i) and r[1] >= t - DAY_US]
        into, out = [r for r in seen if r[4] == b], [r for r in seen if r[3] == a]
        assert tuple(fan[i])[1:] == (len({r[3] for r in into}), len({r[4] for r in out}), len(into), len(out))
        for name, end in (("src", a), ("dst", b)):
            for role, place in (("out", 3), ("in", 4)):
                x = [r[2] for r in seen if r[place] == end]
                want = (min(x), max(x), statistics.median(x), sum(x) / len(x)) if x else (None,) * 4
                assert tuple(order[i][f"{name}_{role}_{s}"] for s in ("min", "max", "median", "mean")) == want


def test_sorted_blocks():
    rng = random.Random(1)
    held, plain = sliding.SortedBlocks(), []
    for _ in range(6000):
        if plain and rng.random() < 0.4:
            held.remove(x := rng.choice(plain))
            plain.remove(x)
        else:
            held.add(x := rng.randint(0, 300))
            plain.append(x)
        if plain and rng.random() < 0.05:
            assert held.summary() == (min(plain), max(plain), statistics.median(plain), sum(plain) / len(plain))
    for k, x in enumerate(sorted(plain)):
        assert held.at(k) == x


def test_no_transfers(spark):
    _, df = transfers(spark, 5)
    for job in (history.behaviour, history.graph_lite, graph.fan_degree, graph.vertex_statistics, graph.order_statistics):
        assert job(df.limit(0)).count() == 0


def test_large_amounts_stay_exact(spark):
    rows = [(i, START + i, 90_000_000_000 + i, "a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "row_pos long, t_us long, cents long, source_account string, destination_account string")
    last = graph.vertex_statistics(df).filter("row_pos = 49").first()
    x = [r[2] for r in rows]
    assert last["src_out_variance"] == pytest.approx(statistics.pvariance(x) / 10000, rel=1e-3, abs=2000) and last["src_out_n"] == 50
