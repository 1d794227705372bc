"""The pattern block: as many columns as labels, in their order, for each parameter set, with values of its parts."""

import random

import pytest

from tidewater.functions.columns import DAY_US, HOUR_US, pattern_columns
from tidewater.operators import graph, patterns

START = 1_700_000_000_000_000


@pytest.fixture(scope="module")
def tx(spark):
    rng = random.Random(5)
    rows = [(i, START + i * 20 * 60_000_000, rng.randint(1, 900), f"v{rng.randrange(7)}", f"v{rng.randrange(7)}") for i in range(60)]
    return spark.createDataFrame(rows, "row_pos long, t_us long, cents long, source_account string, destination_account string")


@pytest.mark.parametrize("name,width", [("default", 215), ("windowed", 215), ("paper", 235)])
def test_columns_are_the_labels(tx, name, width):
    p = patterns.PARAMETER_SETS[name]
    small = patterns.replace(p, window=min(p.window, DAY_US // 4), longest=3, longest_temporal=3)
    block = patterns.pattern_block(tx, small)
    names = [c for c, _ in pattern_columns(p.stat_columns)]
    assert block.columns == ["row_pos", *names] and len(names) == width
    rows = {r.row_pos: r for r in block.collect()}
    assert len(rows) == tx.filter("source_account <> destination_account").count()
    fan = {r.row_pos: r for r in graph.fan_degree(tx, small.clamped().fan).collect()}
    cycles: dict = {}
    for r in graph.cycles(tx, small.clamped().temporal_cycle, 3, ordered=True).collect():
        cycles[r.row_pos, r.length] = r.n
    for k, r in rows.items():
        assert sum(r[f"pat_fan_in_{b}"] for b in range(2, 31)) == (fan[k].fan_in >= 2)
        assert fan[k].fan_in < 2 or r[f"pat_fan_in_{min(fan[k].fan_in, 30)}"] == 1
        assert [r[f"pat_temporal_cycle_{b}"] for b in (2, 3, 4)] == [cycles.get((k, 2), 0), cycles.get((k, 3), 0), 0]
        assert r.pat_sender_outgoing_count >= 1 and r.pat_receiver_incoming_counterparties >= 1
    if "timestamp" in p.stat_columns:
        first = rows[min(rows)]
        assert first.pat_sender_outgoing_timestamp_mean == (START + min(rows) * 20 * 60_000_000) // 1_000_000


def test_windows_are_clamped():
    wide = patterns.PARAMETER_SETS["windowed"].clamped()
    assert (wide.statistics, wide.temporal_cycle, wide.simple_cycle, wide.fan) == (2 * DAY_US, 2 * DAY_US, 2 * DAY_US, DAY_US)
    assert patterns.PARAMETER_SETS["paper"].clamped().scatter_gather == 6 * HOUR_US
    assert patterns.PARAMETER_SETS["default"].clamped().temporal_cycle == 3 * DAY_US
