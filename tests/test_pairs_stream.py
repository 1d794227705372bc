"""Pair counts of a stream against the batch columns, from the first transfer and from counts of the past."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import history
from tidewater.streaming import pairs

SCHEMA = "row_pos long, t_us long, source_account string, destination_account string, cents long"
COLUMNS = ["row_pos", "bh_pair_n_prior", "bh_reverse_pair_n_prior"]


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, pairs.ROCKSDB)
    yield
    spark.conf.set(key, old)


@pytest.fixture(scope="module")
def tx(spark):
    rng = random.Random(3)
    rows = [(i, 1_700_000_000_000_000 + 60_000_000 * (i // 3), f"N{rng.randrange(4)}", f"N{rng.randrange(4)}", 100) for i in range(90)]
    return spark.createDataFrame(rows, SCHEMA)


def streamed(spark, path, parts, past=None, late_us=0):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"file://{path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{path}/in")
        q = pairs.pair_history(stream, past, late_us).writeStream.format("parquet").option("checkpointLocation", f"file://{path}/cp")
        q.trigger(availableNow=True).start(f"file://{path}/out").awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"file://{path}/out").collect())


def test_batches_cut_inside_an_instant_equal_the_batch(spark, tx, tmp_path):
    want = sorted(tuple(r) for r in history.behaviour(tx).select(*COLUMNS).collect())
    upto = lambda lo, hi: tx.filter(F.col("row_pos").between(lo, hi - 1))
    assert streamed(spark, tmp_path, [upto(0, 31), upto(31, 62), upto(62, 90)]) == want  # 31 and 62 cut instants of three


def test_a_warm_start_needs_no_replay(spark, tx, tmp_path):
    want = sorted(tuple(r) for r in history.behaviour(tx).select(*COLUMNS).collect() if r.row_pos >= 45)
    past = pairs.past_counts(tx.filter("row_pos < 45"))
    upto = lambda lo, hi: tx.filter(F.col("row_pos").between(lo, hi - 1))
    assert streamed(spark, tmp_path, [upto(45, 70), upto(70, 90)], past) == want


def test_late_events_count_from_their_own_time(spark, tx, tmp_path):
    late, rest = tx.filter("row_pos IN (20, 21)"), tx.filter("row_pos NOT IN (20, 21) AND row_pos < 40")
    got = {r[0]: r[1:] for r in streamed(spark, tmp_path, [rest, late], late_us=3_600_000_000)}
    want = {r.row_pos: (r.bh_pair_n_prior, r.bh_reverse_pair_n_prior) for r in history.behaviour(tx).select(*COLUMNS).collect()}
    assert {k: got[k] for k in (20, 21)} == {k: want[k] for k in (20, 21)} and len(got) == 40


def test_many_pairs_are_few_states(spark, tmp_path):
    """A state a pair costs a call of the Python worker a pair; held pairs, new ones and those of the past share a group."""
    rng = random.Random(9)
    rows = [(i, 1_700_000_000_000_000 + 60_000_000 * (i // 3), f"N{rng.randrange(40)}", f"N{rng.randrange(40)}", 100) for i in range(600)]
    tx = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in history.behaviour(tx).select(*COLUMNS).collect() if r.row_pos >= 300)
    past = pairs.past_counts(tx.filter("row_pos < 300"))
    held = []
    for part in ("row_pos BETWEEN 300 AND 450", "row_pos > 450"):  # 300 opens an instant, 451 goes on with one
        tx.filter(part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        rows = pairs.pair_history(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in"), past, groups=8)
        q = rows.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out")
        q.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]
    assert max(held) <= 8
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == want
