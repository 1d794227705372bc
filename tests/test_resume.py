"""Resumable extraction: only what is missing, stale or changed is made again, and the whole equals one pass."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidewater.functions.columns import DAY_US
from tidewater.operators import graph
from tidewater.session import cut
from tidewater.sources import resume, views

SIZE = 120


@pytest.fixture(scope="module")
def tx(spark):
    return cut(views.tx_events(spark, "/root/testdata/sf0.001"), "resume-tx")


@pytest.fixture
def kept(tx, tmp_path):
    path = f"file://{tmp_path}/parts"
    asked = []

    def compute(df):
        asked.append(df.agg(F.min("t_us"), F.max("t_us"), F.count("*")).first())
        return graph.fan_degree(df)

    run = lambda df=tx, **more: resume.extract(df, compute, path, **({"rows_per_part": SIZE, "reach_us": DAY_US, "at_once": 2} | more))
    read = lambda df=tx, **more: resume.read(df, path, **({"rows_per_part": SIZE, "reach_us": DAY_US} | more))
    return path, run, read, asked


def folder(path, part):
    found = list(__import__("pathlib").Path(path.removeprefix("file://")).glob(f"data/*/part={part}"))
    assert len(found) == 1
    return found[0]


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_parts_follow_the_rows_before_them(spark):
    at = [10, 10, 10, 20, 30, 30, 40, 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "row_pos long, t_us long")
    got = resume.plan(df, 2, None)
    assert [(p.first_us, p.last_us) for p in got] == [(10, 10), (20, 20), (30, 30), (40, 50)]  # 0, 3, 4, 6 and 7 rows before; an instant is never cut
    assert resume.plan(df.filter("t_us < 50"), 2, None)[:3] == got[:3]  # later rows change no earlier part
    moved = resume.plan(df.withColumn("t_us", F.when(F.col("row_pos") == 3, 21).otherwise(F.col("t_us"))), 2, 15)
    assert [a.source == b.source for a, b in zip(moved, resume.plan(df, 2, 15), strict=True)] == [True, False, False, True]  # 40 - 15 is past it
    assert resume.plan(df.limit(0), 2, None) == []
    with pytest.raises(ValueError, match="without a time"):
        resume.plan(df.withColumn("t_us", F.nullif("t_us", F.lit(20))), 2, None)


def test_a_deleted_part_is_made_again_alone(tx, kept):
    path, run, read, asked = kept
    made = run()
    assert made == list(range(len(made))) and len(made) > 4 and same(read(), graph.fan_degree(tx))
    assert run() == []
    shutil.rmtree(folder(path, 2))
    with pytest.raises(resume.IncompleteError, match="2"):
        read()
    asked.clear()
    assert run() == [2] and same(read(), graph.fan_degree(tx))
    assert len(asked) == 1 and asked[0][2] < tx.count()  # with the day before it, and nothing later


def test_a_run_cut_short_goes_on(tx, kept):
    path, run, read, asked = kept
    first = run(jobs=1)
    assert first == [0, 1]
    orphan = tx.limit(3).select("row_pos").withColumn("part", F.lit(4))  # what a killed batch leaves
    orphan.write.partitionBy("part").parquet(f"{path}/data/batch=half")
    rest = run()
    assert min(rest) == 2 and same(read(), graph.fan_degree(tx))
    assert not __import__("pathlib").Path(f"{path}/data/batch=half".removeprefix("file://")).exists()


def test_new_and_changed_transfers(tx, kept):
    path, run, read, _ = kept
    n = tx.count()
    run(tx.filter(F.col("row_pos") < n - 50))
    parts = resume.plan(tx, SIZE, DAY_US)
    early = tx.filter(F.col("row_pos") < n - 50).agg(F.max("t_us")).first()[0]
    stale = [p.part for p in parts if p.last_us >= early]
    made = run()
    assert 0 not in made and set(made) >= set(stale) and same(read(), graph.fan_degree(tx))
    changed = tx.withColumn("destination_account", F.when(F.col("row_pos") == n - 1, F.lit("A-new")).otherwise(F.col("destination_account")))
    again = run(changed)
    assert again == [parts[-1].part] and same(read(changed), graph.fan_degree(changed))
    assert len(run(changed, settings="other")) == len(parts)


def test_contents_are_compared_when_asked(spark, tx, kept):
    path, run, read, _ = kept
    run()
    at = folder(path, 1)
    other = spark.read.parquet(f"file://{at}").withColumn("fan_in", F.col("fan_in") + 1).collect()
    schema = spark.read.parquet(f"file://{at}").schema
    shutil.rmtree(at)
    spark.createDataFrame(other, schema).write.parquet(f"file://{at}")
    assert run() == [] and run(deep=True) == [1] and same(read(deep=True), graph.fan_degree(tx))


def test_nothing_to_extract(tx, kept):
    _, run, read, _ = kept
    assert run(tx.limit(0)) == []
    with pytest.raises(resume.IncompleteError):
        read(tx.limit(0))
