"""Work that must grow with the input: rows shuffled and tasks run, counted by Spark, and the same results as plain Python."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater import session
from tidewater.operators import ablation, graph, history, model, patterns
from tidewater.plans import catalog, models
from tidewater.sources import views

START = 1_700_000_000_000_000
MIN = 60_000_000
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "row_pos long, t_us long, source_account string, destination_account string, cents long"


@pytest.fixture
def shuffled(spark):
    """Runs a function and tells how many rows its jobs put into shuffles."""

    def run(work):
        group, key = f"growth-{random.random()}", "spark.sql.autoBroadcastJoinThreshold"
        threshold = spark.conf.get(key)
        spark.conf.set(key, "-1")  # else small tables meet without a shuffle
        spark.sparkContext.setJobGroup(group, "growth")
        try:
            found = work()
        finally:
            spark.conf.set(key, threshold)
        tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)

    return run


def plain_scatter_gather(rows, width):
    """Every closing edge against every earlier edge, as the definition has it."""
    e = [r for r in rows if r[2] != r[3]]
    found = Counter()
    for pos, t, mid, w, _ in e:
        past = [x for x in e if (x[1], x[0]) < (t, pos) and x[1] >= t - width]
        for u in {x[2] for x in past if x[3] == mid and x[2] != w}:
            others = {g[2] for g in past if g[3] == w and g[2] not in (u, mid) and any(s[2] == u and s[3] == g[2] and t - width <= s[1] <= g[1] for s in e)}
            if others:
                found[pos, len(others) + 1] += 1
    return sorted((*k, n) for k, n in found.items())


def test_scatter_gather_is_its_definition(spark):
    """Instants of three transfers, windows that paths leave, and sizes up to five."""
    rng = random.Random(4)
    rows = [(i, START + (i // 3) * 7 * MIN, f"N{rng.randrange(7)}", f"N{rng.randrange(7)}", 100) for i in range(150)]
    want = plain_scatter_gather(rows, 60 * MIN)
    assert len({size for _, size, _ in want}) > 2
    assert sorted(tuple(r) for r in graph.scatter_gather(spark.createDataFrame(rows, SCHEMA).repartition(5), 60 * MIN).collect()) == want


def test_scatter_gather_of_a_hub_is_not_quadratic(spark, shuffled):
    """400 pay the hub, 400 others pay the shop, and the hub pays the shop: 400 roots, none of which meets the 400 gathers."""
    pairs = [(f"U{i}", "hub") for i in range(400)] + [(f"V{i}", "shop") for i in range(400)] + [("hub", "shop"), ("U1", "V1"), ("V1", "shop"), ("hub", "shop")]
    tx = spark.createDataFrame([(i, START + i, s, d, 100) for i, (s, d) in enumerate(pairs)], SCHEMA)
    found, rows = shuffled(lambda: sorted(tuple(r) for r in graph.scatter_gather(tx).collect()))
    assert found == [(802, 2, 1), (803, 2, 1)]
    assert rows < 20 * len(pairs)


def test_cycles_read_the_transfers_once(spark):
    """Once for the edges and once for the accounts that receive, however long the cycles are."""
    read = spark.sparkContext.accumulator(0)

    def counted(t):
        read.add(1)
        return t

    rows = [(i, START + (12 - i) * MIN, f"N{i}", f"N{(i + 1) % 12}", 100) for i in range(12)]  # one ring, closed by its last edge
    tx = spark.createDataFrame(rows, SCHEMA).withColumn("t_us", F.udf(counted, "long")("t_us"))
    assert [tuple(r) for r in graph.cycles(tx, longest=None, ordered=False).collect()] == [(0, 12, 1)]
    assert read.value <= 2 * len(rows)


def test_pattern_block_reads_the_transfers_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(t):
        read.add(1)
        return t

    rows = [(i, START + i * MIN, f"N{i % 5}", f"N{(i + 1) % 5}", 100) for i in range(20)]
    tx = spark.createDataFrame(rows, SCHEMA).withColumn("t_us", F.udf(counted, "long")("t_us"))
    small = patterns.PatternParams(window=60 * MIN, longest=2, longest_temporal=2)
    assert patterns.pattern_block(tx, small).count() == len(rows)
    assert read.value == len(rows)


def test_a_sort_of_known_size_has_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(session, "SORTED_ROWS", 50)
    placed = session.global_position(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), [("x", True)], "at", rows=1000)
    assert placed.filter("x <> at").count() == 0
    assert len(placed.inputFiles()) > 10  # 4 partitions are the session's


def test_duplicates_are_counted_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(views, "global_position", None)
    found = catalog.QUERIES["e4_duplicate_natural_key"](spark, SMALL).collect()
    assert len(found) == 1 and found[0].duplicates >= 0


@pytest.mark.parametrize("name,most", [("h2_fan_degree_ties", 6), ("f_behaviour_ties", 8)])
def test_line_items_meet_their_orders_once(spark, shuffled, monkeypatch, name, most):
    """Rows shuffled for a line item, with the hubs looked for in a table of their own, as in a large one."""
    monkeypatch.setattr(history if name.startswith("f_") else graph, "hubs", lambda df, limit: df.groupBy("source_account").count().filter("count < 0").isEmpty() and None)
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    found, rows = shuffled(lambda: catalog.QUERIES[name](spark, SMALL).count())
    assert found == n and rows < most * n


def test_parts_come_from_the_transfers(spark, shuffled, monkeypatch):
    """The histories are made once, not again for the split's bounds and for each pass of a fit."""
    made = []
    behaviour = history.behaviour
    monkeypatch.setattr(history, "behaviour", lambda df: made.append(spark.sparkContext.accumulator(0)) or behaviour(counted(df, made[-1])))

    def counted(df, read):
        def seen(t):
            read.add(1)
            return t

        return df.withColumn("t_us", F.udf(seen, "long")("t_us"))

    tx = views.tx_events(spark, SMALL)
    n, reads = tx.count(), 3  # hubs are ruled out by a count, both ends, pairs
    split, columns = models._split_features(tx)
    assert {"split", "t_us"} < set(split.columns) and len(columns) == 20 and split.count() == n and made[0].value <= reads * n
    hints = catalog.QUERIES["j9_typology_hint"](spark, MIDDLE)
    assert hints.count() > 0 and made[1].value <= reads * spark.read.parquet(f"{MIDDLE}/events.parquet").count()


def _counting(spark, df, column, kind="double"):
    """`df` with a column that counts how often it is read."""
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    return df.withColumn(column, F.udf(seen, kind)(column)), read


def test_ablation_table_reads_the_transfers_once(spark):
    tx, read = _counting(spark, views.tx_events(spark, SMALL), "amount")
    data, _ = ablation.table(tx)
    assert data.count() == tx.count() == read.value


def test_seeds_share_the_vectors_of_an_arm(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.2), rng.choice(["train", "train", "val", "test"]), rng.random(), rng.random()) for i in range(400)]
    data, read = _counting(spark, spark.createDataFrame(rows, "row_pos long, is_laundering int, split string, tx_a double, tx_b double").repartition(3), "tx_a")
    runs = ablation.run(data, ["tx_a", "tx_b"], [ablation.Arm("A", "", ("tx_",))], (1, 2), ablation.trees(2, 2))
    assert {(r.arm, r.seed) for r in runs.collect()} == {("A", 1), ("A", 2)}
    assert read.value == len(rows)
    vectors = model.assembled(data, ["tx_a", "tx_b"])
    with pytest.raises(ValueError, match="other features"):
        model.assemble(vectors, ["tx_b", "tx_a"])


def test_adaptive_peers_by_hand(spark):
    """Middles of odd, even and single groups, nulls, and a fit on some of the rows next to one on all."""
    sent = [("a", "x", 1.0, True), ("a", "x", 4.0, True), ("a", "y", 2.0, False), ("b", "x", 7.0, True), ("b", None, None, True), ("c", "y", 9.0, False)]
    df = spark.createDataFrame(sent, "source_account string, destination_account string, amount double, early boolean").coalesce(1)
    seen = [(0, F.col("__in0")), (1, F.col("__in1"))]
    rows = df.withColumns({"__in0": F.col("early"), "__in1": F.lit(True)})
    own = {r["__a"]: (r["__own0"], r["__own1"]) for r in graph._own_medians(rows, seen).collect()}
    assert own == {"a": (2.5, 2.0), "b": (7.0, 7.0), "c": (None, 9.0)}
    out = spark.createDataFrame([("a", 2, 3), ("b", 2, 2), ("c", 1, 2)], "__a string, __bucket0 int, __bucket1 int")
    peers = {(r.fit, r.bucket): (r.median, r.sd) for r in graph._peers(rows, out, seen).collect()}
    assert peers == {(0, 2): (4.0, pytest.approx(3.0)), (1, 3): (2.0, pytest.approx(statistics.stdev([1, 4, 2]))), (1, 2): (8.0, pytest.approx(statistics.stdev([7, 9])))}


def test_mean_contributions_are_made_once(spark):
    df, read = _counting(spark, spark.createDataFrame([(1.0, -3.0), (-2.0, 5.0)], "tx_a double, bh_b double"), "tx_a")
    got = {r.feature: (r.family, r.mean_abs, r.share) for r in model.mean_absolute(df, ["tx_a", "bh_b"]).collect()}
    assert got == {"tx_a": ("tx", 1.5, pytest.approx(1.5 / 5.5)), "bh_b": ("bh", 4.0, pytest.approx(4 / 5.5))} and read.value == 2
