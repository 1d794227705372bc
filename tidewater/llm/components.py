"""Connected components of an edge table, by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """`(node, root)` for every node of the undirected edges `(a, b)`; the root is the least node reachable.

    Large-star and small-star rounds (each a group-by with map-side combining of minima and one join) until
    nothing changes; a few rounds even for long chains. No edge list reaches the driver.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = cut(edges.select("a", "b").filter("a <> b").distinct(), label)
    before = None
    while not current.isEmpty():
        # large star: every larger neighbour of a node points to the least of the node and its neighbours
        pairs = both(current)
        least = pairs.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours point to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        following = cut(small.filter("a <> b").distinct(), label)
        state = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        current = following
        if state == before:
            break
        before = state
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
