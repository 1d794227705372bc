"""Session settings, and shipping the package to Python workers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings the engine is tested with. Partition counts stay with the caller: they follow the data's size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


#: Rows that one task sorts, at most about, where the number of rows is known.
SORTED_ROWS = 1_000_000


def local_session(app: str = "tidewater", cores: str = "8", **more: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, spark-submit supplies the session."""
    settings = SETTINGS | {"spark.sql.shuffle.partitions": "8"} | more
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_tidewater_shipped", False):
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="tidewater-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(path)
    context._tidewater_shipped = True


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Without that setting a local session uses the warehouse folder; a cluster must name a shared one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write and reread `df` in the shared folder: recovery from lost executors restarts from files."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewater_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a frame from `cut` once everything made from it is written itself.

    Also lets the driver drop the shuffle files of finished queries, which otherwise stay until it happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tidewater_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def more_partitions(spark: SparkSession, rows: int) -> list[int]:
    """The number of partitions that so many rows need, as a first argument of repartition; none where the session's suffices."""
    parts = -(-rows // SORTED_ROWS)
    return [parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


def global_position(df: DataFrame, order: list[tuple[str, bool]], name: str, keep: list[str] | None = None, dealt_by: int | None = None, rows: int = 0) -> DataFrame:
    """Adds the 0-based position of each row under an order of (column, ascending), without a single-task window.

    Rows are dealt by ranges of the order, sorted and numbered inside their partition, and written; a
    partition's offset is the row count of those before it, a small table of one row a partition that is broadcast.
    Rows that tie on the whole order are numbered in any order. `keep` names the columns to write and return, all
    by default; the order may use more. `dealt_by` of the order's columns, all by default, bound the ranges: fewer make
    the sample cheaper, where few rows share their values. `rows`, where it is known, raises the session's number of
    partitions to one a `SORTED_ROWS`, so that no task's sort grows with the table.
    """
    directions = [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in order]
    spread = df.repartitionByRange(*more_partitions(df.sparkSession, rows), *directions[:dealt_by]).sortWithinPartitions(*directions)
    # monotonically_increasing_id numbers the rows of a partition from (partition << 33)
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    numbered = cut(spread.select(*kept, F.monotonically_increasing_id().alias("__at")), "positions")
    numbered = numbered.withColumn("__p", F.shiftright("__at", 33))
    counts = numbered.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__base"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = numbered.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__base") + inside)
    return placed.drop("__at", "__p", "__base")


def global_running(df: DataFrame, order: list[tuple[str, bool]], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Adds running totals (`name -> column`) over an order of the whole frame, or of each group, the current row included.

    Rows are dealt by ranges of (group, order), so a group of any size is spread; running totals are windows inside a
    partition, and a group that goes on from earlier partitions adds what it summed up to there: at most one row a
    partition, which is broadcast. Null values count as nothing.
    """
    by = by or []
    directions = [F.col(f"`{c}`").asc() for c in by] + [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in order]
    spread = df.repartitionByRange(*directions).sortWithinPartitions(*directions)
    numbered = cut(spread.withColumn("__at", F.monotonically_increasing_id()), "running").withColumn("__p", F.shiftright("__at", 33))
    parts = numbered.groupBy("__p", *by).agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col("__p").alias("__cp"), *[F.col(c).alias(f"__by_{c}") for c in by], F.sum("__n").over(earlier).alias("__any"),
        *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums],
    ).filter("__any IS NOT NULL")
    same = F.col("__p") == F.col("__cp")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inside = Window.partitionBy("__p", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = numbered.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    j = own.join(F.broadcast(carried), same, "left")
    return j.withColumns({n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in sums}).drop("__at", "__p", "__cp", "__any", *[f"__by_{c}" for c in by], *[f"__{n}" for n in sums])
