"""Resumable extraction: feature parts by ranges of time, a manifest of what each was made from, and only what is missing made again.

A part holds the transfers of whole instants; which part an instant belongs to depends on the rows before it alone, so
that later transfers change the last part and add others. A part's input is everything that its features may read:
its rows and those of the parts within `reach_us` before it. Parts are written a few at a time, each batch to a folder of
its own that the manifest names once it is complete: a run that is cut short keeps what it had entered, and half-written
folders are never read. What no entry names any more goes when nothing is missing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import global_running

MANIFEST = "version long, batch string, part long, first_us long, last_us long, source string, n long, content long"


class IncompleteError(ValueError):
    """Raised when parts are read that are missing, stale or changed."""


@dataclass(frozen=True)
class Part:
    """A range of time, both ends inclusive, and the digest of what its features are made from."""

    part: int
    first_us: int
    last_us: int
    source: str


def content_hash(df: DataFrame) -> Column:
    """An aggregate over rows in any order: a row's hash counts as often as the row does."""
    one = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return F.sum(F.pmod(one, F.lit((1 << 31) - 1))).alias("content")  # sums of 31 bits stay exact in a long


def assigned(tx: DataFrame, starts: list[int]) -> DataFrame:
    """Adds `part` by a binary search among the parts' first instants (whole microseconds are exact in a double)."""
    if len(starts) < 2:
        return tx.withColumn("part", F.lit(0).cast("long"))
    edges = [float("-inf"), *[float(s) for s in starts[1:]], float("inf")]
    found = Bucketizer(splits=edges, inputCol="__t", outputCol="__p").transform(tx.withColumn("__t", F.col("t_us").cast("double")))
    return found.withColumn("part", F.col("__p").cast("long")).drop("__t", "__p")


def plan(tx: DataFrame, rows_per_part: int, reach_us: int | None, settings: str = "") -> list[Part]:
    """The parts of a table in time order (a few numbers each) with the digest of their inputs."""
    if tx.filter("t_us IS NULL").limit(1).count():
        raise ValueError("transfers without a time belong to no part")
    counts = tx.groupBy("t_us").agg(F.count("*").alias("n"))
    before = global_running(counts, [("t_us", True)], {"upto": "n"}).withColumn("slot", F.floor((F.col("upto") - F.col("n")) / rows_per_part))
    ranges = before.groupBy("slot").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi")).orderBy("slot").collect()  # a row a part
    starts = [r.lo for r in ranges]
    hashes = {r.part: (r.n, r.content) for r in assigned(tx, starts).groupBy("part").agg(F.count("*").alias("n"), content_hash(tx)).collect()}
    out, first = [], 0
    for i, r in enumerate(ranges):
        while reach_us is not None and ranges[first].hi < r.lo - reach_us:
            first += 1
        text = "|".join([settings, str(reach_us), *[f"{ranges[k].lo}:{hashes[k]}" for k in range(first, i + 1)]])
        out.append(Part(i, r.lo, r.hi, hashlib.sha256(text.encode()).hexdigest()))
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each part; empty before the first."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except Exception as e:  # nothing was entered yet; anything else is not ours to hide
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    latest = entries.groupBy("part").agg(F.max_by(F.struct(*entries.columns), "version").alias("e"))
    return latest.select("e.*")


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows below the data folder with their batch and part; None before the first write."""
    try:
        return spark.read.parquet(f"{path}/data").withColumns({"batch": F.col("batch").cast("string"), "part": F.col("part").cast("long")})
    except Exception as e:
        if not any(k in str(e) for k in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return None


def _entered(files: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of the entries' folders; a row a part is broadcast, and prunes the others' files."""
    return files.join(F.broadcast(entries.select("batch", "part")), ["batch", "part"], "left_semi").drop("batch")


def _contents(files: DataFrame, deep: bool) -> dict[int, tuple[int, int | None]]:
    """(rows, content) by part: rows alone come from the files' footers."""
    content = content_hash(files.drop("part")) if deep else F.lit(None).cast("long").alias("content")
    return {r.part: (r.n, r.content) for r in files.groupBy("part").agg(F.count("*").alias("n"), content).collect()}


def missing(spark: SparkSession, parts: list[Part], path: str, deep: bool = False) -> list[Part]:
    """The parts that have to be made: not entered, made from other input, or with files that are not as entered.

    `deep` compares contents as well as counts of rows.
    """
    entries = manifest(spark, path)
    known = {r.part: r for r in entries.collect()}
    files = _files(spark, path)
    found = _contents(_entered(files, entries), deep) if files is not None else {}

    def whole(p: Part) -> bool:
        e = known.get(p.part)
        if e is None or e.source != p.source:
            return False
        n, content = found.get(p.part, (0, None))
        return n == e.n and (not deep or content == e.content)

    return [p for p in parts if not whole(p)]


def extract(
    tx: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, rows_per_part: int = 50_000_000, reach_us: int | None = None,
    settings: str = "", at_once: int = 8, deep: bool = False, jobs: int | None = None,
) -> list[int]:
    """Makes what is missing below `path` and returns the numbers of the parts made.

    `compute` takes transfers and returns rows keyed by `row_pos`, at most one for each of theirs; it looks back no further
    than `reach_us` (without it, over everything before). `settings` names what else the features depend on. `at_once`
    neighbouring parts are one job; `jobs` ends the run after so many.
    """
    spark = tx.sparkSession
    parts = plan(tx, rows_per_part, reach_us, settings)
    todo = missing(spark, parts, path, deep)
    version = (manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    batches: list[list[Part]] = []
    for p in todo:
        if batches and len(batches[-1]) < at_once and batches[-1][-1].part == p.part - 1:
            batches[-1].append(p)
        else:
            batches.append([p])
    made: list[int] = []
    for batch in batches[:jobs]:
        lo, hi = batch[0].first_us, batch[-1].last_us
        upto = tx.filter(F.col("t_us") <= hi)
        read = upto if reach_us is None else upto.filter(F.col("t_us") >= lo - reach_us)
        own = assigned(upto.filter(F.col("t_us") >= lo).select("row_pos", "t_us"), [p.first_us for p in batch])
        rows = compute(read).join(own.select("row_pos", (F.col("part") + batch[0].part).alias("part")), "row_pos")
        name = f"v{version}-{batch[0].part}-{uuid.uuid4().hex}"
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/data/batch={name}")
        done = spark.read.schema(rows.schema).parquet(f"{path}/data/batch={name}")
        found = _contents(done, deep=True)
        entries = [(version, name, p.part, p.first_us, p.last_us, p.source, *found.get(p.part, (0, None))) for p in batch]
        spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        made += [p.part for p in batch]
    if jobs is None:
        _discard_others(spark, path, parts)
    return made


def _discard_others(spark: SparkSession, path: str, parts: list[Part]) -> None:
    """Removes the folders that no part's latest entry names: replaced ones and those of runs that were cut short."""
    entries = manifest(spark, path).filter(F.col("part") < len(parts))
    named = {f"batch={r.batch}" for r in entries.select("batch").distinct().collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(root):
        for status in system.listStatus(root):
            if status.getPath().getName().startswith("batch=") and status.getPath().getName() not in named:
                system.delete(status.getPath(), True)


def read(tx: DataFrame, path: str, rows_per_part: int = 50_000_000, reach_us: int | None = None, settings: str = "", deep: bool = False) -> DataFrame:
    """The features of a table as extracted with the same parameters; refused while any part is missing or stale."""
    spark = tx.sparkSession
    parts = plan(tx, rows_per_part, reach_us, settings)
    if absent := missing(spark, parts, path, deep):
        raise IncompleteError(f"parts to be made again: {', '.join(str(p.part) for p in absent)}")
    entries = manifest(spark, path).filter(F.col("part") < len(parts))
    files = _files(spark, path)
    if files is None:
        raise IncompleteError("nothing was extracted")
    return _entered(files, entries).drop("part")
