"""Helpers shared by the training-data operators: shared folders, cut lineage, even splits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: paths given out by shared_uri, in order
MADE: list[str] = []


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which every executor reaches.

    A local session without that setting (a test) gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="tallystone-")
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def discard(spark: SparkSession, since: int, keep: str) -> None:
    """Deletes the intermediate tables made since MADE had that length, but for one; nothing may read them any more."""
    for path in MADE[since:]:
        if path != keep:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    MADE[since:] = [keep]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages don't depend on executors."""
    spark, path = df.sparkSession, shared_uri(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stated_bytes(df: DataFrame) -> int:
    """The size of a table as its plan states it, without a job; 0 if the plan doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def split_points(df: DataFrame, key: str, parts: int) -> list[int]:
    """Distinct ascending quantiles that cut a numeric key into at most `parts` even ranges.

    One aggregation over the key column alone; `parts` numbers come to the driver.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, at, 20 * parts).alias("q")).head()
    return sorted(set((got and got["q"]) or []))


def range_of(key: str, points: list[int]) -> Column:
    """Index of the range that holds column `key`, 0 for null; a pure function of it, found by halving."""

    def within(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"if({key} < {int(points[middle])}L, {within(low, middle)}, {within(middle + 1, high)})"

    return F.expr(f"if({key} is null, 0, {within(0, len(points))})")
