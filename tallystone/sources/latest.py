"""The latest state: runs of sorted keys under an overlay that isn't written yet.

A run holds a key once, ascending, keys of 1 to 255 bytes and values of at most 255; an
empty value is a tombstone, which hides what older runs have. Reads see the overlay over the
newest run over older ones. A roll freezes the overlay, merges everything into a new run,
checks it against what the reads gave, and swaps it in by the corpus's manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.sources.shared import shared_uri, written

ROWS = "key binary, val binary"


def checked(rows: DataFrame) -> DataFrame:
    """The rows, if every key comes once and sizes fit; else an error when they are read."""
    size, val = F.octet_length("key"), F.coalesce(F.octet_length("val"), F.lit(0))
    bad = size.isNull() | ~size.between(1, 255) | (val > 255)
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.first("val").alias("val"))
    held = counted.withColumn("key", F.when(bad | (F.col("n") > 1), F.raise_error(F.lit("a key comes twice or doesn't fit"))).otherwise(F.col("key")))
    return held.select(F.col("key").cast("binary"), "val")


class Latest:
    """Latest values by key; keys sort as bytes do."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or shared_uri(spark, "latest")
        self.runs: list[str] = []  # oldest first
        self.levels: list[DataFrame] = []  # of the overlay, oldest first

    def put(self, rows: DataFrame) -> None:
        """Rows (key, val) that win over all before them; null or empty values are tombstones."""
        self.levels.append(written(checked(rows.select("key", "val")), "overlay"))

    def _stacked(self, overlay_only: bool = False) -> DataFrame:
        tables = ([] if overlay_only else [self.spark.read.schema(ROWS).parquet(r) for r in self.runs]) + self.levels
        out = self.spark.createDataFrame([], ROWS).withColumn("level", F.lit(-1))
        for k, t in enumerate(tables):
            out = out.unionByName(t.withColumn("level", F.lit(k)))
        return out.groupBy("key").agg(F.max_by(F.struct("val"), "level").alias("v")).select("key", "v.val")

    def get(self, keys: DataFrame) -> DataFrame:
        """Each key asked (key) with its value, null for none."""
        return keys.join(self._live(self._stacked()), "key", "left")

    @staticmethod
    def _live(rows: DataFrame) -> DataFrame:
        return rows.where(F.octet_length("val") > 0)

    def rows(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Live rows from low on and below high, in order: the newest wins, tombstones are dropped."""
        own = self._live(self._stacked())
        own = own if low is None else own.where(F.col("key") >= F.lit(low))
        return (own if high is None else own.where(F.col("key") < F.lit(high))).orderBy("key")

    def overlay_size(self) -> tuple[int, int]:
        """Keys and bytes that the overlay holds, tombstones included."""
        n, size = self._stacked(True).agg(F.count("*"), F.sum(F.octet_length("key") + F.coalesce(F.octet_length("val"), F.lit(0)))).head()
        return n, size or 0

    def checkpoint(self) -> str:
        """Everything live as a new run; its folder."""
        path = f"{self.folder}/run-{len(self.runs):06d}-{len(self.levels):06d}"
        rows = self._live(self._stacked())
        checked(rows).repartitionByRange(F.col("key")).sortWithinPartitions("key").write.mode("overwrite").parquet(path)
        return path

    def roll(self, verify=None) -> str:
        """Freeze the overlay, merge it into a new run, verify, swap; what is put meanwhile stays in the overlay.

        verify(rows): raises if the merged rows aren't right, which leaves everything as it was.
        """
        frozen = len(self.levels)
        path = self.checkpoint()
        merged, want = self.spark.read.schema(ROWS).parquet(path), self._live(self._stacked())
        mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("key", "val"))).head())
        if mark(merged) != mark(want):
            raise ValueError("the merged run isn't what the reads give")
        if verify:
            verify(merged)
        self.runs, self.levels = [path], self.levels[frozen:]
        return path
