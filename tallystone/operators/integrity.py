"""Checks that a corpus is whole. Each gives its offending rows; `verified` turns them into a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def broken_links(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent hash isn't the hash of the block below; the lowest block is the anchor."""
    below = blocks.select((F.col("height") + 1).alias("height"), F.col("hash").alias("below"))
    return blocks.join(below, "height", "left").where((F.col("height") > 0) & ~F.col("below").eqNullSafe(F.col("parent_hash")))


def torn_slots(blocks: DataFrame) -> DataFrame:
    """Blocks that don't start right after the boundary slot of the block below."""
    below = blocks.select((F.col("height") + 1).alias("height"), F.col("boundary_tx").alias("below"))
    return blocks.join(below, "height").where(F.col("first_tx") != F.col("below") + 1)


def sparse_blocks(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Blocks whose rows aren't as many as the header says, and rows of unknown blocks."""
    counts = rows.groupBy("height").agg(F.count("*").alias("rows"))
    return blocks.select("height", "tx_count").join(counts, "height", "full").where(~F.coalesce("rows", F.lit(0)).eqNullSafe(F.col("tx_count")))


def roots_without_rows(changed: DataFrame, rows: DataFrame) -> DataFrame:
    """Heights whose root changed though no state row lies in their slots."""
    return changed.join(rows.select("height").distinct(), "height", "left_anti")


def band_sample(blocks: DataFrame, bands: int, per_band: int) -> DataFrame:
    """A reproducible sample: the blocks of least hash in each band of height, per_band of them wherever a band has so many.

    The least of each part of a band are found first, so that no task ranks a whole band.
    """
    total = F.broadcast(blocks.agg(F.count("*").alias("total")))
    banded = blocks.crossJoin(total).withColumns({"band": F.floor(F.col("height") * bands / F.col("total")), "part": F.substring("hash", 1, 2)})
    least = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
    near = banded.withColumn("rk", least("band", "part")).where(F.col("rk") <= per_band)
    return near.withColumn("rk", least("band")).where(F.col("rk") <= per_band)


def verified(bad: DataFrame, walked: int) -> None:
    """Raises if there is an offending row, and if nothing was walked at all."""
    if walked == 0:
        raise ValueError("nothing was walked")
    if rows := bad.limit(5).collect():
        raise ValueError(f"broken: {rows}")
