"""Order-dependent building blocks that don't gather a table in one task.

A global running sum, an as-of join and a lookup of the range that holds a number each work
on buckets of the ordering number; what crosses buckets is carried by a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, order: str, value: Column, out: str, width: int = 1 << 14, keys: list[str] | None = None) -> DataFrame:
    """Adds `out`, the sum of value over the rows before in `order` (a whole number), within keys.

    width: the span of `order` that one bucket holds.
    """
    keys = keys or []
    own = df.withColumn("_bucket", F.floor(F.col(order) / width)).withColumn("_value", value)
    before = Window.unboundedPreceding
    sums = own.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    carried = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(before, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("_value").over(Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(before, -1)), F.lit(0))
    return own.withColumn("_inside", inside).join(carried, [*keys, "_bucket"]).withColumn(out, F.col("_inside") + F.col("_before")).drop("_bucket", "_value", "_inside", "_before")


def holding_range(points: DataFrame, point: str, ranges: DataFrame, first: str, last: str, width: int = 256) -> DataFrame:
    """points joined with the one of the disjoint ranges [first, last] that holds them: an equi-join on buckets."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    return points.withColumn("_cell", F.floor(F.col(point) / width)).join(cells, "_cell").where(F.col(point).between(F.col(first), F.col(last))).drop("_cell")


def as_of(versions: DataFrame, probes: DataFrame, keys: list[str], time: str, at: str, values: list[str], width: int = 1 << 16) -> DataFrame:
    """Every row of probes with the values of the newest version at or before `at` of its keys, or nulls.

    Versions and probes share buckets of time; the last version of earlier buckets is carried
    on, so that a key with most of the rows is spread over its buckets.
    """
    state = F.struct(*values)
    left = versions.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_probe"), state.alias("_state"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("_row"))
    right = probes.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.lit(None).cast(versions.select(state).schema[0].dataType).alias("_state"), F.struct("*").alias("_row"))
    both = left.unionByName(right).withColumn("_bucket", F.floor(F.col("_t") / width))
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_near", F.last("_state", ignorenulls=True).over(upto))
    ends = both.groupBy(*keys, "_bucket").agg(F.max_by("_state", F.when(F.col("_probe") == 0, F.col("_t"))).alias("_end"))
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    found = both.where("_probe = 1").join(carried, [*keys, "_bucket"])
    picked = F.coalesce("_near", "_carried")
    return found.select("_row.*", *(picked[v].alias(v) for v in values))


def newest(df: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """The newest row of each key, as a hash aggregation that combines before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(time, *values), time).alias("_v")).select(*keys, "_v.*")
