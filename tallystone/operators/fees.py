"""Fee statistics. Their index rules are not those of SQL percentiles, so ranks are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators.ledger import effective_price, effective_tip

MOST_BLOCKS = 20
ENOUGH_PRICES = 100
MOST_HISTORY = 1024
MOST_REWARDS = 128
TIP_CAP = 20 * 10**9


def oracle_price(blocks: DataFrame, txs: DataFrame, floor: int) -> DataFrame:
    """The price at place n * 60 / 100 of the newest prices, ascending.

    Newest non-empty blocks, at most 20, until they hold 100 prices: asked between blocks, so
    the last may overshoot. No prices give the floor.
    """
    recent = blocks.where("tx_count > 0").orderBy(F.desc("height")).limit(MOST_BLOCKS)
    before = Window.orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, -1)  # 20 rows
    used = recent.withColumn("seen", F.coalesce(F.sum("tx_count").over(before), F.lit(0))).where(F.col("seen") < ENOUGH_PRICES)
    prices = txs.join(F.broadcast(used.select("height", "base_fee")), "height").select(effective_price().alias("price"))
    listed = prices.agg(F.array_sort(F.collect_list("price")).alias("p"))  # of 20 blocks at most
    return listed.select(F.when(F.size("p") > 0, F.get("p", F.floor(F.size("p") * 60 / 100).cast("int"))).otherwise(F.lit(floor)).alias("price"))


def rewards(blocks: DataFrame, txs: DataFrame, percentiles: list[float]) -> DataFrame:
    """Gas-weighted tip percentiles of every block given, zeros for an empty one.

    By tip, the first transaction at which the gas so far reaches the truncated share of the
    header's gas, or the last.
    """
    if any(not 0 <= p <= 100 for p in percentiles) or sorted(percentiles) != percentiles:
        raise ValueError("percentiles ascend between 0 and 100")
    joined = txs.join(blocks.select("height", "base_fee", F.col("gas_used").alias("block_gas")), "height").withColumn("tip", effective_tip())
    by_tip = Window.partitionBy("height").orderBy("tip", "tx_index").rowsBetween(Window.unboundedPreceding, 0)
    summed = joined.withColumn("gas_so_far", F.sum("gas_used").over(by_tip))
    picks = []
    for i, p in enumerate(percentiles):
        reached = F.col("gas_so_far") >= F.floor(F.col("block_gas") * F.lit(float(p)) / 100)
        picks.append(F.coalesce(F.min(F.when(reached, F.col("tip"))), F.max("tip")).alias(f"reward_{i}"))
    found = summed.groupBy("height").agg(*picks)
    zeros = {f"reward_{i}": F.coalesce(F.col(f"reward_{i}"), F.lit(0)) for i in range(len(percentiles))}
    return blocks.select("height").join(found, "height", "left").withColumns(zeros)


def history(blocks: DataFrame, txs: DataFrame, count: int, newest: int, percentiles: list[float]) -> DataFrame:
    """Base fee, gas ratio and rewards of the `count` blocks up to newest."""
    if percentiles and count > MOST_REWARDS:
        raise ValueError(f"at most {MOST_REWARDS} blocks with percentiles")
    count = min(count, MOST_HISTORY, newest + 1)
    part = blocks.where(F.col("height").between(newest - count + 1, newest))
    ratio = F.when(F.col("gas_limit") == 0, F.lit(0.0)).otherwise(F.col("gas_used") / F.col("gas_limit"))
    base = part.select("height", "base_fee", ratio.alias("ratio"))
    return base.join(rewards(part, txs.where(F.col("height").between(newest - count + 1, newest)), percentiles), "height") if percentiles else base


def base_fees(blocks: DataFrame, count: int, newest: int) -> DataFrame:
    """count + 1 base fees: of the blocks up to newest and of the one after it, null if that is above the head (no rule is known here)."""
    count = min(count, MOST_HISTORY, newest + 1)
    asked = blocks.sparkSession.range(newest - count + 1, newest + 2).withColumnRenamed("id", "height")  # 1025 rows at most
    return asked.join(blocks.where(F.col("height").between(newest - count + 1, newest + 1)).select("height", "base_fee"), "height", "left")


def suggestions(price: DataFrame, base_fee: int, next_base: int) -> DataFrame:
    """Slow, normal and fast tips and their fee caps out of one sampled price.

    The tip is the price less the base fee, at least 0; it is capped, but the fast one is
    105 % of the tip before the cap.
    """
    tip = F.greatest(F.col("price") - base_fee, F.lit(0))
    capped = F.least(tip, F.lit(TIP_CAP))
    picks = {"slow": F.greatest(F.floor(capped * 95 / 100), F.lit(1)), "normal": capped, "fast": F.floor(tip * 105 / 100)}
    return price.select("price", *(c.cast("long").alias(f"{k}_tip") for k, c in picks.items()), *((c + 2 * next_base).cast("long").alias(f"{k}_cap") for k, c in picks.items()))


def least_passing(low: int, high: int, passes) -> int | None:
    """The least number in (low, high] that passes, for a test that stays passed; None if high fails. Errors of the test end the search."""
    if not passes(high):
        return None
    while low + 1 < high:
        middle = (low + high) // 2
        if passes(middle):
            high = middle
        else:
            low = middle
    return high
