"""Blocks, transactions and receipts: assembly, look-ups, pages and totals.

Canonical columns. blocks: height, first_tx, tx_count, boundary_tx, base_fee, gas_used,
gas_limit, hash, parent_hash. txs: txnum, height, tx_index, tx_hash, sender, recipient,
emitter, nonce, status, gas_used, gas_limit, fee_cap, tip_cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators.scaling import holding_range, running_sum


def assign_slots(blocks: DataFrame) -> DataFrame:
    """first_tx and boundary_tx of blocks with height and tx_count: a block of n takes n + 1 slots."""
    slotted = running_sum(blocks, "height", F.col("tx_count") + 1, "first_tx").withColumn("first_tx", F.col("first_tx").cast("long"))
    return slotted.withColumn("boundary_tx", F.col("first_tx") + F.col("tx_count"))


def rows_between(df: DataFrame, key: str, first: int, last: int, half_open: bool = False) -> DataFrame:
    """Rows of a key range, both ends included unless half open; missing rows are just absent."""
    return df.where((F.col(key) >= first) & ((F.col(key) < last) if half_open else (F.col(key) <= last)))


def by_hash(wanted: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Each wanted hash with its row, nulls for an unknown one."""
    return wanted.join(table, wanted["wanted"] == table[column], "left").drop(column)


def height_of(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """The height whose slots, boundary slot included, hold each txnum."""
    return holding_range(points, "txnum", blocks.select("height", "first_tx", "boundary_tx"), "first_tx", "boundary_tx").select("txnum", "height")


def effective_price() -> Column:
    return F.least(F.col("fee_cap"), F.col("tip_cap") + F.col("base_fee"))


def effective_tip() -> Column:
    """Refuses a cap below the base fee."""
    short = F.col("fee_cap") < F.col("base_fee")
    return F.when(short, F.raise_error(F.lit("fee cap below base fee")).cast("long")).otherwise(F.least(F.col("tip_cap"), F.col("fee_cap") - F.col("base_fee")))


def cumulative_gas() -> Column:
    """Gas of a block's transactions up to each."""
    return F.sum("gas_used").over(Window.partitionBy("height").orderBy("tx_index").rowsBetween(Window.unboundedPreceding, 0))


def receipts(txs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Receipts with cumulative gas and price; a block whose count disagrees with its rows is an error."""
    in_block = Window.partitionBy("height")
    joined = txs.join(blocks.select("height", "base_fee", "tx_count"), "height")
    counted = joined.withColumn("_n", F.count("*").over(in_block)).withColumn("cumulative_gas", cumulative_gas())
    checked = counted.withColumn("tx_count", F.when(F.col("_n") == F.col("tx_count"), F.col("tx_count")).otherwise(F.raise_error(F.lit("block and rows disagree")).cast("long")))
    return checked.select("txnum", "height", "tx_index", "tx_hash", "status", "gas_used", "cumulative_gas", effective_price().alias("price"), "tx_count")


def assembled(blocks: DataFrame, txs: DataFrame) -> DataFrame:
    """Headers with their transactions' hashes in order; blocks without any keep an empty list."""
    lists = txs.groupBy("height").agg(F.array_sort(F.collect_list(F.struct("tx_index", "tx_hash"))).alias("l")).select("height", F.transform("l", lambda x: x["tx_hash"]).alias("hashes"))
    return blocks.join(lists, "height", "left").withColumn("hashes", F.coalesce("hashes", F.array().cast("array<string>")))


def block_details(blocks: DataFrame, txs: DataFrame) -> DataFrame:
    """Transactions and total fees of every block; issuance is always 0."""
    fees = txs.join(blocks.select("height", "base_fee"), "height").groupBy("height").agg(F.sum(effective_price() * F.col("gas_used")).alias("fees"))
    return blocks.join(fees, "height", "left").select("height", "tx_count", F.coalesce("fees", F.lit(0)).alias("total_fees"), F.lit(0).alias("issuance"))


def page_of_block(txs: DataFrame, height: int, page: int, size: int) -> DataFrame:
    """A page of a block's transactions; past the end it is empty."""
    return txs.where((F.col("height") == height) & (F.col("tx_index") >= page * size) & (F.col("tx_index") < (page + 1) * size))


def head(blocks: DataFrame) -> DataFrame:
    """Number and hash of the newest block, and the chain's transactions: slots less boundary slots."""
    best = blocks.agg(F.max_by(F.struct("height", "hash", "boundary_tx"), "height").alias("h"), F.count("*").alias("n"))
    return best.select("h.height", "h.hash", (F.col("h.boundary_tx") - (F.col("n") - 1)).alias("txs"))


def by_sender_and_nonce(txs: DataFrame, sender: int, nonce: int) -> DataFrame:
    """The sender's transaction of that nonce; no row if its first nonce at or above is another."""
    first = txs.where((F.col("sender") == sender) & (F.col("nonce") >= nonce)).orderBy("nonce").limit(1)
    return first.where(F.col("nonce") == nonce)


def consumed_gas(blocks: DataFrame, txs: DataFrame) -> DataFrame:
    """Header gas less the limits plus the last cumulative gas; below zero is an error."""
    sums = txs.groupBy("height").agg(F.sum("gas_limit").alias("limits"), F.sum("gas_used").alias("last_cumulative"))
    value = F.col("gas_limit") - F.coalesce("limits", F.lit(0)) + F.coalesce("last_cumulative", F.lit(0))
    return blocks.join(sums, "height", "left").select("height", F.when(value < 0, F.raise_error(F.lit("negative gas")).cast("long")).otherwise(value).alias("consumed"))


def swept(blocks: DataFrame, first: int, last: int, every: int) -> DataFrame:
    """Running gas and transactions over a height range, at each multiple of `every` and at the end."""
    part = rows_between(blocks, "height", first, last)
    summed = running_sum(running_sum(part, "height", F.col("gas_used"), "g"), "height", F.col("tx_count"), "t")
    return summed.where((F.col("height") % every == 0) | (F.col("height") == last)).select("height", (F.col("g") + F.col("gas_used")).cast("long").alias("gas"), (F.col("t") + F.col("tx_count")).cast("long").alias("txs"))


def ancestors(blocks: DataFrame, start: int, count: int, most: int) -> DataFrame:
    """Newest first from a height: up to `count` blocks while their bytes (size) stay within `most`; the first always comes."""
    walk = blocks.where(F.col("height") <= start).orderBy(F.desc("height")).limit(count)
    upto = Window.orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, 0)  # over `count` rows
    return walk.withColumn("bytes", F.sum("size").over(upto)).where((F.col("bytes") <= most) | (F.col("height") == start))
