"""Versioned state: as-of reads, genesis floor, overlays, deletions and recovery.

versions: kind ('a' account, 's' slot), addr, slot, txnum, val, present (false: cleared or
deleted). A cleared row is not a missing one: only a missing row falls to genesis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators.scaling import as_of, newest


def frontier(versions: DataFrame, at: int, keys: list[str] | None = None) -> DataFrame:
    """The newest row of every key at or before a slot, cleared ones included."""
    return newest(versions.where(F.col("txnum") <= at), keys or ["addr", "slot"], "txnum", ["val", "present"])


def read_many(versions: DataFrame, probes: DataFrame, genesis: DataFrame) -> DataFrame:
    """probes (addr, slot, at) with their value: newest version, else genesis (addr, val) of an unseen key, else null."""
    found = as_of(versions.withColumn("seen", F.lit(True)), probes, ["addr", "slot"], "txnum", "at", ["val", "present", "seen"])
    floor = genesis.select(F.col("addr").alias("_addr"), F.col("val").alias("_floor"))
    joined = found.join(floor, found.addr == floor._addr, "left")
    value = F.when(F.col("seen").isNull(), F.col("_floor")).when(F.col("present"), F.col("val"))
    return joined.select("addr", "slot", "at", value.alias("val"), F.col("seen").isNotNull().alias("written"))


def accounts_at(accounts: DataFrame, genesis: DataFrame, codes: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (addr, at, ...) with balance, nonce and code: the newest account version's, genesis's of an account never written, else 0, 0 and none.

    accounts: addr, txnum, balance, nonce, code_hash, present (false: deleted, which does not
    fall to genesis). codes: code_hash, code; a hash without code is no code.
    """
    fields = ["balance", "nonce", "code_hash"]
    found = as_of(accounts.withColumn("seen", F.lit(True)), probes, ["addr"], "txnum", "at", [*fields, "present", "seen"])
    floor = genesis.select(F.col("addr").alias("_addr"), *(F.col(c).alias(f"_{c}") for c in fields))
    joined = found.join(floor, F.col("addr") == F.col("_addr"), "left")
    own = {c: F.when(F.col("seen").isNull(), F.col(f"_{c}")).when(F.col("present"), F.col(c)) for c in fields}
    named = joined.withColumns({"balance": F.coalesce(own["balance"], F.lit(0.0)), "nonce": F.coalesce(own["nonce"], F.lit(0)), "code_hash": own["code_hash"]})
    return named.join(codes, "code_hash", "left").select(*probes.columns, "balance", "nonce", "code")


def slot_series(versions: DataFrame, addr, slot) -> DataFrame:
    return versions.where((F.col("addr") == addr) & (F.col("slot") == slot)).orderBy("txnum")


def overlaid(levels: DataFrame, keys: list[str]) -> DataFrame:
    """One view of stacked levels: the highest level wins, its newest row; tombstones hide what is below."""
    best = levels.groupBy(*keys).agg(F.max_by(F.struct("val", "present"), F.struct("level", "txnum")).alias("v"))
    return best.where("v.present").select(*keys, "v.val")


def slots_after_deletes(slots: DataFrame, deletes: DataFrame) -> DataFrame:
    """The newest live row of every slot: rows older than the account's newest delete are gone.

    deletes: addr, txnum of the account's empty rows; a recreated account keeps newer slots.
    """
    last = deletes.groupBy("addr").agg(F.max("txnum").alias("deleted"))
    live = slots.join(last, "addr", "left").where("deleted is null or txnum >= deleted")
    return newest(live, ["addr", "slot"], "txnum", ["val", "present"]).where("present")


def tombstones(slots: DataFrame, deletes: DataFrame) -> DataFrame:
    """An empty row for each slot that was live at a delete of its account, at that delete.

    A live version ends at the account's next delete if its slot isn't written before that.
    Both are looked up by as-of joins on reversed slots, so that an account that is deleted
    or written often is spread over buckets of slots.
    """
    back = lambda df, c: df.withColumn("_back", -F.col(c))
    probes = slots.select("addr", "slot", F.col("txnum").alias("written"), "present", (-F.col("txnum") - 1).alias("_at"))
    gone = back(deletes.select("addr", "txnum"), "txnum").withColumn("deleted", F.col("txnum"))
    at = as_of(gone, probes, ["addr"], "_back", "_at", ["deleted"])
    after = back(slots.select("addr", "slot", "txnum"), "txnum").withColumn("next", F.col("txnum"))
    both = as_of(after, at, ["addr", "slot"], "_back", "_at", ["next"])
    return both.where("present and deleted is not null and (next is null or deleted < next)").select("addr", "slot", F.col("deleted").alias("txnum"))


def recovered(versions: DataFrame, roll: int, head: int) -> DataFrame:
    """Rows that bring a rolled state up to the head: newest per key in (roll, head], without code rows.

    A slot row older than its account's newest delete in the range doesn't come back.
    """
    part = versions.where((F.col("txnum") > roll) & (F.col("txnum") <= head) & (F.col("kind") != "c"))
    gone = part.where("kind = 'a' and not present").groupBy("addr").agg(F.max("txnum").alias("deleted"))
    kept = part.join(gone, "addr", "left").where("kind = 'a' or deleted is null or txnum >= deleted")
    return newest(kept, ["kind", "addr", "slot"], "txnum", ["val", "present"])


def modified(versions: DataFrame, first: int, last: int) -> DataFrame:
    """Accounts written in a range (an extension: there is no index of them elsewhere)."""
    return versions.where(F.col("txnum").between(first, last)).select("addr").distinct()


def overridden(view: DataFrame, replaced: DataFrame, changed: DataFrame) -> DataFrame:
    """A view (addr, slot, val) under overrides: `replaced` accounts keep only the slots given, `changed` slots win.

    An account in both is an error, as the two exclude each other.
    """
    twice = replaced.select("addr").distinct().join(changed.select("addr").distinct(), "addr")
    if not twice.isEmpty():
        raise ValueError("an account has both a full state and a difference")
    base = view.join(replaced.select("addr").distinct(), "addr", "left_anti").withColumn("level", F.lit(0))
    over = replaced.unionByName(changed).withColumn("level", F.lit(1))
    best = base.unionByName(over).groupBy("addr", "slot").agg(F.max_by("val", "level").alias("val"))
    return best.where("val is not null")
