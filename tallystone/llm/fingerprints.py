"""Document fingerprints: SimHash, in DataFrame operations only.

Terms are pairs of neighbouring words (a lone word stands for itself), a term weighs as
often as it occurs. Each term's 64-bit hash votes with its weight for or against every bit
of the fingerprint; a bit is set if the votes for it win. The votes of bits i and i + 32 are
counted in the halves of one number, so that 32 sums of shifted and masked hashes do.

Votes are summed by the text's hash, not by row: copies multiply all votes alike, which
leaves the fingerprint as it is, and partial sums keep a text with many copies small.

Search: permuted block tables. 64 bits are cut into BLOCKS blocks; RADIUS differing bits
leave BLOCKS - RADIUS blocks untouched, so a table for each choice of that many blocks, keyed
by their bits, holds every fingerprint within RADIUS. A pair is taken from the first table
that has it; the exact distance is part of the join.

Defined results: null and empty texts have fingerprint zero, and so equal ones; equal texts
have equal fingerprints; rows without an id come last in the order; rows of equal id are
ordered by their texts' hash, then their texts; the only row is its own next; an empty
table gives no rows. Very long texts count whole, and other columns don't matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import partitions, range_of, split_points, stated_bytes, written

RADIUS = 3
BLOCKS = 6
RANGE = 1 << 24  # bytes of a range of ids, as the plan states them
LANES = 0x0000000100000001


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2")]


def prints_of(texts: DataFrame) -> DataFrame:
    """key, key2, fp of each distinct value of the column `text` of texts, nulls excepted."""
    words = F.split(F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    cut = texts.select(*text_keys(F.col("text")), words.alias("w"))
    # each word after the first with the one before it; of a text without words nothing
    pairs = F.transform(F.slice("w", F.lit(2), F.size("w")), lambda b, i: F.xxhash64(F.get("w", i), b))
    alone = F.filter(F.array(F.get("w", F.lit(0))), lambda x: x != "")
    terms = F.when(F.size("w") > 1, pairs).otherwise(F.transform(alone, lambda x: F.xxhash64(x)))
    votes = cut.select("key", "key2", F.explode_outer(terms).alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES))).alias(f"v{i}") for i in range(32)]
    sums = votes.groupBy("key", "key2").agg(F.count("h").alias("n"), *lanes)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda c: F.shiftrightunsigned(F.col(c), 32)
    bits = F.lit(0).cast("long")
    for i in range(32):
        bits = bits.bitwiseOR(F.when(2 * low(f"v{i}") > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0).cast("long")))
        mask = 1 << (i + 32)
        bits = bits.bitwiseOR(F.when(2 * high(f"v{i}") > F.col("n"), F.lit(mask if mask < 1 << 63 else mask - (1 << 64))).otherwise(F.lit(0).cast("long")))
    return sums.select("key", "key2", bits.alias("fp"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: the text of the next row by descending id, after the last that of the first.

    Ids are cut into even ranges, rows without an id by ranges of their texts' hash, by
    which they are ordered; the first row of each range is dealt to the range before it as
    well, behind all its own rows, so that no range is ordered with another.
    """
    parts = max(2 * partitions(df.sparkSession), -(-stated_bytes(df) // RANGE))
    points = split_points(df, id_col, parts)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    of_hash = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * parts)
    bucket = F.when(F.col("doc_id").isNull(), len(points) + 1 + F.least(of_hash, F.lit(parts - 1))).otherwise(F.lit(len(points)) - range_of("doc_id", points))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    least = F.min(F.struct(F.bitwise_not("doc_id").alias("back"), "h"))
    tops = {r[0]: (None if r[1]["back"] is None else ~r[1]["back"], r[1]["h"]) for r in rows.groupBy("bucket").agg(least).collect()}  # a row for each range
    order = sorted(tops)
    # by bucket: its first row's id and hash, and the bucket before it
    first, to = {}, {}
    for k, b in enumerate(order):
        first[b], to[b] = tops[b], order[k - 1]
    listed = lambda values: F.get(F.expr(f"cast(array({','.join('null' if values.get(b) is None else str(values[b]) for b in range(len(points) + 1 + parts))}) as array<bigint>)"), F.col("bucket"))
    home = F.struct("bucket", F.lit(False).alias("ghost"))
    leads = F.col("doc_id").eqNullSafe(listed({b: f[0] for b, f in first.items()})) & (F.col("h") == listed({b: f[1] for b, f in first.items()}))
    away = F.struct(F.when(leads, listed(to)).cast("int").alias("bucket"), F.lit(True).alias("ghost"))
    dealt = rows.withColumn("at", F.explode(F.filter(F.array(home, away), lambda x: x["bucket"].isNotNull()))).select("doc_id", "text", "h", "at.bucket", "at.ghost")
    by = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h", "text")
    return dealt.withColumn("next_text", F.lead("text").over(by)).where("not ghost").select("doc_id", "text", "next_text")


def edited(rows: DataFrame) -> DataFrame:
    """Adds n_chars and edited: the last third of the text gives way to the start of the next."""
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    return rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substr("text", F.lit(1), n - k), F.substr("next_text", F.lit(1), k)))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_bits(radius: int, blocks: int) -> list[tuple[int, int]]:
    """Shift and mask of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Each fingerprint under every table's key: its bits in the blocks the table keeps, brought together."""
    cuts = block_bits(radius, blocks)
    entries = []
    for t, kept in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.xxhash64(*(F.shiftrightunsigned("fp", cuts[b][0]).bitwiseAND(F.lit(cuts[b][1])) for b in kept))
        entries.append(F.struct(F.lit(t).alias("table"), key.alias("slot")))
    return prints.withColumn("entry", F.explode(F.array(*entries))).select("*", "entry.table", "entry.slot").drop("entry")


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """q, fp, bits: all pairs of distinct fingerprints of the two (column fp) that are radius or fewer bits apart."""
    cuts = block_bits(radius, blocks)
    left = tables(queries.select("fp").distinct(), radius, blocks).withColumnRenamed("fp", "q")
    right = tables(prints.select("fp").distinct(), radius, blocks)
    differ = F.col("q").bitwiseXOR(F.col("fp"))
    same = [(F.shiftrightunsigned(differ, a).bitwiseAND(F.lit(m)) == 0).cast("int") for a, m in cuts]
    # the first table that has the pair keeps the first untouched blocks
    first, found = F.lit(None).cast("int"), list(combinations(range(blocks), blocks - radius))
    for t, kept in reversed(list(enumerate(found))):
        all_same = same[kept[0]] == 1
        for b in kept[1:]:
            all_same = all_same & (same[b] == 1)
        first = F.when(all_same, F.lit(t)).otherwise(first)
    right = right.withColumnRenamed("table", "t").withColumnRenamed("slot", "s")
    on = (F.col("table") == F.col("t")) & (F.col("slot") == F.col("s")) & (F.bit_count(differ) <= radius) & (first == F.col("table"))
    # both sides are many times what their statistics say: never broadcast them
    return left.join(right.hint("merge"), on).select("q", "fp", F.bit_count(differ).alias("bits"))


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 20) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    n_within: for each row whose id is divisible by `every`, the rows of the table whose
    fingerprint is within RADIUS bits of its own, itself included; null for other rows.
    """
    rows = edited(with_next(df, id_col, text_col))
    own = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = lambda c, a, b: [F.xxhash64(c).alias(a), F.xxhash64(F.lit(1), c).alias(b)]
    facts = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *digest(F.col("text"), "t1", "t2"), *digest(F.col("edited"), "e1", "e2"), *digest(F.col("next_text"), "x1", "x2"))
    # written together, so that the ordered texts are shuffled once for both
    prints = prints_of(own.union(rows.select("edited")))
    both = written(prints.unionByName(facts, allowMissingColumns=True), "fingerprints")
    prints, facts = both.where("fp is not null").select("key", "key2", "fp"), both.where("fp is null").drop("key", "key2", "fp")
    for a, b, name in (("t1", "t2", "fp"), ("e1", "e2", "edited_fp"), ("x1", "x2", "next_fp")):
        known = prints.select(F.col("key").alias(a), F.col("key2").alias(b), F.col("fp").alias(name))
        facts = facts.join(known, [a, b]).drop(a, b)
    facts = written(facts, "facts")
    asked = facts.where(F.col("doc_id") % every == 0).select("fp")
    rows_of = facts.groupBy("fp").agg(F.count("*").alias("rows"))
    # written, so that the join below can split the rows of a fingerprint that many texts have
    near = written(within(asked, facts.select("fp")).join(rows_of, "fp").groupBy("q").agg(F.sum("rows").alias("n_within")), "near")
    out = facts.join(near, facts.fp == near.q, "left")
    name = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select("doc_id", "n_chars", "edited_sha256", name("fp").alias("fingerprint"), name("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.when(F.col("doc_id") % every == 0, F.col("n_within")).alias("n_within"))
