"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all
words; a target stops at `passes` times its source's size and the excess is shared again by
weight, until none is above. The shared level is found by rounds of one aggregation over
the sources, so their number doesn't matter to the driver.

Schedule: slot i takes the golden-ratio point frac(i * phi) (64-bit fixed point, exact)
and falls to the source whose share of the unit interval holds it; slots are ranked within
their source. Documents of a source are laid end to end in a shuffled order, `passes`
times, and cut into blocks of equally many words; the k-th slot of a source takes its k-th
block, and a document takes the words that it has in the blocks taken. Taken blocks are
met by pages of 64, a bit a block.

Running sums within a source are taken in two steps, over hash buckets of it and over the
buckets, so that a source with most of the rows is dealt to many tasks.

Defined results: a null text counts as empty, size 0, and takes nothing; a null source is a
source, the last one; repeated rows are laid out one by one; an empty table gives no rows.
Reruns agree: the order depends on document ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import partitions, written

WEIGHTS = (5, 2, 1)
PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"
PHI = 11400714819323198485  # 2**64 / golden ratio, odd
BLOCK = 16  # words of a block, whatever the size of the whole
STRETCH = 1 << 16  # slots that are ranked together, whatever their number
PAGE = 64  # blocks of a page, the bits of a long


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def summed_before(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of value over the rows before in (bucket, order) of the same groups.

    Within (groups, bucket) by a window, across buckets by a window over the buckets' sums.
    """
    keys = [*groups, bucket]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    own = df.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return own.join(sums, keys).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before")


def ranked_sources(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, sid (place in code-point order, null last), weight; sorted without a single task."""
    spark = sizes.sparkSession
    ranged = sizes.repartitionByRange(max(1, min(partitions(spark), 64)), F.col("source").asc_nulls_last())
    held = written(ranged.withColumn("part", F.spark_partition_id()), "sources")
    held = summed_before(held.withColumn("all", F.lit(0)), ["all"], "part", [F.col("source").asc_nulls_last()], F.lit(1), "sid").drop("all")
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    return held.withColumn("weight", pick)


def with_targets(sources: DataFrame, passes: int) -> DataFrame:
    """Adds target: the level times the weight, or `passes` times the size where that is less."""
    cap = passes * F.col("source_size")
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = (F.lit(level) * F.col("weight") > cap) if capped >= 0 else F.lit(False)
        n, full, weight = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).head()
        if n == capped or not weight:
            break
        level, capped = (total - (full or 0)) / weight, n
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))


def slots_of(sources: DataFrame, total: int, block: int, grid: int = 4096) -> DataFrame:
    """slot, sid and rank (among the slots of its source) of each slot of the schedule that has a source."""
    spark = sources.sparkSession
    n = -(-total // block)
    parts = partitions(spark)
    upto = summed_before(sources.withColumn("all", F.lit(0)), ["all"], "part", [F.col("sid")], F.col("target"), "lo")
    share = upto.where("target > 0").select("sid", (F.col("lo") / total).alias("lo"), ((F.col("lo") + F.col("target")) / total).alias("hi"))
    # a source is listed under each cell of the unit interval that it touches
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1)))))
    point = F.expr(f"cast(cast((cast(id as decimal(20,0)) * cast({PHI} as decimal(20,0))) % cast(18446744073709551616 as decimal(20,0)) as double) / 18446744073709551616 as double)")
    slots = spark.range(0, n, 1, parts).withColumn("u", point).withColumn("cell", F.least(F.floor(F.col("u") * grid), F.lit(grid - 1)))
    dealt = slots.join(cells, "cell").where("u >= lo and u < hi").select(F.col("id").alias("slot"), "sid", F.floor(F.col("id") / STRETCH).alias("stretch"))
    # written, so that the points aren't made twice
    return summed_before(written(dealt, "dealt"), ["sid"], "stretch", [F.col("slot")], F.lit(1), "rank").select("slot", "sid", "rank")


def bits(first: Column, last: Column) -> Column:
    """A long with the bits from first to last, of 0 to 63."""
    ones = F.lit(-1).cast("long")
    return F.call_function("shiftleft", F.call_function("shiftrightunsigned", ones, (63 - (last - first)).cast("int")), first.cast("int"))


def words_taken(lie: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """sid, at and taken: the words that stretches (from, upto) of documents have in the blocks that have a slot.

    The k-th slot of a source takes its k-th block. A page holds the taken ones of PAGE
    blocks, so that a document meets as many rows as it has pages, not blocks.
    """
    page, within = F.floor(F.col("rank") / PAGE), F.col("rank") % PAGE
    pages = slots.groupBy("sid", page.alias("page")).agg(F.bit_or(bits(within, within)).alias("full"))
    # ends of a stretch in blocks, then in those of the page
    ends = lie.withColumn("first", F.floor(F.col("from") / block)).withColumn("last", F.floor((F.col("upto") - 1) / block))
    each = ends.withColumn("page", F.explode(F.sequence(F.floor(F.col("first") / PAGE), F.floor(F.col("last") / PAGE))))
    start = F.col("page") * PAGE
    low, high = F.greatest("first", start) - start, F.least("last", start + PAGE - 1) - start
    has = lambda at: F.col("full").bitwiseAND(bits(at, at)) != 0
    whole = F.bit_count(F.col("full").bitwiseAND(bits(low, high))) * block
    ahead = F.when((F.col("first") >= start) & has(low), F.col("from") - F.col("first") * block).otherwise(0)
    beyond = F.when((F.col("last") < start + PAGE) & has(high), (F.col("last") + 1) * block - F.col("upto")).otherwise(0)
    return each.join(pages, ["sid", "page"]).groupBy("sid", "at").agg(F.sum(whole - ahead - beyond).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block_words: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, source, size, text_key, source_size, target and taken of every row."""
    spark = df.sparkSession
    sized = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    sized = written(sized, "sized")
    rows = sized.count()
    sources = written(with_targets(ranked_sources(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), passes), "targets")
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    block = block_words or BLOCK
    known = sources.select(F.col("source").alias("_tally_source"), "sid", "source_size", "target")
    buckets = max(64, rows // 50_000)
    turned = sized.withColumn("turn", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("bucket", F.pmod(F.shiftrightunsigned("turn", 32), F.lit(buckets)))
    # what is known of a source is copied to salts, so that its rows meet it in many tasks
    salts = min(64, buckets)
    salted = lambda small: small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    turned = turned.withColumn("salt", (F.col("bucket") % salts).cast("int"))
    placed = turned.join(salted(known).withColumnRenamed("salt", "_tally_salt"), F.col("source").eqNullSafe(F.col("_tally_source")) & (F.col("salt") == F.col("_tally_salt"))).drop("_tally_source", "_tally_salt")
    placed = written(summed_before(placed, ["sid"], "bucket", [F.col("turn"), F.col("doc_id"), F.col("size"), F.col("text_key")], F.col("size"), "at"), "placed")
    if not total:
        return placed.select("doc_id", "source", "size", "text_key", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    slots = written(slots_of(sources, total, block), "slots")
    # the stretch of a document in each pass
    lie = placed.where("size > 0").select("sid", "at", "size", "source_size", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    lie = lie.withColumn("from", F.col("pass") * F.col("source_size") + F.col("at")).select("sid", "at", "from", (F.col("from") + F.col("size")).alias("upto"))
    taken = words_taken(lie, slots, block).withColumn("full", F.lit(True))
    out = placed.withColumn("full", F.col("size") > 0).join(taken, ["sid", "at", "full"], "left")
    return out.select("doc_id", "source", "size", "text_key", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """The rows of df, each as often as the mix takes it: words taken by its words, rounded half up.

    Rows that agree in id, source and text take equal shares of what they take together.
    """
    plan = mixed(df, **how)
    each = plan.groupBy("doc_id", "source", "text_key").agg(F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int").alias("_tally_times"))
    each = each.where("_tally_times > 0").select(F.col("doc_id").alias("_tally_id"), F.col("source").alias("_tally_source"), F.col("text_key").alias("_tally_key"), "_tally_times")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_tally_id")) & F.col("source").eqNullSafe(F.col("_tally_source")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_tally_key"))
    return df.join(each, same).withColumn("_tally_copy", F.explode(F.sequence(F.lit(1), F.col("_tally_times")))).select(*df.columns)
