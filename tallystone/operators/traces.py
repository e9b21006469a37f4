"""Call traces: JSON trees flattened without UDFs, and what is asked of their frames.

A trace is a call with `type`, `from`, `to`, `value`, `error` and nested `calls`. Frames are
in pre-order, depth counts from 0 below the top call, and the top call isn't a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.sources.shared import written

DEEPEST = 1024  # the machine's own limit of nested calls

FIELDS = ("type", "from", "to", "value", "error")


#: a call whose children stay text
NODE = "type string, `from` string, `to` string, value string, error string, calls array<string>"


def frames(traces: DataFrame) -> DataFrame:
    """txnum, ord, depth and the fields of every frame of (txnum, trace).

    One level of the tree is opened per round, as long as there are calls: a parsed node
    keeps its children as text for the next round. From the third on, levels are written, so
    that none is parsed again for the next.
    """
    from pyspark.sql import Window

    level = traces.select("txnum", F.array().cast("array<int>").alias("path"), F.from_json("trace", NODE).alias("node"))
    out = None
    for depth in range(DEEPEST):
        below = level.where("size(node.calls) > 0").select("txnum", "path", F.posexplode("node.calls").alias("i", "text"))
        level = below.select("txnum", F.concat("path", F.array("i")).alias("path"), F.from_json("text", NODE).alias("node"))
        if depth >= 2:
            level = written(level, "calls")
            if level.isEmpty():
                break
        rows = level.select("txnum", "path", F.lit(depth).alias("depth"), *(F.col(f"node.`{f}`").alias(f) for f in FIELDS))
        out = rows if out is None else out.unionByName(rows)
    order = Window.partitionBy("txnum").orderBy("path")  # an array that is a prefix sorts first
    return out.withColumn("ord", F.row_number().over(order) - 1).drop("path")


def internal_operations(rows: DataFrame) -> DataFrame:
    """CREATE, CREATE2 and calls that move value; delegate calls move none of their own."""
    return rows.where("type in ('CREATE', 'CREATE2') or (type = 'CALL' and value is not null and value not in ('0x0', '0x', ''))")


def operations_by_hash(asked: DataFrame, known: DataFrame, rows: DataFrame) -> DataFrame:
    """digest, known and operations of each hash asked: an unknown transaction has null, a known one without operations an empty list.

    known: digest, txnum; rows: frames.
    """
    found = asked.join(known, "digest", "left")
    own = internal_operations(rows).groupBy(F.col("txnum").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("ord", "type", "from", "to", "value"))).alias("own"))
    joined = found.join(own, F.col("txnum") == F.col("_t"), "left")
    none = F.array().cast(joined.schema["own"].dataType)
    return joined.select("digest", F.col("txnum").isNotNull().alias("known"), F.when(F.col("txnum").isNotNull(), F.coalesce("own", none)).alias("operations"))


def paths(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path and value of every leaf of JSON documents, and of empty objects and lists: nested levels are opened round by round."""
    from pyspark.sql import types as T

    level = rows.select(key, F.lit("$").alias("path"), F.col(text).alias("value"))
    out, nested = None, T.MapType(T.StringType(), T.StringType())
    for depth in range(DEEPEST):
        kind = F.substring(F.ltrim("value"), 1, 1)
        open_ = (kind == "{") | (kind == "[")
        entries = F.map_entries(F.from_json(F.when(kind == "{", F.col("value")), nested))
        items = F.transform(F.from_json(F.when(kind == "[", F.col("value")), T.ArrayType(T.StringType())), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("key"), x.alias("value")))
        inner = F.when(kind == "{", F.transform(entries, lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("key"), e["value"].alias("value")))).otherwise(items)
        level = written(level.withColumns({"_open": open_, "_inner": inner}), "paths")
        leaves = level.where("not coalesce(_open, false) or size(_inner) = 0").select(key, "path", "value")
        out = leaves if out is None else out.unionByName(leaves)
        below = level.where("_open and size(_inner) > 0")
        if below.isEmpty():
            return out
        level = below.select(key, "path", F.explode("_inner").alias("e")).select(key, F.concat("path", "e.key").alias("path"), "e.value")
    raise ValueError(f"documents nest deeper than {DEEPEST}")


def document_differences(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, a and b wherever two JSON documents of a key differ: every path of either, none ignored."""
    a, b = paths(left, key, text).withColumnsRenamed({"value": "a"}), paths(right, key, text).withColumnsRenamed({"value": "b"})
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), [key, "path"], "full")
    return both.where("in_a is null or in_b is null or not (a <=> b)").select(key, "path", "a", "b")


def failed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("failed", F.coalesce(F.col("error"), F.lit("")) != "")


def creators(rows: DataFrame) -> DataFrame:
    """By contract: the first transaction with a creation of it that didn't fail."""
    made = failed(rows).where("type in ('CREATE', 'CREATE2') and not failed and `to` is not null")
    return made.groupBy(F.col("to").alias("contract")).agg(F.min("txnum").alias("txnum"), F.min_by("from", F.struct("txnum", "ord")).alias("creator"))


def different(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places where two sets of frames differ: every path and field, missing ones included."""
    fields = lambda d, name: d.select("txnum", "ord", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias(name)) for f in FIELDS))).alias("x")).select("txnum", "ord", "x.*")
    both = fields(left, "a").join(fields(right, "b"), ["txnum", "ord", "field"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))
