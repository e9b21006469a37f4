"""Event logs: filters, candidates, tokens.

logs: txnum, height, log_index, emitter, topics (array of strings or bytes).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators.ledger import rows_between

ZERO = "0"  # the topic that a log without topics files under
MOST_RANGE = 10_000


def _listed(x) -> list | None:
    return None if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def criteria(first: int | None, last: int | None, head: int, emitters=None, topics=None, cap: int | None = MOST_RANGE) -> dict:
    """A checked filter: scalars become lists, trailing wildcards go, 0 is clamped to 1.

    An empty list of a position matches nothing; None matches anything.
    """
    lo, hi = max(1, head if first is None else first), head if last is None else last
    if hi < lo:
        raise ValueError("the range ends before it starts")
    if cap is not None and hi - lo >= cap:
        raise ValueError(f"a range has at most {cap} blocks")
    positions = [_listed(t) for t in topics or []]
    while positions and positions[-1] is None:
        positions.pop()
    return {"first": lo, "last": hi, "emitters": _listed(emitters), "topics": positions}


def matches(emitters: list | None, topics: list[list | None]) -> Column:
    """Emitters are alternatives, positions all hold, a position's values are alternatives; a log too short never matches."""
    tests = [F.col("emitter").isin(emitters)] if emitters else []
    for i, values in enumerate(topics):
        if values is not None:
            tests.append((F.size("topics") > i) & F.get("topics", F.lit(i)).isin(values))
    if len(topics) and topics[-1] is None:
        tests.append(F.size("topics") >= len(topics))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def get_logs(logs: DataFrame, what: dict) -> DataFrame:
    return rows_between(logs, "height", what["first"], what["last"]).where(matches(what["emitters"], what["topics"]))


def elog(logs: DataFrame) -> DataFrame:
    """(emitter, topic0) postings; no topics is the zero topic."""
    return logs.select("emitter", F.coalesce(F.get("topics", F.lit(0)), F.lit(ZERO)).alias("topic0"), "txnum").distinct()


def tval(logs: DataFrame) -> DataFrame:
    """(value, topic0) postings with position bits 1, 2, 4 for positions 1 to 3."""
    spots = logs.where(F.size("topics") > 1).select("txnum", F.get("topics", F.lit(0)).alias("topic0"), F.posexplode(F.slice("topics", 2, 3)).alias("at", "value"))
    return spots.groupBy("value", "topic0", "txnum").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("at"))).alias("pos"))


def sig(logs: DataFrame) -> DataFrame:
    return logs.where(F.size("topics") > 0).select(F.get("topics", F.lit(0)).alias("topic0"), "txnum").distinct()


def set_rows(logs: DataFrame) -> DataFrame:
    """Distinct (topic0, pos, value, emitter) of positions 1 to 3."""
    spots = logs.where(F.size("topics") > 1).select("emitter", F.get("topics", F.lit(0)).alias("topic0"), F.posexplode(F.slice("topics", 2, 3)).alias("at", "value"))
    return spots.select("topic0", (F.col("at") + 1).alias("pos"), "value", "emitter").distinct()


def elog_spots(logs: DataFrame) -> DataFrame:
    """Every log as a posting of its emitter: emitter, topic0, txnum, log_index, n_topics."""
    return logs.select("emitter", F.coalesce(F.get("topics", F.lit(0)), F.lit(ZERO)).alias("topic0"), "txnum", "log_index", F.size("topics").alias("n_topics"))


def tval_spots(logs: DataFrame) -> DataFrame:
    """Every log as a posting of each value that it has: value, topic0, txnum, log_index, position bits, emitter, n_topics."""
    spots = logs.where(F.size("topics") > 1).select("txnum", "log_index", "emitter", F.get("topics", F.lit(0)).alias("topic0"), F.size("topics").alias("n_topics"), F.posexplode(F.slice("topics", 2, 3)).alias("at", "value"))
    return spots.groupBy("value", "topic0", "txnum", "log_index").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("at"))).alias("pos"), F.max("emitter").alias("emitter"), F.max("n_topics").alias("n_topics"))


def standard_of_spot(transfer: list, multi: list) -> Column:
    """erc20, erc721 or erc1155 of a posting, or null."""
    t0, n = F.col("topic0"), F.col("n_topics")
    return F.when(t0.isin(transfer) & (n == 3), "erc20").when(t0.isin(transfer) & (n == 4), "erc721").when(t0.isin(multi) & (n == 4), "erc1155")


def holder_spots(spots: DataFrame, holder, transfer: list, multi: list, standard: str | None = None) -> DataFrame:
    """Postings of the holder's token transfers: positions 1 and 2, of several tokens 2 and 3."""
    own = spots.where((F.col("value") == holder) & F.col("topic0").isin([*transfer, *multi])).withColumn("standard", standard_of_spot(transfer, multi))
    bits = F.col("pos").bitwiseAND(F.when(F.col("standard") == "erc1155", 0b110).otherwise(0b011)) != 0
    return own.where(bits & (F.col("standard").isNotNull() if standard is None else F.col("standard") == standard))


def contract_spots(spots: DataFrame, token, transfer: list, multi: list, standard: str | None = None) -> DataFrame:
    """Postings of the contract's token transfers."""
    own = spots.where((F.col("emitter") == token) & F.col("topic0").isin([*transfer, *multi])).withColumn("standard", standard_of_spot(transfer, multi))
    return own.where(F.col("standard").isNotNull() if standard is None else F.col("standard") == standard)


def candidates(logs: DataFrame, emitters: list | None, topics: list[list | None], elogs: DataFrame | None = None, tvals: DataFrame | None = None, sigs: DataFrame | None = None) -> DataFrame:
    """Transactions in every dimension's postings: a superset of the matches, by semi-joins.

    One topic0 narrows the other dimensions to its groups; positions above 3 aren't indexed.
    elogs, tvals, sigs: the stored postings; without them they are made of the logs.
    """
    elogs, tvals, sigs = elog(logs) if elogs is None else elogs, tval(logs) if tvals is None else tvals, sig(logs) if sigs is None else sigs
    one = topics[0][0] if topics and topics[0] is not None and len(topics[0]) == 1 else None
    narrow = lambda d: d if one is None else d.where(F.col("topic0") == one)
    sets = []
    if emitters:
        sets.append(narrow(elogs).where(F.col("emitter").isin(emitters)).select("txnum").distinct())
    if topics and topics[0] is not None and not (emitters and one is not None):
        sets.append(sigs.where(F.col("topic0").isin(topics[0])).select("txnum").distinct())
    for i, values in enumerate(topics[1:4], 1):
        if values is not None:
            sets.append(narrow(tvals).where(F.col("value").isin(values) & (F.col("pos").bitwiseAND(F.lit(1 << (i - 1))) != 0)).select("txnum").distinct())
    if not sets:
        return logs.select("txnum").distinct()
    return reduce(lambda a, b: a.join(b, "txnum", "left_semi"), sets)


def with_value(logs: DataFrame, value, topic0=None, mask: int = 0) -> DataFrame:
    """Logs that have the value at one of the mask's positions (0: any of 1 to 3)."""
    spots = [(F.size("topics") > i) & (F.get("topics", F.lit(i)) == value) for i in (1, 2, 3) if not mask or mask >> (i - 1) & 1]
    own = logs.where(reduce(lambda a, b: a | b, spots))
    return own if topic0 is None else own.where(F.get("topics", F.lit(0)) == topic0)


#: fixed values: what makes a log a transfer of a token standard: signatures by role, and topics
TRANSFER_TOPICS = {"erc20": 3, "erc721": 4, "erc1155": 4}


def standard_of(transfer: list, multi: list) -> Column:
    """erc20, erc721 or erc1155 of a log, or null; transfer and multi: topic0 values."""
    t0, n = F.get("topics", F.lit(0)), F.size("topics")
    return F.when(t0.isin(transfer) & (n == 3), "erc20").when(t0.isin(transfer) & (n == 4), "erc721").when(t0.isin(multi) & (n == 4), "erc1155")


def transfers(logs: DataFrame, transfer: list, multi: list, holder=None, token=None, standard: str | None = None) -> DataFrame:
    """Token transfers of a holder (positions 1 and 2, for erc1155 2 and 3) or a contract."""
    own = logs.withColumn("standard", standard_of(transfer, multi)).where("standard is not null")
    if standard:
        own = own.where(F.col("standard") == standard)
    if token is not None:
        own = own.where(F.col("emitter") == token)
    if holder is not None:
        at = lambda i: F.get("topics", F.lit(i)) == holder
        own = own.where(F.when(F.col("standard") == "erc1155", at(2) | at(3)).otherwise(at(1) | at(2)))
    return own


def token_contracts(rows: DataFrame, counts: DataFrame, holder, transfer: list, multi: list) -> DataFrame:
    """Distinct tokens of a holder out of the set rows, with the standard that their logs' topic counts show.

    counts: (emitter, topic0, topics) seen, in place of a call to the contract.
    """
    spot = (F.col("topic0").isin(transfer) & F.col("pos").isin(1, 2)) | (F.col("topic0").isin(multi) & F.col("pos").isin(2, 3))
    own = rows.where((F.col("value") == holder) & spot).select("emitter", "topic0").distinct()
    seen = own.join(counts, ["emitter", "topic0"])
    named = F.when(F.col("topic0").isin(multi), F.when(F.col("n_topics") == 4, "erc1155")).when(F.col("n_topics") == 4, "erc721").when(F.col("n_topics") == 3, "erc20")
    return seen.select(F.col("emitter").alias("token"), named.alias("standard")).where("standard is not null").distinct()


def topic_profile(logs: DataFrame, top: int) -> DataFrame:
    """Logs by topic0, with the share of all and the cumulative share, of the `top` most frequent."""
    counts = logs.groupBy(F.coalesce(F.get("topics", F.lit(0)), F.lit(ZERO)).alias("topic0")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    best = counts.orderBy(F.desc("n"), "topic0").limit(top)
    from pyspark.sql import Window

    upto = Window.orderBy(F.desc("n"), "topic0").rowsBetween(Window.unboundedPreceding, 0)  # over `top` rows
    return best.crossJoin(F.broadcast(total)).select("topic0", "n", F.sum("n").over(upto).alias("cumulative"), "total")


def position_profile(logs: DataFrame) -> DataFrame:
    """pos, n and kinds: how many logs have a topic at each position, and how many values it takes."""
    spots = logs.where(F.size("topics") > 0).select(F.posexplode("topics").alias("pos", "value"))
    return spots.groupBy("pos", "value").agg(F.count("*").alias("n")).groupBy("pos").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


def holder_profile(spots: DataFrame) -> DataFrame:
    """Postings and emitters per holder of (holder, emitter); median and 99th percentile by the places n / 2 and n / 100 of a descending order, found by counts of counts."""
    from pyspark.sql import Window

    pairs = spots.groupBy("holder", "emitter").agg(F.count("*").alias("per"))
    levels = pairs.groupBy("holder", "per").agg(F.sum("per").alias("rows"), F.count("*").alias("emitters"))
    down = Window.partitionBy("holder").orderBy(F.desc("per")).rowsBetween(Window.unboundedPreceding, 0)
    placed = levels.withColumn("upto", F.sum("rows").over(down)).withColumn("postings", F.sum("rows").over(Window.partitionBy("holder")))
    at = lambda share: F.max(F.when(F.col("upto") > F.floor(F.col("postings") * share), F.col("per")))
    return placed.groupBy("holder").agg(F.first("postings").alias("postings"), F.sum("emitters").alias("emitters"), at(0.5).alias("p50"), at(0.01).alias("p99"), F.max("per").alias("most"))


def family_statistics(rows: DataFrame, family: str) -> DataFrame:
    """Of a family's rows (k, v, c: key, value and the key's first component): counts and bytes, combined by key before anything is distinct."""
    by_key = rows.groupBy("c", "k").agg(F.count("*").alias("n"), F.sum(F.octet_length("v")).alias("v")).withColumn("b", F.col("n") * F.octet_length("k"))
    by_first = by_key.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("b").alias("b"), F.sum("v").alias("v"))
    return by_first.agg(F.lit(family).alias("family"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("groups"), F.count("*").alias("firsts"), F.sum("b").alias("key_bytes"), F.sum("v").alias("value_bytes"))


def holder_pairs(logs: DataFrame, transfer: list) -> DataFrame:
    """Distinct (holder, token) of transfers."""
    own = logs.where(F.get("topics", F.lit(0)).isin(transfer) & (F.size("topics") >= 3))
    return own.select(F.explode(F.slice("topics", 2, 2)).alias("holder"), "emitter").distinct()


def net_flow(logs: DataFrame, transfer: list) -> DataFrame:
    """Of non-fungible transfers, by holder: in less out, and distinct (token, id)."""
    own = logs.where(F.get("topics", F.lit(0)).isin(transfer) & (F.size("topics") == 4))
    t = lambda i: F.get("topics", F.lit(i))
    moves = own.select(F.explode(F.array(F.struct(t(1).alias("holder"), F.lit(-1).alias("move")), F.struct(t(2).alias("holder"), F.lit(1).alias("move")))).alias("m"), "emitter", t(3).alias("id"))
    return moves.groupBy("m.holder").agg(F.sum("m.move").alias("net"), F.count_distinct("emitter", "id").alias("ids"))
