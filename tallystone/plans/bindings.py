"""The driver's star schema read as a ledger: orders are blocks, line items transactions, events logs, state and traces.

Each DataFrame binding has the same thing as DuckDB common table expressions (the *_SQL
texts), from which the oracles are written.

Blocks, transactions, hashes, postings and logs are written once a session as a corpus of
sorted families, from which every query reads: a look-up by height, slot, digest, address or
value skips the files, row groups and pages that can't hold it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.operators.ledger import assign_slots, cumulative_gas
from tallystone.operators.logs import elog_spots, set_rows, sig, tval_spots
from tallystone.operators.scaling import running_sum
from tallystone.sources.runs import Corpus
from tallystone.sources.shared import discard, shared_uri, written

TRANSFER, MULTI = ["click", "purchase"], ["error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    counts = items.groupBy(F.col("l_orderkey").alias("height")).agg(F.count("*").alias("tx_count"), F.sum(F.col("l_quantity").cast("long")).alias("gas_used"))
    none = F.lit(0).cast("long")
    own = orders.select(F.col("o_orderkey").alias("height"), (F.round(F.col("o_totalprice") * 100).cast("long") % 1000).alias("base_fee"), F.col("o_custkey").alias("miner"))
    joined = own.join(counts, "height", "left").withColumns({"tx_count": F.coalesce("tx_count", none), "gas_used": F.coalesce("gas_used", none)})
    named = joined.withColumns({"gas_limit": 50 * F.col("tx_count"), "hash": hashed("b", F.col("height")), "parent_hash": hashed("b", F.col("height") - 1)})
    return assign_slots(named)


def hashed(prefix: str, number: Column) -> Column:
    return F.sha2(F.concat(F.lit(prefix), number.cast("string")), 256)


def built_txs(spark: SparkSession, sf_dir: str, blocks: DataFrame) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    own = items.select(
        F.col("l_orderkey").alias("height"),
        (F.row_number().over(order) - 1).cast("long").alias("tx_index"),
        F.col("l_suppkey").alias("recipient"),
        F.col("l_partkey").alias("emitter"),
        F.col("l_quantity").cast("long").alias("gas_used"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("fee_cap"),
        F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long").alias("tip_cap"),
        (F.col("l_linestatus") == "F").cast("long").alias("status"),
        F.lit(50).cast("long").alias("gas_limit"),
    )
    placed = own.join(blocks.select("height", "first_tx", F.col("miner").alias("sender")), "height")
    placed = placed.withColumn("txnum", F.col("first_tx") + F.col("tx_index")).drop("first_tx")
    return with_nonce(placed.withColumn("tx_hash", hashed("t", F.col("txnum"))))


_STORED: dict[tuple[str, str, str], Corpus] = {}


def _stored(spark: SparkSession, sf_dir: str, kind: str, tables: Callable[[], tuple[dict[str, DataFrame], tuple[int, int, int, int], list[DataFrame]]]) -> Corpus:
    """The corpus of a folder's tables, built at the first use in a session: one terminal run of all families; the tables that it is made of are deleted then."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORED:
        own, span, made = tables()
        corpus = Corpus(spark, shared_uri(spark, f"corpus-{kind}"), kind)
        corpus.flush(own, span, level=1)
        discard(*made)
        _STORED[key] = corpus
    return _STORED[key]


def ledger_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Families: blocks by height, txs by slot, hashes by digest, postings by address and slot."""

    def tables():
        blocks = written(built_blocks(spark, sf_dir), "built-blocks")
        own = written(built_txs(spark, sf_dir, blocks), "built-txs")
        top = blocks.agg(F.max(F.struct("height", "boundary_tx")).alias("e")).head()["e"] or (-1, -1)
        of_txs = own.select(F.col("tx_hash").alias("digest"), F.lit("t").alias("kind"), "txnum", "height")
        of_blocks = blocks.select(F.col("hash").alias("digest"), F.lit("b").alias("kind"), F.col("boundary_tx").alias("txnum"), "height")
        merged = address_postings(own).groupBy("addr", "txnum", "height").agg(F.bit_or("roles").alias("roles"), F.max("nonce").alias("nonce"))
        return {"blocks": blocks.withColumn("txnum", F.col("boundary_tx")), "txs": own, "hashes": of_txs.union(of_blocks), "postings": merged}, (0, top[1] + 1, 0, top[0]), [blocks, own]

    return _stored(spark, sf_dir, "ledger", tables)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_corpus(spark, sf_dir).read(family="blocks").drop("txnum")


def txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_corpus(spark, sf_dir).read(family="txs")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest, kind ('b' or 't'), txnum, height."""
    return ledger_corpus(spark, sf_dir).read(family="hashes")


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addr, txnum, height, roles, and the nonce where the address is the sender."""
    return ledger_corpus(spark, sf_dir).read(family="postings")


def with_nonce(transactions: DataFrame) -> DataFrame:
    return running_sum(transactions, "txnum", F.lit(1), "nonce", keys=["sender"]).withColumn("nonce", F.col("nonce").cast("long"))


def address_postings(transactions: DataFrame) -> DataFrame:
    """(addr, txnum, height, roles, nonce) before merging: sender 1, recipient 2, emitter 8; kinds of number are told apart by a letter."""
    nonce = lambda bit: (F.col("nonce") if bit == 1 else F.lit(None).cast("long")).alias("nonce")
    each = F.array(*(F.struct(F.concat(F.lit(f"{letter}:"), F.col(c).cast("string")).alias("addr"), F.lit(bit).alias("roles"), nonce(bit)) for letter, c, bit in (("c", "sender", 1), ("s", "recipient", 2), ("p", "emitter", 8))))
    return transactions.select("txnum", "height", F.explode(each).alias("x")).select("x.addr", "txnum", "height", "x.roles", "x.nonce")


LEDGER_SQL = """
n AS (SELECT l_orderkey h, count(*) n, cast(sum(cast(l_quantity AS bigint)) AS bigint) g FROM lineitem GROUP BY 1),
blocks AS (SELECT o_orderkey height, coalesce(n, 0) tx_count,
    cast(sum(coalesce(n, 0) + 1) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - coalesce(n, 0) - 1 AS bigint) first_tx,
    cast(sum(coalesce(n, 0) + 1) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - 1 AS bigint) boundary_tx,
    coalesce(g, 0) gas_used, 50 * coalesce(n, 0) gas_limit, cast(round(o_totalprice * 100) AS bigint) % 1000 base_fee,
    o_custkey miner, sha256(concat('b', o_orderkey)) hash, sha256(concat('b', o_orderkey - 1)) parent_hash
  FROM orders LEFT JOIN n ON h = o_orderkey),
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 tx_index FROM lineitem),
txs AS (SELECT b.height, b.first_tx + tx_index txnum, tx_index, sha256(concat('t', b.first_tx + tx_index)) tx_hash, o_custkey sender,
    l_suppkey recipient, l_partkey emitter, cast(l_quantity AS bigint) gas_used, cast(50 AS bigint) gas_limit,
    cast(round(l_extendedprice * 100) AS bigint) fee_cap, cast(round(l_extendedprice * l_discount * 100) AS bigint) tip_cap,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END status, base_fee, b.tx_count, b.gas_used block_gas,
    least(cast(round(l_extendedprice * 100) AS bigint), cast(round(l_extendedprice * l_discount * 100) AS bigint) + base_fee) price,
    row_number() OVER (PARTITION BY o_custkey ORDER BY b.first_tx + tx_index) - 1 nonce
  FROM i JOIN blocks b ON b.height = l_orderkey JOIN orders ON o_orderkey = l_orderkey),
post AS (SELECT addr, txnum, height, bit_or(role) roles FROM (
    SELECT concat('c:', sender) addr, txnum, height, 1 role FROM txs UNION ALL SELECT concat('s:', recipient), txnum, height, 2 FROM txs
    UNION ALL SELECT concat('p:', emitter), txnum, height, 8 FROM txs) GROUP BY 1, 2, 3)
"""


def typed_txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as the wire has them: types 0, 1 and 2 in turn, every 50th a creation, and what the wire forms need besides."""
    # hashes are shuffled as bytes, half as long; sums by block come first, so that the same shuffle and sort serve the join
    packed = txs(spark, sf_dir).withColumn("tx_hash", F.unhex("tx_hash")).withColumn("cumulative_gas", cumulative_gas())
    heads = blocks(spark, sf_dir).select("height", "base_fee", F.unhex("hash").alias("block_hash"))
    own = packed.join(heads, "height").withColumns({h: F.lower(F.hex(h)) for h in ("tx_hash", "block_hash")})
    kind = (F.col("tx_index") % 3).alias("type")
    creates = F.col("txnum") % 50 == 0
    say = lambda letter, c: F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))
    named = own.withColumn("type", kind).withColumns({
        "price": F.when(F.col("type") == 2, F.least(F.col("fee_cap"), F.col("tip_cap") + F.col("base_fee"))).otherwise(F.col("fee_cap")),
        "parity": F.col("txnum") % 2, "chain_id": F.lit(1337), "access": F.array(F.struct(say("p", "emitter").alias("address"), F.array(F.concat(F.lit("k:"), (F.col("txnum") % 5).cast("string"))).alias("storageKeys"))),
        "to": F.when(~creates, say("s", "recipient")), "contract": F.when(creates, say("n", "txnum")), "root": F.when(F.col("height") < 100, F.concat(F.lit("0x"), hashed("r", F.col("txnum")))),
        "logs": F.when(F.col("tx_index") % 2 == 0, F.array(F.struct(say("p", "emitter").alias("address"), F.array(F.concat(F.lit("t:"), (F.col("txnum") % 3).cast("string"))).alias("topics"), F.lit("0x0").alias("logIndex")))).otherwise(F.array().cast("array<struct<address:string,topics:array<string>,logIndex:string>>")),
    })
    return named.withColumn("sender", say("c", "sender"))


WIRE_SQL = """
w AS (SELECT t.*, b.hash block_hash, tx_index % 3 kind, CASE WHEN tx_index % 3 = 2 THEN price ELSE fee_cap END paid, CASE WHEN txnum % 50 <> 0 THEN concat('"to":"s:', recipient, '",') ELSE '' END dest,
    concat('0x', lower(to_hex(t.height))) bn, concat('0x', lower(to_hex(tx_index))) ti, cast(sum(t.gas_used) OVER (PARTITION BY t.height ORDER BY tx_index) AS bigint) cumulative FROM txs t JOIN blocks b ON b.height = t.height),
wire AS (SELECT height, txnum, tx_index, tx_hash, concat('{"hash":"0x', tx_hash, '","type":"0x', kind, '","nonce":"0x', lower(to_hex(nonce)), '","blockHash":"0x', block_hash, '","blockNumber":"', bn, '","transactionIndex":"', ti, '","from":"c:', sender, '",', dest,
    '"gas":"0x32","gasPrice":"0x', lower(to_hex(paid)), '"', CASE WHEN kind = 2 THEN concat(',"maxFeePerGas":"0x', lower(to_hex(fee_cap)), '","maxPriorityFeePerGas":"0x', lower(to_hex(tip_cap)), '"') ELSE '' END,
    CASE WHEN kind > 0 THEN concat(',"chainId":"0x539","accessList":[{"address":"p:', emitter, '","storageKeys":["k:', txnum % 5, '"]}],"yParity":"0x', txnum % 2, '"') ELSE '' END, '}') json FROM w)
"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account versions (addr, txnum, balance, nonce, code_hash, present): purchases write an account, sign-ups with k < 5 delete it."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'signup')").withColumn("k", _k())
    code = F.when(F.col("user_id") % 3 == 0, hashed("code", F.col("user_id") % 7))
    return e.where("event_type = 'purchase' or k < 5").select(F.col("user_id").alias("addr"), F.col("event_id").alias("txnum"), F.col("value").alias("balance"), (F.col("event_id") % 7).alias("nonce"), code.alias("code_hash"), (F.col("event_type") == "purchase").alias("present"))


def genesis_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.when(F.col("c_nationkey") < 5, hashed("code", F.col("c_nationkey")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("addr"), F.col("c_acctbal").alias("balance"), F.lit(0).cast("long").alias("nonce"), nation.alias("code_hash"))


def codes(spark: SparkSession) -> DataFrame:
    return spark.range(7).select(hashed("code", F.col("id")).alias("code_hash"), F.concat(F.lit("bytes "), F.col("id").cast("string")).alias("code"))


ACCOUNTS_SQL = """
acc AS (SELECT user_id addr, event_id txnum, "value" balance, event_id % 7 nonce, CASE WHEN user_id % 3 = 0 THEN concat('bytes ', user_id % 7) END code, event_type = 'purchase' present FROM events
    WHERE event_type = 'purchase' OR (event_type = 'signup' AND cast(regexp_extract(props, '([0-9]+)', 1) AS int) < 5)),
gen AS (SELECT c_custkey addr, c_acctbal balance, CASE WHEN c_nationkey < 5 THEN concat('bytes ', c_nationkey) END code FROM customer)
"""


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def built_logs(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    """One log per event; multi: `error` has a fourth topic, as a transfer of several tokens has."""
    events = table(spark, sf_dir, "events")
    hour = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("ts")
    own = events.select(F.col("event_id").alias("txnum"), F.col("user_id").alias("emitter"), "event_type", _k().alias("k"), hour.alias("hour"))
    start = own.agg(F.min("hour").alias("start"))
    t1, t2, t3 = F.concat(F.lit("h:"), (F.col("k") % 20).cast("string")), F.concat(F.lit("h:"), (F.col("k") * 7 % 20).cast("string")), F.concat(F.lit("id:"), (F.col("txnum") % 50).cast("string"))
    sizes = {"signup": 1, "view": 2, "click": 3, "error": 4 if multi else 3, "purchase": 4}
    size = F.coalesce(*(F.when(F.col("event_type") == e, n) for e, n in sizes.items()))
    topics = F.slice(F.array("event_type", t1, t2, t3), F.lit(1), F.when(F.col("k") == 0, 0).otherwise(size))
    return own.crossJoin(F.broadcast(start)).select("txnum", (F.col("hour") - F.col("start")).alias("height"), F.lit(0).alias("log_index"), "emitter", topics.alias("topics"), "k")


def log_corpus(spark: SparkSession, sf_dir: str, multi: bool = False) -> Corpus:
    """Families: logs by slot, elog, tval and sig postings by their keys, the set rows."""

    def tables():
        own = written(built_logs(spark, sf_dir, multi), "built-logs")
        top = own.agg(F.max("txnum"), F.max("height")).head()
        rows = set_rows(own).withColumn("txnum", F.lit(0).cast("long"))
        return {"logs": own, "elog": elog_spots(own), "tval": tval_spots(own), "sig": sig(own), "set": rows}, (0, (top[0] if top[0] is not None else -1) + 1, 0, top[1] if top[1] is not None else -1), [own]

    return _stored(spark, sf_dir, f"logs-{multi}", tables)


def logs(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    return log_corpus(spark, sf_dir, multi).read(family="logs")


def _logs_sql(multi: bool) -> str:
    return f"""
ev AS (SELECT event_id txnum, user_id emitter, event_type t, cast(regexp_extract(props, '([0-9]+)', 1) AS int) k,
    date_diff('day', DATE '1970-01-01', cast(ts AS date)) * 24 + hour(ts) hh FROM events),
sized AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE CASE t WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'error' THEN {4 if multi else 3} ELSE 4 END END n FROM ev),
logs AS (SELECT txnum, emitter, k, n, hh - (SELECT min(hh) FROM ev) height, CASE WHEN n > 0 THEN t END t0, CASE WHEN n > 1 THEN concat('h:', k % 20) END t1,
    CASE WHEN n > 2 THEN concat('h:', k * 7 % 20) END t2, CASE WHEN n > 3 THEN concat('id:', txnum % 50) END t3 FROM sized)
"""


LOGS_SQL, MULTI_SQL = _logs_sql(False), _logs_sql(True)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot versions: cleared where k < 10."""
    return table(spark, sf_dir, "events").select(F.lit("s").alias("kind"), F.col("user_id").alias("addr"), F.col("event_type").alias("slot"), F.col("event_id").alias("txnum"), F.col("value").alias("val"), (_k() >= 10).alias("present"), _k().alias("k"))


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account deletions: sign-ups with k < 5."""
    return versions(spark, sf_dir).where("slot = 'signup' and k < 5").select("addr", "txnum")


def genesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("addr"), F.col("c_acctbal").alias("val"))


STATE_SQL = """
v AS (SELECT user_id addr, event_type slot, event_id txnum, "value" val, cast(regexp_extract(props, '([0-9]+)', 1) AS int) k,
    cast(regexp_extract(props, '([0-9]+)', 1) AS int) >= 10 present FROM events),
del AS (SELECT addr, txnum FROM v WHERE slot = 'signup' AND k < 5)
"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per event; see the fixture for what its calls depend on."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("txnum"), F.col("user_id").alias("u"), _k().alias("k"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    create = say('{"type":"CREATE","from":"u:', F.col("u"), '","to":"n:', F.col("txnum"), '"', F.when(F.col("k") % 10 == 0, ',"error":"execution reverted"').otherwise(""), "}")
    call = say('{"type":"CALL","from":"u:', F.col("u"), '","to":"p:', F.col("k") % 20, '","value":"0x1","calls":[{"type":"STATICCALL","from":"p:', F.col("k") % 20, '","to":"s:', F.col("k") % 7, '"}]}')
    delegate = say('{"type":"DELEGATECALL","from":"u:', F.col("u"), '","to":"d:', F.col("k") % 5, '","value":"0x5"}')
    calls = F.array_join(F.array_compact(F.array(F.when(F.col("k") % 5 == 0, create), F.when(F.col("k") % 3 == 0, call), F.when(F.col("k") % 7 == 0, delegate))), ",")
    return e.select("txnum", say('{"type":"CALL","from":"u:', F.col("u"), '","to":"p:', F.col("k"), '","calls":[', calls, "]}").alias("trace"))


TRACES_SQL = """
e AS (SELECT event_id txnum, user_id u, cast(regexp_extract(props, '([0-9]+)', 1) AS int) k FROM events),
f AS (
  SELECT txnum, 0 ord, 0 depth, 'CREATE' "type", concat('u:', u) "from", concat('n:', txnum) "to", NULL "value", CASE WHEN k % 10 = 0 THEN 'execution reverted' END error FROM e WHERE k % 5 = 0
  UNION ALL SELECT txnum, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END, 0, 'CALL', concat('u:', u), concat('p:', k % 20), '0x1', NULL FROM e WHERE k % 3 = 0
  UNION ALL SELECT txnum, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END, 1, 'STATICCALL', concat('p:', k % 20), concat('s:', k % 7), NULL, NULL FROM e WHERE k % 3 = 0
  UNION ALL SELECT txnum, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END, 0, 'DELEGATECALL', concat('u:', u), concat('d:', k % 5), '0x5', NULL FROM e WHERE k % 7 = 0)
"""
