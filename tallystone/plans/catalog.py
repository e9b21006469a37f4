"""Every registered query of the ledger operators with its DuckDB oracle, keyed by the survey's row names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.operators import fees, integrity, ledger, postings, state, traces
from tallystone.operators import logs as L
from tallystone.operators.scaling import newest
from tallystone.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = ""):
    """Registers a function under its name, and its oracle."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {ctes.strip()}\n{sql}" if ctes else sql
        return f

    return take


one = {"ctes": B.LEDGER_SQL}
two = {"ctes": B.LOGS_SQL}
many = {"ctes": B.MULTI_SQL}
three = {"ctes": B.STATE_SQL}
four = {"ctes": B.TRACES_SQL}

# blocks and transactions


@query("SELECT height, tx_count, first_tx, boundary_tx FROM blocks", **one)
def s7_slot_assignment(spark, d):
    return B.blocks(spark, d).select("height", "tx_count", "first_tx", "boundary_tx")


@query("SELECT txnum, height, tx_index, sender, recipient, emitter, gas_used, status FROM txs", **one)
def tx_table(spark, d):
    return B.txs(spark, d).select("txnum", "height", "tx_index", "sender", "recipient", "emitter", "gas_used", "status")


@query("SELECT txnum, height, tx_hash FROM txs WHERE txnum = 1234", **one)
def s1_point_get(spark, d):
    return B.txs(spark, d).where("txnum = 1234").select("txnum", "height", "tx_hash")


@query("SELECT height, hash, tx_count FROM blocks WHERE height = 77", **one)
def s2_chain_row(spark, d):
    return B.blocks(spark, d).where("height = 77").select("height", "hash", "tx_count")


@query("SELECT height, tx_count, gas_used FROM blocks WHERE height BETWEEN 100 AND 250", **one)
def s3_chain_rows(spark, d):
    return ledger.rows_between(B.blocks(spark, d), "height", 100, 250).select("height", "tx_count", "gas_used")


@query("SELECT txnum, tx_hash FROM txs WHERE txnum >= 2000 AND txnum < 2500", **one)
def s4_scan_half_open(spark, d):
    return ledger.rows_between(B.txs(spark, d), "txnum", 2000, 2500, half_open=True).select("txnum", "tx_hash")


def _wanted(spark):
    return spark.range(0, 600, 7).select(B.hashed("t", F.col("id") * 11).alias("wanted"))


def _known(spark, d):
    """The hash rows of the transactions wanted: a short list, looked up in the family sorted by hash."""
    return postings.fetched(B.hashes(spark, d), "digest", postings.numbers_of(_wanted(spark), "wanted")).where("kind = 't'")


WANTED = "w AS (SELECT sha256(concat('t', id * 11)) wanted FROM range(0, 600, 7) r(id))"


@query("SELECT wanted, txnum, height FROM w LEFT JOIN txs ON tx_hash = wanted", ctes=B.LEDGER_SQL.rstrip() + ",\n" + WANTED)
def s5_hash_lookup(spark, d):
    return ledger.by_hash(_wanted(spark), _known(spark, d), "digest").drop("kind")


@query("SELECT height, hash, parent_hash, base_fee, gas_used, gas_limit, miner FROM blocks", **one)
def s6_headers(spark, d):
    return B.blocks(spark, d).select("height", "hash", "parent_hash", "base_fee", "gas_used", "gas_limit", "miner")


@query("SELECT txnum FROM v WHERE txnum BETWEEN 300 AND 700", **three)
def s8_state_sweep(spark, d):
    return B.versions(spark, d).where("txnum between 300 and 700").select("txnum")


@query("SELECT height, cast(sum(tx_count + 1) OVER (ORDER BY height DESC) AS bigint) bytes FROM (SELECT * FROM blocks WHERE height <= 900 ORDER BY height DESC LIMIT 200) QUALIFY sum(tx_count + 1) OVER (ORDER BY height DESC) <= 500 OR height = 900", **one)
def s14_ancestors(spark, d):
    return ledger.ancestors(B.blocks(spark, d).withColumn("size", F.col("tx_count") + 1), 900, 200, 500).select("height", "bytes")


@query("SELECT p txnum, height FROM (SELECT id * 13 p FROM range(0, 400) r(id)) JOIN blocks ON p BETWEEN first_tx AND boundary_tx", **one)
def j1_height_of_tx(spark, d):
    return ledger.height_of(spark.range(0, 400).select((F.col("id") * 13).alias("txnum")), B.blocks(spark, d))


@query("SELECT txnum, height, tx_index, tx_hash, status, gas_used, cast(sum(gas_used) OVER (PARTITION BY height ORDER BY tx_index) AS bigint) cumulative_gas, price, tx_count FROM txs", **one)
def j2_receipts(spark, d):
    return ledger.receipts(B.txs(spark, d), B.blocks(spark, d))


@query("SELECT b.height, b.hash, b.tx_count, coalesce(string_agg(tx_hash, ',' ORDER BY tx_index), '') hashes FROM blocks b LEFT JOIN txs USING (height) GROUP BY ALL", **one)
def j3_block_assembly(spark, d):
    return ledger.assembled(B.blocks(spark, d), B.txs(spark, d)).select("height", "hash", "tx_count", F.array_join("hashes", ",").alias("hashes"))


@query("SELECT t.tx_hash, txnum, t.height, tx_index, hash FROM txs t JOIN blocks b ON b.height = t.height JOIN w ON wanted = tx_hash", ctes=B.LEDGER_SQL.rstrip() + ",\n" + WANTED)
def j4_find_tx(spark, d):
    found = postings.fetched(B.txs(spark, d), "txnum", postings.numbers_of(_known(spark, d), "txnum"))
    own = postings.fetched(B.blocks(spark, d), "height", postings.numbers_of(found, "height"))
    return found.join(own.select("height", "hash"), "height").select("tx_hash", "txnum", "height", "tx_index", "hash")


@query("SELECT wanted FROM w WHERE wanted NOT IN (SELECT tx_hash FROM txs)", ctes=B.LEDGER_SQL.rstrip() + ",\n" + WANTED)
def j9_unknown_hashes(spark, d):
    return _wanted(spark).join(_known(spark, d), F.col("wanted") == F.col("digest"), "left_anti")


@query("SELECT txnum, cast(sum(gas_used) OVER (PARTITION BY height ORDER BY tx_index) AS bigint) cumulative_gas FROM txs", **one)
def a7_cumulative_gas(spark, d):
    upto = Window.partitionBy("height").orderBy("tx_index").rowsBetween(Window.unboundedPreceding, 0)
    return B.txs(spark, d).select("txnum", F.sum("gas_used").over(upto).alias("cumulative_gas"))


@query("SELECT b.height, b.tx_count, coalesce(cast(sum(price * t.gas_used) AS bigint), 0) total_fees, 0 issuance FROM blocks b LEFT JOIN txs t USING (height) GROUP BY 1, 2", **one)
def a8_q14_block_details(spark, d):
    return ledger.block_details(B.blocks(spark, d), B.txs(spark, d))


@query("SELECT height, hash, boundary_tx - (SELECT count(*) - 1 FROM blocks) txs FROM blocks ORDER BY height DESC LIMIT 1", **one)
def a9_q19_head(spark, d):
    return ledger.head(B.blocks(spark, d))


ORACLE_PRICE = """r AS (SELECT height, tx_count FROM blocks WHERE tx_count > 0 ORDER BY height DESC LIMIT 20),
u AS (SELECT height, coalesce(sum(tx_count) OVER (ORDER BY height DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) seen FROM r),
p AS (SELECT price, row_number() OVER (ORDER BY price) - 1 rk, count(*) OVER () c FROM txs JOIN u USING (height) WHERE seen < 100),
price AS (SELECT price FROM p WHERE rk = c * 60 // 100)"""


@query("SELECT price FROM price", ctes=B.LEDGER_SQL.rstrip() + ",\n" + ORACLE_PRICE)
def a10_gas_oracle(spark, d):
    return fees.oracle_price(B.blocks(spark, d), B.txs(spark, d), 1)


@query("SELECT price, greatest(t * 95 // 100, 1) slow_tip, t normal_tip, (price - 500) * 105 // 100 fast_tip, greatest(t * 95 // 100, 1) + 1200 slow_cap, t + 1200 normal_cap, (price - 500) * 105 // 100 + 1200 fast_cap FROM (SELECT price, least(greatest(price - 500, 0), 20000000000) t FROM price)", ctes=B.LEDGER_SQL.rstrip() + ",\n" + ORACLE_PRICE)
def f17_q21_suggestions(spark, d):
    return fees.suggestions(fees.oracle_price(B.blocks(spark, d), B.txs(spark, d), 1), 500, 600)


def _reward(i: int, p: float) -> str:
    return f"coalesce(coalesce(min(CASE WHEN sofar >= floor(block_gas * {p} / 100) THEN tip END), max(tip)), 0) reward_{i}"


REWARDS = """t AS (SELECT height, least(tip_cap, fee_cap - base_fee) tip, block_gas, sum(gas_used) OVER (PARTITION BY height ORDER BY least(tip_cap, fee_cap - base_fee), tx_index) sofar FROM txs)"""


@query(f"SELECT b.height, {', '.join(_reward(i, p) for i, p in enumerate((0.0, 25.0, 60.0, 100.0)))} FROM blocks b LEFT JOIN t USING (height) GROUP BY 1", ctes=B.LEDGER_SQL.rstrip() + ",\n" + REWARDS)
def a11_tip_percentiles(spark, d):
    return fees.rewards(B.blocks(spark, d), B.txs(spark, d), [0.0, 25.0, 60.0, 100.0])


@query(f"SELECT b.height, b.base_fee, CASE WHEN b.gas_limit = 0 THEN 0.0 ELSE cast(b.gas_used AS double) / b.gas_limit END ratio, {_reward(0, 10.0)}, {_reward(1, 90.0)} FROM blocks b LEFT JOIN t USING (height) WHERE b.height BETWEEN 873 AND 1000 GROUP BY ALL", ctes=B.LEDGER_SQL.rstrip() + ",\n" + REWARDS)
def q20_fee_history(spark, d):
    return fees.history(B.blocks(spark, d), B.txs(spark, d), 128, 1000, [10.0, 90.0])


@query("SELECT height, CASE WHEN gas_limit = 0 THEN 0.0 ELSE cast(gas_used AS double) / gas_limit END ratio FROM blocks", **one)
def a12_gas_ratio(spark, d):
    return B.blocks(spark, d).select("height", F.when(F.col("gas_limit") == 0, F.lit(0.0)).otherwise(F.col("gas_used") / F.col("gas_limit")).alias("ratio"))


@query("SELECT b.height, cast(b.gas_limit - coalesce(sum(t.gas_limit), 0) + coalesce(sum(t.gas_used), 0) AS bigint) consumed FROM blocks b LEFT JOIN txs t USING (height) GROUP BY b.height, b.gas_limit", **one)
def a13_consumed_gas(spark, d):
    return ledger.consumed_gas(B.blocks(spark, d), B.txs(spark, d))


@query("SELECT count(*) n, cast(max(tx_count) AS bigint) most, cast(sum(tx_count) AS bigint) total, CASE WHEN count(*) = 1 THEN 'single' WHEN min(tx_count) = max(tx_count) THEN 'uniform' ELSE 'skewed' END shape, CASE WHEN sum(tx_count) > 100000000 OR count(*) > 10000000 THEN 'reject' ELSE 'accept' END verdict FROM blocks", **one)
def a23_probe_statistics(spark, d):
    b = B.blocks(spark, d).agg(F.count("*").alias("n"), F.max("tx_count").alias("most"), F.min("tx_count").alias("least"), F.sum("tx_count").alias("total"))
    shape = F.when(F.col("n") == 1, "single").when(F.col("least") == F.col("most"), "uniform").otherwise("skewed")
    verdict = F.when((F.col("total") > 100_000_000) | (F.col("n") > 10_000_000), "reject").otherwise("accept")
    return b.select("n", "most", "total", shape.alias("shape"), verdict.alias("verdict"))


@query("SELECT height, gas, txs FROM (SELECT height, cast(sum(gas_used) OVER (ORDER BY height) AS bigint) gas, cast(sum(tx_count) OVER (ORDER BY height) AS bigint) txs FROM blocks WHERE height BETWEEN 10 AND 1400) WHERE height % 500 = 0 OR height = 1400", **one)
def a24_archive_sweep(spark, d):
    return ledger.swept(B.blocks(spark, d), 10, 1400, 500)


@query("SELECT txnum, price, least(tip_cap, fee_cap - base_fee) tip FROM txs", **one)
def f10_f11_effective_prices(spark, d):
    joined = B.txs(spark, d).join(B.blocks(spark, d).select("height", "base_fee"), "height")
    return joined.select("txnum", ledger.effective_price().alias("price"), ledger.effective_tip().alias("tip"))


@query("SELECT txnum, tx_index, tx_hash FROM txs WHERE height = 5 AND tx_index BETWEEN 2 AND 3", **one)
def k6_q15_block_page(spark, d):
    return ledger.page_of_block(B.txs(spark, d), 5, 1, 2).select("txnum", "tx_index", "tx_hash")


@query("SELECT txnum, nonce FROM txs WHERE sender = 7 AND nonce = 3", **one)
def q11_sender_and_nonce(spark, d):
    return B.stored_postings(spark, d).where("addr = 'c:7' and nonce = 3").select("txnum", "nonce")


@query("SELECT txnum, sender, nonce FROM txs", **one)
def nonces(spark, d):
    return B.txs(spark, d).select("txnum", "sender", "nonce")


@query("SELECT b.height, b.hash, count(t.txnum) txs FROM blocks b LEFT JOIN txs t USING (height) WHERE b.hash = sha256('b321') GROUP BY 1, 2", **one)
def q16_block_by_hash(spark, d):
    at = postings.numbers_of(B.hashes(spark, d).where((F.col("digest") == F.sha2(F.lit("b321"), 256)) & (F.col("kind") == "b")), "height")
    own, inside = postings.fetched(B.blocks(spark, d), "height", at), postings.fetched(B.txs(spark, d), "height", at)
    return own.join(inside.select("height", "txnum"), "height", "left").groupBy("height", "hash").agg(F.count("txnum").alias("txs"))


@query("SELECT txnum, height, tx_index, tx_hash, status, gas_used, cast(sum(gas_used) OVER (PARTITION BY height ORDER BY tx_index) AS bigint) cumulative_gas, price, tx_count FROM txs WHERE height = 321", **one)
def q17_block_receipts(spark, d):
    return ledger.receipts(B.txs(spark, d).where("height = 321"), B.blocks(spark, d).where("height = 321"))


@query("SELECT 40 first, 60 last, count(*) = 21 accessible FROM blocks WHERE height BETWEEN 40 AND 60", **one)
def q26_accessible_state(spark, d):
    return B.blocks(spark, d).where("height between 40 and 60").agg(F.lit(40).alias("first"), F.lit(60).alias("last"), (F.count("*") == 21).alias("accessible"))


# integrity


def _damaged(spark, d):
    """The blocks with planted breaks: wrong parents at 5 of 97 heights, shifted slots at 3 of 89, wrong counts at 7 of 101."""
    b, h = B.blocks(spark, d), F.col("height")
    parent = F.when(h % 97 == 5, F.lit("?")).otherwise(F.col("parent_hash"))
    return b.withColumns({"parent_hash": parent, "first_tx": F.when(h % 89 == 3, F.col("first_tx") + 1).otherwise(F.col("first_tx")), "tx_count": F.when(h % 101 == 7, F.col("tx_count") + 1).otherwise(F.col("tx_count"))})


DAMAGED = "d AS (SELECT height, hash, boundary_tx, CASE WHEN height % 97 = 5 THEN '?' ELSE parent_hash END parent_hash, CASE WHEN height % 89 = 3 THEN first_tx + 1 ELSE first_tx END first_tx, CASE WHEN height % 101 = 7 THEN tx_count + 1 ELSE tx_count END tx_count FROM blocks)"
broken = {"ctes": B.LEDGER_SQL.rstrip() + ",\n" + DAMAGED}


@query("SELECT b.height, b.hash FROM d b LEFT JOIN d p ON p.height = b.height - 1 WHERE b.height > 0 AND p.hash IS DISTINCT FROM b.parent_hash", **broken)
def v1_hash_chain(spark, d):
    return integrity.broken_links(_damaged(spark, d)).select("height", "hash")


@query("SELECT b.height, b.first_tx FROM d b JOIN d p ON p.height = b.height - 1 WHERE b.first_tx <> p.boundary_tx + 1", **broken)
def v2_contiguity(spark, d):
    return integrity.torn_slots(_damaged(spark, d)).select("height", "first_tx")


@query("SELECT h height, cast(1 AS bigint) changes FROM (SELECT DISTINCT txnum // 40 h FROM v WHERE present) WHERE h NOT IN (SELECT txnum // 40 FROM v WHERE k % 20 = 0)", **three)
def v3_roots_without_rows(spark, d):
    v = B.versions(spark, d).withColumn("height", F.floor(F.col("txnum") / 40))
    changed = v.where("present").select("height").distinct().withColumn("changes", F.lit(1).cast("long"))
    return integrity.roots_without_rows(changed, v.where("k % 20 = 0")).select("height", "changes")


@query("SELECT b.height FROM d b LEFT JOIN txs t ON t.height = b.height AND t.txnum % 113 <> 9 GROUP BY b.height, b.tx_count HAVING count(t.txnum) <> b.tx_count", **broken)
def v4_density(spark, d):
    """Against rows of which every 113th from 9 on is missing."""
    return integrity.sparse_blocks(_damaged(spark, d), B.txs(spark, d).where("txnum % 113 <> 9")).select("height")


@query("SELECT (SELECT count(*) FROM blocks) blocks, (SELECT count(*) FROM txs) txs, (SELECT count(*) FROM d b JOIN d p ON p.height = b.height - 1 WHERE p.hash <> b.parent_hash) links, (SELECT count(*) FROM d b JOIN d p ON p.height = b.height - 1 WHERE b.first_tx <> p.boundary_tx + 1) slots", **broken)
def v7_walked(spark, d):
    """What a verification walked and found, in one row; nothing walked would be an error."""
    bad = _damaged(spark, d)
    walked = B.blocks(spark, d).agg(F.count("*").alias("blocks")).withColumn("blocks", F.when(F.col("blocks") == 0, F.raise_error(F.lit("nothing was walked")).cast("long")).otherwise(F.col("blocks")))
    parts = [B.txs(spark, d).agg(F.count("*").alias("txs")), integrity.broken_links(bad).agg(F.count("*").alias("links")), integrity.torn_slots(bad).agg(F.count("*").alias("slots"))]
    for part in parts:  # one row each
        walked = walked.crossJoin(F.broadcast(part))
    return walked


@query("SELECT height, hash FROM (SELECT height, hash, height * 8 // (SELECT count(*) FROM blocks) band, row_number() OVER (PARTITION BY height * 8 // (SELECT count(*) FROM blocks) ORDER BY hash) rk FROM blocks) WHERE rk <= 5", **one)
def v11_band_sample(spark, d):
    return integrity.band_sample(B.blocks(spark, d), 8, 5).select("height", "hash")


# postings and pages


@query("SELECT addr, txnum, roles FROM post", **one)
def a1_address_postings(spark, d):
    return B.stored_postings(spark, d).select("addr", "txnum", "roles")


@query("SELECT addr, min(txnum) first, count(*) n, string_agg(txnum, ',' ORDER BY txnum) txnums FROM (SELECT addr, txnum, (row_number() OVER (PARTITION BY addr ORDER BY txnum) - 1) // 16 c FROM post) GROUP BY addr, c", **one)
def a2_chunks(spark, d):
    return postings.chunked(B.stored_postings(spark, d), ["addr"], 16).select("addr", "first", "n", F.array_join(F.col("txnums").cast("array<string>"), ",").alias("txnums"))


@query("SELECT txnum, roles FROM post WHERE addr = 's:7' ORDER BY txnum LIMIT 20", **one)
def k1_walk_up(spark, d):
    return _own(spark, d, "s:7").orderBy("txnum").limit(20).select("txnum", "roles")


@query("SELECT txnum, roles FROM post WHERE addr = 's:7' ORDER BY txnum DESC LIMIT 20", **one)
def k2_walk_down(spark, d):
    return _own(spark, d, "s:7").orderBy(F.desc("txnum")).limit(20).select("txnum", "roles")


def _own(spark, d, addr):
    """An address's postings: the family is sorted by address, so that only its rows are read."""
    return B.stored_postings(spark, d).where(F.col("addr") == addr).select("addr", "txnum", "height", "roles")


@query("SELECT txnum, height, roles, tx_hash FROM post JOIN txs USING (txnum, height) WHERE addr = 's:7' AND txnum <= 4000 ORDER BY txnum DESC LIMIT 26", **one)
def k3_q10_search_by_address(spark, d):
    page = postings.keyset_rows(_own(spark, d, "s:7"), 4000, 25, True)
    own = postings.fetched(B.txs(spark, d), "txnum", postings.numbers_of(page, "txnum"))
    return page.join(F.broadcast(own.select("txnum", "tx_hash")), "txnum").select("txnum", "height", "roles", "tx_hash")  # 26 rows at most


@query("SELECT height, txnum FROM post WHERE addr = 's:7' AND height < 900 ORDER BY height DESC, txnum DESC LIMIT 25", **one)
def k5_search_before(spark, d):
    return postings.side_page(_own(spark, d, "s:7"), 900, 25, True).select("height", "txnum")


@query("SELECT height, txnum FROM post WHERE addr = 's:7' AND height > 300 ORDER BY height, txnum LIMIT 25", **one)
def k5_search_after(spark, d):
    return postings.side_page(_own(spark, d, "s:7"), 300, 25, False).select("height", "txnum")


@query("SELECT addr, txnum FROM post WHERE roles & 9 <> 0", **one)
def p4_payload_mask(spark, d):
    return postings.with_mask(B.stored_postings(spark, d), "roles", postings.SENDER | postings.EMITTER).select("addr", "txnum")


@query("SELECT roles, concat_ws('+', CASE WHEN roles & 1 <> 0 THEN 'sender' END, CASE WHEN roles & 2 <> 0 THEN 'recipient' END, CASE WHEN roles & 8 <> 0 THEN 'emitter' END) names, count(*) n FROM post GROUP BY 1, 2", **one)
def f16_role_names(spark, d):
    return B.stored_postings(spark, d).groupBy("roles").agg(F.count("*").alias("n")).select("roles", F.array_join(postings.role_names(F.col("roles")), "+").alias("names"), "n")


@query("SELECT DISTINCT split_part(addr, ':', 1) kind, addr FROM post WHERE addr LIKE 's:%'", **one)
def a6_groups(spark, d):
    own = B.stored_postings(spark, d).where(F.col("addr").startswith("s:"))
    return own.select(F.substring_index("addr", ":", 1).alias("kind"), "addr").distinct()


# logs


def _topics(df: DataFrame) -> DataFrame:
    return df.withColumn("topics", F.array_join("topics", "|"))


ROW = "txnum, height, emitter, concat_ws('|', t0, t1, t2, t3) topics"


@query(f"SELECT {ROW} FROM logs WHERE height BETWEEN 1 AND 500 AND t0 IN ('click', 'purchase') AND t2 IN ('h:7', 'h:1')", **two)
def p1_q1_get_logs(spark, d):
    what = L.criteria(1, 500, 719, None, [["click", "purchase"], None, ["h:7", "h:1"]])
    return _topics(L.get_logs(B.logs(spark, d), what)).select("txnum", "height", "emitter", "topics")


@query(f"SELECT {ROW} FROM logs WHERE height BETWEEN 1 AND 400 AND emitter IN (3, 5, 8)", **two)
def p2_emitters_and_clamped_start(spark, d):
    return _topics(L.get_logs(B.logs(spark, d), L.criteria(0, 400, 719, [3, 5, 8], [None, None]))).select("txnum", "height", "emitter", "topics")


@query(f"SELECT {ROW} FROM logs WHERE height = 12", **two)
def p3_logs_of_a_block(spark, d):
    return _topics(L.get_logs(B.logs(spark, d), L.criteria(12, 12, 719))).select("txnum", "height", "emitter", "topics")


@query("SELECT DISTINCT txnum FROM logs WHERE t0 = 'click' AND emitter IN (3, 5, 8, 11) AND t1 IN ('h:1', 'h:2', 'h:3', 'h:4')", **two)
def j5_q2_candidates(spark, d):
    return _candidates(spark, d, [3, 5, 8, 11], [["click"], ["h:1", "h:2", "h:3", "h:4"]])


def _candidates(spark, d, emitters, topics):
    own = B.log_corpus(spark, d)
    return L.candidates(B.logs(spark, d), emitters, topics, own.read(family="elog"), own.read(family="tval"), own.read(family="sig"))


@query(f"SELECT {ROW} FROM logs WHERE t0 = 'click' AND emitter IN (3, 5, 8, 11) AND t1 IN ('h:1', 'h:2')", **two)
def j10_recheck(spark, d):
    logs, topics = B.logs(spark, d), [["click"], ["h:1", "h:2"]]
    return _topics(logs.join(_candidates(spark, d, [3, 5, 8, 11], topics), "txnum", "left_semi").where(L.matches([3, 5, 8, 11], topics))).select("txnum", "height", "emitter", "topics")


@query("SELECT DISTINCT emitter, coalesce(t0, '0') topic0, txnum FROM logs", **two)
def elog_postings(spark, d):
    return L.elog(B.logs(spark, d))


TVAL = "s AS (SELECT txnum, t0, t1 value, 1 pos FROM logs WHERE t1 IS NOT NULL UNION ALL SELECT txnum, t0, t2, 2 FROM logs WHERE t2 IS NOT NULL UNION ALL SELECT txnum, t0, t3, 4 FROM logs WHERE t3 IS NOT NULL)"


@query("SELECT value, t0 topic0, txnum, bit_or(pos) pos FROM s GROUP BY 1, 2, 3", ctes=B.LOGS_SQL.rstrip() + ",\n" + TVAL)
def tval_postings(spark, d):
    return L.tval(B.logs(spark, d))


@query("SELECT DISTINCT t0 topic0, txnum FROM logs WHERE n > 0", **two)
def sig_postings(spark, d):
    return L.sig(B.logs(spark, d))


SETS = "s AS (SELECT t0 topic0, 1 pos, t1 value, emitter FROM logs WHERE t1 IS NOT NULL UNION SELECT t0, 2, t2, emitter FROM logs WHERE t2 IS NOT NULL UNION SELECT t0, 3, t3, emitter FROM logs WHERE t3 IS NOT NULL)"


@query("SELECT topic0, pos, value, emitter FROM s", ctes=B.LOGS_SQL.rstrip() + ",\n" + SETS)
def a5_set_rows(spark, d):
    return B.log_corpus(spark, d).read(family="set").drop("txnum")


@query("SELECT pos, emitter FROM s WHERE value = 'h:3' AND topic0 = 'click'", ctes=B.LOGS_SQL.rstrip() + ",\n" + SETS)
def q6_topic_groups(spark, d):
    return B.log_corpus(spark, d).read(family="set").where("value = 'h:3' and topic0 = 'click'").select("pos", "emitter")


def _paged(where: str, ctes: str, limit: int) -> dict:
    """Oracle of a log page: whole transactions, descending from a cursor."""
    text = f"""m AS (SELECT * FROM logs WHERE {where}), r AS (SELECT txnum, row_number() OVER (ORDER BY txnum DESC) rk FROM (SELECT DISTINCT txnum FROM m))"""
    sql = f"SELECT m.txnum, emitter, (SELECT count(*) FROM r) > {limit} more, (SELECT txnum FROM r WHERE rk = {limit + 1}) next_cursor FROM m JOIN r USING (txnum) WHERE rk <= {limit}"
    return {"sql": sql, "ctes": ctes.rstrip() + ",\n" + text}


@query(**_paged("emitter = 3 AND txnum <= 9000", B.LOGS_SQL, 10))
def k4_q4_logs_by_emitter(spark, d):
    return postings.log_page(B.log_corpus(spark, d).read(family="elog").where("emitter = 3"), B.logs(spark, d), 9000, 10, True).select("txnum", "emitter", "more", "next_cursor")


@query(**_paged("(t1 = 'h:7' OR t3 = 'h:7') AND t0 = 'purchase' AND txnum <= 9500", B.LOGS_SQL, 10))
def q5_logs_by_topic_value(spark, d):
    spots = B.log_corpus(spark, d).read(family="tval").where("value = 'h:7' and topic0 = 'purchase' and pos & 5 <> 0")
    return postings.log_page(spots, B.logs(spark, d), 9500, 10, True).select("txnum", "emitter", "more", "next_cursor")


@query(**_paged("((t0 IN ('click', 'purchase') AND n IN (3, 4) AND 'h:7' IN (t1, t2)) OR (t0 = 'error' AND n = 4 AND 'h:7' IN (t2, t3))) AND txnum <= 9999", B.MULTI_SQL, 15))
def q7_transfers_by_holder(spark, d):
    spots = L.holder_spots(B.log_corpus(spark, d, multi=True).read(family="tval"), "h:7", B.TRANSFER, B.MULTI)
    return postings.log_page(spots, B.logs(spark, d, multi=True), 9999, 15, True).select("txnum", "emitter", "more", "next_cursor")


@query(**_paged("t0 IN ('click', 'purchase') AND n = 3 AND emitter = 4", B.MULTI_SQL, 15))
def q8_transfers_by_contract(spark, d):
    spots = L.contract_spots(B.log_corpus(spark, d, multi=True).read(family="elog"), 4, B.TRANSFER, B.MULTI, "erc20")
    return postings.log_page(spots, B.logs(spark, d, multi=True), None, 15, True).select("txnum", "emitter", "more", "next_cursor")


@query("SELECT DISTINCT emitter token, CASE WHEN t0 = 'error' THEN 'erc1155' WHEN n = 3 THEN 'erc20' ELSE 'erc721' END standard FROM logs l WHERE n > 2 AND EXISTS (SELECT 1 FROM logs m WHERE m.emitter = l.emitter AND m.t0 = l.t0 AND ((m.t0 IN ('click', 'purchase') AND 'h:3' IN (m.t1, m.t2)) OR (m.t0 = 'error' AND 'h:3' IN (m.t2, m.t3))))", **many)
def q9_token_contracts(spark, d):
    own = B.log_corpus(spark, d, multi=True)
    counts = own.read(family="elog").where("n_topics > 0").select("emitter", "topic0", "n_topics").distinct()
    return L.token_contracts(own.read(family="set"), counts, "h:3", B.TRANSFER, B.MULTI)


@query("SELECT CASE WHEN t0 = 'error' AND n = 4 THEN 'erc1155' WHEN n = 3 THEN 'erc20' ELSE 'erc721' END standard, count(*) n FROM logs WHERE (t0 IN ('click', 'purchase') AND n IN (3, 4)) OR (t0 = 'error' AND n = 4) GROUP BY 1", **many)
def p6_standards(spark, d):
    named = B.logs(spark, d, multi=True).withColumn("standard", L.standard_of(B.TRANSFER, B.MULTI))
    return named.where("standard is not null").groupBy("standard").agg(F.count("*").alias("n"))


@query("SELECT t0 topic0, n, cast(sum(n) OVER (ORDER BY n DESC, t0) AS bigint) cumulative, total FROM (SELECT coalesce(t0, '0') t0, count(*) n, cast(sum(count(*)) OVER () AS bigint) total FROM logs GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20)", **two)
def a18_topic_profile(spark, d):
    return L.topic_profile(B.logs(spark, d), 20)


@query("SELECT pos, count(*) n, count(DISTINCT value) kinds FROM (SELECT 0 pos, t0 value FROM logs WHERE n > 0 UNION ALL SELECT 1, t1 FROM logs WHERE n > 1 UNION ALL SELECT 2, t2 FROM logs WHERE n > 2 UNION ALL SELECT 3, t3 FROM logs WHERE n > 3) GROUP BY 1", **two)
def a18_position_profile(spark, d):
    return L.position_profile(B.logs(spark, d))


@query("SELECT value holder, count(*) postings, count(DISTINCT emitter) emitters, list_extract(list_sort(list(per), 'DESC'), cast(floor(count(*) * 0.5) AS int) + 1) p50, list_extract(list_sort(list(per), 'DESC'), cast(floor(count(*) * 0.01) AS int) + 1) p99, max(per) most FROM (SELECT s.value, s.txnum, l.emitter, count(*) OVER (PARTITION BY s.value, l.emitter) per FROM s JOIN logs l USING (txnum)) GROUP BY 1", ctes=B.LOGS_SQL.rstrip() + ",\n" + TVAL)
def a19_holder_profile(spark, d):
    return L.holder_profile(B.logs(spark, d).select("txnum", "emitter", F.explode(F.slice("topics", 2, 3)).alias("holder")))


@query("SELECT holder, cast(sum(m) AS bigint) net, count(DISTINCT (emitter, t3)) ids FROM (SELECT t1 holder, -1 m, emitter, t3 FROM logs WHERE t0 IN ('click', 'purchase') AND n = 4 UNION ALL SELECT t2, 1, emitter, t3 FROM logs WHERE t0 IN ('click', 'purchase') AND n = 4) GROUP BY 1", **two)
def a20_net_flow(spark, d):
    return L.net_flow(B.logs(spark, d), B.TRANSFER)


FAMILIES = """f AS (SELECT DISTINCT 'elog' family, concat_ws('/', emitter, coalesce(t0, '0')) k, cast(txnum AS varchar) v, cast(emitter AS varchar) c FROM logs
UNION ALL SELECT DISTINCT 'sig', t0, cast(txnum AS varchar), t0 FROM logs WHERE n > 0
UNION ALL SELECT 'tval', concat_ws('/', value, t0), concat_ws('/', txnum, bit_or(pos)), value FROM s GROUP BY value, t0, txnum
UNION ALL SELECT 'set', concat_ws('/', topic0, pos, value), cast(emitter AS varchar), topic0 FROM (SELECT DISTINCT t0 topic0, CASE pos WHEN 4 THEN 3 ELSE pos END pos, value, emitter FROM s JOIN logs USING (txnum, t0)))"""


@query("SELECT family, count(*) rows, count(DISTINCT k) groups, count(DISTINCT c) firsts, cast(sum(length(k)) AS bigint) key_bytes, cast(sum(length(v)) AS bigint) value_bytes FROM f GROUP BY 1", ctes=B.LOGS_SQL.rstrip() + ",\n" + TVAL + ",\n" + FAMILIES)
def a21_family_statistics(spark, d):
    """Rows, distinct keys and first components, and bytes of keys and values, of the four posting families."""
    logs = B.logs(spark, d)
    both = lambda *c: F.concat_ws("/", *(F.col(x).cast("string") for x in c))
    parts = {
        "elog": L.elog(logs).select(both("emitter", "topic0").alias("k"), F.col("txnum").cast("string").alias("v"), F.col("emitter").cast("string").alias("c")),
        "sig": L.sig(logs).select(F.col("topic0").alias("k"), F.col("txnum").cast("string").alias("v"), F.col("topic0").alias("c")),
        "tval": L.tval(logs).select(both("value", "topic0").alias("k"), both("txnum", "pos").alias("v"), F.col("value").alias("c")),
        "set": L.set_rows(logs).select(both("topic0", "pos", "value").alias("k"), F.col("emitter").cast("string").alias("v"), F.col("topic0").alias("c")),
    }
    return reduce(DataFrame.unionByName, (L.family_statistics(p, name) for name, p in parts.items()))


@query("SELECT DISTINCT h holder, emitter FROM (SELECT t1 h, emitter FROM logs WHERE t0 IN ('click', 'purchase') AND n >= 3 UNION ALL SELECT t2, emitter FROM logs WHERE t0 IN ('click', 'purchase') AND n >= 3)", **two)
def j12_holder_pairs(spark, d):
    return L.holder_pairs(B.logs(spark, d), B.TRANSFER)


@query("SELECT txnum FROM logs WHERE t0 = 'view' INTERSECT SELECT txnum FROM logs WHERE t1 IN ('h:2', 'h:4')", **two)
def u2_intersection(spark, d):
    logs = B.logs(spark, d)
    at = lambda i: F.get("topics", F.lit(i))
    return logs.where(at(0) == "view").select("txnum").intersect(logs.where(at(1).isin("h:2", "h:4")).select("txnum"))


@query("SELECT DISTINCT txnum FROM logs WHERE emitter IN (1, 2) OR t1 = 'h:5'", **two)
def u1_union(spark, d):
    logs = B.logs(spark, d)
    return logs.where("emitter in (1, 2)").select("txnum").unionByName(logs.where(F.get("topics", F.lit(1)) == "h:5").select("txnum")).distinct()


# state


@query("SELECT addr, slot, max(txnum) txnum, arg_max(val, txnum) val, arg_max(present, txnum) present FROM v WHERE txnum <= 5000 GROUP BY 1, 2", **three)
def a4_frontier(spark, d):
    return state.frontier(B.versions(spark, d), 5000)


def _probes(spark):
    p = spark.range(0, 300).select((F.col("id") % 40).alias("addr"), F.element_at(F.array(*map(F.lit, ("view", "click", "signup", "nothing"))), (F.col("id") % 4 + 1).cast("int")).alias("slot"), (F.col("id") * 37).alias("at"))
    return p


PROBES = "p AS (SELECT id % 40 addr, ['view', 'click', 'signup', 'nothing'][id % 4 + 1] slot, id * 37 AS \"at\" FROM range(0, 300) r(id))"


@query("""SELECT p.addr, p.slot, p."at", CASE WHEN v.txnum IS NULL THEN c_acctbal WHEN v.present THEN v.val END val, v.txnum IS NOT NULL written
FROM p LEFT JOIN v ON v.addr = p.addr AND v.slot = p.slot AND v.txnum = (SELECT max(txnum) FROM v w WHERE w.addr = p.addr AND w.slot = p.slot AND w.txnum <= p."at") LEFT JOIN customer ON c_custkey = p.addr""", ctes=B.STATE_SQL.rstrip() + ",\n" + PROBES)
def j6_j8_q23_reads_as_of(spark, d):
    return state.read_many(B.versions(spark, d), _probes(spark), B.genesis(spark, d))


@query("SELECT txnum, val, present FROM v WHERE addr = 3 AND slot = 'view'", **three)
def q25_slot_series(spark, d):
    return state.slot_series(B.versions(spark, d), 3, "view").select("txnum", "val", "present")


@query("SELECT DISTINCT addr FROM v WHERE txnum BETWEEN 100 AND 180", **three)
def q30_modified_accounts(spark, d):
    return state.modified(B.versions(spark, d), 100, 180)


@query("SELECT addr, slot, val FROM (SELECT *, row_number() OVER (PARTITION BY addr, slot ORDER BY CASE WHEN txnum >= 8000 THEN 2 WHEN txnum >= 5000 THEN 1 ELSE 0 END DESC, txnum DESC) rk FROM v) WHERE rk = 1 AND present", **three)
def l1_l2_overlay_view(spark, d):
    levels = B.versions(spark, d).withColumn("level", F.when(F.col("txnum") >= 8000, 2).when(F.col("txnum") >= 5000, 1).otherwise(0))
    return state.overlaid(levels, ["addr", "slot"])


@query("SELECT addr, slot, d txnum FROM (SELECT v.*, lead(txnum) OVER (PARTITION BY addr, slot ORDER BY txnum) nx, (SELECT min(del.txnum) FROM del WHERE del.addr = v.addr AND del.txnum > v.txnum) d FROM v WHERE slot <> 'signup') WHERE present AND d IS NOT NULL AND (nx IS NULL OR d < nx)", **three)
def l6_delete_tombstones(spark, d):
    return state.tombstones(B.versions(spark, d).where("slot <> 'signup'"), B.deletes(spark, d))


@query("SELECT addr, slot, arg_max(val, txnum) val FROM (SELECT v.* FROM v LEFT JOIN (SELECT addr, max(txnum) t FROM del GROUP BY 1) x USING (addr) WHERE v.slot <> 'signup' AND (t IS NULL OR v.txnum >= t)) GROUP BY 1, 2 HAVING arg_max(present, txnum)", **three)
def q24_slots_after_deletes(spark, d):
    return state.slots_after_deletes(B.versions(spark, d).where("slot <> 'signup'"), B.deletes(spark, d)).select("addr", "slot", "val")


@query("""SELECT kind, addr, slot, max(txnum) txnum, arg_max(val, txnum) val, arg_max(present, txnum) present FROM (
  SELECT r.* FROM (SELECT 's' kind, addr, slot, txnum, val, present FROM v WHERE slot <> 'signup' UNION ALL SELECT 'a', addr, '', txnum, NULL, false FROM del) r
  LEFT JOIN (SELECT addr, max(txnum) t FROM del WHERE txnum > 200 AND txnum <= 9000 GROUP BY 1) x USING (addr)
  WHERE txnum > 200 AND txnum <= 9000 AND (kind = 'a' OR t IS NULL OR txnum >= t)) GROUP BY 1, 2, 3""", **three)
def l8_recovery(spark, d):
    slots = B.versions(spark, d).where("slot <> 'signup'").select("kind", "addr", "slot", "txnum", "val", "present")
    gone = B.deletes(spark, d).select(F.lit("a").alias("kind"), "addr", F.lit("").alias("slot"), "txnum", F.lit(None).cast("double").alias("val"), F.lit(False).alias("present"))
    return state.recovered(slots.unionByName(gone), 200, 9000)


# traces


@query('SELECT txnum, ord, depth, "type", "from", "to", "value", error FROM f', **four)
def f15_q29_frames(spark, d):
    return traces.frames(B.traces(spark, d)).select("txnum", "ord", "depth", "type", "from", "to", "value", "error")


@query("""SELECT txnum, ord, "type", "to" FROM f WHERE "type" IN ('CREATE', 'CALL')""", **four)
def p8_q13_internal_operations(spark, d):
    return traces.internal_operations(traces.frames(B.traces(spark, d))).select("txnum", "ord", "type", "to")


@query("""SELECT "to" contract, min(txnum) txnum, arg_min("from", txnum) creator FROM f WHERE "type" = 'CREATE' AND error IS NULL GROUP BY 1""", **four)
def q12_contract_creators(spark, d):
    return traces.creators(traces.frames(B.traces(spark, d)))


@query("SELECT txnum, ord, 'error' field, 'execution reverted' a, NULL b FROM f WHERE error IS NOT NULL", **four)
def j13_q28_trace_differences(spark, d):
    own = traces.frames(B.traces(spark, d))
    return traces.different(own, own.withColumn("error", F.lit(None).cast("string")))


@query("SELECT depth, count(*) n, count(error) failed FROM f GROUP BY 1", **four)
def frame_depths(spark, d):
    return traces.failed(traces.frames(B.traces(spark, d))).groupBy("depth").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))


# set operations and latest values over the ledger


@query("SELECT sender addr, max(txnum) txnum FROM txs GROUP BY 1", **one)
def u4_newest_wins(spark, d):
    return newest(B.txs(spark, d).withColumnRenamed("sender", "addr"), ["addr"], "txnum", ["height"]).select("addr", "txnum")


@query("SELECT height FROM blocks EXCEPT SELECT height FROM txs", **one)
def u5_empty_blocks(spark, d):
    return B.blocks(spark, d).select("height").join(B.txs(spark, d).select("height"), "height", "left_anti")
