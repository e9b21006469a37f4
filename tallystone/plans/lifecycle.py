"""Registered queries of runs, streams, encodings and roots. Imported for its effect on the catalogue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallystone.functions import encoding, receipts, wire
from tallystone.operators import ledger
from tallystone.operators import logs as L
from tallystone.operators.scaling import running_sum
from tallystone.plans import bindings as B
from tallystone.plans import tags
from tallystone.plans.catalog import many, one, query
from tallystone.sources import runs
from tallystone.sources.shared import shared_uri, written
from tallystone.streaming import follow

SLOTS, BLOCKS, TERMINAL = 5_000, 500, 40_000  # the thresholds scaled to the tables

CUTS = """b AS MATERIALIZED (SELECT * FROM blocks),
e AS MATERIALIZED (SELECT s.height h, s.first_tx f, min(b.height) last FROM b s JOIN b ON b.height BETWEEN s.height AND s.height + 499 AND (b.boundary_tx + 1 - s.first_tx >= 5000 OR b.height - s.height + 1 >= 500) GROUP BY 1, 2),
r AS (SELECT h, f, last FROM e WHERE h = 0 UNION ALL SELECT e.h, e.f, e.last FROM r JOIN e ON e.h = r.last + 1)"""


@query("SELECT f from_tx, boundary_tx + 1 to_tx, h from_height, last to_height FROM r JOIN b ON b.height = last", ctes="RECURSIVE" + B.LEDGER_SQL.rstrip() + ",\n" + CUTS)
def c1_run_cuts(spark, d):
    return runs.run_cuts(B.blocks(spark, d), SLOTS, BLOCKS)


def _spans(blocks):
    """Spans of the full runs, and of what is left at the end; a number of rows that the thresholds bound."""
    cuts = sorted(tuple(r) for r in runs.run_cuts(blocks, 4 * SLOTS, 4 * BLOCKS).select("from_tx", "to_tx", "from_height", "to_height").collect())
    end = blocks.agg(F.max(F.struct("height", "boundary_tx")).alias("e")).head()["e"]
    start = cuts[-1] if cuts else (0, 0, 0, -1)
    rest = [(start[1], end[1] + 1, start[3] + 1, end[0])] if end and start[3] < end[0] else []
    return cuts, rest


def _corpus(spark, d):
    """Transactions flushed as runs of a corpus, then merged as far as is due, at the first use in a session."""
    key = (spark.sparkContext.applicationId, d, f"runs-{SLOTS}-{BLOCKS}-{TERMINAL}")
    if key not in B._STORED:
        cuts, rest = _spans(B.blocks(spark, d))
        corpus = runs.Corpus(spark, shared_uri(spark, "corpus"), "root")
        corpus.flush_all(B.txs(spark, d).select("txnum", "height", "tx_hash"), cuts + rest)
        corpus.merge_all(TERMINAL)
        B._STORED[key] = corpus
    return B._STORED[key]


@query("SELECT txnum, height, tx_hash FROM txs", **one)
def s16_c3_runs_read_back(spark, d):
    return _corpus(spark, d).read()


@query("SELECT txnum, height FROM txs WHERE txnum BETWEEN 900 AND 1500", **one)
def p10_runs_pruned_by_slots(spark, d):
    return _corpus(spark, d).at_slots(900, 1500).select("txnum", "height")


@query("SELECT 'blocks' family, 1 level, 1 runs, count(*) rows FROM blocks UNION ALL SELECT 'txs', 1, 1, count(*) FROM txs UNION ALL SELECT 'hashes', 1, 1, (SELECT count(*) FROM blocks) + (SELECT count(*) FROM txs) UNION ALL SELECT 'postings', 1, 1, count(*) FROM post", **one)
def a22_section_sizes(spark, d):
    """Runs and rows by family out of the ledger's manifest (bytes are there, too, but depend on the writer)."""
    return B.ledger_corpus(spark, d).sizes().select("family", "level", F.col("runs").cast("int").alias("runs"), "rows")


@query("SELECT txnum, row_number() OVER (ORDER BY txnum) - 1 place FROM txs WHERE txnum < 700", **one)
def s9_ordered_scan(spark, d):
    """The scan gives rows by run and slot; its first 700 slots with their places."""
    first = [r.txnum for r in _corpus(spark, d).scan().where("txnum < 700").collect()]
    return spark.createDataFrame(list(enumerate(first)), "place long, txnum long").select("txnum", "place")


@query("SELECT count(*) rows, cast(sum(txnum) AS bigint) slots, min(txnum) first, max(txnum) last, min(tx_hash) hash FROM txs JOIN (SELECT max(to_tx) upto FROM t) ON txnum < upto", ctes="RECURSIVE" + B.LEDGER_SQL.rstrip() + ",\n" + CUTS.replace("499", "1999").replace("5000", "20000").replace("500", "2000") + """,
c AS (SELECT to_tx, row_number() OVER (ORDER BY to_tx) k FROM (SELECT boundary_tx + 1 to_tx FROM r JOIN b ON b.height = last UNION SELECT max(boundary_tx) + 1 FROM blocks)),
t AS (SELECT 0 to_tx, 0 upto, 0 kk UNION ALL SELECT c.to_tx, c.to_tx, c.k FROM t JOIN c ON c.k = (SELECT min(x.k) FROM c x WHERE x.k > t.kk AND x.to_tx - t.upto >= 40000))""")
def s17_s18_published_and_joined(spark, d):
    """Terminal runs published with a pointer, joined by their footers, and read from there."""
    corpus = _corpus(spark, d)
    folder = shared_uri(spark, "published")
    corpus.publish(folder)
    other = runs.Corpus(spark, folder, "root")
    joined = other.join()
    if not joined:
        return B.txs(spark, d).where("false").agg(F.count("*").alias("rows"), F.sum("txnum").alias("slots"), F.min("txnum").alias("first"), F.max("txnum").alias("last"), F.min("tx_hash").alias("hash"))
    return other.read(joined).agg(F.count("*").alias("rows"), F.sum("txnum").alias("slots"), F.min("txnum").alias("first"), F.max("txnum").alias("last"), F.min("tx_hash").alias("hash"))


def _stream(spark, d):
    """The log binding as a stream: events land in files by time, one micro-batch each."""
    landing = shared_uri(spark, "landing")
    B.table(spark, d, "events").repartitionByRange(4, "event_id").write.parquet(landing)
    source = spark.readStream.schema(B.table(spark, d, "events").schema).option("maxFilesPerTrigger", 1)
    events = source.parquet(landing)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select(F.col("event_id").alias("txnum"), F.col("user_id").alias("emitter"), F.col("event_type").alias("topic0"), k.alias("k"))


def _drained(spark, stream, name):
    """What a stream gives until it has caught up."""
    out, mark = shared_uri(spark, name), shared_uri(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT txnum, emitter FROM logs WHERE t0 = 'click' AND emitter IN (2, 4, 6)", **many)
def t2_log_subscription(spark, d):
    return _drained(spark, follow.subscribed(_stream(spark, d), (F.col("topic0") == "click") & F.col("emitter").isin(2, 4, 6) & (F.col("k") > 0)), "logs").select("txnum", "emitter")


@query("SELECT height, tx_hash FROM txs", **one)
def t3_accepted_transactions(spark, d):
    """Transactions of the blocks that have any, out of a stream of landed blocks."""
    landing = shared_uri(spark, "landed")
    rows = ledger.assembled(B.blocks(spark, d), B.txs(spark, d)).select("height", "hash", "parent_hash", F.col("hashes").alias("tx_hashes"))
    rows.repartitionByRange(4, "height").write.parquet(landing)
    return _drained(spark, follow.accepted(follow.landed(spark, landing, rows.schema)), "accepted")


@query("SELECT event_id txnum FROM events WHERE false")
def t4_pending_transactions(spark, d):
    return _drained(spark, follow.pending(_stream(spark, d)).select("txnum"), "pending")


@query("SELECT height, concat('0x', lower(to_hex(height))) quantity, concat('0x', lower(to_hex(gas_used))) gas FROM blocks", **one)
def f1_quantities(spark, d):
    return B.blocks(spark, d).select("height", encoding.quantity(F.col("height")).alias("quantity"), encoding.quantity(F.col("gas_used")).alias("gas"))


@query("SELECT height, cast(sum(price * gas_used) AS bigint) total, false overflow FROM txs GROUP BY 1", **one)
def uint256_sums(spark, d):
    joined = B.txs(spark, d).join(B.blocks(spark, d).select("height", "base_fee"), "height")
    words = joined.select("height", F.unhex(F.lpad(F.hex(ledger.effective_price() * F.col("gas_used")), 64, "0")).alias("w"))
    sums = encoding.sum_words(words, ["height"], "w", "total")
    return sums.select("height", encoding.as_decimal(F.col("total")).cast("long").alias("total"), "overflow")


wired = {"ctes": B.LEDGER_SQL.rstrip() + ",\n" + B.WIRE_SQL.strip()}


@query("SELECT txnum, json FROM wire", **wired)
def f12_transaction_json(spark, d):
    return B.typed_txs(spark, d).select("txnum", F.to_json(wire.transaction()).alias("json"))


HEAD_SQL = """concat('{"number":"0x', lower(to_hex(b.height)), '","hash":"0x', b.hash, '","parentHash":"0x', b.parent_hash, '","gasUsed":"0x', lower(to_hex(b.gas_used)), '","gasLimit":"0x', lower(to_hex(b.gas_limit)), '"', CASE WHEN b.height >= 50 THEN concat(',"baseFeePerGas":"0x', lower(to_hex(b.base_fee)), '"') ELSE '' END, CASE WHEN b.height < 1000 THEN concat(',"totalDifficulty":"0x', lower(to_hex(b.height + 1)), '"') ELSE '' END, CASE WHEN b.height >= 1200 THEN ',"blobGasUsed":"0x0"' ELSE '' END"""


def _later_fields():
    """Fields that blocks have from a height on, or up to one."""
    h = F.col("height")
    return {"baseFeePerGas": F.when(h >= 50, encoding.quantity(F.col("base_fee"))), "totalDifficulty": F.when(h < 1000, encoding.quantity(h + 1)), "blobGasUsed": F.when(h >= 1200, F.lit("0x0"))}


@query(f"SELECT b.height, {HEAD_SQL}, '}}') json FROM blocks b", **wired)
def f13_block_json(spark, d):
    return B.blocks(spark, d).select("height", F.to_json(wire.header(_later_fields())).alias("json"))


@query(f"""SELECT b.height, {HEAD_SQL}, ',"transactions":[', coalesce(string_agg(CASE WHEN b.height % 2 = 0 THEN w.json ELSE concat('"0x', w.tx_hash, '"') END, ',' ORDER BY w.tx_index), ''), ']}}') json FROM blocks b LEFT JOIN wire w ON w.height = b.height WHERE b.height BETWEEN 40 AND 90 GROUP BY b.height, b.hash, b.parent_hash, b.gas_used, b.gas_limit, b.base_fee""", **wired)
def p12_blocks_with_transactions(spark, d):
    """Even blocks with whole transactions, odd ones with hashes."""
    part = lambda df: ledger.rows_between(df, "height", 40, 90)
    return wire.block(part(B.blocks(spark, d)), part(B.typed_txs(spark, d)), F.col("height") % 2 == 0, _later_fields())


@query("""SELECT txnum, concat('{"transactionHash":"0x', tx_hash, '","transactionIndex":"', ti, '","blockHash":"0x', block_hash, '","blockNumber":"', bn, '","from":"c:', sender, '",', dest, CASE WHEN txnum % 50 = 0 THEN concat('"contractAddress":"n:', txnum, '",') ELSE '' END,
'"type":"0x', kind, '",', CASE WHEN height < 100 THEN concat('"root":"0x', sha256(concat('r', txnum)), '"') ELSE concat('"status":"0x', status, '"') END, ',"gasUsed":"0x', lower(to_hex(gas_used)), '","cumulativeGasUsed":"0x', lower(to_hex(cumulative)), '","effectiveGasPrice":"0x', lower(to_hex(paid)), '","logs":[',
CASE WHEN tx_index % 2 = 0 THEN concat('{"address":"p:', emitter, '","topics":["t:', txnum % 3, '"],"logIndex":"0x0"}') ELSE '' END, ']}') json FROM w""", **wired)
def f14_receipt_json(spark, d):
    return B.typed_txs(spark, d).select("txnum", F.to_json(wire.receipt()).alias("json"))


@query("SELECT * FROM (VALUES ('latest'), ('pending'), ('safe'), ('finalized'), (''), ('earliest'), ('0x10'), ('77'), ('0xffffffff'), ('99999999'), (concat('0x', sha256('b321'))), (sha256('b12')), (sha256('nothing'))) t(tag) JOIN LATERAL (SELECT CASE WHEN tag IN ('latest', 'pending', 'safe', 'finalized', '') THEN (SELECT max(o_orderkey) FROM orders) WHEN tag = 'earliest' THEN 0 WHEN tag = '0x10' THEN 16 WHEN tag = '77' THEN 77 WHEN length(tag) = 66 THEN 321 WHEN tag = sha256('b12') THEN 12 END height) ON true")
def p9_tags(spark, d):
    names = [("latest",), ("pending",), ("safe",), ("finalized",), ("",), ("earliest",), ("0x10",), ("77",), ("0xffffffff",), ("99999999",)]
    asked = spark.createDataFrame(names, "tag string").union(spark.range(1).select(F.explode(F.array(F.concat(F.lit("0x"), F.sha2(F.lit("b321"), 256)), F.sha2(F.lit("b12"), 256), F.sha2(F.lit("nothing"), 256)))))
    return tags.heights(B.blocks(spark, d).select("height", "hash"), asked)


@query("""SELECT * FROM (VALUES ('eth_call', 'no virtual machine'), ('eth_callDetailed', 'no virtual machine'), ('eth_estimateGas', 'no virtual machine'), ('eth_createAccessList', 'no virtual machine'), ('debug_traceCall', 'no virtual machine'), ('eth_getProof', 'no proofs are stored'),
('debug_dumpBlock', 'no state dump'), ('debug_accountRange', 'no state dump'), ('debug_storageRangeAt', 'no state dump'), ('debug_intermediateRoots', 'no state dump'), ('debug_preimage', 'no preimages'), ('debug_traceBadBlock', 'no bad blocks'), ('debug_traceChain', 'no chain trace'),
('eth_sendRawTransaction', 'read-only'), ('eth_sendTransaction', 'read-only'), ('eth_fillTransaction', 'read-only'), ('eth_resend', 'read-only'), ('eth_sign', 'no keys'), ('eth_signTransaction', 'no keys'),
('personal_*', 'no keys'), ('miner_*', 'nothing is mined'), ('admin_*', 'no node to administer'), ('les_*', 'no light clients'), ('clique_*', 'other consensus'), ('ethash_*', 'other consensus')) t(method, reason)""")
def q22_refusals(spark, d):
    return tags.refusals(spark)


@query()
def a14_block_blooms(spark, d):
    """A bloom of every block's emitters and topics, three bits each, OR-ed, 2048 in all: each distinct item is hashed once."""
    own = B.typed_txs(spark, d)
    items = own.select("height", F.explode(F.flatten(F.transform("logs", lambda x: F.concat(F.array(x["address"]), x["topics"])))).alias("item")).distinct()
    return receipts.blooms(items, "height", "item").select("height", F.hex("bloom").alias("bloom"))


@query()
def a15_transaction_roots(spark, d):
    """The Patricia root of every block's transactions, in order; a block's rows fit a task, whose blocks are hashed together."""
    own = B.txs(spark, d).groupBy("height").agg(F.array_sort(F.collect_list(F.struct("tx_index", F.unhex("tx_hash").alias("tx")))).alias("own"))
    listed = own.select("height", F.transform("own", lambda x: x["tx"]).alias("values"))

    def rooted(batches):
        for batch in batches:
            found = receipts.roots([[bytes(x) for x in own] for own in batch["values"]])
            yield pd.DataFrame({"height": batch["height"], "root": [r.hex() for r in found]})

    return listed.mapInPandas(rooted, "height long, root string")


@query("SELECT DISTINCT t0 topic0, n topics FROM logs", **many)
def topic_counts(spark, d):
    return B.logs(spark, d, multi=True).select(F.get("topics", F.lit(0)).alias("topic0"), F.size("topics").alias("topics")).distinct()


@query("SELECT b.height, b.first_tx, CASE WHEN e.tx_count = 0 THEN e.first_tx - 1 ELSE e.boundary_tx - 1 END last_tx FROM blocks b JOIN blocks e ON e.height = b.height + 9", **one)
def q3_block_ranges(spark, d):
    """The slots of transactions of the ten blocks from each on; an empty last block ends one below."""
    b = B.blocks(spark, d)
    ends = b.select((F.col("height") - 9).alias("height"), F.when(F.col("tx_count") == 0, F.col("first_tx") - 1).otherwise(F.col("boundary_tx") - 1).alias("last_tx"))
    return b.join(ends, "height").select("height", "first_tx", "last_tx")


@query("SELECT emitter, upper(printf('%064x', emitter)) topic, emitter address FROM (SELECT DISTINCT emitter FROM logs)", **many)
def p7_f5_address_topics(spark, d):
    own = B.logs(spark, d).select("emitter").distinct()
    topic = encoding.address_topic(F.unhex(F.lpad(F.hex("emitter"), 40, "0")))
    return own.select("emitter", F.hex(topic).alias("topic"), F.conv(F.hex(encoding.topic_address(topic)), 16, 10).cast("long").alias("address"))


@query("SELECT height, sha256(concat('block ', height)) id, upper(printf('%016x', height)) key, CASE WHEN height = 0 THEN '' ELSE upper(CASE WHEN length(to_hex(height)) % 2 = 1 THEN concat('0', to_hex(height)) ELSE to_hex(height) END) END trimmed FROM blocks", **one)
def f3_f4_f6_ids_and_keys(spark, d):
    h = F.col("height")
    return B.blocks(spark, d).select("height", F.sha2(F.concat(F.lit("block "), h.cast("string")), 256).alias("id"), F.hex(encoding.number_key(h)).alias("key"), F.hex(encoding.trimmed(encoding.number_key(h))).alias("trimmed"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS secs, epoch_us(ts) // 1000 % 1000 AS millis FROM events")
def f19_block_time(spark, d):
    """Header seconds, refined by milliseconds."""
    ts = F.to_utc_timestamp("ts", "UTC").cast("timestamp_ntz")
    whole = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return B.table(spark, d, "events").select("event_id", F.floor(whole / 1000).alias("secs"), (whole % 1000).alias("millis"))


@query("SELECT c_custkey addr, c_acctbal balance, coalesce(n, 0) nonce, n_name code FROM customer LEFT JOIN (SELECT sender, count(*) n FROM txs WHERE txnum <= 3000 GROUP BY 1) ON sender = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey", **one)
def j7_q24_state_bundle(spark, d):
    """Balance, nonce at a slot and code of every account, the code joined by its hash (here a nation's key)."""
    nonces = B.txs(spark, d).where("txnum <= 3000").groupBy(F.col("sender").alias("addr")).agg(F.count("*").alias("nonce"))
    codes = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("code_hash"), F.col("n_name").alias("code"))
    own = B.table(spark, d, "customer").select(F.col("c_custkey").alias("addr"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("code_hash"))
    return own.join(nonces, "addr", "left").join(codes, "code_hash", "left").select("addr", "balance", F.coalesce("nonce", F.lit(0)).alias("nonce"), "code")


TOKENS = "u AS (SELECT DISTINCT h holder, emitter token, CASE WHEN t0 = 'error' THEN 'erc1155' WHEN n = 3 THEN 'erc20' ELSE 'erc721' END standard FROM (SELECT t1 h, * FROM logs WHERE t0 IN ('click', 'purchase') AND n IN (3, 4) UNION ALL SELECT t2 h, * FROM logs WHERE (t0 IN ('click', 'purchase') AND n IN (3, 4)) OR (t0 = 'error' AND n = 4) UNION ALL SELECT t3 h, * FROM logs WHERE t0 = 'error' AND n = 4))"


@query("SELECT holder, token, standard, row_number() OVER (PARTITION BY holder ORDER BY CASE standard WHEN 'erc20' THEN 0 WHEN 'erc721' THEN 1 ELSE 2 END, token) - 1 place FROM u", ctes=B.MULTI_SQL.rstrip() + ",\n" + TOKENS)
def k7_sorted_tokens(spark, d):
    """Every holder's tokens in order of standard, then token; places are counted in buckets of tokens, so that no holder is ranked in one task."""
    spots = B.log_corpus(spark, d, multi=True).read(family="tval")
    named = spots.withColumn("standard", L.standard_of_spot(B.TRANSFER, B.MULTI))
    bits = F.col("pos").bitwiseAND(F.when(F.col("standard") == "erc1155", 0b110).otherwise(0b011)) != 0
    own = named.where(bits & F.col("standard").isNotNull()).select(F.col("value").alias("holder"), F.col("emitter").alias("token"), "standard").distinct()
    rank = F.when(F.col("standard") == "erc20", 0).when(F.col("standard") == "erc721", 1).otherwise(2)
    ordered = own.withColumn("_order", rank.cast("long") * (1 << 40) + F.col("token"))
    return running_sum(ordered, "_order", F.lit(1), "place", keys=["holder"]).select("holder", "token", "standard", F.col("place").cast("long").alias("place"))


@query("SELECT user_id category, count(*) queries, count(*) FILTER (WHERE event_type = 'error') mismatches, count(*) FILTER (WHERE event_type = 'signup') skipped FROM events GROUP BY 1")
def a25_tally(spark, d):
    return B.table(spark, d, "events").groupBy(F.col("user_id").alias("category")).agg(F.count("*").alias("queries"), F.count_if(F.col("event_type") == "error").alias("mismatches"), F.count_if(F.col("event_type") == "signup").alias("skipped"))


@query("SELECT height, hash, parent_hash FROM blocks", **one)
def t1_new_heads(spark, d):
    """Every block's head out of a stream of landed blocks."""
    landing = shared_uri(spark, "blocks")
    rows = B.blocks(spark, d).select("height", "hash", "parent_hash")
    rows.repartitionByRange(4, "height").write.parquet(landing)
    return _drained(spark, follow.new_heads(follow.landed(spark, landing, rows.schema)), "heads")


@query("SELECT txnum, height FROM txs", **one)
def s10_window_and_runs(spark, d):
    """Rows of the runs and of the window that isn't flushed yet, as every read sees them."""
    rows = B.txs(spark, d).select("txnum", "height")
    corpus = runs.Corpus(spark, shared_uri(spark, "corpus"), "root")
    cuts, _ = _spans(B.blocks(spark, d))
    if not cuts:
        return rows
    corpus.flush(rows, cuts[0])
    return corpus.read().unionByName(rows.where(F.col("txnum") >= cuts[0][1]))


@query("SELECT count(*) rows, cast(sum(txnum) AS bigint) slots, cast(sum(height) AS bigint) heights, count(DISTINCT tx_hash) hashes, 0 from_tx, (SELECT max(boundary_tx) + 1 FROM blocks) to_tx, (SELECT max(height) FROM blocks) to_height FROM txs", **one)
def v8_v9_v10_runs_verified(spark, d):
    """What the manifest of the merged corpus says and what its runs hold, after tiling and contents have been checked."""
    corpus = _corpus(spark, d)
    kept = corpus.runs()
    runs.check_tiling(kept)
    corpus.present(kept)
    rows = corpus.read()
    name, n = runs.content_name(rows.select("txnum", "height", "tx_hash"))
    want, total = runs.content_name(B.txs(spark, d).select("txnum", "height", "tx_hash"))
    if name != want or n != total or n != sum(r.rows for r in kept):
        raise ValueError("the merged runs aren't what went in")
    read = rows.agg(F.count("*").alias("rows"), F.sum("txnum").alias("slots"), F.sum("height").alias("heights"), F.count_distinct("tx_hash").alias("hashes"))
    return read.select("*", F.lit(kept[0].from_tx).alias("from_tx"), F.lit(kept[-1].to_tx).alias("to_tx"), F.lit(kept[-1].to_height).alias("to_height"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) n, cast(sum(tx_count) AS bigint) txs FROM blocks JOIN orders ON o_orderkey = height GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", **one)
def extension_rollup(spark, d):
    """An extension: the canonical tables answer what relational queries ask."""
    joined = B.blocks(spark, d).join(B.table(spark, d, "orders"), F.col("o_orderkey") == F.col("height"))
    return joined.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("tx_count").alias("txs"))
