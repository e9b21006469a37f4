"""Registered queries of account reads, hashes, differences, codecs and the latest state. Imported for its effect on the catalogue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallystone.functions import container, receipts, rlp
from tallystone.operators import fees, integrity, state, traces
from tallystone.plans import bindings as B
from tallystone.plans import tags
from tallystone.plans.catalog import four, one, query, three
from tallystone.sources.latest import Latest

ASKED = """p AS (SELECT id % 60 addr, ['view', 'click', 'signup', 'nothing'][id % 4 + 1] slot, ['latest', 'earliest', '0x10', '100', '0xffffff'][id % 5 + 1] tag FROM range(0, 300) r(id)),
top AS (SELECT max(event_id) // 40 t FROM events),
q AS (SELECT p.*, CASE tag WHEN 'latest' THEN t WHEN 'earliest' THEN 0 WHEN '0x10' THEN 16 WHEN '100' THEN 100 END height FROM p, top),
probe AS (SELECT *, height * 40 + 39 slot_at FROM q, top WHERE height <= t)"""
bundled = {"ctes": B.STATE_SQL.rstrip() + ",\n" + B.ACCOUNTS_SQL.strip() + ",\n" + ASKED}


def _asked(spark, d):
    """Accounts, slots and tags; a state block holds 40 slots of the clock, the last of them its boundary."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int"))
    p = spark.range(300).select((F.col("id") % 60).alias("addr"), pick(["view", "click", "signup", "nothing"]).alias("slot"), pick(["latest", "earliest", "0x10", "100", "0xffffff"]).alias("tag"))
    top = B.table(spark, d, "events").agg(F.floor(F.max("event_id") / 40).alias("top")).head()["top"]
    blocks = spark.range((top if top is not None else -1) + 1).select(F.col("id").alias("height"), B.hashed("b", F.col("id")).alias("hash"))
    known = tags.heights(blocks, p.select("tag").distinct()).where("height is not null")
    return p.join(F.broadcast(known), "tag").withColumn("at", F.col("height") * 40 + 39)  # a row a tag


ACCOUNT = "LEFT JOIN acc ON acc.addr = probe.addr AND acc.txnum = (SELECT max(txnum) FROM acc x WHERE x.addr = probe.addr AND x.txnum <= slot_at) LEFT JOIN gen ON gen.addr = probe.addr"
FIELDS = "CASE WHEN acc.txnum IS NULL THEN coalesce(gen.balance, 0) WHEN acc.present THEN acc.balance ELSE 0 END balance, CASE WHEN acc.present THEN acc.nonce ELSE 0 END nonce, CASE WHEN acc.txnum IS NULL THEN gen.code WHEN acc.present THEN acc.code END code"


@query(f"SELECT DISTINCT probe.addr, tag, {FIELDS} FROM probe {ACCOUNT}", **bundled)
def q23_accounts_at_tags(spark, d):
    """Balance, nonce and code of accounts at tags; a tag that names no block has no answer."""
    probes = _asked(spark, d).select("addr", "tag", "at").distinct()
    return state.accounts_at(B.accounts(spark, d), B.genesis_accounts(spark, d), B.codes(spark), probes).select("addr", "tag", "balance", "nonce", "code")


@query(f"SELECT probe.addr, probe.slot, tag, {FIELDS}, CASE WHEN v.present THEN v.val END val FROM probe {ACCOUNT} LEFT JOIN v ON v.addr = probe.addr AND v.slot = probe.slot AND v.txnum = (SELECT max(txnum) FROM v w WHERE w.addr = probe.addr AND w.slot = probe.slot AND w.txnum <= slot_at)", **bundled)
def q24_state_bundles(spark, d):
    """Account, code and a slot in one row."""
    own = state.accounts_at(B.accounts(spark, d), B.genesis_accounts(spark, d), B.codes(spark), _asked(spark, d).select("addr", "slot", "tag", "at"))
    none = B.genesis(spark, d).where("false")
    read = state.read_many(B.versions(spark, d), own.select("addr", "slot", "at").distinct(), none).select("addr", "slot", "at", "val")
    return own.join(read, ["addr", "slot", "at"]).select("addr", "slot", "tag", "balance", "nonce", "code", "val")


@query("SELECT DISTINCT addr, code FROM acc WHERE present AND code IS NOT NULL", ctes=B.ACCOUNTS_SQL)
def j7_codes_by_hash(spark, d):
    """Accounts' code out of the code table, by hash."""
    return B.accounts(spark, d).where("present").join(B.codes(spark), "code_hash").select("addr", "code").distinct()


@query("""SELECT digest, event_id IS NOT NULL known, CASE WHEN event_id IS NOT NULL THEN coalesce(ops, '') END operations FROM (SELECT sha256(concat('e', id * 3)) digest, id * 3 n FROM range(0, 400) r(id)) LEFT JOIN events ON event_id = n AND n % 2 = 0
LEFT JOIN (SELECT txnum, string_agg(concat("type", ' ', "to"), ',' ORDER BY ord) ops FROM f WHERE "type" IN ('CREATE', 'CALL') GROUP BY 1) ON txnum = event_id""", **four)
def q13_operations_by_hash(spark, d):
    """Of hashes, half of them unknown: null for an unknown transaction, an empty list for one without operations."""
    asked = spark.range(400).select(B.hashed("e", F.col("id") * 3).alias("digest"))
    own = B.traces(spark, d)
    known = own.where("txnum % 2 = 0").select(B.hashed("e", F.col("txnum")).alias("digest"), "txnum")
    found = traces.operations_by_hash(asked, known, traces.frames(own.where("txnum < 1200")))
    return found.select("digest", "known", F.array_join(F.transform("operations", lambda o: F.concat_ws(" ", o["type"], o["to"])), ",").alias("operations"))


@query("SELECT n height, base_fee FROM (SELECT (SELECT max(height) FROM blocks) - 9 + id n FROM range(0, 11) r(id)) LEFT JOIN blocks ON height = n", **one)
def q20_base_fees(spark, d):
    """Base fees up to the head, and the one after it, for which no rule is known."""
    b = B.blocks(spark, d)
    return fees.base_fees(b, 10, b.agg(F.max("height")).head()[0])


@query("SELECT event_id txnum, path, a, b FROM events JOIN LATERAL (SELECT '$.calls[0].error' path, 'execution reverted' a, NULL b WHERE k % 10 = 0 UNION ALL SELECT '$.to', concat('p:', k), concat('q:', k) WHERE k % 4 = 1) ON true".replace("FROM events", "FROM (SELECT event_id, cast(regexp_extract(props, '([0-9]+)', 1) AS int) k FROM events)"))
def j13_document_differences(spark, d):
    """Every path in which two JSON documents differ: an error that one lacks, and another callee."""
    own = B.traces(spark, d)
    k = F.regexp_extract("trace", '"to":"p:([0-9]+)"', 1).cast("int")
    other = F.regexp_replace("trace", ',"error":"execution reverted"', "")
    changed = own.withColumn("trace", F.when(k % 4 == 1, F.regexp_replace(other, '^(\\{"type":"CALL","from":"u:[0-9]+","to":)"p:', '$1"q:')).otherwise(other))
    return traces.document_differences(own, changed, "txnum", "trace")


@query("SELECT addr, slot, val FROM (SELECT addr, slot, arg_max(val, txnum) val, arg_max(present, txnum) live FROM v WHERE slot <> 'signup' AND addr BETWEEN 3 AND 9 GROUP BY 1, 2) WHERE live", **three)
def l2_l4_l7_latest_state(spark, d):
    """Versions put in three steps with a roll between, tombstones for cleared ones; a bounded range of what is live."""
    store = Latest(spark)
    key = lambda: F.concat(F.unhex(F.lpad(F.hex("addr"), 16, "0")), F.encode("slot", "UTF-8"))
    v = B.versions(spark, d).where("slot <> 'signup'")
    for k in range(3):
        part = v.where(F.floor(F.col("txnum") / 400) % 3 == k).select("addr", "slot").distinct()
        # puts are in the order of the clock: what an earlier step has written later wins
        seen = state.newest(v.where(F.floor(F.col("txnum") / 400) % 3 <= k), ["addr", "slot"], "txnum", ["val", "present"]).join(part, ["addr", "slot"])
        store.put(seen.select(key().alias("key"), F.when(F.col("present"), F.encode(F.col("val").cast("string"), "UTF-8")).alias("val")))
        if k == 1:
            store.roll()
    low, high = (3).to_bytes(8, "big"), (10).to_bytes(8, "big")
    rows = store.rows(low, high)
    return rows.select(F.conv(F.hex(F.substring("key", 1, 8)), 16, 10).cast("long").alias("addr"), F.decode(F.expr("substring(key, 9)"), "UTF-8").alias("slot"), F.decode("val", "UTF-8").cast("double").alias("val"))


def _roots(own):
    def root(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("tx_index")["tx_hash"]
        return pd.DataFrame({"height": rows["height"].head(1), "root": [receipts.root([bytes.fromhex(x) for x in ordered]).hex()]})

    return own.groupBy("height").applyInPandas(root, "height long, root string")


@query("SELECT DISTINCT height FROM txs WHERE height < 300 AND height % 53 = 4", **one)
def v5_wrong_roots(spark, d):
    """Headers hold the roots of their transactions, with a break planted at 4 of 53 heights: recomputing finds those."""
    own = B.txs(spark, d).where("height < 300").select("height", "tx_index", "tx_hash")
    stated = _roots(own).withColumn("root", F.when(F.col("height") % 53 == 4, F.lit("00")).otherwise(F.col("root")))
    again = _roots(own).withColumnRenamed("root", "own")
    return stated.join(again, "height").where("root <> own").select("height")


@query("SELECT height, tx_count, height % 7 <> 2 AS whole FROM blocks WHERE height < 400", **one)
def s13_v6_containers(spark, d):
    """Blocks packed into containers, split again and hashed back to the header; every seventh is damaged on the way."""
    b = B.blocks(spark, d).where("height < 400").select("height", "hash", "tx_count")
    lists = B.txs(spark, d).where("height < 400").groupBy("height").agg(F.transform(F.array_sort(F.collect_list(F.struct("tx_index", "tx_hash"))), lambda x: F.unhex(x["tx_hash"])).alias("txs"))
    none = F.array().cast("array<binary>")
    joined = b.join(lists, "height", "left").withColumn("packed", container.packed(F.unhex("hash"), F.encode(F.lit("wrapper"), "UTF-8"), F.coalesce("txs", none)))
    sent = joined.withColumn("packed", F.when(F.col("height") % 7 == 2, F.expr("substring(packed, 1, length(packed) - 1)")).otherwise(F.col("packed")))
    read = sent.withColumn("parts", container.parts("packed"))
    same = F.coalesce((F.hex("parts.header") == F.upper("hash")) & (F.size("parts.txs") == F.col("tx_count")), F.lit(False))
    return read.select("height", "tx_count", same.alias("whole"))


@query("SELECT height, base_fee, gas_used, gas_limit, parent_hash FROM blocks WHERE height < 400", **one)
def f8_headers_decoded(spark, d):
    """Headers encoded as lists and read back as columns."""
    b = B.blocks(spark, d).where("height < 400")
    raw = rlp.encode_header(F.unhex("parent_hash"), F.col("height"), F.col("gas_limit"), F.col("gas_used"), F.col("base_fee"))
    return b.select(raw.alias("raw")).select(rlp.decode_header("raw").alias("h")).select("h.height", "h.base_fee", "h.gas_used", "h.gas_limit", F.lower(F.hex("h.parent_hash")).alias("parent_hash"))


@query("SELECT txnum, status, gas_used, emitter, topics FROM (SELECT txnum, status, gas_used, concat('p', emitter) emitter, cast(txnum % 3 AS int) topics FROM txs WHERE height < 200)", **one)
def f7_receipts_decoded(spark, d):
    """Receipts packed with a log of 0 to 2 topics and read back as columns."""
    own = B.txs(spark, d).where("height < 200")
    word = F.unhex(F.lpad(F.hex("emitter"), 64, "0"))
    raw = receipts.encode_receipt(F.col("status"), F.col("gas_used"), F.lit(0).cast("long"), F.unhex(F.lpad(F.hex("emitter"), 40, "0")), F.slice(F.array(word, word), F.lit(1), (F.col("txnum") % 3).cast("int")))
    read = own.select("txnum", raw.alias("raw")).select("txnum", receipts.decode_receipt("raw").alias("r"))
    log = F.get("r.logs", F.lit(0))
    return read.select("txnum", "r.status", "r.gas_used", F.concat(F.lit("p"), F.conv(F.hex(log["address"]), 16, 10)).alias("emitter"), F.size(log["topics"]).alias("topics"))


@query("SELECT count(*) walked, count(*) FILTER (WHERE b.hash IS DISTINCT FROM sha256(concat('b', b.height))) damaged FROM blocks b", **one)
def v6_rehashed(spark, d):
    """Every block's id computed again from its content."""
    b = B.blocks(spark, d)
    bad = b.where(F.col("hash") != B.hashed("b", F.col("height")))
    integrity.verified(bad, b.count())
    return b.agg(F.count("*").alias("walked"), F.count_if(F.col("hash") != B.hashed("b", F.col("height"))).alias("damaged"))
