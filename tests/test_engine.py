import pytest
from pyspark.sql import functions as F
from tallystone.engine import Engine
from tallystone.plans.tags import Refused, UnknownBlock


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.bound(spark, "/root/testdata/sf0.001")


def test_surfaces_agree(engine):
    b = engine.block(7).head()
    assert engine.block_by_hash(b.hash).head() == b == engine.ask("eth_getBlockByNumber", "0x7").head()
    assert engine.ask("eth_getBlockTransactionCountByHash", b.hash).head().tx_count == len(b.hashes) == engine.receipts(7).count()
    one = engine.transaction(b.hashes[0]).head()
    assert engine.ask("eth_getTransactionByBlockNumberAndIndex", 7, 0).head() == one
    assert engine.receipt(one.tx_hash).head() == engine.receipts(7).where(F.col("tx_index") == 0).head()
    assert engine.by_nonce(one.sender, one.nonce).head().txnum == one.txnum
    assert engine.head().head().height == engine.height() == 1499


def test_unknown_and_refused(engine):
    assert engine.transaction("0" * 64).count() == engine.block_by_hash("0" * 64).count() == engine.receipt("0" * 64).count() == 0
    for ask in (lambda: engine.get_logs(block_hash="0" * 64), lambda: engine.block(99_999), lambda: engine.ask("eth_getHeaderByHash", "0" * 64)):
        with pytest.raises(UnknownBlock):
            ask()
    for method in ("eth_call", "eth_sendRawTransaction", "eth_getProof", "made_up"):
        with pytest.raises(NotImplementedError, match=method):
            engine.ask(method)
    assert engine.ask("eth_accounts") == [] and engine.ask("eth_syncing") is False


def test_pages_cover_an_address_once(engine):
    seen, cursor = [], None
    while True:
        page = engine.search("s:7", cursor, 100)
        seen += [r.txnum for r in page.rows]
        if not page.more:
            break
        cursor = page.next_cursor
    want = [r.txnum for r in engine.addresses.where("addr = 's:7'").orderBy(F.desc("txnum")).collect()]
    assert seen == want and page.next_cursor is None


def test_tokens_logs_and_fees(engine):
    listed = engine.token_contracts("h:3").collect()
    order = {"erc20": 0, "erc721": 1, "erc1155": 2}
    assert listed and [(order[r.standard], r.token) for r in listed] == sorted((order[r.standard], r.token) for r in listed)
    assert engine.ask("tally_getTokenTransfersByHolder", "h:3", limit=5).count() <= 5
    assert engine.logs_by_emitter(3, limit=4).select("txnum").distinct().count() == 4
    assert engine.get_logs(1, 50, topics=["click"]).count() == engine.logs.where("height between 1 and 50 and get(topics, 0) = 'click'").count()
    assert engine.fee_history(10, 100, [50.0]).count() == 10 and engine.price().count() == engine.tip().count() == 1
    with pytest.raises(ValueError):
        engine.topic_groups("h:3", None)


def test_accounts_and_bundles(engine):
    live = engine.accounts.where("present").orderBy(F.desc("txnum")).head()
    seen = engine.blocks.agg(F.max("height")).head()[0]
    assert engine.ask("eth_getBalance", live.addr).head().balance == engine.account(live.addr, seen).head().balance
    row = engine.bundle(live.addr, ["view", "nothing"], "latest").collect()
    assert len(row) == 1 and set(row[0].slots) == {"view", "nothing"} and row[0].slots["nothing"] is None
    assert row[0].balance == engine.account(live.addr).head().balance
    assert engine.ask("eth_getTransactionCount", 10**9).head().nonce == 0 and engine.ask("eth_getCode", 10**9).head().code is None


def test_rules_by_hash(engine):
    h = engine.txs.where("txnum < 900").orderBy("txnum").limit(400).collect()
    traced = {r.txnum for r in engine.traces.collect()}
    assert engine.ask("ots_getInternalOperations", "0x" + "0" * 64) is None and engine.ask("debug_traceTransaction", "0" * 64) is None
    known = next(r for r in h if r.txnum in traced)
    assert isinstance(engine.ask("ots_getInternalOperations", known.tx_hash), list)
    assert engine.ask("debug_traceTransaction", "0x" + known.tx_hash).startswith('{"type":"CALL"')
    with pytest.raises(Refused):
        engine.ask("debug_traceTransaction", known.tx_hash, "prestateTracer")


def test_whole_blocks_and_batches(engine):
    import json

    one = json.loads(engine.block_json(7, True).head().json)
    assert [t["hash"] for t in one["transactions"]] == json.loads(engine.block_json("0x7", False).head().json)["transactions"]
    assert {t["type"] for t in one["transactions"]} <= {"0x0", "0x1", "0x2"} and all(("accessList" in t) == (t["type"] != "0x0") for t in one["transactions"])
    with pytest.raises(ValueError):
        engine.block_json(7, "yes")
    text = engine.ask("debug_printBlock", 7).split("\n")
    assert len(text) == 1 + len(one["transactions"]) and json.loads(text[0])["number"] == "0x7" and all(json.loads(x) for x in text)
    got = engine.batch([{"id": 1, "method": "eth_chainId"}, {"method": "eth_accounts"}, {"id": 2, "method": "made_up"}, {"id": 3, "method": "personal_sign"}, {"id": 4, "method": "eth_getBlockByNumber", "params": ["0xffffff"]}])
    assert [x["id"] for x in got] == [1, 2, 3, 4] and got[0]["result"] == 1337
    assert [x["error"]["kind"] for x in got[1:]] == ["UnknownMethod", "Refused", "UnknownBlock"]
    for calls in ([], [{"method": "eth_accounts"}] * 1001):
        with pytest.raises(ValueError):
            engine.batch(calls)
    a, b = engine.ask("debug_getModifiedAccountsByNumber", 3).count(), engine.ask("debug_getModifiedAccountsByNumber", 2, 9).count()
    assert 0 <= a and b >= 0
