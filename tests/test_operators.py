"""Edge cases of the ledger operators on small tables, and seeded models of the order-dependent ones."""

import random

import pytest
from pyspark.sql import functions as F
from tallystone.functions import container
from tallystone.operators import fees, integrity, ledger, logs, postings, scaling, state, traces
from tallystone.plans import tags


def blocks_of(spark, counts):
    rows = [(h, n, 10 * n, 50 * n, 5, f"h{h}", f"h{h - 1}") for h, n in enumerate(counts)]
    return ledger.assign_slots(spark.createDataFrame(rows, "height long, tx_count long, gas_used long, gas_limit long, base_fee long, hash string, parent_hash string"))


def test_empty_blocks_have_slots_of_their_own(spark):
    got = blocks_of(spark, [2, 0, 0, 2, 0]).orderBy("height").collect()
    assert [(r.first_tx, r.boundary_tx) for r in got] == [(0, 2), (3, 3), (4, 4), (5, 7), (8, 8)]
    points = spark.range(9).withColumnRenamed("id", "txnum")
    found = {r.txnum: r.height for r in ledger.height_of(points, blocks_of(spark, [2, 0, 0, 2, 0])).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 3, 7: 3, 8: 4}
    head = ledger.head(blocks_of(spark, [2, 0, 0, 2, 0])).head()
    assert (head.height, head.txs) == (4, 4)


def test_running_sum_and_as_of_against_loops(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), t, rng.randrange(9)) for t in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(5)
    for r in scaling.running_sum(df, "t", F.col("v"), "s", width=64, keys=["k"]).collect():
        assert r.s == sum(v for k, t, v in rows if k == r.k and t < r.t)
    probes = [(rng.choice("abc"), rng.randrange(5200)) for _ in range(300)] + [("a", rows[0][1])]
    got = scaling.as_of(df, spark.createDataFrame(probes, "k string, q long"), ["k"], "t", "q", ["v"], width=100).collect()
    assert len(got) == len(probes)
    for r in got:
        own = [(t, v) for k, t, v in rows if k == r.k and t <= r.q]
        assert r.v == (max(own)[1] if own else None)


def test_pages(spark):
    df = spark.createDataFrame([(t,) for t in range(10, 20)], "txnum long")
    page = postings.keyset_page(df, None, 4, True)
    assert ([r.txnum for r in page.rows], page.more, page.next_cursor) == ([19, 18, 17, 16], True, 15)
    page = postings.keyset_page(df, 13, 4, True)
    assert (len(page.rows), page.more, page.next_cursor) == (4, False, None)
    assert postings.keyset_page(df, 14, 4, True).more and not postings.keyset_page(df, 12, 4, True).more
    assert postings.keyset_page(df, 99, 2, False).rows == [] and postings.keyset_page(df, None, 0, False).rows == [] and postings.keyset_page(df, None, -3, False).rows == []
    zero = spark.createDataFrame([(0,), (1,)], "txnum long")
    first = postings.keyset_page(zero, None, 1, True)
    assert (first.more, first.next_cursor) == (True, 0)
    assert [r.txnum for r in postings.keyset_page(zero, first.next_cursor, 1, True).rows] == [0]


def test_log_pages_keep_transactions_whole(spark):
    df = spark.createDataFrame([(t, i) for t in range(1, 6) for i in range(3)], "txnum long, log_index int")
    got = postings.log_page_rows(df, None, 2, False).collect()
    assert sorted({r.txnum for r in got}) == [1, 2] and len(got) == 6 and got[0].more and got[0].next_cursor == 3
    last = postings.log_page_rows(df, 4, 2, False).collect()
    assert not last[0].more and last[0].next_cursor is None
    assert len(postings.log_page_rows(df, None, 0, True).collect()) == 15


def test_postings_or_their_bits(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 8), ("b", 1, 8)], "addr string, txnum long, roles int")
    assert sorted(map(tuple, postings.merged(df, ["addr"], "roles").collect())) == [("a", 1, 3), ("a", 2, 8), ("b", 1, 8)]
    many = spark.range(10_000).select(F.lit("x").alias("addr"), F.col("id").alias("txnum"))
    chunks = postings.chunked(many, ["addr"]).orderBy("first").collect()
    assert [(c.first, c.n) for c in chunks] == [(0, 4096), (4096, 4096), (8192, 1808)]


LOGS = "txnum long, height long, emitter int, topics array<string>"


def test_log_criteria(spark):
    rows = [(1, 1, 7, []), (2, 1, 7, ["A"]), (3, 2, 8, ["A", "x"]), (4, 2, 7, ["B", "x", "y", "z"]), (5, 3, 9, ["A", "y", "x"])]
    df = spark.createDataFrame(rows, LOGS)
    ask = lambda **k: sorted(r.txnum for r in logs.get_logs(df, logs.criteria(0, 3, 3, **k)).collect())
    assert ask() == [1, 2, 3, 4, 5]
    assert ask(emitters=7) == [1, 2, 4] and ask(emitters=[8, 9]) == [3, 5]
    assert ask(topics=["A"]) == [2, 3, 5] and ask(topics=[None, "x"]) == [3, 4] and ask(topics=[["A", "B"], ["x", "y"]]) == [3, 4, 5]
    assert ask(topics=[None, None, None]) == [1, 2, 3, 4, 5] and ask(topics=[[]]) == [] and ask(topics=[None, None, None, "z", None]) == [4]
    with pytest.raises(ValueError):
        logs.criteria(5, 4, 9)
    with pytest.raises(ValueError):
        logs.criteria(1, 20_000, 30_000)
    assert sorted(r.topic0 for r in logs.elog(df).where("txnum = 1").collect()) == [logs.ZERO]
    both = {(r.value, r.txnum): r.pos for r in logs.tval(spark.createDataFrame([(1, 1, 1, ["A", "v", "v"])], LOGS)).collect()}
    assert both == {("v", 1): 3}
    assert logs.candidates(df, None, []).count() == 5


def test_fees(spark):
    b = blocks_of(spark, [3, 0, 1])
    txs = spark.createDataFrame([(0, 0, 10, 100, 7), (0, 1, 10, 100, 3), (0, 2, 10, 100, 7), (2, 0, 10, 6, 50)], "height long, tx_index long, gas_used long, fee_cap long, tip_cap long")
    got = {r.height: (r.reward_0, r.reward_1, r.reward_2) for r in fees.rewards(b, txs, [0.0, 50.0, 100.0]).collect()}
    assert got == {0: (3, 7, 7), 1: (0, 0, 0), 2: (1, 1, 1)}
    with pytest.raises(ValueError):
        fees.rewards(b, txs, [60.0, 50.0])
    with pytest.raises(ValueError):
        fees.history(b, txs, 200, 2, [50.0])
    assert [r.ratio for r in fees.history(b, txs, 9, 2, []).orderBy("height").collect()] == [0.2, 0.0, 0.2]
    assert fees.oracle_price(b.where("height = 1"), txs.where("height = 1"), 25).head().price == 25
    below = txs.withColumn("fee_cap", F.lit(1).cast("long"))
    with pytest.raises(Exception, match="below base fee"):
        fees.rewards(b, below, [50.0]).collect()
    assert fees.least_passing(0, 1000, lambda n: n >= 377) == 377 and fees.least_passing(0, 10, lambda n: False) is None


def test_oracle_overshoots_between_blocks(spark):
    counts = [60, 60, 60]
    b = blocks_of(spark, counts)
    txs = spark.createDataFrame([(h, i, 1, 10_000, 100 * h + i) for h, n in enumerate(counts) for i in range(n)], "height long, tx_index long, gas_used long, fee_cap long, tip_cap long")
    prices = sorted(100 * h + i + 5 for h in (1, 2) for i in range(60))
    assert fees.oracle_price(b, txs, 1).head().price == prices[len(prices) * 60 // 100]


VERSIONS = "kind string, addr int, slot string, txnum long, val double, present boolean"


def test_state_reads(spark):
    rows = [("s", 1, "x", 5, 1.0, True), ("s", 1, "x", 9, None, False), ("s", 1, "x", 9, None, False), ("s", 2, "x", 7, 3.0, True), ("s", 2, "y", 0, None, False)]
    v = spark.createDataFrame(rows, VERSIONS)
    genesis = spark.createDataFrame([(1, 50.0), (2, 60.0)], "addr int, val double")
    probes = spark.createDataFrame([(1, "x", 4), (1, "x", 5), (1, "x", 9), (2, "x", 6), (2, "y", 3), (3, "x", 9)], "addr int, slot string, at long")
    got = {(r.addr, r.slot, r.at): r.val for r in state.read_many(v, probes, genesis).collect()}
    assert got == {(1, "x", 4): 50.0, (1, "x", 5): 1.0, (1, "x", 9): None, (2, "x", 6): 60.0, (2, "y", 3): None, (3, "x", 9): None}


def test_destroyed_and_recreated_accounts(spark):
    slots = spark.createDataFrame([("s", 1, "x", 5, 1.0, True), ("s", 1, "y", 12, 2.0, True), ("s", 2, "x", 3, 4.0, True)], VERSIONS)
    gone = spark.createDataFrame([(1, 10)], "addr int, txnum long")
    assert sorted((r.addr, r.slot) for r in state.slots_after_deletes(slots, gone).collect()) == [(1, "y"), (2, "x")]
    assert [tuple(r) for r in state.tombstones(slots, gone).collect()] == [(1, "x", 10)]
    rows = slots.union(spark.createDataFrame([("a", 1, "", 10, None, False), ("c", 1, "", 11, None, True)], VERSIONS))
    assert sorted((r.kind, r.addr, r.slot) for r in state.recovered(rows, 4, 20).collect()) == [("a", 1, ""), ("s", 1, "y")]


def test_overlay_against_a_model(spark):
    rng = random.Random(5)
    levels, model = [], {}
    for level in range(3):
        for t in range(60):
            key, val = rng.randrange(25), rng.choice([None, rng.random()])
            levels.append((level, key, level * 60 + t, val, val is not None))
            model[key] = val
    df = spark.createDataFrame(levels, "level int, k int, txnum long, val double, present boolean")
    assert {r.k: r.val for r in state.overlaid(df, ["k"]).collect()} == {k: v for k, v in model.items() if v is not None}


def test_overrides(spark):
    view = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0)], "addr int, slot string, val double")
    full, diff = view.where("false"), spark.createDataFrame([(2, "z", 9.0), (2, "x", None)], view.schema)
    assert sorted((r.addr, r.slot, r.val) for r in state.overridden(view, full.union(spark.createDataFrame([(1, "q", 7.0)], view.schema)), diff).collect()) == [(1, "q", 7.0), (2, "z", 9.0)]
    with pytest.raises(ValueError):
        state.overridden(view, diff, diff)


def test_traces(spark):
    deep = '{"type":"STATICCALL","from":"c","to":"d"}'
    for k in range(6):
        deep = f'{{"type":"CALL","from":"c{k}","to":"d{k}","value":"0x0","calls":[{deep}]}}'
    rows = [(1, '{"type":"CALL"}'), (2, f'{{"type":"CALL","calls":[{deep},{{"type":"CREATE","from":"m","to":"n","error":"out of gas"}},{{"type":"CREATE2","from":"m","to":"o"}},{{"type":"DELEGATECALL","value":"0x5"}},{{"type":"CALL","value":"0x1"}}]}}'), (3, '{"type":"CALL","calls":[]}')]
    got = traces.frames(spark.createDataFrame(rows, "txnum long, trace string")).orderBy("txnum", "ord")
    listed = got.collect()
    assert [r.depth for r in listed] == [0, 1, 2, 3, 4, 5, 6, 0, 0, 0, 0] and [r.ord for r in listed] == list(range(11))
    assert [r.type for r in traces.internal_operations(got).collect()] == ["CREATE", "CREATE2", "CALL"]
    assert [(r.contract, r.creator) for r in traces.creators(got).collect()] == [("o", "m")]
    assert traces.different(got, got).count() == 0


def test_document_differences(spark):
    docs = [('{"a":1,"b":{"c":[1,{"d":"x"}],"e":{}},"f":[]}', '{"a":1,"b":{"c":[1,{"d":"y"},2],"e":{"g":null}},"f":[]}'), ('{"same":[1,2]}', '{"same":[1,2]}'), ('{"n":{"m":1}}', '{"n":3}')]
    left, right = (spark.createDataFrame([(k, d[i]) for k, d in enumerate(docs)], "id long, doc string") for i in (0, 1))
    got = sorted((r.id, r.path, r.a, r.b) for r in traces.document_differences(left, right, "id", "doc").collect())
    assert [(g[0], g[1]) for g in got] == [(0, "$.b.c[1].d"), (0, "$.b.c[2]"), (0, "$.b.e"), (0, "$.b.e.g"), (2, "$.n"), (2, "$.n.m")]
    assert got[0][2:] == ("x", "y")


def test_band_samples_are_full(spark):
    """Bands with gaps still give as many blocks as they have, up to the number asked."""
    b = spark.range(1000).where("id < 100 or id % 50 = 0").select(F.col("id").alias("height"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    n = b.count()
    got = [r.band for r in integrity.band_sample(b, 8, 5).collect()]
    want = {}
    for r in b.collect():
        want[r.height * 8 // n] = want.get(r.height * 8 // n, 0) + 1
    assert {k: got.count(k) for k in set(got)} == {k: min(5, v) for k, v in want.items()}


def test_integrity_finds_what_is_broken(spark):
    b = blocks_of(spark, [1, 2, 0, 3])
    assert integrity.broken_links(b).count() == integrity.torn_slots(b).count() == 0
    bad = b.withColumn("parent_hash", F.when(F.col("height") == 2, "?").otherwise(F.col("parent_hash"))).withColumn("first_tx", F.when(F.col("height") == 3, 99).otherwise(F.col("first_tx")))
    assert [r.height for r in integrity.broken_links(bad).collect()] == [2] and [r.height for r in integrity.torn_slots(bad).collect()] == [3]
    rows = spark.createDataFrame([(0,), (1,), (3,), (3,), (3,), (9,)], "height long")
    assert sorted(r.height for r in integrity.sparse_blocks(b, rows).collect()) == [1, 9]
    with pytest.raises(ValueError, match="nothing"):
        integrity.verified(b.where("false"), 0)
    with pytest.raises(ValueError, match="broken"):
        integrity.verified(integrity.broken_links(bad), 4)


def test_tags(spark):
    b = blocks_of(spark, [1, 1, 1]).withColumn("hash", F.sha2("hash", 256))
    digest = b.where("height = 1").head().hash
    for tag, want in (("latest", 2), ("pending", 2), (None, 2), ("", 2), ("earliest", 0), ("0x1", 1), (2, 2), (f"0x{digest}", 1), ({"blockHash": digest}, 1), ({"blockNumber": "0x2"}, 2)):
        assert tags.height_of_tag(b, tag) == want
    for tag in ("0x9", "0" * 64):
        with pytest.raises(tags.UnknownBlock):
            tags.height_of_tag(b, tag)
    with pytest.raises(ValueError):
        tags.height_of_tag(b, {"blockNumber": 1, "blockHash": digest})
    with pytest.raises(ValueError):
        tags.height_of_tag(b, {"blockHash": digest, "requireCanonical": "yes"})
    assert tags.height_of_tag(b, {"blockHash": digest, "requireCanonical": True}) == 1
    for method in ("eth_call", "personal_sign", "admin_peers"):
        with pytest.raises(tags.Refused, match=method):
            tags.refuse(method)
    tags.refuse("made_up")


def test_containers():
    raw = container.pack(b"head", b"", [b"t" * n for n in (0, 1, 300)])
    assert container.unpack(raw) == (b"head", b"", [b"", b"t", b"t" * 300])
    for cut in range(len(raw)):
        with pytest.raises(ValueError):
            container.unpack(raw[:cut])
