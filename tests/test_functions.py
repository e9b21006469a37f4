import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tallystone.functions import encoding, keccak, receipts, rlp
from tallystone.sources import runs
from tallystone.streaming import follow

SF = "/root/testdata/sf0.001"


def test_keccak_known_digests(spark):
    known = {b"": "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470", b"abc": "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45", b"Transfer(address,address,uint256)": "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"}
    df = spark.createDataFrame([(m,) for m in known] + [(None,)], "m binary")
    assert {None if r.m is None else bytes(r.m): r.h and r.h.hex() for r in df.select("m", keccak.keccak256(F.col("m")).alias("h")).collect()} == known | {None: None}
    # one round function serves both paddings: SHA-3 of long messages checks the sponge
    assert len(set(keccak.digests([b"x" * n for n in range(400)]))) == 400


def test_rlp_round_trip_and_refusals():
    rng = random.Random(1)

    def item(depth):
        return rng.randbytes(rng.choice([0, 1, 2, 54, 55, 56, 57, 300])) if depth == 0 or rng.random() < 0.6 else [item(depth - 1) for _ in range(rng.randrange(5))]

    for _ in range(300):
        x = item(4)
        assert rlp.decode(rlp.encode(x)) == x
    assert rlp.encode([b"cat", b"dog"]).hex() == "c88363617483646f67"
    for bad in (b"", b"\x81\x05", b"\xb8\x01a", b"\x83ab", b"\xc2\x83a", b"aa"):
        with pytest.raises((ValueError, IndexError)):
            rlp.decode(bad)


def test_transactions_and_accounts(spark):
    to = b"\x11" * 20
    bare = rlp.encode([9, 20 * 10**9, 21000, to, 10**18, b"", 37, 1, 1])
    typed = b"\x02" + rlp.encode([1, 5, 10**9, 3 * 10**9, 50000, b"", 2**256 - 1, b"\xca\xfe", [], 0, 1, 1])
    rows = spark.createDataFrame([(bare,), (typed,), (None,)], "raw binary").select(rlp.decode_transaction("raw").alias("t")).select("t.*").collect()
    assert (rows[0].type, rows[0].nonce, rows[0].gas, int.from_bytes(rows[0].gas_price, "big"), bytes(rows[0].to)) == (0, 9, 21000, 20 * 10**9, to)
    assert (rows[1].type, rows[1].to, int.from_bytes(rows[1].value, "big"), int.from_bytes(rows[1].tip_cap, "big")) == (2, None, 2**256 - 1, 10**9)
    assert rows[2].nonce is None
    account = rlp.encode([3, 7, b"\x01" * 32, b"\x02" * 32])
    got = spark.createDataFrame([(account,), (b"",)], "raw binary").select(rlp.decode_account("raw").alias("a")).select("a.*").collect()
    assert (got[0].nonce, int.from_bytes(got[0].balance, "big"), got[1].nonce) == (3, 7, None)


def test_receipt_codec(spark):
    logs = [(b"\x01" * 20, [b"\x02" * 32] * n, b"d" * n) for n in range(5)]
    raw = receipts.pack(1, 21000, 2**40, logs)
    got = spark.createDataFrame([(raw,)], "raw binary").select(receipts.decode_receipt("raw").alias("r")).select("r.*").head()
    assert (got.status, got.gas_used, got.cumulative, [len(x.topics) for x in got.logs]) == (1, 21000, 2**40, [0, 1, 2, 3, 4])
    for cut in range(len(raw)):
        with pytest.raises(ValueError):
            receipts.unpack(raw[:cut])
    with pytest.raises(ValueError):
        receipts.unpack(raw + b"\0")


def test_roots_and_bloom():
    assert receipts.root([]).hex() == "56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421"
    pairs = {b"do": b"verb", b"dog": b"puppy", b"doge": b"coin", b"horse": b"stallion"}
    assert receipts.trie_root(pairs).hex() == "5991bb8c6514148a29db676a14ac506cd2cd5775ace63c30a4fe457715e9ac84"
    assert receipts.trie_root(dict(reversed(pairs.items()))) == receipts.trie_root(pairs)
    one = receipts.bloom([b"\x01" * 20])
    assert 1 <= int.from_bytes(one, "big").bit_count() <= 3
    both = int.from_bytes(receipts.bloom([b"\x01" * 20, b"x"]), "big")
    assert both & int.from_bytes(one, "big") == int.from_bytes(one, "big")


def test_words(spark):
    rng = random.Random(3)
    values = [0, 1, 255, 2**127, 2**128 - 1, 2**256 - 1, 10**37] + [rng.getrandbits(rng.randrange(1, 250)) for _ in range(60)]
    df = spark.createDataFrame([(i % 3, v.to_bytes(32, "big")) for i, v in enumerate(values)], "g int, w binary")
    for r in encoding.sum_words(df, ["g"], "w", "total").collect():
        total = sum(v for i, v in enumerate(values) if i % 3 == r.g)
        assert int.from_bytes(r.total, "big") == total % 2**256 and r.overflow == (total >= 2**256)
    got = df.select("w", encoding.quantity(F.col("w")).alias("q"), encoding.as_decimal(F.col("w")).alias("d"), encoding.from_quantity(encoding.quantity(F.col("w"))).alias("b")).collect()
    for r in got:
        v = int.from_bytes(r.w, "big")
        assert r.q == hex(v) and bytes(r.b) == bytes(r.w) and r.d == (v if v < 10**38 else None)
    assert [int.from_bytes(r.w, "big") for r in df.orderBy("w").collect()] == sorted(values)
    topic = df.select(encoding.topic_address(encoding.address_topic(F.unhex(F.lit("ab" * 20)))).alias("a"), encoding.topic_address(F.unhex(F.lit("01" * 32))).alias("n"), encoding.trimmed(F.unhex(F.lit("000010"))).alias("t")).head()
    assert (bytes(topic.a), topic.n, bytes(topic.t)) == (b"\xab" * 20, None, b"\x10")


def _blocks(spark, n):
    return spark.range(n).select(F.col("id").alias("height"), (F.col("id") * 3).alias("first_tx"), (F.col("id") * 3 + 2).alias("boundary_tx"))


def test_receipts_shuffle_transactions_once(spark):
    from tallystone.plans import bindings, lifecycle

    bindings.ledger_corpus(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lifecycle.f14_receipt_json(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1  # transactions and blocks, by height


def test_cuts_by_doubling_jumps(spark):
    rng = random.Random(3)
    counts, first, rows = [rng.choice([0, 1, 5, 30]) for _ in range(400)], 0, []
    for h, n in enumerate(counts):
        rows.append((h, first, first + n))
        first += n + 1
    for slots, most in ((100, 1000), (10_000, 7), (60, 12), (1 << 30, 1 << 30)):
        want, at = [], 0
        for h, _, boundary in rows:
            if boundary + 1 - rows[at][1] >= slots or h - at + 1 >= most:
                want.append((rows[at][1], boundary + 1, at, h))
                at = h + 1
        got = runs.run_cuts(spark.createDataFrame(rows, "height long, first_tx long, boundary_tx long"), slots, most).collect()
        assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("slots, most, stretch", [(100, 3, 1), (40, 5, 333), (1 << 30, 2, 1)])
def test_cuts_over_many_stretches(spark, slots, most, stretch):
    rng, first, rows = random.Random(5), 0, []
    for h in range(1500):
        n = rng.choice([0, 1, 5, 30])
        rows.append((h, first, first + n))
        first += n + 1
    want, at = [], 0
    for h, _, boundary in rows:
        if boundary + 1 - rows[at][1] >= slots or h - at + 1 >= most:
            want.append((rows[at][1], boundary + 1, at, h))
            at = h + 1
    blocks = spark.createDataFrame(rows, "height long, first_tx long, boundary_tx long")
    assert sorted(map(tuple, runs.run_cuts(blocks, slots, most, stretch).collect())) == want
    assert runs.run_cuts(blocks.where("height < 0"), slots, most).collect() == []


@pytest.mark.parametrize("name", ["p10_runs_pruned_by_slots", "s16_c3_runs_read_back", "s17_s18_published_and_joined", "v8_v9_v10_runs_verified", "s9_ordered_scan"])
def test_jobs_dont_grow_with_the_number_of_runs(spark, monkeypatch, name):
    from tallystone.plans import bindings, lifecycle

    monkeypatch.setattr(lifecycle, "TERMINAL", 400)  # 20 merges
    monkeypatch.setattr(lifecycle, "SLOTS", 50)
    monkeypatch.setattr(bindings, "_STORED", {k: v for k, v in bindings._STORED.items() if not k[2].startswith("runs")})
    bindings.ledger_corpus(spark, SF)
    spark.sparkContext.setJobGroup(name, name)
    getattr(lifecycle, name)(spark, SF).collect()
    spark.sparkContext.setJobGroup("none", "none")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) <= 60


def test_families_of_a_run(spark, tmp_path):
    blocks = spark.range(50).select(F.col("id").alias("height"), (F.col("id") * 3).alias("txnum"))
    posts = spark.range(150).select(F.col("id").alias("txnum"), (F.col("id") % 7).cast("string").alias("addr"))
    corpus = runs.Corpus(spark, str(tmp_path / "c"), "root")
    corpus.flush({"blocks": blocks, "postings": posts}, (0, 90, 0, 29))
    corpus.flush({"blocks": blocks, "postings": posts}, (90, 150, 30, 49))
    assert corpus.read(family="postings").count() == 150 and corpus.scan("blocks").collect() == blocks.collect()
    merged = corpus.merge(100)
    assert {f[0]: f[1] for f in merged.families} == {"blocks": 50, "postings": 150}
    assert {(r.family, r.rows) for r in corpus.sizes().collect()} == {("blocks", 50), ("postings", 150)}
    assert sorted(map(tuple, corpus.read(family="postings").select("txnum", "addr").collect())) == sorted(map(tuple, posts.collect()))


def test_latest_state_against_a_model(spark, tmp_path):
    from tallystone.sources.latest import Latest

    rng, model, store = random.Random(9), {}, Latest(spark, str(tmp_path / "l"))
    for step in range(5):
        rows = {bytes([rng.randrange(40)]) * rng.randint(1, 3): rng.choice([None, b"", b"v%d" % rng.randrange(99)]) for _ in range(25)}
        store.put(spark.createDataFrame(list(rows.items()), "key binary, val binary"))
        model |= rows
        live = sorted((k, v) for k, v in model.items() if v)
        assert [(bytes(r.key), bytes(r.val)) for r in store.rows().collect()] == live
        assert [(bytes(r.key), bytes(r.val)) for r in store.rows(b"\x05", b"\x14\x14").collect()] == [x for x in live if b"\x05" <= x[0] < b"\x14\x14"]
        if step == 2:
            with pytest.raises(ValueError, match="no"):
                store.roll(lambda rows: (_ for _ in ()).throw(ValueError("no")))
            store.roll()
            assert store.overlay_size() == (0, 0)
    asked = spark.createDataFrame([(k,) for k in sorted(model)] + [(b"none",)], "key binary")
    assert {bytes(r.key): r.val and bytes(r.val) for r in store.get(asked).collect()} == {k: v or None for k, v in model.items()} | {b"none": None}
    for bad in ([(b"a", b"1"), (b"a", b"2")], [(b"", b"1")], [(b"k" * 256, b"1")], [(b"k", b"v" * 256)]):
        with pytest.raises(Exception, match="twice or doesn't fit"):
            store.put(spark.createDataFrame(bad, "key binary, val binary"))


def test_blooms_and_roots_by_block(spark):
    from tallystone.plans import bindings as B
    from tallystone.plans import catalog

    own = {}
    for r in B.typed_txs(spark, SF).select("height", "tx_index", "tx_hash", "logs").collect():
        own.setdefault(r.height, []).append(r)
    got = {r.height: r.bloom for r in catalog.QUERIES["a14_block_blooms"](spark, SF).collect()}
    items = {h: {x for r in rows for log in r.logs for x in (log.address, *log.topics)} for h, rows in own.items()}
    assert got == {h: receipts.bloom([x.encode() for x in i]).hex().upper() for h, i in items.items() if i}
    roots = {r.height: r.root for r in catalog.QUERIES["a15_transaction_roots"](spark, SF).collect()}
    some = sorted(own)[:40]
    assert all(roots[h] == receipts.root([bytes.fromhex(r.tx_hash) for r in sorted(own[h], key=lambda r: r.tx_index)]).hex() for h in some)


def test_roots_of_many_blocks_are_hashed_together(monkeypatch):
    rng = random.Random(1)
    sizes = [0, 1, 2, 3, 15, 16, 17, 18, 127, 128, 129, 255, 256, 257, 300] + [rng.randrange(20) for _ in range(60)]
    lists = [[rng.randbytes(rng.choice([1, 5, 32, 33, 200])) for _ in range(n)] for n in sizes]
    want, calls, digests = [receipts.root(x) for x in lists], [], receipts.keccak.digests
    monkeypatch.setattr(receipts.keccak, "digests", lambda m: calls.append(len(m)) or digests(m))
    assert receipts.roots(lists) == want and receipts.roots([]) == []
    assert len(calls) <= 12 and sum(calls) > 500  # by level, not by block


def test_runs_flush_merge_publish(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("txnum"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    blocks, corpus, at = _blocks(spark, 100), runs.Corpus(spark, str(tmp_path / "c"), "root"), 0
    while edge := runs.next_edge(blocks, at, 40, 20):
        last, first, end = edge
        corpus.flush(rows, (first, end, at, last))
        at = last + 1
    spans = [(r.from_tx, r.to_tx) for r in corpus.runs()]
    assert spans[0] == (0, 42) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    before = corpus.read().orderBy("txnum").collect()
    old = [r.path for r in corpus.runs()]
    with corpus.snapshot() as held:
        merged = corpus.merge(100)
        assert merged.level == 1 and merged.rows == merged.to_tx - merged.from_tx
        assert corpus.read(held).orderBy("txnum").collect() == before  # what a snapshot holds stays
    gone = corpus.sweep()
    assert gone and set(gone) < set(old) and corpus.read().orderBy("txnum").collect() == before
    assert [r.txnum for r in corpus.at_slots(50, 60).orderBy("txnum").collect()] == list(range(50, 61))
    assert corpus.publish(str(tmp_path / "p")) == [merged]
    other = runs.Corpus(spark, str(tmp_path / "p"), "root")
    assert other.join() == [merged] and other.read().count() == merged.rows
    with pytest.raises(ValueError, match="chain"):
        runs.Corpus(spark, str(tmp_path / "p"), "other").join()
    again = corpus.merge(100)
    assert again and corpus.publish(str(tmp_path / "p")) == [merged, again] == other.join()
    footer = tmp_path / "p" / merged.path / "_footer.json"
    kept = footer.read_text()
    footer.write_text(kept.replace('"rows": ', '"rows": 1'))
    with pytest.raises(ValueError, match="footer"):
        other.join()
    footer.unlink()
    with pytest.raises(OSError):
        other.join()
    footer.write_text(kept)
    (tmp_path / "p" / "current.json").unlink()
    with pytest.raises(ValueError, match="pointer"):
        other.join()
    assert runs.Corpus(spark, str(tmp_path / "nothing"), "root").join() == []
    gap = corpus.runs()
    with pytest.raises(ValueError):
        runs.check_tiling([gap[0], *gap[2:]])
    seen = corpus.generation()
    corpus.commit(corpus.runs(), seen)
    with pytest.raises(runs.Conflict):
        corpus.commit(corpus.runs(), seen)  # another writer was faster
    (tmp_path / "c" / f"claim-{seen + 2:08d}").touch()  # one that died after its claim
    with pytest.raises(runs.Conflict):
        corpus.commit(corpus.runs(), seen + 1)
    corpus.sweep()
    assert corpus.commit(corpus.runs(), seen + 1) == seen + 2
    assert runs.content_name(rows)[0] == runs.content_name(rows.orderBy(F.desc("txnum")).repartition(7))[0]


@pytest.mark.parametrize("families", [False, True])
def test_merging_all_at_once_gives_the_same_runs(spark, tmp_path, families):
    rows = spark.range(400).select(F.col("id").alias("txnum"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    made = [runs.Corpus(spark, str(tmp_path / n), "root") for n in "ab"]
    spans = [(at, at + 40, at // 2, at // 2 + 19) for at in range(0, 400, 40)]
    none = rows.where("txnum >= 120 and txnum < 240")  # a family that has rows in some runs only
    for corpus in made:
        if families:
            for span in spans[:7]:
                corpus.flush({"txs": rows, "postings": none.select(F.substring("v", 1, 2).alias("addr"), "txnum")}, span)
        else:
            corpus.flush_all(rows, spans)
    one, all_ = made
    want = []
    while run := one.merge(100):
        want.append(run)
    at, jobs = all_.generation(), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("all", "all")
    got = all_.merge_all(100)
    spark.sparkContext.setJobGroup("none", "none")
    assert len(jobs.getJobIdsForGroup("all")) <= 12 * (1 + families)  # as many passes however many runs there are
    said = lambda r: (r.name, r.level, r.from_tx, r.to_tx, r.from_height, r.to_height, r.rows)
    assert [said(r) for r in got] == [said(r) for r in want] and [said(r) for r in all_.runs()] == [said(r) for r in one.runs()]
    assert all_.generation() == at + 1 and all_.merge_all(100) == []
    all_.present(all_.runs())
    for family in ("txs", "postings") if families else (runs.ROWS,):
        for run, same in zip(all_.runs(), one.runs()):
            again = runs.Corpus(spark, str(tmp_path / "b"), "root").read([run], family)
            key = runs.ORDER.get(family, ["txnum"])
            files = {}
            for r in again.select("*", F.col("_metadata.file_path").alias("file")).collect():
                files.setdefault(r.file, []).append(tuple(r[k] for k in key))
            assert all(f == sorted(f) for f in files.values())
            want = one.read([same], family)
            assert sorted(again.select(want.columns).collect()) == sorted(want.collect())


def _chain(a, b):
    h = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    return [(i, h(i), h(i - 1), [f"t{i}-{k}" for k in range(i % 3)]) for i in range(a, b)]


SCHEMA = "height long, hash string, parent_hash string, tx_hashes array<string>"


def _land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_in_order(spark, tmp_path):
    land, check, store = str(tmp_path / "land"), str(tmp_path / "check"), []
    head = lambda: (store[-1][0], store[-1][1]) if store else None
    keep = lambda df: store.extend(tuple(r) for r in df.orderBy("height").collect())

    def go():
        q = follow.ingest(follow.landed(spark, land, SCHEMA, 1), check, head, keep)
        q.awaitTermination(60)

    _land(spark, land, _chain(0, 5))
    go()
    _land(spark, land, _chain(3, 8))  # overlaps: stored blocks are skipped
    go()
    assert [r[0] for r in store] == list(range(8))
    _land(spark, land, _chain(10, 12))  # a gap is refused, and stays refused
    for _ in range(2):
        with pytest.raises(Exception, match="gap"):
            go()
    assert len(store) == 8


def test_subscriptions_equal_the_batch_answer(spark, tmp_path):
    land = str(tmp_path / "land")
    _land(spark, land, _chain(0, 6))
    _land(spark, land, _chain(6, 11))
    for make, name in ((follow.new_heads, "heads"), (follow.accepted, "accepted"), (follow.pending, "pending")):
        stream = make(follow.landed(spark, land, SCHEMA, 1))
        stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(60)
        want = make(spark.read.schema(SCHEMA).parquet(land))
        assert sorted(spark.table(name).collect()) == sorted(want.collect())


def test_poll_filters():
    top = [5]
    f = follow.Filters(lambda: top[0])
    name = f.install(lambda a, b: list(range(a, b + 1)), last=8)
    assert f.changes(name) == []
    top[0] = 7
    assert f.changes(name) == [6, 7] and f.changes(name) == []
    top[0] = 20
    assert f.changes(name) == [8] and f.logs(name) == list(range(1, 9))
    assert f.uninstall(name) and not f.uninstall(name)
    with pytest.raises(KeyError):
        f.changes(name)


def test_elias_fano():
    from tallystone.functions import eliasfano

    rng = random.Random(4)
    for n in (0, 1, 2, 100, 4096):
        for top in (n + 1, 10 * n + 5, 2**40):
            numbers = sorted(rng.sample(range(top), n))
            payload = [rng.randrange(32) for _ in numbers]
            assert eliasfano.decode(eliasfano.encode(numbers, payload)) == (numbers, payload)
            assert eliasfano.decode(eliasfano.encode(numbers)) == (numbers, [0] * n)
    whole = eliasfano.encode([1, 5, 9], [1, 2, 3])
    for bad in (whole[:-1], whole + b"x"):
        with pytest.raises(ValueError):
            eliasfano.decode(bad)
    with pytest.raises(ValueError):
        eliasfano.encode([3, 3])


def test_state_roots_full_and_rolled(spark):
    rng = random.Random(12)
    state = {hashlib.sha256(b"%d" % i).digest(): b"v%d" % rng.randrange(10**9) * rng.randint(1, 9) for i in range(1200)}
    frame = lambda: spark.createDataFrame(list(state.items()), "key binary, value binary")
    root, known = receipts.state_root(frame())
    assert root == receipts.trie_root(state)
    for k in list(state)[:20]:
        state[k] = b"changed"
    gone = list(state)[30:34]
    changed = {k.hex()[:2] for k in [*list(state)[:20], *gone]}
    for k in gone:
        del state[k]
    rolled, _ = receipts.state_root(frame(), known, sorted(changed))
    assert rolled == receipts.trie_root(state) != root
    few = dict(list(state.items())[:5])
    assert receipts.state_root(spark.createDataFrame(list(few.items()), "key binary, value binary"))[0] == receipts.trie_root(few)


def test_recovery_cuts_a_torn_tail(spark):
    rows = [(h, part, part == 2) for h in range(3, 9) for part in range(3)] + [(9, 0, False), (9, 1, False)]
    df = spark.createDataFrame(rows, "height long, part int, ended boolean")
    assert sorted({r.height for r in follow.whole_blocks(df, None).collect()}) == list(range(3, 9))
    assert sorted({r.height for r in follow.whole_blocks(df, 5).collect()}) == [6, 7, 8]
    assert follow.whole_blocks(df, 8).count() == 0
    for bad, head in ((df.where("height <> 6"), None), (df.where("not (height = 6 and ended)"), None), (df, 1)):
        with pytest.raises(follow.OrderError):
            follow.whole_blocks(bad, head)


def test_groups_are_halved_to_the_failing_block(spark):
    kept = []

    def store(part):
        own = sorted(r.height for r in part.collect())
        if 41 in own:
            raise ValueError("bad block")
        kept.extend(own)

    blocks = spark.range(10, 60).withColumnRenamed("id", "height")
    with pytest.raises(follow.OrderError, match="block 41"):
        follow.store_in_groups(blocks, store, 16)
    assert kept == list(range(10, 41))
    kept.clear()
    assert follow.store_in_groups(blocks.where("height < 41"), store, 16) == 31 == len(kept)
    assert follow.store_in_groups(blocks.where("false"), store) == 0
    assert follow.due(10, 500) == (11, 138) and follow.due(10, 12) == (11, 12) and follow.due(10, 10) is None and follow.due(10, 500, 20) == (11, 20) and follow.due(20, 500, 20) is None


def test_batches_go_into_all_families_and_heads_are_the_newest(spark, tmp_path):
    blocks = spark.range(12).select(F.col("id").alias("height"), F.concat(F.lit("h"), "id").alias("hash"), F.concat(F.lit("h"), F.col("id") - 1).alias("parent_hash"), (F.col("id") * 3).alias("first_tx"), (F.col("id") * 3 + 2).alias("boundary_tx"))
    corpus = runs.Corpus(spark, str(tmp_path / "c"), "root")
    families = lambda new: {"blocks": new.withColumn("txnum", F.col("boundary_tx")), "txs": new.select("height", F.explode(F.sequence("first_tx", "boundary_tx")).alias("txnum"))}
    blocks.repartitionByRange(3, "height").write.parquet(str(tmp_path / "land"))
    head = lambda: (lambda own: (own[-1].to_height, f"h{own[-1].to_height}") if own else None)(corpus.runs())
    follow.ingest(follow.landed(spark, str(tmp_path / "land"), blocks.schema, 12), str(tmp_path / "k"), head, follow.store_families(corpus, families)).awaitTermination()
    assert corpus.read(family="blocks").count() == 12 and corpus.read(family="txs").count() == 36
    heads = []
    follow.newest_heads(follow.landed(spark, str(tmp_path / "land"), blocks.schema, 12), str(tmp_path / "k2"), lambda best: heads.extend(r.height for r in best.collect())).awaitTermination()
    assert heads[-1] == 11 and len(heads) == 1
    again = corpus.migrate(lambda own: own | {"hashes": own["blocks"].select(F.col("hash").alias("digest"), "height", "txnum")})
    assert corpus.read(family="hashes").count() == 12 and corpus.runs() == again and corpus.read(family="txs").count() == 36

    from tallystone.__main__ import main

    assert main(["verify", str(tmp_path / "c"), "--chain", "root"], spark) == 0 and main(["sizes", str(tmp_path / "c"), "--chain", "root"], spark) == 0
    with pytest.raises(ValueError):
        main(["verify", str(tmp_path / "none")], spark)


def test_misc_log_survives_a_torn_tail(tmp_path):
    from tallystone.sources.misc import MiscLog

    log = MiscLog(tmp_path / "x" / "misc.log")
    for i in range(20):
        log.put(f"k{i % 7}", {"n": i})
    log.delete("k3")
    log.close()
    kept = dict(log.kept)
    assert MiscLog(tmp_path / "x" / "misc.log").kept == kept and "k3" not in kept and kept["k5"] == {"n": 19}
    whole = (tmp_path / "x" / "misc.log").read_bytes()
    for cut in range(len(whole) - 30, len(whole)):
        (tmp_path / "y.log").write_bytes(whole[:cut])
        again = MiscLog(tmp_path / "y.log")
        again.put("after", 1)
        again.close()
        assert MiscLog(tmp_path / "y.log").get("after") == 1
    with pytest.raises(ValueError):
        log.put("k", None)
