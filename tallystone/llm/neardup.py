"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 2-bit segments. The Manhattan
distance of two embeddings is a lower bound of the Hamming distance, so a link (2 or fewer
bits) has embeddings at distance 2 or less, and one of the two halves at distance 1 or
less. A grid range-join over half embeddings therefore finds every link: each fingerprint
is filed under the cell of either half and looks into that cell and those one step up in
one coordinate. Candidates pass the lower bound over the whole embedding, then the exact
Hamming distance.

Cells with more than CROWD fingerprints are not joined pair by pair. Every fingerprint that
looks into one is listed under the 65 points at distance 1 or less from it: two of them
share a point exactly if they are 2 or fewer bits apart, so linking each point's (at most
65) fingerprints to the least of them keeps every component, without pairs of a group.

Components are found among distinct fingerprints by alternating large and small stars,
each round written to the shared folder; copies of a text never become links.

Defined results: no words (null, empty or blank text) is fingerprint zero, linked like any
other; a sequence of fewer words than a shingle is one shingle; repeated rows repeat; a
component of null ids only has a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import written

SEED = 42
CROWD = 48
RADIUS = 2
TABLES = 32
MARKS = 8  # words of 64 bits that a difference from a centre is marked in; a power of 2
ROWS = 6  # least hashes of a table's slot: texts of similarity j share one of the slots with chance 1 - (1 - j^ROWS)^TABLES, 0.9999 at 0.8, whatever else the table holds
#: bits of a byte, each in a byte of its own
SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))).sum(1).astype(np.uint64)


def hashes_of(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text, repeats included."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(parts) - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits, the lowest bit first."""
    counts = np.zeros((8, 8), np.int64)
    for i in range(0, len(hashes), 255 * 64):
        part = SPREAD[np.ascontiguousarray(hashes[i : i + 255 * 64]).view(np.uint8).reshape(-1, 8)]
        full = len(part) // 255 * 255
        if full:
            counts += part[:full].reshape(-1, 255, 8).sum(1).view(np.uint8).reshape(-1, 8, 8).sum(0, dtype=np.int64)
        if full < len(part):
            counts += part[full:].sum(0).view(np.uint8).reshape(8, 8)
    return counts.reshape(64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero of none."""
    return int(np.packbits(2 * votes(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


def mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of what the hashes stand for; turn 0 leaves them."""
    if turn == 0:
        return hashes
    x = hashes + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, text_key and fp, the fingerprint as a signed 64-bit number, of every row."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(hashes_of(t.as_py(), words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "text_key", "fp"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"xxhash64(coalesce(`{text_col}`, '')) text_key", f"`{text_col}` text").mapInArrow(run, "doc_id long, text_key long, fp long")


def halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def counts_of(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of a half, two bits each."""
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))


def apart(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed halves, at most RADIUS if it is that small, else more."""
    total = F.lit(0)
    for i in range(16):
        total = total + F.abs(F.shiftright(a, 2 * i).bitwiseAND(F.lit(3)) - F.shiftright(b, 2 * i).bitwiseAND(F.lit(3)))
    return total


def links(prints: DataFrame) -> DataFrame:
    """a < b: a link graph with the components of all pairs of distinct `fp` RADIUS or fewer bits apart."""
    high, low = halves(F.col("fp"))
    homes = prints.select("fp", F.posexplode(F.array(counts_of(high), counts_of(low))).alias("half", "cell"))
    # one step up in one coordinate: those segments with fewer than two bits set
    steps = [F.when(F.shiftright(F.col("cell"), 2 * i).bitwiseAND(F.lit(3)) < 2, F.col("cell") + (1 << 2 * i)) for i in range(16)]
    looks = homes.select("fp", "half", F.explode(F.filter(F.array(F.col("cell"), *steps), lambda c: c.isNotNull())).alias("cell"), F.col("cell").alias("home"))
    crowded = written(homes.groupBy("half", "cell").count().where(F.col("count") > CROWD).select("half", "cell"), "crowded")
    near = looks.join(crowded, ["half", "cell"], "left_anti").withColumnRenamed("fp", "a")
    filed = homes.join(crowded, ["half", "cell"], "left_anti").select(F.col("half").alias("side"), F.col("cell").alias("place"), F.col("fp").alias("b"))
    (ah, al), (bh, bl) = halves(F.col("a")), halves(F.col("b"))
    bound = apart(counts_of(ah), counts_of(bh)) + apart(counts_of(al), counts_of(bl))
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    once = (F.col("home") != F.col("cell")) | (F.col("a") < F.col("b"))
    # both sides are many times what their statistics say: never broadcast them
    lone = near.join(filed.hint("merge"), (F.col("half") == F.col("side")) & (F.col("cell") == F.col("place")) & once & (bound <= RADIUS) & (exact <= RADIUS)).select("a", "b")
    busy = looks.join(crowded, ["half", "cell"], "left_semi").select("fp").distinct()
    flips = F.array(*(F.lit(x).cast("long") for x in (0, *(1 << i for i in range(63)), -(1 << 63))))
    stars = busy.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    stars = stars.groupBy("point").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    both = lone.union(stars).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node that has a link."""
    now, mark = written(edges.select("a", "b"), "edges"), None
    while True:
        # large star: neighbours above a node are linked to the least of its neighbours and itself
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join can split the links of a node that has most of them
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        # small star: neighbours below a node, and the node, are linked to the least of those
        under = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(under, "b").select(F.col("m").alias("m"), "a", "b")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        now = written(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).head()
        if seen[0] == seen[2] and mark == tuple(seen):
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a"), F.col("a")).distinct())
        mark = tuple(seen)


def classed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, text_key, fp, root (the component's fingerprint) and component_id of every row."""
    prints = written(fingerprints(df, id_col, text_col, words), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(distinct.select("fp")))
    # a fingerprint without a link is its own component
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    best = written(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "best")
    known = named.join(best, "root").select("fp", "root", "component_id")
    return prints.join(known, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (least id reachable over links) of every row."""
    found = classed(df, id_col, text_col, words)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def slots_of(own: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """One number a table, of the least values that `rows` hash functions take on the distinct shingles; nothing of none."""
    if not len(own):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng([SEED, tables, rows])
    flip, odd = (rng.integers(0, 1 << 32, (tables * rows, 1), dtype=np.uint32) for _ in range(2))
    odd |= np.uint32(1)
    short, least = own.astype(np.uint32), np.full(tables * rows, (1 << 32) - 1, np.uint32)
    for i in range(0, len(short), 2048):
        x = short[i : i + 2048] ^ flip
        x *= odd
        np.minimum(least, x.min(1), out=least)
    slot = np.arange(tables, dtype=np.uint64)
    for column in least.reshape(tables, rows).T:
        slot = mixed(slot ^ column, 1)
    return slot.view(np.int64)


def sets_of(df: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, shingles (their distinct hashes), slots (of TABLES tables) and fp (the fingerprint of those hashes) of every row."""

    def run(batches):
        for batch in batches:
            own = [np.unique(hashes_of(t.as_py(), words)) for t in batch.column(2)]
            lists = ([x.view(np.int64) for x in own], [slots_of(x, TABLES, ROWS) for x in own])
            prints = pa.array(np.array([fingerprint(x) for x in own], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int64())) for x in lists), prints], ["doc_id", "text_key", "shingles", "slots", "fp"])

    return df.selectExpr("cast(doc_id as long) doc_id", "xxhash64(coalesce(text, '')) text_key", "text").mapInArrow(run, "doc_id long, text_key long, shingles array<long>, slots array<long>, fp long")


def shared_slots(nodes: DataFrame, name: str) -> DataFrame:
    """slot and all (its nodes) of every slot that two nodes share."""
    filed = nodes.select("node", F.explode("slots").alias("slot"))
    return written(filed.groupBy("slot").agg(F.collect_list("node").alias("all")).where("size(all) > 1"), name)


def sets_by_node(df: DataFrame, prints: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and shingles of the wanted nodes, made anew from one text of each: sets of all rows are larger than the texts."""
    own = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("text_key", "doc_id")).alias("w")).select(F.col("w.doc_id").alias("_tally_id"), F.col("w.text_key").alias("_tally_key"))
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_tally_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_tally_key"))
    made = sets_of(texts.join(own, same, "left_semi"), words).withColumn("node", F.xxhash64("shingles"))
    return written(made.select("node", "shingles").dropDuplicates(["node"]), "sets")


def alike(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Those of the pairs a < b whose shingle sets have a Jaccard similarity of 0.8 or more, exactly."""
    # sets are many times what their statistics say: never broadcast them
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")).hint("merge") for c in "ab")
    n = F.size("sa") + F.size("sb")
    # the share of the smaller in the larger bounds the similarity
    bound = 5 * F.least(F.size("sa"), F.size("sb")) >= 4 * F.greatest(F.size("sa"), F.size("sb"))
    return written(pairs.join(one, "a").join(two, "b").where(bound & (9 * F.size(F.array_intersect("sa", "sb")) >= 4 * n)).select("a", "b"), name)


def embedded(nodes: DataFrame) -> DataFrame:
    """a < b: nodes whose fingerprints the grid join over the embedding links; one node stands for those of a fingerprint, and is paired with them."""
    stands = written(nodes.groupBy("fp").agg(F.min("node").alias("stand")), "stands")
    of = lambda fp, node: stands.select(F.col("fp").alias(fp), F.col("stand").alias(node)).hint("merge")
    linked = links(stands.select("fp")).join(of("a", "p"), "a").join(of("b", "q"), "b").select("p", "q")
    same = nodes.join(of("fp", "p"), "fp").where("node <> p").select("p", F.col("node").alias("q"))
    return linked.union(same).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def parted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs a < b whose nodes aren't in one component yet."""
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def centred(shared: DataFrame) -> DataFrame:
    """slot and centre: the node of the slot that meets most others over all slots, by number if several do.

    Copies of one text that differ from each other more than from it meet it most often.
    """
    filed = shared.select("slot", F.size("all").alias("n"), F.explode("all").alias("node"))
    meets = written(filed.groupBy("node").agg(F.sum("n").alias("meets")), "meets")
    best = F.min_by("node", F.struct(-F.col("meets"), F.col("node")))
    return written(filed.join(meets.hint("merge"), "node").groupBy("slot").agg(best.alias("centre")), "centres")


def starred(shared: DataFrame, centres: DataFrame) -> DataFrame:
    """a < b: every node of a slot with its centre."""
    both = shared.join(centres.hint("merge"), "slot").select("centre", F.explode("all").alias("node")).where("centre <> node")
    return both.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()


def crossing(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """a < b: all pairs of nodes that share a slot and aren't in one component yet."""
    filed = shared.select("slot", F.explode("all").alias("node")).join(roots, "node", "left").select("slot", "node", F.coalesce("root", "node").alias("root"))
    groups = filed.groupBy("slot", "root").agg(F.collect_list("node").alias("all"))
    mixed_slots = groups.groupBy("slot").count().where("count > 1").select("slot")
    groups = written(groups.join(mixed_slots, "slot", "left_semi"), "groups")
    other = groups.select("slot", F.col("root").alias("root2"), F.col("all").alias("all2"))
    both = groups.join(other.hint("merge"), "slot").where("root < root2").select(F.explode("all").alias("p"), "all2")
    both = both.select("p", F.explode("all2").alias("q"))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def differing(shared: DataFrame, centres: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """a < b: all pairs of nodes that share a slot, aren't in one component yet and may be similar.

    Every node x of a slot has been compared with its centre c or is in one component with
    it. D(x), what x and c don't share, settles the rest: sets x and y are similar if |x ^ y| <= (|x| + |y|) / 9, and
    x ^ y = D(x) ^ D(y), so D(x) and D(y) share A = (|D(x)| + |D(y)| - (|x| + |y|) / 9) / 2
    shingles or more. One of a pair that is of two components isn't similar to c, so its D
    is larger than (|x| + |c|) / 9, and A is above 0: the pair shares a shingle among the
    first |D| - A + 1 of either D, ordered alike (what c lacks first), and so many are left
    after it on both sides as A needs; and no more marks of either D than that allows are
    missing in the other. Nothing is missed, and groups of copies that are
    unlike each other make no pairs but those that share their changes.
    """
    own = roots.select(F.col("node").alias("n"), "root")
    root_of = lambda df, node, out: df.join(own.withColumnRenamed("root", out).hint("merge"), F.col(node) == F.col("n"), "left").withColumn(out, F.coalesce(out, node)).drop("n")
    filed = shared.join(centres.hint("merge"), "slot").select("slot", "centre", F.explode("all").alias("node"))
    filed = written(root_of(filed, "node", "root"), "filed")
    split = filed.groupBy("slot").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("slot")
    groups = filed.join(split, "slot", "left_semi").select("centre", "node", "root").distinct()
    groups = root_of(groups, "centre", "centre_root").withColumn("lone", F.col("root") != F.col("centre_root"))
    # sets are many times what their statistics say: never broadcast them
    of = lambda node, out: sets.select(F.col("node").alias(node), F.col("shingles").alias(out)).hint("merge")
    both = groups.join(of("node", "s"), "node").join(of("centre", "c"), "centre")
    apart = both.select("centre", "node", "root", "lone", F.size("s").alias("size"), F.size("c").alias("c_size"), F.concat(F.array_sort(F.array_except("s", "c")), F.array_sort(F.array_except("c", "s"))).alias("d"))
    # marks of D, a bit a shingle: what is marked in one and not in the other isn't shared
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda i: F.aggregate("d", F.lit(0).cast("long"), lambda acc, t: F.when(F.shiftrightunsigned(t, 6).bitwiseAND(F.lit(MARKS - 1)) == i, acc.bitwiseOR(bit(t))).otherwise(acc))
    apart = apart.withColumns({f"m{i}": word(i) for i in range(MARKS)})
    marks = [f"m{i}" for i in range(MARKS)]
    n = F.size("d")
    # 18 A at least, of any partner, and of a partner that isn't similar to the centre
    least = F.when(F.col("lone"), (9 * n - F.col("size") - F.col("c_size")) * 9 / 5).otherwise(9 * n + F.col("c_size") - F.col("size"))
    first = n - F.greatest(F.ceil(least / 18), F.lit(1)).cast("int") + 1
    listed = apart.withColumn("n", n).select("centre", "node", "root", "lone", "size", "n", *marks, F.posexplode(F.slice("d", F.lit(1), F.greatest(first, F.lit(0)))).alias("at", "token"))
    listed = written(listed, "changes")
    x = listed.where("lone").select(*(F.col(m).alias(f"p_{m}") for m in marks), "centre", "token", F.col("node").alias("p"), F.col("root").alias("p_root"), F.col("size").alias("p_size"), (F.col("n") - F.col("at")).alias("p_left"), F.col("n").alias("p_n"))
    y = listed.select(*(F.col(m).alias(f"q_{m}") for m in marks), "centre", "token", F.col("node").alias("q"), F.col("root").alias("q_root"), F.col("size").alias("q_size"), (F.col("n") - F.col("at")).alias("q_left"), F.col("n").alias("q_n"))
    only = lambda a, b: sum((F.bit_count(F.col(f"{a}_{m}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{m}")))) for m in marks), F.lit(0))
    shared_most = F.least("p_left", "q_left", F.col("p_n") - only("p", "q"), F.col("q_n") - only("q", "p"))
    enough = 18 * shared_most >= 9 * (F.col("p_n") + F.col("q_n")) - F.col("p_size") - F.col("q_size")
    met = x.withColumnsRenamed({"centre": "c", "token": "t"}).join(y.hint("merge"), (F.col("c") == F.col("centre")) & (F.col("t") == F.col("token")) & (F.col("p_root") != F.col("q_root")) & enough)
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def similar_classes(df: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, text_key and root of every row: components of texts whose shingle sets have a similarity of 0.8 or more.

    First candidates are the links of the operator: fingerprints RADIUS or fewer bits apart,
    by the grid join over the embedding. At a similarity of 0.8, fingerprints are 5 to 13
    bits apart, so what that leaves in several components goes on: candidates then share a
    slot of TABLES tables of least hashes. The nodes of each slot are compared with its
    centre, which joins groups of near-copies by as many pairs as they have nodes. What
    shares a slot and isn't in one component after that is compared pair by pair in slots
    of up to CROWD nodes, and in fuller ones where what the two don't share with the centre
    leaves a chance. Every candidate is decided by its exact similarity.
    """
    prints = sets_of(df, words).withColumn("node", F.xxhash64("shingles"))
    prints = written(prints.drop("shingles"), "prints")
    nodes = prints.groupBy("node").agg(F.first("slots").alias("slots"))
    shared = shared_slots(nodes, "shared")
    near = written(embedded(prints.select("node", "fp").distinct()), "near")
    wanted = shared.select(F.explode("all").alias("node")).union(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = sets_by_node(df, prints, wanted, words)
    centres = centred(shared)
    tried = links_found = roots = None
    steps = (
        lambda: near,
        lambda: parted(starred(shared, centres), roots),
        lambda: crossing(shared.where(F.size("all") <= CROWD), roots),
        lambda: differing(shared.where(F.size("all") > CROWD), centres, roots, sets),
    )
    for step in steps:
        pairs = written(step() if tried is None else step().join(tried, ["a", "b"], "left_anti"), "pairs")
        if tried is not None and pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = alike(pairs, sets, "alike")
        links_found = found if links_found is None else links_found.union(found)
        roots = written(components(links_found), "roots")
    last = roots.withColumnRenamed("node", "_tally_node")
    return prints.select("doc_id", "text_key", "node").join(last, F.col("node") == F.col("_tally_node"), "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def kept_documents(df: DataFrame, words: int = 5) -> DataFrame:
    """The rows of df that stay: one of each component, that of the least id (null is the greatest), then the least text key."""
    found = written(similar_classes(df, words), "classes")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_key")).alias("w")).select("root", "w.doc_id", "w.text_key")
    best = written(best, "best")
    stay = written(found.join(best.select("root", F.col("doc_id").alias("_tally_id"), F.col("text_key").alias("_tally_key")), "root").where("doc_id <=> _tally_id and text_key = _tally_key").groupBy("_tally_id", "_tally_key").agg(F.count("*").alias("_tally_n")), "stay")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_tally_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_tally_key"))
    kept = df.join(stay.where("_tally_n = 1"), own).select(*df.columns)
    if stay.where("_tally_n > 1").isEmpty():
        return kept
    return kept.union(df.join(stay.where("_tally_n > 1"), own).dropDuplicates(["_tally_id", "_tally_key"]).select(*df.columns))
