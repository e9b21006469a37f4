"""The stored receipt form: variable-length numbers, then logs of address, topics and data."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import keccak, rlp


HASHED = 2048  # messages hashed at once, so that their states stay near the processor


def put(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def take(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("a number is cut off")
        byte = raw[at]
        n |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return n, at
        shift += 7


def pack(status: int, gas_used: int, cumulative: int, logs: list[tuple[bytes, list[bytes], bytes]]) -> bytes:
    out = put(status) + put(gas_used) + put(cumulative) + put(len(logs))
    for address, topics, data in logs:
        out += address + put(len(topics)) + b"".join(topics) + put(len(data)) + data
    return out


def unpack(raw: bytes) -> dict:
    at, head = 0, []
    for _ in range(4):
        n, at = take(raw, at)
        head.append(n)
    logs = []

    def cut(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise ValueError("a receipt is cut off")
        at += n
        return raw[at - n : at]

    for _ in range(head[3]):
        address = cut(20)
        n, at = take(raw, at)
        topics = [cut(32) for _ in range(n)]
        n, at = take(raw, at)
        logs.append({"address": address, "topics": topics, "data": cut(n)})
    if at != len(raw):
        raise ValueError("bytes after the receipt")
    return {"status": head[0], "gas_used": head[1], "cumulative": head[2], "logs": logs}


RECEIPT = "status long, gas_used long, cumulative long, logs array<struct<address:binary,topics:array<binary>,data:binary>>"


def decode_receipt(raw: Column | str) -> Column:
    """The fields of RECEIPT of a binary column; null stays null."""
    return F.pandas_udf(_receipts, RECEIPT)(raw)


def _receipts(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dict.fromkeys(("status", "gas_used", "cumulative", "logs")) if r is None else unpack(bytes(r)) for r in raw], columns=["status", "gas_used", "cumulative", "logs"])


def bloom(items: list[bytes]) -> bytes:
    """2048 bits, three of each item's hash: its first three pairs of bytes, eleven bits each."""
    bits = 0
    for h in keccak.digests(items):
        for i in (0, 2, 4):
            bits |= 1 << (int.from_bytes(h[i : i + 2], "big") & 2047)
    return bits.to_bytes(256, "big")


def encode_receipt(status: Column, gas_used: Column, cumulative: Column, address: Column, topics: Column) -> Column:
    """The stored form of a receipt with one log without data."""
    return F.pandas_udf(_encoded, "binary")(status, gas_used, cumulative, address, topics)


def _encoded(status: pd.Series, gas_used: pd.Series, cumulative: pd.Series, address: pd.Series, topics: pd.Series) -> pd.Series:
    return pd.Series([pack(int(s), int(g), int(c), [(bytes(a), [bytes(x) for x in t], b"")]) for s, g, c, a, t in zip(status, gas_used, cumulative, address, topics, strict=True)], dtype=object)


def blooms(items: DataFrame, key: str, item: str) -> DataFrame:
    """key and bloom of each key's items: distinct items are hashed once, bits are OR-ed word by word before and after the shuffle."""
    digests_of = items.select(F.col(item).cast("binary").alias("_item")).distinct().withColumn("_h", keccak.keccak256("_item"))
    number = lambda i: F.conv(F.hex(F.substring("_h", 2 * i + 1, 2)), 16, 10).cast("int").bitwiseAND(F.lit(2047))
    bits = digests_of.select("_item", F.explode(F.array_distinct(F.array(number(0), number(1), number(2)))).alias("_bit"))
    marked = items.join(bits, F.col(item).cast("binary") == F.col("_item")).select(key, F.floor(F.col("_bit") / 64).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit") % 64).alias("_mask"))
    words = [F.coalesce(F.bit_or(F.when(F.col("_word") == w, F.col("_mask"))), F.lit(0)).alias(f"w{w}") for w in range(32)]
    # the highest bit comes first
    return marked.groupBy(key).agg(*words).select(key, F.unhex(F.concat(*(F.lpad(F.hex(f"w{w}"), 16, "0") for w in reversed(range(32))))).alias("bloom"))


def root(values: list[bytes]) -> bytes:
    """Root of the Patricia trie that maps the encoded place of each value to it."""
    pairs = {rlp.encode(i): v for i, v in enumerate(values)}
    return trie_root(pairs)


def trie_root(pairs: dict[bytes, bytes]) -> bytes:
    if not pairs:
        return keccak.digest(rlp.encode(b""))
    nibbles = sorted((tuple(x for b in k for x in (b >> 4, b & 15)), v) for k, v in pairs.items())
    return keccak.digest(rlp.encode(_node(nibbles, 0)))


def roots(lists: list[list[bytes]]) -> list[bytes]:
    """`root` of each list; the nodes of all tries at one distance from their leaves are hashed together."""
    shapes: dict[int, list] = {}
    out: list[bytes] = [keccak.digest(rlp.encode(b""))] * len(lists)
    waiting: list[list[tuple[list, int, object]]] = []  # by level: where a node goes, and the node

    def plan(n: int):
        """The trie of n values: [level, kind, ...] with places of values in it, the same for every list of n."""
        if n not in shapes:
            keys = sorted((tuple(x for b in rlp.encode(i) for x in (b >> 4, b & 15)), i) for i in range(n))
            shapes[n] = _shape(keys, 0)
        return shapes[n]

    def put(shape, values: list[bytes], into: list, at: int) -> None:
        level, kind, own, below = shape
        while len(waiting) <= level:
            waiting.append([])
        if kind == "leaf":
            node = [own, values[below]]
        elif kind == "path":
            node = [own, b""]
            put(below, values, node, 1)
        else:
            node = [b""] * 17
            node[16] = b"" if own is None else values[own]
            for nibble, child in below:
                put(child, values, node, nibble)
        waiting[level].append((into, at, node))

    tops: list[list] = []
    for i, values in enumerate(lists):
        if values:
            top = [b"", i]
            tops.append(top)
            put(plan(len(values)), values, top, 0)
    heads = {id(t) for t in tops}
    for level in waiting:
        raws = [rlp.encode(node) for _, _, node in level]
        long = [k for k, raw in enumerate(raws) if len(raw) >= 32 or id(level[k][0]) in heads]
        got: dict[int, bytes] = {}
        for first in range(0, len(long), HASHED):
            some = long[first : first + HASHED]
            got |= zip(some, keccak.digests([raws[k] for k in some]), strict=True)
        for k, (into, at, node) in enumerate(level):
            into[at] = got.get(k, node)
    for digest, i in tops:
        out[i] = digest
    return out


def _shape(keys: list[tuple[tuple[int, ...], int]], at: int) -> list:
    """The level, kind, path or value, and children of the node of sorted keys that agree before nibble `at`."""
    if len(keys) == 1:
        return [0, "leaf", _compact(keys[0][0][at:], True), keys[0][1]]
    first, last = keys[0][0], keys[-1][0]
    same = at
    while same < min(len(first), len(last)) and first[same] == last[same]:
        same += 1
    if same > at:
        below = _shape(keys, same)
        return [below[0] + 1, "path", _compact(first[at:same], False), below]
    children = [(nibble, _shape(own, at + 1)) for nibble in range(16) if (own := [k for k in keys if len(k[0]) > at and k[0][at] == nibble])]
    return [1 + max(c[0] for _, c in children), "branch", next((v for k, v in keys if len(k) == at), None), children]


def subtrees(rows: DataFrame) -> DataFrame:
    """prefix (two nibbles) and node: what the trie of (key, value), keys hashed to one length, has below each prefix, a task a prefix."""
    nibble = lambda k: F.substring(F.lower(F.hex("key")), 1, k)

    def node(part: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted((tuple(x for b in bytes(k) for x in (b >> 4, b & 15)), bytes(v)) for k, v in zip(part["key"], part["value"], strict=True))
        return pd.DataFrame({"prefix": part["prefix"].head(1), "n": [len(pairs)], "node": [json.dumps(_plain(_link(_node(pairs, 2))))]})

    return rows.select("key", "value", nibble(2).alias("prefix")).groupBy("prefix").applyInPandas(node, "prefix string, n long, node string")


def _plain(node):
    return node.hex() if isinstance(node, bytes) else [_plain(x) for x in node]


def _read(node):
    return bytes.fromhex(node) if isinstance(node, str) else [_read(x) for x in node]


def state_root(rows: DataFrame, known: DataFrame | None = None, changed: list[str] | None = None) -> tuple[bytes, DataFrame]:
    """The root of (key, value), keys hashed to one length, and its subtrees.

    known, changed: subtrees from before and the prefixes that have changed since; only those
    are built again. The at most 256 subtrees are put together here. Where a first nibble has
    only one second nibble, the trie has no branch between them, and its rows are few unless
    keys aren't hashed: such tries are built whole.
    """
    from tallystone.sources.shared import written

    if known is None:
        own = subtrees(rows)
    else:
        again = rows.where(F.substring(F.lower(F.hex("key")), 1, 2).isin(changed or []))
        own = known.where(~F.col("prefix").isin(changed or [])).unionByName(subtrees(again))
    own = written(own, "subtrees")
    found = {r.prefix: _read(json.loads(r.node)) for r in own.collect()}  # 256 rows at most
    seconds: dict[int, list[int]] = {}
    for p in found:
        seconds.setdefault(int(p[0], 16), []).append(int(p[1], 16))
    if len(seconds) < 2 or any(len(s) < 2 for s in seconds.values()):
        return trie_root({bytes(r.key): bytes(r.value) for r in rows.collect()}), own
    top: list = [b""] * 17
    for a, some in seconds.items():
        branch: list = [b""] * 17
        for b in some:
            branch[b] = found[f"{a:x}{b:x}"]
        top[a] = _link(branch)
    return keccak.digest(rlp.encode(top)), own


def _compact(path: tuple[int, ...], leaf: bool) -> bytes:
    flag = 2 * leaf + len(path) % 2
    full = (flag, *path) if len(path) % 2 else (flag, 0, *path)
    return bytes(16 * a + b for a, b in zip(full[::2], full[1::2], strict=True))


def _link(node):
    raw = rlp.encode(node)
    return node if len(raw) < 32 else keccak.digest(raw)


def _node(rows: list[tuple[tuple[int, ...], bytes]], at: int):
    """The node of sorted rows that agree before nibble `at`."""
    if len(rows) == 1:
        return [_compact(rows[0][0][at:], True), rows[0][1]]
    first, last = rows[0][0], rows[-1][0]
    same = at
    while same < min(len(first), len(last)) and first[same] == last[same]:
        same += 1
    if same > at:
        return [_compact(first[at:same], False), _link(_node(rows, same))]
    branch: list = [b""] * 17
    for nibble in range(16):
        own = [r for r in rows if len(r[0]) > at and r[0][at] == nibble]
        if own:
            branch[nibble] = _link(_node(own, at + 1))
    branch[16] = next((v for k, v in rows if len(k) == at), b"")
    return branch
