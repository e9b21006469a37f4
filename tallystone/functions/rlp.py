"""Recursive length prefix: items are bytes or lists of items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(item) -> bytes:
    if isinstance(item, int):
        item = item.to_bytes((item.bit_length() + 7) // 8, "big")
    if isinstance(item, (bytes, bytearray)):
        return bytes(item) if len(item) == 1 and item[0] < 0x80 else _head(len(item), 0x80) + bytes(item)
    body = b"".join(encode(x) for x in item)
    return _head(len(body), 0xC0) + body


def _head(size: int, base: int) -> bytes:
    if size < 56:
        return bytes((base + size,))
    length = size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes((base + 55 + len(length),)) + length


def decode(raw: bytes):
    """The one item that raw is; anything left over, short or not canonical is an error."""
    item, at = _item(raw, 0)
    if at != len(raw):
        raise ValueError("bytes after the item")
    return item


def _item(raw: bytes, at: int):
    if at >= len(raw):
        raise ValueError("no item")
    lead = raw[at]
    if lead < 0x80:
        return raw[at : at + 1], at + 1
    nested, rest = lead >= 0xC0, lead - (0xC0 if lead >= 0xC0 else 0x80)
    at += 1
    if rest > 55:
        size = int.from_bytes(raw[at : at + rest - 55], "big")
        if size < 56 or raw[at] == 0:
            raise ValueError("a length isn't canonical")
        at += rest - 55
    else:
        size = rest
    end = at + size
    if end > len(raw):
        raise ValueError("an item is short")
    if not nested:
        if size == 1 and raw[at] < 0x80:
            raise ValueError("a byte isn't canonical")
        return raw[at:end], end
    out = []
    while at < end:
        item, at = _item(raw, at)
        if at > end:
            raise ValueError("an item leaves its list")
        out.append(item)
    return out, end


def _word(raw: bytes) -> bytes:
    return bytes(raw).rjust(32, b"\0")


TX = "type int, nonce long, gas long, gas_price binary, fee_cap binary, tip_cap binary, to binary, value binary, input binary"


def transaction(raw: bytes) -> dict:
    """Fields of a bare or typed transaction (types 0, 1 and 2)."""
    kind = raw[0] if raw[0] < 0x80 else 0
    fields = decode(raw[1:] if kind else raw)
    number = lambda b: int.from_bytes(b, "big")
    if kind == 0:
        nonce, price, gas, to, value, data = fields[:6]
        tip = cap = price
    elif kind == 1:
        _, nonce, price, gas, to, value, data = fields[:7]
        tip = cap = price
    elif kind == 2:
        _, nonce, tip, cap, gas, to, value, data = fields[:8]
        price = b""
    else:
        raise ValueError(f"transactions of type {kind} aren't known")
    return {"type": kind, "nonce": number(nonce), "gas": number(gas), "gas_price": None if kind == 2 else _word(price), "fee_cap": _word(cap), "tip_cap": _word(tip), "to": to or None, "value": _word(value), "input": data}


def decode_transaction(raw: Column | str) -> Column:
    """The fields of TX of a binary column; null stays null."""
    return F.pandas_udf(_transactions, TX)(raw)


def _transactions(raw: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in TX.split(", ")]
    return pd.DataFrame([dict.fromkeys(names) if r is None else transaction(bytes(r)) for r in raw], columns=names)


ACCOUNT = "nonce long, balance binary, root binary, code_hash binary"


def decode_account(raw: Column | str) -> Column:
    """The fields of ACCOUNT of account rows; an empty row (a deleted account) gives nulls."""
    return F.pandas_udf(_accounts, ACCOUNT)(raw)


def _accounts(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        if not r:
            rows.append((None, None, None, None))
            continue
        nonce, balance, root, code = decode(bytes(r))[:4]
        rows.append((int.from_bytes(nonce, "big"), _word(balance), root, code))
    return pd.DataFrame(rows, columns=["nonce", "balance", "root", "code_hash"])


HEADER = "parent_hash binary, height long, gas_limit long, gas_used long, base_fee long"


def header(raw: bytes) -> tuple:
    """Parent hash, number, gas limit, gas used and base fee (null before it came) of an encoded header."""
    fields = decode(raw)
    if len(fields) < 15:
        raise ValueError("a header has 15 fields or more")
    number = lambda b: int.from_bytes(b, "big")
    return fields[0], number(fields[8]), number(fields[9]), number(fields[10]), number(fields[15]) if len(fields) > 15 else None


def decode_header(raw: Column | str) -> Column:
    """The fields of HEADER of a binary column; null stays null."""
    return F.pandas_udf(_headers, HEADER)(raw)


def _headers(raw: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in HEADER.split(", ")]
    frame = pd.DataFrame([(None,) * 5 if r is None else header(bytes(r)) for r in raw], columns=names)
    return frame.astype({n: "Int64" for n in names[1:]})


def _encoded_headers(parent: pd.Series, height: pd.Series, limit: pd.Series, used: pd.Series, fee: pd.Series) -> pd.Series:
    """What isn't given is empty: the fields' places count."""
    return pd.Series([encode([bytes(p), *[b""] * 7, int(h), int(g), int(u), *[b""] * 4, int(f)]) for p, h, g, u, f in zip(parent, height, limit, used, fee, strict=True)], dtype=object)


def encode_header(parent: Column, height: Column, gas_limit: Column, gas_used: Column, base_fee: Column) -> Column:
    return F.pandas_udf(_encoded_headers, "binary")(parent, height, gas_limit, gas_used, base_fee)
