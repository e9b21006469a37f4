"""A block's container: header, consensus wrapper and transactions, split and put together byte for byte."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions.receipts import put, take


def pack(header: bytes, wrapper: bytes, txs: list[bytes]) -> bytes:
    return b"".join(put(len(x)) + x for x in (header, wrapper)) + put(len(txs)) + b"".join(put(len(t)) + t for t in txs)


def unpack(raw: bytes) -> tuple[bytes, bytes, list[bytes]]:
    at = 0

    def piece() -> bytes:
        nonlocal at
        n, at = take(raw, at)
        if at + n > len(raw):
            raise ValueError("a container is cut off")
        at += n
        return raw[at - n : at]

    header, wrapper = piece(), piece()
    n, at = take(raw, at)
    txs = [piece() for _ in range(n)]
    if at != len(raw):
        raise ValueError("bytes after the container")
    return header, wrapper, txs


PARTS = "header binary, wrapper binary, txs array<binary>"


def _packed(header: pd.Series, wrapper: pd.Series, txs: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or w is None or t is None else pack(bytes(h), bytes(w), [bytes(x) for x in t]) for h, w, t in zip(header, wrapper, txs, strict=True)], dtype=object)


def packed(header: Column | str, wrapper: Column | str, txs: Column | str) -> Column:
    """The container of a header, a wrapper and a list of transactions; null if one of them is."""
    return F.pandas_udf(_packed, "binary")(header, wrapper, txs)


def _parts(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        try:
            rows.append((None, None, None) if r is None else unpack(bytes(r)))
        except ValueError:
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["header", "wrapper", "txs"])


def parts(raw: Column | str) -> Column:
    """The fields of PARTS of a container; nulls of a null or damaged one."""
    return F.pandas_udf(_parts, PARTS)(raw)
