"""Elias-Fano sets: ascending numbers as packed low bits and unary high bits, with payload bits beside.

Parquet's own encodings serve the tables; this is for chunks that leave them.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<IQBB")  # how many, the first, low bits, payload bits


def _pack(values: np.ndarray, bits: int) -> bytes:
    spread = (values.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def _unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 0:
        return np.zeros(n, np.uint64)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint64)


def encode(numbers: list[int], payload: list[int] | None = None) -> bytes:
    """Strictly ascending numbers, and a small payload for each."""
    if any(b <= a for a, b in zip(numbers, numbers[1:], strict=False)):
        raise ValueError("numbers must ascend")
    n, bits = len(numbers), max(payload or [0]).bit_length()
    if n == 0:
        return HEAD.pack(0, 0, 0, 0)
    offsets = np.array(numbers, np.uint64) - np.uint64(numbers[0])
    low = max(0, (int(offsets[-1]) // n).bit_length() - 1)
    high = (offsets >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(int(high[-1]) + n, np.uint8)
    unary[high + np.arange(n)] = 1
    parts = [_pack(offsets & np.uint64((1 << low) - 1), low), np.packbits(unary, bitorder="little").tobytes(), _pack(np.array(payload or [0] * n), bits)]
    return HEAD.pack(n, numbers[0], low, bits) + struct.pack("<II", len(parts[0]), len(parts[1])) + b"".join(parts)


def decode(raw: bytes) -> tuple[list[int], list[int]]:
    """Numbers and payloads; a chunk of another length than its head says is an error."""
    n, first, low, bits = HEAD.unpack_from(raw)
    if n == 0:
        return [], []
    a, b = struct.unpack_from("<II", raw, HEAD.size)
    at = HEAD.size + 8
    if len(raw) != at + a + b + (n * bits + 7) // 8 or a != (n * low + 7) // 8:
        raise ValueError("a chunk is damaged")
    places = np.flatnonzero(np.unpackbits(np.frombuffer(raw[at + a : at + a + b], np.uint8), bitorder="little"))
    if len(places) != n:
        raise ValueError("a chunk is damaged")
    high = (places - np.arange(n)).astype(np.uint64)
    numbers = (high << np.uint64(low)) + _unpack(raw[at : at + a], n, low) + np.uint64(first)
    return numbers.tolist(), _unpack(raw[at + a + b :], n, bits).tolist()
