"""Keccak-256 (the padding before SHA-3), over whole Arrow batches in numpy.

The round constants come from the standard's shift register and the rotations from its
walk over the lanes, both computed here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 136


def _round_constants() -> list[int]:
    out, r = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if r & 1:
                value |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(value)
    return out


def _rotations() -> dict[tuple[int, int], int]:
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


ROUNDS, TURNS = _round_constants(), _rotations()


def _turn(lane: np.ndarray, by: int) -> np.ndarray:
    return lane if by == 0 else (lane << np.uint64(by)) | (lane >> np.uint64(64 - by))


def permute(a: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Keccak-f[1600] of a[x][y], lanes of a batch of states."""
    for constant in ROUNDS:
        columns = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        mixed = [columns[x - 1] ^ _turn(columns[(x + 1) % 5], 1) for x in range(5)]
        moved = [[None] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                moved[y][(2 * x + 3 * y) % 5] = _turn(a[x][y] ^ mixed[x], TURNS[x, y])
        a = [[moved[x][y] ^ (~moved[(x + 1) % 5][y] & moved[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        a[0][0] = a[0][0] ^ np.uint64(constant)
    return a


def digests(messages: list[bytes]) -> list[bytes]:
    """Digests of a batch; messages of equally many blocks are hashed together."""
    out: list[bytes] = [b""] * len(messages)
    groups: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        groups.setdefault(len(m) // RATE + 1, []).append(i)
    for blocks, rows in groups.items():
        padded = []
        for i in rows:
            raw = bytearray(messages[i] + b"\1" + b"\0" * (blocks * RATE - len(messages[i]) - 1))
            raw[-1] |= 0x80
            padded.append(bytes(raw))
        words = np.frombuffer(b"".join(padded), "<u8").reshape(len(rows), blocks, RATE // 8)
        state = [[np.zeros(len(rows), np.uint64) for _ in range(5)] for _ in range(5)]
        for b in range(blocks):
            for k in range(RATE // 8):
                state[k % 5][k // 5] = state[k % 5][k // 5] ^ words[:, b, k]
            state = permute(state)
        found = np.stack([state[k][0] for k in range(4)], axis=1).astype("<u8")
        for i, row in zip(rows, found, strict=True):
            out[i] = row.tobytes()
    return out


def digest(message: bytes) -> bytes:
    return digests([message])[0]


def _batch(raw: pd.Series) -> pd.Series:
    values = [None if r is None else bytes(r) for r in raw]
    got = iter(digests([v for v in values if v is not None]))
    return pd.Series([None if v is None else next(got) for v in values], dtype=object)


def keccak256(raw: Column) -> Column:
    """Of a binary column; null stays null."""
    return F.pandas_udf(_batch, "binary")(raw)
