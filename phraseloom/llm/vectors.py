"""Numpy helpers over Arrow batches of token lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of each value."""
    h = x.astype(np.uint64) + np.uint64((seed * int(_ODD) + 1) & 0xFFFFFFFFFFFFFFFF)
    h *= _ODD
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def rolling(h: np.ndarray, n: int, by: int = 0x100000001B3) -> np.ndarray:
    """A hash of each ``n`` consecutive values of ``h``; another multiplier gives an independent one."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out *= np.uint64(by)
        out += h[j : j + len(out)]
    return out


def token_lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat tokens of a list column (null: -1) and the rows' bounds in them; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(col.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each start of an ``n``-window over the flat values, whether the window lies within one row."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return row[: max(0, len(row) - n + 1)] == row[n - 1 :]
