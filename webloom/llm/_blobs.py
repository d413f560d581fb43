"""Sorted integer arrays as compact bytes, for exchanges of many hashes in few rows."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values; 4 bytes each unless a gap is wider."""
    gaps = np.diff(values, prepend=_U(0))
    narrow = len(gaps) == 0 or int(gaps[1:].max(initial=0)) < 1 << 32
    head = np.array([len(values), int(narrow), int(values[0]) if len(values) else 0], dtype=_U).tobytes()
    return head + (gaps[1:].astype(np.uint32) if narrow else gaps[1:]).tobytes()


def unpack_sorted(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    """(values, position behind them)."""
    n, narrow, least = (int(x) for x in np.frombuffer(raw, dtype=_U, count=3, offset=at))
    at += 24
    if n == 0:
        return np.empty(0, dtype=_U), at
    kind = np.uint32 if narrow else _U
    gaps = np.frombuffer(raw, dtype=kind, count=n - 1, offset=at)
    out = np.empty(n, dtype=_U)
    out[0] = least
    np.cumsum(gaps, dtype=_U, out=out[1:])
    out[1:] += _U(least)
    return out, at + gaps.nbytes


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest of 1, 2, 4 or 8 bytes."""
    most = int(values.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return np.array([len(values), np.dtype(kind).itemsize], dtype=_U).tobytes() + values.astype(kind).tobytes()


def unpack_small(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = (int(x) for x in np.frombuffer(raw, dtype=_U, count=2, offset=at))
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[width]
    return np.frombuffer(raw, dtype=kind, count=n, offset=at + 16), at + 16 + n * width
