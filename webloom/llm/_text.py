"""Vectorised tokenising and hashing of Arrow text columns.

A batch is handled as one byte buffer: word boundaries come from a byte mask and every word's
64-bit hash from one running polynomial, so there is no Python loop over words.  Words are
runs of bytes other than ASCII white space (space, \\t, \\n, \\v, \\f, \\r).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 17
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over an array."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, dtype=_U), np.full(size, _INV, dtype=_U)
        up[0] = down[0] = 1
        if size > 4 * _SEGMENT:  # one huge word: not worth keeping
            return np.cumprod(up), np.cumprod(down)
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if len(col) == 0 or off[-1] == off[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(col) + 1, dtype=np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def _bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words; a row's end ends its last word."""
    n = len(data)
    inside = ~_SPACE[data]
    edge, stop = np.empty(n + 1, dtype=bool), np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = inside[0], False
    np.logical_and(inside[1:], ~inside[:-1], out=edge[1:n])
    stop[0], stop[n] = False, inside[n - 1]
    np.logical_and(inside[:-1], ~inside[1:], out=stop[1:n])
    inner = off[(off > 0) & (off < n)]
    edge[inner], stop[inner] = inside[inner], inside[inner - 1]
    return np.flatnonzero(edge), np.flatnonzero(stop)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans ascend and don't overlap."""
    out = np.empty(len(starts), dtype=_U)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _SEGMENT, side="right")))
        b = ends[j - 1]
        up, down = _pow(int(b - a))
        run = np.empty(b - a + 1, dtype=_U)
        run[0] = 0
        np.cumsum((data[a:b].astype(_U) + _U(1)) * up[: b - a], out=run[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (run[e] - run[s]) * down[s]
        i = j
    return mix(out)


def words(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row), the latter with one more entry than rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    data, off = buffer(pc.utf8_lower(col) if lower else col)
    if len(data) == 0:
        return np.empty(0, dtype=_U), np.zeros(len(off), dtype=np.int64)
    starts, ends = _bounds(data, off)
    return span_hashes(data, starts, ends), np.searchsorted(starts, off).astype(np.int64)


def units(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first unit of each row): words with the white space before them.

    White space at a row's end is a unit too, so the units of a row make up its text.
    """
    data, off = buffer(col)
    if len(data) == 0:
        none = np.empty(0, dtype=np.int64)
        return data, none, none, np.zeros(len(off), dtype=np.int64)
    _, ends = _bounds(data, off)
    rows = off[np.flatnonzero(np.diff(off)) + 1]  # where a row that isn't empty ends
    at = np.minimum(np.searchsorted(ends, rows), max(len(ends) - 1, 0))
    open_ = ends[at] != rows if len(ends) else np.ones(len(rows), bool)
    ends = np.insert(ends, np.searchsorted(ends, rows[open_]), rows[open_])
    starts = np.concatenate([[0], ends[:-1]])
    return data, starts, ends, np.searchsorted(starts, off).astype(np.int64)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word n-gram, first n-gram of each row).

    A row of 1 to n - 1 words has one n-gram, of all its words; a row without words has none.
    """
    counts = np.diff(first)
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(grams)])
    padded = np.concatenate([hashes, np.zeros(n, dtype=_U)])
    row = np.repeat(np.arange(len(counts)), grams)
    at = first[:-1][row] + (np.arange(out_first[-1]) - out_first[:-1][row])
    left = first[1:][row] - at
    acc = np.zeros(len(at), dtype=_U)
    for j in range(n):
        w = padded[at + j]
        if j:
            w = np.where(left > j, w, _U(j))
        acc = mix(acc * _U(0x9DDFEA08EB382D69) + w + _U(j + 1))
    return acc, out_first


def byte_counts(col: pa.Array, tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each boolean table of 256 entries, how many bytes of each row it marks."""
    data, off = buffer(col)
    rows = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
    out = []
    for table in tables:
        marks = table[data]
        out.append(np.array([np.count_nonzero(marks[a:z]) for a, z in rows], dtype=np.int64))
    return out
