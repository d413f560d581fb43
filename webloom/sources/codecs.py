"""Byte streams of archives: codec detection, members and frames, and content coding.

Gzip files may hold many members, LZ4 files many frames and Zstandard files many frames; a
record usually has one of its own, so positions are those of members in the compressed file.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa

try:
    import brotli
except ImportError:  # an optional codec; without it such bodies can't be decoded, which is an error or a null
    brotli = None

GZIP, LZ4, ZSTD, PLAIN, AUTO = "gzip", "lz4", "zstd", "uncompressed", "auto"
SUFFIX = {GZIP: ".gz", LZ4: ".lz4", ZSTD: ".zst", PLAIN: ""}
_CHUNK = 1 << 20
_FIRST = 1 << 14  # of a member; what is left of a piece is copied at each member's end, so pieces grow with members only


class StreamError(ValueError):
    """Bytes that aren't what the codec says."""


def codec_of_name(path: str) -> str:
    """By the file's name: .gz, .lz4, .zst or .warc; anything else is looked at."""
    low = path.lower()
    for codec, suffix in SUFFIX.items():
        if suffix and low.endswith(suffix):
            return codec
    return PLAIN if low.endswith(".warc") else AUTO


def codec_of_bytes(head: bytes) -> str:
    if head.startswith(b"\x1f\x8b"):
        return GZIP
    if head.startswith(b"\x04\x22\x4d\x18"):
        return LZ4
    if head.startswith(b"\x28\xb5\x2f\xfd"):
        return ZSTD
    if head.startswith(b"WARC/"):
        return PLAIN
    raise StreamError("not a valid archive stream")


def _members(f: io.BufferedIOBase, codec: str, piece: int | None) -> Iterator[tuple[int, bytes, bool | None]]:
    """Members of a gzip or frames of a Zstandard file; with ``piece``, longer ones in parts, all but the last with None."""
    if codec == GZIP:
        fresh, broken, padding = lambda: zlib.decompressobj(31), zlib.error, True
    else:
        import zstandard

        fresh, broken, padding = lambda: zstandard.ZstdDecompressor().decompressobj(), zstandard.ZstdError, False
    at, rest = 0, b""
    while True:
        more = min(_FIRST, _CHUNK)
        rest = rest or f.read(more)
        while padding and rest[:1] == b"\0":  # padding between members
            kept = rest.lstrip(b"\0")
            at, rest = at + len(rest) - len(kept), kept or f.read(_CHUNK)
        if not rest:
            return
        start, d, out, size = at, fresh(), [], 0
        while True:
            try:
                out.append(d.decompress(rest))
            except broken:
                yield start, b"".join(out), False
                return
            at += len(rest) - len(d.unused_data)
            rest = d.unused_data
            if d.eof:
                yield start, b"".join(out), True
                break
            size += len(out[-1])
            if piece is not None and size >= piece:
                yield start, b"".join(out), None
                out, size = [], 0
            more = min(2 * more, _CHUNK)
            rest = f.read(more)
            if not rest:
                yield start, b"".join(out), False
                return


def _lz4_frame_end(data: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, from its block sizes; -1 if it is cut off."""
    magic = data[at : at + 4]
    if magic[1:] == b"\x2a\x4d\x18" and 0x50 <= magic[0] <= 0x5F:  # a skippable frame
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0] if len(data) >= at + 8 else -1
    if magic != b"\x04\x22\x4d\x18":
        raise StreamError("not an LZ4 frame")
    if len(data) < at + 7:
        return -1
    flags = data[at + 4]
    at += 7 + 8 * bool(flags & 8) + 4 * bool(flags & 1)
    while True:
        if len(data) < at + 4:
            return -1
        size = struct.unpack_from("<I", data, at)[0]
        at += 4
        if size == 0:
            at += 4 * bool(flags & 4)
            return at if at <= len(data) else -1
        at += (size & 0x7FFFFFFF) + 4 * bool(flags & 16)


def _lz4_frames(f: io.BufferedIOBase) -> Iterator[tuple[int, bytes, bool]]:
    data, base, start, size = b"", 0, 0, min(_FIRST, _CHUNK)
    while True:
        more = f.read(size)
        data = data[start:] + more
        base, start, size = base + start, 0, min(2 * size, _CHUNK)
        while start < len(data):
            end = _lz4_frame_end(data, start)
            if end < 0 or end > len(data):
                break
            if data[start] == 0x04:
                yield base + start, pa.CompressedInputStream(pa.BufferReader(data[start:end]), "lz4").read(), True
            start = end
        if not more:
            if start < len(data):
                yield base + start, b"", False
            return


def members(f: io.BufferedIOBase, codec: str, piece: int | None = None) -> Iterator[tuple[int, bytes, bool | None]]:
    """(position in the file, decompressed bytes, whether it is whole) of each member of a compressed file.

    With ``piece``, a gzip member or Zstandard frame comes in parts of about that size, all but its last with None, so
    that a file of one member doesn't have to fit in memory.
    """
    return _lz4_frames(f) if codec == LZ4 else _members(f, codec, piece)


def compress(data: bytes, codec: str, level: int = 6) -> bytes:
    """One member or frame."""
    if codec == GZIP:
        return gzip.compress(data, level, mtime=0)
    if codec == ZSTD:
        import zstandard

        return zstandard.ZstdCompressor(level=3).compress(data)
    if codec == LZ4:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as out:
            out.write(data)
        return sink.getvalue().to_pybytes()
    return data


def inflate(data: bytes) -> bytes:
    """Deflated bytes with or without a zlib header; what can be read of damaged ones."""
    for bits in (15, -15):
        try:
            return zlib.decompressobj(bits).decompress(data)
        except zlib.error:
            continue
    raise StreamError("not deflated data")


def decode_content(data: bytes, codings: list[str]) -> bytes:
    """Undoes content codings, last one first: gzip, x-gzip, deflate, br; names of no coding are passed over."""
    for coding in reversed([c.strip().lower() for c in codings]):
        if coding in ("gzip", "x-gzip"):
            data = b"".join(x for _, x, _ in _members(io.BytesIO(data), GZIP, None))
        elif coding == "deflate":
            data = inflate(data)
        elif coding == "br":
            if brotli is None:
                raise StreamError("a br body, and no brotli module")
            data = brotli.decompress(data)
    return data
