"""WARC archives: records from bytes, and bytes from records.

``read_records`` is the plain reader; ``webloom.sources.archive`` makes a Spark data source of it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from webloom.sources import codecs as C
from webloom.sources.codecs import PLAIN

TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation", "unknown")
_WS = b" \t\n\v\f\r"
_LONGEST = 8192
#: Decompressed bytes of a member that are held at once; a longer record is held whole.
_PIECE = 32 << 20

Headers = list[tuple[str, str]]


@dataclass
class Record:
    stream_pos: int
    version: str
    headers: Headers
    content_length: int = 0
    body: bytes | None = b""
    http_status_line: str | None = None
    http_headers: Headers | None = None
    http_block: bytes = b""
    filename: str = ""
    complete: bool = True

    @property
    def warc_type(self) -> str:
        low = (header(self.headers, "WARC-Type") or "").lower()
        return low if low in TYPES else "unknown"

    @property
    def is_http(self) -> bool:
        return first_header(self.headers, "Content-Type").startswith("application/http")

    @property
    def record_id(self) -> str | None:
        return header(self.headers, "WARC-Record-ID")

    @property
    def date(self) -> datetime | None:
        return iso_date(header(self.headers, "WARC-Date"))


def header(headers: Headers, name: str) -> str | None:
    """The last value of a header, whatever its case."""
    low = name.lower()
    return next((v for k, v in reversed(headers) if k.lower() == low), None)


def first_header(headers: Headers, name: str) -> str:
    low = name.lower()
    return next((v for k, v in headers if k.lower() == low), "")


def iso_date(text: str | None) -> datetime | None:
    try:
        when = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return when.astimezone(timezone.utc) if when.tzinfo else when.replace(tzinfo=timezone.utc)


def http_date(text: str | None) -> datetime | None:
    try:
        when = parsedate_to_datetime(text) if text else None
    except (TypeError, ValueError, IndexError):
        return None
    return when and (when.astimezone(timezone.utc) if when.tzinfo else when.replace(tzinfo=timezone.utc))


def _line(data: bytes, at: int, strict: bool) -> int:
    """Where the line at ``at`` ends, its end mark included."""
    end = data.find(b"\r\n" if strict else b"\n", at)
    end = len(data) if end < 0 else end + (2 if strict else 1)
    return min(end, at + _LONGEST)


def parse_headers(data: bytes, at: int, status: bool, strict: bool = True, charset: str = "utf-8") -> tuple[str | None, Headers, int]:
    """(status line, headers, position behind the blank line).

    A line that starts with white space continues the value before it, and so does a line without a colon.
    """
    out: list[list[bytes]] = []
    line_of_status: bytes | None = None
    while at < len(data):
        end = _line(data, at, strict)
        line, at = data[at:end], end
        if line == b"\r\n" or (line == b"\n" and not strict):
            break
        if line[:1].isspace():
            if out:
                out[-1][1] += b" " + line.strip(_WS)
        elif status and line_of_status is None:
            line_of_status = line.strip(_WS)
        elif b":" in line:
            k, _, v = line.partition(b":")
            out.append([k.strip(_WS), v.strip(_WS)])
        elif out:
            out[-1][1] += b" " + line.strip(_WS)
    named = [(k.decode(charset, "ignore"), v.decode(charset, "ignore")) for k, v in out]
    return (None if line_of_status is None else line_of_status.decode(charset, "ignore")), named, at


def _is_version(line: bytes) -> bool:
    return line in (b"WARC/1.0", b"WARC/1.1") or (line.startswith(b"WARC/0.") and len(line) <= 9)


def _length(headers: Headers) -> int | None:
    value = first_header(headers, "Content-Length")
    if not value:
        return None
    digits = ""
    for c in value.strip():
        if not c.isdigit():
            break
        digits += c
    return int(digits or 0)


def _scan(data: bytes, base: int, strict: bool, compressed: bool, fixed: bool) -> Iterator[tuple[Record, int, int]]:
    """(record without body, start, end of its body) of a decompressed run of bytes; ``fixed``: all are at ``base``."""
    at = 0
    while at < len(data):
        start = at
        end = _line(data, at, strict)
        line, at = data[at:end], end
        if line in (b"\r\n", b"\n"):
            continue
        line = line.strip(_WS)
        if not _is_version(line):
            if strict:
                return
            continue
        _, headers, at = parse_headers(data, at, False, strict)
        size = _length(headers)
        if size is None:
            size = len(data) - at if compressed and not strict else 0
        complete = at < len(data) or data[at - 4 : at].endswith((b"\n\r\n", b"\n\n"))
        yield Record(base if fixed else base + start, line.decode(), headers, size, complete=complete), at, at + size
        at += size


def split_http(r: Record, strict: bool = True) -> Record:
    """Takes the HTTP header block off a record's body; does nothing the second time."""
    if r.http_headers is None and r.is_http and r.body is not None:
        status, headers, at = parse_headers(r.body, 0, True, strict, "iso8859-15")
        r.http_block, r.body = r.body[:at], r.body[at:]
        r.http_status_line, r.http_headers, r.content_length = status or "", headers, max(0, r.content_length - at)
    return r


def read_records(
    f: io.BufferedIOBase,
    codec: str = C.AUTO,
    record_types: list[str] | None = None,
    parse_http: bool = True,
    min_content_length: int | None = None,
    max_content_length: int | None = None,
    func_filter=None,
    verify_digests: bool = False,
    strict: bool = True,
    auto_decode: str = "none",
    with_body: bool = True,
    keep_meta: bool = False,
    invalid: str = "eof",
    start: int = 0,
    end: int | None = None,
) -> Iterator[Record]:
    """The records of a file that start in [start, end), filtered by their headers before anything is parsed.

    In strict mode, lines end in CRLF and anything that isn't a record ends the file; otherwise bare
    LF is allowed and junk is skipped.  With ``invalid`` "error", what would end a file in strict mode is an error instead:
    junk, a header that the file's end cuts off, a body shorter than its length, a damaged or cut-off member.
    With ``keep_meta``, records longer than the limit stay, with an empty body and their length.
    """
    if invalid not in ("eof", "error"):
        raise ValueError("invalid must be eof or error")
    severe = strict and invalid == "error"
    if codec == C.AUTO:
        head = f.read(8)
        f.seek(0)
        if not head:
            return
        codec = C.codec_of_bytes(head) if strict or head[:2] == b"\x1f\x8b" or head[:4] in (b"\x04\x22\x4d\x18", b"\x28\xb5\x2f\xfd") else PLAIN
    wanted = None if record_types is None else {t.lower() for t in record_types}

    def fine(r: Record) -> bool:
        if wanted is not None and r.warc_type not in wanted:
            return False
        if (long(r) and not keep_meta) or (min_content_length is not None and r.content_length < min_content_length):
            return False
        return func_filter is None or bool(func_filter(r))

    def long(r: Record) -> bool:
        return max_content_length is not None and r.content_length > max_content_length

    def finish(r: Record, body: bytes | None) -> Record | None:
        """The record with its body; without one for a record that is kept for its header."""
        if body is None:
            r.body = b""
            return r
        if severe and len(body) < r.content_length:
            raise C.StreamError(f"the record at {r.stream_pos} is cut off")
        r.body = body
        if verify_digests and not verify_block_digest(r):
            return None
        if parse_http:
            split_http(r, strict)
            if auto_decode != "none" and r.http_headers is not None:
                try:
                    r.body = C.decode_content(r.body, codings(r.http_headers, auto_decode))
                except C.StreamError:
                    if severe:
                        raise
                    r.body = None  # a body that can't be decoded isn't passed off as a decoded one
        if not with_body:
            r.body = None
        return r

    if codec != PLAIN:
        if start:
            f.seek(start)
        data, held, found = b"", None, False
        for pos, piece, whole in C.members(f, codec, _PIECE):
            if end is not None and start + pos >= end:
                return
            if held == pos:
                data += piece
            else:
                data, found = piece, False
            held = pos
            used, more = 0, False
            for r, a, z in _scan(data, start + pos, strict, True, True):
                if whole is None and z >= len(data):  # the rest comes with the next piece
                    more = True
                    break
                found, used = True, z
                if severe and not r.complete:
                    raise C.StreamError(f"the header at {start + pos} is cut off")
                if fine(r) and (r := finish(r, None if long(r) else data[a:z])) is not None:
                    yield r
            data = data[used:]
            junk = bool(data.strip(_WS)) and (whole is not None or (not more and len(data) > 2 * _LONGEST))
            if severe and (junk or whole is False):
                raise C.StreamError(f"no record at {start + pos}" if junk else f"the member at {start + pos} is damaged")
            if strict and junk and not (found and whole is not None):
                return
        return
    yield from _plain(f, fine, finish, long, strict, severe, start, end)


def _plain(f: io.BufferedIOBase, fine, finish, long, strict: bool, severe: bool, start: int, end: int | None) -> Iterator[Record]:
    """Streams an uncompressed file: bodies that aren't wanted are skipped, not read."""
    if start:
        f.seek(start)
    at = start
    if start:  # a split starts at the first version line in it
        at = _next_version(f, start)
        if at is None:
            return
        f.seek(at)
    while True:
        if end is not None and at >= end:
            return
        pos, line = at, f.readline(_LONGEST)
        if not line:
            return
        at += len(line)
        if line in (b"\r\n", b"\n"):
            continue
        version = line.strip(_WS)
        if not _is_version(version) or (strict and not line.endswith(b"\r\n")):
            if severe:
                raise C.StreamError(f"no record at {pos}")
            if strict:
                return
            continue
        block, done = [], False
        while line := f.readline(_LONGEST):
            at += len(line)
            block.append(line)
            if line == b"\r\n" or (line == b"\n" and not strict):
                done = True
                break
        if severe and not done:
            raise C.StreamError(f"the header at {pos} is cut off")
        _, headers, _ = parse_headers(b"".join(block), 0, False, strict)
        size = _length(headers) or 0
        r = Record(pos, version.decode(), headers, size)
        wanted = fine(r)
        if wanted and not long(r):
            body = f.read(size)
            at += size
            if len(body) < size:
                f.seek(at)
            if (r := finish(r, body)) is not None:
                yield r
        else:
            at += size
            f.seek(at)
            if wanted:
                yield finish(r, None)


def _next_version(f: io.BufferedIOBase, start: int) -> int | None:
    """The first position from ``start`` on where a record may begin: a version line behind a blank line."""
    back = max(0, start - 2)
    f.seek(back)
    base, data = back, b""
    while True:
        more = f.read(1 << 20)
        data += more
        at = -1
        while (at := data.find(b"\nWARC/", at + 1)) >= 0:
            stop = data.find(b"\n", at + 1)
            if stop < 0:
                break
            if base + at + 1 >= start and _is_version(data[at + 1 : stop].strip(_WS)) and (data[max(0, at - 1) : at] in (b"\n", b"\r")):
                return base + at + 1
        if not more:
            return None
        keep = min(len(data), 64)
        base, data = base + len(data) - keep, data[-keep:]


# HTTP accessors


def codings(headers: Headers, which: str = "all") -> list[str]:
    """Content codings in the order they were applied; ``which``: content, transfer or all."""
    out: list[str] = []
    for name, on in (("Content-Encoding", which in ("all", "content")), ("Transfer-Encoding", which in ("all", "transfer"))):
        value = first_header(headers, name)
        out += [c.strip() for c in value.split(",") if c.strip()] if on else []
    return out


def status_code(line: str | None) -> int | None:
    parts = (line or "").split(" ", 2)
    return int(parts[1]) if parts[0].startswith("HTTP/") and len(parts) > 1 and parts[1].isascii() and parts[1].isdigit() else None


def reason_phrase(line: str | None) -> str | None:
    """The first word of the reason."""
    parts = (line or "").split(" ", 3)
    return parts[2] if status_code(line) is not None and len(parts) > 2 else None


def content_type(headers: Headers) -> str | None:
    value = header(headers, "Content-Type")
    return None if value is None else value.partition(";")[0].strip()


def charset(headers: Headers) -> str | None:
    import codecs

    _, semi, rest = (header(headers, "Content-Type") or "").partition(";")
    at = rest.find("charset=")
    if not semi or at < 0:
        return None
    name = rest[at + 8 :].partition(";")[0].strip().lower()
    try:
        codecs.lookup(name)
    except (LookupError, ValueError):
        return None
    return name


def dechunk(data: bytes) -> bytes:
    """The contents of a chunked body, as far as they are whole."""
    return b"".join(http_chunks(data))


def http_chunks(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n", at)
        if end < 0:
            return
        try:
            size = int(data[at:end].partition(b";")[0].strip() or b"0", 16)
        except ValueError:
            return
        if size <= 0:
            return
        yield data[end + 2 : end + 2 + size]
        at = end + 2 + size + 2


# Digests


def digest(data: bytes, algorithm: str = "sha1") -> str:
    return f"{algorithm}:{base64.b32encode(hashlib.new(algorithm, data).digest()).decode()}"


def digest_error(data: bytes, text: str | None) -> str | None:
    """What is wrong with "algorithm:value" as the data's digest, or None; the value is base32, or else hexadecimal."""
    if not text:
        return "missing"
    name, colon, value = text.partition(":")
    if not colon or not value:
        return "malformed"
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return "unknown algorithm"
    want, read = hashlib.new(name, data).digest(), 0
    for decode in (base64.b32decode, bytes.fromhex):
        try:
            got = decode(value)
        except ValueError:
            continue
        if got == want:
            return None
        read += len(got) == len(want)
    return "mismatch" if read else "bad encoding"


def verify_digest(data: bytes, text: str) -> bool:
    return digest_error(data, text) is None


def verify_block_digest(r: Record) -> bool:
    return verify_digest(r.http_block + (r.body or b""), first_header(r.headers, "WARC-Block-Digest"))


def verify_payload_digest(r: Record) -> bool:
    return r.http_headers is not None and verify_digest(r.body or b"", first_header(r.headers, "WARC-Payload-Digest"))


# Writing


def new_record(warc_type: str, body: bytes, headers: Headers | None = None, when: datetime | None = None, http: bool = False) -> Record:
    """A record with the headers that every record needs; given ones win."""
    when = (when or datetime.now(timezone.utc)).astimezone(timezone.utc)
    basic = {"WARC-Type": warc_type, "WARC-Date": when.isoformat(timespec="seconds").replace("+00:00", "Z"), "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>"}
    if http:
        basic["Content-Type"] = f"application/http; msgtype={warc_type}"
    own = {k.lower() for k, _ in headers or []}
    merged = [(k, v) for k, v in basic.items() if k.lower() not in own] + list(headers or [])
    return Record(0, "WARC/1.1", merged, len(body), body)


def _clean(text: str) -> bytes:
    return " ".join(text.split("\n")).replace("\r", "").strip().encode()


def serialise(r: Record, checksum: bool = False) -> bytes:
    """The record's bytes; its length, and digests if wanted, are those of the body as it is."""
    block = r.http_block
    if r.http_headers is not None and not block:
        lines = [r.http_status_line or "", *(f"{k}: {v}" for k, v in r.http_headers)]
        block = ("\r\n".join(lines) + "\r\n\r\n").encode("iso8859-15", "replace")
    payload = r.body or b""
    set_ = {"content-length": ("Content-Length", str(len(block) + len(payload)))}
    if checksum:
        set_["warc-block-digest"] = ("WARC-Block-Digest", digest(block + payload))
        if r.http_headers is not None:
            set_["warc-payload-digest"] = ("WARC-Payload-Digest", digest(payload))
    out = [r.version.encode()]
    for k, v in r.headers:
        name, value = set_.pop(k.lower(), (k, v))
        out.append(_clean(k) + b": " + _clean(value))
    out += [k.encode() + b": " + v.encode() for k, v in set_.values()]
    return b"\r\n".join(out) + b"\r\n\r\n" + block + payload + b"\r\n\r\n"
