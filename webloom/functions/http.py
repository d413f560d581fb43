"""Column functions over HTTP messages: headers, chunks, content coding, digests.  A null gives null."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.sources import codecs as C
from webloom.sources import warc as W

_PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
_MESSAGE = T.StructType(
    [
        T.StructField("status_line", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("headers", _PAIRS),
        T.StructField("content_type", T.StringType()), T.StructField("charset", T.StringType()), T.StructField("date", T.TimestampType()), T.StructField("last_modified", T.TimestampType()), T.StructField("body", T.BinaryType()),
    ]
)
_ARROW = pa.struct(
    [
        ("status_line", pa.string()), ("status", pa.int32()), ("reason", pa.string()), ("headers", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))),
        ("content_type", pa.string()), ("charset", pa.string()), ("date", pa.timestamp("us", "UTC")), ("last_modified", pa.timestamp("us", "UTC")), ("body", pa.binary()),
    ]
)


def _col(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("binary")


def _each(f: Callable, kind: str | T.DataType, arrow: pa.DataType) -> Callable[..., Column]:
    @F.arrow_udf(kind)
    def run(*cols: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else f(*row) for row in zip(*(c.to_pylist() for c in cols), strict=True)], arrow)

    return run


def message(data: bytes, strict: bool = True) -> dict:
    status, headers, at = W.parse_headers(data, 0, True, strict, "iso8859-15")
    return {
        "status_line": status, "status": W.status_code(status), "reason": W.reason_phrase(status), "headers": [{"key": k, "value": v} for k, v in headers], "content_type": W.content_type(headers),
        "charset": W.charset(headers), "date": W.http_date(W.header(headers, "Date")), "last_modified": W.http_date(W.header(headers, "Last-Modified")), "body": data[at:],
    }


def parse_http(body: str | Column, strict: bool = True) -> Column:
    """struct(status_line, status, reason, headers, content_type, charset, date, last_modified, body)."""
    return _each(lambda b: message(b, strict), _MESSAGE, _ARROW)(_col(body))


def dechunk(body: str | Column) -> Column:
    return _each(W.dechunk, "binary", pa.binary())(_col(body))


def http_chunks(body: str | Column) -> Column:
    """array<binary> of the chunks."""
    return _each(lambda b: list(W.http_chunks(b)), "array<binary>", pa.list_(pa.binary()))(_col(body))


def decode_content(body: str | Column, content: str | Column, transfer: str | Column = "") -> Column:
    """Undoes the codings that Content-Encoding and Transfer-Encoding name; literal strings are header values.

    A body that isn't what they say, or br without its module, gives null.
    """
    heads = [F.lit(x) if isinstance(x, str) else x for x in (content, transfer)]

    def decoded(b: bytes, c: str | None, t: str | None) -> bytes | None:
        try:
            return C.decode_content(b, [x for v in (c, t) for x in (v or "").split(",") if x.strip()])
        except C.StreamError:
            return None

    return _each(decoded, "binary", pa.binary())(_col(body), *heads)


def digest(body: str | Column, algorithm: str = "sha1") -> Column:
    """ "algorithm:base32" of a body."""
    return _each(lambda b: W.digest(b, algorithm), "string", pa.string())(_col(body))


def gzipped(body: str | Column) -> Column:
    return _each(lambda b: C.compress(b, C.GZIP), "binary", pa.binary())(_col(body))
