"""Web archives as Spark tables: the data source ``warc``, its writer, offset indexes and checks.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").option("record_types", "response").load("/data/*.warc.gz")
    df.write.format("warc").option("compression", "gzip").mode("append").save("/out")

A plain file is read in ranges of ``split_bytes``; a compressed one is one task, and one file's
records stream through it in Arrow batches.  The options record_types, min_content_length and
max_content_length make the reader skip bodies without parsing them; with pushdown=true it takes
such filters from the query, which suits a DataFrame that is used once: Spark keeps a reader's
filters for all later uses of the same DataFrame.

Further options: always_keep_meta (records over max_content_length stay, with an empty body), invalid_header (eof, or
error for damaged archives in strict mode), retries (how often in a row a file is opened again behind the last
record after a read error), shuffle_files and seed (tasks in a random order), func_filter (module:function, which gets a
record's headers).
"""

from __future__ import annotations

import fnmatch
import importlib
import io
import itertools
import posixpath
import random
import re
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, WriterCommitMessage

from webloom.functions import guards as G
from webloom.functions.guards import retrying
from webloom.session import prepare
from webloom.sources import codecs as C
from webloom.sources import warc as W

_PAIR = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()), T.StructField("stream_pos", T.LongType()), T.StructField("warc_version", T.StringType()), T.StructField("record_id", T.StringType()),
        T.StructField("warc_type", T.StringType()), T.StructField("warc_date", T.TimestampType()), T.StructField("headers", _PAIR), T.StructField("content_length", T.LongType()),
        T.StructField("is_http", T.BooleanType()), T.StructField("http_status_line", T.StringType()), T.StructField("http_status", T.IntegerType()), T.StructField("http_reason", T.StringType()),
        T.StructField("http_headers", _PAIR), T.StructField("http_content_type", T.StringType()), T.StructField("http_charset", T.StringType()), T.StructField("http_date", T.TimestampType()),
        T.StructField("http_last_modified", T.TimestampType()), T.StructField("body", T.BinaryType()),
    ]
)
_ARROW_PAIR = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_ARROW = pa.schema(
    [
        ("filename", pa.string()), ("stream_pos", pa.int64()), ("warc_version", pa.string()), ("record_id", pa.string()), ("warc_type", pa.string()), ("warc_date", pa.timestamp("us", "UTC")),
        ("headers", _ARROW_PAIR), ("content_length", pa.int64()), ("is_http", pa.bool_()), ("http_status_line", pa.string()), ("http_status", pa.int32()), ("http_reason", pa.string()),
        ("http_headers", _ARROW_PAIR), ("http_content_type", pa.string()), ("http_charset", pa.string()), ("http_date", pa.timestamp("us", "UTC")), ("http_last_modified", pa.timestamp("us", "UTC")), ("body", pa.binary()),
    ]
)
_BATCH_ROWS, _BATCH_BYTES = 1000, 16 << 20


def row_of(r: W.Record) -> tuple:
    """A record's values in the order of the columns."""
    http, line = r.http_headers, r.http_status_line
    head = (r.filename, r.stream_pos, r.version, r.record_id, r.warc_type, r.date, r.headers, r.content_length, r.is_http, line, W.status_code(line), W.reason_phrase(line))
    if http is None:
        return (*head, None, None, None, None, None, r.body)
    dates = [W.http_date(W.header(http, n)) for n in ("Date", "Last-Modified")]
    return (*head, http, W.content_type(http), W.charset(http), *dates, r.body)


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() in ("true", "1", "yes")


def _named(path: str):
    """The function that "module:function" names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def reader_options(options: dict) -> dict:
    """Keyword arguments of ``read_records`` from string options."""
    low = {k.lower(): v for k, v in options.items()}
    number = lambda n: int(low[n]) if low.get(n) not in (None, "") else None
    return {
        "codec": low.get("compression", C.AUTO),
        "record_types": [t.strip() for t in low["record_types"].split(",")] if low.get("record_types") else None,
        "parse_http": _flag(low, "parse_http", True), "min_content_length": number("min_content_length"), "max_content_length": number("max_content_length"),
        "verify_digests": _flag(low, "verify_digests", False), "strict": _flag(low, "strict", True), "auto_decode": low.get("auto_decode", "none"), "with_body": _flag(low, "body", True),
        "keep_meta": _flag(low, "always_keep_meta", False), "invalid": low.get("invalid_header", "eof"), "retries": number("retries") or 0,
        "func_filter": _named(low["func_filter"]) if low.get("func_filter") else None,
    }


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"\w+:", path) else (pa.fs.LocalFileSystem(), path)


def open_file(path: str):
    fs, inner = file_system(path)
    return fs.open_input_file(inner)


def list_files(pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that match a path, folder or glob."""
    scheme = re.match(r"\w+:", pattern)
    prefix = re.match(r"[^*?\[]*", pattern)[0]
    base = pattern if prefix == pattern else posixpath.dirname(prefix)
    fs, inner = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", base)) if scheme else (pa.fs.LocalFileSystem(), base or ".")
    info = fs.get_file_info(inner)
    found = [info] if info.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(inner, recursive=True, allow_not_found=True))
    want = None if prefix == pattern else re.sub(r"^\w+:/*(?=/)", "", pattern)
    out = []
    for f in found:
        name = posixpath.basename(f.path)
        if f.type != pa.fs.FileType.File or name.startswith((".", "_")):
            continue
        if want is None or fnmatch.fnmatch(f.path, want) or fnmatch.fnmatch("/" + f.path, want):
            out.append((f"{scheme[0]}//{'/' if not f.path.startswith('/') else ''}{f.path}" if scheme and scheme[0] == "file:" else f.path if not scheme else f"{scheme[0]}//{f.path}", f.size))
    return sorted(out)


def splits(files: list[tuple[str, int]], size: int, codec: str = C.AUTO) -> list[tuple[str, int, int | None]]:
    """(path, start, end) of read tasks; only plain files are cut."""
    out: list[tuple[str, int, int | None]] = []
    for path, length in files:
        known = codec if codec != C.AUTO else C.codec_of_name(path)
        if known != C.PLAIN or length <= size:
            out.append((path, 0, None))
        else:
            out += [(path, a, min(a + size, length)) for a in range(0, length, size)]
    return out


def records(path: str, start: int = 0, end: int | None = None, retries: int = 0, **options) -> Iterator[W.Record]:
    """The records of a task; after a read error the file is opened again behind the last record, up to ``retries`` times in a row."""

    def open_at(pos: int) -> Iterator[W.Record]:
        with open_file(path) as f:
            yield from W.read_records(f if isinstance(f, io.BufferedReader) else io.BufferedReader(f, 1 << 16), start=pos, end=end, **options)

    return retrying(open_at, lambda r: r.stream_pos, retries, start) if retries else open_at(start)


def batches(path: str, start: int, end: int | None, **options) -> Iterator[pa.RecordBatch]:
    """The records of one task as Arrow batches of bounded size."""
    if options.get("codec", C.AUTO) == C.AUTO:
        options["codec"] = C.codec_of_name(path)
    rows, size = [], 0
    for r in records(path, start, end, **options):
        r.filename = path
        rows.append(row_of(r))
        size += len(r.body or b"") + 500
        if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.args = dict(options), reader_options(options)

    def partitions(self):
        files = [f for p in self.options["path"].split(",") for f in list_files(p.strip())]
        found = [_Range(*s) for s in splits(files, int(self.options.get("split_bytes", 128 << 20)), self.args["codec"])] or [_Range("", 0, 0)]
        if _flag(self.options, "shuffle_files", False):
            random.Random(int(self.options.get("seed", 0))).shuffle(found)
        return found

    def read(self, partition):
        if partition.path:
            yield from batches(partition.path, partition.start, partition.end, **self.args)


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        for f in filters:
            name = tuple(getattr(f, "attribute", ()))
            if isinstance(f, (EqualTo, In)) and name == ("warc_type",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                have = self.args["record_types"]
                self.args["record_types"] = sorted(values if have is None else values & {x.lower() for x in have}) or ["-"]
            elif isinstance(f, (GreaterThanOrEqual, LessThanOrEqual)) and name == ("content_length",) and not self.args["parse_http"]:
                # with parsed HTTP the column is the length of what follows the header block
                key, pick = ("min_content_length", max) if isinstance(f, GreaterThanOrEqual) else ("max_content_length", min)
                self.args[key] = f.value if self.args[key] is None else pick(self.args[key], f.value)
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    files: list


def record_from(row: dict) -> W.Record:
    """A record to write from a row that has at least warc_type and body."""
    pairs = lambda hs: None if hs is None else [(p["key"], p["value"]) for p in hs]
    r = W.new_record(row.get("warc_type") or "unknown", row.get("body") or b"", pairs(row.get("headers")), row.get("warc_date"), bool(row.get("is_http")))
    r.version = row.get("warc_version") or r.version
    if row.get("http_headers") is not None:
        r.http_status_line, r.http_headers = row.get("http_status_line") or "", pairs(row["http_headers"])
    return r


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.codec = options["path"], options.get("compression", C.GZIP)
        self.checksum, self.overwrite = _flag(options, "checksum", False), overwrite
        self.tmp = f"_tmp-{uuid.uuid4().hex}"  # of this job; others may write to the same path meanwhile

    def _fs(self):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.path)) if re.match(r"\w+:", self.path) else (pa.fs.LocalFileSystem(), self.path)

    def write(self, iterator):
        fs, base = self._fs()
        name = f"part-{uuid.uuid4().hex}.warc{C.SUFFIX[self.codec]}"
        fs.create_dir(f"{base}/{self.tmp}", recursive=True)
        n = 0
        with fs.open_output_stream(f"{base}/{self.tmp}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(C.compress(W.serialise(record_from(row), self.checksum), self.codec))
                    n += 1
        return _Written([name] if n else [])

    def commit(self, messages):
        fs, base = self._fs()
        old = [f.path for f in fs.get_file_info(pa.fs.FileSelector(base, allow_not_found=True)) if f.type == pa.fs.FileType.File] if self.overwrite else []
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{base}/{self.tmp}/{name}", f"{base}/{name}")
        for path in old:  # only once the new files are in place
            fs.delete_file(path)
        self.abort(messages)

    def abort(self, messages):
        fs, base = self._fs()
        if fs.get_file_info(f"{base}/{self.tmp}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.tmp}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (_PushingReader if _flag(self.options, "pushdown", False) else _Reader)(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes ``warc`` a format of the session, with filters pushed down."""
    # planning runs in workers that don't get the session's Python path, so these modules travel with the source
    for module in (sys.modules[__name__], C, W, G):
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return prepare(spark)


def read_files(files: DataFrame, **options) -> DataFrame:
    """Records of a table of files (path, and start and end if ranges are wanted), one task for each Arrow batch of files."""
    args = {**reader_options({}), **options}
    cols = ["path", *(F.lit(None).cast("long").alias(c) if c not in files.columns else c for c in ("start", "end"))]

    def read(parts):
        for b in parts:
            for row in b.to_pylist():
                if row["path"] is not None:
                    yield from batches(row["path"], row["start"] or 0, row["end"], **args)

    prepare(files.sparkSession)
    return files.select(*cols).mapInArrow(read, SCHEMA)


def match_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length) of the files that match, dealt out evenly."""
    rows = list_files(pattern)
    return spark.createDataFrame(rows, "path string, length long").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))


def header_value(name: str, headers: str | Column = "headers", which: str = "last") -> Column:
    """A header's value, natively: the last (default) or first match, or an array of all."""
    col = F.col(headers) if isinstance(headers, str) else headers
    found = F.transform(F.filter(col, lambda h: F.lower(h["key"]) == name.lower()), lambda h: h["value"])
    return found if which == "all" else F.try_element_at(found, F.lit(-1 if which == "last" else 1))


def with_header(name: str, value: str | Column, headers: str | Column = "headers") -> Column:
    """The headers with the first match overwritten, or the value appended."""
    col = F.col(headers) if isinstance(headers, str) else headers
    new = F.struct(F.lit(name).alias("key"), (F.lit(value) if isinstance(value, str) else value).alias("value"))
    at = F.array_position(F.transform(col, lambda h: F.lower(h["key"])), name.lower())
    put = F.transform(col, lambda h, i: F.when(i + 1 == at, F.struct(h["key"].alias("key"), new["value"].alias("value"))).otherwise(h))
    return F.when(at > 0, put).otherwise(F.concat(col, F.array(new)))


def with_appended(name: str | Column, value: str | Column, headers: str | Column = "headers") -> Column:
    """The headers with one more at the end; line breaks become spaces and a name loses its colons."""
    col = F.col(headers) if isinstance(headers, str) else headers
    key, val = (F.lit(x) if isinstance(x, str) else x for x in (name, value))
    one_line = lambda c: F.trim(F.regexp_replace(c, r"[\r\n]+", " "))
    return F.concat(col, F.array(F.struct(one_line(F.replace(key, F.lit(":"))).alias("key"), one_line(val).alias("value"))))


def without_header(name: str, headers: str | Column = "headers") -> Column:
    """The headers without all of that name."""
    col = F.col(headers) if isinstance(headers, str) else headers
    return F.filter(col, lambda h: F.lower(h["key"]) != name.lower())


def has_header(name: str, headers: str | Column = "headers") -> Column:
    return F.exists(F.col(headers) if isinstance(headers, str) else headers, lambda h: F.lower(h["key"]) == name.lower())


def header_map(headers: str | Column = "headers") -> Column:
    """A map from lower-case names to their last values."""
    col = F.col(headers) if isinstance(headers, str) else headers
    low = F.transform(col, lambda h: F.struct(F.lower(h["key"]).alias("key"), h["value"].alias("value")))
    last = F.filter(low, lambda h, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda x: x["key"] == h["key"]))
    return F.map_from_entries(last)


def _checked(test, kind: str, arrow: pa.DataType, body: str | Column, digest: str | Column) -> tuple[Column, Column]:
    """(the test of each body and digest, the digest)."""

    @F.arrow_udf(kind)
    def run(bodies: pa.Array, digests: pa.Array) -> pa.Array:
        return pa.array([test(b or b"", d) for b, d in zip(bodies.to_pylist(), digests.to_pylist(), strict=True)], arrow)

    b, d = (F.col(x) if isinstance(x, str) else x for x in (body, digest))
    return run(b.cast("binary"), d), d


def digest_status(body: str | Column, digest: str | Column) -> Column:
    """OK, FAIL or NO_DIGEST of a body against "algorithm:value"."""
    fine, d = _checked(lambda b, d: bool(d) and W.verify_digest(b, d), "boolean", pa.bool_(), body, digest)
    return F.when(F.coalesce(d, F.lit("")) == "", "NO_DIGEST").when(fine, "OK").otherwise("FAIL")


def digest_reason(body: str | Column, digest: str | Column) -> Column:
    """Why a digest doesn't hold: missing, malformed, unknown algorithm, bad encoding or mismatch; null if it does."""
    return _checked(W.digest_error, "string", pa.string(), body, digest)[0]


def verify(records: DataFrame, payload: bool = False) -> DataFrame:
    """(record_id, block, payload) states of records read with parse_http=false (block) or parsed (payload)."""
    states = [F.col("record_id"), digest_status("body", header_value("WARC-Block-Digest", which="first")).alias("block")]
    if payload:
        states.append(F.when(F.col("http_headers").isNotNull(), digest_status("body", header_value("WARC-Payload-Digest", which="first"))).otherwise("NO_DIGEST").alias("payload"))
    return records.select(*states)


def check_report(records: DataFrame) -> DataFrame:
    """(status, n) over the block digests."""
    return verify(records).groupBy(F.col("block").alias("status")).agg(F.count("*").alias("n"))


def index(records: DataFrame, sizes: DataFrame | None = None, fields: tuple[str, ...] = ("offset", "length", "filename")) -> DataFrame:
    """CDXJ rows: (filename, stream_pos, length, json).

    A record's length reaches to the next offset of its file, or to the file's end by ``sizes`` (filename, length).
    Fields are offset, length, filename, http:status, http:NAME, or the name of an archive header.
    """
    w = Window.partitionBy("filename").orderBy("stream_pos")
    rows = records.withColumn("__next", F.lead("stream_pos").over(w))
    rows = rows.join(sizes.select("filename", F.col("length").alias("__size")), "filename", "left") if sizes is not None else rows.withColumn("__size", F.lit(None).cast("long"))
    rows = rows.withColumn("length", F.coalesce(F.col("__next"), F.col("__size")) - F.col("stream_pos"))
    value = {"offset": F.col("stream_pos").cast("string"), "length": F.col("length").cast("string"), "filename": F.col("filename"), "http:status": F.col("http_status").cast("string")}
    of = lambda f: value[f] if f in value else header_value(f[5:], "http_headers") if f.startswith("http:") else header_value(f)
    return rows.select("filename", "stream_pos", "length", F.to_json(F.struct(*[of(f).alias(f) for f in fields])).alias("json"))


def write_index(records: DataFrame, path: str, sizes: DataFrame | None = None, fields: tuple[str, ...] = ("offset", "length", "filename")) -> None:
    index(records, sizes, fields).sortWithinPartitions("filename", "stream_pos").select("json").write.text(path)


def records_at(places: Iterable[tuple[str, int]], **options) -> Iterator[W.Record | None]:
    """Records by (path, offset), in that order; a file stays open while the next record is in it too."""
    for path, some in itertools.groupby(places, lambda x: x[0]):
        with open_file(path) as f:
            for _, offset in some:
                yield next(W.read_records(f, C.codec_of_name(path), start=offset, **options), None)
                f.seek(0)


def record_at(path: str, offset: int, **options) -> W.Record | None:
    """One record by its offset."""
    (found,) = records_at([(path, offset)], **options)
    return found


def recompress(spark: SparkSession, source: str, target: str, compression: str = C.GZIP, **options) -> int:
    """Writes archives again with another codec; returns the bytes written, not counting files that were there before."""
    register(spark)
    before = {path for path, _ in list_files(target)}
    rows = spark.read.format("warc").options(parse_http="false", **options).load(source)
    rows.write.format("warc").option("compression", compression).mode("append").save(target)
    return sum(size for path, size in list_files(target) if path not in before)


def bulk_actions(docs: DataFrame, index_name: str, id_col: str = "_id", op: str = "index") -> DataFrame:
    """(_id, action, source): one JSON pair for each document of a bulk request, in the order of _id within each partition.

    Columns that start with _ aren't part of the source; a null id is left out of an index action.
    An update wraps the source, and a delete has none.
    """
    if op not in ("index", "create", "update", "delete"):
        raise ValueError("op must be index, create, update or delete")
    fields = [F.col(f"`{c}`") for c in docs.columns if not c.startswith("_")]
    meta = F.struct(F.lit(index_name).alias("_index"), F.col(id_col).cast("string").alias("_id"))
    source = F.struct(*fields)
    body = F.to_json(F.struct(source.alias("doc"))) if op == "update" else F.lit(None).cast("string") if op == "delete" else F.to_json(source)
    return docs.sortWithinPartitions(id_col).select(F.col(id_col).cast("string").alias("_id"), F.to_json(F.struct(meta.alias(op))).alias("action"), body.alias("source"))


def ensure_index(create, index_name: str, settings: dict | None = None) -> bool:
    """Creates an index by ``create(name, settings)``; false if the endpoint says 400, as it does for one that exists."""
    status = create(index_name, settings or {})
    if status >= 300 and status != 400:
        raise RuntimeError(f"the endpoint refused the index: {status}")
    return status < 300


def send_bulk(actions: DataFrame, send, dry_run: bool = False, ignore_400: bool = True, initial_backoff: float = 2, max_backoff: float = 600, max_retries: int = 10, chunk: int = 800) -> DataFrame:
    """Ids that a bulk endpoint took: ``send`` gets the lines of a chunk and returns a status for each action.

    It runs in the tasks; 429 and 5xx are sent again with growing pauses.
    """
    import time

    def run(parts):
        for b in parts:
            rows = b.to_pylist()
            for at in range(0, len(rows), chunk):
                todo, done, pause = rows[at : at + chunk], [], initial_backoff
                for attempt in range(max_retries + 1):
                    states = [201] * len(todo) if dry_run else send([x for r in todo for x in (r["action"], r["source"]) if x is not None])
                    done += [r["_id"] for r, s in zip(todo, states, strict=True) if s < 300]
                    bad = [s for s in states if 400 <= s < 500 and s != 429]
                    if bad and not (ignore_400 and all(s == 400 for s in bad)):
                        raise RuntimeError(f"the endpoint refused documents: {sorted(set(bad))}")
                    todo = [r for r, s in zip(todo, states, strict=True) if s == 429 or s >= 500]
                    if not todo:
                        break
                    if attempt == max_retries:
                        raise RuntimeError(f"{len(todo)} documents weren't taken")
                    time.sleep(min(pause, max_backoff))
                    pause *= 2
                yield pa.RecordBatch.from_pydict({"_id": pa.array(done, pa.string())})

    return actions.mapInArrow(run, "_id string")


_TASK_BYTES = 64 << 20

#: Encodings in which a line feed may be part of another character, or the state of a line depends on those before it.
_WHOLE = re.compile(r"utf-?(16|32|7)|iso-?2022|hz", re.I)


def read_text(spark: SparkSession, pattern: str, encoding: str = "utf-8", split_bytes: int = 64 << 20) -> DataFrame:
    """(value) lines of text files, decoded leniently.

    UTF-8 is split by Spark.  Other files are read in ranges of ``split_bytes``, and as a whole only if they are compressed (by
    their suffix) or in an encoding whose line feeds can't be told byte by byte (UTF-16, UTF-32, ISO-2022).
    """
    from webloom.functions.encoding import bytes_to_str, decoded, map_encoding

    if encoding.lower().replace("-", "") == "utf8":
        return spark.read.format("text").load(pattern)
    prepare(spark)
    if _WHOLE.search(encoding):
        return spark.read.format("binaryFile").load(pattern).select(F.explode(F.split(F.regexp_replace(decoded("content", encoding), r"\r?\n\z", ""), r"\r?\n")).alias("value"))
    name, packed = map_encoding(encoding), (".gz", ".bz2", ".zst", ".lz4")
    files = list_files(pattern)
    ranges = [(p, a, min(a + split_bytes, n)) for p, n in files for a in range(0, n, split_bytes if not p.endswith(packed) else max(n, 1))]
    # neighbours share a task where ranges are small, so that the tasks' number doesn't grow with that of ranges
    tasks = min(len(ranges), max(4 * spark.sparkContext.defaultParallelism, sum(n for _, n in files) // _TASK_BYTES))
    table = spark.createDataFrame(spark.sparkContext.parallelize(ranges, max(1, tasks)), "path string, start long, end long")

    def read(parts):
        for b in parts:
            for row in b.to_pylist():
                fs, inner = file_system(row["path"])
                lines = _lines(fs, inner, row["start"], row["end"], row["path"].endswith(packed))
                while some := list(itertools.islice(lines, 5000)):
                    yield pa.RecordBatch.from_pydict({"value": pa.array([bytes_to_str(x, name) for x in some], pa.string())})

    return table.mapInArrow(read, "value string")


def _lines(fs: pa.fs.FileSystem, path: str, start: int, end: int, packed: bool) -> Iterator[bytes]:
    """The lines that begin in a range, without their ends."""
    with fs.open_input_stream(path, compression="detect") if packed else fs.open_input_file(path) as raw:
        f = io.BufferedReader(raw, 1 << 16)
        at = start
        if start and not packed:
            f.seek(start - 1)
            at += len(f.readline()) - 1
        while packed or at < end:
            line = f.readline()
            if not line:
                return
            at += len(line)
            yield line.removesuffix(b"\n").removesuffix(b"\r")


def stream_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of the records of archive files as they come into a folder."""
    register(spark)
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")
    return read_files(files, **options)


def dump(records: list[W.Record], codec: str = C.PLAIN, checksum: bool = False) -> bytes:
    """An archive file's bytes; every record is a member of its own."""
    return b"".join(C.compress(W.serialise(r, checksum), codec) for r in records)
