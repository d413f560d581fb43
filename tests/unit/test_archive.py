import io
import random

import pytest
from pyspark.sql import functions as F

from webloom.sources import archive as A
from webloom.sources import codecs as C
from webloom.sources import warc as W

CODECS = [C.PLAIN, C.GZIP, C.LZ4, C.ZSTD]


def records(n=16):
    rng = random.Random(1)
    out = [W.new_record("warcinfo", b"software: x\r\n", [("Content-Type", "application/warc-fields")])]
    for i in range(n):
        for kind, line, heads, body in (("request", "GET / HTTP/1.1", [("Host", "h")], b""), ("response", "HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=UTF-8"), ("Date", "Wed, 21 Oct 2015 07:28:00 GMT")], bytes(rng.choices(b"abc \n<>", k=rng.randint(0, 3000))))):
            r = W.new_record(kind, body, [("WARC-Target-URI", f"http://h/{i}"), ("X-Page", str(i)), ("x-page", "again")], http=True)
            r.http_status_line, r.http_headers = line, heads
            out.append(r)
        out.append(W.new_record("metadata", b"k: v"))
    return out


@pytest.mark.parametrize("codec", CODECS)
def test_round_trip(codec):
    data = A.dump(records(), codec, checksum=True)
    got = list(W.read_records(io.BytesIO(data)))
    assert [r.warc_type for r in got] == [r.warc_type for r in records()] and len({r.stream_pos for r in got}) == len(got)
    assert all(W.verify_block_digest(r) for r in got) and all(W.verify_payload_digest(r) for r in got if r.is_http)
    for r in got:
        assert next(W.read_records(io.BytesIO(data), codec, start=r.stream_pos)).record_id == r.record_id
        assert len(r.body) == r.content_length
    raw = list(W.read_records(io.BytesIO(data), parse_http=False))
    assert b"".join(C.compress(W.serialise(r), codec) for r in raw) == data


@pytest.mark.parametrize("size", [50, 333, 1000, 7000])
def test_ranges_meet_every_record_once(size):
    data = A.dump(records())
    whole = [r.stream_pos for r in W.read_records(io.BytesIO(data))]
    parts = [r.stream_pos for a in range(0, len(data), size) for r in W.read_records(io.BytesIO(data), C.PLAIN, start=a, end=min(a + size, len(data)))]
    assert parts == whole


def test_filters():
    data = A.dump(records(), C.GZIP, checksum=True)
    read = lambda **k: list(W.read_records(io.BytesIO(data), **k))
    assert len(read(record_types=["response"])) == 16 and len(read(record_types=["none"])) == 0
    assert all(100 <= r.content_length <= 900 for r in read(min_content_length=100, max_content_length=900, parse_http=False))
    assert len(read(func_filter=lambda r: W.header(r.headers, "x-PAGE") == "again")) == 32
    assert len(read(verify_digests=True)) == 49
    bad = A.dump([W.new_record("resource", b"x", [("WARC-Block-Digest", "sha1:AAAA")]), W.new_record("resource", b"y")])
    assert not list(W.read_records(io.BytesIO(bad), verify_digests=True))


def test_quirks():
    lf = b"WARC/0.18\nWARC-Type: response\nContent-Length: 2\n\nhi\n\njunk\nWARC/1.0\nWARC-Type: resource\nContent-Length: 1\n\nx\n\n"
    assert list(W.read_records(io.BytesIO(lf), C.PLAIN)) == []
    assert [(r.version, r.body) for r in W.read_records(io.BytesIO(lf), C.PLAIN, strict=False)] == [("WARC/0.18", b"hi"), ("WARC/1.0", b"x")]
    whole = A.dump(records(), C.GZIP)
    assert 0 < len(list(W.read_records(io.BytesIO(whole[: len(whole) // 2])))) < 49
    with pytest.raises(C.StreamError):
        list(W.read_records(io.BytesIO(b"not an archive")))
    assert list(W.read_records(io.BytesIO(b""))) == []


def test_headers():
    status, h, at = W.parse_headers(b"HTTP/1.1 404 Not Found\r\nA: 1\r\n more\r\nbroken\r\na : 2\r\nEmpty:\r\n\r\nbody", 0, True)
    assert status == "HTTP/1.1 404 Not Found" and h == [("A", "1 more broken"), ("a", "2"), ("Empty", "")] and at == 62
    assert (W.status_code(status), W.reason_phrase(status), W.status_code("GET / HTTP/1.1"), W.header(h, "A"), W.first_header(h, "A")) == (404, "Not", None, "2", "1 more broken")
    assert [W.charset([("Content-Type", x)]) for x in ("text/html; charset=UTF-8", "text/html; Charset=x", "text/html", "a; charset=nope", "a; charset=latin1; q")] == ["utf-8", None, None, None, "latin1"]
    assert W.iso_date("2020-01-01T00:00:00Z").year == 2020 and W.iso_date("x") is None and W.http_date("nope") is None


@pytest.mark.parametrize("algorithm", ["md5", "sha1", "sha256", "sha512"])
def test_digests(algorithm):
    import hashlib

    assert W.verify_digest(b"x", W.digest(b"x", algorithm)) and not W.verify_digest(b"y", W.digest(b"x", algorithm))
    assert W.verify_digest(b"x", f"{algorithm}:{hashlib.new(algorithm, b'x').hexdigest()}")
    assert not W.verify_digest(b"x", "nope") and not W.verify_digest(b"x", algorithm.upper() + ":x")


def test_bodies():
    import gzip
    import zlib

    assert W.dechunk(b"4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n") == b"Wikipedia" and W.dechunk(b"zz\r\n") == b""
    for codings, data in ((["gzip"], gzip.compress(b"x")), (["deflate"], zlib.compress(b"x")), (["deflate"], zlib.compress(b"x")[2:-4]), (["gzip", "x-gzip"], gzip.compress(gzip.compress(b"x"))), (["identity", "none"], b"x")):
        assert C.decode_content(data, codings) == b"x"


def test_source_and_writer(spark, tmp_path):
    A.register(spark)
    (tmp_path / "in").mkdir()
    for i, codec in enumerate(CODECS):
        (tmp_path / "in" / f"{i}.warc{C.SUFFIX[codec]}").write_bytes(A.dump(records(), codec))
    df = spark.read.format("warc").option("split_bytes", "5000").load(str(tmp_path / "in"))
    assert df.count() == 4 * 49 and df.where("warc_type = 'response'").count() == 64
    one = df.where("warc_type = 'response' and http_status = 200").select("http_content_type", "http_charset", "http_date").distinct().collect()
    assert [(r[0], r[1]) for r in one] == [("text/html", "utf-8")]
    for codec in CODECS:
        out = str(tmp_path / codec)
        df.write.format("warc").option("compression", codec).option("checksum", "true").mode("append").save(out)
        back = spark.read.format("warc").load(out)
        key = ["record_id", "warc_type", "body"]
        assert back.select(key).exceptAll(df.select(key)).count() == 0 and back.count() == df.count()
        assert A.check_report(spark.read.format("warc").option("parse_http", "false").load(out)).collect()[0].asDict() == {"status": "OK", "n": 196}
    files = A.match_files(spark, str(tmp_path / "in" / "*.gz"))
    assert A.read_files(files, record_types=["metadata"]).count() == 16
    found = A.index(A.read_files(files), files.withColumnRenamed("path", "filename")).orderBy("stream_pos").collect()
    size = (tmp_path / "in" / "1.warc.gz").stat().st_size
    assert sum(r.length for r in found) == size and A.record_at(found[7].filename, found[7].stream_pos).stream_pos == found[7].stream_pos
    assert A.recompress(spark, str(tmp_path / "in" / "0.warc"), str(tmp_path / "re"), C.LZ4) > 0


def test_header_columns(spark):
    h = spark.createDataFrame([([("A", "1"), ("b", "2"), ("a", "3")],), ([],), (None,)], "headers array<struct<key:string,value:string>>")
    got = h.select(A.header_value("a").alias("last"), A.header_value("A", which="first").alias("first"), F.size(A.header_value("a", which="all")).alias("n"), A.with_header("a", "x").alias("put"), A.with_header("z", "y").alias("new")).collect()
    assert (got[0].last, got[0].first, got[0].n) == ("3", "1", 2) and [tuple(p) for p in got[0].put] == [("A", "x"), ("b", "2"), ("a", "3")] and tuple(got[0].new[-1]) == ("z", "y")
    assert got[1].last is None and got[2].last is None


def test_bulk(spark):
    docs = spark.createDataFrame([("2", "b", 1), ("1", "a", 1), (None, "c", 1)], "_id string, text string, _hidden int").coalesce(1)
    rows = A.bulk_actions(docs, "i").collect()
    assert [(r.action, r.source) for r in rows] == [('{"index":{"_index":"i"}}', '{"text":"c"}'), ('{"index":{"_index":"i","_id":"1"}}', '{"text":"a"}'), ('{"index":{"_index":"i","_id":"2"}}', '{"text":"b"}')]
    assert A.bulk_actions(docs, "i", op="update").collect()[1].source == '{"doc":{"text":"a"}}' and A.bulk_actions(docs, "i", op="delete").collect()[1].source is None

    calls = []

    def send(lines):
        calls.append(lines)
        return [429 if len(calls) == 1 and "2" in line else 400 if '"1"' in line else 201 for line in lines if "_index" in line]

    sent = A.send_bulk(A.bulk_actions(docs, "i"), send, initial_backoff=0)
    assert {r["_id"] for r in sent.collect()} == {None, "2"}
    with pytest.raises(ValueError):
        A.bulk_actions(docs, "i", op="nope")


def junk(codec, tail=b""):
    return A.dump(records(2), codec) + C.compress(b"junk\r\n", codec) + A.dump(records(2), codec) + tail


@pytest.mark.parametrize("codec", CODECS)
def test_damaged_archives_end_or_raise(codec):
    assert len(list(W.read_records(io.BytesIO(junk(codec)), codec))) == 7
    assert len(list(W.read_records(io.BytesIO(junk(codec)), codec, strict=False))) == 14
    with pytest.raises(C.StreamError):
        list(W.read_records(io.BytesIO(junk(codec)), codec, invalid="error"))
    whole = A.dump(records(4), codec)
    assert len(list(W.read_records(io.BytesIO(whole), codec, invalid="error"))) == 13
    with pytest.raises(C.StreamError):
        list(W.read_records(io.BytesIO(whole[:-9]), codec, invalid="error"))
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(whole), codec, invalid="no"))


@pytest.mark.parametrize("codec", [C.PLAIN, C.GZIP])
def test_cut_off_headers_raise(codec):
    data = C.compress(A.dump(records(1)) + b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Le", codec)
    with pytest.raises(C.StreamError, match="cut off"):
        list(W.read_records(io.BytesIO(data), codec, invalid="error"))
    list(W.read_records(io.BytesIO(data), codec))


@pytest.mark.parametrize("codec", CODECS)
def test_over_long_records_keep_their_header(codec):
    data = A.dump(records(), codec)
    got = list(W.read_records(io.BytesIO(data), codec, max_content_length=500, keep_meta=True, parse_http=False))
    want = list(W.read_records(io.BytesIO(data), codec, parse_http=False))
    assert [(r.record_id, r.content_length) for r in got] == [(r.record_id, r.content_length) for r in want]
    assert all(r.body == (w.body if w.content_length <= 500 else b"") for r, w in zip(got, want)) and {r.body == b"" for r in got} == {True, False}


@pytest.mark.parametrize("codec", [C.GZIP, C.ZSTD])
@pytest.mark.parametrize("piece", [1, 700, 5000, 1 << 20])
def test_one_member_for_a_whole_archive_streams(codec, piece, monkeypatch):
    monkeypatch.setattr(W, "_PIECE", piece)
    monkeypatch.setattr(C, "_CHUNK", 64)
    plain = A.dump(records(), checksum=True)
    data = C.compress(plain, codec)
    got = list(W.read_records(io.BytesIO(data), codec, invalid="error"))
    assert [r.record_id for r in got] == [r.record_id for r in W.read_records(io.BytesIO(plain))]
    assert all(W.verify_block_digest(r) for r in got) and {r.stream_pos for r in got} == {0}
    assert codec != C.GZIP or next(C.members(io.BytesIO(data), codec, 2000))[2] is None


@pytest.mark.parametrize("codec", [C.PLAIN, C.GZIP])
@pytest.mark.parametrize("single", [False, True])
def test_reading_goes_on_after_errors(codec, single, tmp_path, monkeypatch):
    if single and codec == C.PLAIN:
        return
    path = tmp_path / f"a.warc{C.SUFFIX[codec]}"
    all_ = records()
    data = A.dump(all_)
    path.write_bytes(C.compress(data, codec) if single else A.dump(all_, codec))
    fails = iter([3, 2, 4, 5, 10**9])
    real = A.open_file

    class Flaky(io.BytesIO):
        def __init__(self, raw, after):
            super().__init__(raw)
            self.left = after

        def _count(self):
            self.left -= 1
            if self.left < 0:
                raise OSError("gone")

        def read(self, *a):
            self._count()
            return super().read(*a)

        def readinto(self, b):
            self._count()
            return super().readinto(b)

    monkeypatch.setattr(C, "_CHUNK", 3000)
    monkeypatch.setattr(A, "open_file", lambda p: Flaky(real(p).read(), next(fails)))
    got = [r.record_id for r in A.records(str(path), retries=4, codec=codec)]
    assert got == [r.record_id for r in W.read_records(io.BytesIO(data))]
    fails = iter([0] * 9)
    with pytest.raises(OSError):
        list(A.records(str(path), retries=2, codec=codec))


def test_digest_reasons():
    good = W.digest(b"x", "sha256")
    assert [W.digest_error(b"x", d) for d in (good, None, "", "sha1", "sha1:", "crc:AA", "md5:!", W.digest(b"y"))] == [None, "missing", "missing", "malformed", "malformed", "unknown algorithm", "bad encoding", "mismatch"]


def test_bodies_that_cannot_be_decoded():
    if C.brotli is None:
        with pytest.raises(C.StreamError):
            C.decode_content(b"x", ["br"])
    r = W.new_record("response", b"not deflated", http=True)
    r.http_status_line, r.http_headers = "HTTP/1.1 200 OK", [("Content-Encoding", "deflate")]
    (got,) = W.read_records(io.BytesIO(A.dump([r])), auto_decode="all")
    assert got.body is None
    with pytest.raises(C.StreamError):
        list(W.read_records(io.BytesIO(A.dump([r])), auto_decode="all", invalid="error"))


def only_again(r):
    return W.header(r.headers, "x-PAGE") == "again"


def test_writers_on_one_path_and_further_options(spark, tmp_path):
    A.register(spark)
    path = str(tmp_path / "out")
    rows = spark.range(40).selectExpr("'resource' as warc_type", "encode(cast(id as string), 'utf-8') as body")
    rows.repartition(4).write.format("warc").mode("append").save(path)
    other = tmp_path / "out" / "_tmp-of-another-job"
    other.mkdir()
    rows.repartition(2).write.format("warc").mode("append").save(path)
    read = lambda **o: spark.read.format("warc").options(**o).load(path)
    assert other.exists() and read().count() == 80 and read(shuffle_files="true", seed="3", retries="1").count() == 80
    rows.limit(5).write.format("warc").mode("overwrite").save(path)
    assert read(invalid_header="error").count() == 5
    before = A.recompress(spark, path, str(tmp_path / "again"), "lz4")
    assert A.recompress(spark, path, str(tmp_path / "again"), "lz4") == pytest.approx(before, abs=60) and before < 2000
    (tmp_path / "f.warc").write_bytes(A.dump(records()))
    got = spark.read.format("warc").option("func_filter", "tests.unit.test_archive:only_again").load(str(tmp_path / "f.warc"))
    assert got.count() == 32


def test_header_edits(spark):
    row = spark.createDataFrame([([("A", "1"), ("b", "2"), ("a", "3")],)], "headers array<struct<key:string,value:string>>")
    got = row.select(A.without_header("a").alias("x"), A.with_appended("n:ew", "v\r\nw ").alias("y"), A.has_header("B").alias("z"), A.header_map().alias("m")).first()
    assert [tuple(h) for h in got.x] == [("b", "2")] and tuple(got.y[-1]) == ("new", "v w") and got.z and got.m == {"a": "3", "b": "2"}


def test_ensure_index():
    assert A.ensure_index(lambda name, settings: 200, "i") and not A.ensure_index(lambda name, settings: 400, "i")
    with pytest.raises(RuntimeError):
        A.ensure_index(lambda name, settings: 503, "i")


def test_command_lines(spark, tmp_path, capsysbinary):
    from webloom.cli import main

    (tmp_path / "in").mkdir()
    data = A.dump(records(), C.GZIP, checksum=True)
    (tmp_path / "in" / "a.warc.gz").write_bytes(data)
    source, out = str(tmp_path / "in"), lambda: capsysbinary.readouterr().out.decode()
    assert main(["check", source], spark) == 0 and out().startswith("OK: 49, FAIL: 0, NO_DIGEST: 0")
    assert main(["recompress", source, str(tmp_path / "lz4"), "--compression", "lz4"], spark) == 0 and out().endswith("bytes written\n")
    assert main(["index", str(tmp_path / "lz4"), str(tmp_path / "cdxj"), "--fields", "offset,http:status"], spark) == 0
    assert spark.read.text(str(tmp_path / "cdxj")).count() == 49
    assert main(["benchmark", source, "--record-types", "response"], spark) == 0 and out().startswith("16 records in")
    assert main(["extract", f"{source}/a.warc.gz", "0"]) == 0 and out().startswith("WARC/1.1\r\n") and main(["extract", f"{source}/a.warc.gz", str(len(data))]) == 1
    assert main(["text", source, str(tmp_path / "text")], spark) == 0 and spark.read.parquet(str(tmp_path / "text")).count() == 16
    bad = A.dump([W.new_record("resource", b"x", [("WARC-Block-Digest", "sha1:AAAA")])])
    (tmp_path / "bad.warc").write_bytes(bad)
    assert main(["check", str(tmp_path / "bad.warc"), "--bad", str(tmp_path / "bad")], spark) == 1 and spark.read.json(str(tmp_path / "bad")).count() == 1


def test_small_ranges_of_text_share_tasks(spark, tmp_path):
    lines = [f"é{i}" * (i % 9) for i in range(3000)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode("iso-8859-1"))
    got = A.read_text(spark, str(tmp_path / "a.txt"), "iso-8859-1", split_bytes=50)
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["value"] for r in got.collect()) == sorted(lines)


@pytest.mark.parametrize("codec", [C.GZIP, C.LZ4, C.ZSTD])
def test_one_record_takes_few_bytes(tmp_path, monkeypatch, codec):
    """A look-up reads about its record, not a large piece of the file, and a file is opened once for all look-ups in it."""
    bodies = [random.Random(i).randbytes(3000 if i != 70 else 3_000_000) for i in range(400)]
    path = str(tmp_path / f"a.warc{C.SUFFIX[codec]}")
    (tmp_path / f"a.warc{C.SUFFIX[codec]}").write_bytes(A.dump([W.new_record("resource", b) for b in bodies], codec))
    offsets = [r.stream_pos for r in A.records(path)]
    read, opened, real = [], [], A.open_file

    class Counting(io.BytesIO):
        def read(self, n=-1):
            read.append(len(data := super().read(n)))
            return data

    def open_counting(p):
        opened.append(p)
        with real(p) as f:
            return Counting(f.read())

    monkeypatch.setattr(A, "open_file", open_counting)
    order = [300, 5, 399, 70, 0]
    assert [r.body for r in A.records_at((path, offsets[i]) for i in order)] == [bodies[i] for i in order] and len(opened) == 1
    read.clear()
    assert A.record_at(path, offsets[100]).body == bodies[100] and sum(read) < 100_000
