"""The registered queries of the library, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import encoding as E
from webloom.functions import html as H
from webloom.functions import http as P
from webloom.functions import language as L
from webloom.functions.extract import extract_plain_text, extract_text
from webloom.functions.guards import guarded
from webloom.session import prepare, shared_dir, spread, written
from webloom.sources import archive as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def _hash(x: str | Column) -> Column:
    return F.md5((F.col(x) if isinstance(x, str) else x).cast("binary"))


# Language identification

_NORM = r"regexp_replace(regexp_replace(text, '[\s\p{Z}\x0B\x1C-\x1F\x{85}]+', ' ', 'g'), '[^\p{L} ]', '', 'g')"
_VECTORS = rf"""
    norm AS (
        SELECT doc_id, lang, length(text) AS len, {_NORM} AS s FROM documents WHERE text IS NOT NULL
    ), chars AS (
        SELECT doc_id, generate_subscripts(cs, 1) AS i, unicode(unnest(cs)) AS c FROM (SELECT doc_id, regexp_extract_all(s, '(?s).') AS cs FROM norm)
    ), leads AS (
        SELECT doc_id, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3, lead(c, 4) OVER w AS c4 FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    ), h1 AS (
        SELECT *, (xor(2166136261::BIGINT, c) * 16777619) % 4294967296 AS a FROM leads
    ), h2 AS (
        SELECT *, (xor(a, c1) * 16777619) % 4294967296 AS b FROM h1
    ), h3 AS (
        SELECT *, (xor(b, c2) * 16777619) % 4294967296 AS d FROM h2
    ), h4 AS (
        SELECT *, (xor(d, c3) * 16777619) % 4294967296 AS e FROM h3
    ), h5 AS (
        SELECT *, (xor(e, c4) * 16777619) % 4294967296 AS f FROM h4
    ), grams AS (
        SELECT doc_id, unnest([a, b, d, e, f]) AS h FROM h5
    ), vec AS (
        SELECT g.doc_id, (xor(h >> 8, h) & 255)::INTEGER AS bucket, least(255, count(*) * 256 // any_value(length(n.s)))::INTEGER AS value
        FROM grams g JOIN norm n USING (doc_id) WHERE h IS NOT NULL GROUP BY ALL
    )"""
_PROFILES = (
    _VECTORS
    + """, langs AS (
        SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS place FROM norm WHERE lang IS NOT NULL GROUP BY 1
    ), profile AS (
        SELECT l.lang, b.bucket::INTEGER AS bucket, least(255, coalesce(sum(v.value), 0) // any_value(l.n))::INTEGER AS value
        FROM langs l CROSS JOIN range(256) AS b(bucket) LEFT JOIN (SELECT n.lang, vec.* FROM vec JOIN norm n USING (doc_id)) v ON v.lang = l.lang AND v.bucket = b.bucket GROUP BY 1, 2
    )"""
)
_RANKS = (
    _PROFILES
    + """, near AS (
        SELECT v.doc_id, p.lang, sum(abs(v.value - p.value) - p.value) AS d FROM vec v JOIN profile p USING (bucket) GROUP BY 1, 2
    ), distance AS (
        SELECT n.doc_id, l.lang, l.place, n.len, (t.total + coalesce(near.d, 0))::INTEGER AS rank
        FROM norm n CROSS JOIN langs l JOIN (SELECT lang, sum(value) AS total FROM profile GROUP BY 1) t ON t.lang = l.lang LEFT JOIN near ON near.doc_id = n.doc_id AND near.lang = l.lang
    ), ranked AS (
        SELECT doc_id, lang, place, rank + CASE WHEN rank > 500 AND len < 150 THEN least(50, 3 * place) ELSE 0 END AS rank FROM distance
    ), best AS (
        SELECT doc_id, lang, rank::INTEGER AS rank, row_number() OVER (PARTITION BY doc_id ORDER BY rank, place)::INTEGER AS pos FROM ranked WHERE rank <= 1200
    ), guess AS (
        SELECT n.doc_id, n.lang, coalesce(b.lang, 'unknown') AS predicted, coalesce(b.rank, 0)::INTEGER AS rank FROM norm n LEFT JOIN best b ON b.doc_id = n.doc_id AND b.pos = 1
    ), confusion AS (
        SELECT lang AS actual, CASE predicted WHEN 'unknown' THEN '-' ELSE predicted END AS predicted, count(*) AS n FROM guess GROUP BY 1, 2
    )"""
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def profiles(spark: SparkSession, sf_dir: str) -> L.Profiles:
    """Profiles trained on the documents; one row for each language comes to the driver."""
    return L.Profiles.of(L.train_profiles(_docs(spark, sf_dir)))


@_query(f"SELECT doc_id, md5({_NORM}) AS h FROM documents")
def lang_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", _hash(L.normalise("text")).alias("h"))


@_query(f"WITH {_VECTORS} SELECT doc_id, bucket, value FROM vec WHERE value > 0")
def lang_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(L.language_vector("text")).alias("bucket", "value")).where("value > 0")


@_query(f"WITH {_PROFILES} SELECT lang, bucket, value FROM profile")
def lang_train_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.train_profiles(_docs(spark, sf_dir)).select("lang", F.posexplode("vector").alias("bucket", "value"))


@_query(f"WITH {_RANKS} SELECT doc_id, lang, rank FROM distance")
def lang_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("text is not null")
    trained = written(L.train_profiles(docs))  # a row for each language, so the broadcast doesn't grow with the documents
    vectors = docs.select("doc_id", L.language_vector("text").alias("v"))
    return vectors.crossJoin(F.broadcast(trained.select("lang", "vector"))).select("doc_id", "lang", L.distance("v", "vector").alias("rank"))


@_query(f"WITH {_RANKS} SELECT doc_id, predicted, rank FROM guess")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).withColumn("d", L.detect("text", profiles(spark, sf_dir)))
    return found.where("text is not null").select("doc_id", F.col("d.lang").alias("predicted"), "d.rank")


@_query(f"WITH {_RANKS} SELECT doc_id, pos, lang, rank FROM best WHERE pos <= 3")
def lang_detect_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = L.detect_top("text", profiles(spark, sf_dir), 3)
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(top).alias("pos", "d")).select("doc_id", (F.col("pos") + 1).alias("pos"), "d.lang", "d.rank")


def _guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is not null").select("lang", L.detect("text", profiles(spark, sf_dir))["lang"].alias("predicted"))


@_query(f"WITH {_RANKS} SELECT actual, predicted, n FROM confusion")
def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.confusion(_guessed(spark, sf_dir))


@_query(
    f"""WITH {_RANKS}, own AS (
        SELECT actual AS lang, sum(n) AS n, coalesce(sum(n) FILTER (actual = predicted), 0) AS hit FROM confusion GROUP BY 1
    ), said AS (
        SELECT predicted AS lang, sum(n) AS said FROM confusion GROUP BY 1
    ), r AS (
        SELECT lang, n, hit, coalesce(said, 0) AS said, hit / greatest(coalesce(said, 0), 1) AS precision, hit / greatest(n, 1) AS recall, (SELECT sum(n) FROM confusion) AS total FROM own LEFT JOIN said USING (lang)
    )
    SELECT lang, n::BIGINT AS n, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, (total - n - said + 2 * hit) / total AS accuracy FROM r"""
)
def lang_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.evaluate(written(_guessed(spark, sf_dir)))


@_query("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def lang_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is not null and lang is not null").select("lang").distinct().orderBy("lang")


_LINES = "SELECT DISTINCT lang, line FROM (SELECT lang, trim(replace(replace(unnest(string_split(text, chr(10))), '[[', ''), ']]', '')) AS line FROM documents) WHERE length(line) >= 200"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("lang", F.explode(L.clean_lines("text")).alias("line"))


@_query(f"SELECT lang, sha1(line) AS h FROM ({_LINES})")
def dataset_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("length(line) >= 200").select("lang", F.sha1("line").alias("h")).distinct()


@_query(
    f"""SELECT lang, h, CASE WHEN i < a THEN 'test' WHEN i > a AND i < a + b THEN 'val' ELSE 'train' END AS part FROM (
        SELECT lang, sha1(line) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha1(line)) - 1 AS i, floor(count(*) OVER (PARTITION BY lang) * 0.05) AS a, floor(count(*) OVER (PARTITION BY lang) * 0.05) AS b FROM ({_LINES}))"""
)
def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_examples(_lines(spark, sf_dir)).select("lang", F.sha1("line").alias("h"), "part")


@_query(
    f"""WITH split AS (SELECT lang, line, CASE WHEN i < a THEN 'test' WHEN i > a AND i < a + b THEN 'val' ELSE 'train' END AS part FROM (
        SELECT lang, line, row_number() OVER (PARTITION BY lang ORDER BY sha1(line)) - 1 AS i, floor(count(*) OVER (PARTITION BY lang) * 0.05) AS a, floor(count(*) OVER (PARTITION BY lang) * 0.05) AS b FROM ({_LINES}))
    ), documents AS (
        SELECT lang || ':' || line AS doc_id, line AS text, CASE WHEN part = 'train' THEN lang END AS lang FROM split
    ), {_RANKS}
    SELECT s.lang AS actual, CASE predicted WHEN 'unknown' THEN '-' ELSE predicted END AS predicted, count(*) AS n FROM guess g JOIN split s ON g.doc_id = s.lang || ':' || s.line WHERE part <> 'train' GROUP BY 1, 2"""
)
def lang_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions on lines that the profiles weren't trained on."""
    return L.confusion(L.held_out(written(L.split_examples(_lines(spark, sf_dir)))))


# Encodings and media types

_LABELS = " Latin1 |utf8|SJIS|windows-874|oops|ISO-8859-8|ascii|UTF-16|csisolatin9|koi8-ru".split("|")


@_query("SELECT * FROM (VALUES (' Latin1 ', 'cp1252'), ('utf8', 'utf-8'), ('SJIS', 'shift_jis'), ('windows-874', 'iso8859-11'), ('oops', 'utf-8'), ('ISO-8859-8', 'ISO-8859-8'), ('ascii', 'cp1252'), ('UTF-16', 'utf-16-le'), ('csisolatin9', 'iso8859-15'), ('koi8-ru', 'koi8-u')) AS t(label, encoding)")
def encoding_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _LABELS], "label string").select("label", E.encoding_label("label").alias("encoding"))


@_query("SELECT doc_id, md5(text) AS utf8, md5(text) AS utf16, md5(regexp_replace(text, '[^\\x00-\\x7F\\xA0-\\xFF]', '', 'g')) AS latin FROM documents")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin = F.regexp_replace("text", r"[^\x00-\x7F\xA0-\xFF]", "")
    bom = lambda mark, data: F.concat(F.unhex(F.lit(mark)), data)
    return _docs(spark, sf_dir).select(
        "doc_id",
        _hash(E.decoded(bom("EFBBBF", F.encode("text", "UTF-8")))).alias("utf8"),
        _hash(E.decoded(bom("FFFE", F.encode("text", "UTF-16LE")), "utf-16-le")).alias("utf16"),
        _hash(E.decoded(F.encode(latin, "ISO-8859-1"), "cp1252")).alias("latin"),
    )


@_query(
    """SELECT 'page' AS kind, page_id AS id, CASE WHEN lower(html[:14]) = '<!doctype html' THEN 'text/html' END AS mime FROM pages
    UNION ALL SELECT 'document', doc_id, CASE WHEN octet_length(encode(text)) - octet_length(encode(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g'))) > floor(octet_length(encode(text)) * 0.05::DOUBLE) THEN 'application/octet-stream' ELSE 'text/plain' END FROM documents"""
)
def detect_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), E.mime_of("html").alias("mime"))
    return pages.union(_docs(spark, sf_dir).select(F.lit("document"), "doc_id", E.mime_of("text")))


@_query("SELECT doc_id, CASE WHEN regexp_full_match(text, '[\\x00-\\x7F]*') THEN 'cp1252' ELSE 'utf-8' END AS utf8, 'utf-16-le' AS utf16, 'iso8859-7' AS meta FROM documents")
def detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.concat(F.lit('<!doctype html><meta charset="greek">'), F.col("text"))
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    return _docs(spark, sf_dir).select("doc_id", E.encoding_of("text").alias("utf8"), E.encoding_of(wide).alias("utf16"), E.encoding_of(meta, from_html_meta=True).alias("meta"))


# HTTP and archives


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", "url", "html")


@_query("SELECT page_id, 200 AS status, 'OK' AS reason, 'text/html' AS content_type, 'utf-8' AS charset, url AS location, md5(html) AS h FROM pages")
def http_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nLocation: other\r\nX-Long: a\r\n b\r\nLocation: "), F.col("url"), F.lit("\r\n\r\n"))
    m = _pages(spark, sf_dir).select("page_id", P.parse_http(F.concat(head, F.col("html"))).alias("m"))
    return m.select("page_id", "m.status", "m.reason", "m.content_type", "m.charset", A.header_value("location", "m.headers").alias("location"), _hash("m.body").alias("h"))


@_query("SELECT page_id, md5(html) AS h, ((octet_length(encode(html)) + 99) // 100)::INTEGER AS chunks FROM pages")
def http_dechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("html", "UTF-8")
    parts = F.transform(F.sequence(F.lit(1), F.octet_length("html"), F.lit(100)), lambda i: F.substring(data, i, 100))
    chunk = lambda p: F.concat(F.encode(F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(";x=y\r\n")), "UTF-8"), p, F.lit(b"\r\n"))
    body = F.concat(F.aggregate(F.transform(parts, chunk), F.lit(b""), lambda a, x: F.concat(a, x)), F.lit(b"0\r\n\r\n"))
    return _pages(spark, sf_dir).withColumn("body", body).select("page_id", _hash(P.dechunk("body")).alias("h"), F.size(P.http_chunks("body")).alias("chunks"))


def _deflated(raw: bool) -> Callable[[Column], Column]:
    @F.arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        out = [zlib.compress(x) for x in data.to_pylist()]
        return pa.array([x[2:-4] if raw else x for x in out], pa.binary())

    return run


@_query("SELECT page_id, md5(html) AS gz, md5(html) AS zlib, md5(html) AS raw, md5(html) AS plain FROM pages")
def http_decode_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("html", "UTF-8")
    return _pages(spark, sf_dir).select(
        "page_id",
        _hash(P.decode_content(P.gzipped(P.gzipped(data)), "x-gzip", "gzip")).alias("gz"),
        _hash(P.decode_content(_deflated(False)(data), "deflate")).alias("zlib"),
        _hash(P.decode_content(_deflated(True)(data), "identity", "deflate")).alias("raw"),
        _hash(P.decode_content(data, "none, identity")).alias("plain"),
    )


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request and a response for each page, as rows to write."""
    pages = _pages(spark, sf_dir)
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
    uri = pair("WARC-Target-URI", F.col("url"))
    page = pair("X-Page", F.col("page_id").cast("string"))
    request = pages.select(F.lit("request").alias("warc_type"), F.array(uri, page, pair("x-page", "second")).alias("headers"), F.lit(True).alias("is_http"), F.lit("GET / HTTP/1.1").alias("http_status_line"), F.array(pair("Host", "h")).alias("http_headers"), F.lit(b"").alias("body"))
    mime = "text/html"
    head = F.array(pair("Content-Type", mime + "; charset=utf-8"), pair("Last-Modified", "Wed, 21 Oct 2015 07:28:00 GMT"))
    response = pages.select(F.lit("response").alias("warc_type"), F.array(uri, page).alias("headers"), F.lit(True).alias("is_http"), F.lit("HTTP/1.1 404 Not Found").alias("http_status_line"), head.alias("http_headers"), F.encode("html", "UTF-8").alias("body"))
    return request.unionByName(response)


def _written_archive(spark: SparkSession, sf_dir: str, compression: str = "gzip", checksum: bool = False) -> str:
    A.register(spark)
    path = shared_dir(spark)
    _archive(spark, sf_dir).coalesce(max(4, spark.sparkContext.defaultParallelism)).write.format("warc").option("compression", compression).option("checksum", str(checksum).lower()).mode("append").save(path)
    return path


def _read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.format("warc").options(**options).load(path)


@_query(
    """SELECT page_id, 'response' AS warc_type, 404 AS status, 'Not' AS reason, 'text/html' AS content_type, 'utf-8' AS charset, TIMESTAMP '2015-10-21 07:28:00' AS last_modified, url, octet_length(encode(html)) AS content_length, md5(html) AS h FROM pages
    UNION ALL SELECT page_id, 'request', 0, NULL, NULL, NULL, NULL, url, 0, md5('') FROM pages"""
)
def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, _written_archive(spark, sf_dir))
    page = A.header_value("X-Page", which="first").cast("long")
    return r.select(page.alias("page_id"), "warc_type", F.coalesce("http_status", F.lit(0)).alias("status"), F.col("http_reason").alias("reason"), F.col("http_content_type").alias("content_type"), F.col("http_charset").alias("charset"), F.col("http_last_modified").cast("timestamp_ntz").alias("last_modified"), A.header_value("WARC-Target-URI").alias("url"), "content_length", _hash("body").alias("h"))


@_query("SELECT page_id, md5(html) AS h FROM pages")
def warc_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, _written_archive(spark, sf_dir, "lz4"), pushdown="true").where(F.col("warc_type") == "response")
    return r.select(A.header_value("x-page").cast("long").alias("page_id"), _hash("body").alias("h"))


@_query("SELECT page_id FROM pages WHERE octet_length(encode(html)) + 112 BETWEEN 1000 AND 5000")
def warc_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths before HTTP parsing: 112 bytes of response headers."""
    r = _read(spark, _written_archive(spark, sf_dir, "uncompressed"), parse_http="false", split_bytes="200000", pushdown="true").where("content_length >= 1000 and content_length <= 5000")
    return r.select(A.header_value("X-Page").cast("long").alias("page_id"))


@_query("SELECT page_id, page_id::VARCHAR AS first, 'second' AS last, 2 AS n FROM pages")
def warc_header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, _written_archive(spark, sf_dir, "zstd"), record_types="request")
    every = A.header_value("X-PAGE", which="all")
    return r.select(every[0].cast("long").alias("page_id"), A.header_value("X-PAGE", which="first").alias("first"), A.header_value("X-PAGE").alias("last"), F.size(every).alias("n"))


@_query("SELECT 'OK' AS status, 2 * count(*) AS n FROM pages HAVING count(*) > 0")
def warc_check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.check_report(_read(spark, _written_archive(spark, sf_dir, checksum=True), parse_http="false"))


@_query("SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'FAIL' WHEN page_id % 10 = 1 THEN 'NO_DIGEST' ELSE 'OK' END AS status FROM pages")
def digest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("page_id") % 3 == 0, P.digest("html", "sha256")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("md5:"), _hash("html"))).otherwise(P.digest("html"))
    given = F.when(F.col("page_id") % 10 == 0, P.digest(F.concat("html", F.lit("x")))).when(F.col("page_id") % 10 != 1, own)
    return _pages(spark, sf_dir).select("page_id", A.digest_status("html", given).alias("status"))


@_query("SELECT page_id, true AS fits FROM pages UNION ALL SELECT page_id, true FROM pages")
def cdxj_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every offset leads back to its record: the index against the records found at its offsets."""
    path = _written_archive(spark, sf_dir)
    records = _read(spark, path)
    sizes = A.match_files(spark, path).withColumnRenamed("path", "filename")
    found = A.index(records, sizes, ("offset", "length", "filename", "http:status", "X-Page"))

    @F.arrow_udf("boolean")
    def fits(name: pa.Array, pos: pa.Array, length: pa.Array, page: pa.Array) -> pa.Array:
        out = []
        for f, p, n, x in zip(name.to_pylist(), pos.to_pylist(), length.to_pylist(), page.to_pylist(), strict=True):
            with A.open_file(f) as file:
                file.seek(p)
                member = next(A.C.members(A.io.BytesIO(file.read(n)), "gzip"))[1]
            out.append(f"X-Page: {x}\r\n".encode() in member and member.endswith(b"\r\n\r\n"))
        return pa.array(out, pa.bool_())

    j = found.withColumn("page", F.get_json_object("json", "$.X-Page"))
    pages = records.select("filename", "stream_pos", A.header_value("X-Page", which="first").alias("first"))
    return j.join(pages, ["filename", "stream_pos"]).select(F.col("first").cast("long").alias("page_id"), fits("filename", "stream_pos", "length", "first").alias("fits"))


@_query("SELECT page_id, n AS content_length, CASE WHEN n <= 3000 THEN n ELSE 0 END AS body_length FROM (SELECT page_id, octet_length(encode(html)) + 112 AS n FROM pages)")
def warc_keep_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-long records stay without their body; lengths before HTTP parsing."""
    r = _read(spark, _written_archive(spark, sf_dir), parse_http="false", record_types="response", max_content_length="3000", always_keep_meta="true", shuffle_files="true")
    return r.select(A.header_value("X-Page").cast("long").alias("page_id"), "content_length", F.octet_length("body").cast("long").alias("body_length"))


@_query("SELECT page_id, md5(html) AS h, 'OK' AS block, 'OK' AS payload FROM pages")
def warc_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and digests of an archive that was written as gzip and again as Zstandard."""
    source, target = _written_archive(spark, sf_dir, checksum=True), shared_dir(spark)
    A.recompress(spark, source, target, "zstd")
    raw = _read(spark, target, parse_http="false", record_types="response", invalid_header="error", retries="2").select("record_id", A.digest_status("body", A.header_value("WARC-Block-Digest")).alias("block"))
    parsed = _read(spark, target, record_types="response")
    state = A.digest_status("body", A.header_value("WARC-Payload-Digest")).alias("payload")
    return parsed.select("record_id", A.header_value("X-Page").cast("long").alias("page_id"), _hash("body").alias("h"), state).join(raw, "record_id").drop("record_id")


@_query("SELECT page_id, ['mismatch', 'missing', 'malformed', 'unknown algorithm', 'bad encoding', NULL][page_id % 6 + 1] AS reason FROM pages")
def digest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 6
    given = F.when(kind == 0, P.digest(F.concat("html", F.lit("x")))).when(kind == 2, "sha1").when(kind == 3, "crc32:AAAA").when(kind == 4, "md5:?").when(kind == 5, P.digest("html", "sha512"))
    return _pages(spark, sf_dir).select("page_id", A.digest_reason("html", given).alias("reason"))


@_query("SELECT page_id, 'host: h|x-page: ' || page_id || '|url: ' || url AS put, 'host: h|a b: 1 2|url: ' || url AS edited, page_id % 2 = 0 AS has, page_id::VARCHAR AS last FROM pages")
def header_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers set, removed, appended with clean-up, tested and mapped, natively."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    url, page = pair("url", F.col("url")), F.col("page_id").cast("string")
    rows = _pages(spark, sf_dir).withColumn("hs", F.array(pair("host", F.lit("h")), pair("x-page", F.lit("old")), url))
    shown = lambda hs: F.array_join(F.transform(hs, lambda h: F.concat(h["key"], F.lit(": "), h["value"])), "|")
    short = F.filter("hs", lambda h: h["key"] != "url")
    edited = F.concat(A.with_appended(F.lit("a: b"), F.lit("1\r\n2"), A.without_header("X-PAGE", short)), F.array(url))
    odd = F.when(F.col("page_id") % 2 == 0, F.col("hs")).otherwise(A.without_header("x-page", "hs"))
    last = A.header_map(A.with_appended("X-Page", page, "hs"))["x-page"]
    return rows.select("page_id", shown(A.with_header("X-Page", page, "hs")).alias("put"), shown(edited).alias("edited"), A.has_header("X-page", odd).alias("has"), last.alias("last"))


# HTML

_ENTITIES = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@_query("SELECT page_id, trim(regexp_replace(" + _ENTITIES.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + ", '\\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", H.html_title("html").alias("title"))


@_query(
    "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS text FROM pages) "
    "SELECT page_id, " + _ENTITIES.format("href") + " AS href, " + _ENTITIES.format("text") + " AS text FROM l"
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.inline(H.html_links("html")))


@_query(
    """WITH t AS (
        SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages
    ), b AS (
        SELECT page_id, regexp_extract_all(html, '<p>(?:<b>)?|<footer>') AS x FROM pages
    ), o AS (
        SELECT page_id, list_sum(list_transform(range(1, len(x) + 1), lambda i: least(3, len(list_filter(x[1:i - 1], lambda y: y = '<p><b>'))) + (x[i] = '<p><b>')::INTEGER))::BIGINT AS n FROM b
    )
    SELECT page_id, tag, count(*) AS n FROM t WHERE tag <> 'b' GROUP BY 1, 2 UNION ALL SELECT page_id, 'b', n FROM o WHERE n > 0"""
)
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements by tag; an unclosed b is opened again in each block behind it, up to three at once."""
    return H.html_nodes(_pages(spark, sf_dir), elements_only=True).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@_query("SELECT page_id, " + _ENTITIES.format("regexp_extract(html, '(?s)<article><h1>([^<]*)</h1>', 1)") + " AS heading, 1 AS n, true AS any FROM pages")
def html_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.html_select("html", "body > article > h1:first-child")
    return _pages(spark, sf_dir).withColumn("f", found).select("page_id", F.col("f")[0]["text"].alias("heading"), F.size("f").alias("n"), H.html_matches("html", "nav li > a[href^='/'], main").alias("any"))


@_query("SELECT page_id, unnest(regexp_extract_all(html, '<div class=\"([^\"]*)\"', 1)) AS cls, 'ad' AS first FROM pages")
def html_class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = H.html_nodes(_pages(spark, sf_dir), elements_only=True).where(F.try_element_at("attrs", F.lit("class")).isNotNull())
    return nodes.select("page_id", F.element_at("attrs", "class").alias("cls"), H.class_list("attrs")[0].alias("first"))


@_query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, 'utf-8' AS charset FROM pages")
def html_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda s, a: H.html_select_one("html", s)["attrs"][a]
    return _pages(spark, sf_dir).select("page_id", one("html", "lang").alias("lang"), one("head > meta[charset]", "charset").alias("charset"))


_FLAT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<!--.*?-->', '', 'g'), '</?(a|b)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g')"


@_query("SELECT page_id, md5(trim(regexp_replace(" + _ENTITIES.format(_FLAT) + ", '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS h FROM pages")
def extract_plain_text_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", _hash(extract_plain_text("html", preserve_formatting=False)).alias("h"))


def _steps(text: str, *rules: tuple[str, str]) -> str:
    """SQL that applies (pattern, SQL of the replacement) one after another."""
    for pattern, to in rules:
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    return text


_NL, _GAP = "chr(10)", "chr(2)"
_BODY = _steps("regexp_replace(html, '(?s)^.*?<body>', '')", ("(?s)<!--.*?-->", "''"), ("[ \\t\\n\\x0B\\f\\r]+", "' '"))
_GAPS = (("\\n*\\x02[\\n\\x02]*", _GAP), ("\\n+", _NL))


def _layout(apart: str, bullet: str) -> str:
    """SQL of a page's text with blocks on lines of their own and an empty line round the tags ``apart``."""
    lines = _steps(
        _BODY, ("</?(a|b)( [^>]*)?>", "''"), (" ?<br> ?</article> ?", _GAP), (" ?<br> ?", _NL), (f" ?</?({apart})> ?", _GAP), (" ?<li> ?", f"{_NL} || chr(1)"),
        (" ?</?(div|article|footer|ul|li|nav|h1|body|html)( [^>]*)?> ?", _NL), *_GAPS,
    )
    return "trim(" + _ENTITIES.format(f"replace(replace({lines}, {_GAP}, {_NL} || {_NL}), chr(1), '{bullet}')") + f", {_NL})"


def _minimal() -> str:
    """SQL of a page's paragraphs, headings and lists as HTML, with links."""
    out = _steps(_BODY, ("</?b>", "''"), (" ?<br> ?</article> ?", "'<br></p>'"), (" ?<br> ?<p> ?", "'<br></p><p>'"), (" ?</?(div|article|footer|nav|body|html)( [^>]*)?> ?", _NL))
    for tag, to in (("<p>", f"{_GAP} || '<p>'"), ("</p>", f"'</p>' || {_GAP}"), ("<h1>", f"{_GAP} || '<h1>'"), ("</h1>", f"'</h1>' || {_GAP}"), ("<ul>", f"{_NL} || '<ul>' || {_NL}"), ("</ul>", f"{_NL} || '</ul>' || {_NL}"), ("<li>", f"{_NL} || '  <li>'")):
        out = f"replace({out}, '{tag}', {to})"
    out = _steps(out, *_GAPS)
    for mark, to in ((_GAP, f"{_NL} || {_NL}"), ("'&copy;'", "'©'"), ("'&middot;'", "'·'")):
        out = f"replace({out}, {mark}, {to})"
    return f"trim({out}, {_NL})"


@_query(f"SELECT page_id, {_layout('p|h1', '  • ')} AS text FROM pages")
def extract_plain_text_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", extract_plain_text("html").alias("text"))


@_query(f"SELECT page_id, {_minimal()} AS text FROM pages")
def extract_plain_text_minimal_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", extract_plain_text("html", preserve_formatting="minimal_html", links=True).alias("text"))


_MAIN = "regexp_replace(regexp_replace(html, '(?s)<nav>.*?</nav>', ' ', 'g'), '(?s)<footer>.*', ' ')"


_MAIN_TEXT = "trim(regexp_replace(" + _ENTITIES.format(_FLAT.replace("(html,", f"({_MAIN},", 1)) + ", '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@_query(f"SELECT page_id, md5({_MAIN_TEXT}) AS h FROM pages")
def extract_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", _hash(extract_plain_text("html", main_content=True, preserve_formatting=False)).alias("h"))


_FORM = '<ol><li>One<li><a href="/x?a&amp;b">Two</a></ol><form><input value="v"><input placeholder="p"><input type="hidden" value="h"><button>Go</button></form><img alt="pic">'


@_query(
    """SELECT options, replace(text, '/n', chr(10)) AS text FROM (VALUES ('plain', '  1. One/n  2. Two/npic'), ('bare', '  One/n  Two/npic'),
    ('links', '  1. One/n  2. Two     (/x?a&b)/npic'), ('forms', '  1. One/n  2. Two/n[ v ] [ p ] [ Go ]/npic')) AS t(options, text)"""
)
def extract_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = spark.createDataFrame([(_FORM,)], "html string")
    wanted = {"plain": {}, "bare": {"list_bullets": False}, "links": {"links": True}, "forms": {"form_fields": True}}
    out = None
    for name, options in wanted.items():
        row = page.select(F.lit(name).alias("options"), extract_plain_text("html", **options).alias("text"))
        out = row if out is None else out.union(row)
    return out


@_query(
    "SELECT page_id, trim(regexp_replace(" + _ENTITIES.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + ", '\\s+', ' ', 'g')) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, "
    f"len(regexp_extract_all(html, '<li>'))::INTEGER AS items, {_layout('p|h1', '  • ')} AS text, {_MAIN_TEXT} AS main FROM pages"
)
def html_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several facts of a page from one parse."""
    facts = H.html_many("html", title="title", lang=("attr", "html", "lang"), items=("count", "nav li"), text="text", main=("text", {"main_content": True, "preserve_formatting": False}))
    return _pages(spark, sf_dir).select("page_id", facts.alias("f")).select("page_id", "f.*")


@_query("SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS url, md5(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM pages")
def text_ascii_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", H.ascii_lower("url").alias("url"), _hash(H.ascii_lower("html")).alias("h"))


@_query(f"SELECT page_id, {_layout('p', '')} AS text FROM pages")
def html_inner_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", H.html_inner_text("html").alias("text"))


@_query(
    f"""WITH documents AS (SELECT doc_id, text, lang FROM main.documents UNION ALL SELECT -1 - page_id, {_MAIN_TEXT}, NULL FROM pages), {_RANKS}
    SELECT predicted AS lang, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM guess JOIN documents USING (doc_id) WHERE doc_id < 0 GROUP BY 1"""
)
def page_language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by detected language of their main content."""
    # a field of a struct, as a function that is fed by another one directly is run with it again for each further use of the text
    text = H.html_many("html", text=("text", {"main_content": True, "preserve_formatting": False}))["text"]
    found = _pages(spark, sf_dir).select(text.alias("text")).select(L.detect("text", profiles(spark, sf_dir))["lang"].alias("lang"), F.length("text").alias("n"))
    return found.groupBy("lang").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"))


@_query("SELECT page_id, page_id % 7 = 0 AS failed FROM pages")
def try_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and overruns cost a row, not the job."""

    def risky(page: str, fail: bool) -> str:
        if fail:
            raise ValueError("bad page")
        return extract_text(page)

    found = guarded(risky, "string", timeout=60)(F.col("html"), F.col("page_id") % 7 == 0)
    return _pages(spark, sf_dir).withColumn("r", found).select("page_id", (F.col("r.error") == "ValueError: bad page").alias("f"), "r.value").select("page_id", F.coalesce("f", F.lit(False)).alias("failed"))


# Sinks


@_query("""SELECT doc_id::VARCHAR AS _id, '{"index":{"_index":"docs","_id":"' || doc_id || '"}}' AS action, '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS source FROM documents""")
def bulk_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "lang", "n_chars", F.lit(1).alias("_private"))
    return A.bulk_actions(docs, "docs")


@_query("SELECT md5(line) AS h, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    _docs(spark, sf_dir).select("text").write.text(path)
    return A.read_text(spark, path).groupBy(_hash("value").alias("h")).agg(F.count("*").alias("n"))


@_query("SELECT lang, page_id % 2 AS side, count(*) AS n FROM (SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages) GROUP BY 1, 2")
def streamed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over page files, counted as it comes, and read back when it has caught up."""
    from webloom.streaming.pages import count_languages

    return count_languages(prepare(spark), f"{sf_dir}/pages.parquet", shared_dir(spark))

