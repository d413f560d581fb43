"""Registered queries, with their SQL, of what the catalogue's main queries don't reach: modes, look-ups, edits and guards."""

from __future__ import annotations

import io
import time

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import dom
from webloom.functions import encoding as E
from webloom.functions import html as H
from webloom.functions import http as P
from webloom.functions import language as L
from webloom.functions.extract import extract_plain_text
from webloom.functions.guards import guarded, retrying
from webloom.plans.catalogue import _ENTITIES, _FLAT, _archive, _docs, _hash, _pages, _query, _read, _table, _written_archive
from webloom.session import dealt, prepare, shared_dir
from webloom.sources import archive as A
from webloom.sources import codecs as C
from webloom.sources import warc as W

_LI = "regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)"
_N = "len(regexp_extract_all(html, '<li>'))"

# Archives


@_query(
    """SELECT page_id, ['uncompressed', 'gzip', 'lz4', 'zstd'][page_id % 4 + 1] AS codec, CASE WHEN page_id // 4 % 2 = 1 THEN 1 ELSE 3 END::INTEGER AS strict, 3 AS lenient,
    page_id // 4 % 2 = 1 AS damaged, 0 AS lf_strict, 1 AS lf_lenient, md5(html) AS h FROM pages"""
)
def archive_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small archives of three versions, with junk in half of them, in each codec: sniffed, read strictly, leniently and with errors."""
    fields = [("codec", T.StringType()), ("strict", T.IntegerType()), ("lenient", T.IntegerType()), ("damaged", T.BooleanType()), ("lf_strict", T.IntegerType()), ("lf_lenient", T.IntegerType()), ("h", T.StringType())]

    def one(page: int, html: bytes) -> dict:
        import hashlib

        codec = (C.PLAIN, C.GZIP, C.LZ4, C.ZSTD)[page % 4]
        raw = [v + b"\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(html) + html + b"\r\n\r\n" for v in (b"WARC/1.0", b"WARC/1.1", b"WARC/0.18")]
        if page // 4 % 2:
            raw.insert(1, b"no record\r\n")
        data = b"".join(C.compress(x, codec) for x in raw)
        lf = b"WARC/1.0\nWARC-Type: resource\nContent-Length: %d\n\n" % len(html) + html + b"\n\n"
        count = lambda d, **o: sum(1 for _ in W.read_records(io.BytesIO(d), **o))
        try:
            count(data, invalid="error")
            damaged = False
        except C.StreamError:
            damaged = True
        (last,) = W.read_records(io.BytesIO(lf), strict=False)
        return {"codec": C.codec_of_bytes(data[:8]), "strict": count(data), "lenient": count(data, strict=False), "damaged": damaged, "lf_strict": count(lf), "lf_lenient": count(lf, strict=False), "h": hashlib.md5(last.body).hexdigest()}

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in fields]))
    def read(pages: pa.Array, bodies: pa.Array) -> pa.Array:
        kinds = {"IntegerType()": pa.int32(), "BooleanType()": pa.bool_(), "StringType()": pa.string()}
        return pa.array([one(p, b) for p, b in zip(pages.to_pylist(), bodies.to_pylist(), strict=True)], pa.struct([(n, kinds[repr(t)]) for n, t in fields]))

    return _pages(spark, sf_dir).select("page_id", read("page_id", F.encode("html", "UTF-8")).alias("r")).select("page_id", "r.*")


@_query("SELECT page_id, 'response' AS warc_type, md5(html) AS h FROM pages UNION ALL SELECT page_id, 'request', md5('') FROM pages")
def warc_read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of files as input, as it comes from a listing or a stream."""
    path = _written_archive(spark, sf_dir, "zstd")
    return A.read_files(A.match_files(spark, path)).select(A.header_value("X-Page", which="first").cast("long").alias("page_id"), "warc_type", _hash("body").alias("h"))


@_query("SELECT page_id, 'response' AS warc_type, md5(html) AS h FROM pages UNION ALL SELECT page_id, 'request', md5('') FROM pages")
def warc_record_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record again, by its file and offset."""
    path = _written_archive(spark, sf_dir)

    @F.arrow_udf("struct<page:string,kind:string,body:binary>")
    def at(names: pa.Array, offsets: pa.Array) -> pa.Array:
        found = A.records_at(zip(names.to_pylist(), offsets.to_pylist(), strict=True))
        rows = [{"page": W.first_header(r.headers, "X-Page"), "kind": r.warc_type, "body": r.body} for r in found]
        return pa.array(rows, pa.struct([("page", pa.string()), ("kind", pa.string()), ("body", pa.binary())]))

    r = _read(spark, path, body="false").select(at("filename", "stream_pos").alias("r"))
    return r.select(F.col("r.page").cast("long").alias("page_id"), F.col("r.kind").alias("warc_type"), _hash("r.body").alias("h"))


def odd_page(r: W.Record) -> bool:
    return int(W.first_header(r.headers, "X-Page")) % 2 == 1


def _resources(spark: SparkSession, sf_dir: str) -> str:
    """A resource record for each page: three versions, every second concurrent to another, every tenth with a wrong digest."""
    A.register(spark)
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    page = F.col("page_id")
    digest = F.when(page % 10 == 0, P.digest(F.concat("html", F.lit("x")))).otherwise(P.digest("html"))
    always = F.array(pair("X-Page", page.cast("string")), pair("WARC-Block-Digest", digest))
    heads = F.when(page % 2 == 0, F.concat(always, F.array(pair("WARC-Concurrent-To", F.lit("<urn:x>"))))).otherwise(always)
    version = F.element_at(F.array(*[F.lit(f"WARC/{v}") for v in ("1.0", "1.1", "0.18")]), (page % 3 + 1).cast("int"))
    path = shared_dir(spark)
    _pages(spark, sf_dir).select(F.lit("resource").alias("warc_type"), version.alias("warc_version"), heads.alias("headers"), F.encode("html", "UTF-8").alias("body")).write.format("warc").mode("append").save(path)
    return path


@_query("SELECT page_id, ['WARC/1.0', 'WARC/1.1', 'WARC/0.18'][page_id % 3 + 1] AS version, page_id % 2 = 0 AS concurrent, true AS digest, false AS http FROM pages")
def warc_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, _resources(spark, sf_dir))
    return r.select(A.header_value("X-Page").cast("long").alias("page_id"), F.col("warc_version").alias("version"), A.has_header("warc-concurrent-to").alias("concurrent"), A.has_header("WARC-Block-Digest").alias("digest"), F.col("is_http").alias("http"))


@_query("SELECT page_id, octet_length(encode(html)) AS n FROM pages WHERE page_id % 10 <> 0")
def warc_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose block digest doesn't hold are passed over by the reader."""
    return _read(spark, _resources(spark, sf_dir), verify_digests="true").select(A.header_value("X-Page").cast("long").alias("page_id"), F.col("content_length").alias("n"))


@_query("SELECT page_id FROM pages WHERE page_id % 2 = 1")
def warc_func_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, _resources(spark, sf_dir), func_filter="webloom.plans.details:odd_page").select(A.header_value("X-Page").cast("long").alias("page_id"))


@_query("SELECT md5(line) AS h, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '[^\\x00-\\x7F\\xA0-\\xFF]', '', 'g'), chr(10))) AS line FROM documents) GROUP BY 1")
def text_lines_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files in another encoding, read in ranges."""
    path = shared_dir(prepare(spark))
    texts = _docs(spark, sf_dir).select(F.encode(F.regexp_replace("text", r"[^\x00-\x7F\xA0-\xFF]", ""), "ISO-8859-1").alias("raw"))

    def save(parts):
        fs, base = A.file_system(path)
        fs.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId()}.txt"  # another attempt of the task writes the same file
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            for b in parts:
                for raw in b.column("raw").to_pylist():
                    f.write((raw or b"") + b"\n")
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int32())})

    texts.mapInArrow(save, "n int").count()
    return A.read_text(spark, path, "iso-8859-1", split_bytes=100_000).groupBy(_hash("value").alias("h")).agg(F.count("*").alias("n"))


# HTML

_NEIGHBOUR = pa.struct([("i", pa.int32()), ("text", pa.string()), ("next", pa.string()), ("prev", pa.string()), ("up", pa.string()), ("down", pa.string())])


@_query(
    "SELECT page_id, i::INTEGER AS i, text, lead(text) OVER w AS next, lag(text) OVER w AS prev, 'ul' AS up, 'a' AS down FROM (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS text "
    f"FROM (SELECT page_id, list_transform({_LI}, lambda x: {_ENTITIES.format('x')}) AS l FROM pages)) WINDOW w AS (PARTITION BY page_id ORDER BY i)"
)
def html_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def items(t: dom.Tree) -> list[dict]:
        return [{"i": n.index, "text": n.text, "next": n.next_element and n.next_element.text, "prev": n.prev_element and n.prev_element.text, "up": n.parent.tag, "down": n.first_child.tag} for n in t.body.get_elements_by_tag_name("li")]

    found = H._on_tree(items, "array<struct<i:int,text:string,next:string,prev:string,up:string,down:string>>", pa.list_(_NEIGHBOUR))("html")
    return _pages(spark, sf_dir).select("page_id", F.inline(found))


@_query(
    "SELECT page_id, " + _ENTITIES.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)") + f" AS ad, {_N}::INTEGER AS items, 1 AS metas, NULL::VARCHAR AS by_id, "
    "len(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>', ''), '<(ul|nav|li|h1|footer|div|br|article|p)[ >]'))::BIGINT AS blocks FROM pages"
)
def html_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By class, tag, attribute and id, and block elements on the table of nodes."""
    pages = _pages(spark, sf_dir)
    blocks = H.html_nodes(pages, elements_only=True).where(F.col("tag").isin(*H.BLOCK_ELEMENTS)).groupBy("page_id").agg(F.count("*").alias("blocks"))
    found = pages.select("page_id", H.html_by_class("html", "ad")[0]["text"].alias("ad"), F.size(H.html_by_tag("html", "LI")).alias("items"), F.size(H.html_by_attr("html", "charset", "UTF-8", True)).alias("metas"), H.html_by_id("html", "none")["text"].alias("by_id"))
    return found.join(blocks, "page_id")


def _edit(t: dom.Tree) -> None:
    t.body.query_selector("nav").decompose()
    p = dom.create_element("p")
    p.text = "inserted & kept"
    t.body.query_selector("footer").before(p)
    t.body.query_selector("div.ad").replace_class("ad", "note")
    h1 = t.body.query_selector("h1")
    h1.prepend(dom.create_text("New: "))
    h1.attrs["id"] = "top"


_EDITED = _FLAT.replace("(html,", "(regexp_replace(replace(replace(html, '<h1>', '<h1>New: '), '<footer>', '<p>inserted &amp; kept</p><footer>'), '(?s)<nav>.*?</nav>', ' ', 'g'),", 1)


@_query("SELECT page_id, trim(regexp_replace(" + _ENTITIES.format(_EDITED) + ", '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text, 1 AS notes, 1 AS tops FROM pages")
def html_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements removed, made, put elsewhere and changed, and the page written and parsed again."""
    edited = _pages(spark, sf_dir).select("page_id", H.html_edit("html", _edit).alias("html"))
    facts = H.html_many("html", text=("text", {"preserve_formatting": False}), notes=("count", "div.note"), tops=("count", "h1#top"))
    return edited.select("page_id", facts.alias("f")).select("page_id", "f.*")


@_query(f"SELECT page_id, (2 + 2 * {_N})::INTEGER AS starts, (2 + {_N})::INTEGER AS ends, 3 AS deepest FROM pages")
def html_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end events below the first nav element."""

    def events(t: dom.Tree) -> dict:
        starts, ends = [], []
        dom.traverse(t.body.query_selector("nav"), lambda n, d: starts.append(d), lambda n, d: ends.append(d), elements_only=True)
        return {"starts": len(starts), "ends": len(ends), "deepest": max(starts)}

    found = H._on_tree(events, "struct<starts:int,ends:int,deepest:int>", pa.struct([("starts", pa.int32()), ("ends", pa.int32()), ("deepest", pa.int32())]))
    return _pages(spark, sf_dir).select("page_id", found("html").alias("r")).select("page_id", "r.*")


@_query(
    f"SELECT page_id, {_ENTITIES.format(f'({_LI})[-1]')} AS last, (({_N} + 1) // 2)::INTEGER AS every_second, 'nav' AS closest, ({_N} > 1)::BOOLEAN AS has_next, "
    f"{_N}::INTEGER AS forwarded, NULL::VARCHAR AS named FROM pages"
)
def html_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [("last", "string"), ("every_second", "int"), ("closest", "string"), ("has_next", "boolean"), ("forwarded", "int"), ("named", "string")]

    def facts(t: dom.Tree) -> dict:
        items = t.body.get_elements_by_tag_name("li")
        named = items.named_item("x")
        return {"last": items[-1].text, "every_second": len(items[::2]), "closest": items[0].closest("nav, body").tag, "has_next": items[0].next_element is not None, "forwarded": len(items.query_selector_all("a[href]")), "named": named and named.text}

    arrow = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    found = H._on_tree(facts, f"struct<{','.join(f'{n}:{k}' for n, k in kinds)}>", pa.struct([(n, arrow[k]) for n, k in kinds]))
    return _pages(spark, sf_dir).select("page_id", found("html").alias("r")).select("page_id", "r.*")


@_query(f"SELECT page_id, (({_N} + 1) // 2)::INTEGER AS odd, ({_N} - 1)::INTEGER AS followers, {_N}::INTEGER AS links, 1 AS first_h, 0 AS none, 1 AS ad FROM pages")
def css_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {"odd": "li:nth-child(2n+1) > a", "followers": "nav li + li", "links": "ul li:not(.x) a[href^='/']", "first_h": "article > h1:first-child:not(p)", "none": "footer a, main, #top", "ad": "nav ~ div[class~=ad]:has(+ article)"}
    return _pages(spark, sf_dir).select("page_id", H.html_many("html", **{k: ("count", s) for k, s in counts.items()}).alias("r")).select("page_id", "r.*")


# Extraction


@_query("SELECT page_id, 'Page' || chr(10) || chr(10) || 'Url' || chr(10) || chr(10) || page_id || url AS cells, page_id::VARCHAR AS root, '  1. ' || page_id || chr(10) || '    • in ' || url AS lists, 'x' || chr(10) || '  ' || page_id AS pre FROM pages")
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells, the main root, nested lists and preformatted text."""
    page, url = F.col("page_id").cast("string"), F.replace("url", F.lit("&"), F.lit("&amp;"))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    rows = _pages(spark, sf_dir).select(
        "page_id",
        cat("<table><tr><th>Page<th><p>Url<tr><td>", page, "<td>", url, "</table>").alias("t"),
        cat("<body><div>around</div><div role=main><p>", page, "</div><div>behind</div>").alias("r"),
        cat("<ol><li>", page, "<ul><li>in ", url, "</ul></ol>").alias("l"),
        cat("<pre>x\n  ", page, "</pre>").alias("p"),
    )
    return rows.select("page_id", extract_plain_text("t").alias("cells"), extract_plain_text("r", main_content=True).alias("root"), extract_plain_text("l").alias("lists"), extract_plain_text("p").alias("pre"))


#: (attributes, whether a block with them is main content) of the rules that decide by names, roles and visibility.
_RULES = [
    ('id="sidebar"', False), ('id="post-content"', True), ('id="breadcrumbs"', False), ('class="social-links"', False), ('id="footer"', False), ('id="cookie-consent"', False), ('id="related-posts"', False),
    ('id="modal"', False), ('id="search-box"', False), ('id="gallery"', False), ('class="login"', False), ('class="logo"', False), ('class="sponsored"', False), ('class="hidden"', False), ('id="x" style="display: none"', False),
    ('aria-hidden="true"', False), ("hidden", False), ('id="x" role="navigation"', False), ('rel="author"', False), ('itemprop="datePublished"', False), ('class="teaser-box"', True), ('class="pagination"', False), ('id="print-only"', False), ('id="intro"', True),
]


@_query("SELECT page_id, CASE WHEN [" + ", ".join(str(k).lower() for _, k in _RULES) + f"][page_id % {len(_RULES)} + 1] THEN 'before ' || page_id || ' behind' ELSE 'before behind' END AS text FROM pages")
def extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block in the middle of an article, with attributes that rule it in or out."""
    given = F.element_at(F.array(*[F.lit(a) for a, _ in _RULES]), (F.col("page_id") % len(_RULES) + 1).cast("int"))
    page = F.concat(F.lit("<body><main><article><section><p>before</p><div "), given, F.lit(">"), F.col("page_id").cast("string"), F.lit("</div><p>behind</p></section></article></main>"))
    return _pages(spark, sf_dir).select("page_id", extract_plain_text(page, main_content=True, preserve_formatting=False).alias("text"))


@_query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'text' ELSE rtrim('text ' || repeat('a', 20) || ' ' || repeat('b', page_id % 50)) END AS text FROM pages")
def extract_link_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists go that are mostly links, and stay where links are few of their text."""
    mostly = F.concat(F.lit("<ul><li><a href=x>"), F.repeat(F.lit("a"), 20), F.lit("</a> b</ul>"))
    few = F.concat(F.lit("<div>"), F.repeat(F.lit("a"), 20), F.lit(" "), F.expr("repeat('b', cast(page_id % 50 as int))"), F.lit("</div>"))
    page = F.concat(F.lit("<body><main><article><section><p>text</p>"), F.when(F.col("page_id") % 3 == 0, mostly).otherwise(few), F.lit("</section></article></main>"))
    return _pages(spark, sf_dir).select("page_id", F.trim(extract_plain_text(page, main_content=True, preserve_formatting=False)).alias("text"))


# Languages and encodings


@_query("SELECT doc_id, ['fi ' || lang || ' 1', doc_id::VARCHAR] AS lines FROM documents")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("ﬁ [["), F.col("lang"), F.lit("]] ①\n<doc id=1>\n"), F.col("doc_id").cast("string"), F.lit("\n</doc>"))
    return _docs(spark, sf_dir).select("doc_id", L.clean_lines(text).alias("lines"))


@_query("SELECT doc_id, true AS utf8, true AS utf16 FROM documents")
def detect_encoding_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts decoded by the encoding that is detected for them are the same again, null too; a mark that begins a text is its own, not one of the encoding."""
    same = lambda raw, **options: E.decoded(raw, E.encoding_of(raw), **options).eqNullSafe(F.col("text"))
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    return _docs(spark, sf_dir).select("doc_id", same(F.encode("text", "UTF-8"), strip_bom=False).alias("utf8"), same(wide).alias("utf16"))


# Guards


@_query("SELECT page_id, CASE page_id % 100 WHEN 7 THEN 'ExecutionTimeout' WHEN 9 THEN 'ValueError: no' END AS error, CASE WHEN page_id % 100 NOT IN (7, 9) THEN octet_length(encode(html))::BIGINT END AS n FROM pages")
def guard_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that take too long or fail have an error, and all others their value."""

    def slow(page: str, kind: int) -> int:
        if kind == 9:
            raise ValueError("no")
        end = time.monotonic() + (20 if kind == 7 else 0)
        while time.monotonic() < end:
            sum(range(1000))
        return len(page.encode())

    return dealt(_pages(spark, sf_dir), "page_id").select("page_id", guarded(slow, "long", timeout=2)("html", F.col("page_id") % 100).alias("r")).select("page_id", "r.error", F.col("r.value").alias("n"))


@_query("SELECT page_id, 20 AS items, (190 + 20 * page_id)::BIGINT AS total FROM pages")
def retried_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that break off at a place of each page's own, opened again behind their last item."""

    def read(page: int) -> dict:
        left = [2]

        def open_at(pos: int):
            for i in range(pos, 20):
                if i == page % 20 and left[0]:
                    left[0] -= 1
                    raise OSError(i)
                yield i

        got = [i + page for i in retrying(open_at, lambda i: i)]
        return {"items": len(got), "total": sum(got)}

    @F.arrow_udf("struct<items:int,total:long>")
    def streams(pages: pa.Array) -> pa.Array:
        return pa.array([read(p) for p in pages.to_pylist()], pa.struct([("items", pa.int32()), ("total", pa.int64())]))

    return _pages(spark, sf_dir).select("page_id", streams("page_id").alias("r")).select("page_id", "r.*")


# Sinks


@_query("""SELECT doc_id::VARCHAR AS _id, '{"update":{"_index":"docs","_id":"' || doc_id || '"}}' AS action, '{"doc":{"lang":"' || lang || '"}}' AS source FROM documents
    UNION ALL SELECT doc_id::VARCHAR, '{"delete":{"_index":"docs","_id":"' || doc_id || '"}}', NULL FROM documents""")
def bulk_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "lang")
    return A.bulk_actions(docs, "docs", op="update").unionByName(A.bulk_actions(docs, "docs", op="delete"))


@_query("SELECT doc_id::VARCHAR AS _id FROM documents")
def bulk_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that an endpoint took, which refuses every first attempt of a chunk with 429."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "lang")
    seen: set = set()

    def send(lines: list[str]) -> list[int]:
        n, key = len(lines) // 2, lines[0]
        if key in seen:
            return [201] * n
        seen.add(key)
        return [429] * n

    return A.send_bulk(A.bulk_actions(docs, "docs"), send, initial_backoff=0.01, chunk=300)
