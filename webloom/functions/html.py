"""Column and table functions over HTML pages.

Each page is parsed once per call; ``html_nodes`` turns pages into a table of nodes, on which
navigation is plain joins and filters.  A null page gives null, or no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import dom
from webloom.functions.dom import ELEMENT, Node, Tree
from webloom.functions.encoding import bytes_to_str, map_encoding
from webloom.functions.extract import extract_text, inner_text
from webloom.session import prepare

BLOCK_ELEMENTS = sorted(dom.BLOCK)
_ATTRS = T.MapType(T.StringType(), T.StringType())
_ELEMENT = T.StructType([T.StructField("tag", T.StringType()), T.StructField("attrs", _ATTRS), T.StructField("text", T.StringType()), T.StructField("html", T.StringType())])
_ARROW_ATTRS = pa.map_(pa.string(), pa.string())
_ARROW_ELEMENT = pa.struct([("tag", pa.string()), ("attrs", _ARROW_ATTRS), ("text", pa.string()), ("html", pa.string())])
NODES = "node_id int, parent_id int, sibling int, depth int, node_type int, tag string, attrs map<string,string>, value string"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _on_tree(f: Callable[[Tree], object], kind: T.DataType | str, arrow: pa.DataType) -> Callable[[str | Column], Column]:
    @F.arrow_udf(kind)
    def found(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else f(dom.parse(p)) for p in pages.to_pylist()], arrow)

    return lambda page: found(_col(page))


def parse_bytes(data: bytes, encoding: str = "utf-8", errors: str = "ignore") -> Tree:
    """A tree from bytes in an encoding that is named as in a browser."""
    return dom.parse(bytes_to_str(data, map_encoding(encoding), errors))


def html_title(page: str | Column) -> Column:
    return _on_tree(lambda t: t.title, "string", pa.string())(page)


def html_inner_text(page: str | Column) -> Column:
    return _on_tree(lambda t: inner_text(t.body), "string", pa.string())(page)


def html_many(page: str | Column, **wanted: str | tuple) -> Column:
    """A struct of several facts of a page that is parsed once for all of them, one field for each keyword.

    "title", "inner_text", "html"; ("text", options of extract_text); ("select", selector) for the elements;
    ("count", selector); ("attr", selector, name) for the first element's attribute.
    """
    string = (T.StringType(), pa.string())
    element = (T.ArrayType(_ELEMENT), pa.list_(_ARROW_ELEMENT))

    def reader(spec: str | tuple) -> tuple[Callable[[Tree], object], T.DataType, pa.DataType]:
        name, *rest = (spec,) if isinstance(spec, str) else spec
        if name == "title":
            return lambda t: t.title, *string
        if name == "inner_text":
            return lambda t: inner_text(t.body), *string
        if name == "html":
            return lambda t: dom.serialise(t.document), *string
        if name == "text":
            return lambda t: extract_text(t, **(rest[0] if rest else {})), *string
        if name == "select":
            return lambda t: [_element(n) for n in t.document.query_selector_all(rest[0])], *element
        if name == "count":
            return lambda t: len(t.document.query_selector_all(rest[0])), T.IntegerType(), pa.int32()
        if name == "attr":
            return lambda t: (n := t.document.query_selector(rest[0])) and n.attrs.get(rest[1]), *string
        raise ValueError(f"nothing is called {name}")

    readers = {k: reader(v) for k, v in wanted.items()}
    kind = T.StructType([T.StructField(k, t) for k, (_, t, _) in readers.items()])
    return _on_tree(lambda t: {k: f(t) for k, (f, _, _) in readers.items()}, kind, pa.struct([(k, a) for k, (_, _, a) in readers.items()]))(page)


def ascii_lower(x: str | Column) -> Column:
    """Lower case of A to Z only, as byte-wise comparisons want it; all other letters stay."""
    return F.translate(_col(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def html_serialised(page: str | Column) -> Column:
    """The page as its tree reads."""
    return _on_tree(lambda t: dom.serialise(t.document), "string", pa.string())(page)


def _element(n: Node) -> dict:
    return {"tag": n.tag, "attrs": list(n.attrs.items()), "text": n.text, "html": n.html}


def html_select(page: str | Column, selector: str) -> Column:
    """array<struct(tag, attrs, text, html)> of the elements that match, in document order; a bad selector raises at once."""
    dom.compile_selector(selector)
    return _on_tree(lambda t: [_element(n) for n in t.document.query_selector_all(selector)], T.ArrayType(_ELEMENT), pa.list_(_ARROW_ELEMENT))(page)


def html_select_one(page: str | Column, selector: str) -> Column:
    return F.get(html_select(page, selector), 0)


def html_matches(page: str | Column, selector: str) -> Column:
    """Whether any element matches."""
    dom.compile_selector(selector)
    return _on_tree(lambda t: t.document.matches(selector), "boolean", pa.bool_())(page)


def html_by_id(page: str | Column, value: str, case_insensitive: bool = False) -> Column:
    def find(t: Tree) -> dict | None:
        n = t.document.get_element_by_id(value, case_insensitive)
        return n and _element(n)

    return _on_tree(find, _ELEMENT, _ARROW_ELEMENT)(page)


def html_by_class(page: str | Column, name: str) -> Column:
    return _on_tree(lambda t: [_element(n) for n in t.document.get_elements_by_class_name(name)], T.ArrayType(_ELEMENT), pa.list_(_ARROW_ELEMENT))(page)


def html_by_tag(page: str | Column, tag: str) -> Column:
    return _on_tree(lambda t: [_element(n) for n in t.document.get_elements_by_tag_name(tag)], T.ArrayType(_ELEMENT), pa.list_(_ARROW_ELEMENT))(page)


def html_by_attr(page: str | Column, name: str, wanted: str, case_insensitive: bool = False) -> Column:
    return _on_tree(lambda t: [_element(n) for n in t.document.get_elements_by_attr(name, wanted, case_insensitive)], T.ArrayType(_ELEMENT), pa.list_(_ARROW_ELEMENT))(page)


def html_links(page: str | Column) -> Column:
    """array<struct(href, text)> of the links."""
    kind, arrow = "array<struct<href:string,text:string>>", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))
    return _on_tree(lambda t: [{"href": n.attrs["href"], "text": n.text} for n in t.document.query_selector_all("a[href]")], kind, arrow)(page)


def html_edit(page: str | Column, edit: Callable[[Tree], None]) -> Column:
    """The pages as they read after ``edit`` has changed their trees."""

    def run(t: Tree) -> str:
        edit(t)
        return dom.serialise(t.document)

    return _on_tree(run, "string", pa.string())(page)


def without(page: str | Column, selector: str) -> Column:
    """The pages without the elements that match."""

    def drop(t: Tree) -> None:
        for n in t.document.query_selector_all(selector):
            n.decompose()

    dom.compile_selector(selector)
    return html_edit(page, drop)


def class_list(attrs: str | Column) -> Column:
    """The classes of an attribute map, natively."""
    return F.array_distinct(F.filter(F.split(F.coalesce(F.try_element_at(_col(attrs), F.lit("class")), F.lit("")), r"\s+"), lambda c: c != ""))


def nodes(tree: Tree) -> Iterator[tuple]:
    """Rows of a tree in document order; the document is node 0."""
    todo, i = [(tree.document, -1, 0, 0)], 0
    while todo:
        n, parent, sibling, depth = todo.pop()
        yield i, parent, sibling, depth, n.kind, n.tag or None, dict(n.attrs) if n.kind == ELEMENT else None, n.value if n.kind not in (ELEMENT, dom.DOCUMENT) else None
        todo.extend((c, i, k, depth + 1) for k, c in reversed(list(enumerate(n.children))))
        i += 1


def html_nodes(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id",), elements_only: bool = False) -> DataFrame:
    """The kept columns and (node_id, parent_id, sibling, depth, node_type, tag, attrs, value) of every node."""
    prepare(pages.sparkSession)
    kept = [pages.schema[c] for c in keep]
    schema = T.StructType(kept + list(T._parse_datatype_string(NODES).fields))
    names = [f.name for f in schema]

    def run(parts):
        for b in parts:
            rows, cols = [], [b.column(c).to_pylist() for c in (*keep, page)]
            for *own, text in zip(*cols, strict=True):
                if text is not None:
                    rows += [(*own, *n) for n in nodes(dom.parse(text)) if not elements_only or n[4] == ELEMENT]
                if len(rows) > 50_000:
                    yield _rows(rows, names, b, keep)
                    rows = []
            if rows:
                yield _rows(rows, names, b, keep)

    return pages.select(*keep, page).mapInArrow(run, schema)


def _rows(rows: list[tuple], names: list[str], batch: pa.RecordBatch, keep: tuple[str, ...]) -> pa.RecordBatch:
    kinds = [batch.schema.field(c).type for c in keep] + [pa.int32()] * 5 + [pa.string(), _ARROW_ATTRS, pa.string()]
    cols = list(zip(*rows, strict=True))
    at = len(keep) + 6
    cols[at] = [None if a is None else list(a.items()) for a in cols[at]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def register(spark: SparkSession) -> None:
    """SQL functions html_title, html_inner_text, extract_plain_text, extract_main_content, detect_mime, detect_encoding."""
    from webloom.functions.encoding import detect_encoding, detect_mime
    from webloom.functions.extract import extract_text

    def plain(f, kind: str):
        @F.arrow_udf(kind)
        def found(values: pa.Array) -> pa.Array:
            return pa.array([None if v is None else f(v) for v in values.to_pylist()])

        return found

    prepare(spark)
    for name, f in {
        "html_title": lambda p: dom.parse(p).title,
        "html_inner_text": lambda p: inner_text(dom.parse(p).body),
        "extract_plain_text": extract_text,
        "extract_main_content": lambda p: extract_text(p, main_content=True),
        "detect_mime": detect_mime,
        "detect_encoding": detect_encoding,
    }.items():
        spark.udf.register(name, plain(f, "string"))
