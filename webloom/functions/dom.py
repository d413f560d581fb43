"""An HTML tree for use inside Arrow functions: parser, navigation, selection, mutation, serialisation.

The parser follows the tree construction rules of HTML that matter for extraction: implied html,
head and body, implied end tags, formatting elements that are reopened after a block closed them,
misnested formatting, raw text elements, foreign content kept apart for titles, and foster-free
tables (stray content stays where it stands).
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator

ELEMENT, TEXT, PI, COMMENT, DOCUMENT, DOCTYPE = 1, 3, 7, 8, 9, 10

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt xmp plaintext listing".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption marquee object template applet".split())
SPECIAL = CLOSES_P | SCOPE | frozenset("body head tr tbody thead tfoot colgroup button select iframe textarea".split())
BLOCK = frozenset(
    "ul tr table section pre p ol nav main li hr hgroup header h6 h5 h4 h3 h2 h1 form footer figure figcaption fieldset dl div dt dd details center br blockquote aside article address".split()
)
_TABLE_PARTS = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"}}

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<!doctype(?P<doctype>[^>]*)>|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>\x00]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<(?P<bogus>[!?/][^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)
_SPACE = " \t\n\f\r\v"


def _decode(text: str) -> str:
    return _html.unescape(text) if "&" in text else text


class Node:
    __slots__ = ("kind", "tag", "attrs", "value", "children", "parent", "foreign", "_order", "_totals")

    def __init__(self, kind: int, tag: str = "", attrs: dict[str, str] | None = None, value: str = ""):
        self.kind, self.tag, self.attrs, self.value = kind, tag, attrs if attrs is not None else {}, value
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.foreign = False
        self._order: dict[int, tuple[int, int, int]] | None = None
        self._totals: dict[str, int] | None = None

    # navigation
    def order(self) -> dict[int, tuple[int, int, int]]:
        """By id() of each child: (index, number among the elements, number among those of its tag), counted once until children change."""
        if self._order is None or len(self._order) != len(self.children):
            tags: dict[str, int] = {}
            n, found = 0, {}
            for i, c in enumerate(self.children):
                if c.kind == ELEMENT:
                    n, tags[c.tag] = n + 1, tags.get(c.tag, 0) + 1
                found[id(c)] = (i, n, tags.get(c.tag, 0))
            self._order, self._totals = found, None
        return self._order

    def totals(self) -> dict[str, int]:
        """The number of child elements by tag, and of all under the empty string."""
        self.order()
        if self._totals is None:
            self._totals = {"": 0}
            for c in self.children:
                if c.kind == ELEMENT:
                    self._totals[""] += 1
                    self._totals[c.tag] = self._totals.get(c.tag, 0) + 1
        return self._totals

    @property
    def index(self) -> int:
        return self.parent.order()[id(self)][0] if self.parent else 0

    @property
    def next(self) -> Node | None:
        if self.parent is None:
            return None
        at = self.index + 1
        return self.parent.children[at] if at < len(self.parent.children) else None

    @property
    def prev(self) -> Node | None:
        at = self.index
        return self.parent.children[at - 1] if self.parent and at else None

    @property
    def elements(self) -> Nodes:
        return Nodes(c for c in self.children if c.kind == ELEMENT)

    @property
    def first_child(self) -> Node | None:
        return self.children[0] if self.children else None

    @property
    def last_child(self) -> Node | None:
        return self.children[-1] if self.children else None

    @property
    def next_element(self) -> Node | None:
        n = self.next
        while n is not None and n.kind != ELEMENT:
            n = n.next
        return n

    @property
    def prev_element(self) -> Node | None:
        n = self.prev
        while n is not None and n.kind != ELEMENT:
            n = n.prev
        return n

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def descendants(self) -> Iterator[Node]:
        it = self.walk()
        next(it)
        return it

    def contains(self, other: Node) -> bool:
        while other is not None:
            if other is self:
                return True
            other = other.parent
        return False

    def closest(self, selector: str) -> Node | None:
        test = compile_selector(selector)
        n = self
        while n is not None and n.kind == ELEMENT:
            if test(n):
                return n
            n = n.parent
        return None

    # contents
    @property
    def text(self) -> str:
        if self.kind in (TEXT, COMMENT, PI):
            return self.value
        return "".join(n.value for n in self.walk() if n.kind == TEXT)

    @text.setter
    def text(self, value: str) -> None:
        if self.kind in (TEXT, COMMENT, PI):
            self.value = value
            return
        self.replace_children()
        if value:
            self.append_child(Node(TEXT, value=value))

    @property
    def html(self) -> str:
        return serialise(self)

    @property
    def inner_html(self) -> str:
        return "".join(serialise(c) for c in self.children)

    # attributes
    @property
    def id(self) -> str:
        return self.attrs.get("id", "")

    @property
    def class_name(self) -> str:
        return self.attrs.get("class", "")

    @property
    def class_list(self) -> list[str]:
        return list(dict.fromkeys(self.class_name.split()))

    def add_class(self, name: str) -> None:
        if name not in self.class_list:
            self.attrs["class"] = " ".join([*self.class_list, name])

    def remove_class(self, name: str) -> None:
        self.attrs["class"] = " ".join(c for c in self.class_list if c != name)

    def toggle_class(self, name: str) -> bool:
        on = name not in self.class_list
        (self.add_class if on else self.remove_class)(name)
        return on

    # search
    def get_element_by_id(self, value: str, case_insensitive: bool = False) -> Node | None:
        return next(iter(self.get_elements_by_attr("id", value, case_insensitive)), None)

    def get_elements_by_attr(self, name: str, wanted: str, case_insensitive: bool = False) -> Nodes:
        same = (lambda a: a.lower() == wanted.lower()) if case_insensitive else (lambda a: a == wanted)
        return Nodes(n for n in self.descendants() if n.kind == ELEMENT and name in n.attrs and same(n.attrs[name]))

    def get_elements_by_class_name(self, name: str) -> Nodes:
        want = set(name.split())
        return Nodes(n for n in self.descendants() if n.kind == ELEMENT and want and want <= set(n.class_name.split()))

    def get_elements_by_tag_name(self, name: str) -> Nodes:
        low = name.lower()
        return Nodes(n for n in self.descendants() if n.kind == ELEMENT and low in ("*", n.tag))

    def query_selector_all(self, selector: str) -> Nodes:
        test = compile_selector(selector)
        return Nodes(n for n in self.descendants() if n.kind == ELEMENT and test(n))

    def query_selector(self, selector: str) -> Node | None:
        test = compile_selector(selector)
        return next((n for n in self.descendants() if n.kind == ELEMENT and test(n)), None)

    def matches(self, selector: str) -> bool:
        """Whether this element or any below it matches."""
        test = compile_selector(selector)
        return any(n.kind == ELEMENT and test(n) for n in self.walk())

    def matches_self(self, selector: str) -> bool:
        return self.kind == ELEMENT and compile_selector(selector)(self)

    # mutation
    def _adopt(self, node: Node) -> None:
        if node.contains(self):
            raise ValueError("a node can't be put into itself")
        if node.parent is not None:
            node.parent.remove_child(node)
        node.parent, self._order = self, None

    def append_child(self, node: Node) -> Node:
        self._adopt(node)
        self.children.append(node)
        return node

    def insert_before(self, node: Node, reference: Node | None) -> Node:
        if reference is None:
            return self.append_child(node)
        if reference.parent is not self:
            raise ValueError("the reference isn't a child of this node")
        if node is reference:
            return node
        self._adopt(node)
        self.children.insert(reference.index, node)
        self._order = None
        return node

    def replace_child(self, node: Node, old: Node) -> Node:
        if old.parent is not self:
            raise ValueError("the node to replace isn't a child of this node")
        if node is not old:
            self.insert_before(node, old)
            self.remove_child(old)
        return old

    def remove_child(self, node: Node) -> Node:
        if node.parent is not self:
            raise ValueError("not a child of this node")
        self.children.pop(node.index)
        node.parent = self._order = None
        return node

    def decompose(self) -> None:
        if self.parent is not None:
            self.parent.remove_child(self)

    def before(self, node: Node) -> None:
        self.parent.insert_before(node, self)

    def after(self, node: Node) -> None:
        self.parent.insert_before(node, self.next)

    def replace_with(self, node: Node) -> None:
        self.parent.replace_child(node, self)

    def prepend(self, node: Node) -> None:
        self.insert_before(node, self.first_child)

    def append(self, *nodes: Node) -> None:
        for n in nodes:
            self.append_child(n)

    def replace_children(self, *nodes: Node) -> None:
        for c in self.children:
            c.parent = None
        self.children, self._order = [], None
        self.append(*nodes)

    def clone(self, deep: bool = True) -> Node:
        def one(n: Node) -> Node:
            new = Node(n.kind, n.tag, dict(n.attrs), n.value)
            new.foreign = n.foreign
            return new

        top = one(self)
        todo = [(self, top)] if deep else []
        while todo:
            old, new = todo.pop()
            for c in old.children:
                copy = one(c)
                new.children.append(copy)
                copy.parent = new
                todo.append((c, copy))
        return top

    # attributes and tokens beyond those above
    def toggle_attr(self, name: str, force: bool | None = None) -> bool:
        on = name not in self.attrs if force is None else force
        if on:
            self.attrs.setdefault(name, "")
        else:
            self.attrs.pop(name, None)
        return on

    def replace_class(self, old: str, new: str) -> bool:
        names = self.class_list
        if old not in names:
            return False
        self.attrs["class"] = " ".join(dict.fromkeys(new if c == old else c for c in names))
        return True

    # character data, of text and comments; offsets beyond the end count as the end
    def substring_data(self, at: int, count: int) -> str:
        return self.value[at : at + count]

    def append_data(self, text: str) -> None:
        self.value += text

    def insert_data(self, at: int, text: str) -> None:
        self.replace_data(at, 0, text)

    def delete_data(self, at: int, count: int) -> None:
        self.replace_data(at, count, "")

    def replace_data(self, at: int, count: int, text: str) -> None:
        self.value = self.value[:at] + text + self.value[at + count :]

    # of a doctype
    @property
    def doctype_ids(self) -> tuple[str, str, str]:
        """(name, public id, system id); what isn't given is empty."""
        m = re.match(r"""\s*(\S*)(?:\s+(?:public\s*(?:"([^"]*)"|'([^']*)')\s*(?:"([^"]*)"|'([^']*)')?|system\s*(?:"([^"]*)"|'([^']*)')))?""", self.value, re.I)
        a = m.groups(default="")
        return a[0].lower(), a[1] or a[2], a[3] or a[4] or a[5] or a[6]


class Nodes(list):
    """Elements in document order; slices are Nodes too, and searches run from each element in turn, results concatenated as they come."""

    def __getitem__(self, at):
        found = super().__getitem__(at)
        return Nodes(found) if isinstance(at, slice) else found

    def get_element_by_id(self, value: str, case_insensitive: bool = False) -> Node | None:
        return next((x for n in self if (x := n.get_element_by_id(value, case_insensitive)) is not None), None)

    def get_elements_by_attr(self, name: str, wanted: str, case_insensitive: bool = False) -> Nodes:
        return Nodes(x for n in self for x in n.get_elements_by_attr(name, wanted, case_insensitive))

    def get_elements_by_class_name(self, name: str) -> Nodes:
        return Nodes(x for n in self for x in n.get_elements_by_class_name(name))

    def get_elements_by_tag_name(self, name: str) -> Nodes:
        return Nodes(x for n in self for x in n.get_elements_by_tag_name(name))

    def query_selector_all(self, selector: str) -> Nodes:
        return Nodes(x for n in self for x in n.query_selector_all(selector))

    def query_selector(self, selector: str) -> Node | None:
        return next((x for n in self if (x := n.query_selector(selector)) is not None), None)

    def matches(self, selector: str) -> bool:
        return any(n.matches(selector) for n in self)

    def matching(self, selector: str) -> Nodes:
        """Those of the elements that match themselves, seen from the whole document."""
        test = compile_selector(selector)
        return Nodes(n for n in self if n.kind == ELEMENT and test(n))

    def named_item(self, name: str) -> Node | None:
        """The first element with that id, or else with that name."""
        return next((n for key in ("id", "name") for n in self if name and n.attrs.get(key) == name), None)


def create_element(tag: str, **attrs: str) -> Node:
    return Node(ELEMENT, tag.lower(), dict(attrs))


def create_text(value: str) -> Node:
    return Node(TEXT, value=value)


def serialise(node: Node) -> str:
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == TEXT:
            raw = n.parent is not None and n.parent.tag in RAW
            out.append(n.value if raw else n.value.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif n.kind == COMMENT:
            out.append(f"<!--{n.value}-->")
        elif n.kind == DOCTYPE:
            out.append(f"<!DOCTYPE {n.value}>")
        elif n.kind == DOCUMENT:
            todo.extend(reversed(n.children))
        else:
            attrs = "".join(' {}="{}"'.format(k, v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")) for k, v in n.attrs.items())
            out.append(f"<{n.tag}{attrs}>")
            if n.tag not in VOID:
                todo.append(f"</{n.tag}>")
                todo.extend(reversed(n.children))
    return "".join(out)


def traverse(root: Node, start: Callable[[Node, int], None], end: Callable[[Node, int], None] | None = None, elements_only: bool = False) -> None:
    """Calls start(node, depth) before and end(node, depth) behind a node's children; leaves have no end."""
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while todo:
        n, depth, over = todo.pop()
        if over:
            if end is not None:
                end(n, depth)
            continue
        if not elements_only or n.kind in (ELEMENT, DOCUMENT):
            start(n, depth)
        inside = n.elements if elements_only else n.children
        if inside:
            todo.append((n, depth, True))
            todo.extend((c, depth + 1, False) for c in reversed(inside))


class Tree:
    """A parsed page: ``document``, ``head``, ``body`` and ``title``."""

    def __init__(self, document: Node, head: Node, body: Node):
        self.document, self.head, self.body = document, head, body

    @property
    def title(self) -> str:
        for n in self.document.descendants():
            if n.kind == ELEMENT and n.tag == "title" and not n.foreign:
                return " ".join(n.text.split())
        return ""


class _Stack(list):
    """The open elements, and how many there are of each tag."""

    def __init__(self, nodes: list[Node] = ()):  # type: ignore[assignment]
        super().__init__(nodes)
        self.open: dict[str, int] = {}
        self.ids: set[int] = set()
        #: How many svg and math elements are open.
        self.foreign = 0
        for n in nodes:
            self._add(n, 1)

    def _add(self, n: Node, by: int) -> None:
        tag = n.tag
        self.open[tag] = self.open.get(tag, 0) + by
        if by > 0:
            self.ids.add(id(n))
        else:
            self.ids.discard(id(n))
        if tag in ("svg", "math"):
            self.foreign += by

    def append(self, n: Node) -> None:
        super().append(n)
        self._add(n, 1)

    def insert(self, at: int, n: Node) -> None:
        super().insert(at, n)
        self._add(n, 1)

    def pop(self, at: int = -1) -> Node:
        n = super().pop(at)
        self._add(n, -1)
        return n

    def __setitem__(self, at: int, n: Node) -> None:
        self._add(self[at], -1)
        super().__setitem__(at, n)
        self._add(n, 1)

    def __delitem__(self, at: int | slice) -> None:
        for n in self[at] if isinstance(at, slice) else [self[at]]:
            self._add(n, -1)
        super().__delitem__(at)


class _Builder:
    def __init__(self):
        self.document = Node(DOCUMENT, "#document")
        self.root = self.head = self.body = None
        self.stack = _Stack()
        self.active: list[Node | None] = []

    def _need_root(self) -> None:
        if self.root is None:
            self.root = Node(ELEMENT, "html")
            self.document.append_child(self.root)
            self.stack = _Stack([self.root])

    def _need_head(self) -> None:
        self._need_root()
        if self.head is None:
            self.head = Node(ELEMENT, "head")
            self._put(self.root, self.head)

    def _need_body(self) -> None:
        if self.body is None:
            self._need_head()
            self.body = Node(ELEMENT, "body")
            self._put(self.root, self.body)
            self.stack = _Stack([self.root, self.body])

    @staticmethod
    def _put(parent: Node, node: Node) -> None:
        node.parent = parent
        parent.children.append(node)

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def _in_head(self) -> bool:
        return self.body is None and len(self.stack) > 1 and self.stack[1] is self.head

    def _in_scope(self, tags: set[str] | frozenset[str], stop: frozenset[str] = SCOPE) -> bool:
        if not any(self.stack.open.get(t) for t in tags):
            return False
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in stop:
                return False
        return False

    def _pop_to(self, tags: set[str] | frozenset[str]) -> None:
        while len(self.stack) > 2 and self.top.tag not in tags:
            self.stack.pop()
        if len(self.stack) > 2:
            self.stack.pop()

    def _reopen(self) -> None:
        """Opens formatting elements again that a block closed before them."""
        active, on = self.active, self.stack
        if not active or active[-1] is None or id(active[-1]) in on.ids:
            return
        i = len(active) - 1
        while i > 0 and active[i - 1] is not None and id(active[i - 1]) not in on.ids:
            i -= 1
        for k in range(i, len(active)):
            new = Node(ELEMENT, active[k].tag, dict(active[k].attrs))
            self._put(self.top, new)
            on.append(new)
            active[k] = new

    def text(self, value: str) -> None:
        if not value:
            return
        if self.body is None:
            if not value.strip(_SPACE):
                if self._in_head():
                    self._append_text(value)
                return
            lead = len(value) - len(value.lstrip(_SPACE))
            value = value[lead:] if not self._in_head() else value
            self._need_body()
        if not self.stack.foreign and self.top.tag not in RAW and self.top.tag not in ESCAPABLE:
            self._reopen()
        self._append_text(value)

    def _append_text(self, value: str) -> None:
        last = self.top.last_child
        if last is not None and last.kind == TEXT:
            last.value += value
        else:
            self._put(self.top, Node(TEXT, value=value))

    def comment(self, value: str) -> None:
        where = self.top if self.stack else self.document
        self._put(where, Node(COMMENT, value=value))

    def doctype(self, value: str) -> None:
        if self.root is None:
            self._put(self.document, Node(DOCTYPE, value=value.strip()))

    def _open(self, tag: str, attrs: dict[str, str], closed: bool = False) -> Node:
        n = Node(ELEMENT, tag, attrs)
        n.foreign = bool(self.stack.foreign)
        self._put(self.top, n)
        if not closed:
            self.stack.append(n)
        return n

    def start(self, tag: str, attrs: dict[str, str], self_closing: bool) -> Node | None:
        if tag == "html":
            self._need_root()
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return None
        if tag == "head":
            if self.head is None:
                self._need_head()
                self.head.attrs = attrs
                self.stack = _Stack([self.root, self.head])
            return None
        if tag == "body":
            if self.body is None:
                self._need_body()
                self.body.attrs = attrs
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return None
        if self.body is None:
            if tag in HEAD_ONLY and not self.stack.foreign:
                if not self._in_head():
                    self._need_head()
                    self.stack = _Stack([self.root, self.head])
                return self._open(tag, attrs, tag in VOID)
            if tag == "frameset":
                return None
            self._need_body()
        if tag in ("svg", "math"):
            self._reopen()
            n = self._open(tag, attrs, self_closing)
            n.foreign = True
            return n
        if self.stack.foreign:
            if tag in CLOSES_P or tag in FORMATTING - {"a"}:
                while self.stack.foreign:
                    self.stack.pop()
            else:
                return self._open(tag, attrs, self_closing)
        if tag in CLOSES_P:
            if tag == "li":
                self._close_item({"li"})
            elif tag in ("dd", "dt"):
                self._close_item({"dd", "dt"})
            if self._in_scope({"p"}, SCOPE | {"button"}):
                self._pop_to({"p"})
            if tag in HEADINGS and self.top.tag in HEADINGS:
                self.stack.pop()
        elif tag in _TABLE_PARTS:
            if not self.stack.open.get("table"):
                return None
            while self.top.tag in _TABLE_PARTS[tag] or (self.top.tag not in ("table", "tbody", "thead", "tfoot", "tr", "template", "body") and self._in_scope(_TABLE_PARTS[tag], frozenset({"table", "template"}))):
                self.stack.pop()
            if tag == "tr" and self.top.tag == "table":
                self._open("tbody", {})
            elif tag in ("td", "th"):
                if self.top.tag == "table":
                    self._open("tbody", {})
                if self.top.tag in ("tbody", "thead", "tfoot"):
                    self._open("tr", {})
                self.active.append(None)
            return self._open(tag, attrs)
        elif tag in ("option", "optgroup"):
            if self.top.tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.top.tag == "optgroup":
                self.stack.pop()
        elif tag == "button" and self._in_scope({"button"}):
            self._pop_to({"button"})
        elif tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self.end("a")
                    self.active = [x for x in self.active if x is not n]
                    self.stack = _Stack([x for x in self.stack if x is not n])
                    break
        if tag not in CLOSES_P or tag == "hr":
            if tag != "hr":
                self._reopen()
        n = self._open(tag, attrs, tag in VOID)
        if tag in FORMATTING:
            same = [x for x in self._tail() if x.tag == tag and x.attrs == attrs]
            if len(same) >= 3:
                self.active = [x for x in self.active if x is not same[0]]
            self.active.append(n)
        elif tag in ("applet", "object", "marquee", "caption"):
            self.active.append(None)
        return n

    def _tail(self) -> list[Node]:
        out = []
        for n in reversed(self.active):
            if n is None:
                break
            out.append(n)
        return out[::-1]

    def _close_item(self, tags: set[str]) -> None:
        for n in reversed(self.stack):
            if n.tag in tags:
                self._pop_to(tags)
                return
            if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                return

    def end(self, tag: str) -> None:
        if self.body is None:
            if self._in_head():
                if tag == "head":
                    self.stack = _Stack([self.root])
                else:
                    for i in range(len(self.stack) - 1, 1, -1):
                        if self.stack[i].tag == tag:
                            del self.stack[i:]
                            break
                return
            if tag not in ("body", "html", "br", "p"):
                return
            self._need_body()
            if tag in ("body", "html"):
                return
        if tag in ("body", "html"):
            return
        if self.stack.foreign:
            for i in range(len(self.stack) - 1, 1, -1):
                if self.stack[i].tag == tag:
                    del self.stack[i:]
                    return
                if not self.stack[i].foreign:
                    break
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p":
            if not self._in_scope({"p"}, SCOPE | {"button"}):
                self._open("p", {})
            self._pop_to({"p"})
        elif tag in FORMATTING:
            self._adoption(tag)
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._pop_to(HEADINGS)
        elif tag in SPECIAL:
            stop = frozenset({"table", "template", "html"}) if tag in ("table", "caption", "td", "th", "tr", "tbody", "thead", "tfoot") else SCOPE | ({"ol", "ul"} if tag == "li" else frozenset())
            if self._in_scope({tag}, stop - {tag}):
                self._pop_to({tag})
                if tag in ("td", "th", "caption", "object", "applet", "marquee") and None in self.active:
                    while self.active.pop() is not None:
                        pass
        else:
            for i in range(len(self.stack) - 1, 1, -1):
                if self.stack[i].tag == tag:
                    del self.stack[i:]
                    return
                if self.stack[i].tag in SPECIAL:
                    return

    def _adoption(self, tag: str) -> None:
        """An end tag of a formatting element, which may be misnested with blocks."""
        for _ in range(8):
            mark = next((n for n in reversed(self._tail()) if n.tag == tag), None)
            if mark is None:
                for i in range(len(self.stack) - 1, 1, -1):
                    if self.stack[i].tag == tag:
                        del self.stack[i:]
                        return
                    if self.stack[i].tag in SPECIAL:
                        return
                return
            at = next((i for i, n in enumerate(self.stack) if n is mark), -1)
            if at < 0:
                self.active = [n for n in self.active if n is not mark]
                return
            block = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active = [n for n in self.active if n is not mark]
                return
            furthest, common, last = self.stack[block], self.stack[at - 1], self.stack[block]
            for i in range(block - 1, at, -1):
                n = self.stack[i]
                k = next((j for j, x in enumerate(self.active) if x is n), -1)
                if k < 0 or block - i > 3:
                    if k >= 0:
                        del self.active[k]
                    del self.stack[i]
                    continue
                new = Node(ELEMENT, n.tag, dict(n.attrs))
                self.active[k] = self.stack[i] = new
                new.append_child(last)
                last = new
            common.append_child(last)
            new = Node(ELEMENT, mark.tag, dict(mark.attrs))
            for c in list(furthest.children):
                new.append_child(c)
            furthest.append_child(new)
            k = next(j for j, x in enumerate(self.active) if x is mark)
            self.active[k] = new
            self.stack = _Stack([n for n in self.stack if n is not mark])
            self.stack.insert(next(i for i, n in enumerate(self.stack) if n is furthest) + 1, new)


def parse(page: str | bytes) -> Tree:
    """The tree of a page; every page has html, head and body.  Bytes are UTF-8, and what isn't becomes U+FFFD."""
    if isinstance(page, bytes):
        page = page.decode("utf-8", "replace")
    page = page.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    b, at, n = _Builder(), 0, len(page)
    find = _TOKEN.search
    while at < n:
        m = find(page, at)
        if m is None:
            b.text(_decode(page[at:]))
            break
        if m.start() > at:
            b.text(_decode(page[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is not None:
            tag = tag.lower()
            if m["close"]:
                b.end(tag)
                continue
            raw = m["attrs"]
            closing = raw.endswith("/")
            attrs: dict[str, str] = {}
            if raw and not raw.isspace():
                for name, x, y, z in _ATTR.findall(raw[:-1] if closing else raw):
                    attrs.setdefault(name.lower(), _decode(x or y or z))
            node = b.start(tag, attrs, closing)
            if node is not None and (tag in RAW or tag in ESCAPABLE) and not node.foreign:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                inner = page[at : stop.start() if stop else n]
                if tag in ESCAPABLE:
                    inner = _decode(inner)
                    if tag == "textarea" and inner.startswith("\n"):
                        inner = inner[1:]
                if inner:
                    node.children.append(t := Node(TEXT, value=inner))
                    t.parent = node
                if b.stack[-1] is node:
                    b.stack.pop()
                at = stop.end() if stop else n
            elif node is not None and tag == "pre" and page.startswith("\n", at):
                at += 1
        elif m["comment"] is not None:
            b.comment(m["comment"])
        elif m["doctype"] is not None:
            b.doctype(m["doctype"])
        else:
            b.comment(m["bogus"].lstrip("!/"))
    b._need_body()
    return Tree(b.document, b.head, b.body)


# Selectors

_NAME = r"(?:[\w\-\u0080-\U0010ffff]|\\.)+"
_PART = re.compile(
    rf"(?P<tag>\*|{_NAME})|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<flag>[iIsS])?\s*)?\]|::?(?P<pseudo>[a-zA-Z-]+)(?P<arg>\()?"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_cache: dict[str, Callable[[Node], bool]] = {}


class SelectorError(ValueError):
    """A selector that isn't valid CSS."""


def compile_selector(selector: str) -> Callable[[Node], bool]:
    if selector not in _cache:
        if len(_cache) > 500:
            _cache.clear()
        test, at = _list(selector, 0, "")
        _cache[selector] = test
    return _cache[selector]


def _list(s: str, at: int, stop: str) -> tuple[Callable[[Node], bool], int]:
    tests = []
    while True:
        test, at = _complex(s, at, stop)
        tests.append(test)
        if at < len(s) and s[at] == ",":
            at += 1
            continue
        if stop and not s.startswith(stop, at):
            raise SelectorError(f"unclosed {stop} in selector {s!r}")
        return (tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)), at


def _complex(s: str, at: int, stop: str) -> tuple[Callable[[Node], bool], int]:
    while at < len(s) and s[at].isspace():
        at += 1
    test, at = _compound(s, at)
    while at < len(s):
        m = _COMBINATOR.match(s, at)
        if m is None:
            if s[at] == "," or (stop and s.startswith(stop, at)):
                break
            raise SelectorError(f"unexpected {s[at]!r} in selector {s!r}")
        if m.end() >= len(s) or s[m.end()] == "," or (stop and s.startswith(stop, m.end())):
            if m[1]:
                raise SelectorError(f"nothing behind {m[1]!r} in selector {s!r}")
            at = m.end()
            break
        right, at = _compound(s, m.end())
        test = _combine(test, m[1] or " ", right)
    return test, at


def _combine(left: Callable[[Node], bool], how: str, right: Callable[[Node], bool]) -> Callable[[Node], bool]:
    def up(n: Node) -> bool:
        p = n.parent
        while p is not None and p.kind == ELEMENT:
            if left(p):
                return True
            p = p.parent
        return False

    def before(n: Node) -> bool:
        p = n.prev_element
        while p is not None:
            if left(p):
                return True
            p = p.prev_element
        return False

    where = {
        " ": up,
        ">": lambda n: n.parent is not None and n.parent.kind == ELEMENT and left(n.parent),
        "+": lambda n: (p := n.prev_element) is not None and left(p),
        "~": before,
    }[how]
    return lambda n: right(n) and where(n)


def _nth(arg: str) -> Callable[[int], bool]:
    arg = arg.replace(" ", "").lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not arg or m is None:
        raise SelectorError(f"bad position {arg!r}")
    step = {None: 0, "": 1, "+": 1, "-": -1}.get(m[1], None)
    step = int(m[1]) if step is None else step
    off = int(m[2] or 0)
    return lambda i: (i == off) if step == 0 else (i - off) * step >= 0 and (i - off) % step == 0


def _place(n: Node, same: bool, back: bool) -> int:
    """A node's number among the elements of its parent, or those of its tag, from the front or the back."""
    if n.parent is None:
        return 1
    at = n.parent.order()[id(n)][1 + same]
    return _count(n, same) - at + 1 if back else at


def _count(n: Node, same: bool) -> int:
    if n.parent is None:
        return 1
    return n.parent.totals()[n.tag if same else ""]


_SIMPLE: dict[str, Callable[[Node], bool]] = {
    "first-child": lambda n: _place(n, False, False) == 1,
    "last-child": lambda n: _place(n, False, True) == 1,
    "only-child": lambda n: _count(n, False) == 1,
    "first-of-type": lambda n: _place(n, True, False) == 1,
    "last-of-type": lambda n: _place(n, True, True) == 1,
    "only-of-type": lambda n: _count(n, True) == 1,
    "empty": lambda n: not any(c.kind == ELEMENT or (c.kind == TEXT and c.value) for c in n.children),
    "root": lambda n: n.parent is not None and n.parent.kind == DOCUMENT,
    "checked": lambda n: "checked" in n.attrs or "selected" in n.attrs,
    "disabled": lambda n: "disabled" in n.attrs,
    "enabled": lambda n: n.tag in ("button", "input", "select", "textarea", "option") and "disabled" not in n.attrs,
    "required": lambda n: "required" in n.attrs,
    "optional": lambda n: n.tag in ("input", "select", "textarea") and "required" not in n.attrs,
    "link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
    "any-link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
    "blank": lambda n: not n.text.strip(),
}


def _compound(s: str, at: int) -> tuple[Callable[[Node], bool], int]:
    tests: list[Callable[[Node], bool]] = []
    while at < len(s):
        m = _PART.match(s, at)
        if m is None or (m["tag"] and tests):
            break
        at = m.end()
        if m["tag"]:
            tag = _unescape(m["tag"]).lower()
            tests.append((lambda n: True) if tag == "*" else (lambda n, tag=tag: n.tag == tag))
        elif m["id"]:
            tests.append(lambda n, v=_unescape(m["id"]): n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=_unescape(m["cls"]): v in n.attrs.get("class", "").split())
        elif m["attr"]:
            tests.append(_attr(m))
        else:
            test, at = _pseudo(s, m, at)
            tests.append(test)
    if not tests:
        raise SelectorError(f"nothing to match at {at} in selector {s!r}")
    return (tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)), at


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _attr(m: re.Match) -> Callable[[Node], bool]:
    name, op = _unescape(m["attr"]).lower(), m["op"]
    if op is None:
        return lambda n: name in n.attrs
    want = next(x for x in (m["dq"], m["sq"], m["bare"]) if x is not None)
    fold = (lambda x: x.lower()) if (m["flag"] or "").lower() == "i" else (lambda x: x)
    want = fold(want)
    how: Callable[[str], bool] = {
        "=": lambda v: v == want,
        "~=": lambda v: bool(want) and want in v.split(),
        "|=": lambda v: v == want or v.startswith(want + "-"),
        "^=": lambda v: bool(want) and v.startswith(want),
        "$=": lambda v: bool(want) and v.endswith(want),
        "*=": lambda v: bool(want) and want in v,
    }[op]
    return lambda n: name in n.attrs and how(fold(n.attrs[name]))


def _pseudo(s: str, m: re.Match, at: int) -> tuple[Callable[[Node], bool], int]:
    name = m["pseudo"].lower()
    if not m["arg"]:
        if name not in _SIMPLE:
            raise SelectorError(f"unknown :{name} in selector {s!r}")
        return _SIMPLE[name], at
    if name in ("not", "is", "where", "has", "matches"):
        if name == "has":
            while at < len(s) and s[at].isspace():
                at += 1
            how = s[at] if at < len(s) and s[at] in ">+~" else " "
            inner, at = _list(s, at + (how != " "), ")")
            spots: dict[str, Callable[[Node], Iterator[Node] | list[Node]]] = {
                " ": lambda n: n.descendants(),
                ">": lambda n: n.children,
                "+": lambda n: [x for x in [n.next_element] if x is not None],
                "~": lambda n: n.parent.children[n.index + 1 :] if n.parent else [],
            }
            return (lambda n: any(x.kind == ELEMENT and inner(x) for x in spots[how](n))), at + 1
        inner, at = _list(s, at, ")")
        return ((lambda n: not inner(n)) if name == "not" else inner), at + 1
    stop = s.find(")", at)
    if stop < 0:
        raise SelectorError(f"unclosed ) in selector {s!r}")
    arg = s[at:stop]
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        fits, same, back = _nth(arg), name.endswith("of-type"), "last" in name
        return (lambda n: fits(_place(n, same, back))), stop + 1
    if name in ("contains", "-lexbor-contains"):
        word = arg.strip().strip("\"'")
        return (lambda n: word in n.text), stop + 1
    raise SelectorError(f"unknown :{name}() in selector {s!r}")
