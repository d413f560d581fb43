import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.functions import dom
from webloom.functions.dom import SelectorError, parse

PAGE = """<!doctype html><html lang=en><head><title> My  page </title><meta charset=utf-8></head>
<body id=top class="a b  a"><main><p id=one class="x">Hello <b>big</b> world</p><p class="x y">Two<br>lines</p>
<ul><li>1<li>2<li data-n="Three">3</ul><a href="/x?a=1&amp;b=2">link</a><!-- note --></main>
</body>"""


def test_basic_tree():
    t = parse(PAGE)
    assert t.title == "My page" and t.body.id == "top" and t.body.class_list == ["a", "b"]
    assert [n.text for n in t.body.get_elements_by_tag_name("li")] == ["1", "2", "3"]
    assert t.body.query_selector("a").attrs["href"] == "/x?a=1&b=2"
    assert [n.value for n in t.body.walk() if n.kind == dom.COMMENT] == [" note "]


@pytest.mark.parametrize(
    ("page", "head", "body", "title"),
    [
        ("<!DOCTYPE html><body><i>x</i></body>", 0, 1, ""),
        ("<!DOCTYPE html><head><title>T 1</title></head>", 1, 0, "T 1"),
        ("<!DOCTYPE html><head></head></body>", 0, 0, ""),
        ("<!DOCTYPE html><head><title>T 2</title><em></em>", 1, 1, "T 2"),
        ("", 0, 0, ""),
        ("just text", 0, 1, ""),
    ],
)
def test_implied_parts(page, head, body, title):
    t = parse(page)
    assert (len(t.head.children), len(t.body.children), t.title) == (head, body, title)


def test_svg_title_does_not_count():
    assert parse("<!doctype html><svg><title>SVG</title></svg>").title == ""


@pytest.mark.parametrize(
    ("page", "body"),
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<p><b>a<br><p>b", "<p><b>a<br></b></p><p><b>b</b></p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<i>1<b>2</i>3</b>", "<i>1<b>2</b></i><b>3</b>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>x", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>x"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("<body><script>if (a<b) 1</script>t", "<script>if (a<b) 1</script>t"),
        ("<textarea>\n<b>&amp;</textarea>", "<textarea>&lt;b&gt;&amp;</textarea>"),
        ("a</p>b", "a<p></p>b"),
        ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"),
        ("<div>x</span>y</div>z", "<div>xy</div>z"),
        ("1 < 2 &lt; 3 &copy &nbsp;", "1 &lt; 2 &lt; 3 © &nbsp;"),
    ],
)
def test_tree_construction(page, body):
    assert parse(page).body.inner_html == body


@pytest.mark.parametrize(
    ("selector", "n"),
    [("p", 2), ("#one", 1), (".x", 2), (".x.y", 1), ("main > p + p", 1), ("p ~ ul li", 3), ("li:first-child, li:last-child", 2), ("li:nth-child(2n+1)", 2), ("[data-n]", 1), ("[data-n=three]", 0), ("[data-n=three i]", 1), ("[href^='/x']", 1), ("[class~=y]", 1), ("p:not(.y)", 1), ("p:has(br)", 1), ("ul:has(> li)", 1), (":is(p, ul) > b", 1), ("*", 10), ("li:nth-last-child(1)", 1), ("a:link", 1)],
)
def test_selectors(selector, n):
    assert len(parse(PAGE).body.query_selector_all(selector)) == n


@pytest.mark.parametrize("selector", ["", "p >", "[a", "p:nope", "..x", "p:not(", ":nth-child(x)"])
def test_bad_selectors(selector):
    with pytest.raises(SelectorError):
        dom.compile_selector(selector)


def test_navigation_and_mutation():
    t = parse("<div><p>1</p>text<p>2</p></div>")
    div = t.body.first_child
    one, two = div.elements
    assert one.next_element is two and two.prev_element is one and one.next.value == "text" and two.closest("div") is div
    with pytest.raises(ValueError):
        one.append_child(div)
    with pytest.raises(ValueError):
        div.remove_child(dom.create_element("p"))
    div.insert_before(two, one)
    assert div.inner_html == "<p>2</p><p>1</p>text"
    copy = div.clone()
    div.replace_child(dom.create_text("<x>"), one)
    two.decompose()
    assert div.inner_html == "&lt;x&gt;text" and copy.inner_html == "<p>2</p><p>1</p>text"
    div.text = "new"
    div.add_class("k")
    assert div.html == '<div class="k">new</div>' and not div.toggle_class("k")
    assert t.body.matches(".nope, div") and not t.body.matches_self("div")


def test_traversal_has_no_end_for_leaves():
    seen = []
    dom.traverse(parse("<p>a<b></b></p>").body, lambda n, d: seen.append((n.tag or n.value, d)), lambda n, d: seen.append(("/" + n.tag, d)))
    assert seen == [("body", 0), ("p", 1), ("a", 2), ("b", 2), ("/p", 1), ("/body", 0)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<a>", "</a>", "<svg>", "</svg>", "<i>", "</i>", "x", "<br>", "</br>", "<!-- c -->", "<script>", "</script>", "<", "&", "<head>", "<title>"]), max_size=25))
def test_any_input_gives_a_sound_tree(parts):
    t = parse("".join(parts))
    for n in t.document.walk():
        assert all(c.parent is n for c in n.children)
    assert t.head.parent is t.body.parent


def test_formatting_closed_inside_foreign_content():
    t = parse("<i><p><svg></i><p>x")
    assert t.body.text == "x" and t.body.get_elements_by_tag_name("svg")


def test_deep_and_wide_pages_take_linear_time():
    import time

    started = time.process_time()
    deep = parse("<div class=x>" * 8000 + "text" + "</div>" * 8000)
    assert deep.document.html.count("<div") == 8000 and deep.document.clone().html == deep.document.html
    wide = parse("<ul>" + "<li>x" * 20_000).document
    assert len(wide.query_selector_all("li:nth-child(3n)")) == 6666 and len(wide.query_selector_all("li:nth-last-of-type(2n+1)")) == 10_000
    assert len(wide.query_selector_all("li + li")) == 19_999
    assert time.process_time() - started < 3


def test_places_follow_mutation():
    ul = parse("<ul><li>1<b>x</b></li><p>2</p><li>3</li></ul>").body.query_selector("ul")
    assert [n.text for n in ul.query_selector_all(":nth-child(2)")] == ["2"] and ul.last_child.index == 2
    ul.insert_before(dom.create_element("li"), ul.first_child)
    assert [n.text for n in ul.query_selector_all("li:nth-of-type(2)")] == ["1x"] and ul.last_child.index == 3
    ul.remove_child(ul.first_child)
    ul.first_child.before(moved := ul.last_child)
    assert moved.index == 0 and moved.prev is None and moved.next.text == "1x" and ul.query_selector(":last-child").text == "x"
    assert [n.text for n in ul.query_selector_all("p:only-of-type")] == ["2"]
    ul.replace_children(dom.create_text("t"), dom.create_element("i"))
    assert ul.html == "<ul>t<i></i></ul>" and moved.parent is None and ul.elements[0].index == 1


def test_collections():
    body = parse("<div id=a class=k><p name=n>1<div class=k><p id=b>2</p></div></div><p>3</p>").body
    divs = body.get_elements_by_tag_name("div")
    assert [n.text for n in divs.query_selector_all("p")] == ["1", "2", "2"]  # concatenated, not made distinct
    assert isinstance(divs[::-1], dom.Nodes) and divs[-1] is divs[1] and [n.id for n in divs[:1]] == ["a"]
    assert divs.get_element_by_id("b").text == "2" and divs.query_selector("p").text == "1" and divs.matches("#b")
    ps = body.get_elements_by_tag_name("p")
    assert ps.named_item("n").text == "1" and ps.named_item("b").text == "2" and ps.named_item("") is None
    assert [n.text for n in ps.matching("div div p")] == ["2"] and len(divs.get_elements_by_class_name("k")) == 1 and len(divs.get_elements_by_attr("id", "b")) == 2


def test_character_data_tokens_and_doctypes():
    t = dom.create_text("abcdef")
    t.replace_data(1, 2, "X")
    t.insert_data(0, "<")
    t.append_data(">")
    t.delete_data(3, 100)
    assert t.value == "<aX" and t.substring_data(1, 9) == "aX"
    p = parse("<p class='a b'>").body.first_child
    assert p.replace_class("a", "b") and p.class_name == "b" and not p.replace_class("q", "r")
    assert p.toggle_attr("hidden") and "hidden" in p.attrs and not p.toggle_attr("hidden") and p.toggle_attr("hidden", True)
    kind = lambda page: next(n for n in parse(page).document.children if n.kind == dom.DOCTYPE).doctype_ids
    assert kind("<!doctype html>") == ("html", "", "") and kind("<!DOCTYPE html SYSTEM 'about:legacy'>") == ("html", "", "about:legacy")
    assert kind('<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://x/s.dtd">') == ("html", "-//W3C//DTD HTML 4.01//EN", "http://x/s.dtd")
    assert parse(b"<p>\xff\xc3\xa9").body.text == "\ufffd\u00e9"
