"""Tree construction: small documents, and the tree each gives."""

import pytest

from sylvan.html.errors import parse_errors
from sylvan.html.parser import FragmentContext, parse
from sylvan.html.testformat import to_test_format

BODY = {
    "a & b &amp; &copy &notit; &#x80;": '"a & b & © ¬it; €"',
    "<p>a<p>b": '<p>\n  "a"\n<p>\n  "b"',
    "<b><p>x</b>y": '<b>\n<p>\n  <b>\n    "x"\n  "y"',
    "<a>1<a>2": '<a>\n  "1"\n<a>\n  "2"',
    "<table>t<tr><td>c": '"t"\n<table>\n  <tbody>\n    <tr>\n      <td>\n        "c"',
    "<ul><li>a<li>b</ul>c": '<ul>\n  <li>\n    "a"\n  <li>\n    "b"\n"c"',
    "<svg viewbox=1><circle/><p>x": '<svg svg>\n  viewBox="1"\n  <svg circle>\n<p>\n  "x"',
    "<script>a</p><!--<script></script>--></script>b": '<script>\n  "a</p><!--<script></script>-->"\n"b"',
    "<textarea>\nx</textarea>": '<textarea>\n  "x"',
    "<select><option>a<option>b</select>": '<select>\n  <option>\n    "a"\n  <option>\n    "b"',
    "a</p>x</br>": '"a"\n<p>\n"x"\n<br>',
    "<h1>a<h2>b": '<h1>\n  "a"\n<h2>\n  "b"',
    "<b><b><b><b>x<p>y": '<b>\n  <b>\n    <b>\n      <b>\n        "x"\n        <p>\n          "y"',
    "<div><?pi x?>": "<div>\n  <?pi x?>",
    "x<": '"x<"',
    "x<a href=": '"x"',
    "<template><td>x</template>": "",
}


def indented(text, depth):
    return [f"| {'  ' * depth}{line}" for line in text.split("\n") if line]


@pytest.mark.parametrize("html", BODY)
def test_body(html):
    if html.startswith("<template>"):
        want = ["| <html>", "|   <head>", "|     <template>", "|       content", "|         <td>", '|           "x"', "|   <body>"]
        assert to_test_format(parse(html)).split("\n") == want
        return
    head = ["| <html>", "|   <head>"]
    if html.startswith("<script>"):
        script, rest = BODY[html].rsplit("\n", 1)
        assert to_test_format(parse(html)).split("\n") == [*head, *indented(script, 2), "|   <body>", *indented(rest, 2)]
        return
    assert to_test_format(parse(html)).split("\n") == [*head, "|   <body>", *indented(BODY[html], 2)]


def test_noahs_ark():
    root = parse("<p><b><b><b><b>x<p>y")
    assert sum(n.name == "b" for n in root.query("p")[1].descendants()) == 3


def test_fragment_contexts():
    assert parse("<td>x", context=FragmentContext("tr")).to_html() == "<td>x</td>"
    assert parse("<td>x", fragment=True).to_html() == "x"
    assert parse("a</title>b", context=FragmentContext("title")).to_text() == "a</title>b"
    assert parse(None).to_html() == parse("").to_html() == "<html><head></head><body></body></html>"


def test_doctype_and_quirks():
    assert parse("<!doctype html><p><table>").query_one("p > table") is None
    assert parse("<p><table>").query_one("p > table") is not None
    assert parse('<!DOCTYPE html PUBLIC "a" "b">').children[0].data.system_id == "b"


def test_written_again_is_the_same():
    for html in BODY:
        once = parse(html).to_html()
        if "<p>" not in html:
            assert parse(once).to_html() == once


def test_deep_nesting_is_no_recursion():
    root = parse("<div>" * 5000 + "x")
    assert root.to_text() == "x"
    assert len(root.to_html()) > 50000
    assert "x" in root.to_markdown()


def test_errors():
    codes = [(e.code, e.line, e.column) for e in parse_errors("<p>a\n</b>\0<i x")]
    assert [c for c, _, _ in codes] == ["expected-doctype-but-got-start-tag", "unexpected-end-tag", "unexpected-null-character", "eof-in-tag"]
    assert codes[1][1:] == (2, 1)
    assert parse_errors("<!doctype html><p>x</p>") == []
    assert len(parse_errors("</a>" * 50, fragment=True, most=3)) == 3


def test_xml_coercion_and_literal():
    assert parse("<p>a\fb", xml_coercion=True).to_text() == "a b"
    assert parse("x<!--c--></b>y<", fragment=True, literal=True).to_text("", False) == "x<!--c--></b>y<"
