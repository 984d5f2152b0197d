"""Selectors: the matcher on trees, and the join plan against it on random trees."""

import random

import pytest

from sylvan.html.parser import parse
from sylvan.html.select import SelectorError, parse_selector, query
from sylvan.operators import nodes_to_pages, parse_html, select, select_one, to_text

PAGE = '<div id=a class="x y"><p>1<p class=x>2<!--c--></div><div><span></span><p data-k="a-b">3 <b>4</b></div>'
CASES = {
    "p": 3, "*": 10, "#a": 1, ".x": 2, "[class]": 2, "[data-k|=a]": 1, "[data-k^=a]": 1, "[data-k$=b]": 1, "[data-k*='-']": 1, "[class~=y]": 1, "[data-k='']": 0,
    "div > p": 3, "div p b": 1, "p + p": 1, "span ~ p": 1, "p:first-child": 1, "p:last-child": 2, "b:only-child": 1, "p:nth-child(2n)": 2, "p:nth-of-type(1)": 2,
    "p:not(.x)": 2, "p:not(div + div p)": 2, ":empty": 2, "html:root": 1, 'p:contains("4")': 1, ":comment": 1, "p:nth-child(z)": 0, "b, span, b": 2, "div:has-no": -1,
    "p:nth-child(odd)": 1, "p:only-of-type": 1, "body > div:first-of-type": 1, "span:last-of-type": 1,
}


@pytest.mark.parametrize("selector", CASES)
def test_counts(selector):
    if CASES[selector] < 0:
        with pytest.raises(SelectorError):
            parse_selector(selector)
    else:
        assert len(query(parse(PAGE), selector)) == CASES[selector]


def test_bad_selectors():
    for bad in ("", "a >", "[x", ":nth-last-child(1)", "a b)", ":contains()x(", "..a", ":contains"):
        with pytest.raises(SelectorError):
            parse_selector(bad)


def test_greedy_descendant():
    """The nearest ancestor is taken, so a farther one that would do isn't tried."""
    root = parse("<x><b><i><b><c></c></b></i></b></x>", fragment=True)
    assert query(root, "x > b c") == []
    assert len(query(root, "x b c")) == 1


def test_plan_equals_matcher(spark):
    random.seed(5)

    def tree(depth):
        if depth == 0:
            return random.choice(["", "t", " "])
        tag = random.choice(["div", "span", "section", "i"])
        attrs = random.choice(["", " class=x", " class='x y'", " id=a", " title=q-r"])
        return f"<{tag}{attrs}>{''.join(tree(depth - 1) for _ in range(random.randint(0, 3)))}</{tag}>"

    pages = [(i, "".join(tree(4) for _ in range(3)) + "<!--c-->") for i in range(25)] + [(100, None), (101, "")]
    nodes = parse_html(spark.createDataFrame(pages, "page_id bigint, html string")).cache()
    selectors = [
        "div", ".x > span", "div span", "div > div i", "i ~ span", "i + span", "section:not(.y) .x", ":empty", "div:nth-child(2n+1)", "*:not(div span)", "div:contains('t')",
        "span ~ div i", "div + span ~ i", ":root > *", "i, .y", ":comment", "[title|=q]", "span:last-of-type", "div > span + i", "i ~ i i",
    ]
    for s in selectors:
        got = {(r.page_id, r.pre) for r in select(nodes, s).select("page_id", "pre").collect()}
        want = set()
        for i, html in pages:
            root = parse(html)
            order = {id(root): 0} | {id(n): k for k, n in enumerate(root.descendants(), 1)}
            want |= {(i, order[id(n)]) for n in query(root, s)}
        assert got == want, s


def test_text_and_pages(spark):
    pages = spark.createDataFrame([(1, "<title>t</title><p>a <b>b</b></p><p>c"), (2, None)], "page_id int, html string")
    nodes = parse_html(pages)
    assert {tuple(r) for r in to_text(nodes, select(nodes, "p, b")).drop("pre").collect()} == {(1, "a b"), (1, "b"), (1, "c")}
    assert [r.name for r in select_one(nodes, "p, title").collect()] == ["title"]
    assert {r.page_id: r.output for r in nodes_to_pages(nodes).collect()} == {1: parse(pages.first().html).to_html(), 2: parse(None).to_html()}


def test_matching_has_a_budget():
    from sylvan.html.select import SelectorError, SelectorLimits, query

    root = parse("<div>" * 30 + "<p>a</p>" * 50)
    assert len(query(root, "div div p")) == 50
    for limits in (SelectorLimits(match_steps=100), SelectorLimits(match_bytes=10)):
        with pytest.raises(SelectorError):
            query(root, "div div p:contains('b'), div:contains('b')", limits)
