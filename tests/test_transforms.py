import pytest

from sylvan.html import transforms as X
from sylvan.html.parser import parse
from sylvan.html.policy import DEFAULT_POLICY, SanitizationPolicy, UnsafeHtmlError
from sylvan.html.urls import UrlPolicy, UrlProxy, UrlRule, clean_sink, clean_style, clean_url, clean_url_value
from sylvan.operators import nodes_to_pages, parse_html, transform_nodes


def after(html, *specs, errors=None, policy=None):
    return X.apply_transforms(parse(html, fragment=True), specs, errors, policy).to_html()


CASES = [
    ("<a>x</a>", X.SetAttrs("a", href="/"), '<a href="/">x</a>'),
    ("<p>a</p><i>b</i>", X.Drop("p"), "<i>b</i>"),
    ("<p>a</p><p>b</p><p>c</p>", X.Drop("p:first-child"), ""),
    ("<b>a<i>b</i></b>", X.Unwrap("b"), "a<i>b</i>"),
    ("<b x=1>a</b>", X.Escape("b"), "&lt;b x=1&gt;a&lt;/b&gt;"),
    ("<b>a", X.Escape("b"), "&lt;b&gt;a"),
    ("<p>a<b>c</b></p>", X.Empty("p"), "<p></p>"),
    ("<p>a</p>", X.Edit("p", lambda n: n.append_child(parse("<u>z</u>", fragment=True))), "<p>a<u>z</u></p>"),
    ("<p>a</p><i>b</i>", X.Decide("*", lambda n: X.Decision.UNWRAP if n.name == "p" else X.Decision.KEEP), "a<i>b</i>"),
    ("<p a=1 b=2>", X.EditAttrs("p", lambda n: {"c": "3"}), '<p c="3"></p>'),
    ("see http://a.com <code>http://b.com</code>", X.Linkify(), 'see <a href="http://a.com">http://a.com</a> <code>http://b.com</code>'),
    ("<p> a \n b <b> c</b> </p>", X.CollapseWhitespace(), "<p>a b <b> c</b></p>"),
    ("a<!--b--><?pi?>c", X.DropComments(), "ac"),
    ("<svg><script>x", X.DropForeignNamespaces(), ""),
    ("<p onclick=1 data-a=2 id=3>", X.DropAttrs("*", ("on*", "data-?")), '<p id="3"></p>'),
    ("<p id=1 x=2><b x=1>", X.AllowlistAttrs("*", {"*": ["id"], "b": ["x"]}), '<p id="1"><b x="1"></b></p>'),
    ("<a rel='B a' href=x>", X.MergeAttrs("a", "rel", ("c", "a")), '<a rel="b a c" href="x"></a>'),
    ("<div><p> </p><i></i></div><br>", X.PruneEmpty("*"), "<br>"),
    ("<p>​a</p>", X.StripInvisible(), "<p>a</p>"),
    ("<p>a</p>", X.Drop("p", enabled=False), "<p>a</p>"),
    ("<b><p>x</p></b>", X.Stage([X.Unwrap("b"), X.Stage([X.Drop("p")])]), ""),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_one(case):
    html, spec, want = CASES[case]
    assert after(html, spec) == want


def test_no_links_where_only_text_can_be():
    html = "<title>a@b.com</title><textarea>a@b.com</textarea><iframe>a@b.com</iframe>"
    assert after(html, X.Linkify(skip_tags=())) == html
    assert after("<svg><title>b.com</title></svg>", X.Linkify()) == '<svg><title><a href="http://b.com">b.com</a></title></svg>'


def test_order_in_one_walk():
    assert after("<b>x</b>", X.Unwrap("b"), X.Drop("i")) == "x"
    assert after("<b><i>x</i></b>", X.Drop("i"), X.Unwrap("b")) == "<i>x</i>"  # hoisted after Drop had its turn
    assert after("<b><i>x</i></b>", X.Unwrap("b"), X.Drop("i")) == ""


def test_callbacks_and_errors():
    errors, seen = [], []
    after("<p>a</p>", X.Edit("p", lambda n: X.emit_error("mine", node=n)), X.Drop("p", callback=seen.append, report=lambda m, node: seen.append(m)), errors=errors)
    assert [e.code for e in errors] == ["mine"] and len(seen) == 2
    X.emit_error("outside")


def test_sanitizer():
    html = '<p onclick=x style=a><script>1</script><nav><a href="javascript:x" title=t>l</a><a href="//h/x">m</a></nav><img src="/i"><img src="http://x/i"><!--c-->'
    assert after(html, X.Sanitize()) == '<p></p><a title="t">l</a><a href="https://h/x">m</a><img src="/i"><img>'
    assert X.sanitize(parse("<title>t</title><nav>x")).to_html() == "<html><head><title>t</title></head><body>x</body></html>"
    with pytest.raises(UnsafeHtmlError):
        X.sanitize(parse("<nav>x"), SanitizationPolicy(["p"], {}, unsafe_handling="raise"))
    errors = []
    X.sanitize(parse("<p>\n<nav>x", fragment=True), SanitizationPolicy(["p"], {}, unsafe_handling="collect"), errors)
    assert [(e.code, e.line, e.column) for e in errors] == [("unsafe-html", 2, 1)]
    escape = SanitizationPolicy(["p"], {}, disallowed_tag_handling="escape")
    assert X.sanitize(parse("<p><x>a</x>", fragment=True), escape).to_html() == "<p>&lt;x&gt;a&lt;/x&gt;</p>"
    with pytest.raises(ValueError):
        SanitizationPolicy(["p"], {"p": ["style"]})
    styles = SanitizationPolicy(["style"], {}, drop_content_tags=())
    assert X.sanitize(parse("<style>a{b:url(x)}</style><style>p{}</style>", fragment=True), styles).to_html() == "<style></style><style>p{}</style>"
    assert X.with_sanitize([X.Stage([X.Sanitize()])])[-1] != X.Sanitize() and X.with_sanitize([])[-1] == X.Sanitize()


def test_urls():
    rule = UrlRule(allowed_schemes=("https", "mailto"))
    for value, want in {
        "https://a/b": "https://a/b", " /x ": "/x", "#f": "#f", "//h/p": "https://h/p", "http://a": None, "java\nscript:x": None, "a\\b": None, "": None,
        "mailto:x@y": "mailto:x@y", "https:x": "https:x", "ja​vascript:x": None,
    }.items():
        assert clean_url(value, rule) == want, value
    hosts = UrlRule(allowed_schemes=("http",), allowed_hosts=frozenset({"a.com", "1.2.3.4"}))
    assert clean_url("http://u@A.com:80/x", hosts) and clean_url("http://a.com.evil/x", hosts) is None and clean_url("http://0x01020304/", hosts) is None
    proxied = UrlRule(allowed_schemes=("http",), handling="proxy", proxy=UrlProxy("/p?x=1", "u"))
    policy = UrlPolicy(allow_rules={("img", "src"): proxied, ("img", "srcset"): UrlRule(("https",), handling="allow"), ("meta", "content"): UrlRule(("https",), handling="allow")})
    assert clean_sink("http://a/b c", "img", "src", "url", policy) == "/p?x=1&u=http%3A%2F%2Fa%2Fb%20c"
    assert clean_sink("/a 1x, https://b 2w", "img", "srcset", "srcset", policy) == "/a 1x, https://b 2w"
    assert clean_sink("/a 1x, http://b 2w", "img", "srcset", "srcset", policy) is None
    assert clean_sink("5; url='https://a'", "meta", "content", "meta_refresh", policy) == "5;url=https://a"
    assert clean_url_value("https://a/?b&amp;c d", rule) == "https://a/?b&c%20d"
    for bad in ("/p#f", "/p?u=1", "ftp://x"):
        with pytest.raises(ValueError):
            UrlProxy(bad, "u")


def test_styles():
    allowed = frozenset({"color", "background-image"})
    assert clean_style("color: red; x: y; COLOR:expression(1); color: u/**/rl(x); color: inherit", allowed) == "color: red"
    policy = UrlPolicy(default_handling="allow", allow_rules={("*", "style:background-image"): UrlRule(("https",))})
    assert clean_style("background-image: URL( \"https://a/b\" )", allowed, "p", policy) == "background-image: url('https://a/b')"
    assert clean_style("background-image: url(http://a/b)", allowed, "p", policy) is None


def test_table_and_walk_agree(spark):
    pages = [(1, "<nav><p class=a>x</p>y</nav><p>z<!--c--><b>w</b></p><div><script>1</script></div>"), (2, None), (3, "<ul><li>a<li class=a>b<li>c</ul>")]
    specs = [X.Drop("script, .a"), X.Empty("nav"), X.DropComments(), X.DropDoctype(), X.SetAttrs("p", {"id": "q"}), X.DropAttrs("b", ("x*",)), X.AllowlistAttrs("li", {"*": ["id"]}), X.MergeAttrs("p", "rel", ("t",))]
    frame = spark.createDataFrame(pages, "page_id bigint, html string")
    by_join = {r.page_id: r.asDict(True) for r in nodes_to_pages(transform_nodes(parse_html(frame), specs)).collect()}
    for i, html in pages:
        assert by_join[i]["output"] == X.apply_transforms(parse(html), specs).to_html()
    want = {(r.page_id, r.pre): r for r in parse_html(frame, transforms=specs).collect()}
    for r in transform_nodes(parse_html(frame), specs).collect():
        w = want[r.page_id, r.pre]
        for c in ("last", "parent_pre", "name", "elem_idx", "elem_cnt", "type_idx", "type_cnt", "prev_elem_pre", "is_empty", "attrs", "data"):
            assert r[c] == w[c], (r.page_id, r.pre, c)
    walked = [X.Unwrap("nav"), X.Linkify(), X.PruneEmpty("*")]
    assert {r.output for r in nodes_to_pages(transform_nodes(parse_html(frame), walked)).collect()} == {X.apply_transforms(parse(h), walked).to_html() for _, h in pages}


def test_many_pages_are_renumbered_at_a_time(spark):
    """Pages that end inside Arrow batches, fill several, or have a null id are renumbered as they are one by one, without a call for each page."""
    some = "<nav><p>x</p></nav><p>z<!--c--><b>w</b></p><ul><li>a<li>b<i>c</i></ul><script>1</script>"
    pages = [(f"p{i:02}", some * (40 if i % 9 == 0 else i % 4)) for i in range(40)] + [(None, some), ("", "")]
    frame = spark.createDataFrame(pages, "page_id string, html string").repartition(3)
    specs = [X.Drop("script, i"), X.Empty("nav"), X.DropComments()]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        left = transform_nodes(parse_html(frame), specs)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and plan.count("Exchange hashpartitioning") == 1
        columns = ("page_id", "pre", "last", "parent_pre", "name", "elem_idx", "elem_cnt", "type_idx", "type_cnt", "prev_elem_pre", "is_empty", "data")
        rows = lambda nodes: sorted(map(repr, nodes.select(*columns).collect()))
        assert rows(left) == rows(parse_html(frame, transforms=specs))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_default_policy_is_frozen():
    with pytest.raises(AttributeError):
        DEFAULT_POLICY.drop_comments = False
