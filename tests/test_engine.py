"""Queries against their SQL on the smallest tables, sources, streams and the command line."""

import os

import pytest

import __spark_entry__
from sylvan import cli
from sylvan.functions.sql import register
from sylvan.html import builder as B
from sylvan.html import transforms as X
from sylvan.html.policy import SanitizationPolicy
from sylvan.operators import html_errors, html_events, nodes_to_pages, parse_html, run, transform_errors
from sylvan.queries import ORACLES, QUERIES
from sylvan.sources import nodes_from_trees, pages_from_files, pages_from_parquet, pages_from_text
from sylvan.streaming import page_stream, stream_output, write_stream

SF = "/root/testdata/sf0.001"


def rows(frame):
    text = lambda v: "" if v is None or v != v else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in ("pages", "documents"):
        p = f"{SF}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        assert rows(got) == rows(duck.execute(ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["page_id", "position", "href", "text"]
    assert set(ORACLES) <= set(__spark_entry__.queries())


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"\xff\xfea\x00")
    (tmp_path / "b.html").write_bytes(b"<meta charset=latin1>\x93")
    got = {r.encoding: r.html for r in pages_from_files(spark, str(tmp_path)).collect()}
    assert got == {"utf-16le": "a", "windows-1252": "<meta charset=latin1>“"}
    assert pages_from_parquet(spark, f"{SF}/pages.parquet", 3).rdd.getNumPartitions() == 3
    (tmp_path / "b.html").unlink()
    (tmp_path / "a.html").write_text("x\ny")
    assert pages_from_text(spark, str(tmp_path)).first().html == "x\ny"


def test_run_events_errors(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><p>b", 5), (2, None, 6)], "page_id string, html string, output int")
    assert {r.page_id: (r.matches, r.output) for r in run(pages, selector="p", format="text").collect()} == {"1": (2, "a\nb"), "2": (0, None)}
    assert run(pages, selector="p", first=True, format="markdown").where("matches = 1").first().output == "a"
    assert html_events(pages).where("event = 'start'").count() == 2
    assert html_errors(pages).first().code == "expected-doctype-but-got-start-tag"
    with pytest.raises(Exception, match="DOCTYPE"):
        html_errors(pages, strict=True).collect()
    empty = pages.limit(0)
    assert html_events(empty).count() == run(empty).count() == html_errors(empty).count() == 0


def test_stream(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a")], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "in"))
    out = stream_output(page_stream(spark, str(tmp_path / "in")), selector="p", format="text")
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_command_line(tmp_path, capsys):
    page = tmp_path / "p.html"
    page.write_text("<!doctype html><p>a <b>b</b><script>x</script><p><a>c</a>")
    assert cli.main([str(page), "--selector", "p", "--format", "text"]) == 0
    assert capsys.readouterr().out == "a b\nc\n"
    assert cli.main([str(page), "--selector", "q"]) == 1
    assert cli.main([str(page), "--selector", "::"]) == 2
    assert cli.main([str(page), "--strict", "--fragment"]) in (0, 2)
    assert cli.main([str(page), "--cleanup", "--output", str(tmp_path / "o")]) == 0
    assert "<a>" not in (tmp_path / "o").read_text()


def test_sql_names(spark):
    assert "html_events" in register(spark)
    spark.createDataFrame([(1, "<p>a &amp; b<script>x</script>")], "page_id int, html string").createOrReplaceTempView("some_pages")
    assert spark.sql("SELECT html_text(html), html_unescape('&lt;') FROM some_pages").first()[:] == ("a & b", "<")
    got = spark.sql("SELECT e.event, e.name FROM some_pages, LATERAL html_events(html) e WHERE e.event = 'start'").collect()
    assert [r.name for r in got] == ["p", "script"]


def test_built_trees_and_places(spark):
    nodes = nodes_from_trees(spark, {7: B.document(B.element("html", None, B.element("p[id=x]", "t", B.comment("c"))))})
    assert nodes_to_pages(nodes).first().output == '<html><p id="x">t<!--c--></p></html>'
    pages = spark.createDataFrame([(1, "<!doctype html>\n<p>a\n<b>x</b><!--c-->")], "page_id int, html string")
    where = {r.name: (r.origin_offset, r.origin_line, r.origin_col) for r in parse_html(pages, locations=True).collect()}
    assert where["p"] == (16, 2, 1) and where["b"] == (21, 3, 1) and where["#comment"] == (29, 3, 9)
    assert {r.origin_line for r in parse_html(pages).collect()} == {None}


def test_transform_errors(spark):
    pages = spark.createDataFrame([(1, "<p>\n<nav>x</nav>")], "page_id int, html string")
    policy = SanitizationPolicy(["p"], {}, unsafe_handling="collect")
    found = transform_errors(pages, [X.Sanitize(policy=policy), X.Edit("p", lambda n: X.emit_error("mine"))], fragment=True).collect()
    assert [(r.code, r.line) for r in found] == [("mine", 0), ("unsafe-html", 2)]
