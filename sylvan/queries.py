"""The registered queries of the HTML engine, and the same in SQL where SQL can say it over the generated pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golden
from .functions import text as T
from .html import transforms as X
from .html.policy import DEFAULT_POLICY
from .html.urls import UrlPolicy, UrlRule
from .operators import attr, find_nodes, html_errors, html_events, nodes_to_pages, parse_html, parse_nodes, run, select, transform_nodes
from .sources import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dealt to all cores where the table is so small that its files make fewer splits: parsing is work for each row."""
    pages = _table(spark, sf_dir, "pages")
    cores = spark.sparkContext.defaultParallelism
    small = pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores << 27
    return pages.repartition(cores) if small else pages


def _nodes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return parse_html(_pages(spark, sf_dir), **options)


def page_title(spark, sf):
    found = find_nodes(_pages(spark, sf), {"title": "head > title"}, first=True)
    return found.select("page_id", F.col("text").alias("title"))


def page_lang_counts(spark, sf):
    found = select(_nodes(spark, sf), "html[lang]")
    return found.groupBy(attr("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n_pages"))


def nav_links(spark, sf):
    found = find_nodes(_pages(spark, sf), {"links": "nav a[href]"})
    return found.select("page_id", F.col("seq").alias("position"), attr("href").alias("href"), "text")


def nav_link_places(spark, sf):
    places = {"first": "li:first-child > a", "last": "nav li:last-child > a", "odd": "nav li:nth-child(odd) > a", "third": "nav li:nth-of-type(3) a"}
    return find_nodes(_pages(spark, sf), places).select("page_id", F.col("selector").alias("place"), attr("href").alias("href"))


def comments(spark, sf):
    return select(_nodes(spark, sf), ":comment").select("page_id", F.col("data").alias("comment"))


def sibling_counts(spark, sf):
    """Adjacent and general siblings, a list, and a negation, as joins over a node table that is parsed and written once."""
    nodes = materialize(_nodes(spark, sf).select("page_id", "pre", "last", "parent_pre", "prev_elem_pre", "name", "attrs"))
    out = None
    for name, selector in (("nav ~ div.ad", "nav ~ div.ad"), ("div.ad + article", "div.ad + article"), ("h1, title", "h1, title"), ("a:not(nav a)", "a:not(nav a)")):
        one = select(nodes, selector).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("selector"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def tag_counts(spark, sf):
    nodes = _nodes(spark, sf).where("name in ('p', 'li', 'br', 'a')")
    return nodes.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


def bold_counts(spark, sf):
    """Unclosed <b>: each paragraph brings back up to three."""
    return _nodes(spark, sf).where("name = 'b'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def event_counts(spark, sf):
    events = html_events(_pages(spark, sf)).where("event in ('start', 'end') and name in ('p', 'a', 'li', 'script', 'article')")
    return events.groupBy("event", "name").agg(F.count(F.lit(1)).alias("n"))


def sanitized_links(spark, sf):
    nodes = _nodes(spark, sf, sanitize=True)
    return nodes.where("name in ('a', 'nav', 'article', 'script', 'style')").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count(attr("href")).alias("n_href"))


RULE = UrlRule(allowed_schemes=("https",), handling="allow")
HOST_RULE = UrlRule(allowed_schemes=("http", "https"), handling="allow", allowed_hosts=frozenset({"www.example.com", "blog.example.net"}))


def url_clean(spark, sf):
    pages = _table(spark, sf, "pages")
    return pages.select("page_id", T.clean_url(F.col("url"), RULE).alias("https_only"), T.clean_url(F.col("url"), HOST_RULE).alias("known_hosts"))


def escapes(spark, sf):
    docs = _table(spark, sf, "documents")
    return docs.select(
        "doc_id", F.md5(T.escape_text(F.col("text"))).alias("html"), F.md5(T.escape_attr_value(F.col("text"))).alias("attr"), F.md5(T.escape_js_string(F.col("text"))).alias("js"), F.md5(T.strip_invisible(F.col("text"))).alias("visible")
    )


def emails(spark, sf):
    docs = _table(spark, sf, "documents").where(F.col("text").contains("@"))
    links = docs.select("doc_id", F.explode(T.find_links(F.col("text"), extra_tlds=("example",))).alias("l")).where("l.kind = 'email'")
    return links.select("doc_id", F.col("l.text").alias("email"), F.col("l.href").alias("href"))


def ipv4(spark, sf):
    docs = _table(spark, sf, "documents").where(F.col("text").rlike(r"\d\.\d"))
    links = docs.select("doc_id", F.explode(T.find_links(F.col("text"), fuzzy_ip=True)).alias("l")).where(F.col("l.text").rlike(r"^\d+\.\d+\.\d+\.\d+$"))
    return links.select("doc_id", F.col("l.text").alias("address"))


def encoding_labels(spark, sf):
    """Label normalization over the source names and a few known labels."""
    labels = spark.createDataFrame([(x,) for x in (" UTF8 ", "latin1", "utf-7", "ISO-8859-2", "eucjp", "utf-16LE", "koi8-r", "")], "label string")
    return labels.select("label", T.normalize_encoding_label(F.col("label")).alias("encoding"))


def relational_transforms(spark, sf):
    """Drop, Empty, SetAttrs and DropComments as windows over the node table; then element counts of what is left."""
    specs = [X.Drop("script, style"), X.Empty("nav"), X.SetAttrs("a", {"rel": "nofollow"}), X.DropComments()]
    left = transform_nodes(_nodes(spark, sf), specs)
    return left.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("name in ('nav', 'li', 'a', '#comment', 'script', 'style', 'article', 'title')")


def decoded_pages(spark, sf):
    """Bytes in, text and detected encoding out."""
    pages = _table(spark, sf, "pages")
    got = T.decode_html(F.encode(F.col("html"), "UTF-8"), F.lit(None).cast("string"))
    return pages.select("page_id", got.alias("d")).select("page_id", F.col("d.encoding").alias("encoding"), F.md5("d.html").alias("digest"))


def decoded_bytes(spark, sf):
    """Pages as bytes in UTF-16 with a mark, in Latin-1 as declared by a server, and in Latin-1 as their own meta element says."""
    pages = _table(spark, sf, "pages").where(~F.col("html").rlike("[^\\x00-\\xFF]"))
    named = F.replace(F.col("html"), F.lit('charset="utf-8"'), F.lit('charset="iso-8859-1"'))
    out = None
    for how, raw, label in (("mark", F.encode("html", "UTF-16"), None), ("declared", F.encode("html", "ISO-8859-1"), "latin1"), ("meta", F.encode(named, "ISO-8859-1"), None)):
        one = pages.select("page_id", F.lit(how).alias("how"), T.decode_html(raw, F.lit(label).cast("string")).alias("d")).select("page_id", "how", F.col("d.encoding").alias("encoding"), F.md5("d.html").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def sanitized_html(spark, sf):
    return run(_pages(spark, sf)).select("page_id", "output")


def page_text(spark, sf):
    return _pages(spark, sf).select("page_id", T.html_to_text(F.col("html"), "\n", separator_blocks_only=True).alias("text"))


def page_markdown(spark, sf):
    return run(_pages(spark, sf), selector="article", format="markdown", sanitize=False, first=True)


def pretty_html(spark, sf):
    return _pages(spark, sf).select("page_id", T.html_to_html(F.col("html"), pretty=True).alias("output"))


def cleaned_html(spark, sf):
    return run(_pages(spark, sf), cleanup=True, policy=DEFAULT_POLICY)


def walked_transforms(spark, sf):
    specs = [X.Unwrap("nav li"), X.Decide(".ad", lambda n: X.Decision.DROP), X.Linkify(), X.CollapseWhitespace(), X.PruneEmpty("p, div"), X.Stage([X.Escape("b")])]
    return run(_pages(spark, sf), transforms=specs, sanitize=False).select("page_id", "output")


def page_errors(spark, sf):
    return html_errors(_pages(spark, sf)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def contains_text(spark, sf):
    return find_nodes(_pages(spark, sf), {"footer": 'footer:contains("©")'}).select("page_id", "name")


def tree_dump(spark, sf):
    return nodes_to_pages(_nodes(spark, sf), "test")


def reparsed_html(spark, sf):
    """Node trees as the source: hardened, written, parsed again and sanitized; then written."""
    return nodes_to_pages(parse_nodes(_nodes(spark, sf)))


def srcset_clean(spark, sf):
    rule = UrlPolicy(default_handling="allow", allow_rules={("img", "srcset"): UrlRule(allowed_schemes=("https", "http"))})
    pages = _table(spark, sf, "pages")
    return pages.select("page_id", T.clean_srcset(F.concat(F.col("url"), F.lit(" 1x, /x.png 2x")), rule).alias("srcset"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        page_title, page_lang_counts, nav_links, nav_link_places, comments, sibling_counts, tag_counts, bold_counts, event_counts, sanitized_links,
        url_clean, escapes, emails, ipv4, encoding_labels, relational_transforms, decoded_pages, decoded_bytes, sanitized_html, page_text, page_markdown,
        pretty_html, cleaned_html, walked_transforms, page_errors, contains_text, tree_dump, reparsed_html, srcset_clean,
    )
}

#: Pages without the bodies of script elements.
_BARE = "regexp_replace(html, '<script>.*?</script>', '', 'gs')"
_COUNT = "len(regexp_extract_all({}, '{}'))"

#: The parts of a generated page: n and p say how texts look in HTML output and as plain text, d how many <b> are open around a paragraph.
_N = "replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
_P = "replace(replace(replace(" + _N + ", '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_M = r"regexp_replace(replace(replace(" + _P + r", '&', '&amp;'), '<', '&lt;'), '([\\`*_\[\]])', '\\\1', 'g')"
#: Addresses that end in a known domain, linked.
_MAIL = r"""regexp_replace({}, '([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.(com|net|org))', '<a href="mailto:\1">\1</a>', 'g')"""
#: White space as the indented form writes it.
_W = r"regexp_replace({}, '\s+', ' ', 'g')"
_PARTS = f"""
    page AS (SELECT page_id, {_BARE} AS h, html, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        regexp_extract(html, '<script>(.*?)</script>', 1) AS script, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<footer>([^<]*)', 1) AS footer,
        regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS names,
        regexp_extract_all(html, '<!--(.*?)-->', 1) AS notes, regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1) AS ads FROM pages),
    par AS (SELECT page_id, unnest(range(1, len(t) + 1)) AS i, CAST(unnest(b) = '<p><b>' AS INTEGER) AS b, unnest(t) AS t
        FROM (SELECT page_id, regexp_extract_all(h, '<p>(?:<b>)?') AS b, regexp_extract_all(h, '<p>(?:<b>)?([^<]*)', 1) AS t FROM page)),
    deep AS (SELECT *, CAST(least(sum(b) OVER (PARTITION BY page_id ORDER BY i) - b, 3) + b AS INTEGER) AS d FROM par),
    body AS (SELECT page_id, CAST(least(sum(b), 3) AS INTEGER) AS o,
        string_agg('<p>' || repeat('<b>', d) || {_N.format("t")} || repeat('<br>', b) || repeat('</b>', d) || '</p>', '' ORDER BY i) AS html_p,
        string_agg(trim({_P.format("t")}), chr(10) ORDER BY i) AS text_p,
        string_agg('<p>' || repeat('&lt;b&gt;', d) || {_MAIL.format("trim(" + _W.format(_N.format("t")) + ")")} || repeat('<br>', b) || '</p>', '' ORDER BY i) AS walk_p,
        string_agg(CASE WHEN d = 0 THEN '    <p>' || trim({_W.format(_N.format("t"))}) || '</p>' ELSE '    <p>' || chr(10) || CASE WHEN b = 0 THEN '      ' || repeat('<b>', d) || {_W.format(_N.format("t"))} || repeat('</b>', d) || chr(10)
            ELSE list_aggregate(list_transform(range(1, d), lambda k: repeat('  ', CAST(k AS INTEGER) + 2) || '<b>' || chr(10)) || [''], 'string_agg', '') || repeat('  ', d + 2) || '<b>' || {_W.format(_N.format("t"))} || '<br></b>' || chr(10)
                || list_aggregate(list_transform(range(1, d), lambda k: repeat('  ', d + 2 - CAST(k AS INTEGER)) || '</b>' || chr(10)) || [''], 'string_agg', '') END || '    </p>' END, chr(10) ORDER BY i) AS fine_p,
        string_agg(repeat('**', d) || trim({_M.format("t")}) || repeat('**', d), chr(10) || chr(10) ORDER BY i) AS mark_p,
        string_agg('|       <p>' || chr(10) || list_aggregate(list_transform(range(0, d), lambda k: '| ' || repeat('  ', CAST(k AS INTEGER) + 4) || '<b>' || chr(10)), 'string_agg', '')
            || '| ' || repeat('  ', d + 4) || '"' || {_P.format("t")} || '"' || repeat(chr(10) || '| ' || repeat('  ', d + 4) || '<br>', b), chr(10) ORDER BY i) AS tree_p FROM deep GROUP BY page_id),
    whole AS (SELECT * FROM page JOIN body USING (page_id))"""
_LIST = "list_aggregate(list_transform(range(1, len({0}) + 1), lambda i: {1}), 'string_agg', {2})"
_ITEMS = _LIST.format("names", "'<li><a href=\"' || hrefs[i] || '\">' || " + _N.format("names[i]") + " || '</a></li>'", "''")
_ADS = "coalesce(" + _LIST.format("ads", "'<div class=\"ad\">' || " + _N.format("ads[i]") + " || '</div>'", "''") + ", '')"
_CONTENT = f"'<ul>' || {_ITEMS} || '</ul>' || {_ADS} || '<h1>' || {_N.format('h1')} || '</h1>' || html_p || repeat('<b>', o) || {_N.format('footer')} || repeat('</b>', o)"

ORACLES: dict[str, str] = {
    "page_title": """
        SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title
        FROM pages""",
    "page_lang_counts": "SELECT regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, count(*) AS n_pages FROM pages GROUP BY 1",
    "nav_links": """
        WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
        SELECT page_id, CAST(unnest(range(1, len(h) + 1)) AS INTEGER) AS position,
            replace(replace(replace(unnest(h), '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS href,
            replace(replace(replace(unnest(t), '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS text
        FROM l""",
    "nav_link_places": """
        WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS h FROM pages),
        u AS (SELECT page_id, len(h) AS n, unnest(range(1, len(h) + 1)) AS i, replace(unnest(h), '&amp;', '&') AS href FROM l)
        SELECT page_id, 'first' AS place, href FROM u WHERE i = 1
        UNION ALL SELECT page_id, 'last', href FROM u WHERE i = n
        UNION ALL SELECT page_id, 'odd', href FROM u WHERE i % 2 = 1
        UNION ALL SELECT page_id, 'third', href FROM u WHERE i = 3""",
    "comments": "SELECT page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) AS comment FROM pages",
    "sibling_counts": """
        SELECT 'nav ~ div.ad' AS selector, CAST(sum(len(regexp_extract_all(html, '<div class="ad">'))) AS BIGINT) AS n FROM pages
        UNION ALL SELECT 'div.ad + article', CAST(sum(len(regexp_extract_all(html, '<article>'))) AS BIGINT) FROM pages
        UNION ALL SELECT 'h1, title', CAST(sum(len(regexp_extract_all(html, '<(h1|title)>'))) AS BIGINT) FROM pages
        UNION ALL SELECT 'a:not(nav a)', CAST(sum(len(regexp_extract_all(html, '<a href='))) - sum(len(regexp_extract_all(html, '<li><a href='))) AS BIGINT) FROM pages""",
    "tag_counts": f"""
        WITH s AS (SELECT page_id, {_BARE} AS h FROM pages),
        c AS (SELECT page_id, 'p' AS name, len(regexp_extract_all(h, '<p>')) AS n FROM s
            UNION ALL SELECT page_id, 'li', len(regexp_extract_all(h, '<li>')) FROM s
            UNION ALL SELECT page_id, 'br', len(regexp_extract_all(h, '<br>')) FROM s
            UNION ALL SELECT page_id, 'a', len(regexp_extract_all(h, '<a ')) FROM s)
        SELECT page_id, name, n FROM c WHERE n > 0""",
    "bold_counts": f"""
        WITH s AS (SELECT page_id, regexp_extract_all({_BARE}, '<p>(?:<b>)?') AS p FROM pages),
        u AS (SELECT page_id, unnest(range(1, len(p) + 1)) AS i, CAST(unnest(p) = '<p><b>' AS INTEGER) AS b FROM s),
        c AS (SELECT page_id, b, sum(b) OVER (PARTITION BY page_id ORDER BY i) - b AS before FROM u)
        SELECT page_id, CAST(sum(least(before, 3) + b) + least(sum(b), 3) AS BIGINT) AS n FROM c GROUP BY page_id HAVING sum(b) > 0""",
    "event_counts": f"""
        WITH s AS (SELECT {_BARE} AS h, html FROM pages)
        SELECT 'start' AS event, t AS name, CAST(sum(len(regexp_extract_all(CASE WHEN t = 'script' THEN html ELSE h END, '<' || t || '[ >]'))) AS BIGINT) AS n
        FROM s, (SELECT unnest(['p', 'a', 'li', 'script', 'article']) AS t) GROUP BY t
        UNION ALL SELECT 'end', t, CAST(sum(len(regexp_extract_all(CASE WHEN t = 'script' THEN html ELSE h END, '</' || t || '>'))) AS BIGINT)
        FROM s, (SELECT unnest(['p', 'a', 'li', 'script', 'article']) AS t) GROUP BY t""",
    "sanitized_links": "SELECT 'a' AS name, CAST(sum(len(regexp_extract_all(html, '<a href='))) AS BIGINT) AS n, CAST(sum(len(regexp_extract_all(html, '<a href='))) AS BIGINT) AS n_href FROM pages",
    "url_clean": """
        SELECT page_id, CASE WHEN url LIKE 'https://%' OR url NOT LIKE '%://%' THEN url END AS https_only,
            CASE WHEN regexp_extract(url, '^https?://([^/:?#]*)', 1) IN ('www.example.com', 'blog.example.net') OR url NOT LIKE '%://%' THEN url END AS known_hosts
        FROM pages""",
    "escapes": r"""
        WITH e AS (SELECT doc_id, text, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS h FROM documents)
        SELECT doc_id, md5(h) AS html, md5(replace(h, '"', '&quot;')) AS attr,
            md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), chr(8), '\b'), chr(12), '\f'),
                '<', '\u003c'), '>', '\u003e'), chr(8232), '\u2028'), chr(8233), '\u2029'), '"', '\"')) AS js,
            md5(regexp_replace(text, '[\x{061C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FE00}-\x{FE0F}\x{FEFF}\x{E000}-\x{F8FF}\x{E0100}-\x{E01EF}]', '', 'g')) AS visible
        FROM e""",
    "emails": r"SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS email, 'mailto:' || unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS href FROM documents",
    "ipv4": r"SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b')) AS address FROM documents",
    "encoding_labels": """
        SELECT label, encoding FROM (VALUES (' UTF8 ', 'utf-8'), ('latin1', 'windows-1252'), ('utf-7', 'windows-1252'), ('ISO-8859-2', 'iso-8859-2'),
            ('eucjp', 'euc-jp'), ('utf-16LE', 'utf-16le'), ('koi8-r', NULL), ('', NULL)) t(label, encoding)""",
    "relational_transforms": """
        SELECT 'nav' AS name, CAST(sum(len(regexp_extract_all(html, '<nav>'))) AS BIGINT) AS n FROM pages
        UNION ALL SELECT 'article', CAST(sum(len(regexp_extract_all(html, '<article>'))) AS BIGINT) FROM pages
        UNION ALL SELECT 'title', CAST(sum(len(regexp_extract_all(html, '<title>'))) AS BIGINT) FROM pages
        UNION ALL SELECT * FROM (SELECT 'a', CAST(sum(len(regexp_extract_all(html, '<a href='))) - sum(len(regexp_extract_all(html, '<li><a href='))) AS BIGINT) AS n FROM pages) WHERE n > 0""",
    "page_errors": "SELECT 'unexpected-end-tag' AS code, CAST(sum(len(regexp_extract_all(html, '<script>[^<]*</p>'))) AS BIGINT) AS n FROM pages",
    "contains_text": "SELECT page_id, 'footer' AS name FROM pages WHERE html LIKE '%<footer>%&copy;%'",
    "sanitized_html": f"""
        WITH {_PARTS}
        SELECT page_id, '<!DOCTYPE html><html lang="' || lang || '"><head><title>' || {_N.format("title")} || '</title></head><body>' || {_CONTENT} || '</body></html>' AS output FROM whole""",
    "cleaned_html": f"""
        WITH {_PARTS}
        SELECT page_id, 1 AS matches, {_N.format("title")} || {_CONTENT} AS output FROM whole""",
    "page_text": f"""
        WITH {_PARTS}
        SELECT page_id, trim({_P.format("title")}) || chr(10) || {_P.format("array_to_string(list_transform(names || ads || [h1], lambda x: trim(x)), chr(10))")}
            || chr(10) || text_p || chr(10) || trim({_P.format("footer")}) AS text FROM whole""",
    "page_markdown": f"""
        WITH {_PARTS}
        SELECT page_id, 1 AS matches, '# ' || trim({_M.format("h1")}) || chr(10) || chr(10) || mark_p AS output FROM whole""",
    "pretty_html": f"""
        WITH {_PARTS}
        SELECT page_id, array_to_string(['<!DOCTYPE html>', '<html lang="' || lang || '">', '  <head>', '    <title>' || trim({_W.format(_N.format("title"))}) || '</title>', '  </head>', '  <body>', '    <ul>']
            || list_transform(range(1, len(names) + 1), lambda i: '      <li>' || chr(10) || '        <a href="' || hrefs[i] || '">' || trim({_W.format(_N.format("names[i]"))}) || '</a>' || chr(10) || '      </li>') || ['    </ul>']
            || list_transform(ads, lambda x: '    <div class="ad">' || trim({_W.format(_N.format("x"))}) || '</div>') || ['    <h1>' || trim({_W.format(_N.format("h1"))}) || '</h1>', fine_p,
            '    ' || repeat('<b>', o) || trim({_W.format(_N.format("footer"))}) || repeat('</b>', o), '  </body>', '</html>'], chr(10)) AS output FROM whole""",
    "walked_transforms": rf"""
        WITH {_PARTS}
        SELECT page_id, '<!DOCTYPE html><html lang="' || lang || '"><head><meta charset="utf-8"><title>' || {_W.format(_N.format("title"))} || '</title><style>p{{margin:0}}</style><script>' || script || '</script></head><body><nav><ul>'
            || {_LIST.format("names", "'<a href=\"' || hrefs[i] || '\">' || " + _W.format(_N.format("names[i]")) + " || '</a>'", "''")} || '</ul></nav>' || {_LIST.format("notes", "'<!--' || notes[i] || '-->'", "''")}
            || '<article><h1>' || trim({_W.format(_N.format("h1"))}) || '</h1>' || walk_p || '</article><footer>' || repeat('&lt;b&gt;', o)
            || regexp_replace({_W.format(_N.format("footer"))}, '([a-z0-9-]+(\.[a-z0-9-]+)*\.(com|net|org))', '<a href="http://\1">\1</a>') || '</footer></body></html>' AS output FROM whole""",
    "tree_dump": f"""
        WITH {_PARTS}
        SELECT page_id, array_to_string(['| <!DOCTYPE html>', '| <html>', '|   lang="' || lang || '"', '|   <head>', '|     <meta>', '|       charset="utf-8"', '|     <title>', '|       "' || {_P.format("title")} || '"',
            '|     <style>', '|       "p{{margin:0}}"', '|     <script>', '|       "' || script || '"', '|   <body>', '|     <nav>', '|       <ul>']
            || list_transform(range(1, len(names) + 1), lambda i: '|         <li>' || chr(10) || '|           <a>' || chr(10) || '|             href="' || {_P.format("hrefs[i]")} || '"' || chr(10) || '|             "' || {_P.format("names[i]")} || '"')
            || list_transform(range(1, len(ads) + 1), lambda i: '|     <!-- ' || notes[i] || ' -->' || chr(10) || '|     <div>' || chr(10) || '|       class="ad"' || chr(10) || '|       "' || {_P.format("ads[i]")} || '"')
            || ['|     <article>', '|       <h1>', '|         "' || {_P.format("h1")} || '"', tree_p, '|     <footer>']
            || list_transform(range(0, o), lambda k: '| ' || repeat('  ', CAST(k AS INTEGER) + 3) || '<b>') || ['| ' || repeat('  ', o + 3) || '"' || {_P.format("footer")} || '"'], chr(10)) AS output FROM whole""",
    "srcset_clean": "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') OR url NOT LIKE '%:%' THEN url || ' 1x, /x.png 2x' END AS srcset FROM pages",
    "decoded_bytes": r"""
        WITH p AS (SELECT page_id, html FROM pages WHERE NOT regexp_matches(html, '[^\x00-\x{FF}]'))
        SELECT page_id, 'mark' AS how, 'utf-16be' AS encoding, md5(html) AS digest FROM p
        UNION ALL SELECT page_id, 'declared', 'windows-1252', md5(html) FROM p
        UNION ALL SELECT page_id, 'meta', 'windows-1252', md5(replace(html, 'charset="utf-8"', 'charset="iso-8859-1"')) FROM p""",
    "decoded_pages": "SELECT page_id, 'utf-8' AS encoding, md5(html) AS digest FROM pages",
}

QUERIES.update(golden.QUERIES)
ORACLES.update(golden.ORACLES)
ORACLES["reparsed_html"] = ORACLES["sanitized_html"]
