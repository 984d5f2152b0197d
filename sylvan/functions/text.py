"""Column functions on text, URLs and whole pages.

Those that built-in functions can say are expressions and stay in the JVM; the others run over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..html import encoding, linkify, markdown, serialize, text, urls
from ..html.entities import unescape
from ..html.parser import FragmentContext, parse
from ..html.policy import SanitizationPolicy
from ..html.transforms import apply_transforms, with_sanitize

#: Whitespace as Python's str.strip() and str.split() see it, as a Java character class.
UNICODE_SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def _replace(column: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def escape_text(column: Column) -> Column:
    return _replace(column, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def escape_attr_value(column: Column, quote: str = '"') -> Column:
    return _replace(escape_text(column), [(quote, "&quot;" if quote == '"' else "&#39;")])


def escape_js_string(column: Column, quote: str = '"') -> Column:
    return _replace(column, [*text.JS_ESCAPES.items(), (quote, "\\" + quote)])


def escape_html_text_in_js_string(column: Column, quote: str = '"') -> Column:
    return escape_js_string(escape_text(column), quote)


def strip_invisible(column: Column) -> Column:
    return F.regexp_replace(column, "[\\u061C\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2069\\uFE00-\\uFE0F\\uFEFF\\uE000-\\uF8FF\\x{E0100}-\\x{E01EF}\\x{F0000}-\\x{FFFFD}\\x{100000}-\\x{10FFFD}]", "")


def strip(column: Column) -> Column:
    """Without Unicode whitespace at both ends."""
    return F.regexp_replace(column, f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+$", "")


def _each(kind: str, function: Callable) -> Callable[[Column], Column]:
    """A function of one value as a column function over Arrow batches; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def html_unescape(column: Column, in_attribute: bool = False) -> Column:
    return _each("string", lambda v: unescape(v, in_attribute))(column)


def escape_url_value(column: Column) -> Column:
    return _each("string", text.escape_url_value)(column)


def clean_url(column: Column, rule: urls.UrlRule, policy: urls.UrlPolicy | None = None) -> Column:
    """The URL as the rule lets it through; null if it doesn't."""
    policy = policy or urls.UrlPolicy(default_handling="allow")
    return _each("string", lambda v: urls.apply_rule(v, rule, policy))(column)


def clean_url_value(column: Column, rule: urls.UrlRule, policy: urls.UrlPolicy | None = None) -> Column:
    return _each("string", lambda v: urls.clean_url_value(v, rule, policy))(column)


def clean_url_in_js_string(column: Column, rule: urls.UrlRule, policy: urls.UrlPolicy | None = None, quote: str = '"') -> Column:
    return _each("string", lambda v: urls.clean_url_in_js_string(v, rule, policy, quote))(column)


def clean_srcset(column: Column, policy: urls.UrlPolicy, tag: str = "img", attr: str = "srcset") -> Column:
    return _each("string", lambda v: urls.clean_sink(v, tag, attr, urls.SINK_OF[attr], policy))(column)


def clean_style(column: Column, allowed: frozenset[str], policy: urls.UrlPolicy | None = None, tag: str = "*") -> Column:
    return _each("string", lambda v: urls.clean_style(v, allowed, tag, policy))(column)


def neutralize_end_tags(column: Column, tag: str) -> Column:
    return F.regexp_replace(column, rf"(?i)<(?=/{tag}(?:[\t\n\f\r />]|\z))", "&lt;")


LINK = "array<struct<start:int,end:int,text:string,href:string,kind:string>>"


def find_links(column: Column, fuzzy_ip: bool = False, extra_tlds: tuple[str, ...] = ()) -> Column:
    """Links of a plain text, in order."""
    return _each(LINK, lambda v: [vars(x) for x in linkify.find_links(v, fuzzy_ip, extra_tlds)])(column)


def decode_html(content: Column, transport: Column) -> Column:
    """struct<html, encoding> of bytes."""

    def run(content: pd.Series, transport: pd.Series) -> pd.DataFrame:
        got = [(None, None) if c is None else encoding.decode_html(bytes(c), t) for c, t in zip(content, transport, strict=True)]
        return pd.DataFrame(got, columns=["html", "encoding"])

    run.__annotations__ = {"content": pd.Series, "transport": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "html string, encoding string")(content, transport)


def normalize_encoding_label(column: Column) -> Column:
    """The encoding a label stands for, or null."""
    table = F.create_map(*[F.lit(x) for label, name in sorted(encoding._BY_LABEL.items()) for x in (label, name)])
    return F.try_element_at(table, F.lower(strip(column)))


# Whole pages.


def page_function(make: Callable, kind: str = "string", fragment: bool = False, context: FragmentContext | None = None, **options) -> Callable[[Column], Column]:
    """A function of a page's tree as a column function of its HTML. A null page is the empty document."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([make(parse(v, fragment=fragment, context=context, **options)) for v in values], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def _cleaned(policy: SanitizationPolicy | None, transforms: list | None, sanitize: bool) -> Callable:
    specs = with_sanitize(transforms or []) if sanitize else list(transforms or [])
    return lambda root: apply_transforms(root, specs, policy=policy)


def html_to_text(column: Column, separator: str = " ", strip: bool = True, separator_blocks_only: bool = False, sanitize: bool = True, transforms: list | None = None, policy: SanitizationPolicy | None = None, **options) -> Column:
    clean = _cleaned(policy, transforms, sanitize)
    return page_function(lambda root: clean(root).to_text(separator, strip, separator_blocks_only), **options)(column)


def html_to_markdown(column: Column, html_passthrough: bool = False, sanitize: bool = True, transforms: list | None = None, policy: SanitizationPolicy | None = None, **options) -> Column:
    clean = _cleaned(policy, transforms, sanitize)
    return page_function(lambda root: markdown.to_markdown(clean(root), html_passthrough), **options)(column)


def html_to_html(column: Column, pretty: bool = False, sanitize: bool = True, transforms: list | None = None, policy: SanitizationPolicy | None = None, context: serialize.HTMLContext = serialize.HTMLContext.HTML, **options) -> Column:
    """The page parsed, sanitized (unless told otherwise), transformed and written again."""
    clean = _cleaned(policy, transforms, sanitize)
    literal = policy is not None and policy.disallowed_tag_handling == "escape"
    return page_function(lambda root: serialize.to_html(clean(root), pretty, context=context), literal=literal, **options)(column)


def select_text(column: Column, selector: str, separator: str = " ", strip: bool = True, first: bool = False, sanitize: bool = False, **options) -> Column:
    """Texts of the elements that a selector finds, as an array."""
    clean = _cleaned(None, None, sanitize)

    def make(root):
        found = clean(root).query(selector)
        return [n.to_text(separator, strip) for n in (found[:1] if first else found)]

    return page_function(make, "array<string>", **options)(column)


