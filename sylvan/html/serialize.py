"""HTML output: compact, or indented where that adds no visible space."""

from __future__ import annotations

import re
from enum import Enum

from . import tables as T
from .dom import Node
from .pretty import Printer
from .text import escape_attr_value, escape_js_string, escape_text, escape_url_value, neutralize_end_tags

_TAG = re.compile(r"[A-Za-z][^\t\n\f\r />]*\Z")
_ATTR = re.compile(r"[^\t\n\f\r />=]+\Z")
_NEEDS_QUOTE = re.compile("[ \t\n\f\r\"'=>]")
# Boolean attributes by element.
BOOLEAN = {
    "*": "autofocus headingreset inert itemscope",
    "audio": "autoplay controls loop muted",
    "button": "disabled formnovalidate",
    "details": "open",
    "dialog": "open",
    "fieldset": "disabled",
    "form": "novalidate",
    "iframe": "allowfullscreen",
    "img": "controls ismap",
    "input": "alpha checked disabled formnovalidate multiple readonly required",
    "link": "disabled",
    "ol": "reversed",
    "optgroup": "disabled",
    "option": "disabled selected",
    "script": "async defer nomodule",
    "select": "disabled multiple required",
    "template": "shadowrootclonable shadowrootcustomelementregistry shadowrootdelegatesfocus shadowrootserializable",
    "textarea": "disabled readonly required",
    "track": "default",
    "video": "autoplay controls loop muted playsinline",
}
BOOLEAN_SETS = {k: frozenset(v.split()) for k, v in BOOLEAN.items()}
# Elements laid out as blocks.
LAYOUT = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr html iframe li listing main marquee menu nav noframes noscript ol p plaintext pre search section summary"
    " table tbody td tfoot th thead tr ul".split()
)


class HTMLContext(Enum):
    HTML = "html"
    JS_STRING = "js_string"
    HTML_ATTR_VALUE = "html_attr_value"
    URL = "url"


def start_tag(name: str, attrs: dict | None, *, ns: str | None = "html", quote_values: bool = True, minimize_boolean: bool = True, quote_char: str | None = None, trailing_solidus: bool = False) -> str:
    if not _TAG.match(name):
        raise ValueError(f"not a tag name that can be written: {name!r}")
    out = [name]
    own = BOOLEAN_SETS.get(name.lower(), frozenset()) | BOOLEAN_SETS["*"] if ns in (None, "html") else frozenset()
    for key, value in (attrs or {}).items():
        if not _ATTR.match(key):
            raise ValueError(f"not an attribute name that can be written: {key!r}")
        if minimize_boolean and (not value or (key.lower() in own and value.isascii() and value.lower() == key.lower())):
            out.append(key)
        elif not value:
            out.append(f'{key}=""')
        elif not quote_values and not _NEEDS_QUOTE.search(value):
            out.append(f"{key}={value.replace('&', '&amp;').replace('<', '&lt;')}")
        else:
            q = quote_char or ("'" if '"' in value and "'" not in value else '"')
            out.append(f"{key}={q}{escape_attr_value(value, q)}{q}")
    return f"<{' '.join(out)}{' />' if trailing_solidus and name in T.VOID else '>'}"


def leaf(node: Node) -> str:
    """A text, comment, processing instruction or doctype."""
    data = node.data
    if node.name == "#text":
        parent = node.parent
        if parent is not None and parent.ns == "html" and parent.name.lower() in T.RAW_OUTPUT:
            name = parent.name.lower()
            return data or "" if name == "plaintext" else neutralize_end_tags(data or "", name)
        return escape_text(data)
    if node.name == "#comment":
        data = data or ""
        while "--" in data:
            data = data.replace("--", "- -")
        if data.startswith((">", "->")):
            data = " " + data
        return f"<!--{data}{' ' if data.endswith('-') else ''}-->"
    if node.name == "#pi":
        return f"<?{(data or '').replace('>', ' ')}>"
    name = data.name if data is not None and data.name and _TAG.match(data.name) else ""
    out = f"<!DOCTYPE {name}" if name else "<!DOCTYPE"
    if data is not None and data.public_id is not None:
        out += f' PUBLIC "{escape_attr_value(data.public_id)}"'
        if data.system_id is not None:
            out += f' "{escape_attr_value(data.system_id)}"'
    elif data is not None and data.system_id is not None:
        out += f' SYSTEM "{escape_attr_value(data.system_id)}"'
    return out + ">"


def compact(root: Node, **options) -> str:
    out: list[str] = []
    pending: list[Node | str] = [root]
    while pending:
        node = pending.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.ns is None and not node.name.startswith("#document"):
            out.append(leaf(node))
        else:
            if node.ns is not None:
                out.append(start_tag(node.name, node.attrs, ns=node.ns, **options))
                if node.ns == "html" and node.name in T.VOID:
                    continue
                pending.append(f"</{node.name}>")
            pending += reversed(node.children)
            if node.content is not None:
                pending.append(node.content)
    return "".join(out)


def pretty(root: Node, indent: int = 0, indent_size: int = 2, **options) -> str:
    """One node a line where that adds no visible space."""

    def text(data: str, parent: Node | None) -> str:
        if parent is not None and parent.ns == "html" and (name := parent.name.lower()) in T.RAW_OUTPUT:
            return data if name == "plaintext" else neutralize_end_tags(data, name)
        return escape_text(data)

    return Printer(root, LAYOUT, indent_size, lambda n: start_tag(n.name, n.attrs, ns=n.ns, **options), leaf, text).print(root, indent)


def to_html(root: Node, pretty_print: bool = False, *, context: HTMLContext = HTMLContext.HTML, quote: str = '"', indent: int = 0, indent_size: int = 2, **options) -> str:
    if context is HTMLContext.URL:
        from .text import to_text

        return escape_url_value(to_text(root, "", True))
    out = pretty(root, indent, indent_size, **options) if pretty_print else compact(root, **options)
    if context is HTMLContext.JS_STRING:
        return escape_js_string(out, quote)
    if context is HTMLContext.HTML_ATTR_VALUE:
        return escape_attr_value(out, quote)
    return out
