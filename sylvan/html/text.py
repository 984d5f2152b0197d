"""Text of a tree, and escaping for the places where text is put."""

from __future__ import annotations

import re
from urllib.parse import quote

from .dom import Node

# Elements that begin and end a block of text.
TEXT_BLOCKS = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main"
    " nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: Characters that don't show, as a regular expression class.
INVISIBLE = (
    "\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufe00-\ufe0f\ufeff\ue000-\uf8ff"
    "\U000e0100-\U000e01ef\U000f0000-\U000ffffd\U00100000-\U0010fffd"
)
_INVISIBLE = re.compile(f"[{INVISIBLE}]")


def strip_invisible(text: str) -> str:
    return text if text.isascii() else _INVISIBLE.sub("", text)


def _texts(root: Node):
    """Text nodes, children before a template's content, and the edges of blocks (as None)."""
    pending: list[Node | None] = [root]
    while pending:
        node = pending.pop()
        if node is None or node.name == "br":
            yield None
            continue
        if node.name == "#text":
            if node.data:
                yield node.data
            continue
        if node.name in TEXT_BLOCKS:
            yield None
            pending.append(None)
        if node.content is not None:
            pending.append(node.content)
        pending += reversed(node.children)


def to_text(root: Node, separator: str = " ", strip: bool = True, separator_blocks_only: bool = False) -> str:
    blocks: list[list[str]] = [[]]
    for data in _texts(root):
        if data is None:
            if blocks[-1]:
                blocks.append([])
        elif not strip:
            blocks[-1].append(data)
        elif part := data.strip():
            blocks[-1].append(part)
    if separator_blocks_only:
        return separator.join((" " if strip else "").join(b) for b in blocks if b)
    return separator.join(x for b in blocks for x in b)


def escape_text(text: str | None) -> str:
    return (text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attr_value(text: str | None, quote_char: str = '"') -> str:
    return escape_text(text).replace(quote_char, "&quot;" if quote_char == '"' else "&#39;")


# Escapes of a JavaScript string, besides the quote.
JS_ESCAPES = {
    "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f",
    "<": "\\u003c", ">": "\\u003e", "\u2028": "\\u2028", "\u2029": "\\u2029",
}


def escape_js_string(text: str | None, quote_char: str = '"') -> str:
    if quote_char not in "\"'" or len(quote_char) != 1:
        raise ValueError("the quote is ' or \"")
    return (text or "").translate(str.maketrans(JS_ESCAPES | {quote_char: "\\" + quote_char}))


def escape_url_value(text: str | None) -> str:
    return quote(text or "", safe="/:@?&=#+-._~")


def neutralize_end_tags(text: str, tag: str) -> str:
    """``</tag`` before a space, ``/``, ``>`` or the end, in the raw text of that tag: its ``<`` is written as a reference."""
    return re.sub(rf"<(?=/{re.escape(tag)}(?:[\t\n\f\r />]|\Z))", "&lt;", text, flags=re.I | re.A)
