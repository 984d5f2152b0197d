"""Parse errors: a linear scan of the source for the seven kinds that are reported."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import islice

from . import tables as T
from .parser import _COMMENT_END, ParseError, Parser, lower

# Error codes and their messages.
MESSAGES = {
    "eof-in-comment": "Unexpected end of file in comment",
    "eof-in-tag": "Unexpected end of file in tag",
    "expected-doctype-but-got-chars": "Expected DOCTYPE but got text content",
    "expected-doctype-but-got-start-tag": "Expected DOCTYPE but got <{}> tag",
    "unexpected-end-tag": "Unexpected </{}> end tag",
    "unexpected-null-character": "Unexpected NULL character (U+0000)",
    "unknown-doctype": "Unknown DOCTYPE (expected <!DOCTYPE html>)",
}
_MARKUP = re.compile(r"<(?:(!--)|(!)|(/?)([A-Za-z][^\t\n\f />]*))")


def parse_errors(html: str | None, fragment: bool = False, most: int = 1000) -> list[ParseError]:
    """Errors in the order of their places, at most ``most``."""
    reader = Parser(html or "")
    html, n, found = reader.html, reader.n, []

    def add(code: str, at: int, tag: str = "", category: str = "tokenizer") -> None:
        found.append((at, code, tag, category))

    for m in islice(re.finditer("\0", html), most):
        add("unexpected-null-character", m.start())
    body = html.lstrip(T.SPACE)
    if not fragment and body and body[:9].lower() != "<!doctype":
        at = n - len(body)
        m = _MARKUP.match(html, at)
        if m and m[4] and not m[3]:
            got = reader._attributes(m.end())
            add("expected-doctype-but-got-start-tag", got[2] - 1 if got else n - 1, lower(m[4]), "treebuilder")
        else:
            add("expected-doctype-but-got-chars", at, category="treebuilder")
    elif not fragment and body and (d := re.match(r"(?i)<!doctype[\t\n\f\r ]*([^\t\n\f\r >]*)", body)) and lower(d[1]) != "html":
        add("unknown-doctype", n - len(body), category="treebuilder")
    open_: list[str] = []
    pos = 0
    by_place = len(found)
    while len(found) - by_place < most and (m := _MARKUP.search(html, pos)):  # the scan finds errors by place
        if m[1]:
            close = _COMMENT_END.search(html, m.end())
            if not close:
                add("eof-in-comment", n - 1)
                break
            pos = close.end()
        elif m[2]:
            end = html.find(">", m.end())
            if end < 0:
                add("eof-in-tag", n - 1)
                break
            pos = end + 1
        else:
            got, name = reader._attributes(m.end()), lower(m[4])
            if got is None:
                add("eof-in-tag", n - 1)
                break
            pos = got[2]
            if m[3]:
                if name == "br" or name not in open_:
                    add("unexpected-end-tag", m.start(), name, "treebuilder")
                else:
                    del open_[len(open_) - 1 - open_[::-1].index(name) :]
            else:
                if name in T.CLOSES_P | T.HEADINGS and "p" in open_:
                    last = len(open_) - 1 - open_[::-1].index("p")
                    if not any(x in T.SCOPE or x == "button" for x in open_[last:]):
                        del open_[last:]
                if name not in T.VOID and not got[1]:
                    open_.append(name)
    found = sorted(found, key=lambda x: x[0])[:most]
    lines = [i for i, c in enumerate(html) if c == "\n"] if found else []
    out = []
    for at, code, tag, category in found:
        line = bisect_left(lines, at)  # line ends before the place
        out.append(ParseError(code, line + 1, at - (lines[line - 1] if line else -1), category, MESSAGES[code].format(tag)))
    return out
