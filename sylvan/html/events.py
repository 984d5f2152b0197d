"""The event stream: tags, text, comments and doctypes of a string in one pass, without a tree and without cleaning."""

from __future__ import annotations

from collections.abc import Iterator

from . import tables as T
from .entities import unescape
from .parser import _COMMENT_END, _TAG, Parser, lower, parse_doctype

RAW = frozenset("script style iframe noembed noframes noscript xmp".split())


def stream(html: str | None) -> Iterator[tuple]:
    """("start", name, attrs), ("end", name), ("text", data), ("comment", data), ("doctype", name, public_id, system_id).

    Adjacent text is one event, except that a ``<`` that begins no markup starts a new one. Bodies of raw text elements run to
    their end tag. Processing instructions come as comments that begin with ``?``. An unfinished tag ends the stream.
    """
    reader = Parser(html or "")
    html, n, pos = reader.html, reader.n, 0
    text: list[str] = []
    foreign: list[str] = []

    def flush() -> Iterator[tuple]:
        if text:
            yield "text", "".join(text)
            text.clear()

    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos:
            text.append(unescape(html[pos:lt]))
        if lt >= n:
            break
        c = html[lt + 1 : lt + 2]
        if c.isascii() and c.isalpha():
            m = _TAG.match(html, lt + 1)
            got = reader._attributes(m.end())
            if got is None:
                break
            yield from flush()
            name = lower(m[0]).replace("\0", "�")
            attrs, closing, pos = got
            yield "start", name, attrs
            if name in ("svg", "math") or foreign:
                if not closing:
                    foreign.append(name)
            elif name == "plaintext":
                if pos < n:
                    yield "text", html[pos:]
                pos = n
            elif name in RAW or name in T.RCDATA:
                end = reader._script_end(pos) if name == "script" else reader._end_tag(name, pos)
                body = html[pos:end]
                body = unescape(body) if name in T.RCDATA else body
                if body:
                    yield "text", body
                pos = end
        elif c == "/":
            m = _TAG.match(html, lt + 2)
            if m:
                got = reader._attributes(m.end())
                if got is None:
                    break
                yield from flush()
                name, pos = lower(m[0]).replace("\0", "�"), got[2]
                if name in foreign:
                    del foreign[len(foreign) - 1 - foreign[::-1].index(name) :]
                yield "end", name
            elif lt + 2 >= n:
                text.append("</")
                break
            elif html[lt + 2] == ">":
                pos = lt + 3
            else:
                end = html.find(">", lt + 2)
                yield from flush()
                yield "comment", html[lt + 2 : end if end >= 0 else n]
                pos = end + 1 or n
        elif html.startswith("<!--", lt):
            yield from flush()
            if html.startswith((">", "->"), lt + 4):
                pos = html.index(">", lt) + 1
                yield "comment", ""
            else:
                m = _COMMENT_END.search(html, lt + 4)
                yield "comment", html[lt + 4 : m.start() if m else n]
                pos = m.end() if m else n
        elif c == "!" and foreign and html.startswith("[CDATA[", lt + 2):
            end = html.find("]]>", lt + 9)
            text.append(html[lt + 9 : end if end >= 0 else n])
            pos = end + 3 if end >= 0 else n
        elif c == "!" and html[lt + 2 : lt + 9].lower() == "doctype":
            yield from flush()
            end = html.find(">", lt)
            d = parse_doctype(html[lt + 9 : end if end >= 0 else n])
            yield "doctype", d.name, d.public_id, d.system_id
            pos = end + 1 or n
        elif c in ("!", "?") and c:
            yield from flush()
            end = html.find(">", lt)
            yield "comment", html[lt + (2 if c == "!" else 1) : end if end >= 0 else n]
            pos = end + 1 or n
        else:
            yield from flush()
            text.append("<")
            pos = lt + 1
    yield from flush()
