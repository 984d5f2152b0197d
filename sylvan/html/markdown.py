"""Markdown output. Tables and images stay HTML; what Markdown can't say is rendered as its content."""

from __future__ import annotations

import re
from urllib.parse import quote

from .dom import Node
from .serialize import compact
from .text import to_text

DEEPEST_QUOTE = 64
# Elements set off by blank lines.
BLOCKS = frozenset("p div section article header footer main nav aside blockquote pre ul ol li hr h1 h2 h3 h4 h5 h6 table".split())
_SYNTAX = re.compile(r"[&<\\`*_\[\]]")
_LINE_START = re.compile(r"(#(?=[ \t]|$)|>|-(?=[ \t])|\+(?=[ \t])|-(?=[ \t]*-[ \t]*-[-\t ]*$)|=(?=[= \t]*$)|~(?=~~)|`(?=``))|(\d+)([.)])(?=[ \t])")


def escape(text: str) -> str:
    return _SYNTAX.sub(lambda m: {"&": "&amp;", "<": "&lt;"}.get(m[0], "\\" + m[0]), text)


def fence(text: str, least: int) -> str:
    return "`" * max(least, 1 + max(map(len, re.findall("`+", text)), default=0))


def code_span(text: str) -> str:
    if not text:
        return ""
    text = " ".join(text.splitlines()) if "\n" in text or "\r" in text else text
    ticks = fence(text, 1)
    space = " " if text[0] == "`" or text[-1:] == "`" else ""
    return f"{ticks}{space}{text}{space}{ticks}"


def destination(url: str) -> str:
    url = url.strip()
    if re.search(r"[ \t\n\r()<>]", url):
        return f"<{quote(url, safe=':/?#[]@!$&' + chr(39) + '*+,;=%-._~()')}>"
    return url


class Writer:
    """Text that grows: spaces collapse, and become one only if something follows on the line."""

    def __init__(self, quotes: int = 0) -> None:
        self.out: list[str] = []
        self.quotes, self.breaks, self.space, self.lead = quotes, 0, False, False

    def raw(self, text: str) -> None:
        if not text:
            return
        if self.space and self.out and not self.breaks:
            self.out.append(" ")
        self.space = False
        self.out.append(text)
        ends = len(text) - len(text.rstrip("\n"))
        self.breaks = self.breaks + ends if ends == len(text) else ends

    def text(self, text: str) -> None:
        at_start = not self.out or self.breaks > 0
        words = text.split()
        if not words:
            if text and not self.out:
                self.lead = True
            self.space |= bool(text)
            return
        if text[0].isspace():
            self.lead |= not self.out
            self.space = True
        body = " ".join(words)
        if at_start and (m := _LINE_START.match(body)):
            body = "\\" + body if m[1] else f"{m[2]}\\{body[len(m[2]):]}"
        self.raw(body)
        self.space = text[-1].isspace()

    def newline(self, n: int = 1) -> None:
        self.space = False
        self.out.append("\n" * n)
        self.breaks += n

    def blank(self, n: int = 2) -> None:
        """At least n line ends after what is there, if anything is."""
        if self.out and self.breaks < n:
            self.newline(n - self.breaks)
        self.space = False

    def finish(self) -> str:
        return "".join(self.out).strip(" \t\n")


def to_markdown(root: Node, html_passthrough: bool = False) -> str:
    top = Writer()
    # Each step is a node with its surroundings, or a function to call when what was put above it is done.
    work: list = [(root, top, False, 0, False)]
    while work:
        step = work.pop()
        if callable(step):
            step()
            continue
        node, w, keep, depth, linked = step
        name = node.name
        inside = lambda writer=w, keep=keep, depth=depth, linked=linked, node=node: [(c, writer, keep, depth, linked) for c in reversed(node.children)]
        if name == "#text":
            (w.raw if keep else lambda t: w.text(escape(t)))(node.data or "")
        elif name == "br":
            w.text(" ") if linked else w.newline()
        elif name in ("#comment", "!doctype", "#pi"):
            pass
        elif name.startswith("#"):
            work += inside()
        elif (tag := name.lower()) in ("head", "title"):
            pass
        elif tag == "img":
            w.raw(compact(node))
        elif tag in ("table", "script", "style", "textarea"):
            if not linked:
                w.blank()
            if tag == "table" or html_passthrough:
                w.raw(compact(node))
            if not linked:
                w.blank()
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if not linked:
                w.blank()
                w.raw("#" * int(tag[1]) + " ")
                work.append(w.blank)
            work += inside(keep=False)
        elif tag == "hr":
            if not linked:
                w.blank()
                w.raw("---")
                w.blank()
        elif tag == "pre":
            code = to_text(node, "", False)
            if linked:
                w.raw(code_span(code))
            else:
                ticks = fence(code, 3)
                w.blank()
                body = code.rstrip("\n") + "\n" if code else ""
                w.raw(f"{ticks}\n{body}{ticks}")
                w.blank()
        elif tag == "code" and not keep:
            w.raw(code_span(to_text(node, "", False)))
        elif tag == "blockquote" and not linked and w.quotes < DEEPEST_QUOTE:
            inner = Writer(w.quotes + 1)

            def quoted(w=w, inner=inner) -> None:
                w.blank()
                if body := inner.finish():
                    w.raw("\n".join("> " + line for line in body.split("\n")))
                w.blank()

            work.append(quoted)
            work += inside(inner, False)
        elif tag == "blockquote":
            work += inside(keep=False)
        elif tag in ("ul", "ol"):
            items = [c for c in node.children if c.name.lower() == "li"]
            if linked:
                for item in reversed(items):
                    work += [(c, w, False, depth + 1, True) for c in reversed(item.children)]
                    work.append(lambda w=w: w.raw(" "))
            else:
                w.blank()
                work.append(w.blank)
                for number in range(len(items), 0, -1):
                    work += [(c, w, False, depth + 1, False) for c in reversed(items[number - 1].children)]
                    mark = "  " * depth + (f"{number}. " if tag == "ol" else "- ")
                    work.append(lambda w=w, mark=mark, first=number == 1: ((None if first else w.newline()), w.raw(mark)))
        elif tag in ("em", "i", "strong", "b"):
            inner, mark = Writer(w.quotes), "*" if tag in ("em", "i") else "**"

            def marked(w=w, inner=inner, mark=mark) -> None:
                body = inner.finish()
                if inner.lead:
                    w.text(" ")
                if "\n" in body:
                    w.blank()
                    w.raw(body)
                    return
                if body:
                    w.raw(mark + body + mark)
                if inner.space:
                    w.text(" ")

            work.append(marked)
            work += inside(inner, False)
        elif tag == "a":
            inner, href = Writer(w.quotes), node.attrs.get("href") or ""

            def link(w=w, inner=inner, href=href) -> None:
                if inner.lead:
                    w.text(" ")
                w.raw(f"[{inner.finish()}]" + (f"({destination(href)})" if href else ""))
                if inner.space:
                    w.text(" ")

            work.append(link)
            work += inside(inner, False, linked=True)
        else:
            if tag in BLOCKS:
                if not linked:
                    w.blank()
                work.append((lambda w=w: w.text(" ")) if linked else w.blank)
            if node.content is not None:
                work.append((node.content, w, keep, depth, linked))
            work += inside(keep=keep and tag != "p")
    return top.finish()
