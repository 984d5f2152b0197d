"""Indented HTML output.

Each element is first laid out: as a single line, or as lines of pieces, a piece being text or a child. A child that has a line of its
own is indented below its parent; one that shares a line is written as if it stood at the left edge. White space between two
inline elements that touch is never made. The walk is a trampoline, so depth is bounded by memory only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator
from dataclasses import dataclass

from . import tables as T
from .dom import Node

#: Levels below this one share its indentation.
MOST_INDENT = 64
_FORMATTING = re.compile(r" *[\t\n\f\r][\t\n\f\r ]*")
_HTML_SPACE = re.compile(r"[\t\n\f\r ]+")

#: A piece of a line, and a request for a child's output: (node, depth, verbatim).
Piece = "str | Node"
Wish = tuple[Node, int, bool]


@dataclass
class Line:
    """``own``: the line is a child at its own depth, which brings its indentation. ``tight``: spaces at both ends go."""

    pieces: list
    own: bool = False
    tight: bool = False


def _blank(node: Node) -> bool:
    return node.name == "#text" and not (node.data or "").strip()


def _worded(node: Node) -> bool:
    return node.name == "#text" and bool((node.data or "").strip())


def _layout_space(data: str) -> bool:
    """Blank text that was meant to lay out the source: with line ends or tabs, or of three spaces and more."""
    return len(data) > 2 or any(c in data for c in "\t\n\f\r")


def collapsed(data: str) -> str:
    """One space for each run of white space, none at the ends. A vertical tab is no HTML space, which only matters where there is one."""
    return _HTML_SPACE.sub(" ", data).strip(" ") if "\v" in data else " ".join(data.split())


def smoothed(data: str) -> str:
    """Runs of white space with a line end or tab become one space, and none at an end that had one; runs of spaces stay."""
    out = _FORMATTING.sub(" ", data)
    start = 1 if data[:1] in ("\t", "\n", "\f", "\r") and out[:1] == " " else 0
    end = len(out) - (1 if data[-1:] in ("\t", "\n", "\f", "\r") and out[-1:] == " " else 0)
    return out[start : max(start, end)]


class Blocks:
    """Which elements are blocks, or hold one, of either kind; each subtree is looked at once."""

    def __init__(self, root: Node, layout: frozenset[str]) -> None:
        self.kinds = (T.SPECIAL, layout)
        self.holds: dict[int, tuple[bool, bool]] = {}
        pending = [(root, False)]
        while pending:
            node, done = pending.pop()
            if not done:
                pending.append((node, True))
                pending += [(c, False) for c in node.children if c.children]
            else:
                self.holds[id(node)] = tuple(any(self._is(c, i) for c in node.children) for i in (0, 1))

    def _is(self, node: Node, kind: int) -> bool:
        return node.name in self.kinds[kind] or self.holds.get(id(node), (False, False))[kind]

    def special(self, node: Node) -> bool:
        return node.name not in ("#text", "#comment", "!doctype") and self._is(node, 0)

    def layout(self, node: Node) -> bool:
        return node.name not in ("#text", "#comment", "!doctype") and self._is(node, 1)


class Printer:
    def __init__(self, root: Node, layout: frozenset[str], size: int, tag: Callable[[Node], str], leaf: Callable[[Node], str], text: Callable[[str, Node | None], str]) -> None:
        self.blocks, self.size, self.tag, self.leaf, self.text = Blocks(root, layout), size, tag, leaf, text

    def pad(self, depth: int) -> str:
        return " " * (self.size * min(depth, MOST_INDENT))

    def print(self, root: Node, depth: int) -> str:
        """Drives the generators: each asks for a child's output and is sent it."""
        stack: list[Generator[Wish, str, str]] = [self._visit(root, depth, False)]
        answer: str | None = None
        while stack:
            try:
                wish = stack[-1].send(answer)
            except StopIteration as done:
                stack.pop()
                answer = done.value
            else:
                stack.append(self._visit(*wish))
                answer = None
        return answer or ""

    def _visit(self, node: Node, depth: int, verbatim: bool) -> Generator[Wish, str, str]:
        pad = "" if verbatim else self.pad(depth)
        if node.name == "#text":
            if verbatim:
                return self.text(node.data or "", node.parent)
            data = (node.data or "").strip()
            return pad + self.text(data, node.parent) if data else ""
        if node.name in ("#document", "#document-fragment"):
            parts = []
            for child in node.children:
                parts.append((yield child, depth, verbatim and node.name != "#document"))
            return ("" if verbatim else "\n").join(p for p in parts if p or node.name == "#document")
        if node.ns is None:
            return pad + self.leaf(node)
        begin = pad + self.tag(node)
        if node.name in T.VOID:
            return begin
        end = f"</{node.name}>"
        children = node.content.children if node.content is not None else node.children
        if not children:
            return begin + end
        if verbatim or node.name in T.PRESERVE_SPACE:
            parts = []
            for child in children:
                parts.append((yield child, depth + 1, True))
            return begin + "".join(parts) + end
        if all(c.name == "#text" for c in children):
            return begin + self.text(collapsed("".join(c.data or "" for c in children)), node) + end
        lines = self._lines(node, children)
        if lines is None:
            parts = []
            for piece in self._compact(children):
                parts.append(piece if isinstance(piece, str) else (yield piece, 0, False))
            return begin + "".join(parts) + end
        out = [begin]
        for line in lines:
            parts = []
            for piece in line.pieces:
                parts.append(piece if isinstance(piece, str) else (yield piece, depth + 1 if line.own else 0, False))
            written = "".join(parts)
            if written := written.strip(" ") if line.tight else written:
                out.append(written if line.own else self.pad(depth + 1) + written)
        out.append((self.pad(depth)) + end)
        return "\n".join(out)

    # Layouts. The first that fits an element is taken.

    def _lines(self, node: Node, children: list[Node]) -> list[Line] | None:
        """Lines of an element's content; None if it goes on the element's own line."""
        indent = self._may_indent(children)
        if node.name in T.SPECIAL:
            if not any(map(_worded, children)):
                return self._one_each(children)
            if not any(c.name == "#comment" for c in children):
                found = self._runs(children)
                if found is None and not indent:
                    found = self._blocks_apart(children) or self._elements_apart(children)
                if found is not None:
                    return found
        return self._one_each(children) if indent else None

    @staticmethod
    def _one_each(children: list[Node]) -> list[Line]:
        return [Line([c], own=True) for c in children if not _blank(c)]

    def _may_indent(self, children: list[Node]) -> bool:
        """Whether a line for each child adds no visible space: no words, no comments, and no two inline elements in a row."""
        if any(c.name == "#comment" or _worded(c) for c in children):
            return False
        blocky = [self.blocks.special(c) for c in children if c.name != "#text"]
        return all(blocky) if len(blocky) == 1 else not any(not a and not b for a, b in zip(blocky, blocky[1:], strict=False))

    def _runs(self, children: list[Node]) -> list[Line] | None:
        """Where layout space separates inner children: a line for each run between such spaces, unless a block shares a run."""
        if not any(_blank(c) and _layout_space(c.data or "") for c in children[1:-1]):
            return None
        runs: list[list[Node]] = [[]]
        for child in children:
            if _blank(child) and _layout_space(child.data or ""):
                runs.append([])
            else:
                runs[-1].append(child)
        lines = []
        for run in filter(None, runs):
            if len(run) > 1 and any(self.blocks.special(c) for c in run):
                return None
            alone = len(run) == 1 and run[0].name != "#text"
            lines.append(Line(run, own=True) if alone else Line([self._words(c) if c.name == "#text" else c for c in run]))
        return lines

    def _words(self, node: Node) -> str:
        data = node.data or ""
        return data if not data.strip() else self.text(smoothed(data), None)

    def _blocks_apart(self, children: list[Node]) -> list[Line] | None:
        """Words among layout blocks: blocks on lines of their own, what is between them joined."""
        if not (any(map(_worded, children)) and any(self.blocks.layout(c) for c in children)):
            return None
        lines: list[Line] = []
        held: list = []

        def flush() -> None:
            nonlocal held
            if held:
                lines.append(Line(held, tight=True))
            held = []

        for i, child in enumerate(children):
            if _blank(child):
                if 0 < i < len(children) - 1:
                    data = child.data or ""
                    if len(data) > 2 or any(c in data for c in "\t\n\r"):
                        flush()
                    else:
                        held.append(data)
            elif child.name == "#text":
                held.append(self._words(child))
            elif self.blocks.layout(child):
                flush()
                lines.append(Line([child], own=True))
            else:
                held.append(child)
        flush()
        return lines

    def _elements_apart(self, children: list[Node]) -> list[Line] | None:
        """Elements that white space separates, with words at most behind the last one: a line for each."""
        places = [i for i, c in enumerate(children) if c.name != "#text"]
        gaps = [children[a + 1 : b] for a, b in zip(places, places[1:], strict=False)]
        if not places or any(map(_worded, [*children[: places[0]], *(c for gap in gaps for c in gap)])) or not any(gaps):
            return None
        return [Line([text]) if c.name == "#text" else Line([c], own=True) for c in children if c.name != "#text" or (text := self.text(collapsed(c.data or ""), None))]

    def _compact(self, children: list[Node]) -> list:
        """Pieces of the element's own line."""
        out: list = []
        for i, child in enumerate(children):
            if child.name != "#text":
                out.append(child)
                continue
            data = child.data or ""
            if _blank(child) and i in (0, len(children) - 1):
                continue
            space = _blank(child) and (len(data) > 2 or any(c in data for c in "\t\n\r"))
            out.append(" " if space else self.text(smoothed(data), None))
        return out
