"""CSS selectors: parsing, and matching on a tree.

Matching goes from right to left. A descendant or general-sibling step takes the nearest match and goes on from there, without
trying farther ones. ``*`` matches every node whose name doesn't begin with ``#``, the doctype included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from .dom import Node


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class SelectorLimits:
    length: int = 8192
    list_items: int = 256
    compound_parts: int = 512
    complex_parts: int = 512
    depth: int = 100
    match_steps: int = 100_000_000
    match_bytes: int = 100_000_000


@dataclass(frozen=True)
class Simple:
    kind: str  # tag, all, id, class, attr, pseudo
    name: str
    op: str | None = None
    value: str | None = None
    inner: tuple | None = None  # of :not(...): a tuple of complex selectors


#: A complex selector is ((combinator, compound), ...), from left to right; the first combinator is None.
Compound = tuple[Simple, ...]
Complex = tuple[tuple[str | None, Compound], ...]

_NAME = re.compile(r"[A-Za-z0-9_\-\u0080-\U0010ffff]+")
_SPACE = re.compile(r"[ \t\n\r\f]*")
_COMBINATOR = re.compile(r"[ \t\n\r\f]*([>+~])[ \t\n\r\f]*|[ \t\n\r\f]+")
_NTH = re.compile(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)")
PSEUDO = frozenset("first-child last-child only-child nth-child first-of-type last-of-type only-of-type nth-of-type not empty root contains comment".split())


class _Reader:
    def __init__(self, text: str, limits: SelectorLimits) -> None:
        self.text, self.pos, self.limits = text, 0, limits

    def fail(self, what: str) -> SelectorError:
        return SelectorError(f"{what} at {self.pos} of {self.text!r}")

    def peek(self) -> str:
        return self.text[self.pos : self.pos + 1]

    def skip(self) -> None:
        self.pos = _SPACE.match(self.text, self.pos).end()

    def name(self) -> str:
        m = _NAME.match(self.text, self.pos)
        if not m:
            raise self.fail("a name is missing")
        self.pos = m.end()
        return m[0]

    def string(self) -> str:
        q, out = self.peek(), []
        self.pos += 1
        while self.pos < len(self.text):
            c = self.text[self.pos]
            if c == q:
                self.pos += 1
                return "".join(out)
            if c == "\\" and self.pos + 1 < len(self.text):
                self.pos += 1
                c = self.text[self.pos]
            out.append(c)
            self.pos += 1
        raise self.fail("a string has no end")

    def selectors(self, depth: int = 0) -> tuple[Complex, ...]:
        if depth > self.limits.depth:
            raise self.fail("too deep")
        out: list[Complex] = []
        while True:
            self.skip()
            if self.peek() in ("", ")") and out:
                break
            out.append(self.complex(depth))
            if len(out) > self.limits.list_items:
                raise self.fail("too many selectors")
            self.skip()
            if self.peek() != ",":
                break
            self.pos += 1
        return tuple(dict.fromkeys(out))

    def complex(self, depth: int) -> Complex:
        parts: list[tuple[str | None, Compound]] = [(None, self.compound(depth))]
        while True:
            m = _COMBINATOR.match(self.text, self.pos)
            if not m:
                return tuple(parts)
            after = self.text[m.end() : m.end() + 1]
            if m[1] is None and after in ("", ",", ")"):
                return tuple(parts)
            self.pos = m.end()
            parts.append((m[1] or " ", self.compound(depth)))
            if len(parts) > self.limits.complex_parts:
                raise self.fail("too many steps")

    def compound(self, depth: int) -> Compound:
        out: list[Simple] = []
        while c := self.peek():
            if c == "*" and not out:
                self.pos += 1
                out.append(Simple("all", "*"))
            elif c == "#":
                self.pos += 1
                out.append(Simple("id", self.name()))
            elif c == ".":
                self.pos += 1
                out.append(Simple("class", self.name()))
            elif c == "[":
                out.append(self.attribute())
            elif c == ":":
                out.append(self.pseudo(depth))
            elif not out and _NAME.match(c):
                out.append(Simple("tag", self.name().lower()))
            else:
                break
            if len(out) > self.limits.compound_parts:
                raise self.fail("too many parts")
        if not out:
            raise self.fail("a selector is missing")
        return tuple(dict.fromkeys(out))

    def attribute(self) -> Simple:
        self.pos += 1
        self.skip()
        name = self.name().lower()
        self.skip()
        op = value = None
        if m := re.compile(r"[~|^$*]?=").match(self.text, self.pos):
            op, self.pos = m[0], m.end()
            self.skip()
            value = self.string() if self.peek() in ("'", '"') and self.peek() else self.name()
            self.skip()
        if self.peek() != "]":
            raise self.fail("] is missing")
        self.pos += 1
        return Simple("attr", name, op, value)

    def pseudo(self, depth: int) -> Simple:
        self.pos += 1
        name = self.name().lower()
        if name not in PSEUDO:
            raise SelectorError(f"Unsupported pseudo-class: :{name}")
        arg = inner = None
        if self.peek() == "(":
            self.pos += 1
            self.skip()
            if name == "not":
                inner = () if self.peek() == ")" else self.selectors(depth + 1)
            elif self.peek() in ("'", '"') and self.peek():
                arg = self.string()
            else:
                end = self.text.find(")", self.pos)
                arg, self.pos = self.text[self.pos : max(end, self.pos)].strip(), max(end, self.pos)
            self.skip()
            if self.peek() != ")":
                raise self.fail(") is missing")
            self.pos += 1
        if name == "contains" and arg is None:
            raise SelectorError(":contains() needs a string")
        return Simple("pseudo", name, None, arg, inner if name != "not" or inner is not None else ())


@lru_cache(512)
def parse_selector(text: str, limits: SelectorLimits = SelectorLimits()) -> tuple[Complex, ...]:
    if len(text) > limits.length:
        raise SelectorError("the selector is too long")
    reader = _Reader(text.strip(), limits)
    if not reader.text:
        raise SelectorError("the selector is empty")
    out = reader.selectors()
    reader.skip()
    if reader.pos < len(reader.text):
        raise reader.fail("unexpected text")
    return out


@lru_cache(512)
def parse_nth(text: str | None) -> tuple[int, int] | None:
    """(a, b) of an+b, or None if malformed, which matches nothing."""
    text = (text or "").replace(" ", "").lower()
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    m = _NTH.fullmatch(text)
    if not m:
        return None
    if m[3] is not None:
        return 0, int(m[3])
    a = {"": 1, "+": 1, "-": -1}.get(m[1])
    return (int(m[1]) if a is None else a), int(m[2] or 0)


def nth_ok(index: int, nth: tuple[int, int] | None) -> bool:
    if nth is None:
        return False
    a, b = nth
    return index == b if a == 0 else (index - b) % a == 0 and (index - b) // a >= 0


def solid(node: Node) -> bool:
    """Whether a node counts among its siblings: elements, and the doctype."""
    return not node.name.startswith("#")


class Matcher:
    """Matches nodes of one tree, whose structure may be asked for again after changes by a new matcher.

    A matcher has a budget of steps (simple selectors tried on nodes) and of characters of text that :contains() builds, over all
    its matches; beyond it, it fails.
    """

    def __init__(self, limits: SelectorLimits = SelectorLimits()) -> None:
        self.places: dict[int, tuple] = {}
        self.texts: dict[int, str] = {}
        self.steps, self.bytes = limits.match_steps, limits.match_bytes

    def place(self, node: Node) -> tuple[int, int, int, int, Node | None]:
        """(index, count, index by type, count by type, previous sibling) among solid siblings."""
        parent = node.parent
        if id(parent) not in self.places:
            table: dict[int, list] = {}
            total, types, previous = 0, {}, None
            for c in parent.children:
                if solid(c):
                    total += 1
                    kind = c.name.lower()
                    types[kind] = types.get(kind, 0) + 1
                    table[id(c)] = [total, kind, types[kind], previous]
                    previous = c
            self.places[id(parent)] = (table, total, types, parent)
        table, total, types, _ = self.places[id(parent)]
        if id(node) not in table:
            return 0, total, 0, 0, None
        index, kind, by_type, previous = table[id(node)]
        return index, total, by_type, types[kind], previous

    def matches(self, node: Node, selectors: tuple[Complex, ...]) -> bool:
        return any(self.complex(node, c) for c in selectors)

    def complex(self, node: Node, parts: Complex) -> bool:
        if not self.compound(node, parts[-1][1]):
            return False
        at: Node | None = node
        for i in range(len(parts) - 1, 0, -1):
            how, wanted = parts[i][0], parts[i - 1][1]
            if how == ">":
                at = at.parent
                if at is None or not self.compound(at, wanted):
                    return False
            elif how == " ":
                at = at.parent
                while at is not None and not self.compound(at, wanted):
                    at = at.parent
                if at is None:
                    return False
            elif at.parent is None:
                return False
            else:
                at = self.place(at)[4] if solid(at) else self._before(at)
                while how == "~" and at is not None and not self.compound(at, wanted):
                    at = self.place(at)[4]
                if at is None or (how == "+" and not self.compound(at, wanted)):
                    return False
        return True

    @staticmethod
    def _before(node: Node) -> Node | None:
        last = None
        for c in node.parent.children:
            if c is node:
                return last
            if solid(c):
                last = c
        return None

    def compound(self, node: Node, parts: Compound) -> bool:
        self.steps -= len(parts)
        if self.steps < 0:
            raise SelectorError("Selector match budget exceeded")
        return all(self.simple(node, p) for p in parts)

    def simple(self, node: Node, s: Simple) -> bool:
        kind = s.kind
        if kind == "pseudo" and s.name == "comment":
            return node.name == "#comment"
        if not solid(node):
            return False
        if kind == "tag":
            return node.name == s.name or node.name.lower() == s.name
        if kind == "all":
            return True
        if kind == "id":
            return (node.attrs.get("id") or "") == s.name
        if kind == "class":
            return s.name in (node.attrs.get("class") or "").split()
        if kind == "attr":
            for k, v in node.attrs.items():
                if k.lower() == s.name:
                    return attr_ok(v or "", s.op, s.value)
            return False
        return self.pseudo(node, s)

    def pseudo(self, node: Node, s: Simple) -> bool:
        name = s.name
        if name == "not":
            return not s.inner or not self.matches(node, s.inner)
        if name == "empty":
            return not any(solid(c) or (c.name == "#text" and (c.data or "").strip()) for c in node.children)
        if name == "root":
            return node.parent is not None and node.parent.name in ("#document", "#document-fragment")
        if name == "contains":
            if not s.value:
                return True
            if id(node) not in self.texts:
                self.texts[id(node)] = text = node.to_text()
                self.bytes -= len(text)
                if self.bytes < 0:
                    raise SelectorError("Selector byte budget exceeded")
            return s.value in self.texts[id(node)]
        if node.parent is None:
            return False
        index, total, by_type, of_type, _ = self.place(node)
        if name == "first-child":
            return index == 1
        if name == "last-child":
            return index == total
        if name == "only-child":
            return total == 1
        if name == "nth-child":
            return nth_ok(index, parse_nth(s.value))
        if name == "first-of-type":
            return by_type == 1
        if name == "last-of-type":
            return by_type == of_type
        if name == "only-of-type":
            return of_type == 1
        return nth_ok(by_type, parse_nth(s.value))


def attr_ok(value: str, op: str | None, wanted: str | None) -> bool:
    if op is None:
        return True
    if op == "=":
        return value == wanted
    if op == "|=":
        return value == wanted or value.startswith(wanted + "-")
    if not wanted:
        return False
    if op == "~=":
        return wanted in value.split()
    if op == "^=":
        return value.startswith(wanted)
    if op == "$=":
        return value.endswith(wanted)
    return wanted in value


def query(root: Node, selector: str, limits: SelectorLimits = SelectorLimits()) -> list[Node]:
    """Descendants that match, in document order."""
    parsed, matcher = parse_selector(selector, limits), Matcher(limits)
    return [n for n in root.descendants() if (n.ns is not None or n.name in ("!doctype", "#comment")) and matcher.matches(n, parsed)]


def matches(node: Node, selector: str) -> bool:
    return Matcher().matches(node, parse_selector(selector))
