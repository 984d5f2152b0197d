"""The node tree: mutable, with parent links."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Doctype:
    name: str | None = None
    public_id: str | None = None
    system_id: str | None = None
    force_quirks: bool = False


class Node:
    """Any node. ``name`` is a tag, or #document, #document-fragment, #text, #comment, #pi, !doctype.

    ``content`` is the fragment of an HTML template; ``span`` and ``end_span`` are the places of the tags in the source.
    """

    __slots__ = ("name", "ns", "attrs", "children", "parent", "data", "content", "span", "end_span", "self_closing", "start_index")

    def __init__(self, name: str, ns: str | None = None, attrs: dict | None = None, data=None) -> None:
        self.name, self.ns, self.attrs, self.data = name, ns, attrs if attrs is not None else {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.content: Node | None = None
        self.span = self.end_span = None
        self.self_closing = False
        self.start_index = 0

    def __repr__(self) -> str:
        return f"<{self.name}>" if self.is_element else f"{self.name} {self.data!r}"

    @property
    def is_element(self) -> bool:
        return self.ns is not None

    @property
    def kind(self) -> str:
        return _KINDS.get(self.name, "element") if self.ns is None else "element"

    @property
    def text(self) -> str:
        return self.data or "" if self.name == "#text" else ""

    # Mutation. A node that is put somewhere leaves its old parent; fragments give their children.

    def append_child(self, node: Node) -> None:
        self.insert_before(node, None)

    def insert_before(self, node: Node, reference: Node | None) -> Node:
        if reference is not None and reference.parent is not self:
            raise ValueError("the reference node is not a child of this node")
        up: Node | None = self
        while up is not None:
            if up is node:
                raise ValueError("a node can't be put inside itself")
            up = up.parent
        if node is reference:
            return node
        nodes = list(node.children) if node.name == "#document-fragment" else [node]
        for n in nodes:
            n.detach()
        at = len(self.children) if reference is None else _index(self.children, reference)
        self.children[at:at] = nodes
        for n in nodes:
            n.parent = self
        return node

    def replace_child(self, node: Node, old: Node) -> Node:
        self.insert_before(node, old)
        if node is not old:
            old.detach()
        return old

    def remove_child(self, node: Node) -> None:
        if node.parent is not self:
            raise ValueError("not a child of this node")
        node.detach()

    def detach(self) -> None:
        if self.parent is not None:
            if self.parent.content is self:
                self.parent.content = None
            else:
                del self.parent.children[_index(self.parent.children, self)]
            self.parent = None

    def has_child_nodes(self) -> bool:
        return bool(self.children)

    def clone_node(self, deep: bool = False) -> Node:
        root, pending = None, [(self, None, False)]
        while pending:
            old, above, as_content = pending.pop()
            new = Node(old.name, old.ns, dict(old.attrs), old.data)
            new.span, new.end_span, new.self_closing = old.span, old.end_span, old.self_closing
            if above is None:
                root = new
            else:
                new.parent = above
                if as_content:
                    above.content = new
                else:
                    above.children.append(new)
            if deep:
                pending += [(c, new, False) for c in reversed(old.children)]
                if old.content is not None:
                    pending.append((old.content, new, True))
            elif old.content is not None:
                new.content = Node("#document-fragment")
                new.content.parent = new
        return root

    # Reading.

    def descendants(self) -> Iterator[Node]:
        """All nodes below, in document order; a template's content comes before its own children."""
        pending = [self]
        while pending:
            node = pending.pop()
            if node is not self:
                yield node
            pending += reversed(node.children)
            if node.content is not None:
                pending.append(node.content)

    def query(self, selector: str) -> list[Node]:
        from .select import query

        return query(self, selector)

    def query_one(self, selector: str) -> Node | None:
        found = self.query(selector)
        return found[0] if found else None

    def matches(self, selector: str) -> bool:
        from .select import matches

        return matches(self, selector)

    def to_text(self, separator: str = " ", strip: bool = True, separator_blocks_only: bool = False) -> str:
        from .text import to_text

        return to_text(self, separator, strip, separator_blocks_only)

    def to_html(self, pretty: bool = False, **options) -> str:
        from .serialize import to_html

        return to_html(self, pretty, **options)

    def to_markdown(self, html_passthrough: bool = False) -> str:
        from .markdown import to_markdown

        return to_markdown(self, html_passthrough)


_KINDS = {"#document": "document", "#document-fragment": "fragment", "#text": "text", "#comment": "comment", "#pi": "pi", "!doctype": "doctype"}


def _index(nodes: list[Node], node: Node) -> int:
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i] is node:
            return i
    raise ValueError("not a child of this node")


def text_node(data: str) -> Node:
    return Node("#text", data=data)


def from_rows(rows: list[dict]) -> Node:
    """The tree of node rows (see sylvan.schema), in any order."""
    made: dict[int, Node] = {}
    root = None
    for r in sorted(rows, key=lambda r: r["pre"]):
        node = Node(r["name"], r["namespace"] if r["kind"] == "element" else None, {a["name"]: a["value"] for a in r["attrs"] or []}, r["data"])
        if r["kind"] == "doctype":
            d = r["doctype"] or {}
            node.data = Doctype(d.get("name"), d.get("public_id"), d.get("system_id"), bool(d.get("force_quirks")))
        node.self_closing = bool(r.get("self_closing"))
        if r.get("src_start") is not None:
            node.span = (r["src_start"], r["src_end"])
        if r.get("end_start") is not None:
            node.end_span = (r["end_start"], r["end_end"])
        made[r["pre"]] = node
        if r["parent_pre"] is None:
            root = node
        else:
            node.parent = made[r["parent_pre"]]
            if r.get("is_template_content"):
                node.parent.content = node
            else:
                node.parent.children.append(node)
    return root
