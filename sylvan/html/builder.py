"""Building trees by hand: ``element("a[href=/x]", "text")``."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from .dom import Doctype, Node, text_node

_SHORT = re.compile(r"\[([^\]=]+)(?:=([^\]]*))?\]")


def element(name: str, attrs=None, *children, namespace: str = "html") -> Node:
    """An element. The name may carry attributes in brackets; ``[x]`` without a value gives None. Children are nodes, strings,
    or iterables of them; None and False are left out; other values are refused."""
    if attrs is not None and not isinstance(attrs, Mapping):
        attrs, children = None, (attrs, *children)
    tag, at = re.match(r"[^\[]+", name), {}
    if not tag:
        raise ValueError("a tag name is missing")
    rest = name[tag.end() :]
    if _SHORT.sub("", rest):
        raise ValueError(f"not a tag with attributes: {name!r}")
    for k, v in _SHORT.findall(rest):
        at[k.strip()] = v.strip("\"'") if f"[{k}=" in rest else None
    node = Node(tag[0].strip(), namespace, at | {k: None if v is None or v is True else str(v) for k, v in (attrs or {}).items()})
    if node.name == "template" and namespace == "html":
        node.content = Node("#document-fragment")
        node.content.parent = node
    target = node.content if node.content is not None else node
    for child in _flat(children):
        target.append_child(child)
    return node


def _flat(children) -> Iterable[Node]:
    for c in children:
        if c is None or c is False:
            continue
        if isinstance(c, Node):
            yield c
        elif isinstance(c, str):
            yield text_node(c)
        elif isinstance(c, (bool, int, float, bytes, bytearray, Mapping)):
            raise TypeError(f"not a child: {c!r}")
        else:
            yield from _flat(c)


def text(data: str) -> Node:
    return text_node(data)


def comment(data: str) -> Node:
    return Node("#comment", data=data)


def doctype(name: str = "html", public_id: str | None = None, system_id: str | None = None) -> Node:
    return Node("!doctype", data=Doctype(name, public_id, system_id))


def document(*children) -> Node:
    root = Node("#document")
    for child in _flat(children):
        root.append_child(child)
    return root
