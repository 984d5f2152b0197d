"""The line format in which tree tests are written."""

from __future__ import annotations

from .dom import Node


def to_test_format(root: Node) -> str:
    """One line a node: ``| ``, two spaces for each level, then the node; attributes sorted, one level deeper."""
    out: list[str] = []
    pending: list[tuple[Node, int]] = [(c, 0) for c in reversed(root.children)] if root.name in ("#document", "#document-fragment") else [(root, 0)]
    while pending:
        node, depth = pending.pop()
        pad = "| " + "  " * depth
        if node.name == "#text":
            out.append(f'{pad}"{node.data}"')
        elif node.name == "#comment":
            out.append(f"{pad}<!-- {node.data} -->")
        elif node.name == "#pi":
            out.append(f"{pad}<?{node.data}?>")
        elif node.name == "!doctype":
            d = node.data
            ids = f' "{d.public_id or ""}" "{d.system_id or ""}"' if d.public_id is not None or d.system_id is not None else ""
            out.append(f"{pad}<!DOCTYPE {d.name or ''}{ids}>")
        elif node.name == "#document-fragment":
            out.append(f"{pad}content")
        else:
            out.append(f"{pad}<{node.ns + ' ' if node.ns != 'html' else ''}{node.name}>")
            out += [f'{pad}  {k}="{v or ""}"' for k, v in sorted(node.attrs.items())]
        pending += [(c, depth + 1) for c in reversed(node.children)]
        if node.content is not None:
            pending.append((node.content, depth + 1))
    return "\n".join(out)
