"""Trees as node rows, in Arrow."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa

from ..schema import NODE_COLUMNS
from .dom import Node
from .select import solid

_ATTR = pa.struct([("name", pa.string()), ("value", pa.string())])
_DOCTYPE = pa.struct([("name", pa.string()), ("public_id", pa.string()), ("system_id", pa.string()), ("force_quirks", pa.bool_())])
_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
ARROW = [_TYPES[t] if t in _TYPES else pa.list_(_ATTR) if n == "attrs" else _DOCTYPE for n, t in NODE_COLUMNS]


class NodeColumns:
    """Columns of node rows, page after page."""

    def __init__(self) -> None:
        self.pages: list = []
        self.columns: list[list] = [[] for _ in NODE_COLUMNS]

    def add(self, page_id, root: Node, locate: bool = False) -> int:
        """Add a tree in preorder (a template's content before its children); gives the number of rows. ``locate``: with places in the source."""
        rows: list[list] = []
        source = root.data if locate and isinstance(root.data, str) and root.ns is None else None
        lines = [0, *(i + 1 for i, c in enumerate(source) if c == "\n")] if source is not None else []
        pending: list[tuple[Node, int | None, int, tuple, bool]] = [(root, None, 0, (None,) * 4, False)]
        open_: list[int] = []
        previous: dict[int, int] = {}  # the last solid child of each parent so far
        while pending:
            node, parent, depth, place, content = pending.pop()
            pre = len(rows)
            while open_ and open_[-1] != parent:
                rows[open_.pop()][1] = pre - 1
            is_solid = place[0] is not None
            before = previous.get(parent) if is_solid else None
            if is_solid:
                previous[parent] = pre
            data, kind, doctype = node.data, node.kind, None
            if kind == "doctype":
                doctype = {"name": data.name, "public_id": data.public_id, "system_id": data.system_id, "force_quirks": data.force_quirks} if data else None
                data = None
            elif kind in ("document", "fragment"):
                data = None
            children = node.children
            rows.append([
                pre, pre, parent, depth, kind, node.name, node.ns, [{"name": k, "value": v} for k, v in node.attrs.items()] if kind == "element" else None, data, doctype,
                *place, before, kind == "element" and node.parent is not None and node.parent.name in ("#document", "#document-fragment"),
                kind == "element" and not any(solid(c) or (c.name == "#text" and (c.data or "").strip()) for c in children),
                *(node.span or (None, None)), *(node.end_span or (None, None)), *_origin(node, lines), content, node.end_span is not None, node.self_closing,
            ])
            open_.append(pre)
            if children:
                total, types = 0, {}
                kinds = []
                for c in children:
                    if solid(c):
                        total += 1
                        low = c.name.lower()
                        types[low] = types.get(low, 0) + 1
                        kinds.append((total, low, types[low]))
                    else:
                        kinds.append(None)
                pending += [(c, pre, depth + 1, (None,) * 4 if k is None else (k[0], total, k[2], types[k[1]]), False) for c, k in zip(reversed(children), reversed(kinds), strict=True)]
            if node.content is not None:
                pending.append((node.content, pre, depth + 1, (None,) * 4, True))
        for pre in open_:
            rows[pre][1] = len(rows) - 1
        for column, values in zip(self.columns, zip(*rows, strict=True), strict=True):
            column += values
        self.pages += [page_id] * len(rows)
        return len(rows)

    def batch(self, id_name: str, id_type: pa.DataType) -> pa.RecordBatch:
        arrays = [pa.array(self.pages, id_type), *(pa.array(c, t) for c, t in zip(self.columns, ARROW, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, [id_name, *(n for n, _ in NODE_COLUMNS)])


def _origin(node: Node, lines: list[int]) -> tuple[int | None, int | None, int | None]:
    """(offset from 0, line from 1, column from 1) of a node, given where lines begin."""
    if not lines or not node.span:
        return None, None, None
    at = node.span[0]
    line = bisect_right(lines, at)
    return at, line, at - lines[line - 1] + 1
