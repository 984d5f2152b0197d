"""Transforms as DataFrame operations on the node table, where a transform's effect doesn't depend on the walk.

Attributes change by expressions. What goes is found by running maxima over a page in preorder: a node goes if the farthest end of
the dropped subtrees that began so far lies behind it. All drops share one exchange and sort, and so does the renumbering of what
is left, many pages at a time in Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_invisible
from ..html import transforms as X
from ..html.select import parse_selector
from .selector import SelectorPlan

_STRUCTURAL = (X.Drop, X.Empty, X.DropComments, X.DropDoctype)
_ATTRIBUTES = (X.SetAttrs, X.DropAttrs, X.AllowlistAttrs, X.MergeAttrs, X.StripInvisible)
_PLACED = frozenset("first-child last-child only-child nth-child first-of-type last-of-type only-of-type nth-of-type empty contains".split())


def _own(selector: str) -> bool:
    """Whether a selector looks at a node's own name and attributes only."""
    return all(len(c) == 1 and not any(s.kind == "pseudo" and (s.name in _PLACED or s.name in ("not", "comment", "root")) for s in c[0][1]) for c in parse_selector(selector))


def _simple(spec: Any) -> bool:
    return spec.enabled and spec.callback is None and spec.report is None and (not hasattr(spec, "selector") or _own(spec.selector))


def split(transforms: Sequence[Any]) -> tuple[list[Any], list[Any]]:
    """(the leading transforms that are relational, the others)."""
    for i, s in enumerate(transforms):
        if not (isinstance(s, _STRUCTURAL + _ATTRIBUTES) and _simple(s) and not getattr(s, "escape", False)):
            return list(transforms[:i]), list(transforms[i:])
    return list(transforms), []


def relational(nodes: DataFrame, transforms: Sequence[Any], page_id: str = "page_id") -> DataFrame:
    """The node table after transforms of the relational kind. Nodes are renumbered once, if any went."""
    columns, going = nodes.columns, []
    for i, s in enumerate(transforms):
        if isinstance(s, _ATTRIBUTES):
            nodes = _attributes(nodes, s, page_id)
        elif isinstance(s, X.DropComments):
            nodes = nodes.withColumn(f"__go{i}", F.col("kind").isin("comment", "pi"))
            going.append(f"__go{i}")
        elif isinstance(s, X.DropDoctype):
            nodes = nodes.withColumn(f"__go{i}", F.col("kind") == "doctype")
            going.append(f"__go{i}")
        else:
            # a node's own attributes as they are at this point of the sequence decide
            nodes = nodes.withColumn(f"__top{i}", F.when(SelectorPlan(nodes, page_id).own(parse_selector(s.selector)), F.col("last")))
            going.append(f"__top{i}")
    if not going:
        return nodes
    rows = Window.partitionBy(page_id).orderBy("pre")
    gone = F.lit(False)
    for name in going:
        if name.startswith("__go"):
            gone = gone | F.col(name)
            continue
        empty = isinstance(transforms[int(name[5:])], X.Empty)
        reach = F.max(name).over(rows.rowsBetween(Window.unboundedPreceding, -1 if empty else 0))
        nodes = nodes.withColumn(name, F.coalesce(reach >= F.col("pre"), F.lit(False)))
        gone = gone | F.col(name)
    return renumber(nodes.where(~gone).select(*columns), page_id)


def _attributes(nodes: DataFrame, s: Any, page_id: str) -> DataFrame:
    attrs = F.col("attrs")
    if isinstance(s, X.StripInvisible):
        clean = F.transform(attrs, lambda a: F.struct(a["name"].alias("name"), strip_invisible(a["value"]).alias("value")))
        return nodes.withColumns({"attrs": clean, "data": F.when(F.col("kind") == "text", strip_invisible(F.col("data"))).otherwise(F.col("data"))})
    if isinstance(s, X.MergeAttrs):
        from .selector import attr

        have = F.filter(F.split(F.lower(F.coalesce(attr(s.attr), F.lit(""))), r"[ \t\n\f\r]+"), lambda t: t != "")
        all_ = F.array_join(F.array_distinct(F.concat(have, F.array(*[F.lit(t) for t in sorted({t.lower() for t in s.tokens})]))), " ")
        return nodes.withColumn("attrs", F.when(F.lower("name") == s.tag, _set(attrs, {s.attr: all_})).otherwise(attrs)) if s.tokens else nodes
    hit = SelectorPlan(nodes, page_id)
    test = None
    for c in parse_selector(s.selector):
        one = hit._condition(c[0][1])
        test = one if test is None else test | one
    if isinstance(s, X.SetAttrs):
        new = _set(attrs, {k: F.lit(v).cast("string") for k, v in s.attributes.items()})
    elif isinstance(s, X.DropAttrs):
        pattern = "|".join(X.glob(p) for p in s.patterns) or r"(?!)"
        new = F.filter(attrs, lambda a: ~F.lower(a["name"]).rlike(f"^(?:{pattern})$"))
    else:
        every = sorted(s.allowed_attributes.get("*", ()))
        table = {t: sorted({*v, *every}) for t, v in s.allowed_attributes.items() if t != "*"}
        keep: Column = F.array(*[F.lit(x) for x in every]).cast("array<string>")
        for t, v in table.items():
            keep = F.when(F.lower("name") == t, F.array(*[F.lit(x) for x in v]).cast("array<string>")).otherwise(keep)
        new = F.filter(attrs, lambda a: F.array_contains(keep, F.lower(a["name"])))
    return nodes.withColumn("attrs", F.when(test & (F.col("kind") == "element"), new).otherwise(attrs))


def _set(attrs: Column, values: dict[str, Column]) -> Column:
    """Attributes with some set: those that are there keep their places, the others go last."""
    for name, value in values.items():
        attrs = _set_one(attrs, name, value)
    return attrs


def _set_one(attrs: Column, name: str, value: Column) -> Column:
    there = F.exists(attrs, lambda a: a["name"] == name)
    changed = F.transform(attrs, lambda a: F.struct(a["name"].alias("name"), F.when(a["name"] == name, value).otherwise(a["value"]).alias("value")))
    return F.when(there, changed).otherwise(F.concat(attrs, F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))))


def renumber(nodes: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Fresh pre, last and sibling positions for a table from which whole subtrees have gone.

    Rows come page by page in preorder, as the window that numbers them needs them so, and many pages are renumbered at a time.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    numbered = nodes.withColumn("__row", F.row_number().over(Window.partitionBy(page_id).orderBy("pre")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last page so far, which may go on
        for batch in batches:
            heads = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy() == 1)
            last = heads[-1] if len(heads) else 0
            if last or (held and len(heads)):
                yield from _renumbered(pa.Table.from_batches([*held, batch.slice(0, last)])).to_batches()
                held = []
            held.append(batch.slice(last))
        if held:
            yield from _renumbered(pa.Table.from_batches(held)).to_batches()

    return numbered.mapInArrow(run, fields)


def _ranks(*groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place from 1, size) of each row in its group, rows being in order."""
    n = len(groups[0])
    order = np.lexsort((np.arange(n), *groups))
    head = np.ones(n, bool)
    for g in groups:
        head[1:] &= g[order][1:] == g[order][:-1]
    head[1:] = ~head[1:]
    first = np.flatnonzero(head)
    sizes = np.diff(np.append(first, n))
    place, size = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order], size[order] = np.arange(n) - np.repeat(first, sizes) + 1, np.repeat(sizes, sizes)
    return place, size


def _renumbered(table: pa.Table) -> pa.Table:
    """Rows of whole pages, page by page in preorder, with fresh numbers; the last column, which is the place of each row in its page from 1, goes."""
    table = table.combine_chunks()
    row = table.column(table.num_columns - 1).to_numpy()
    table = table.remove_column(table.num_columns - 1)
    head = row == 1
    base = (np.arange(len(row)) - row + 1).astype(np.int64)  # where a row's page begins
    page = np.cumsum(head, dtype=np.int64) << 32
    pre, last = page + table.column("pre").to_numpy(), page + table.column("last").to_numpy()
    n, top = len(pre), table.column("parent_pre").is_null().to_numpy(zero_copy_only=False)
    parent = np.searchsorted(pre, page + table.column("parent_pre").fill_null(0).to_numpy())
    names, kinds = pc.utf8_lower(table.column("name")), table.column("kind")
    codes = pc.dictionary_encode(names).combine_chunks().indices.to_numpy() if n else np.empty(0, np.int64)
    solid = ~pc.starts_with(names, "#").to_numpy(zero_copy_only=False)
    placed = np.flatnonzero(solid & ~top)
    columns = {c: np.zeros(n, np.int32) for c in ("elem_idx", "elem_cnt", "type_idx", "type_cnt", "prev_elem_pre")}
    columns["elem_idx"][placed], columns["elem_cnt"][placed] = _ranks(parent[placed])
    columns["type_idx"][placed], columns["type_cnt"][placed] = _ranks(codes[placed], parent[placed])
    by_parent = placed[np.lexsort((placed, parent[placed]))]
    columns["prev_elem_pre"][by_parent[1:]] = by_parent[:-1] - base[by_parent[:-1]]
    hidden = {c: np.ones(n, bool) for c in columns}
    for c in columns:
        hidden[c][placed] = c == "prev_elem_pre" and columns["elem_idx"][placed] == 1
    written = pc.fill_null(pc.and_(pc.equal(kinds, "text"), pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(table.column("data"))), 0)), False).to_numpy(zero_copy_only=False)
    full = np.zeros(n, bool)
    full[parent[(solid | written) & ~top]] = True
    is_element = pc.equal(kinds, "element").to_numpy(zero_copy_only=False)
    new = {"pre": (row - 1).astype(np.int32), "last": (np.searchsorted(pre, last, side="right") - 1 - base).astype(np.int32), "is_empty": is_element & ~full}
    for name, values in new.items():
        table = table.set_column(table.column_names.index(name), table.schema.field(name), pa.array(values))
    table = table.set_column(table.column_names.index("parent_pre"), table.schema.field("parent_pre"), pa.array((parent - base).astype(np.int32), mask=top))
    for name, values in columns.items():
        table = table.set_column(table.column_names.index(name), table.schema.field(name), pa.array(values, mask=hidden[name]))
    return table
