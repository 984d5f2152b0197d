"""Operators on the node table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip as strip_column
from ..html.dom import from_rows
from ..html.rows import NodeColumns
from ..html.policy import SanitizationPolicy
from ..html.transforms import HardenRawtext, apply_transforms
from ..html.select import parse_selector
from ..plans.selector import SelectorPlan, attr, plan_selector
from ..plans.transforms import relational, split
from ..schema import NODES
from .pages import parse_html

__all__ = ["attr", "nodes_to_pages", "parse_nodes", "select", "select_one", "to_text", "transform_nodes"]


def select(nodes: DataFrame, selector: str, page_id: str = "page_id") -> DataFrame:
    """Rows of the nodes that a selector finds. Without combinators that is a filter; with them nodes are read for each step, so keep them in a table."""
    own = SelectorPlan(nodes, page_id).own(parse_selector(selector))
    if own is not None:
        return nodes.where(own)
    return nodes.join(plan_selector(nodes, selector, page_id), [page_id, "pre"], "left_semi")


def select_one(nodes: DataFrame, selector: str, page_id: str = "page_id") -> DataFrame:
    """The first match of each page."""
    found = select(nodes, selector, page_id)
    return found.groupBy(page_id).agg(F.min_by(F.struct(*[c for c in found.columns if c != page_id]), "pre").alias("n")).select(page_id, "n.*")


def to_text(nodes: DataFrame, targets: DataFrame, separator: str = " ", strip: bool = True, page_id: str = "page_id") -> DataFrame:
    """``page_id, pre, text`` of targets (page_id, pre, last): the texts inside each, in order; empty if there are none.

    Meant for targets that don't nest deeply: a text is met once for each target around it.
    """
    data = strip_column(F.col("data")) if strip else F.col("data")
    texts = nodes.where("kind = 'text'").select(F.col(page_id).alias("t_page"), F.col("pre").alias("t_pre"), data.alias("t")).where("t <> ''")
    inside = (F.col(page_id) == F.col("t_page")) & (F.col("t_pre") > F.col("pre")) & (F.col("t_pre") <= F.col("last"))
    met = targets.select(page_id, "pre", "last").join(texts, inside, "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("t_pre").isNotNull(), F.struct("t_pre", "t"))))
    return met.groupBy(page_id, "pre").agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias("text"))


def _by_page(nodes: DataFrame, page_id: str, function, schema: str) -> DataFrame:
    kind = nodes.schema[page_id].dataType.simpleString()
    return nodes.groupBy(page_id).applyInArrow(function, f"`{page_id}` {kind}, {schema}")


def transform_nodes(nodes: DataFrame, transforms: Sequence[Any], page_id: str = "page_id") -> DataFrame:
    """The node table after transforms, renumbered.

    The leading transforms that only look at a node's own columns, and at positions that none before them changes, are DataFrame
    operations; from the first other one on, pages are rebuilt and walked one by one.
    """
    first, rest = split(transforms)
    out = relational(nodes, first, page_id) if first else nodes
    if not rest:
        return out

    def walk(table: pa.Table) -> pa.Table:
        key = table.column(page_id)[0].as_py()
        made = NodeColumns()
        made.add(key, apply_transforms(from_rows(table.to_pylist()), rest))
        return pa.Table.from_batches([made.batch(page_id, table.schema.field(page_id).type)])

    return _by_page(out, page_id, walk, NODES)


def nodes_to_pages(nodes: DataFrame, format: str = "html", page_id: str = "page_id", **options) -> DataFrame:  # noqa: A002
    """``page_id, output``: pages written from their nodes as html, pretty, text, markdown or test (the tree test format)."""
    from ..html.testformat import to_test_format

    write = {"html": lambda n: n.to_html(**options), "pretty": lambda n: n.to_html(True, **options), "text": lambda n: n.to_text(**options), "markdown": lambda n: n.to_markdown(**options), "test": to_test_format}[format]

    def one(table: pa.Table) -> pa.Table:
        root = from_rows(table.to_pylist())
        return pa.table({page_id: table.column(page_id)[:1].combine_chunks(), "output": pa.array([write(root)], pa.string())})

    return _by_page(nodes, page_id, one, "output string")


def parse_nodes(nodes: DataFrame, page_id: str = "page_id", *, sanitize: bool = True, policy: SanitizationPolicy | None = None, **options) -> DataFrame:
    """The node table of pages that come as nodes, not as text: raw text is hardened, each tree written, parsed again and, by default, sanitized.

    A tree built by hand may hold what no parser makes; only what survives being written and parsed is judged by the sanitizer.
    """

    def one(table: pa.Table) -> pa.Table:
        root = apply_transforms(from_rows(table.to_pylist()), [HardenRawtext(policy=policy)])
        return pa.table({page_id: table.column(page_id)[:1].combine_chunks(), "html": pa.array([root.to_html()], pa.string())})

    return parse_html(_by_page(nodes, page_id, one, "html string"), page_id, "html", sanitize=sanitize, policy=policy, **options)
