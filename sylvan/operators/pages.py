"""From pages to nodes, events and errors: stateless Arrow maps, without a shuffle, for batch and streaming tables alike."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..html.errors import parse_errors
from ..html.events import stream
from ..html.parser import FragmentContext, StrictModeError, parse
from ..html.policy import SanitizationPolicy
from ..html.rows import NodeColumns
from ..html.select import parse_selector
from ..html.transforms import apply_transforms, with_sanitize
from ..schema import ATTRS, ERRORS, EVENTS, NODES

#: Rows that a node batch holds at least before it is sent on.
BATCH_ROWS = 20_000


def _pages(pages: DataFrame, page_id: str, html: str) -> tuple[DataFrame, str]:
    rows = pages.select(F.col(f"`{page_id}`"), F.col(f"`{html}`").cast("string").alias("__html"))
    return rows, f"`{page_id}` {rows.schema[0].dataType.simpleString()}"


def _sources(batch: pa.RecordBatch) -> Iterator[tuple[Any, str | None]]:
    """(page id, source) of the pages of a batch, of which few are Python objects at a time."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def parse_html(pages: DataFrame, page_id: str = "page_id", html: str = "html", *, sanitize: bool = False, policy: SanitizationPolicy | None = None, transforms: Sequence[Any] = (), fragment: bool = False, context: FragmentContext | None = None, locations: bool = False, **options) -> DataFrame:
    """The node table of pages: one row for each node, numbered in preorder within its page (see sylvan.schema).

    Select pages before this operator: filters on its result don't reach the pages below it. Transforms, and with ``sanitize``
    the sanitizer, run on the tree before it becomes rows. ``locations`` fills the origin columns: where in the source a node begins,
    line ends counted as one character. A null page is an empty document.
    """
    rows, ident = _pages(pages, page_id, html)
    specs = with_sanitize(transforms) if sanitize else list(transforms)
    literal = policy is not None and policy.disallowed_tag_handling == "escape"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = NodeColumns(), 0
            for key, source in _sources(batch):
                root = parse(source, fragment=fragment, context=context, literal=literal, track=locations, **options)
                if specs:
                    apply_transforms(root, specs, policy=policy)
                n += out.add(key, root, locations)
                if n >= BATCH_ROWS:
                    yield out.batch(page_id, batch.schema.field(0).type)
                    out, n = NodeColumns(), 0
            if n:
                yield out.batch(page_id, batch.schema.field(0).type)

    return rows.mapInArrow(run, f"{ident}, {NODES}")


def html_events(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Tags, texts, comments and doctypes of pages in the order of the source, without a tree and without cleaning."""
    rows, ident = _pages(pages, page_id, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema, made = _EVENTS.insert(0, batch.schema.field(0)), []
            for key, source in _sources(batch):
                for seq, event in enumerate(stream(source)):
                    row = {page_id: key, "seq": seq, "event": event[0], "name": None, "attrs": None, "data": None, "public_id": None, "system_id": None}
                    if event[0] in ("start", "end"):
                        row["name"] = event[1]
                        if event[0] == "start":
                            row["attrs"] = [{"name": k, "value": v} for k, v in event[2].items()]
                    elif event[0] == "doctype":
                        row["name"], row["public_id"], row["system_id"] = event[1:]
                    else:
                        row["data"] = event[1]
                    made.append(row)
                if len(made) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)

    return rows.mapInArrow(run, f"{ident}, {EVENTS}")


_STRUCT = pa.struct([("name", pa.string()), ("value", pa.string())])
_EVENTS = pa.schema([("seq", pa.int32()), ("event", pa.string()), ("name", pa.string()), ("attrs", pa.list_(_STRUCT)), ("data", pa.string()), ("public_id", pa.string()), ("system_id", pa.string())])
_ERRORS = pa.schema([("seq", pa.int32()), ("code", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("category", pa.string()), ("message", pa.string())])


def html_errors(pages: DataFrame, page_id: str = "page_id", html: str = "html", *, most: int = 1000, fragment: bool = False, strict: bool = False) -> DataFrame:
    """Parse errors of pages, at most ``most`` each, by place. ``strict`` fails the job on the first one."""
    rows, ident = _pages(pages, page_id, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema, made = _ERRORS.insert(0, batch.schema.field(0)), []
            for key, source in _sources(batch):
                found = parse_errors(source, fragment, most)
                if found and strict:
                    raise StrictModeError(f"page {key}: {found[0].message} at line {found[0].line}, column {found[0].column}")
                made += [{page_id: key, "seq": i, **vars(e)} for i, e in enumerate(found)]
                if len(made) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)

    return rows.mapInArrow(run, f"{ident}, {ERRORS}")


def transform_errors(pages: DataFrame, transforms: Sequence[Any] = (), page_id: str = "page_id", html: str = "html", *, policy: SanitizationPolicy | None = None, sanitize: bool = True, fragment: bool = False, **options) -> DataFrame:
    """What transforms report with emit_error, and a policy with ``unsafe_handling="collect"`` finds unsafe, by place."""
    rows, ident = _pages(pages, page_id, html)
    specs = with_sanitize(transforms) if sanitize else list(transforms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema, made = _ERRORS.insert(0, batch.schema.field(0)), []
            for key, source in _sources(batch):
                found: list = []
                apply_transforms(parse(source, fragment=fragment, **options), specs, found, policy)
                made += [{page_id: key, "seq": i, **vars(e)} for i, e in enumerate(sorted(found, key=lambda e: (e.line, e.column)))]
                if len(made) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)

    return rows.mapInArrow(run, f"{ident}, {ERRORS}")


_FOUND = pa.schema([("selector", pa.string()), ("seq", pa.int32()), ("name", pa.string()), ("attrs", pa.list_(_STRUCT)), ("data", pa.string()), ("text", pa.string())])


def find_nodes(pages: DataFrame, selectors: Mapping[str, str], page_id: str = "page_id", html: str = "html", *, first: bool = False, separator: str = " ", strip: bool = True, transforms: Sequence[Any] = (), sanitize: bool = False, policy: SanitizationPolicy | None = None, **options) -> DataFrame:
    """``page_id, selector, seq, name, attrs, data, text`` of the nodes that named selectors find in each page, numbered from 1 in its order.

    For pages that aren't kept as a node table: each is parsed once for all selectors, and only matches leave the worker. ``first``
    keeps the first match of each selector; ``text`` is the text inside a node. A null page is an empty document. Selectors have
    the limits of ``sylvan.html.select``.
    """
    rows, ident = _pages(pages, page_id, html)
    specs = with_sanitize(transforms) if sanitize else list(transforms)
    wanted = dict(selectors)
    for selector in wanted.values():
        parse_selector(selector)  # errors are the caller's, before any task runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema, made = _FOUND.insert(0, batch.schema.field(0)), []
            for key, source in _sources(batch):
                root = parse(source, **options)
                if specs:
                    apply_transforms(root, specs, policy=policy)
                for name, selector in wanted.items():
                    for seq, node in enumerate(root.query(selector)[: 1 if first else None], 1):
                        attrs = [{"name": k, "value": v} for k, v in node.attrs.items()] if node.is_element else None
                        data = node.data if isinstance(node.data, str) else None
                        made.append({page_id: key, "selector": name, "seq": seq, "name": node.name, "attrs": attrs, "data": data, "text": node.to_text(separator, strip)})
                if len(made) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)

    return rows.mapInArrow(run, f"{ident}, selector string, seq int, name string, attrs {ATTRS}, data string, text string")


def run(pages: DataFrame, *, selector: str | None = None, format: str = "html", first: bool = False, sanitize: bool = True, cleanup: bool = False, policy: SanitizationPolicy | None = None, transforms: Sequence[Any] = (), separator: str = " ", separator_blocks_only: bool = False, strip: bool = True, page_id: str = "page_id", html: str = "html", **options) -> DataFrame:  # noqa: A002
    """``page_id, matches, output``: each page, or the elements that a selector finds in it, as html, text or markdown.

    Several matches are joined by a line end (markdown: a blank line). ``cleanup`` also unwraps dead links and drops dead images and
    empty elements. A page without a match has 0 matches and null output.
    """
    from ..html.transforms import cleanup_preset

    specs = [*transforms, *(cleanup_preset(sanitize) if cleanup else [])]
    specs = with_sanitize(specs) if sanitize else specs
    rows, ident = _pages(pages, page_id, html)
    write = {"html": lambda n: n.to_html(), "text": lambda n: n.to_text(separator, strip, separator_blocks_only), "markdown": lambda n: n.to_markdown()}[format]
    glue = "\n\n" if format == "markdown" else "\n"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, outputs = [], []
            for _, source in _sources(batch):
                root = apply_transforms(parse(source, **options), specs, policy=policy)
                found = root.query(selector) if selector else [root]
                found = found[:1] if first else found
                counts.append(len(found))
                outputs.append(glue.join(map(write, found)) if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(outputs, pa.string())], [page_id, "matches", "output"])

    return rows.mapInArrow(each, f"{ident}, matches int, output string")
