"""Declarative tree transforms, run in one walk for each stage.

The walk visits a node and runs all transforms of the stage on it, in order, before it goes on; a node that a transform moves
or makes carries the number of the transform from which it is to be treated. PruneEmpty, EditDocument and HardenRawtext are
passes of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from . import tables as T
from .dom import Node, text_node
from .linkify import find_links
from .parser import ParseError
from .policy import DEFAULT_DOCUMENT_POLICY, DEFAULT_POLICY, SanitizationPolicy, UnsafeHtmlError
from .select import Matcher, parse_selector
from .serialize import leaf, start_tag
from .text import neutralize_end_tags, strip_invisible
from .urls import UrlPolicy, clean_sink, clean_style, css_loads, sink_kind

_SINK: ContextVar[list | None] = ContextVar("errors", default=None)
_RUN = re.compile("[\t\n\f\r ]+")
# Elements that hold text alone: a link there would be written as markup and read again as text.
_TEXT_ONLY = T.RCDATA | T.RAW_OUTPUT
# Siblings that show nothing.
_UNSEEN = frozenset({"#comment", "#pi", "script", "style", "template", "noscript"})


def emit_error(code: str, *, node: Node | None = None, line: int | None = None, column: int | None = None, category: str = "transform", message: str | None = None) -> None:
    """From a callback: add an error to the document being transformed."""
    sink = _SINK.get()
    if sink is not None:
        sink.append(ParseError(code, line or 0, column or 0, category, message or code))


class Decision(Enum):
    KEEP = "keep"
    DROP = "drop"
    UNWRAP = "unwrap"
    EMPTY = "empty"
    ESCAPE = "escape"


@dataclass(frozen=True)
class _Spec:
    enabled: bool = field(default=True, kw_only=True)
    callback: Callable[[Node], None] | None = field(default=None, kw_only=True)
    report: Callable[..., None] | None = field(default=None, kw_only=True)

    def told(self, node: Node, message: str) -> None:
        if self.callback:
            self.callback(node)
        if self.report:
            self.report(message, node=node)


@dataclass(frozen=True)
class SetAttrs(_Spec):
    selector: str
    attributes: dict[str, str | None]

    def __init__(self, selector: str, attributes: dict | None = None, *, enabled: bool = True, callback=None, report=None, **attrs: str | None) -> None:
        for k, v in {"selector": selector, "attributes": {**(attributes or {}), **attrs}, "enabled": enabled, "callback": callback, "report": report}.items():
            object.__setattr__(self, k, v)


@dataclass(frozen=True)
class Drop(_Spec):
    selector: str


@dataclass(frozen=True)
class Unwrap(_Spec):
    selector: str


@dataclass(frozen=True)
class Escape(_Spec):
    selector: str


@dataclass(frozen=True)
class Empty(_Spec):
    selector: str


@dataclass(frozen=True)
class Edit(_Spec):
    selector: str
    func: Callable[[Node], None]


@dataclass(frozen=True)
class EditDocument(_Spec):
    func: Callable[[Node], None]


@dataclass(frozen=True)
class Decide(_Spec):
    selector: str
    func: Callable[[Node], Decision]


@dataclass(frozen=True)
class EditAttrs(_Spec):
    selector: str
    func: Callable[[Node], dict | None]


@dataclass(frozen=True)
class Linkify(_Spec):
    skip_tags: Sequence[str] = ("a", "code", "pre", "script", "style", "textarea")
    fuzzy_ip: bool = False
    extra_tlds: Sequence[str] = ()


@dataclass(frozen=True)
class CollapseWhitespace(_Spec):
    skip_tags: Sequence[str] = tuple(sorted(T.PRESERVE_SPACE))
    trim_blocks: bool = True
    block_tags: Sequence[str] = tuple(sorted(T.TRIM_BLOCKS))


@dataclass(frozen=True)
class Sanitize(_Spec):
    policy: SanitizationPolicy | None = None


@dataclass(frozen=True)
class HardenRawtext(_Spec):
    policy: SanitizationPolicy | None = None


@dataclass(frozen=True)
class DropComments(_Spec):
    escape: bool = False


@dataclass(frozen=True)
class DropDoctype(_Spec):
    pass


@dataclass(frozen=True)
class DropForeignNamespaces(_Spec):
    pass


@dataclass(frozen=True)
class DropAttrs(_Spec):
    selector: str
    patterns: Sequence[str] = ()


@dataclass(frozen=True)
class AllowlistAttrs(_Spec):
    selector: str
    allowed_attributes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class DropUrlAttrs(_Spec):
    selector: str
    url_policy: UrlPolicy = field(default_factory=UrlPolicy)


@dataclass(frozen=True)
class AllowStyleAttrs(_Spec):
    selector: str
    allowed_css_properties: Sequence[str] = ()
    url_policy: UrlPolicy | None = None


@dataclass(frozen=True)
class MergeAttrs(_Spec):
    tag: str
    attr: str
    tokens: Sequence[str] = ()


@dataclass(frozen=True)
class PruneEmpty(_Spec):
    selector: str
    strip_whitespace: bool = True


@dataclass(frozen=True)
class StripInvisible(_Spec):
    pass


@dataclass(frozen=True)
class TagRule(_Spec):
    """The tag decision of a policy."""

    policy: SanitizationPolicy | None = None


@dataclass(frozen=True)
class Stage(_Spec):
    transforms: Sequence[Any] = ()


class Walker:
    """One run over a tree."""

    def __init__(self, root: Node, errors: list[ParseError], policy: SanitizationPolicy | None = None) -> None:
        self.root, self.errors, self.source = root, errors, root.data if isinstance(root.data, str) and root.ns is None else ""
        self.policy = policy or (DEFAULT_DOCUMENT_POLICY if root.name == "#document" else DEFAULT_POLICY)
        self.matcher = Matcher()

    # Plan: stages of walks and passes.

    def expand(self, spec: Any) -> list[Any]:
        if not spec.enabled:
            return []
        if isinstance(spec, Sanitize):
            return self.sanitizer(spec.policy or self.policy)
        if isinstance(spec, MergeAttrs) and not spec.tokens:
            return []
        return [spec]

    def sanitizer(self, p: SanitizationPolicy) -> list[Any]:
        tell = lambda message, node=None: self.unsafe(p, message, node)
        out: list[Any] = [DropForeignNamespaces(report=tell), TagRule(policy=p, report=tell)]
        if p.strip_invisible_unicode:
            out.append(StripInvisible(report=tell))
        allowed = dict(p.allowed_attributes)
        if p.force_link_rel:
            allowed["a"] = allowed.get("a", frozenset()) | {"rel"}
        out += [AllowlistAttrs("*", allowed, report=tell), DropUrlAttrs("*", p.url_policy, report=tell)]
        if any("style" in v for v in p.allowed_attributes.values()):
            out.append(AllowStyleAttrs("[style]", tuple(p.allowed_css_properties), p.url_policy, report=tell))
        if p.force_link_rel:
            out.append(MergeAttrs("a", "rel", tuple(p.force_link_rel)))
        if p.drop_comments:
            out.append(DropComments(escape=p.disallowed_tag_handling == "escape", report=tell))
        if p.drop_doctype:
            out.append(DropDoctype(report=tell))
        if p.allowed_tags & {"script", "style"}:
            out.append(HardenRawtext(policy=p))
        return out

    def unsafe(self, p: SanitizationPolicy, message: str, node: Node | None, code: str = "unsafe-html") -> None:
        if p.unsafe_handling == "raise":
            raise UnsafeHtmlError(message)
        if p.unsafe_handling == "collect":
            line = column = 0
            if node is not None and node.span and self.source:
                at = node.span[0]
                line, column = self.source.count("\n", 0, at) + 1, at - self.source.rfind("\n", 0, at)
            self.errors.append(ParseError(code, line, column, "security", message))

    def run(self, specs: Sequence[Any]) -> Node:
        token = _SINK.set(self.errors)
        try:
            for stage in stages(specs):
                batch: list[Any] = []
                for spec in [x for s in stage for x in self.expand(s)]:
                    if isinstance(spec, (PruneEmpty, EditDocument, HardenRawtext)):
                        self.walk(batch)
                        batch = []
                        {PruneEmpty: self.prune, EditDocument: lambda s: s.func(self.root), HardenRawtext: self.harden}[type(spec)](spec)
                    else:
                        batch.append(spec)
                self.walk(batch)
        finally:
            _SINK.reset(token)
        return self.root

    # The walk.

    def walk(self, specs: list[Any]) -> None:
        if not specs:
            return
        ops = [self.lower(s) for s in specs]
        structural = any(isinstance(s, (Drop, Unwrap, Escape, Empty, Edit, Decide, Linkify, TagRule, DropForeignNamespaces, DropComments, DropDoctype, CollapseWhitespace)) for s in specs)
        self.matcher = Matcher()
        pending: list[tuple[Node, int]] = [(self.root, 0)]
        while pending:
            parent, i = pending.pop()
            if i >= len(parent.children):
                continue
            node = parent.children[i]
            begin, node.start_index = node.start_index, 0
            moved = False
            for k in range(begin, len(ops)):
                if structural:
                    self.matcher = Matcher()
                if ops[k](node, i, k):
                    moved = True
                    break
            if moved:
                pending.append((parent, i))
                continue
            pending.append((parent, i + 1))
            pending.append((node, 0))
            if node.content is not None:
                pending.append((node.content, 0))

    def lower(self, s: Any) -> Callable[[Node, int, int], bool]:
        """A transform as a function of (node, its index, the transform's number) that says whether the node is no longer at its place."""
        return getattr(self, "_" + type(s).__name__.lower())(s)

    def hits(self, selector: str) -> Callable[[Node], bool]:
        parsed = parse_selector(selector)
        if selector.strip() == "*":
            return lambda n: n.ns is not None or n.name == "!doctype"
        return lambda n: (n.ns is not None or n.name in ("!doctype", "#comment")) and self.matcher.matches(n, parsed)

    def _on(self, s: Any, act: Callable[[Node, int, int], bool], message: str) -> Callable[[Node, int, int], bool]:
        hits = self.hits(s.selector)

        def run(node: Node, i: int, k: int) -> bool:
            if not hits(node):
                return False
            s.told(node, message)
            return act(node, i, k)

        return run

    def _drop(self, s: Drop):
        return self._on(s, self.act_drop, "dropped")

    def _unwrap(self, s: Unwrap):
        return self._on(s, lambda n, i, k: self.act_unwrap(n, i, k + 1), "unwrapped")

    def _escape(self, s: Escape):
        return self._on(s, self.act_escape, "escaped")

    def _empty(self, s: Empty):
        return self._on(s, self.act_empty, "emptied")

    def _edit(self, s: Edit):
        def act(node: Node, i: int, k: int) -> bool:
            parent = node.parent
            s.func(node)
            return node.parent is not parent or i >= len(parent.children) or parent.children[i] is not node

        return self._on(s, act, "edited")

    def _setattrs(self, s: SetAttrs):
        return self._on(s, lambda n, i, k: n.attrs.update(s.attributes) or False, "attributes set")

    def _editattrs(self, s: EditAttrs):
        def act(node: Node, i: int, k: int) -> bool:
            got = s.func(node)
            if got is not None:
                node.attrs = dict(got)
            return False

        return self._on(s, act, "attributes edited")

    def _decide(self, s: Decide):
        hits = (lambda n: True) if s.selector.strip() == "*" else self.hits(s.selector)
        acts = {Decision.DROP: self.act_drop, Decision.UNWRAP: self.act_unwrap, Decision.EMPTY: self.act_empty, Decision.ESCAPE: self.act_escape}

        def run(node: Node, i: int, k: int) -> bool:
            if not hits(node):
                return False
            choice = Decision(s.func(node))
            if choice is Decision.KEEP:
                return False
            s.told(node, choice.value)
            return acts[choice](node, i, k)

        return run

    def _tagrule(self, s: TagRule):
        p = s.policy
        act = {"unwrap": self.act_unwrap, "escape": self.act_escape, "drop": self.act_drop}[p.disallowed_tag_handling]

        def run(node: Node, i: int, k: int) -> bool:
            if node.ns is None:
                return False
            name = node.name.lower()
            if name in p.allowed_tags:
                return False
            s.told(node, f"tag <{name}> is not allowed")
            return self.act_drop(node, i, k) if name in p.drop_content_tags else act(node, i, k)

        return run

    def act_drop(self, node: Node, i: int, k: int) -> bool:
        del node.parent.children[i]
        node.parent = None
        return True

    def act_unwrap(self, node: Node, i: int, k: int) -> bool:
        parent = node.parent
        inner = [*node.children, *(node.content.children if node.content is not None else ())]
        for c in inner:
            c.parent, c.start_index = parent, max(c.start_index, k)
        parent.children[i : i + 1] = inner
        node.parent, node.children = None, []
        return True

    def act_empty(self, node: Node, i: int, k: int) -> bool:
        for c in node.children:
            c.parent = None
        node.children = []
        if node.content is not None:
            node.content.children = []
        return False

    def act_escape(self, node: Node, i: int, k: int) -> bool:
        if node.ns is None:
            return False
        parent = node.parent
        source = self.source[slice(*node.span)] if node.span and self.source else ""
        head = text_node(source if source.startswith("<") else start_tag(node.name, node.attrs, ns=node.ns))
        inner = [*node.children, *(node.content.children if node.content is not None else ())]
        tail = []
        if node.end_span and self.source:
            tail = [text_node(self.source[slice(*node.end_span)])]
        elif not node.span and node.name not in T.VOID:
            tail = [text_node(f"</{node.name}>")]
        new = [head, *inner, *tail]
        for c in new:
            c.parent, c.start_index = parent, k
        parent.children[i : i + 1] = new
        node.parent, node.children = None, []
        return True

    def _linkify(self, s: Linkify):
        skip = frozenset(t.lower() for t in s.skip_tags) | {"a"}

        def run(node: Node, i: int, k: int) -> bool:
            if node.name != "#text" or not node.data or within(node, skip):
                return False
            if node.parent.ns == "html" and node.parent.name.lower() in _TEXT_ONLY:
                return False
            links = find_links(node.data, s.fuzzy_ip, s.extra_tlds)
            if not links:
                return False
            new, at = [], 0
            for link in links:
                if link.start > at:
                    new.append(text_node(node.data[at : link.start]))
                a = Node("a", "html", {"href": link.href})
                inner = text_node(link.text)
                inner.parent, a.children = a, [inner]
                s.told(a, "linked")
                new.append(a)
                at = link.end
            if at < len(node.data):
                new.append(text_node(node.data[at:]))
            for c in new:
                c.parent, c.start_index = node.parent, k + 1
            node.parent.children[i : i + 1] = new
            return True

        return run

    def _collapsewhitespace(self, s: CollapseWhitespace):
        skip, blocks = frozenset(s.skip_tags), frozenset(s.block_tags)

        def beside(nodes) -> Node | None:
            return next((n for n in nodes if n.name not in _UNSEEN), None)

        def run(node: Node, i: int, k: int) -> bool:
            if node.name != "#text" or not node.data or within(node, skip):
                return False
            data, sibs = _RUN.sub(" ", node.data), node.parent.children
            before, after = beside(reversed(sibs[:i])), beside(sibs[i + 1 :])
            edge = lambda n: n.name in blocks or n.name == "br" if n is not None else node.parent.name in blocks or node.parent.ns is None
            if (before is not None and before.name == "#text" and before.data.endswith(" ")) or (s.trim_blocks and edge(before)):
                data = data.removeprefix(" ")
            if s.trim_blocks and edge(after):
                data = data.removesuffix(" ")
            if data != node.data:
                s.told(node, "whitespace collapsed")
                node.data = data
            if not data:
                del sibs[i]
                node.parent = None
                return True
            return False

        return run

    def _dropcomments(self, s: DropComments):
        def run(node: Node, i: int, k: int) -> bool:
            if node.name not in ("#comment", "#pi"):
                return False
            s.told(node, "comment dropped")
            if not s.escape:
                return self.act_drop(node, i, k)
            text, parent = text_node(leaf(node)), node.parent
            del parent.children[i]
            text.start_index = k + 1
            if parent.name == "#document":
                body = next((n for n in parent.descendants() if n.name == "body"), None)
                parent, i = (body, 0) if body is not None else (parent, i)
            text.parent = parent
            parent.children.insert(i, text)
            return True

        return run

    def _dropdoctype(self, s: DropDoctype):
        def run(node: Node, i: int, k: int) -> bool:
            if node.name != "!doctype":
                return False
            s.told(node, "doctype dropped")
            return self.act_drop(node, i, k)

        return run

    def _dropforeignnamespaces(self, s: DropForeignNamespaces):
        def run(node: Node, i: int, k: int) -> bool:
            if node.ns in (None, "html"):
                return False
            s.told(node, f"<{node.name}> is foreign")
            if any(n.name in ("script", "style") and n.span and not n.end_span and not n.self_closing and n.ns != "html" for n in [node, *node.descendants()]):
                for n in node.parent.children[i + 1 :]:
                    n.parent = None
                del node.parent.children[i + 1 :]
            return self.act_drop(node, i, k)

        return run

    def _stripinvisible(self, s: StripInvisible):
        def run(node: Node, i: int, k: int) -> bool:
            if node.name == "#text":
                new = strip_invisible(node.data or "")
                if new != node.data:
                    s.told(node, "invisible characters removed")
                    node.data = new
            elif node.ns is not None and any(v and not v.isascii() for v in node.attrs.values()):
                node.attrs = {a: strip_invisible(v) if v else v for a, v in node.attrs.items()}
            return False

        return run

    def _attrs(self, s: Any, act: Callable[[Node], None]):
        hits = self.hits(s.selector)

        def run(node: Node, i: int, k: int) -> bool:
            if node.ns is not None and hits(node):
                act(node)
            return False

        return run

    def _dropattrs(self, s: DropAttrs):
        wanted = re.compile("|".join(glob(p) for p in s.patterns) or r"(?!)")

        def act(node: Node) -> None:
            gone = [a for a in node.attrs if wanted.fullmatch(a.lower())]
            if gone:
                s.told(node, f"attributes dropped: {', '.join(gone)}")
                node.attrs = {a.lower(): v for a, v in node.attrs.items() if a not in gone}

        return self._attrs(s, act)

    def _allowlistattrs(self, s: AllowlistAttrs):
        allowed = {t.lower(): frozenset(x.lower() for x in v) for t, v in s.allowed_attributes.items()}
        every = allowed.get("*", frozenset())

        def act(node: Node) -> None:
            mine = allowed.get(node.name.lower(), frozenset())
            gone = [a for a in node.attrs if a.lower() not in every and a.lower() not in mine]
            if gone:
                for a in gone:
                    s.told(node, f"attribute {a} is not allowed")
                node.attrs = {a.lower(): v for a, v in node.attrs.items() if a not in gone}

        return self._attrs(s, act)

    def _dropurlattrs(self, s: DropUrlAttrs):
        def act(node: Node) -> None:
            out, tag = {}, node.name.lower()
            for a, v in node.attrs.items():
                kind = sink_kind(tag, a.lower(), node.attrs)
                if kind is not None:
                    v = None if v is None else clean_sink(v, tag, a.lower(), kind, s.url_policy)
                    if v is None:
                        s.told(node, f"URL in {a} is not allowed")
                        continue
                out[a] = v
            node.attrs = out

        return self._attrs(s, act)

    def _allowstyleattrs(self, s: AllowStyleAttrs):
        allowed = frozenset(s.allowed_css_properties)

        def act(node: Node) -> None:
            if "style" in node.attrs:
                new = clean_style(node.attrs["style"], allowed, node.name, s.url_policy)
                if new != node.attrs["style"]:
                    s.told(node, "style cleaned")
                if new is None:
                    del node.attrs["style"]
                else:
                    node.attrs["style"] = new

        return self._attrs(s, act)

    def _mergeattrs(self, s: MergeAttrs):
        tokens = sorted({t.lower() for t in s.tokens})

        def run(node: Node, i: int, k: int) -> bool:
            if node.ns is not None and node.name.lower() == s.tag:
                have = list(dict.fromkeys((node.attrs.get(s.attr) or "").lower().split()))
                new = " ".join(have + [t for t in tokens if t not in have])
                if new != node.attrs.get(s.attr):
                    node.attrs[s.attr] = new
                    s.told(node, f"{s.attr} merged")
            return False

        return run

    # Passes of their own.

    def prune(self, s: PruneEmpty) -> None:
        order, pending = [], [self.root]
        while pending:
            node = pending.pop()
            order.append(node)
            pending += node.children
            if node.content is not None:
                pending.append(node.content)
        hits = self.hits(s.selector)
        full = lambda c: (c.name == "#text" and bool((c.data or "").strip() if s.strip_whitespace else c.data)) or not c.name.startswith("#")
        for node in reversed(order):
            if node is self.root or node.name.startswith("#") or (node.ns == "html" and node.name in T.VOID):
                continue
            self.matcher = Matcher()
            if not any(map(full, node.children)) and not (node.content is not None and any(map(full, node.content.children))) and hits(node):
                s.told(node, "empty element pruned")
                node.detach()

    def harden(self, s: HardenRawtext) -> None:
        p = s.policy or self.policy
        for node in [n for n in self.root.descendants() if n.ns is not None and n.name.lower() in ("script", "style")]:
            name, texts = node.name.lower(), [c for c in node.children if c.name == "#text"]
            for c in node.children:
                if c.name != "#text":
                    self.unsafe(p, f"a node inside <{name}> was dropped", c, "unsafe-rawtext-child")
                    c.parent = None
            node.children = texts
            whole = "".join(t.data or "" for t in texts)
            safe = neutralize_end_tags(whole, name)
            if safe != whole:
                self.unsafe(p, f"an end tag inside <{name}>", node, "unsafe-rawtext-end-tag")
                texts[0].data, node.children = safe, texts[:1]
            if name == "style" and safe and css_loads(safe):
                self.unsafe(p, "a resource inside <style>", node, "unsafe-style-resource")
                node.children = []


def within(node: Node, names: frozenset[str]) -> bool:
    up = node.parent
    while up is not None:
        if up.name in names:
            return True
        up = up.parent
    return False


def glob(pattern: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())


def stages(specs: Sequence[Any]) -> list[list[Any]]:
    """Transforms by stage; a Stage is one of its own, those between stages form one each."""
    out: list[list[Any]] = [[]]
    for s in specs:
        if isinstance(s, Stage):
            if s.enabled:
                inner = stages(s.transforms)
                out += [*inner, []]
        else:
            out[-1].append(s)
    return [x for x in out if x]


def apply_transforms(root: Node, specs: Sequence[Any], errors: list[ParseError] | None = None, policy: SanitizationPolicy | None = None) -> Node:
    return Walker(root, [] if errors is None else errors, policy).run(specs)


def sanitize(root: Node, policy: SanitizationPolicy | None = None, errors: list[ParseError] | None = None) -> Node:
    """Sanitize a tree in place. A root that is no document or fragment is put into a fragment, which is returned if it changed to that."""
    if root.ns is None and root.name.startswith("#document"):
        return apply_transforms(root, [Sanitize(policy=policy)], errors)
    wrapper = Node("#document-fragment")
    wrapper.append_child(root)
    apply_transforms(wrapper, [Sanitize(policy=policy)], errors)
    if len(wrapper.children) == 1:
        only = wrapper.children[0]
        only.parent = None
        return only
    return wrapper


#: What the command line's cleanup option adds.
def cleanup_preset(with_sanitize: bool = True) -> list[Any]:
    return [*([Sanitize()] if with_sanitize else []), Unwrap("a:not([href])"), Drop('img:not([src]), img[src=""]'), PruneEmpty("*")]


def with_sanitize(specs: Sequence[Any]) -> list[Any]:
    """Sanitize goes last unless the transforms have it, or a stage has it."""
    has = lambda xs: any(isinstance(x, Sanitize) or (isinstance(x, Stage) and has(x.transforms)) for x in xs)
    return list(specs) if has(specs) else [*specs, Sanitize()]


