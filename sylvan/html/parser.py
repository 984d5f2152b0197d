"""HTML parsing by the WHATWG algorithm: a tokenizer over a string and a tree builder with explicit insertion modes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import tables as T
from .dom import Doctype, Node
from .entities import unescape

WS = "\t\n\f\r "
_TAG = re.compile(r"[A-Za-z][^\t\n\f />]*")
_SKIP = re.compile(r"[\t\n\f /]*")
_NAME = re.compile(r"=?[^\t\n\f />=]*")
_EQ = re.compile(r"[\t\n\f ]*=[\t\n\f ]*")
_BARE = re.compile(r"[^\t\n\f >]*")
_COMMENT_END = re.compile(r"--!?>")
_DOCTYPE_NAME = re.compile(r"[\t\n\f ]*([^\t\n\f >]*)")
_PI = re.compile(r"[^\W\d][\w\-.:·]*")
_LEADING = re.compile(r"[\t\n\f ]*")
_ASCII_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters that XML doesn't allow, with what stands for them in XML coercion.
_XML_BAD = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f\ufdd0-\ufdef\ufffe\uffff]|[" + "".join(chr((p << 16) + x) for p in range(1, 17) for x in (0xFFFE, 0xFFFF)) + "]")


def lower(text: str) -> str:
    """ASCII lower-casing."""
    return text.lower() if text.isascii() else text.translate(_ASCII_UPPER)


@dataclass(frozen=True)
class FragmentContext:
    tag: str
    namespace: str | None = None


@dataclass(frozen=True)
class ParseError:
    code: str
    line: int
    column: int
    category: str = "tokenizer"
    message: str = ""


class StrictModeError(SyntaxError):
    """The first parse error of a document parsed in strict mode."""


def quirks_of(d: Doctype, iframe_srcdoc: bool = False) -> str:
    public, system = (d.public_id or "").lower(), (d.system_id or "").lower()
    if d.force_quirks:
        return "quirks"
    if iframe_srcdoc:
        return "no-quirks"
    if (d.name or "").lower() != "html" or public in T.QUIRKS_PUBLIC or system in T.QUIRKS_SYSTEM or public.startswith(T.QUIRKS_PREFIXES):
        return "quirks"
    if public.startswith(T.LIMITED_PREFIXES):
        return "limited-quirks"
    if public.startswith(T.HTML4_PREFIXES):
        return "quirks" if d.system_id is None else "limited-quirks"
    return "no-quirks"


def parse_doctype(body: str) -> Doctype:
    """Of the text between ``<!doctype`` and ``>``."""
    m = _DOCTYPE_NAME.match(body)
    name = lower(m[1]).replace("\0", "�") or None
    rest = body[m.end() :].strip(WS)
    if name is None:
        return Doctype(None, None, None, True)
    if not rest:
        return Doctype(name)
    public = system = None
    key = rest[:6].lower()

    def quoted(s: str) -> tuple[str | None, str, bool]:
        s = s.lstrip(WS)
        if not s or s[0] not in "\"'":
            return None, s, True
        end = s.find(s[0], 1)
        return (s[1:].replace("\0", "�"), "", False) if end < 0 else (s[1:end].replace("\0", "�"), s[end + 1 :], True)

    if key not in ("public", "system"):
        return Doctype(name, None, None, True)
    rest = rest[6:]
    force = False
    if key == "public":
        public, rest, closed = quoted(rest)
        if public is None or not closed:
            return Doctype(name, public, None, True)
        if not rest.strip(WS):
            return Doctype(name, public)
    system, rest, closed = quoted(rest)
    if system is None or not closed:
        force = True
    return Doctype(name, public, system, force)


def pi_data(body: str) -> str | None:
    """Text of a processing instruction node from what follows ``<?``, or None if it is a comment."""
    m = _PI.match(body)
    if not m or m[0].lower().startswith("xml"):
        return None
    rest = body[m.end() :]
    if rest and rest[0] not in WS and rest[0] != "?":
        return None
    return f"{m[0]} {rest.lstrip(WS).removesuffix('?')}"


class Parser:
    """One parse. The result is ``document`` (a #document, or a #document-fragment with a fragment context)."""

    def __init__(self, html: str, *, fragment: FragmentContext | None = None, scripting: bool = True, iframe_srcdoc: bool = False, xml_coercion: bool = False, track: bool = False, literal: bool = False) -> None:
        if "\r" in html:
            html = html.replace("\r\n", "\n").replace("\r", "\n")
        self.html, self.n, self.track = html, len(html), track
        self.scripting, self.iframe_srcdoc, self.xml = scripting, iframe_srcdoc, xml_coercion
        #: Markup that makes no element (comments, declarations, stray or unfinished tags) stays as text.
        self.literal = literal
        self.fragment = fragment
        self.document = Node("#document-fragment" if fragment else "#document", data=html)
        self.quirks = "no-quirks"
        self.open: list[Node] = []
        self.active: list[Node | None] = []
        self.templates: list[str] = []
        self.head: Node | None = None
        self.form: Node | None = None
        self.frameset_ok = True
        self.skip_lf = self.foster = False
        self.mode, self.original = "initial", None
        self.table_text: list[str] | None = None
        self.raw: str | None = None
        self.pos = 0
        self.has_selectedcontent = False
        self.span = (0, 0)
        self.markup = self.text_at = 0

    def parse(self) -> Node:
        if self.fragment is not None:
            self._start_fragment()
        self._scan()
        self._finish()
        return self.document

    def _start_fragment(self) -> None:
        tag, ns = self.fragment.tag, self.fragment.namespace
        root = Node("html", "html")
        root.parent = None
        self.root = root
        self.open = [root]
        self.context = Node(tag if ns else lower(tag), {None: "html", "": "html", "html": "html", "svg": "svg", "math": "math"}[ns])
        self.mode = "in_body"
        if self.context.ns == "html":
            name = self.context.name
            if name in T.RCDATA:
                self.raw, self.skip_lf = name, name == "textarea"
            elif name in T.RAWTEXT or name == "script" or (name == "noscript" and self.scripting):
                self.raw = name
            elif name == "plaintext":
                self.raw = "plaintext"
            if name == "template":
                self.templates.append("in_template")
            if name == "form":
                self.form = self.context
        self._reset_mode()

    # Tokenizer.

    def _scan(self) -> None:
        html, n = self.html, self.n
        find = html.find
        while self.pos < n:
            pos = self.pos
            if self.raw is not None:
                self._raw_text()
                continue
            lt = find("<", pos)
            self.text_at, self.markup = pos, lt
            if lt < 0:
                self._text(html[pos:n])
                self.pos = n
                return
            if lt > pos:
                self._text(html[pos:lt])
            if lt + 1 >= n:
                self._text("<")
                self.pos = n
                return
            c = html[lt + 1]
            if c.isascii() and c.isalpha():
                m = _TAG.match(html, lt + 1)
                name, pos = lower(m[0]), m.end()
                got = self._attributes(pos)
                if got is None:
                    self._unfinished(lt)
                    return
                attrs, closing, self.pos = got
                self.span = (lt, self.pos)
                self._start(name.replace("\0", "�"), attrs, closing)
            elif c == "/":
                if lt + 2 >= n:
                    self._text("</")
                    self.pos = n
                    return
                c = html[lt + 2]
                if c.isascii() and c.isalpha():
                    m = _TAG.match(html, lt + 2)
                    got = self._attributes(m.end())
                    if got is None:
                        self._unfinished(lt)
                        return
                    self.pos = got[2]
                    self.span = (lt, self.pos)
                    self.skip_lf = False
                    if self.literal and not any(lower(x.name) == lower(m[0]) for x in self.open[1:]):
                        self._characters(html[lt : self.pos])
                        continue
                    self._end(lower(m[0]).replace("\0", "�"))
                elif c == ">" and not self.literal:
                    self.pos = lt + 3
                elif self.literal:
                    self._literal(lt)
                else:
                    self._bogus(lt + 2)
            elif self.literal and c in "!?":
                self._literal(lt)
            elif c == "!":
                if html.startswith("--", lt + 2):
                    self._comment_token(lt + 4)
                elif html[lt + 2 : lt + 9].lower() == "doctype":
                    end = find(">", lt + 9)
                    body = html[lt + 9 : end if end >= 0 else n]
                    # a quoted identifier ends at ">" as well
                    self.pos = n if end < 0 else end + 1
                    d = parse_doctype(body)
                    self._doctype(Doctype(d.name, d.public_id, d.system_id, True) if end < 0 else d)
                elif html.startswith("[CDATA[", lt + 2) and self.open and self._current().ns != "html":
                    end = find("]]>", lt + 9)
                    data = html[lt + 9 : end if end >= 0 else n]
                    self.pos = n if end < 0 else end + 3
                    if data:
                        self._characters(data)
                else:
                    self._bogus(lt + 2)
            elif c == "?":
                end = find(">", lt + 2)
                body = html[lt + 2 : end if end >= 0 else n]
                data = pi_data(body)
                if not body and end < 0:
                    self.pos = n
                elif data is None:
                    self._bogus(lt + 1)
                else:
                    self.pos = n if end < 0 else end + 1
                    if end >= 0:
                        self.skip_lf = False
                        self._comment(data.replace("\0", "�"), "#pi")
            elif c == "\0":
                self._append_after_lt()
            else:
                self._text("<")
                self.pos = lt + 1

    def _literal(self, lt: int) -> None:
        """A declaration, comment or stray tag, as text."""
        html = self.html
        if html.startswith("<!--", lt):
            m = _COMMENT_END.search(html, lt + 4)
            end = m.end() if m else self.n
        else:
            end = html.find(">", lt) + 1 or self.n
        self.pos = end
        self._characters(html[lt:end])

    def _unfinished(self, lt: int) -> None:
        """A tag that the input ends in: nothing, or text."""
        self.pos = self.n
        if self.literal:
            self._characters(self.html[lt:])

    def _append_after_lt(self) -> None:
        """``<`` before NUL: both stay as text, the NUL as U+FFFD."""
        self._text("<�")
        self.pos = self.html.index("\0", self.pos) + 1

    def _attributes(self, pos: int) -> tuple[dict[str, str], bool, int] | None:
        html, n, attrs = self.html, self.n, {}
        while True:
            m = _SKIP.match(html, pos)
            pos = m.end()
            if pos >= n:
                return None
            if html[pos] == ">":
                return attrs, m.end() > m.start() and html[pos - 1] == "/", pos + 1
            m = _NAME.match(html, pos)
            name, pos = m[0], m.end()
            m = _EQ.match(html, pos)
            if m:
                pos = m.end()
                if pos >= n:
                    return None
                c = html[pos]
                if c == '"' or c == "'":
                    end = html.find(c, pos + 1)
                    if end < 0:
                        return None
                    value, pos = html[pos + 1 : end], end + 1
                elif c == ">":
                    value = ""
                else:
                    m = _BARE.match(html, pos)
                    value, pos = m[0], m.end()
                if "&" in value:
                    value = unescape(value, True)
                if "\0" in value:
                    value = value.replace("\0", "�")
            else:
                value = ""
            name = lower(name)
            if "\0" in name:
                name = name.replace("\0", "�")
            if name not in attrs:
                attrs[name] = value if not self.xml else self._coerce(value)

    def _bogus(self, pos: int) -> None:
        end = self.html.find(">", pos)
        data = self.html[pos : end if end >= 0 else self.n]
        self.pos = self.n if end < 0 else end + 1
        self.skip_lf = False
        self._comment(data.replace("\0", "�"))

    def _comment_token(self, pos: int) -> None:
        html = self.html
        self.skip_lf = False
        if html.startswith(">", pos) or html.startswith("->", pos):
            self.pos = html.index(">", pos) + 1
            self._comment("")
            return
        m = _COMMENT_END.search(html, pos)
        if m:
            data, self.pos = html[pos : m.start()], m.end()
        else:
            data, self.pos = html[pos:], self.n
            for tail in ("--!", "--", "-"):
                if data.endswith(tail):
                    data = data[: -len(tail)]
                    break
        self._comment(data.replace("\0", "�"))

    def _raw_text(self) -> None:
        """The body of a raw text element, up to its end tag, which is handled as any end tag."""
        html, name, pos = self.html, self.raw, self.pos
        self.text_at = pos
        if name == "plaintext" or (self.fragment is not None and len(self.open) == 1):
            end, stop = self.n, None  # a fragment's context has no end tag
        elif name == "script":
            end = self._script_end(pos)
            stop = end < self.n
        else:
            end = self._end_tag(name, pos)
            stop = end < self.n
        data = html[pos:end]
        if name in T.RCDATA:
            data = unescape(data)
        self.raw = None
        if self.skip_lf and data:
            data = data.removeprefix("\n")
            self.skip_lf = False
        if data:
            self._append_text(data.replace("\0", "�"))
        self.pos = end
        if stop:
            got = self._attributes(end + 2 + len(name))
            if got is None:
                self.pos = self.n
                return
            self.span, self.pos = (end, got[2]), got[2]
            self._end(name)

    def _end_tag(self, name: str, pos: int) -> int:
        html, n = self.html, self.n
        while True:
            lt = html.find("</", pos)
            if lt < 0:
                return n
            after = lt + 2 + len(name)
            if lower(html[lt + 2 : after]) == name and after < n and html[after] in "\t\n\f />":
                return lt
            pos = lt + 2

    _SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.I | re.A)

    def _script_end(self, pos: int) -> int:
        """Scripts may hold comments that hold script tags: inside ``<!-- <script``, the first ``</script`` ends only the inner one."""
        state, opened = 0, 0  # 0 data, 1 escaped, 2 double escaped
        while m := self._SCRIPT.search(self.html, pos):
            found, pos = m[0], m.end()
            if found == "<!--":
                if state == 0:
                    state, opened = 1, m.start()
                    if self.html.startswith((">", "->"), pos):
                        state = 0
            elif found == "-->":
                state = 0
            elif m[1]:
                if state < 2:
                    return m.start()
                state = 1
            elif state == 1:
                state = 2
        return self.n

    def _text(self, data: str) -> None:
        if self.skip_lf:
            self.skip_lf = False
            if data[0] == "\n":
                data = data[1:]
                if not data:
                    return
        self._characters(unescape(data) if "&" in data else data)

    # Tree construction: helpers.

    def _current(self) -> Node:
        """The adjusted current node."""
        return self.context if self.fragment is not None and len(self.open) == 1 else self.open[-1]

    def _foreign(self) -> bool:
        return bool(self.open) and self._current().ns != "html"

    def _coerce(self, text: str) -> str:
        return _XML_BAD.sub("�", text.replace("\f", " ")) if self.xml else text

    def _place(self, target: Node | None = None) -> tuple[Node, Node | None]:
        """Where a node goes: (parent, the child it goes before)."""
        target = target or self.open[-1]
        if self.foster and target.ns == "html" and target.name in ("table", "tbody", "tfoot", "thead", "tr"):
            template = self._last("template")
            table = self._last("table")
            if template >= 0 and template > table:
                return self.open[template].content, None
            if table < 0:
                return self.open[0], None
            at = self.open[table]
            if at.parent is not None:
                return at.parent, at
            target = self.open[table - 1]
        if target.content is not None and target.ns == "html":
            return target.content, None
        return target, None

    def _last(self, name: str) -> int:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name == name and self.open[i].ns == "html":
                return i
        return -1

    @staticmethod
    def _put(parent: Node, before: Node | None, node: Node) -> None:
        node.parent = parent
        if before is None:
            parent.children.append(node)
        else:
            children = parent.children
            at = len(children) - 1
            while children[at] is not before:
                at -= 1
            children.insert(at, node)

    def _element(self, name: str, attrs: dict, ns: str = "html") -> Node:
        node = Node(name, ns, attrs)
        node.span = self.span
        if name == "template" and ns == "html":
            node.content = Node("#document-fragment")
            node.content.parent = node
        elif name == "selectedcontent":
            self.has_selectedcontent = True
        return node

    def _insert(self, name: str, attrs: dict, ns: str = "html") -> Node:
        node = self._element(name, attrs, ns)
        parent, before = self._place()
        self._put(parent, before, node)
        self.open.append(node)
        return node

    def _void(self, name: str, attrs: dict) -> Node:
        node = self._insert(name, attrs)
        self.open.pop()
        return node

    def _append_text(self, data: str) -> None:
        parent, before = self._place()
        if parent.name == "#document":
            return
        if self.xml:
            data = self._coerce(data)
        children = parent.children
        if before is None:
            last = children[-1] if children else None
        else:
            at = len(children) - 1
            while children[at] is not before:
                at -= 1
            last = children[at - 1] if at else None
        if last is not None and last.name == "#text":
            last.data += data
            return
        node = Node("#text", data=data)
        if self.track:
            node.span = (self.text_at, self.text_at)
        self._put(parent, before, node)

    def _comment(self, data: str, name: str = "#comment") -> None:
        if self.xml and name == "#comment":
            data = data.replace("--", "- -")
            data = self._coerce(data + " " if data.endswith("-") else data)
        self._flush_table()
        node = Node(name, data=data)
        if self.track:
            node.span = (self.markup, self.pos)
        mode = self.mode
        if self.fragment is None and mode in ("initial", "before_html", "after_after_body", "after_after_frameset"):
            self._put(self.document, None, node)
        elif mode == "after_body" or (self.fragment is not None and mode in ("after_after_body", "after_after_frameset")):
            self._put(self.open[0], None, node)
        else:
            parent, before = self._place()
            self._put(parent, before, node)

    def _in_scope(self, name, extra: frozenset = frozenset()) -> bool:
        names = (name,) if isinstance(name, str) else name
        for node in reversed(self.open):
            if node.ns == "html":
                if node.name in names:
                    return True
                if node.name in T.SCOPE or node.name in extra:
                    return False
            elif (node.ns == "math" and (node.name in T.MATH_TEXT or node.name == "annotation-xml")) or (node.ns == "svg" and node.name in T.SVG_HTML):
                return False
        return False

    def _node_in_scope(self, wanted: Node) -> bool:
        for node in reversed(self.open):
            if node is wanted:
                return True
            if (node.ns == "html" and node.name in T.SCOPE) or (node.ns == "math" and (node.name in T.MATH_TEXT or node.name == "annotation-xml")) or (node.ns == "svg" and node.name in T.SVG_HTML):
                return False
        return False

    _BUTTON = frozenset({"button"})
    _LIST = frozenset({"ol", "ul"})

    def _in_table_scope(self, *names: str) -> bool:
        for node in reversed(self.open):
            if node.ns == "html":
                if node.name in names:
                    return True
                if node.name in ("html", "table", "template"):
                    return False
        return False

    def _implied(self, but: str | None = None) -> None:
        while self.open[-1].ns == "html" and self.open[-1].name in T.IMPLIED_END and self.open[-1].name != but:
            self.open.pop()

    def _implied_thoroughly(self) -> None:
        names = T.IMPLIED_END | {"caption", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
        while self.open[-1].ns == "html" and self.open[-1].name in names:
            self.open.pop()

    def _pop_to(self, *names: str) -> None:
        while True:
            node = self.open.pop()
            if node.ns == "html" and node.name in names:
                if node.name == self._ending:
                    node.end_span = self.span
                return

    _ending: str | None = None

    def _close_p(self) -> None:
        if self._in_scope("p", self._BUTTON):
            self._implied("p")
            self._pop_to("p")

    def _clear_to(self, *names: str) -> None:
        while not (self.open[-1].ns == "html" and (self.open[-1].name in names or self.open[-1].name in ("template", "html"))):
            self.open.pop()

    def _clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _push_active(self, node: Node) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            other = self.active[i]
            if other is None:
                break
            if other.name == node.name and other.ns == node.ns and other.attrs == node.attrs:
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(node)

    def _reconstruct(self) -> None:
        active = self.active
        if not active or active[-1] is None:
            return
        stack = {id(x) for x in self.open} if len(self.open) > 8 else None
        held = (lambda x: id(x) in stack) if stack is not None else (lambda x: any(x is y for y in self.open))
        if held(active[-1]):
            return
        i = len(active) - 1
        while i > 0 and active[i - 1] is not None and not held(active[i - 1]):
            i -= 1
        for j in range(i, len(active)):
            old = active[j]
            active[j] = self._insert(old.name, dict(old.attrs))
            active[j].span = old.span

    def _reset_mode(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node, last = self.open[i], i == 0
            if last and self.fragment is not None:
                node = self.context
            name = node.name if node.ns == "html" else ""
            if name in ("td", "th") and not last:
                self.mode = "in_cell"
            elif name == "tr":
                self.mode = "in_row"
            elif name in ("tbody", "thead", "tfoot"):
                self.mode = "in_table_body"
            elif name == "caption":
                self.mode = "in_caption"
            elif name == "colgroup":
                self.mode = "in_column_group"
            elif name == "table":
                self.mode = "in_table"
            elif name == "template":
                self.mode = self.templates[-1]
            elif name == "head" and not last:
                self.mode = "in_head"
            elif name == "body":
                self.mode = "in_body"
            elif name == "frameset":
                self.mode = "in_frameset"
            elif name == "html":
                self.mode = "before_head" if self.head is None else "after_head"
            elif last:
                self.mode = "in_body"
            else:
                continue
            return

    def _doctype(self, d: Doctype) -> None:
        self.skip_lf = False
        if self.mode == "initial" and self.fragment is None:
            self._put(self.document, None, Node("!doctype", data=d))
            self.quirks = quirks_of(d, self.iframe_srcdoc)
            self.mode = "before_html"
        else:
            self._flush_table()

    # Tokens that imply others, before and around the body.

    def _leave_initial(self) -> None:
        if not self.iframe_srcdoc:
            self.quirks = "quirks"
        self.mode = "before_html"

    def _ensure_html(self, attrs: dict | None = None) -> None:
        node = self._element("html", attrs or {})
        self._put(self.document, None, node)
        self.open.append(node)
        self.mode = "before_head"

    def _ensure_head(self, attrs: dict | None = None) -> None:
        self.head = self._insert("head", attrs or {})
        self.mode = "in_head"

    def _leave_head(self) -> None:
        self.open.pop()
        self.mode = "after_head"

    def _ensure_body(self) -> None:
        self._insert("body", {})
        self.mode = "in_body"

    # Characters.

    def _characters(self, data: str) -> None:
        if self._foreign() and not self._html_point(chars=True):
            if not data.strip("\0\t\n\f\r "):
                pass
            else:
                self.frameset_ok = False
            self._append_text(data.replace("\0", "�"))
            return
        while data:
            mode = self.mode
            if mode == "in_body" or mode in ("in_cell", "in_caption", "in_template"):
                data = data.replace("\0", "") if "\0" in data else data
                if data:
                    self._reconstruct()
                    self._append_text(data)
                    if self.frameset_ok and data.strip(WS):
                        self.frameset_ok = False
                return
            if "\0" in data and mode in ("initial", "before_html", "before_head", "in_head", "after_head"):
                data = data.replace("\0", "")
            lead = _LEADING.match(data).end()
            white, rest = data[:lead], data[lead:]
            if mode in ("initial", "before_html", "before_head"):
                if not rest:
                    return
                if mode == "initial":
                    self._leave_initial()
                elif mode == "before_html":
                    self._ensure_html()
                else:
                    self._ensure_head()
                data = rest
            elif mode in ("in_head", "after_head"):
                if white:
                    self._append_text(white)
                if not rest:
                    return
                if mode == "in_head":
                    self._leave_head()
                else:
                    self._ensure_body()
                data = rest
            elif mode == "in_head_noscript":
                if white:
                    self._append_text(white)
                if not rest:
                    return
                self.open.pop()
                self.mode = "in_head"
                data = rest
            elif mode in ("in_table", "in_table_body", "in_row"):
                if self.open[-1].ns == "html" and self.open[-1].name in ("table", "tbody", "template", "tfoot", "thead", "tr"):
                    if self.table_text is None:
                        self.table_text = []
                    self.table_text.append(data.replace("\0", ""))
                else:
                    self._foster_text(data.replace("\0", ""))
                return
            elif mode == "in_column_group":
                if white:
                    self._append_text(white)
                if not rest:
                    return
                if self.open[-1].name != "colgroup" or self.open[-1].ns != "html":
                    return
                self.open.pop()
                self.mode = "in_table"
                data = rest
            elif mode in ("after_body", "after_after_body"):
                if not rest:
                    kept, self.mode = self.mode, "in_body"
                    self._characters(white)
                    self.mode = kept
                    return
                self.mode = "in_body"
            elif mode in ("in_frameset", "after_frameset", "after_after_frameset"):
                spaces = "".join(c for c in data if c in WS)
                if spaces:
                    self._append_text(spaces)
                return
            else:  # text
                self._append_text(data)
                return

    def _foster_text(self, data: str) -> None:
        if data:
            self.foster = True
            self._reconstruct()
            self._append_text(data)
            self.foster = False
            if data.strip(WS):
                self.frameset_ok = False

    def _flush_table(self) -> None:
        if self.table_text is not None:
            data, self.table_text = "".join(self.table_text), None
            if data.strip(WS):
                self._foster_text(data)
            elif data:
                self._append_text(data)

    def _html_point(self, chars: bool = False, tag: str | None = None) -> bool:
        """Whether a token is handled by HTML rules although the current node is foreign."""
        node = self._current()
        if node.ns == "math":
            if node.name in T.MATH_TEXT and (chars or tag not in ("mglyph", "malignmark")):
                return True
            if node.name == "annotation-xml":
                if tag == "svg":
                    return True
                return lower(node.attrs.get("encoding") or "") in ("text/html", "application/xhtml+xml")
            return False
        return node.ns == "svg" and node.name in T.SVG_HTML

    # Start tags.

    def _start(self, name: str, attrs: dict, closing: bool) -> None:
        self.skip_lf = False
        if self.table_text is not None:
            self._flush_table()
        if self._foreign() and not self._html_point(tag=name):
            self._foreign_start(name, attrs, closing)
            return
        self._start_in(self.mode, name, attrs, closing)

    def _start_in(self, mode: str, name: str, attrs: dict, closing: bool) -> None:
        getattr(self, "_s_" + mode)(name, attrs, closing)

    def _s_initial(self, name: str, attrs: dict, closing: bool) -> None:
        self._leave_initial()
        self._start(name, attrs, closing)

    def _s_before_html(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "html":
            self._ensure_html(attrs)
            return
        self._ensure_html()
        self._start(name, attrs, closing)

    def _s_before_head(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "html":
            self._s_in_body(name, attrs, closing)
        elif name == "head":
            self._ensure_head(attrs)
        else:
            self._ensure_head()
            self._start(name, attrs, closing)

    def _s_in_head(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "html":
            self._s_in_body(name, attrs, closing)
        elif name in ("base", "basefont", "bgsound", "link", "meta"):
            self._void(name, attrs)
        elif name in T.RCDATA and name == "title":
            self._raw(name, attrs)
        elif name in ("noframes", "style", "script") or (name == "noscript" and self.scripting):
            self._raw(name, attrs)
        elif name == "noscript":
            self._insert(name, attrs)
            self.mode = "in_head_noscript"
        elif name == "template":
            self._insert(name, attrs)
            self.active.append(None)
            self.frameset_ok = False
            self.mode = "in_template"
            self.templates.append("in_template")
        elif name != "head":
            self._leave_head()
            self._start(name, attrs, closing)

    def _raw(self, name: str, attrs: dict) -> None:
        self._insert(name, attrs)
        self.raw = name

    def _s_in_head_noscript(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "html":
            self._s_in_body(name, attrs, closing)
        elif name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            self._s_in_head(name, attrs, closing)
        elif name not in ("head", "noscript"):
            self.open.pop()
            self.mode = "in_head"
            self._start(name, attrs, closing)

    def _s_after_head(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "html":
            self._s_in_body(name, attrs, closing)
        elif name == "body":
            self._insert(name, attrs)
            self.frameset_ok = False
            self.mode = "in_body"
        elif name == "frameset":
            self._insert(name, attrs)
            self.mode = "in_frameset"
        elif name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.open.append(self.head)
            self._s_in_head(name, attrs, closing)
            self.open = [x for x in self.open if x is not self.head]
        elif name != "head":
            self._ensure_body()
            self._start(name, attrs, closing)

    def _merge(self, node: Node, attrs: dict) -> None:
        for k, v in attrs.items():
            node.attrs.setdefault(k, v)

    def _s_in_body(self, name: str, attrs: dict, closing: bool) -> None:
        if name in T.FORMATTING:
            self._formatting(name, attrs)
        elif name in T.CLOSES_P:
            self._close_p()
            self._insert(name, attrs)
        elif name in ("span", "sub", "sup", "label", "abbr", "cite"):
            self._reconstruct()
            self._insert(name, attrs)
        elif name == "html":
            if self._last("template") < 0:
                self._merge(self.open[0], attrs)
        elif name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self._s_in_head(name, attrs, closing)
        elif name == "body":
            if len(self.open) > 1 and self.open[1].name == "body" and self._last("template") < 0:
                self.frameset_ok = False
                self._merge(self.open[1], attrs)
        elif name == "frameset":
            if len(self.open) > 1 and self.open[1].name == "body" and self.frameset_ok and _replaceable(self.open[1]):
                self.open[1].detach()
                del self.open[1:]
                self._insert(name, attrs)
                self.mode = "in_frameset"
        elif name in T.HEADINGS:
            self._close_p()
            if self.open[-1].ns == "html" and self.open[-1].name in T.HEADINGS:
                self.open.pop()
            self._insert(name, attrs)
        elif name in ("pre", "listing"):
            self._close_p()
            self._insert(name, attrs)
            self.skip_lf, self.frameset_ok = True, False
        elif name == "form":
            if self.form is not None and self._last("template") < 0:
                return
            self._close_p()
            node = self._insert(name, attrs)
            if self._last("template") < 0:
                self.form = node
        elif name in ("li", "dd", "dt"):
            self.frameset_ok = False
            same = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.ns == "html" and node.name in same:
                    self._implied(node.name)
                    self._pop_to(node.name)
                    break
                if self._special(node) and not (node.ns == "html" and node.name in ("address", "div", "p")):
                    break
            self._close_p()
            self._insert(name, attrs)
        elif name == "plaintext":
            self._close_p()
            self._insert(name, attrs)
            self.raw = "plaintext"
        elif name == "button":
            if self._in_scope("button"):
                self._implied()
                self._pop_to("button")
            self._reconstruct()
            self._insert(name, attrs)
            self.frameset_ok = False
        elif name in ("applet", "marquee", "object"):
            self._reconstruct()
            self._insert(name, attrs)
            self.active.append(None)
            self.frameset_ok = False
        elif name == "table":
            if self.quirks != "quirks":
                self._close_p()
            self._insert(name, attrs)
            self.frameset_ok = False
            self.mode = "in_table"
        elif name in ("area", "br", "embed", "img", "keygen", "wbr", "image"):
            self._reconstruct()
            self._void("img" if name == "image" else name, attrs)
            self.frameset_ok = False
        elif name == "input":
            if self.fragment is not None and self.context.name == "select" and self.context.ns == "html":
                return
            if self._in_scope("select"):
                self._pop_to("select")
            self._reconstruct()
            self._void(name, attrs)
            if lower(attrs.get("type", "")) != "hidden":
                self.frameset_ok = False
        elif name in ("param", "source", "track"):
            self._void(name, attrs)
        elif name == "hr":
            self._close_p()
            if self._in_scope("select"):
                self._implied()
            self._void(name, attrs)
            self.frameset_ok = False
        elif name == "textarea":
            self._insert(name, attrs)
            self.raw, self.skip_lf, self.frameset_ok = name, True, False
        elif name == "xmp":
            self._close_p()
            self._reconstruct()
            self.frameset_ok = False
            self._raw(name, attrs)
        elif name == "iframe":
            self.frameset_ok = False
            self._raw(name, attrs)
        elif name == "noembed" or (name == "noscript" and self.scripting):
            self._raw(name, attrs)
        elif name == "select":
            if self.fragment is not None and self.context.name == "select" and self.context.ns == "html":
                return
            if self._in_scope("select"):
                self._pop_to("select")
                return
            self._reconstruct()
            self._insert(name, attrs)
            self.frameset_ok = False
        elif name in ("option", "optgroup"):
            if self._in_scope("select"):
                self._implied("optgroup" if name == "option" else None)
            elif self.open[-1].name == "option" and self.open[-1].ns == "html":
                self.open.pop()
            self._reconstruct()
            self._insert(name, attrs)
        elif name in ("rb", "rtc"):
            if self._in_scope("ruby"):
                self._implied()
            self._insert(name, attrs)
        elif name in ("rp", "rt"):
            if self._in_scope("ruby"):
                self._implied("rtc")
            self._insert(name, attrs)
        elif name in ("math", "svg"):
            self._reconstruct()
            self._insert(name, self._foreign_attrs(name, attrs), name)
            if closing:
                self.open.pop().self_closing = True
        elif name in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return
        else:
            self._reconstruct()
            self._insert(name, attrs)

    def _formatting(self, name: str, attrs: dict) -> None:
        if name == "a":
            for node in reversed(self.active):
                if node is None:
                    break
                if node.name == "a":
                    self._adopt("a")
                    self.active = [x for x in self.active if x is not node]
                    self.open = [x for x in self.open if x is not node]
                    break
        self._reconstruct()
        if name == "nobr" and self._in_scope("nobr"):
            self._adopt("nobr")
            self._reconstruct()
        self._push_active(self._insert(name, attrs))

    def _special(self, node: Node) -> bool:
        if node.ns == "html":
            return node.name in T.SPECIAL
        if node.ns == "math":
            return node.name in T.MATH_TEXT or node.name == "annotation-xml"
        return node.name in T.SVG_HTML

    def _s_in_table(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "caption":
            self._clear_to("table")
            self.active.append(None)
            self._insert(name, attrs)
            self.mode = "in_caption"
        elif name == "colgroup":
            self._clear_to("table")
            self._insert(name, attrs)
            self.mode = "in_column_group"
        elif name == "col":
            self._clear_to("table")
            self._insert("colgroup", {})
            self.mode = "in_column_group"
            self._start(name, attrs, closing)
        elif name in ("tbody", "tfoot", "thead"):
            self._clear_to("table")
            self._insert(name, attrs)
            self.mode = "in_table_body"
        elif name in ("td", "th", "tr"):
            self._clear_to("table")
            self._insert("tbody", {})
            self.mode = "in_table_body"
            self._start(name, attrs, closing)
        elif name == "table":
            if self._in_table_scope("table"):
                self._pop_to("table")
                self._reset_mode()
                self._start(name, attrs, closing)
        elif name in ("style", "script", "template"):
            self._s_in_head(name, attrs, closing)
        elif name == "input" and lower(attrs.get("type", "")) == "hidden":
            self._void(name, attrs)
        elif name == "form":
            if self._last("template") >= 0:
                self._void(name, attrs)
            elif self.form is None:
                self.form = self._void(name, attrs)
        else:
            self.foster = True
            self._s_in_body(name, attrs, closing)
            self.foster = False

    def _s_in_caption(self, name: str, attrs: dict, closing: bool) -> None:
        if name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if self._end_caption():
                self._start(name, attrs, closing)
        else:
            self._s_in_body(name, attrs, closing)

    def _end_caption(self) -> bool:
        if not self._in_table_scope("caption"):
            return False
        self._implied()
        self._pop_to("caption")
        self._clear_active()
        self.mode = "in_table"
        return True

    def _s_in_column_group(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "html":
            self._s_in_body(name, attrs, closing)
        elif name == "col":
            self._void(name, attrs)
        elif name == "template":
            self._s_in_head(name, attrs, closing)
        elif self.open[-1].name == "colgroup" and self.open[-1].ns == "html":
            self.open.pop()
            self.mode = "in_table"
            self._start(name, attrs, closing)

    def _s_in_table_body(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "tr":
            self._clear_to("tbody", "tfoot", "thead")
            self._insert(name, attrs)
            self.mode = "in_row"
        elif name in ("td", "th"):
            self._clear_to("tbody", "tfoot", "thead")
            self._insert("tr", {})
            self.mode = "in_row"
            self._start(name, attrs, closing)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
            if self._in_table_scope("tbody", "tfoot", "thead"):
                self._clear_to("tbody", "tfoot", "thead")
                self.open.pop()
                self.mode = "in_table"
                self._start(name, attrs, closing)
        else:
            self._s_in_table(name, attrs, closing)

    def _end_row(self) -> bool:
        if not self._in_table_scope("tr"):
            return False
        self._clear_to("tr")
        node = self.open.pop()
        if self._ending == "tr":
            node.end_span = self.span
        self.mode = "in_table_body"
        return True

    def _s_in_row(self, name: str, attrs: dict, closing: bool) -> None:
        if name in ("td", "th"):
            self._clear_to("tr")
            self._insert(name, attrs)
            self.mode = "in_cell"
            self.active.append(None)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            if self._end_row():
                self._start(name, attrs, closing)
        else:
            self._s_in_table(name, attrs, closing)

    def _close_cell(self) -> None:
        self._implied()
        self._pop_to("td", "th")
        self._clear_active()
        self.mode = "in_row"

    def _s_in_cell(self, name: str, attrs: dict, closing: bool) -> None:
        if name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if self._in_table_scope("td", "th"):
                self._close_cell()
                self._start(name, attrs, closing)
        else:
            self._s_in_body(name, attrs, closing)

    def _s_in_template(self, name: str, attrs: dict, closing: bool) -> None:
        if name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            if name in ("base", "basefont", "bgsound", "noframes", "title"):
                self.templates[-1] = self.mode = "in_body"
            self._s_in_head(name, attrs, closing)
            return
        if name in ("caption", "colgroup", "tbody", "tfoot", "thead"):
            mode = "in_table"
        elif name == "col":
            mode = "in_column_group"
        elif name == "tr":
            mode = "in_table_body"
        elif name in ("td", "th"):
            mode = "in_row"
        else:
            mode = "in_body"
        self.templates[-1] = mode
        self.mode = mode
        self._start(name, attrs, closing)

    def _s_after_body(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "html":
            self._s_in_body(name, attrs, closing)
        else:
            self.mode = "in_body"
            self._start(name, attrs, closing)

    _s_after_after_body = _s_after_body

    def _s_in_frameset(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "html":
            self._s_in_body(name, attrs, closing)
        elif name == "frameset":
            self._insert(name, attrs)
        elif name == "frame":
            self._void(name, attrs)
        elif name == "noframes":
            self._s_in_head(name, attrs, closing)

    def _s_after_frameset(self, name: str, attrs: dict, closing: bool) -> None:
        if name == "html":
            self._s_in_body(name, attrs, closing)
        elif name == "noframes":
            self._s_in_head(name, attrs, closing)

    _s_after_after_frameset = _s_after_frameset

    # Foreign content.

    def _foreign_attrs(self, ns: str, attrs: dict) -> dict:
        out = {}
        for k, v in attrs.items():
            if ns == "math" and k == "definitionurl":
                k = "definitionURL"
            elif ns == "svg":
                k = T.SVG_ATTRS.get(k, k)
            out[T.FOREIGN_ATTRS.get(k, k)] = v
        return out

    def _foreign_start(self, name: str, attrs: dict, closing: bool) -> None:
        if name in T.FOREIGN_BREAKOUT or (name == "font" and any(k in attrs for k in ("color", "face", "size"))):
            while len(self.open) > 1 and not (self.open[-1].ns == "html" or self._html_integration(self.open[-1])):
                self.open.pop()
            if self.fragment is not None and len(self.open) == 1 and self.context.ns != "html":
                self._start_in(self.mode, name, attrs, closing)
            else:
                self._start(name, attrs, closing)
            return
        ns = self._current().ns
        if ns == "svg":
            name = T.SVG_TAGS.get(name, name)
        self._insert(name, self._foreign_attrs(ns, attrs), ns)
        if closing:
            self.open.pop().self_closing = True

    @staticmethod
    def _html_integration(node: Node) -> bool:
        if node.ns == "math":
            return node.name in T.MATH_TEXT or (node.name == "annotation-xml" and lower(node.attrs.get("encoding") or "") in ("text/html", "application/xhtml+xml"))
        return node.ns == "svg" and node.name in T.SVG_HTML

    # End tags.

    def _end(self, name: str) -> None:
        if self.table_text is not None:
            self._flush_table()
        self._ending = name
        if self._foreign() and len(self.open) > 1:
            self._foreign_end(name)
        elif self.open and self.open[-1].ns == "html" and self.open[-1].name == name and name in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript") and self.mode not in ("in_head_noscript",):
            self.open.pop().end_span = self.span
            if name == "script":
                pass
        else:
            self._end_in(self.mode, name)
        self._ending = None

    def _end_in(self, mode: str, name: str) -> None:
        getattr(self, "_e_" + mode)(name)

    def _foreign_end(self, name: str) -> None:
        if name in ("br", "p"):
            while len(self.open) > 1 and not (self.open[-1].ns == "html" or self._html_integration(self.open[-1])):
                self.open.pop()
            self._end_in(self.mode, name)
            return
        for i in range(len(self.open) - 1, 0, -1):
            node = self.open[i]
            if node.ns == "html":
                self._end_in(self.mode, name)
                return
            if lower(node.name) == name:
                node.end_span = self.span
                del self.open[i:]
                return

    def _e_initial(self, name: str) -> None:
        if name in ("head", "body", "html", "br"):
            self._leave_initial()
            self._end(name)
        elif self.mode == "initial":
            self._leave_initial()
            self._end(name)

    def _e_before_html(self, name: str) -> None:
        if name in ("head", "body", "html", "br"):
            self._ensure_html()
            self._end(name)

    def _e_before_head(self, name: str) -> None:
        if name in ("head", "body", "html", "br"):
            self._ensure_head()
            self._end(name)

    def _e_in_head(self, name: str) -> None:
        if name == "head":
            self._leave_head()
        elif name in ("body", "html", "br"):
            self._leave_head()
            self._end(name)
        elif name == "template":
            self._end_template()

    def _end_template(self) -> None:
        if self._last("template") >= 0:
            self._implied_thoroughly()
            self._pop_to("template")
            self._clear_active()
            self.templates.pop()
            self._reset_mode()

    def _e_in_head_noscript(self, name: str) -> None:
        if name == "noscript":
            self.open.pop()
            self.mode = "in_head"
        elif name == "br":
            self.open.pop()
            self.mode = "in_head"
            self._end(name)

    def _e_after_head(self, name: str) -> None:
        if name == "template":
            self._end_template()
        elif name in ("body", "html", "br"):
            self._ensure_body()
            self._end(name)

    def _e_in_body(self, name: str) -> None:
        if name in T.FORMATTING:
            self._adopt(name)
        elif name == "p":
            if not self._in_scope("p", self._BUTTON):
                self._insert("p", {})
            self._implied("p")
            self._pop_to("p")
        elif name in T.BLOCK_END:
            if self._in_scope(name):
                self._implied()
                self._pop_to(name)
        elif name in ("body", "html"):
            if self._in_scope("body"):
                self.mode = "after_body"
                self.open[1].end_span = self.span
                if name == "html":
                    self._end(name)
        elif name == "template":
            self._end_template()
        elif name == "form":
            if self._last("template") < 0:
                node, self.form = self.form, None
                if node is not None and self._node_in_scope(node):
                    self._implied()
                    node.end_span = self.span
                    self.open = [x for x in self.open if x is not node]
            elif self._in_scope("form"):
                self._implied()
                self._pop_to("form")
        elif name == "li":
            if self._in_scope("li", self._LIST):
                self._implied("li")
                self._pop_to("li")
        elif name in ("dd", "dt"):
            if self._in_scope(name):
                self._implied(name)
                self._pop_to(name)
        elif name in T.HEADINGS:
            if self._in_scope(T.HEADINGS):
                self._implied()
                self._pop_to(*T.HEADINGS)
        elif name in ("applet", "marquee", "object"):
            if self._in_scope(name):
                self._implied()
                self._pop_to(name)
                self._clear_active()
        elif name == "br":
            self._reconstruct()
            self._void("br", {})
            self.frameset_ok = False
        else:
            self._any_end(name)

    def _any_end(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node = self.open[i]
            if node.ns == "html" and node.name == name:
                self._implied(name)
                node.end_span = self.span
                del self.open[i:]
                return
            if self._special(node):
                return

    def _adopt(self, subject: str) -> None:
        """The adoption agency: close a formatting element across blocks that were opened inside it."""
        current = self.open[-1]
        if current.ns == "html" and current.name == subject and not any(current is x for x in self.active):
            self.open.pop().end_span = self.span
            return
        for _ in range(8):
            node = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.name == subject:
                    node = x
                    break
            if node is None:
                self._any_end(subject)
                return
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i] is node), -1)
            if at < 0:
                self.active = [x for x in self.active if x is not node]
                return
            if not self._node_in_scope(node):
                return
            node.end_span = node.end_span or self.span
            block = next((i for i in range(at + 1, len(self.open)) if self._special(self.open[i]) and self.open[i].name != "dialog"), -1)
            if block < 0:
                del self.open[at:]
                self.active = [x for x in self.active if x is not node]
                return
            furthest, ancestor = self.open[block], self.open[at - 1]
            bookmark = next(i for i, x in enumerate(self.active) if x is node)
            last, place, count = furthest, block, 0
            while True:
                count += 1
                place -= 1
                x = self.open[place]
                if x is node:
                    break
                index = next((i for i, y in enumerate(self.active) if y is x), -1)
                if count > 3 and index >= 0:
                    del self.active[index]
                    if index < bookmark:
                        bookmark -= 1
                    index = -1
                if index < 0:
                    del self.open[place]
                    continue
                new = self._element(x.name, dict(x.attrs))
                new.span = x.span
                self.active[index] = self.open[place] = new
                if last is furthest:
                    bookmark = index + 1
                last.detach()
                self._put(new, None, last)
                last = new
            last.detach()
            kept, self.foster = self.foster, True
            parent, before = self._place(ancestor)
            self.foster = kept
            self._put(parent, before, last)
            new = self._element(node.name, dict(node.attrs))
            new.span = node.span
            for child in list(furthest.children):
                child.parent = new
            new.children, furthest.children = furthest.children, []
            self._put(furthest, None, new)
            old = next(i for i, x in enumerate(self.active) if x is node)
            self.active[bookmark:bookmark] = [new]
            del self.active[old if old < bookmark else old + 1]
            self.open = [x for x in self.open if x is not node]
            at = next(i for i, x in enumerate(self.open) if x is furthest)
            self.open.insert(at + 1, new)

    def _e_in_table(self, name: str) -> None:
        if name == "table":
            if self._in_table_scope("table"):
                self._pop_to("table")
                self._reset_mode()
        elif name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return
        elif name == "template":
            self._end_template()
        else:
            self.foster = True
            self._e_in_body(name)
            self.foster = False

    def _e_in_caption(self, name: str) -> None:
        if name == "caption":
            self._end_caption()
        elif name == "table":
            if self._end_caption():
                self._end(name)
        elif name not in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self._e_in_body(name)

    def _e_in_column_group(self, name: str) -> None:
        group = self.open[-1].name == "colgroup" and self.open[-1].ns == "html"
        if name == "colgroup":
            if group:
                self.open.pop().end_span = self.span
                self.mode = "in_table"
        elif name == "template":
            self._end_template()
        elif name != "col" and group:
            self.open.pop()
            self.mode = "in_table"
            self._end(name)

    def _e_in_table_body(self, name: str) -> None:
        if name in ("tbody", "tfoot", "thead"):
            if self._in_table_scope(name):
                self._clear_to("tbody", "tfoot", "thead")
                self.open.pop().end_span = self.span
                self.mode = "in_table"
        elif name == "table":
            if self._in_table_scope("tbody", "tfoot", "thead"):
                self._clear_to("tbody", "tfoot", "thead")
                self.open.pop()
                self.mode = "in_table"
                self._end(name)
        elif name not in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            self._e_in_table(name)

    def _e_in_row(self, name: str) -> None:
        if name == "tr":
            self._end_row()
        elif name == "table":
            if self._end_row():
                self._end(name)
        elif name in ("tbody", "tfoot", "thead"):
            if self._in_table_scope(name) and self._end_row():
                self._end(name)
        elif name not in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            self._e_in_table(name)

    def _e_in_cell(self, name: str) -> None:
        if name in ("td", "th"):
            if self._in_table_scope(name):
                self._implied()
                self._pop_to(name)
                self._clear_active()
                self.mode = "in_row"
        elif name in ("body", "caption", "col", "colgroup", "html"):
            return
        elif name in ("table", "tbody", "tfoot", "thead", "tr"):
            if self._in_table_scope(name):
                self._close_cell()
                self._end(name)
        else:
            self._e_in_body(name)

    def _e_in_template(self, name: str) -> None:
        if name == "template":
            self._end_template()

    def _e_after_body(self, name: str) -> None:
        if name == "html":
            if self.fragment is None:
                self.mode = "after_after_body"
                self.open[0].end_span = self.span
        else:
            self.mode = "in_body"
            self._end(name)

    def _e_after_after_body(self, name: str) -> None:
        self.mode = "in_body"
        self._end(name)

    def _e_in_frameset(self, name: str) -> None:
        if name == "frameset" and len(self.open) > 1:
            self.open.pop().end_span = self.span
            if self.fragment is None and self.open[-1].name != "frameset":
                self.mode = "after_frameset"

    def _e_after_frameset(self, name: str) -> None:
        if name == "html":
            self.mode = "after_after_frameset"

    def _e_after_after_frameset(self, name: str) -> None:
        return

    # End of the input.

    def _finish(self) -> None:
        self._flush_table()
        self.raw = None
        if self.fragment is None:
            if self.mode == "initial":
                self._leave_initial()
            if self.mode == "before_html":
                self._ensure_html()
            if self.mode == "before_head":
                self._ensure_head()
            if self.mode == "in_head_noscript":
                self.open.pop()
                self.mode = "in_head"
            if self.mode == "in_head" or (self.head is not None and self.open and self.open[-1] is self.head):
                self._leave_head()
            while self.templates:
                at = self._last("template")
                if at < 0:
                    break
                del self.open[at:]
                self._clear_active()
                self.templates.pop()
                self._reset_mode()
            if self.mode == "in_head":
                self._leave_head()
            html = next((c for c in self.document.children if c.ns == "html"), None)
            if html is not None and self.mode == "after_head" and not any(c.name in ("body", "frameset") for c in html.children):
                del self.open[1:]
                self._ensure_body()
        else:
            for child in self.root.children:
                child.parent = self.document
            self.document.children, self.root.children = self.root.children, []
        if self.has_selectedcontent:
            self._fill_selectedcontent()

    def _fill_selectedcontent(self) -> None:
        """Copies of the chosen option's children go into each selectedcontent of a select; together no larger than the source."""
        room = self.n
        for select in [x for x in self.document.descendants() if x.name == "select"]:
            markers, options, pending = [], [], [(select, False, False)]
            while pending:
                node, disabled, datalist = pending.pop()
                if node is not select:
                    if node.name == "selectedcontent":
                        markers.append(node)
                    elif node.name == "option" and not datalist:
                        options.append((node, disabled or "disabled" in node.attrs))
                disabled |= node.name == "optgroup" and "disabled" in node.attrs
                pending += [(c, disabled, datalist or node.name == "datalist") for c in reversed(node.children)]
            selected = [o for o, _ in options if "selected" in o.attrs]
            free = [o for o, off in options if not off]
            chosen = (selected[0 if "multiple" in select.attrs else -1] if selected else None) or (free[0] if free else None)
            for marker in markers:
                up = marker
                while up is not None and up is not chosen:
                    up = up.parent
                if up is not None and chosen is not None:
                    continue
                for c in marker.children:
                    c.parent = None
                marker.children.clear()
                if chosen is not None:
                    size = sum(1 for _ in chosen.descendants())
                    if size <= room:
                        room -= size
                        for c in chosen.children:
                            copy = c.clone_node(deep=True)
                            copy.parent = marker
                            marker.children.append(copy)


def _replaceable(body: Node) -> bool:
    """Whether a frameset may take the place of a body: it holds only plain containers, formatting, foreign elements and blank text."""
    pending = [(c, True) for c in body.children]
    while pending:
        node, plain = pending.pop()
        if node.name == "#text":
            if (node.data or "").strip(WS if plain else WS + "\ufffd"):
                return False
        elif node.ns == "html" and plain and node.name not in T.FRAMESET_BODY and not (node.name == "input" and lower(node.attrs.get("type") or "") == "hidden"):
            return False
        pending += [(c, plain and node.ns == "html") for c in node.children]
    return True


def parse(html: str | None, *, fragment: bool = False, context: FragmentContext | None = None, scripting: bool = True, iframe_srcdoc: bool = False, xml_coercion: bool = False, discard_bom: bool = True, track: bool = False, literal: bool = False) -> Node:
    """The tree of a document, or of a fragment (by default as if inside a div). None is the empty document."""
    html = html or ""
    if discard_bom and html[:1] == "\ufeff":
        html = html[1:]
    if fragment and context is None:
        context = FragmentContext("div")
    return Parser(html, fragment=context, scripting=scripting, iframe_srcdoc=iframe_srcdoc, xml_coercion=xml_coercion, track=track, literal=literal).parse()
