"""URL and inline style cleaning by rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote, urlsplit

from .entities import unescape
from .text import escape_js_string, escape_url_value, strip_invisible

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_BLANK = re.compile(r"[\x00-\x20\x7f]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*\Z")


@dataclass(frozen=True)
class UrlProxy:
    """Where proxied URLs are sent: ``url?param=<value>``."""

    url: str
    param: str = "url"

    def __post_init__(self) -> None:
        parts = urlsplit(self.url)
        if parts.fragment:
            raise ValueError("a proxy url has no fragment")
        if any(k == self.param for k, _ in parse_qsl(parts.query, keep_blank_values=True)):
            raise ValueError("a proxy url doesn't hold the parameter already")
        if clean_url(self.url, UrlRule(allowed_schemes=("http", "https"), resolve_protocol_relative=None), handling="allow", allow_relative=True) is None:
            raise ValueError("a proxy url is relative, http or https")

    def of(self, value: str) -> str:
        return f"{self.url}{'&' if '?' in self.url else '?'}{quote(self.param, safe='')}={quote(value, safe='')}"


@dataclass(frozen=True)
class UrlRule:
    allowed_schemes: tuple[str, ...] = ()
    allow_relative: bool | None = None
    allow_fragment: bool = True
    resolve_protocol_relative: str | None = "https"
    allowed_hosts: frozenset[str] | None = None
    handling: str | None = None
    proxy: UrlProxy | None = None

    def __post_init__(self) -> None:
        if isinstance(self.allowed_schemes, str) or isinstance(self.allowed_hosts, str):
            raise TypeError("schemes and hosts are collections")
        object.__setattr__(self, "allowed_schemes", tuple(s.lower() for s in self.allowed_schemes))
        if self.allowed_hosts is not None:
            object.__setattr__(self, "allowed_hosts", frozenset(h.lower() for h in self.allowed_hosts))
        if self.handling not in (None, "allow", "strip", "proxy"):
            raise ValueError("handling is allow, strip or proxy")


@dataclass(frozen=True)
class UrlPolicy:
    default_handling: str = "strip"
    default_allow_relative: bool = True
    allow_rules: Mapping[tuple[str, str], UrlRule] = field(default_factory=dict)
    url_filter: Callable[[str, str, str], str | None] | None = None
    proxy: UrlProxy | None = None

    def rule(self, tag: str, attr: str) -> UrlRule | None:
        return self.allow_rules.get((tag, attr)) or self.allow_rules.get(("*", attr))


def scheme_prefix(url: str) -> str | None:
    """What stands before a colon that no ``/``, ``?`` or ``#`` precedes."""
    m = re.match(r"([^:/?#]+):", url)
    return m[1] if m else None


def scheme_of(url: str) -> str | None:
    prefix = scheme_prefix(url)
    return prefix.lower() if prefix and _SCHEME.match(prefix) else None


def _odd_ipv4(host: str) -> bool:
    """Whether all labels read as numbers, but not as four plain decimal bytes."""
    labels = host.split(".")
    number = lambda s: bool(re.fullmatch(r"0[xX][0-9a-fA-F]+", s)) or s.isdecimal()
    if len(labels) > 4 or not all(map(number, labels)):
        return False
    plain = lambda s: s.isascii() and s.isdecimal() and len(s) <= 3 and (s == "0" or s[0] != "0") and int(s) <= 255
    return not (len(labels) == 4 and all(map(plain, labels)))


def host_allowed(url: str, hosts: frozenset[str]) -> bool:
    try:
        parts = urlsplit(url)
        parts.port  # noqa: B018
    except ValueError:
        return False
    place = parts.netloc
    if _BLANK.search(place):
        return False
    raw = place.rpartition("@")[2]
    raw = raw[1 : raw.find("]")] if raw.startswith("[") else raw.rpartition(":")[0] if ":" in raw else raw
    if not raw or "%" in raw or not raw.isascii() or (":" not in raw and _odd_ipv4(raw)):
        return False
    return (parts.hostname or "").lower() in hosts


def clean_url(value: str, rule: UrlRule, *, handling: str = "allow", allow_relative: bool = True, proxy: UrlProxy | None = None) -> str | None:
    """The URL as the rule lets it through, or None."""
    shown = strip_invisible(value).strip()
    if _CONTROL.search(shown):
        return None
    bare = _BLANK.sub("", shown)
    if not bare or "\\" in bare:
        return None
    through = lambda url: url if handling == "allow" else proxy.of(url) if handling == "proxy" and proxy else None
    if bare[0] == "#":
        return through(shown) if rule.allow_fragment else None
    if handling == "proxy" and scheme_prefix(bare) is not None and scheme_of(bare) is None:
        return None
    if bare.startswith("//"):
        scheme = (rule.resolve_protocol_relative or "").lower()
        if not scheme or scheme not in rule.allowed_schemes:
            return None
        if rule.allowed_hosts is not None and not host_allowed(f"{scheme}:{shown}", rule.allowed_hosts):
            return None
        return through(f"{scheme}:{bare}")
    scheme = scheme_of(bare)
    if scheme is None:
        return through(shown) if allow_relative else None
    if scheme not in rule.allowed_schemes:
        return None
    if scheme in ("http", "https") and not bare.startswith(scheme + "://"):
        return through(shown) if rule.allowed_hosts is None and allow_relative else None
    if rule.allowed_hosts is not None and not host_allowed(shown, rule.allowed_hosts):
        return None
    return through(shown)


def apply_rule(value: str, rule: UrlRule, policy: UrlPolicy) -> str | None:
    return clean_url(
        value, rule, handling=rule.handling or policy.default_handling, proxy=rule.proxy or policy.proxy,
        allow_relative=policy.default_allow_relative if rule.allow_relative is None else rule.allow_relative,
    )


# Attributes that hold URLs, by the form of their value; and the guarded ones.
SINKS = {
    "url": "href icon dynsrc lowsrc src poster action formaction data cite background classid code codebase longdesc manifest object usemap",
    "srcset": "srcset imagesrcset",
    "space_list": "ping attributionsrc",
    "comma_or_space_list": "profile archive",
}
GUARDED = {
    ("meta", "content"): ("meta_refresh", "http-equiv", frozenset({"refresh"})),
    ("param", "value"): ("url", "name", frozenset("code codebase data filename href movie src url".split())),
}
SINK_OF = {a: kind for kind, attrs in SINKS.items() for a in attrs.split()}


def sink_kind(tag: str, attr: str, attrs: Mapping[str, str | None]) -> str | None:
    if attr in SINK_OF:
        return SINK_OF[attr]
    if (tag, attr) in GUARDED:
        kind, guard, values = GUARDED[tag, attr]
        for k, v in attrs.items():
            if k.lower() == guard:
                return kind if v is not None and v.strip().lower() in values else None
    return None


def _descriptor(text: str) -> str | None:
    if not text:
        return ""
    token = text.lower()
    if re.fullmatch(r"\d+[wh]", token) and token[:-1].strip("0"):
        return token
    if re.fullmatch(r"(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)x", token) and float(token[:-1]) > 0:
        return token
    return None


def clean_sink(value: str, tag: str, attr: str, kind: str, policy: UrlPolicy) -> str | None:
    """An attribute value of a URL sink, cleaned; None if it goes. One bad URL rejects a whole list."""
    rule = policy.rule(tag, attr)
    if rule is None:
        return None
    if kind == "meta_refresh":
        m = re.match(r"([^;]*);\s*url\s*=\s*(.*)\Z", value, re.I | re.S)
        if not m:
            return None
        target = m[2].strip()
        if target[:1] in ("'", '"') and target:
            target = target[1:].split(target[0], 1)[0]
        if not target or re.search("[,;]", target):
            return None
        done = clean_sink(target, tag, attr, "url", policy)
        return None if done is None else f"{m[1].strip()};url={done}"
    if policy.url_filter is not None:
        value = policy.url_filter(tag, attr, value)
        if value is None:
            return None
        value = strip_invisible(value)
    if kind == "url":
        return apply_rule(value, rule, policy)
    out: list[str] = []
    if kind == "srcset":
        for candidate in filter(None, (c.strip() for c in value.split(","))):
            url, *rest = candidate.split(None, 1)
            done, size = apply_rule(url, rule, policy), _descriptor(rest[0].strip() if rest else "")
            if done is None or size is None:
                return None
            out.append(f"{done} {size}".strip())
        return ", ".join(out) or None
    for token in value.split() if kind == "space_list" else filter(None, re.split(r"[\s,]+", value.strip())):
        done = apply_rule(token, rule, policy)
        if done is None:
            return None
        out.append(done)
    return " ".join(out) or None


def clean_url_value(value: str, rule: UrlRule, policy: UrlPolicy | None = None) -> str | None:
    """A URL from outside any tree: references decoded, checked by the rule, percent-encoded."""
    done = apply_rule(strip_invisible(unescape(value, True)), rule, policy or UrlPolicy(default_handling="allow"))
    return None if done is None else escape_url_value(done)


def clean_url_in_js_string(value: str, rule: UrlRule, policy: UrlPolicy | None = None, quote_char: str = '"') -> str | None:
    done = clean_url_value(value, rule, policy)
    return None if done is None else escape_js_string(done, quote_char)


# What may load something, or take effect from outside a declaration.
CSS_BLOCKED = (
    "@import", "var(", ":inherit", ":revert", ":unset", "src(", "image(", "image-set(", "expression(", "progid:", "alphaimageloader",
    "behavior:", "-moz-binding",
)
CSS_AMBIENT = frozenset({"inherit", "revert", "revert-layer", "unset"})
_CSS_URL = re.compile(r"url\([\x00-\x20]*(?:\"([^\"]*)\"[\x00-\x20]*|'([^']*)'[\x00-\x20]*|([^)]*))\)", re.I)


def css_loads(value: str, allow_url: bool = False) -> bool:
    """Whether a CSS value may load a resource; spaces, controls and comments don't hide anything."""
    if "\\" in value:
        return True
    bare = re.sub(r"/\*.*?\*/", "", value, flags=re.S)
    if "/*" in bare:
        return True
    bare = re.sub(r"[\x00-\x20\x7f]", "", bare).lower()
    if bare.removesuffix("!important") in CSS_AMBIENT or any(t in bare for t in CSS_BLOCKED):
        return True
    return not allow_url and "url(" in bare


def clean_css_urls(value: str, tag: str, prop: str, policy: UrlPolicy) -> str | None:
    rule = policy.rule(tag, f"style:{prop}")
    if rule is None or "\\" in value or "/*" in value:
        return None
    out, at = [], 0
    for begin in re.finditer(r"url\(", value, re.I):
        if begin.start() < at:
            continue
        m = _CSS_URL.match(value, begin.start())
        if not m:
            return None
        url = m[1] if m[1] is not None else m[2] if m[2] is not None else m[3].strip()
        if m[3] is not None and (not url or url[0] in "\"'" or _BLANK.search(url)):
            return None
        after = value[m.end() : m.end() + 1]
        if after and not (ord(after) <= 0x20 or after in ",/"):
            return None
        if policy.url_filter is not None:
            url = policy.url_filter(tag, f"style:{prop}", url)
        done = None if url is None else apply_rule(url, rule, policy)
        if done is None or _BLANK.search(done) or any(c in "'\"()\\" for c in done):
            return None
        out += [value[at : begin.start()], f"url('{done}')"]
        at = m.end()
    return "".join(out) + value[at:] if out else None


def clean_style(value: str | None, allowed: frozenset[str], tag: str = "*", policy: UrlPolicy | None = None) -> str | None:
    """Declarations of allowed properties whose values load nothing, or only what the policy lets through."""
    out = []
    for declaration in (value or "").split(";"):
        prop, colon, body = declaration.strip().partition(":")
        prop, body = prop.strip().lower(), body.strip()
        if not colon or not re.fullmatch(r"[a-z0-9-]+", prop) or prop not in allowed or not body or body.lower() in CSS_AMBIENT:
            continue
        if css_loads(body):
            body = clean_css_urls(body, tag.lower(), prop, policy) if policy is not None and not css_loads(body, True) else None
        if body is not None:
            out.append(f"{prop}: {body}")
    return "; ".join(out) or None
