"""Sanitization policies."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from .urls import UrlPolicy, UrlRule


class UnsafeHtmlError(ValueError):
    pass


@dataclass(frozen=True)
class SanitizationPolicy:
    """What stays. ``unsafe_handling``: strip (silently), collect (as errors), raise. ``disallowed_tag_handling``: unwrap, escape, drop."""

    allowed_tags: Collection[str]
    allowed_attributes: Mapping[str, Collection[str]]
    url_policy: UrlPolicy = field(default_factory=UrlPolicy)
    drop_comments: bool = True
    drop_doctype: bool = True
    drop_content_tags: Collection[str] = frozenset({"script", "style"})
    allowed_css_properties: Collection[str] = frozenset()
    force_link_rel: Collection[str] = frozenset()
    unsafe_handling: str = "strip"
    disallowed_tag_handling: str = "unwrap"
    strip_invisible_unicode: bool = True

    def __post_init__(self) -> None:
        lowered = lambda names: frozenset(str(n).lower() for n in names)
        for name in ("allowed_tags", "drop_content_tags", "allowed_css_properties", "force_link_rel"):
            if isinstance(getattr(self, name), str):
                raise TypeError(f"{name} is a collection")
            object.__setattr__(self, name, lowered(getattr(self, name)))
        object.__setattr__(self, "allowed_attributes", {k.lower(): lowered(v) for k, v in self.allowed_attributes.items()})
        if self.unsafe_handling not in ("strip", "raise", "collect"):
            raise ValueError("unsafe_handling is strip, raise or collect")
        if self.disallowed_tag_handling not in ("unwrap", "escape", "drop"):
            raise ValueError("disallowed_tag_handling is unwrap, escape or drop")
        if any("style" in v for v in self.allowed_attributes.values()) and not self.allowed_css_properties:
            raise ValueError("the style attribute needs allowed_css_properties")


# The default policies.
_TAGS = (
    "p br div span blockquote pre code h1 h2 h3 h4 h5 h6 ul ol li table caption thead tbody tfoot tr th td b strong i em u s sub sup small"
    " mark hr a img"
)
_ATTRS = {
    "*": "class id title lang dir",
    "a": "href title",
    "img": "src alt title width height loading decoding",
    "th": "colspan rowspan",
    "td": "colspan rowspan",
}
_URLS = UrlPolicy(
    allow_rules={
        ("a", "href"): UrlRule(allowed_schemes=("http", "https", "mailto", "tel"), handling="allow", resolve_protocol_relative="https"),
        ("img", "src"): UrlRule(allowed_schemes=(), handling="allow", resolve_protocol_relative=None),
    }
)
DEFAULT_POLICY = SanitizationPolicy(_TAGS.split(), {k: v.split() for k, v in _ATTRS.items()}, _URLS)
DEFAULT_DOCUMENT_POLICY = SanitizationPolicy([*_TAGS.split(), "html", "head", "body", "title"], {k: v.split() for k, v in _ATTRS.items()}, _URLS, drop_doctype=False)
CSS_PRESET_TEXT = frozenset(
    "background-color color font-size font-style font-weight letter-spacing line-height text-align text-decoration text-transform"
    " white-space word-break word-spacing word-wrap".split()
)
