"""Encoding detection: byte-order mark, transport label, meta prescan, windows-1252."""

from __future__ import annotations

import re

# Labels by encoding. UTF-7 is never used; Latin-1 labels mean windows-1252.
LABELS = {
    "utf-8": "utf-8 utf8",
    "windows-1252": "windows-1252 windows1252 cp1252 x-cp1252 iso-8859-1 iso8859-1 latin1 latin-1 l1 cp819 ibm819 utf-7 utf7 x-utf-7",
    "iso-8859-2": "iso-8859-2 iso8859-2 latin2 latin-2",
    "euc-jp": "euc-jp eucjp",
    "utf-16": "utf-16 utf16",
    "utf-16le": "utf-16le utf16le",
    "utf-16be": "utf-16be utf16be",
}
_BY_LABEL = {label: name for name, labels in LABELS.items() for label in labels.split()}
_CODECS = {"windows-1252": "cp1252", "euc-jp": "euc_jp"}
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
MOST_SCANNED, MOST_MARKUP = 65536, 1024
_SP = rb"[\t\n\f\r ]"
_META = re.compile(rb"<meta(?=[\t\n\f\r /])", re.I)
_OTHER = re.compile(rb"<(?:/?[A-Za-z][^\t\n\f\r />]*|[!/?])")
_ATTR = re.compile(rb"[\t\n\f\r /]*([^\t\n\f\r />=][^\t\n\f\r />=]*)(?:" + _SP + rb"*=" + _SP + rb"*(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\f\r >]*)))?")
_CHARSET = re.compile(rb"charset" + _SP + rb"*=" + _SP + rb"*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\t\n\f\r ;][^\t\n\f\r ;]*))", re.I)


def normalize_label(label: str | bytes | None) -> str | None:
    if isinstance(label, bytes):
        label = label.decode("ascii", "ignore")
    return _BY_LABEL.get(label.strip().lower()) if label else None


def _tag_attrs(data: bytes, pos: int) -> tuple[dict[bytes, bytes], int]:
    attrs: dict[bytes, bytes] = {}
    while m := _ATTR.match(data, pos):
        value = next((g for g in m.groups()[1:] if g is not None), b"")
        attrs.setdefault(m[1].lower(), value)
        pos = m.end()
    end = data.find(b">", pos)
    return attrs, len(data) if end < 0 else end + 1


def prescan(data: bytes) -> str | None:
    """Encoding that a meta element declares within the first kilobyte outside comments; UTF-16 labels mean UTF-8."""
    data, pos, spent = data[:MOST_SCANNED], 0, 0
    while spent < MOST_MARKUP:
        lt = data.find(b"<", pos)
        if lt < 0 or spent + lt - pos >= MOST_MARKUP:
            return None
        spent += lt - pos
        if data.startswith(b"<!--", lt):
            end = data.find(b"-->", lt + 2)
            if end < 0:
                return None
            pos = end + 3
            continue
        if m := _META.match(data, lt):
            attrs, pos = _tag_attrs(data, m.end())
            found = normalize_label(attrs.get(b"charset"))
            if found is None and attrs.get(b"http-equiv", b"").strip().lower() == b"content-type" and (c := _CHARSET.search(attrs.get(b"content", b""))):
                found = normalize_label(next(g for g in c.groups() if g is not None))
            if found:
                return "utf-8" if found.startswith("utf-16") else found
        elif m := _OTHER.match(data, lt):
            pos = _tag_attrs(data, m.end())[1] if m[0][-1:].isalnum() else (data.find(b">", lt) + 1 or len(data))
        else:
            pos = lt + 1
        spent += pos - lt
    return None


def sniff(data: bytes, transport: str | None = None) -> tuple[str, int]:
    """(encoding, length of the byte-order mark)."""
    for bom, name in BOMS:
        if data.startswith(bom):
            return name, len(bom)
    return normalize_label(transport) or prescan(data) or "windows-1252", 0


def decode_html(data: bytes, transport: str | None = None) -> tuple[str, str]:
    """(text, encoding); bytes that don't decode become U+FFFD."""
    name, skip = sniff(data, transport)
    return data[skip:].decode(_CODECS.get(name, name), "replace"), name
