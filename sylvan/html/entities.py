"""Character references."""

from __future__ import annotations

import re
from html.entities import html5

from .tables import C1

_LONGEST = max(map(len, html5))
_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|(\d+));?|([A-Za-z][A-Za-z0-9]*;?))")


def code_point(number: int) -> str:
    if number in C1:
        return C1[number]
    if number == 13:
        return "\n"
    if number == 0 or number > 0x10FFFF or 0xD800 <= number <= 0xDFFF:
        return "�"
    return chr(number)


def unescape(text: str, in_attribute: bool = False) -> str:
    """Decode references by the HTML rules: longest known name, names without ``;`` only where the standard has them.

    In an attribute, a name without ``;`` stays as it is if ``=`` or a letter or digit follows.
    """
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        hexadecimal, decimal, name = m.groups()
        if name is None:
            digits = hexadecimal or decimal
            return code_point(int(digits, 16 if hexadecimal else 10)) if len(digits) < 12 else "�"
        if name in html5 and name[-1] == ";":
            return html5[name]
        for n in range(min(len(name), _LONGEST), 1, -1):
            if name[:n] in html5:
                after = name[n] if n < len(name) else text[m.end() : m.end() + 1]
                if in_attribute and name[n - 1] != ";" and after and (after == "=" or (after.isascii() and after.isalnum())):
                    return m[0]
                return html5[name[:n]] + name[n:]
        return m[0]

    return _REFERENCE.sub(one, text)
