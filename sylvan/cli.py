"""Command line: ``python -m sylvan.cli PATH [--selector S] [--format html|text|markdown] ...``; PATH of - reads standard input."""

from __future__ import annotations

import argparse
import sys

from .html.encoding import decode_html
from .html.errors import parse_errors
from .html.parser import parse
from .html.policy import DEFAULT_DOCUMENT_POLICY, DEFAULT_POLICY
from .html.select import SelectorError
from .html.transforms import Sanitize, apply_transforms, cleanup_preset


def main(argv: list[str] | None = None) -> int:
    """0 if something was written, 1 if the selector found nothing, 2 for a bad selector or an error in strict mode."""
    from dataclasses import replace

    p = argparse.ArgumentParser("sylvan")
    p.add_argument("path")
    p.add_argument("--output")
    p.add_argument("--selector")
    p.add_argument("--format", choices=("html", "text", "markdown"), default="html")
    for flag in ("first", "fragment", "strict", "unsafe", "cleanup", "separator-blocks-only"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--allow-tags", default="")
    p.add_argument("--separator", default=" ")
    p.add_argument("--strip", action=argparse.BooleanOptionalAction, default=True)
    a = p.parse_args(argv)
    data = sys.stdin.buffer.read() if a.path == "-" else open(a.path, "rb").read()
    html, _ = decode_html(data)
    if a.strict and (errors := parse_errors(html, a.fragment)):
        print(f"{errors[0].message} at line {errors[0].line}, column {errors[0].column}", file=sys.stderr)
        return 2
    root = parse(html, fragment=a.fragment)
    policy = DEFAULT_POLICY if a.fragment else DEFAULT_DOCUMENT_POLICY
    if a.allow_tags:
        policy = replace(policy, allowed_tags=policy.allowed_tags | {t.strip().lower() for t in a.allow_tags.split(",") if t.strip()})
    specs = cleanup_preset(not a.unsafe) if a.cleanup else [] if a.unsafe else [Sanitize()]
    apply_transforms(root, specs, policy=policy)
    try:
        found = root.query(a.selector) if a.selector else [root]
    except SelectorError as error:
        print(error, file=sys.stderr)
        return 2
    if not found:
        return 1
    found = found[:1] if a.first else found
    if a.format == "html":
        out = "\n".join(n.to_html() for n in found)
    elif a.format == "text":
        out = "\n".join(n.to_text(a.separator, a.strip, a.separator_blocks_only) for n in found)
    else:
        out = "\n\n".join(n.to_markdown() for n in found)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out + "\n")
    else:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
