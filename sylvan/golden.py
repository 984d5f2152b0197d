"""Small cases with known results, as queries: inputs are a table, expected results are the rows of the SQL.

The cases are in ``fixtures`` as JSON lists: tree construction (document or fragment), sanitizing, transforms, links and selectors.
They show parts of the engine that generated pages don't reach.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import transforms as X
from .html.linkify import find_links
from .html.parser import FragmentContext, parse
from .html.policy import DEFAULT_POLICY, SanitizationPolicy
from .html.testformat import to_test_format
from .html.urls import UrlPolicy, UrlProxy, UrlRule

_LINK = {("a", "href"): UrlRule(allowed_schemes=("https", "http"), handling="allow"), ("img", "src"): UrlRule(allowed_schemes=("https",), handling="allow"), ("img", "srcset"): UrlRule(allowed_schemes=("https",), handling="allow")}
_ATTRS = {"*": ["id"], "a": ["href", "rel"], "img": ["src", "srcset", "alt"], "p": ["style"]}
POLICIES: dict[str, SanitizationPolicy] = {
    "default": DEFAULT_POLICY,
    "links": SanitizationPolicy(["a", "b", "p", "img"], _ATTRS, UrlPolicy(allow_rules=_LINK), allowed_css_properties=["color"], force_link_rel=["noopener", "nofollow"]),
    "escape": SanitizationPolicy(["b", "p"], {"*": []}, disallowed_tag_handling="escape"),
    "drop": SanitizationPolicy(["b", "p"], {"*": []}, disallowed_tag_handling="drop", drop_comments=False),
    "proxy": SanitizationPolicy(["a"], {"a": ["href"]}, UrlPolicy(allow_rules={("a", "href"): UrlRule(allowed_schemes=("https",), handling="proxy", proxy=UrlProxy("/go"))})),
    "hosts": SanitizationPolicy(["a"], {"a": ["href"]}, UrlPolicy(allow_rules={("a", "href"): UrlRule(allowed_schemes=("https",), handling="allow", allowed_hosts=frozenset({"a.com"}))})),
}


def _upper(node) -> None:
    for child in node.children:
        if child.name == "#text":
            child.data = child.data.upper()


TRANSFORMS: dict[str, Callable[[], list]] = {
    "set": lambda: [X.SetAttrs("a[href^='http']", {"rel": "nofollow", "download": None})],
    "drop": lambda: [X.Drop("i, .ad")],
    "unwrap": lambda: [X.Unwrap("span")],
    "escape": lambda: [X.Escape("u")],
    "empty": lambda: [X.Empty("ul")],
    "edit": lambda: [X.Edit("em", _upper)],
    "document": lambda: [X.EditDocument(lambda root: root.children[0].attrs.update({"id": "first"}))],
    "decide": lambda: [X.Decide("p", lambda n: X.Decision.UNWRAP if "class" in n.attrs else X.Decision.KEEP)],
    "attrs": lambda: [X.EditAttrs("p", lambda n: {k: v for k, v in n.attrs.items() if k == "id"})],
    "linkify": lambda: [X.Linkify(fuzzy_ip=True, extra_tlds=["example"])],
    "whitespace": lambda: [X.CollapseWhitespace()],
    "comments": lambda: [X.DropComments()],
    "foreign": lambda: [X.DropForeignNamespaces()],
    "drop_attrs": lambda: [X.DropAttrs("*", ("on*", "data-*"))],
    "allow_attrs": lambda: [X.AllowlistAttrs("*", {"*": ["id"], "a": ["href"]})],
    "style": lambda: [X.AllowStyleAttrs("*", ("color", "width"))],
    "merge": lambda: [X.MergeAttrs("a", "rel", ("noopener", "nofollow"))],
    "prune": lambda: [X.PruneEmpty("p, b, div")],
    "invisible": lambda: [X.StripInvisible()],
    "stages": lambda: [X.Stage([X.Unwrap("b")]), X.Stage([X.Drop("i")])],
}


def _cases(name: str) -> list[dict]:
    return json.loads((Path(__file__).parent / "fixtures" / f"{name}.json").read_text(encoding="utf-8"))


def _tree(case: dict) -> str:
    context = FragmentContext(*case["context"]) if case.get("context") else None
    return to_test_format(parse(case["html"], fragment=context is not None, context=context))


def _fragment(case: dict, specs: list, policy: SanitizationPolicy | None = None) -> str:
    root = parse(case["html"], fragment=True, literal=policy is not None and policy.disallowed_tag_handling == "escape")
    return X.apply_transforms(root, specs, policy=policy).to_html()


def _first_link(case: dict) -> str:
    found = find_links(case["html"], fuzzy_ip=bool(case["what"]))
    return f"{found[0].text} -> {found[0].href}" if found else "none"


KINDS: dict[str, Callable[[dict], str]] = {
    "trees": _tree,
    "sanitize": lambda case: _fragment(case, X.with_sanitize([]), POLICIES[case["what"]]),
    "transforms": lambda case: _fragment(case, TRANSFORMS[case["what"]]()),
    "links": _first_link,
    "selectors": lambda case: " ".join(n.attrs.get("id") or n.name for n in parse(case["html"], fragment=True).query(case["what"])),
}


def _query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(i, json.dumps(case)) for i, case in enumerate(_cases(kind))]
        apply = KINDS[kind]

        def each(cases: pd.Series) -> pd.Series:
            return cases.map(lambda text: apply(json.loads(text)))

        return spark.createDataFrame(rows, "case_id int, spec string").select("case_id", F.pandas_udf(each, "string")("spec").alias("output"))

    run.__name__ = f"golden_{kind}"
    run.__doc__ = f"Cases of {kind}, each with its result."
    return run


def _text(case: dict) -> str:
    expected = case["expected"]
    return "\n".join(expected) if isinstance(expected, list) else expected


def _sql(kind: str) -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(_text(c))})" for i, c in enumerate(_cases(kind))) + ") t(case_id, output)"


QUERIES = {f"golden_{kind}": _query(kind) for kind in KINDS}
ORACLES = {f"golden_{kind}": _sql(kind) for kind in KINDS}
