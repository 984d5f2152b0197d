"""The functions under SQL names: register(spark), then ``SELECT html_text(html) FROM pages``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..html.entities import unescape
from ..html.events import stream
from ..html.linkify import find_links
from ..html.parser import parse
from ..html.text import escape_url_value
from ..html.transforms import apply_transforms, with_sanitize
from ..schema import EVENTS
from .text import LINK


class HtmlEvents:
    """``SELECT e.* FROM pages, LATERAL html_events(html) e``"""

    def eval(self, html: str):
        for seq, e in enumerate(stream(html)):
            attrs = [(k, v) for k, v in e[2].items()] if e[0] == "start" else None
            named = e[0] in ("start", "end", "doctype")
            yield seq, e[0], e[1] if named else None, attrs, None if named else e[1], *(e[2:4] if e[0] == "doctype" else (None, None))


def _registered(function, kind: str):
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def register(spark: SparkSession) -> list[str]:
    """Register the SQL functions of this session; gives their names."""
    clean = lambda html: apply_transforms(parse(html), with_sanitize([]))
    table = {
        "html_text": (lambda v: clean(v).to_text(), "string"),
        "html_markdown": (lambda v: clean(v).to_markdown(), "string"),
        "html_sanitize": (lambda v: clean(v).to_html(), "string"),
        "html_unescape": (unescape, "string"),
        "escape_url": (escape_url_value, "string"),
        "find_links": (lambda v: [vars(x) for x in find_links(v)], LINK),
    }
    for name, (function, kind) in table.items():
        spark.udf.register(name, _registered(function, kind))
    spark.udtf.register("html_events", F.udtf(HtmlEvents, returnType=EVENTS))
    return [*table, "html_events"]
