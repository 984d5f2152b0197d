"""Selectors as joins over the node table.

A compound selector is a condition on a node's columns. A combinator is a join: the child and adjacent ones are equi-joins, the
descendant and general-sibling ones are equi-joins by page with a range, of which the nearest match is kept (the greedy rule),
or a semi-join where any match will do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNICODE_SPACE
from ..html.select import Complex, Compound, Simple, parse_nth, parse_selector


def attr(name: str, node: str = "") -> Column:
    """Value of an attribute of a node, by its lower-case name; null if it is absent."""
    attrs = F.col(f"{node}attrs")
    return F.try_element_at(F.transform(F.filter(attrs, lambda a: F.lower(a["name"]) == name), lambda a: a["value"]), F.lit(1))


def _has(name: str) -> Column:
    return F.coalesce(F.exists("attrs", lambda a: F.lower(a["name"]) == name), F.lit(False))


def _tokens(value: Column) -> Column:
    return F.split(value, f"[{UNICODE_SPACE}]+")


def _attribute(s: Simple) -> Column:
    value, wanted = F.coalesce(attr(s.name), F.lit("")), s.value
    if s.op is None:
        return _has(s.name)
    if s.op == "=":
        test = value == wanted
    elif s.op == "|=":
        test = (value == wanted) | value.startswith(wanted + "-")
    elif not wanted:
        return F.lit(False)
    else:
        test = {"~=": lambda: F.array_contains(_tokens(value), wanted), "^=": lambda: value.startswith(wanted), "$=": lambda: value.endswith(wanted), "*=": lambda: value.contains(wanted)}[s.op]()
    return _has(s.name) & test


def _nth(index: str, text: str | None) -> Column:
    nth = parse_nth(text)
    if nth is None:
        return F.lit(False)
    a, b = nth
    if a == 0:
        return F.col(index) == b
    return ((F.col(index) - b) % a == 0) & ((F.col(index) - b) * (1 if a > 0 else -1) >= 0)


_PLACES = {
    "first-child": "elem_idx = 1", "last-child": "elem_idx = elem_cnt", "only-child": "elem_cnt = 1", "first-of-type": "type_idx = 1",
    "last-of-type": "type_idx = type_cnt", "only-of-type": "type_cnt = 1", "empty": "is_empty", "root": "at_root",
}


class SelectorPlan:
    """A selector against one node table."""

    def __init__(self, nodes: DataFrame, page_id: str) -> None:
        self.nodes, self.page = nodes, page_id

    def own(self, selectors: tuple[Complex, ...]) -> Column | None:
        """The selectors as one condition on a node's own columns, if they ask for no more than those."""
        if any(len(c) > 1 or self._needs_join(c[0][1]) for c in selectors):
            return None
        return reduce(Column.__or__, [self._condition(c[0][1]) for c in selectors])

    def of(self, selectors: tuple[Complex, ...]) -> DataFrame:
        """(page, pre) of the matches, once each."""
        single = [c for c in selectors if len(c) == 1 and not self._needs_join(c[0][1])]
        parts = []
        if single:
            parts.append(self.nodes.where(reduce(Column.__or__, [self._condition(c[0][1]) for c in single])).select(self.page, "pre"))
        parts += [self.complex(c) for c in selectors if c not in single]
        out = reduce(DataFrame.unionByName, parts)
        return out.distinct() if len(parts) > 1 else out

    def _needs_join(self, compound: Compound) -> bool:
        return any(s.kind == "pseudo" and (s.name == "contains" and s.value or s.name == "not" and s.inner and any(len(c) > 1 or self._needs_join(c[0][1]) for c in s.inner)) for s in compound)

    def _condition(self, compound: Compound) -> Column:
        """The part of a compound selector that a node's own columns decide."""
        if any(s.kind == "pseudo" and s.name == "comment" for s in compound):
            rest = [s for s in compound if not (s.kind == "pseudo" and s.name == "comment")]
            return F.lit(False) if any(s.name != "not" for s in rest) else F.col("name") == "#comment"
        return reduce(Column.__and__, [~F.startswith("name", F.lit("#")), *[c for s in compound if (c := self._simple(s)) is not None]])

    def _simple(self, s: Simple) -> Column | None:
        if s.kind == "tag":
            return F.lower("name") == s.name
        if s.kind == "all":
            return None
        if s.kind == "id":
            return F.coalesce(attr("id"), F.lit("")) == s.name
        if s.kind == "class":
            return F.array_contains(_tokens(F.coalesce(attr("class"), F.lit(""))), s.name)
        if s.kind == "attr":
            return _attribute(s)
        if s.name in _PLACES:
            return F.coalesce(F.expr(_PLACES[s.name]), F.lit(False))
        if s.name == "nth-child":
            return F.coalesce(_nth("elem_idx", s.value), F.lit(False))
        if s.name == "nth-of-type":
            return F.coalesce(_nth("type_idx", s.value), F.lit(False))
        if s.name == "not" and s.inner and not self._needs_join((s,)):
            return ~reduce(Column.__or__, [self._condition(c[0][1]) for c in s.inner])
        return None

    def compound(self, compound: Compound) -> DataFrame:
        found = self.nodes.where(self._condition(compound))
        for s in compound:
            if not self._needs_join((s,)):
                continue
            if s.name == "not":
                found = found.join(self.of(s.inner), [self.page, "pre"], "left_anti")
            else:
                from ..operators.nodes import to_text

                found = found.join(to_text(self.nodes, found.select(self.page, "pre", "last"), page_id=self.page).where(F.col("text").contains(s.value)), [self.page, "pre"], "left_semi")
        return found

    def complex(self, parts: Complex) -> DataFrame:
        page = self.page
        step = ["pre", "parent_pre", "prev_elem_pre"]
        now = self.compound(parts[-1][1]).select(page, F.col("pre").alias("target"), *[F.col(c).alias(f"at_{c}") for c in step])
        for i in range(len(parts) - 1, 0, -1):
            how = parts[i][0]
            left = self.compound(parts[i - 1][1]).select(F.col(page).alias("l_page"), *[F.col(c).alias(f"l_{c}") for c in [*step, "last"]])
            same = F.col(page) == F.col("l_page")
            if how == ">":
                on = same & (F.col("at_parent_pre") == F.col("l_pre"))
            elif how == "+":
                on = same & (F.col("at_prev_elem_pre") == F.col("l_pre"))
            elif how == " ":
                on = same & (F.col("at_pre") > F.col("l_pre")) & (F.col("at_pre") <= F.col("l_last"))
            else:
                on = same & (F.col("at_parent_pre") == F.col("l_parent_pre")) & (F.col("l_pre") < F.col("at_pre"))
            if i == 1:
                now = now.join(left, on, "left_semi")
                break
            met = now.join(left, on).select(page, "target", *[F.col(f"l_{c}").alias(f"at_{c}") for c in step])
            if how in (" ", "~"):
                met = met.groupBy(page, "target").agg(F.max_by(F.struct(*[f"at_{c}" for c in step]), "at_pre").alias("m")).select(page, "target", "m.*")
            now = met
        return now.select(page, F.col("target").alias("pre"))


def plan_selector(nodes: DataFrame, selector: str, page_id: str = "page_id") -> DataFrame:
    return SelectorPlan(nodes, page_id).of(parse_selector(selector))
