"""Rule lists that decide what is boilerplate and what is the main content.

A rule is ``(kind, name, value)``:

* ``("tag", "nav", None)``            the element's tag
* ``("equals", "role", "banner")``    an attribute's whole value
* ``("contains", "class", "cookie")`` a part of an attribute's value, case-sensitive
* ``("word", "class", "content")``    one white-space separated word of an attribute

Callers may pass their own lists to every operator that takes rules.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import SPACE_CLASS

Rule = tuple[str, str, str | None]

# Boilerplate elements.
JUNK_RULES: list[Rule] = [
    *(("tag", t, None) for t in ("script", "style", "nav", "footer", "aside", "header", "menu")),
    *(("equals", "role", v) for v in ("navigation", "banner", "contentinfo")),
    *(
        ("contains", attribute, v)
        for v in ("cookie", "consent", "sidebar", "popup")
        for attribute in ("id", "class")
    ),
    *(("contains", "class", v) for v in ("social", "related", "advert")),
]

# Main content, best first.
CONTENT_RULES: list[Rule] = [
    ("tag", "main", None),
    ("tag", "article", None),
    ("equals", "role", "main"),
    ("word", "class", "main-content"),
    ("word", "class", "content"),
    ("equals", "id", "main"),
    ("equals", "id", "content"),
]


def rule_label(rule: Rule) -> str:
    kind, name, value = rule
    sign = {"equals": "=", "contains": "*=", "word": "~="}.get(kind)
    return name if sign is None else f"[{name}{sign}{value}]"


def rule_test(rule: Rule, tag: Column, attribute: dict[str, Column]) -> Column:
    """Boolean column: does an element with this tag and these attributes match the rule?"""
    kind, name, value = rule
    if kind == "tag":
        return tag == name
    column = F.coalesce(attribute[name], F.lit(""))
    if kind == "equals":
        return column == value
    if kind == "contains":
        return F.contains(column, F.lit(value))
    if kind == "word":
        words = F.concat(F.lit(" "), F.regexp_replace(column, f"[{SPACE_CLASS}]+", " "), F.lit(" "))
        return F.contains(words, F.lit(f" {value} "))
    raise ValueError(f"unknown rule kind {kind!r}")


def any_rule(rules: list[Rule], tag: Column, attribute: dict[str, Column]) -> Column:
    tags = [name for kind, name, _ in rules if kind == "tag"]
    tests = [tag.isin(tags)] if tags else []
    tests += [rule_test(r, tag, attribute) for r in rules if r[0] != "tag"]
    return reduce(or_, tests, F.lit(False))


def rule_rank(rules: list[Rule], tag: Column, attribute: dict[str, Column]) -> Column:
    """Position of the first rule that matches, NULL when none does."""
    if not rules:
        return F.lit(None).cast("int")
    first, *rest = list(enumerate(rules))
    rank = F.when(rule_test(first[1], tag, attribute), F.lit(first[0]))
    for place, rule in rest:
        rank = rank.when(rule_test(rule, tag, attribute), F.lit(place))
    return rank


def attributes_in(*rule_lists: list[Rule]) -> list[str]:
    return sorted({name for rules in rule_lists for kind, name, _ in rules if kind != "tag"})
