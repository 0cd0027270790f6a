"""Label sets as arrays of (key, value) sorted by key: they group, join and compare, which maps do not."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "__name__"
KEY_TYPE = "array<struct<key:string,value:string>>"


def entries(pairs: dict[str, Column]) -> Column:
    """A label set from columns; null values are absent labels."""
    items = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(pairs.items())]
    return F.filter(F.array(*items), lambda x: x["value"].isNotNull())


def of_map(labels: Column) -> Column:
    return F.array_sort(F.map_entries(labels)).cast(KEY_TYPE)


def value(key: Column, name: str) -> Column:
    """The label's value, null if it is absent."""
    return F.get(F.filter(key, lambda x: x["key"] == name), F.lit(0))["value"]


def keep(key: Column, names: list[str]) -> Column:
    return F.filter(key, lambda x: x["key"].isin(*names)) if names else F.array().cast(KEY_TYPE)


def drop(key: Column, names: list[str]) -> Column:
    return F.filter(key, lambda x: ~x["key"].isin(*names)) if names else key


def put(key: Column, name: str, val: Column) -> Column:
    """Set a label; an empty or null value removes it."""
    rest = drop(key, [name])
    added = F.array_sort(F.concat(rest, F.array(F.struct(F.lit(name).alias("key"), val.alias("value")))))
    return F.when(F.coalesce(val, F.lit("")) == "", rest).otherwise(added)


def text(key: Column) -> Column:
    """``a=1,b=2``."""
    return F.array_join(F.transform(key, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str


def java_regex(pattern: str) -> str | None:
    """An RE2-style pattern for Java, or None if it is no valid pattern of both."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    if re.search(r"\(\?(?:=|!|<=|<!)|\\[1-9]", pattern):  # no look-around, no back references
        return None
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        if c == "$" and not in_class:
            out.append(r"\z")
        elif pattern.startswith("(?P<", i) and not in_class:
            out.append("(?<")
            i += 4
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def predicate(found: Column, m: Matcher) -> Column:
    """Does the label's value (null: absent) satisfy the matcher?  Positive matchers need the label, negative ones accept its
    absence, and a pattern that is invalid matches nothing."""
    if m.op == "=":
        return F.coalesce(found == m.value, F.lit(False))
    if m.op == "!=":
        return F.coalesce(found != m.value, F.lit(True))
    pattern = java_regex(m.value)
    if pattern is None:
        return F.lit(False)
    hit = found.rlike(rf"\A(?:{pattern})\z")
    return F.coalesce(hit, F.lit(False)) if m.op == "=~" else ~F.coalesce(hit, F.lit(False))


def matches(labels: Column, matchers: list[Matcher], columns: dict[str, Column] | None = None) -> Column:
    """All matchers hold.  ``columns`` are labels that are real columns, which a Parquet scan can be filtered by."""
    out = F.lit(True)
    for m in matchers:
        found = (columns or {}).get(m.name)
        if found is not None and m.op == "=":
            out = out & (found == m.value)
        else:
            out = out & predicate(found if found is not None else labels[m.name], m)
    return out
