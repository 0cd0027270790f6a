"""Parser of the trace-selector language (a TraceQL subset)."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.units import duration_ns
from .lexing import Scanner

KINDS = {"unspecified": 0, "internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
OPS = r">=|<=|!=|=~|=|>|<"


@dataclass(frozen=True)
class Condition:
    """field: duration, status, kind, name, event_name, event, attribute.  ``value`` is str, bool, int or float."""

    field: str
    op: str
    value: object
    key: str = ""


@dataclass(frozen=True)
class Selector:
    """Groups of conditions: or over groups, and within one."""

    any_of: tuple[tuple[Condition, ...], ...] = ()


@dataclass(frozen=True)
class Stage:
    """function: count, avg, max, min; value in spans or nanoseconds."""

    function: str
    op: str
    value: int


@dataclass(frozen=True)
class Query:
    left: Selector
    op: str | None = None  # >, >>, ~
    right: Selector | None = None
    stages: tuple[Stage, ...] = ()


def parse(source: str) -> Query:
    s = Scanner(source)
    left = _selector(s)
    op = s.match(r">>|>|~")
    right = _selector(s) if op else None
    stages = []
    while s.match(r"\|"):
        stages.append(_stage(s))
    if not s.end():
        raise s.error("unexpected input")
    return Query(left, op, right, tuple(stages))


def _selector(s: Scanner) -> Selector:
    s.need(r"\{", "a span selector", 'a query starts with { ... }')
    if s.match(r"\}"):
        return Selector()
    groups, group = [], [_condition(s)]
    while not s.match(r"\}"):
        if s.match("&&"):
            group.append(_condition(s))
        else:
            s.need(r"\|\|", "&&, || or }")
            groups.append(tuple(group))
            group = [_condition(s)]
    return Selector((*groups, tuple(group)))


def _condition(s: Scanner) -> Condition:
    if s.match(r"duration(?![\w.])"):
        op = s.need(OPS, "a comparison")
        return Condition("duration", op, _duration(s))
    for field, values in (("status", ("ok", "error", "unset")), ("kind", tuple(KINDS))):
        if s.match(rf"{field}(?![\w.])"):
            op = s.need(r"!=|=(?!~)", "= or !=", f"{field} is only equal or not")
            return Condition(field, op, s.need(rf"(?:{'|'.join(values)})\b", " or ".join(values)))
    if s.match(r"name(?![\w.])"):
        return Condition("name", s.need(OPS, "a comparison"), s.quoted())
    if s.match(r"event\.name(?![\w.])"):
        return Condition("event_name", s.need(OPS, "a comparison"), s.quoted())
    field = "attribute"
    if s.match(r"event\."):
        field, key = "event", s.need(r"[\w.\-]+", "an attribute")
    else:
        key = s.need(r"\.?[A-Za-z_][\w.\-]*", "a condition").lstrip(".")
        if not key.startswith(("resource.", "span.")):
            key = ("resource." if "." in key else "span.") + key
    op = s.need(OPS, "a comparison")
    return Condition(field, op, _value(s), key)


def _value(s: Scanner):
    if s.peek('"'):
        return s.quoted()
    if word := s.match(r"(?:true|false)\b"):
        return word == "true"
    text = s.need(r"-?\d+(?:\.\d+)?", "a value")
    return float(text) if "." in text else int(text)


def _duration(s: Scanner) -> int:
    return duration_ns(s.need(r"\d+(?:\.\d+)?(?:ms|s|m|h)(?!\w)", "a duration", "ms, s, m or h"), False)


def _stage(s: Scanner) -> Stage:
    if s.match(r"count\s*\(\s*\)"):
        op = s.need(OPS, "a comparison")
        return Stage("count", op, int(s.need(r"\d+", "a number")))
    name = s.need(r"avg|max|min", "a stage", "count(), avg(duration), max(duration) or min(duration)")
    s.need(r"\(\s*duration\s*\)", "(duration)")
    op = s.need(OPS, "a comparison")
    return Stage(name, op, _duration(s))
