"""Parser of the metric-vector language (a PromQL subset)."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.labels import Matcher
from ..functions.units import UNIT_MS
from .lexing import QueryError, Scanner, Unsupported

AGGREGATIONS = ("sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "quantile", "topk", "bottomk", "count_values", "limitk", "limit_ratio")
WITH_PARAMETER = ("quantile", "topk", "bottomk", "count_values", "limitk", "limit_ratio")
#: Binding powers: or, and/unless, comparison, + -, * / % atan2, ^ (which is right-associative).
POWER = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "<=": 3, "<": 3, ">=": 3, ">": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 6}
COMPARISONS = ("==", "!=", "<=", "<", ">=", ">")
SETS = ("and", "or", "unless")


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Selector:
    name: str
    matchers: tuple[Matcher, ...]
    range_ms: int | None = None
    offset_ms: int = 0
    at: object = None  # milliseconds, "start" or "end"


@dataclass(frozen=True)
class Negate:
    of: object


@dataclass(frozen=True)
class Matching:
    on: bool | None = None
    labels: tuple[str, ...] = ()
    group: str | None = None  # left, right
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    as_bool: bool = False
    matching: Matching = field(default_factory=Matching)


@dataclass(frozen=True)
class Aggregate:
    op: str
    of: object
    parameter: object = None
    without: bool = False
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


def duration(text: str) -> int:
    import re

    return sum(int(n) * UNIT_MS[u] for n, u in re.findall(r"(\d+)(ms|[smhdwy])", text))


DURATION = r"(?:\d+(?:ms|[smhdwy]))+(?![\w.])"
NAME = r"[A-Za-z_:][\w:]*"


class Parser:
    def __init__(self, source: str):
        self.s = Scanner(source)

    def parse(self):
        out = self.expression(0)
        if not self.s.end():
            raise self.s.error("unexpected input")
        return out

    def expression(self, least: int):
        left = self.unary()
        while op := self.operator():
            power = POWER[op]
            if power < least:
                break
            self.s.match(r"\w+" if op.isalpha() or op == "atan2" else ".{%d}" % len(op))
            as_bool = bool(self.s.match(r"bool\b"))
            if as_bool and op not in COMPARISONS:
                raise self.s.error("bool needs a comparison")
            matching = self.matching()
            right = self.expression(power if op == "^" else power + 1)
            left = Binary(op, left, right, as_bool, matching)
        return left

    def operator(self) -> str | None:
        return self.s.peek(r"(?:and|or|unless|atan2)\b|==|!=|<=|>=|[-+*/%^<>]")

    def unary(self):
        if self.s.match(r"-"):
            of = self.expression(POWER["^"])
            return Number(-of.value) if isinstance(of, Number) else Negate(of)
        if self.s.match(r"\+"):
            return self.expression(POWER["^"])
        return self.postfix(self.atom())

    def atom(self):
        s = self.s
        if s.match(r"\("):
            out = self.expression(0)
            s.need(r"\)", "a closing parenthesis")
            return out
        if s.peek("[\"'`]"):
            return Text(s.quoted("\"'`", keep_unknown=False))
        if n := s.match(r"(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?![\w.])"):
            return Number(float(int(n, 16)) if n[:2].lower() == "0x" else float(n))
        if n := s.match(r"(?i:inf|nan)\b(?!\s*[({\[:])"):
            return Number(float(n))
        if s.peek(r"\{"):
            return self.selector("")
        name = s.match(NAME)
        if name is None:
            raise s.error("expected an expression")
        if name in AGGREGATIONS and s.peek(r"\(|by\b|without\b"):
            return self.aggregation(name)
        if s.match(r"\("):
            args = []
            while not s.match(r"\)"):
                args.append(self.expression(0))
                if not s.peek(r"\)"):
                    s.need(",", "a comma")
            return Call(name, tuple(args))
        return self.selector(name)

    def selector(self, name: str):
        s, out = self.s, []
        if s.match(r"\{"):
            while not s.match(r"\}"):
                label = s.need(r"[A-Za-z_]\w*", "a label name")
                op = s.need(r"=~|!~|!=|=", "a matcher")
                out.append(Matcher(label, op, s.quoted("\"'`", keep_unknown=False)))
                if s.peek(r"or\b"):
                    raise Unsupported("or between matchers")
                if not s.peek(r"\}"):
                    s.need(",", "a comma")
        if not name and not out:
            raise s.error("a selector needs a name or a matcher")
        return Selector(name, tuple(out))

    def postfix(self, e):
        s = self.s
        while True:
            if s.match(r"\["):
                text = s.need(DURATION, "a duration")
                if s.match(":"):
                    raise Unsupported("unsupported expression: subquery")
                s.need(r"\]", "a closing bracket")
                if not isinstance(e, Selector) or e.range_ms is not None:
                    raise Unsupported("unsupported expression: range of an expression")
                e = Selector(e.name, e.matchers, duration(text), e.offset_ms, e.at)
            elif s.match(r"offset\b"):
                sign = -1 if s.match("-") else 1
                e = self.modified(e, offset_ms=sign * duration(s.need(DURATION, "a duration")))
            elif s.match("@"):
                if name := s.match(r"(?:start|end)\s*\(\s*\)"):
                    e = self.modified(e, at=name[:5].strip(" (") if name.startswith("start") else "end")
                else:
                    e = self.modified(e, at=round(float(s.need(r"-?[\d.]+(?:[eE][-+]?\d+)?", "a time")) * 1000))
            else:
                return e

    def modified(self, e, **change):
        if not isinstance(e, Selector):
            raise self.s.error("offset and @ follow a selector")
        return Selector(**({"name": e.name, "matchers": e.matchers, "range_ms": e.range_ms, "offset_ms": e.offset_ms, "at": e.at} | change))

    def names(self) -> tuple[str, ...]:
        s, out = self.s, []
        s.need(r"\(", "an opening parenthesis")
        while not s.match(r"\)"):
            out.append(s.need(r"[A-Za-z_]\w*", "a label name"))
            if not s.peek(r"\)"):
                s.need(",", "a comma")
        return tuple(out)

    def aggregation(self, op: str):
        s = self.s
        word = s.match(r"by\b|without\b")
        labels = self.names() if word else ()
        s.need(r"\(", "an opening parenthesis")
        args = [self.expression(0)]
        while s.match(","):
            args.append(self.expression(0))
        s.need(r"\)", "a closing parenthesis")
        if not word and (word := s.match(r"by\b|without\b")):
            labels = self.names()
        if len(args) != 1 + (op in WITH_PARAMETER):
            raise QueryError(f"{op} takes {1 + (op in WITH_PARAMETER)} arguments", s.at)
        return Aggregate(op, args[-1], args[0] if len(args) == 2 else None, word == "without", labels)

    def matching(self) -> Matching:
        s = self.s
        word = s.match(r"(?:on|ignoring)\b(?=\s*\()")
        if not word:
            return Matching()
        labels = self.names()
        group, include = None, ()
        if g := s.match(r"group_(?:left|right)\b"):
            group = g[6:]
            include = self.names() if s.peek(r"\(") else ()
        return Matching(word == "on", labels, group, include)


def parse(source: str):
    return Parser(source).parse()
