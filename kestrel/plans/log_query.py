"""Parser of the log-pipeline language (a LogQL subset)."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.labels import Matcher
from ..functions.units import duration_ns
from .lexing import Scanner

FUNCTIONS = ("count_over_time", "bytes_over_time", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "rate")


@dataclass(frozen=True)
class Stage:
    """kind: contains, lacks, finds, misses (lines), json, logfmt, regexp, unwrap, compare (label, op, number), test (label, op, text)."""

    kind: str
    name: str = ""
    op: str = ""
    value: object = None


@dataclass(frozen=True)
class Pipeline:
    matchers: tuple[Matcher, ...]
    stages: tuple[Stage, ...] = ()


@dataclass(frozen=True)
class Metric:
    function: str
    pipeline: Pipeline
    range_ns: int


def parse(source: str) -> Pipeline | Metric:
    s = Scanner(source)
    name = s.match("(?:" + "|".join(FUNCTIONS) + r")(?=\()")
    if name:
        s.match(r"\(")
        pipeline = _pipeline(s)
        s.need(r"\[", "a range", "a metric query ends with [5m])")
        at = s.at
        text = s.need(r"[A-Za-z0-9]+", "a duration")
        try:
            width = duration_ns(text)
        except ValueError as e:
            s.at = at
            raise s.error(str(e)) from None
        s.need(r"\]", "a closing bracket")
        s.need(r"\)", "a closing parenthesis")
        out: Pipeline | Metric = Metric(name, pipeline, width)
    else:
        out = _pipeline(s)
    if not s.end():
        raise s.error("unexpected input")
    return out


def _pipeline(s: Scanner) -> Pipeline:
    s.need(r"\{", "a stream selector", 'a query starts with {label="value"}')
    matchers = []
    while not s.match(r"\}"):
        if matchers:
            s.need(",", "a comma")
        label = s.need(r"[\w.]+", "a label name")
        op = s.need(r"=~|!~|!=|=", "a matcher")
        matchers.append(Matcher(label, op, s.quoted()))
    stages = []
    while True:
        if op := s.match(r"\|=|!=|\|~|!~"):
            stages.append(Stage({"|=": "contains", "!=": "lacks", "|~": "finds", "!~": "misses"}[op], value=s.quoted()))
        elif s.match(r"\|"):
            stages.append(_stage(s))
        else:
            return Pipeline(tuple(matchers), tuple(stages))


def _stage(s: Scanner) -> Stage:
    for word in ("json", "logfmt"):
        if s.match(rf"{word}(?![\w.])(?!\s*(?:=|!|<|>))"):
            return Stage(word)
    if s.match(r'regexp(?=\s*")'):
        return Stage("regexp", value=s.quoted())
    if s.match(r"unwrap(?=\s+\w)"):
        return Stage("unwrap", s.need(r"[\w.]+", "a label name"))
    name = s.need(r"[\w.]+", "a stage", "json, logfmt, regexp, unwrap or a label filter")
    if op := s.match(r">=|<=|>|<"):
        text = s.need(r"[0-9.+-]+", "a number")
        try:
            return Stage("compare", name, op, float(text))
        except ValueError:
            raise s.error(f"not a number: {text}") from None
    op = s.need(r"=~|!~|!=|=", "a comparison")
    return Stage("test", name, op, s.quoted())
