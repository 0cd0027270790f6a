"""Evaluation of log-pipeline queries.

``logs``: (key, labels map, ts_ns, line, ingest_seq, ...).  Stages fold over a column of labels, each line is looked at once,
and metric functions give the surviving lines to the windows of the step grid.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.units import to_number
from ..plans import log_query as Q
from ..plans.grid import Grid

DEFAULT_LIMIT, MAX_LIMIT = 1_000, 10_000
HOUR_NS = 3_600_000_000_000


def merged(labels: Column, extra: Column) -> Column:
    """Labels overwritten by ``extra`` (null: nothing)."""
    more = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(labels, lambda k, _: ~F.map_contains_key(more, k)), more)


def distinct_map(pairs: Column) -> Column:
    """A map of (key, value) pairs in which a later pair wins."""
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def json_labels(line: Column) -> Column:
    found = F.from_json(line, "map<string,string>")
    return F.when(F.trim(line).startswith("{"), F.transform_values(found, lambda _, v: F.coalesce(v, F.lit("null"))))


def logfmt_labels(line: Column) -> Column:
    tokens = F.filter(F.split(line, r"(?U)\s+"), lambda t: t.contains("=") & ~t.startswith("="))

    def pair(t):
        at = F.instr(t, "=")
        raw = F.substring(t, at + 1, F.length(t))
        quoted = raw.startswith('"') & raw.endswith('"') & (F.length(raw) >= 2)
        return F.struct(F.substring(t, F.lit(1), at - 1).alias("key"), F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw).alias("value"))

    return distinct_map(F.transform(tokens, pair))


def regexp_labels(line: Column, pattern: str) -> Column:
    names = re.compile(pattern).groupindex
    java = L.java_regex(pattern)
    pairs = [F.struct(F.lit(n).alias("key"), F.regexp_extract(line, java, i).alias("value")) for n, i in names.items()]
    # an optional group that took no part stays absent; Spark gives '' for it, and for a group that matched nothing
    found = F.filter(F.array(*pairs), lambda x: x["value"] != "") if pairs else F.array().cast(L.KEY_TYPE)
    return F.when(line.rlike(java), F.map_from_entries(found))


def holds(value: Column, test) -> Column:
    """``test`` of a value that is computed once, however often the test looks at it; null counts as false."""
    return F.exists(F.array(value), lambda x: F.coalesce(test(x), F.lit(False)))


def run_stages(rows: DataFrame, stages: tuple[Q.Stage, ...]) -> tuple[DataFrame, Column | None]:
    """Rows that pass, with ``found`` (all labels), and the value of the label that the first unwrap names.

    Filters look up their one label in what each stage has read; the whole of ``found`` is put together only if it is asked for.
    """
    read: list[Column] = []
    unwrap = None

    def label(name: str) -> Column:
        return F.coalesce(*[r[name] for r in reversed(read)], F.col("labels")[name])

    for s in stages:
        line = F.col("line")
        if s.kind in ("contains", "lacks"):
            hit = line.contains(s.value)
            rows = rows.filter(hit if s.kind == "contains" else ~hit)
        elif s.kind in ("finds", "misses"):
            java = L.java_regex(s.value)
            if java is None:
                raise ValueError(f"invalid pattern {s.value!r}")
            rows = rows.filter(line.rlike(java) if s.kind == "finds" else ~line.rlike(java))
        elif s.kind == "json":
            read.append(json_labels(line))
        elif s.kind == "logfmt":
            read.append(logfmt_labels(line))
        elif s.kind == "regexp":
            read.append(regexp_labels(line, s.value))
        elif s.kind == "unwrap":
            unwrap = unwrap or s.name
        elif s.kind == "compare":
            test = {">": lambda n: n > s.value, ">=": lambda n: n >= s.value, "<": lambda n: n < s.value, "<=": lambda n: n <= s.value}[s.op]
            rows = rows.filter(holds(to_number(label(s.name)), lambda n: test(n) & ~F.isnan(n)))  # noqa: B023
        elif s.op in ("=", "!="):
            rows = rows.filter(F.coalesce(label(s.name) == s.value if s.op == "=" else label(s.name) != s.value, F.lit(False)))
        else:
            java = L.java_regex(s.value)
            hit = label(s.name).rlike(java) if java is not None else F.lit(False)
            rows = rows.filter(F.coalesce(hit if s.op == "=~" else ~hit, F.lit(False)))
    return rows.withColumn("found", functools.reduce(merged, read, F.col("labels"))), None if unwrap is None else label(unwrap)


class Logs:
    def __init__(self, logs: DataFrame, promoted: tuple[str, ...] = ()):
        """``promoted``: labels that are also real columns."""
        self.logs, self.promoted = logs, {p: F.col(p) for p in promoted}

    def select(self, matchers, start_ns: int, end_ns: int) -> DataFrame:
        return self.logs.filter(L.matches(F.col("labels"), list(matchers), self.promoted) & F.col("ts_ns").between(start_ns, end_ns))

    def streams(self, query: str | Q.Pipeline, start_ns: int, end_ns: int, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
        """Matching entries by stream, oldest first; with a limit the newest over all streams.  ``limit=None``: all."""
        q = Q.parse(query) if isinstance(query, str) else query
        if not isinstance(q, Q.Pipeline):
            raise ValueError("a metric query has no streams")
        rows, _ = run_stages(self.select(q.matchers, start_ns, end_ns), q.stages)
        if limit is not None:
            rows = rows.orderBy(F.desc("ts_ns"), F.desc("ingest_seq")).limit(max(0, min(limit, MAX_LIMIT)))
        return rows.orderBy("key", "ts_ns", "ingest_seq")

    def matrix(self, query: str | Q.Metric, start_ns: int, end_ns: int, step_ns: int | None = None) -> DataFrame:
        """(key, t, value).  Without a step the range is the step.  Labels are the stream's own."""
        q = Q.parse(query) if isinstance(query, str) else query
        if not isinstance(q, Q.Metric):
            raise ValueError("not a metric query")
        step = q.range_ns if step_ns is None else step_ns
        if step <= 0:
            raise ValueError("the step must be positive")
        grid = Grid(start_ns, end_ns, step)
        base = self.select(q.pipeline.matchers, start_ns - q.range_ns, end_ns)
        rows, unwrap = run_stages(base, q.pipeline.stages)
        number = to_number(F.col("line") if unwrap is None else F.coalesce(unwrap, F.col("line")))
        value = {"bytes_over_time": F.octet_length("line").cast("double"), "count_over_time": F.lit(1.0), "rate": F.lit(1.0)}.get(q.function, number)
        rows = rows.select("key", "ts_ns", value.alias("v")).filter("v is not null")
        finite = F.when(~F.isnan("v"), F.col("v"))
        agg = {"avg_over_time": F.avg("v"), "min_over_time": F.coalesce(F.min(finite), F.lit(float("inf"))), "max_over_time": F.coalesce(F.max(finite), F.lit(float("-inf")))}.get(q.function, F.sum("v"))
        out = grid.cover(rows, "ts_ns", q.range_ns).groupBy("key", "t").agg(agg.alias("value"))
        if q.function in ("min_over_time", "max_over_time"):
            return out
        seconds = q.range_ns / 1e9
        keys = self.select(q.pipeline.matchers, -(2**63), 2**63 - 1).select("key").distinct()
        dense = keys.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.last).cast("long")))).select("key", grid.time(F.col("k")).alias("t"))
        v = F.coalesce("value", F.lit(0.0))
        v = (v / seconds if seconds else F.lit(0.0)) if q.function == "rate" else v
        return dense.join(out, ["key", "t"], "left").select("key", "t", v.alias("value"))

    def instant(self, query: str, at_ns: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """The hour up to ``at_ns``; a metric query gives a matrix from the hour's beginning."""
        q = Q.parse(query)
        if isinstance(q, Q.Metric):
            return self.matrix(q, at_ns - HOUR_NS, at_ns)
        return self.streams(q, at_ns - HOUR_NS, at_ns, limit)

    def label_names(self) -> DataFrame:
        return self.logs.select(F.explode(F.map_keys("labels")).alias("name")).distinct()

    def label_values(self, name: str) -> DataFrame:
        return self.logs.select(F.col("labels")[name].alias("value")).filter("value is not null").distinct()
