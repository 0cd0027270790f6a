"""Evaluation of trace-selector queries and trace summaries.

``spans``: (trace_id, span_id, parent_span_id, name, service, start_ns, duration_ns, status, status_message, kind, attributes,
events, links, ingest_seq); an attribute is (key, value) with value (kind, s, i, d, b, rendered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import java_regex
from ..functions.units import floor_div
from ..plans import trace_query as Q
from ..plans.rounds import stored

VALUE = "struct<kind:string,s:string,i:bigint,d:double,b:boolean,rendered:string>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
EVENTS = f"array<struct<name:string,time_ns:bigint,attributes:{ATTRIBUTES}>>"
LINKS = f"array<struct<trace_id:string,span_id:string,trace_state:string,flags:int,attributes:{ATTRIBUTES}>>"
SPANS = f"trace_id string, span_id string, parent_span_id string, name string, service string, start_ns long, duration_ns long, status string, status_message string, kind int, attributes {ATTRIBUTES}, events {EVENTS}, links {LINKS}, ingest_seq long"
EPSILON = 2.220446049250313e-16
DEFAULT_LIMIT, MAX_LIMIT, MAX_DEPTH = 20, 1_000, 128


def text_value(v: Column) -> Column:
    n = lambda kind: F.lit(None).cast(kind)
    return F.struct(F.lit("s").alias("kind"), v.cast("string").alias("s"), n("bigint").alias("i"), n("double").alias("d"), n("boolean").alias("b"), v.cast("string").alias("rendered"))


def int_value(v: Column) -> Column:
    n = lambda kind: F.lit(None).cast(kind)
    return F.struct(F.lit("i").alias("kind"), n("string").alias("s"), v.cast("bigint").alias("i"), n("double").alias("d"), n("boolean").alias("b"), v.cast("string").alias("rendered"))


def ordered(op: str, a: Column, b) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}.get(op, F.lit(False))


def text_test(op: str, a: Column, b: str) -> Column:
    if op == "=~":
        java = java_regex(b)
        return a.rlike(java) if java is not None else F.lit(False)
    return ordered(op, a, b)


def number_test(op: str, a: Column, b: float) -> Column:
    if op in ("=", "!="):
        near = F.abs(a - F.lit(float(b)))
        return ~F.isnan(near) & ((near < EPSILON) if op == "=" else (near >= EPSILON))
    return ~F.isnan(a) & ordered(op, a, F.lit(float(b)))


def typed_test(op: str, v: Column, b) -> Column:
    """Values compare with their own kind; integers and floats with each other; other pairs never, not even for !=."""
    kind = v["kind"]
    if isinstance(b, bool):
        out = F.when(kind == "b", ordered(op, v["b"], F.lit(b)) if op in ("=", "!=") else F.lit(False))
    elif isinstance(b, str):
        out = F.when(kind == "s", text_test(op, v["s"], b))
    elif isinstance(b, int):
        out = F.when(kind == "i", ordered(op, v["i"], F.lit(b))).when(kind == "d", number_test(op, v["d"], b))
        out = out.when(kind == "s", F.coalesce(ordered(op, F.when(v["s"].rlike(r"^[+-]?\d{1,18}$"), v["s"].try_cast("bigint")), F.lit(b)), F.lit(False)))
    else:
        out = F.when(kind == "d", number_test(op, v["d"], b)).when(kind == "i", number_test(op, v["i"].cast("double"), b))
    return F.coalesce(out, F.lit(False))


def condition(c: Q.Condition) -> Column:
    if c.field == "duration":
        return ordered(c.op, F.greatest(F.col("duration_ns"), F.lit(0)), c.value)
    if c.field == "status":
        return ordered(c.op, F.col("status"), c.value)
    if c.field == "kind":
        return ordered(c.op, F.col("kind"), Q.KINDS[c.value])
    if c.field == "name":
        return text_test(c.op, F.col("name"), c.value)
    if c.field == "event_name":
        return F.exists("events", lambda e: text_test(c.op, e["name"], c.value))
    if c.field == "event":
        found = F.filter(F.flatten(F.transform("events", lambda e: e["attributes"])), lambda a: a["key"] == c.key)
        hit = F.exists(found, lambda a: typed_test(c.op, a["value"], c.value))
        return hit | (F.size(found) == 0) if c.op == "!=" else hit
    bare = c.key.split(".", 1)[1]
    value = F.get(F.filter("attributes", lambda a: a["key"].isin(c.key, bare)), F.lit(0))["value"]
    if c.key in ("resource.service.name",) and c.op in ("=", "!=", "=~") and isinstance(c.value, str):
        value = F.coalesce(value, text_value(F.col("service")))
    test = lambda v: F.when(v.isNull(), F.lit(c.op == "!=")).otherwise(typed_test(c.op, v, c.value))
    return F.get(F.transform(F.array(value), test), F.lit(0))  # the attribute is looked up once


def matches(s: Q.Selector) -> Column:
    out = F.lit(not s.any_of)
    for group in s.any_of:
        both = F.lit(True)
        for c in group:
            both = both & F.coalesce(condition(c), F.lit(False))
        out = both if s.any_of[0] is group else out | both
    return out


class Traces:
    def __init__(self, spans: DataFrame):
        self.spans, self.spark = spans, spans.sparkSession

    def query(self, text: str | Q.Query) -> DataFrame:
        """Matched spans, by trace; within one in order of arrival, for structural queries by span id."""
        q = Q.parse(text) if isinstance(text, str) else text
        if q.op is None:
            found, order = self.spans.filter(matches(q.left)), ["trace_id", "ingest_seq"]
        else:
            found, order = self.structural(q), ["trace_id", "span_id"]
        if q.stages:
            d = F.col("duration_ns").cast("decimal(38,0)")
            stats = found.groupBy("trace_id").agg(F.count("*").alias("n"), F.sum(d).alias("total"), F.max("duration_ns").alias("hi"), F.min("duration_ns").alias("lo"))
            average = F.expr("cast(total div n as bigint)")
            for s in q.stages:
                x = {"count": F.col("n"), "avg": average, "max": F.col("hi"), "min": F.col("lo")}[s.function]
                stats = stats.filter(ordered(s.op, x, s.value))
            found = found.join(stats.select("trace_id"), "trace_id", "left_semi")
        return found.orderBy(*order)

    def structural(self, q: Q.Query) -> DataFrame:
        """Right-hand spans that stand in the relation to a left-hand span of their trace, each span id once.

        Of spans that repeat an id the first arrival is returned and the last one's parent counts.
        """
        hit = F.coalesce(matches(q.left), F.lit(False))
        first = F.row_number().over(W.partitionBy("trace_id", "span_id").orderBy("ingest_seq"))
        right = self.spans.filter(matches(q.right)).withColumn("__n", first).filter("__n = 1").drop("__n")
        nodes = self.spans.select("trace_id", "span_id", "parent_span_id", "ingest_seq", hit.alias("left")).groupBy("trace_id", "span_id").agg(F.max_by("parent_span_id", "ingest_seq").alias("parent"), F.max("left").alias("left"))
        if q.op == ">":
            child = F.col("b.parent") == F.col("a.span_id")
        elif q.op == "~":
            child = F.col("b.parent").eqNullSafe(F.col("a.parent")) & (F.col("b.span_id") != F.col("a.span_id"))
        else:
            return right.join(self.descendants(nodes), ["trace_id", "span_id"], "left_semi")
        related = nodes.alias("b").join(nodes.filter("left").alias("a"), (F.col("a.trace_id") == F.col("b.trace_id")) & child, "left_semi")
        return right.join(related.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi")

    def descendants(self, nodes: DataFrame) -> DataFrame:
        """(trace_id, span_id) of ``nodes`` (trace_id, span_id, parent, left) that have another left node above them.

        Pointer doubling: each node knows an ancestor and the least and greatest left id on the way to it; a round joins it with
        what that ancestor knows, so the rounds are the logarithm of the depth.  Rounds are stored.  A cycle has no end; its
        nodes have seen all of it once the way is longer than the largest trace.
        """
        nodes = stored(nodes.join(nodes.filter("left").select("trace_id").distinct(), "trace_id", "left_semi"), "tree")
        largest = nodes.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
        parents = nodes.select("trace_id", F.col("span_id").alias("parent"), F.when(F.col("left"), F.col("span_id")).alias("lo"))
        ways = nodes.select("trace_id", "span_id", "parent").join(parents, ["trace_id", "parent"]).select("trace_id", "span_id", F.col("parent").alias("up"), "lo", F.col("lo").alias("hi"))
        ways = stored(ways, "ways")
        length = 1
        while length < largest:
            above = ways.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            longer = ways.filter("up is not null").join(above, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("up2").alias("up"), F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"))
            ways, length = stored(longer.unionByName(ways.filter("up is null")), "ways"), length * 2
            if not ways.filter("up is not null").head(1):
                break
        return ways.filter("lo <> span_id or hi <> span_id").select("trace_id", "span_id")

    def summaries(self, spans: DataFrame | None = None) -> DataFrame:
        """One row a trace: root, extent, span and error counts."""
        rank = F.struct(F.col("parent_span_id").isNotNull(), F.when(F.col("parent_span_id").isNull(), F.col("ingest_seq")).otherwise(F.col("start_ns")), F.col("ingest_seq"))
        root = F.min_by(F.struct("name", "service"), rank)
        t = (spans if spans is not None else self.spans).groupBy("trace_id").agg(root.alias("root"), F.min("start_ns").alias("start_ns"), F.max(F.col("start_ns") + F.col("duration_ns")).alias("end_ns"), F.count_if(F.col("status") == "error").alias("error_count"), F.count("*").alias("span_count"))
        duration = F.col("end_ns") - F.col("start_ns")
        return t.select("trace_id", F.col("root.name").alias("root_name"), F.col("root.service").alias("root_service"), "start_ns", duration.alias("duration_ns"), floor_div(duration, 1_000_000).alias("duration_ms"), "span_count", "error_count")

    def search(self, text: str = "", start_ns: int | None = None, end_ns: int | None = None, limit: int | None = None) -> DataFrame:
        """Trace summaries: of the matching traces by id, or without a query the most recent."""
        if not text.strip():
            t = self.summaries()
            if start_ns is not None:
                t = t.filter(F.col("start_ns") + F.col("duration_ns") >= start_ns)
            if end_ns is not None:
                t = t.filter(F.col("start_ns") <= end_ns)
            return t.orderBy(F.desc("start_ns"), "trace_id").limit(min(DEFAULT_LIMIT if limit is None else limit, MAX_LIMIT))
        hits = self.query(text)
        if start_ns is not None:
            hits = hits.filter(F.col("start_ns") + F.col("duration_ns") >= start_ns)
        if end_ns is not None:
            hits = hits.filter(F.col("start_ns") <= end_ns)
        ids = hits.groupBy("trace_id").agg(F.count("*").alias("matched")).orderBy("trace_id").limit(min(MAX_LIMIT if limit is None else limit, MAX_LIMIT))
        whole = self.spans.join(ids, "trace_id", "left_semi")
        return self.summaries(whole).join(ids, "trace_id").orderBy("trace_id")

    def trace(self, trace_id: str) -> DataFrame:
        if len(trace_id) != 32 or any(c not in "0123456789abcdefABCDEF" for c in trace_id):
            raise ValueError("a trace id has 32 hexadecimal digits")
        return self.spans.filter(F.col("trace_id") == trace_id.lower()).orderBy("ingest_seq")

    def levels(self) -> DataFrame:
        """(trace_id, span_id, root, depth) of every span id that has a way up to a root: a span without a parent in its trace.

        Pointer doubling as for :meth:`descendants`; a way that ends in a cycle has no root, and depths end at 127.
        """
        nodes = self.spans.groupBy("trace_id", "span_id").agg(F.max_by("parent_span_id", "ingest_seq").alias("up"))
        there = nodes.select("trace_id", F.col("span_id").alias("up"), F.lit(True).alias("there"))
        ways = nodes.join(there, ["trace_id", "up"], "left").select("trace_id", "span_id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), F.col("up")).otherwise(F.col("span_id")).alias("top"), F.when(F.col("there"), 1).otherwise(0).alias("depth"))
        ways, length = stored(ways, "ways"), 1
        while length < MAX_DEPTH and ways.filter("up is not null").head(1):
            above = ways.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"))
            longer = ways.filter("up is not null").join(above, ["trace_id", "up"]).select("trace_id", "span_id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"))
            ways, length = stored(longer.unionByName(ways.filter("up is null")), "ways"), length * 2
        return ways.filter(F.col("up").isNull() & (F.col("depth") < MAX_DEPTH)).select("trace_id", "span_id", F.col("top").alias("root"), "depth")

    def tree(self, trace_id: str) -> list[dict]:
        """The span tree of one trace: spans without a parent in it are roots; deeper than 128 levels is cut off."""
        rows = [r.asDict() for r in self.trace(trace_id).select("span_id", "parent_span_id", "name", "service", "start_ns", "duration_ns", "status").collect()]
        ids, children = {r["span_id"] for r in rows}, {}
        for r in rows:
            children.setdefault(r["parent_span_id"] if r["parent_span_id"] in ids else None, []).append(r)

        def below(parent, depth):
            if depth >= MAX_DEPTH:
                return []
            return [r | {"children": below(r["span_id"], depth + 1)} for r in sorted(children.get(parent, []), key=lambda r: r["start_ns"])]

        return below(None, 0)

    def waterfall(self, trace_id: str) -> DataFrame:
        """Spans of one trace with their offset from its start and their depth; a span that has no way up to a root is a root.

        Spans without a start are left out of the trace's extent, and offsets lie within it.
        """
        rows = self.trace(trace_id).drop("attributes", "events", "links")
        timed, end = F.col("start_ns") > 0, F.col("start_ns") + F.col("duration_ns")
        low, high = F.coalesce(F.min(F.when(timed, F.col("start_ns"))), F.min("start_ns")), F.coalesce(F.max(F.when(timed, end)), F.max(end))
        extent = rows.agg(low.alias("low"), F.greatest(low, high).alias("high"))  # one row
        depth = Traces(rows).levels().select("trace_id", "span_id", "depth")
        offset = F.greatest(F.lit(0), F.least(F.col("start_ns") - F.col("low"), F.col("high") - F.col("low")))
        out = rows.join(depth, ["trace_id", "span_id"], "left").join(extent)
        return out.select("span_id", "parent_span_id", "name", "service", "status", offset.alias("offset_ns"), F.greatest(F.lit(0), "duration_ns").alias("duration_ns"), F.coalesce("depth", F.lit(0)).alias("depth")).orderBy("offset_ns", "name", "span_id")

    @staticmethod
    def ordered(found: DataFrame, mode: str = "recent") -> DataFrame:
        """Trace summaries by start, duration or errors, the most first."""
        by = {"recent": ["start_ns"], "slowest": ["duration_ns"], "errors": ["error_count", "start_ns"]}[mode]
        return found.orderBy(*[F.desc(c) for c in by], "trace_id")

    def operations(self) -> DataFrame:
        """Spans and errors of each (service, operation)."""
        return self.spans.groupBy("service", "name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"))

    def with_exceptions(self) -> DataFrame:
        exceptional = F.exists("events", lambda e: (e["name"] == "exception") | F.exists(e["attributes"], lambda a: a["key"].startswith("exception.")))
        return self.spans.filter(exceptional)
