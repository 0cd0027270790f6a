"""Cross-signal reports: fixed plans over logs, samples and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from .logs import Logs
from .traces import Traces

HOUR_NS, MINUTE_NS = 3_600_000_000_000, 60_000_000_000
NOTABLE = r"(?i)error|fail|duration|latency"
MOST_SHOWN = 100


class UnknownService(ValueError):
    """A report on a service that no signal knows; lists those that are known."""


class Reports:
    """``logs`` need service, level; ``samples`` and ``spans`` as elsewhere."""

    def __init__(self, logs: DataFrame, samples: DataFrame, spans: DataFrame):
        self.logs, self.samples, self.spans, self.traces = logs, samples, spans, Traces(spans)

    def services(self) -> DataFrame:
        """(name, signals): every service with the sorted signals that know it."""
        parts = [(self.logs, F.col("labels")["service"], "logs"), (self.samples, F.col("labels")["service"], "metrics"), (self.spans, F.col("service"), "traces")]
        rows = None
        for df, col, signal in parts:
            part = df.select(col.alias("name")).filter("name is not null").distinct().withColumn("signal", F.lit(signal))
            rows = part if rows is None else rows.union(part)
        return rows.groupBy("name").agg(F.array_sort(F.collect_set("signal")).alias("signals"))

    def status(self) -> DataFrame:
        """One row of counts."""
        l = self.logs.agg(F.count("*").alias("log_entries"), F.count_distinct("key").alias("log_streams"))
        m = self.samples.agg(F.count("*").alias("samples"), F.count_distinct("key").alias("series"))
        t = self.spans.agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"))
        s = self.services().agg(F.count("*").alias("services"))
        return l.join(m).join(t).join(s)  # one row each

    def catalog(self, service: str) -> DataFrame:
        """(kind, name): metric names, log label keys and span attribute keys of a service."""
        m = self.samples.filter(F.col("labels")["service"] == service).select(F.lit("metric").alias("kind"), F.col("metric").alias("name"))
        l = self.logs.filter(F.col("service") == service).select(F.lit("log_label").alias("kind"), F.explode(F.map_keys("labels")).alias("name"))
        t = self.spans.filter(F.col("service") == service).select(F.lit("span_attribute").alias("kind"), F.explode(F.transform("attributes", lambda a: a["key"])).alias("name"))
        return m.distinct().union(l.distinct()).union(t.distinct())

    def describe(self, service: str, most: int = 50) -> DataFrame:
        """(label, values, truncated): log label values of a service, at most ``most`` of each shown."""
        rows = self.logs.filter(F.col("service") == service).select(F.explode("labels").alias("label", "value")).distinct()
        ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("value"))).filter(F.col("n") <= most + 1)
        values = F.array_sort(F.collect_list("value"))
        return ranked.groupBy("label").agg(F.slice(values, 1, most).alias("values"), (F.count("*") > most).alias("truncated"))

    def metadata(self, known: DataFrame | None = None) -> DataFrame:
        """(metric, type, help, unit) of every metric name, with defaults."""
        names = self.samples.select("metric").distinct()
        if known is None:
            return names.select("metric", F.lit("unknown").alias("type"), F.lit("").alias("help"), F.lit("").alias("unit"))
        both = names.join(known, "metric", "full")
        return both.select("metric", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("help", F.lit("")).alias("help"), F.coalesce("unit", F.lit("")).alias("unit"))

    # -- diagnosis

    def require(self, service: str) -> None:
        if not self.services().filter(F.col("name") == service).head(1):
            known = [r["name"] for r in self.services().orderBy("name").limit(50).collect()]
            raise UnknownService(f"no service {service!r}; known: {', '.join(known)}")

    def error_rate(self, now_ns: int, service: str | None = None) -> DataFrame:
        """(service, total, errors, error_percent) of the last hour's log entries."""
        rows = self.logs.filter(F.col("ts_ns").between(now_ns - HOUR_NS, now_ns))
        rows = rows.filter(F.col("service") == service) if service else rows
        t = rows.groupBy("service").agg(F.count("*").alias("total"), F.count_if(F.col("level") == "error").alias("errors"))
        return t.withColumn("error_percent", F.col("errors") / F.col("total") * 100)

    def recent_errors(self, service: str, now_ns: int, n: int = 10, horizon_ns: int | None = HOUR_NS) -> DataFrame:
        rows = self.logs.filter((F.col("service") == service) & (F.col("level") == "error"))
        rows = rows.filter(F.col("ts_ns").between(now_ns - horizon_ns, now_ns)) if horizon_ns is not None else rows
        return rows.orderBy(F.desc("ts_ns"), F.desc("ingest_seq")).limit(n).select("ts_ns", "line", "ingest_seq")

    def error_trend(self, service: str, now_ns: int) -> DataFrame:
        """Errors of the last five minutes against the five before; the instant between counts in both."""
        errors = self.logs.filter((F.col("service") == service) & (F.col("level") == "error"))
        cut = now_ns - 5 * MINUTE_NS
        t = errors.agg(F.count_if(F.col("ts_ns").between(cut, now_ns)).alias("recent"), F.count_if(F.col("ts_ns").between(now_ns - 10 * MINUTE_NS, cut)).alias("before"))
        return t.withColumn("direction", F.when(F.col("recent") > F.col("before"), "increasing").when(F.col("recent") < F.col("before"), "decreasing").otherwise("stable"))

    def touched(self, service: str) -> DataFrame:
        """All spans of the traces that have a span of the service."""
        return self.spans.join(self.spans.filter(F.col("service") == service).select("trace_id"), "trace_id", "left_semi")

    def slowest(self, service: str, n: int = 5) -> DataFrame:
        return self.traces.summaries(self.touched(service)).orderBy(F.desc("duration_ns"), "trace_id").limit(n)

    def latency(self, service: str) -> DataFrame:
        """One row: traces, spans, error spans and the nearest-rank 99th percentile of trace durations."""
        t = self.traces.summaries(self.touched(service))
        p99 = F.expr("percentile_disc(0.99) within group (order by duration_ns)")
        return t.agg(F.count("*").alias("traces"), F.coalesce(F.sum("span_count"), F.lit(0)).alias("spans"), F.coalesce(F.sum("error_count"), F.lit(0)).alias("error_spans"), p99.cast("long").alias("p99_ns"))

    def diagnose(self, service: str, now_ns: int) -> DataFrame:
        """One row: the service's rates and its health score."""
        rate = self.error_rate(now_ns, service).agg(F.coalesce(F.max("error_percent"), F.lit(0.0)).alias("error_percent"))
        t = rate.join(self.latency(service)).join(self.error_trend(service, now_ns).select("recent", "before", "direction"))
        ratio = F.when(F.col("spans") > 0, F.col("error_spans") / F.col("spans")).otherwise(0.0)
        p99 = F.coalesce(F.col("p99_ns"), F.lit(0)) / 1e6
        slow = F.when(p99 > 1000, F.least((p99 - 1000) / 1000 * 10, F.lit(20.0))).otherwise(0.0)
        score = 100 - F.least("error_percent", F.lit(40.0)) - F.least(ratio * 30, F.lit(30.0)) - slow
        return t.select(F.lit(service).alias("service"), "error_percent", ratio.alias("span_error_ratio"), p99.alias("p99_ms"), "recent", "before", "direction", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("health"))

    def per_trace_services(self) -> DataFrame:
        """(service, spans, error_spans): each service is credited with all spans of the traces it appears in."""
        t = self.spans.groupBy("trace_id").agg(F.collect_set("service").alias("services"), F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("bad"))
        return t.select(F.explode("services").alias("service"), "n", "bad").groupBy("service").agg(F.sum("n").alias("spans"), F.sum("bad").alias("error_spans"))

    def diagnose_all(self, now_ns: int) -> DataFrame:
        """(service, error_percent, span_error_ratio, health) of all services, worst first."""
        names = self.services().select(F.col("name").alias("service"))
        t = names.join(self.error_rate(now_ns), "service", "left").join(self.per_trace_services(), "service", "left")
        rate = F.coalesce("error_percent", F.lit(0.0))
        ratio = F.coalesce(F.when(F.col("spans") > 0, F.col("error_spans") / F.col("spans")), F.lit(0.0))
        score = F.greatest(F.lit(0.0), 100 - F.least(rate, F.lit(40.0)) - F.least(ratio * 30, F.lit(30.0)))
        percent = lambda x: F.concat(F.format_number(x, 1), F.lit("%"))
        logs, spans = F.concat(F.lit("og error rate: "), percent(rate)), F.concat(F.lit("Span error ratio: "), percent(ratio * 100))
        issue = F.when(rate > 10, F.concat(F.lit("High l"), logs)).when(ratio > 0.1, spans).when(rate > 0, F.concat(F.lit("L"), logs)).when(ratio > 0, spans).otherwise("No issues detected")
        return t.select("service", rate.alias("error_percent"), ratio.alias("span_error_ratio"), score.alias("health"), issue.alias("top_issue")).orderBy("health", "service")

    def check_health(self, since: int = 0) -> DataFrame:
        """(service, errors, span_error_ratio, health): 100 less at most 30 for failing spans and 40 for error entries."""
        names = self.services().select(F.col("name").alias("service"))
        e = self.logs.filter((F.col("level") == "error") & (F.col("ingest_seq") >= since)).groupBy("service").agg(F.count("*").alias("errors"))
        t = names.join(e, "service", "left").join(self.per_trace_services(), "service", "left")
        errors, ratio = F.coalesce("errors", F.lit(0)), F.coalesce(F.when(F.col("spans") > 0, F.col("error_spans") / F.col("spans")), F.lit(0.0))
        score = F.greatest(F.lit(0.0), 100 - F.least(ratio * 30, F.lit(30.0)) - F.least(errors, F.lit(40)))
        return t.select("service", errors.alias("errors"), ratio.alias("span_error_ratio"), score.alias("health")).orderBy("health", "service")

    def key_metrics(self, service: str, n: int = 10) -> DataFrame:
        """(series, points): the last ``n`` values of every series of the service, in time order."""
        w = W.partitionBy("key").orderBy(F.desc("ts_ms"), F.desc("ingest_seq"))
        rows = self.samples.filter(F.col("labels")["service"] == service).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)
        points = F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "ingest_seq", "value"))), lambda x: x["value"])
        return rows.groupBy("key").agg(points.alias("points")).select(L.text(F.col("key")).alias("series"), "points")

    def notable_metrics(self, service: str, n: int = 20) -> DataFrame:
        """Last samples of series whose name tells of errors or latency, newest first."""
        rows = self.samples.filter((F.col("labels")["service"] == service) & F.col("metric").rlike(NOTABLE))
        last = rows.groupBy("key").agg(F.max_by(F.struct("ts_ms", "value"), F.struct("ts_ms", "ingest_seq")).alias("z"))
        return last.select(L.text(F.col("key")).alias("series"), "z.ts_ms", "z.value").orderBy(F.desc(F.col("ts_ms").cast("string")), "series").limit(n)

    def failing_traces(self, service: str, n: int = 20) -> DataFrame:
        """Traces in which a span of the service failed, slowest first."""
        failed = self.spans.filter((F.col("service") == service) & (F.col("status") == "error")).select("trace_id")
        return self.traces.summaries(self.spans.join(failed, "trace_id", "left_semi")).orderBy(F.desc("duration_ns"), "trace_id").limit(n)

    def checkpoint(self) -> int:
        """The next arrival number: what has arrived since is at or above it."""
        tops = [df.agg(F.max("ingest_seq")).first()[0] for df in (self.logs, self.samples, self.spans)]
        return max((t for t in tops if t is not None), default=-1) + 1

    def since(self, checkpoint: int) -> Reports:
        """The same reports over what arrived at or after a checkpoint."""
        new = lambda df: df.filter(F.col("ingest_seq") >= checkpoint)
        return Reports(new(self.logs), new(self.samples), new(self.spans))

    def suggestions(self, service: str, errors: bool = True, failing: bool = True, slow: bool = True) -> list[str]:
        """Queries that show what a diagnosis found, or all of the service's logs if it found nothing."""
        name = quoted(service)
        found = [(errors, f'{{service="{name}", level="error"}}'), (failing, f'{{ resource.service.name = "{name}" && status = error }}'), (slow, f'{{ resource.service.name = "{name}" && duration > 1s }}')]
        return [q for wanted, q in found if wanted] or [f'{{service="{name}"}}']

    # -- activity since a checkpoint, and searches by their parts

    def activity(self, service: str, since: int = 0) -> DataFrame:
        """One row: a service's entries, errors and traces that arrived at or after ``since``, and its health by them."""
        new = F.col("ingest_seq") >= since
        l = self.logs.filter((F.col("service") == service) & new).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count("*").alias("entries"))
        per = self.touched(service).filter(new).groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("bad"))
        t = per.agg(F.count_if(F.col("bad") > 0).alias("failing_traces"), F.count("*").alias("traces"), F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0)).alias("ratio"))
        health = F.greatest(F.lit(0.0), 100 - F.least(F.col("ratio") * 30, F.lit(30.0)) - F.least("errors", F.lit(40)))
        says = F.concat(F.col("errors").cast("string"), F.lit(" error log(s), "), F.col("failing_traces").cast("string"), F.lit(" failing trace(s), health "), F.format_number(health, 0))
        return l.join(t).select(F.lit(service).alias("service"), "errors", "entries", "failing_traces", "traces", F.col("ratio").alias("span_error_ratio"), health.alias("health"), says.alias("summary"))  # one row each

    def describe_metrics(self, service: str, known: DataFrame) -> DataFrame:
        """(metric, type, help, unit) of a service's metrics; null where ``known`` has none."""
        names = self.samples.filter(F.col("labels")["service"] == service).select("metric").distinct()
        return names.join(known.select("metric", "type", "help", "unit"), "metric", "left")

    def query_logs(self, service: str | None = None, level: str | None = None, contains: str | None = None, limit: int = 50, query: str | None = None) -> tuple[DataFrame, int, bool]:
        """(entries, how many there are in all, truncated) of a search by its parts, or by a whole query, which wins.

        All matches are counted only if there are more than ``limit``, of 100 at most.
        """
        if query is None:
            parts = [f'{k}="{quoted(v)}"' for k, v in (("service", service), ("level", level)) if v is not None]
            if not parts:
                raise ValueError("give a service or a level, or a query")
            query = "{" + ", ".join(parts) + "}" + (f' |= "{quoted(contains)}"' if contains is not None else "")
        limit, logs = min(limit, MOST_SHOWN), Logs(self.logs, tuple(c for c in ("service", "level") if c in self.logs.columns))
        found = logs.streams(query, -(2**63), 2**63 - 1, limit + 1)
        n = found.count()
        if n <= limit:
            return found, n, False
        return logs.streams(query, -(2**63), 2**63 - 1, limit), logs.streams(query, -(2**63), 2**63 - 1, None).count(), True

    def query_traces(self, service: str | None = None, name: str | None = None, status: str | None = None, min_duration: str | None = None, limit: int = 50, query: str | None = None) -> tuple[DataFrame, int, bool]:
        """(summaries by trace id, how many there are in all, truncated) of a search by its parts, or by a whole query."""
        if query is None:
            if status not in (None, "error", "ok", "unset"):
                raise ValueError(f"no status {status!r}")
            texts = [(service, 'resource.service.name = "{}"'), (status, "status = {}"), (min_duration, "duration > {}"), (name, 'name = "{}"')]
            parts = [form.format(quoted(v)) for v, form in texts if v is not None]
            if not parts:
                raise ValueError("give a service, a name, a status or a duration, or a query")
            query = "{ " + " && ".join(parts) + " }"
        limit = min(limit, MOST_SHOWN)
        total = self.traces.query(query).select("trace_id").distinct().count()
        return self.traces.search(query, limit=limit), total, total > limit


def quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"')
