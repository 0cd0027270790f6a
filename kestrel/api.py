"""The query, report, ingestion and management endpoints over a store folder: (method, path, parameters, body) -> (status, document).

Answers are collected, so every one has a bound: limits of the query languages, step caps, or a report's own.  ``python -m
kestrel.api ROOT`` serves them over HTTP from one Spark session.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels as L
from .functions import responses, units
from .operators import retention
from .operators.logs import DEFAULT_LIMIT, Logs
from .operators.metrics import Metrics
from .operators.reports import Reports, UnknownService
from .operators.traces import ATTRIBUTES, SPANS, Traces
from .plans import log_query
from .plans.grid import MAX_STEPS
from .sources import ingest, store, wire

SCHEMAS = {
    "logs": f"key {L.KEY_TYPE}, labels map<string,string>, service string, level string, ts_ns long, line string, trace_id string, span_id string, severity_number int, severity_text string, attributes {ATTRIBUTES}, ingest_seq long",
    "samples": f"metric string, key {L.KEY_TYPE}, labels map<string,string>, ts_ms long, value double, ingest_seq long",
    "spans": SPANS,
    "metadata": "metric string, type string, help string, unit string, source_name string",
}
HOUR_NS = 3_600_000_000_000
ROUTES: list[tuple[str, re.Pattern, str]] = []


class Problem(Exception):
    """An answer that isn't a success."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def route(method: str, pattern: str) -> Callable:
    def keep(f: Callable) -> Callable:
        ROUTES.append((method, re.compile(pattern + r"\Z"), f.__name__))
        return f

    return keep


def parsed(params: dict, name: str, read: Callable, default=None):
    """A parameter read with ``read``; one that can't be read is the caller's fault."""
    if params.get(name) in (None, ""):
        return default
    try:
        return read(params[name])
    except ValueError:
        raise Problem(400, f"invalid {name}: {params[name]}") from None


def capped(start: int, end: int, step: int | None) -> None:
    if step is not None and step <= 0:
        raise Problem(400, "step must be positive")
    if step is not None and (n := max(0, end - start) // step) >= MAX_STEPS:
        raise Problem(400, f"query would produce {n} steps, exceeding maximum of {MAX_STEPS}")


def listed(df: DataFrame, column: str) -> list:
    return sorted(r[0] for r in df.select(column).collect())


def success(data) -> dict:
    return {"status": "success", "data": data}


class Api:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = time.time_ns):
        self.spark, self.root, self.clock, self.since = spark, root, clock, clock()

    # -- the store

    def table(self, signal: str) -> DataFrame:
        if not store.exists(self.spark, self.root, signal):
            return self.spark.createDataFrame([], SCHEMAS[signal])
        return store.load(self.spark, self.root, signal)

    @property
    def logs(self) -> Logs:
        return Logs(self.table("logs"), ("service", "level"))

    @property
    def metrics(self) -> Metrics:
        return Metrics(self.table("samples"))

    @property
    def traces(self) -> Traces:
        return Traces(self.table("spans"))

    @property
    def reports(self) -> Reports:
        return Reports(self.table("logs"), self.table("samples"), self.table("spans"))

    def request(self, method: str, path: str, params: dict | None = None, body: bytes | None = None) -> tuple[int, dict | None]:
        known = False
        for verb, pattern, name in ROUTES:
            m = pattern.match(path)
            if not m:
                continue
            known = True
            if verb == method or (verb == "GET" and method == "POST"):
                args = {"body": body} if verb == "POST" else {}
                try:
                    out = getattr(self, name)(params or {}, *m.groups(), **args)
                    return (204, None) if out is None else (200, out)
                except Problem as e:
                    return e.status, {"status": "error", "error": str(e)}
                except UnknownService as e:
                    return 404, {"status": "error", "error": str(e)}
                except ValueError as e:
                    return 400, {"status": "error", "errorType": "bad_data", "error": str(e)}
        return (405 if known else 404), None

    # -- logs

    @route("GET", "/loki/api/v1/query")
    def log_instant(self, p: dict) -> dict:
        at = parsed(p, "time", units.epoch_ns, self.clock())
        return self._logs(p.get("query", ""), at - HOUR_NS, at, None, parsed(p, "limit", int, DEFAULT_LIMIT))

    @route("GET", "/loki/api/v1/query_range")
    def log_range(self, p: dict) -> dict:
        now = self.clock()
        start, end = parsed(p, "start", units.epoch_ns, now - HOUR_NS), parsed(p, "end", units.epoch_ns, now)
        return self._logs(p.get("query", ""), start, end, parsed(p, "step", units.duration_ns), parsed(p, "limit", int, DEFAULT_LIMIT))

    def _logs(self, text: str, start: int, end: int, step: int | None, limit: int) -> dict:
        q = log_query.parse(text)
        capped(start, start, step)
        if isinstance(q, log_query.Metric):
            capped(start, end, q.range_ns if step is None else step)
            return responses.matrix(self.logs.matrix(q, start, end, step), 10**9)
        return responses.streams(self.logs.streams(q, start, end, limit))

    @route("GET", "/loki/api/v1/labels")
    def log_labels(self, p: dict) -> dict:
        return success(listed(self.logs.label_names(), "name"))

    @route("GET", "/loki/api/v1/label/([^/]+)/values")
    def log_label(self, p: dict, name: str) -> dict:
        return success(listed(self.logs.label_values(name), "value"))

    # -- metrics

    @route("GET", "/api/v1/query")
    def metric_instant(self, p: dict) -> dict:
        at, m = parsed(p, "time", units.epoch_ms), self.metrics
        if at is None:
            at = m.samples.agg(F.max("ts_ms")).first()[0] or self.clock() // 10**6
        out = m.instant(p.get("query", ""), at)
        if isinstance(out, float):
            return responses.scalar(out, at)
        return responses.matrix(out.df) if out.ranged else responses.vector(out.df)

    @route("GET", "/api/v1/query_range")
    def metric_range(self, p: dict) -> dict:
        now = self.clock() // 10**6
        start, end = parsed(p, "start", units.epoch_ms, now - HOUR_NS // 10**6), parsed(p, "end", units.epoch_ms, now)
        step = parsed(p, "step", units.duration_ns, 60 * 10**9) // 10**6
        capped(start, end, step)
        out = self.metrics.range(p.get("query", ""), start, end, step)
        return responses.scalar(out, end) if isinstance(out, float) else responses.matrix(out.df)

    @route("GET", "/api/v1/series")
    def metric_series(self, p: dict) -> dict:
        wanted = p.get("match[]") or ['{__name__=~".*"}']
        start, end = parsed(p, "start", units.epoch_ms), parsed(p, "end", units.epoch_ms)
        rows = self.metrics.series([wanted] if isinstance(wanted, str) else wanted, start, end).collect()
        return success([responses.labels(r["key"]) for r in rows])

    @route("GET", "/api/v1/labels")
    def metric_labels(self, p: dict) -> dict:
        return success(listed(self.metrics.label_names(), "name"))

    @route("GET", "/api/v1/label/([^/]+)/values")
    def metric_label(self, p: dict, name: str) -> dict:
        return success(listed(self.metrics.label_values(name), "value"))

    @route("GET", "/api/v1/metadata")
    def metric_metadata(self, p: dict) -> dict:
        rows = self.reports.metadata(self.table("metadata")).collect()
        return success({r["metric"]: [{"type": r["type"], "help": r["help"], "unit": r["unit"]}] for r in rows})

    # -- traces

    @route("GET", "/api/search")
    def search(self, p: dict) -> dict:
        at = lambda text: units.trace_epoch_ns(int(text))
        return responses.search(self.traces.search(p.get("q", ""), parsed(p, "start", at), parsed(p, "end", at), parsed(p, "limit", int)))

    @route("GET", "/api/traces/([^/]+)")
    def trace(self, p: dict, trace_id: str) -> dict:
        out = responses.trace(self.traces.trace(trace_id.strip()))
        if not out["batches"]:
            raise Problem(404, "trace not found")
        return out

    # -- reports

    def service(self, p: dict) -> str:
        if not p.get("service"):
            raise Problem(400, "missing parameter: service")
        return p["service"]

    @route("GET", "/ready")
    def ready(self, p: dict) -> dict:
        return {"status": "ready"}

    @route("GET", "/api/v1/services")
    def services(self, p: dict) -> dict:
        rows = self.reports.services().orderBy("name").collect()
        return success({"services": [{"name": r["name"], "signals": r["signals"]} for r in rows]})

    @route("GET", "/api/v1/status")
    def status(self, p: dict) -> dict:
        r = self.reports.status().first()
        sizes = {signal: store.size(self.spark, self.root, signal) for signal in ("logs", "samples", "spans")}
        return success({
            "totalLogEntries": r["log_entries"], "totalMetricSeries": r["series"], "totalMetricSamples": r["samples"], "totalSpans": r["spans"], "totalTraces": r["traces"], "serviceCount": r["services"],
            "uptimeSeconds": (self.clock() - self.since) // 10**9, "memoryBytes": sum(sizes.values()), "logMemoryBytes": sizes["logs"], "metricMemoryBytes": sizes["samples"], "traceMemoryBytes": sizes["spans"],
        })

    @route("GET", "/api/v1/catalog")
    def catalog(self, p: dict) -> dict:
        found: dict[str, list] = {"metric": [], "log_label": [], "span_attribute": []}
        for r in self.reports.catalog(self.service(p)).orderBy("kind", "name").collect():
            found[r["kind"]].append(r["name"])
        return success({"metrics": found["metric"], "log_labels": found["log_label"], "span_attributes": found["span_attribute"]})

    @route("GET", "/api/v1/summary")
    def summary(self, p: dict) -> dict:
        name, r = self.service(p), self.reports
        logs = [{"timestamp": str(x["ts_ns"]), "line": x["line"]} for x in r.recent_errors(name, self.clock(), 20).collect()]
        metrics = [{"series": x["series"], "timestampMs": str(x["ts_ms"]), "value": x["value"]} for x in r.notable_metrics(name).collect()]
        traces = [{"traceID": x["trace_id"], "rootSpanName": x["root_name"], "durationMs": x["duration_ns"] / 1e6} for x in r.failing_traces(name).collect()]
        return success({"service": name, "logs": logs, "metrics": metrics, "traces": traces})

    @route("GET", "/api/v1/diagnose")
    def diagnose(self, p: dict) -> dict:
        r, now, name = self.reports, self.clock(), p.get("service")
        if not name:
            return {"services": [{"service": x["service"], "health_score": x["health"], "top_issue": x["top_issue"]} for x in r.diagnose_all(now).collect()]}
        d = r.diagnose(name, now).first()
        errors = [{"timestamp": str(x["ts_ns"]), "line": x["line"]} for x in r.recent_errors(name, now).collect()]
        slowest = [{"traceID": x["trace_id"], "rootSpanName": x["root_name"], "durationMs": x["duration_ns"] / 1e6} for x in r.slowest(name).collect()]
        key = [{"series": x["series"], "sparkline": x["points"]} for x in r.key_metrics(name).orderBy("series").collect()]
        return {
            "service": name, "health_score": d["health"], "health_factors": {"error_rate_pct": d["error_percent"], "latency_p99_ms": d["p99_ms"], "span_error_ratio": d["span_error_ratio"]}, "slowest_traces": slowest,
            "error_trend": [{"current_5m": d["recent"], "previous_5m": d["before"], "direction": d["direction"]}], "recent_errors": errors, "key_metrics": key,
            "suggested_queries": r.suggestions(name, bool(errors), d["span_error_ratio"] > 0, d["p99_ms"] > 1000),
        }

    # -- ingestion

    def requests(self, kind: str, body: bytes | None) -> DataFrame:
        text = wire.json_body(kind, body)
        if text is None:
            raise Problem(400, "the body can't be read")
        return self.spark.createDataFrame([(text,)], "body string")

    def keep(self, signal: str, rows: DataFrame) -> DataFrame:
        """Rows, numbered on from the last arrival, in the store."""
        first = self.reports.checkpoint()
        rows = rows.withColumn("ingest_seq", F.col("ingest_seq") + F.lit(first)).select(*self.spark.createDataFrame([], SCHEMAS[signal]).columns).persist()
        if rows.head(1):
            store.append(rows, self.root, signal)
        return rows

    @route("POST", "/loki/api/v1/push")
    def push(self, p: dict, body: bytes | None) -> dict:
        rows = self.keep("logs", ingest.push(self.requests("push", body)))
        return {"accepted": {"streams": rows.select("key").distinct().count(), "entries": rows.count()}}

    @route("POST", "/v1/logs")
    def push_logs(self, p: dict, body: bytes | None) -> None:
        self.keep("logs", ingest.export_logs(self.requests("export_logs", body), self.clock()))

    @route("POST", "/v1/metrics")
    def push_metrics(self, p: dict, body: bytes | None) -> dict:
        rows, metadata = ingest.export_metrics(self.requests("export_metrics", body))
        known = self.table("metadata")
        clash = ingest.name_collisions(metadata, known).orderBy("metric").first()
        if clash:
            raise Problem(400, f"several metrics would be named {clash['metric']}")
        store.replace(ingest.upsert_metadata(known, metadata), self.root, "metadata")
        n = self.keep("samples", rows).count()
        return {"accepted": {"series": n, "samples": n}}

    @route("POST", "/v1/traces")
    def push_traces(self, p: dict, body: bytes | None) -> dict:
        rows = self.keep("spans", ingest.export_traces(self.requests("export_traces", body)))
        return {"accepted": {"traces": rows.select("trace_id").distinct().count(), "spans": rows.count()}}

    @route("POST", "/api/v1/write")
    def write(self, p: dict, body: bytes | None) -> None:
        try:
            ingest.write_request(body or b"")
        except (ValueError, IndexError):
            raise Problem(400, "the body can't be read") from None
        self.keep("samples", ingest.remote_write(self.spark.createDataFrame([(bytearray(body or b""),)], "body binary")))

    # -- management

    @route("DELETE", "/api/v1/reset")
    def reset(self, p: dict) -> dict:
        for signal in ("logs", "samples", "spans"):
            rows, name = self.table(signal), p.get("service")
            store.replace(retention.without_service(rows, name) if name else rows.limit(0), self.root, signal)
        return {}

    @route("POST", "/api/v1/snapshot")
    def snapshot(self, p: dict, body: bytes | None = None) -> dict:
        path = f"{self.root}/snapshots/{self.clock()}"
        store.save_snapshot({s: self.table(s) for s in SCHEMAS}, path)
        return {"status": "ok", "bytes": sum(store.size(self.spark, path, s) for s in SCHEMAS)}

    def evict(self, keep_ns: int, logs: int = 100_000, series: int = 10_000, spans: int = 100_000) -> None:
        """What retention leaves: by age, then by the caps on entries, series and spans."""
        cut = self.clock() - keep_ns
        store.replace(retention.cap_logs(retention.by_age(self.table("logs"), "ts_ns", cut), logs), self.root, "logs")
        samples = retention.cap_series(retention.by_age(self.table("samples"), "ts_ms", cut // 10**6), series)
        store.replace(samples, self.root, "samples")
        store.replace(retention.prune_metadata(self.table("metadata"), self.table("samples")), self.root, "metadata")
        store.replace(retention.cap_spans(retention.by_age(self.table("spans"), "start_ns", cut), spans), self.root, "spans")


def serve(api: Api, host: str = "127.0.0.1", port: int = 4320):
    """An HTTP server of the endpoints; the caller runs ``serve_forever``."""
    import json
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, unquote, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            at = urlsplit(self.path)
            size = int(self.headers.get("Content-Length") or 0)
            if size > wire.MOST_BYTES:
                self.send_error(413)
                return
            body, query = self.rfile.read(size), at.query
            if "form-urlencoded" in self.headers.get("Content-Type", ""):
                query = f"{query}&{body.decode()}"
            params = {k: v if k == "match[]" else v[-1] for k, v in parse_qs(query, keep_blank_values=True).items()}
            status, out = api.request(self.command, unquote(at.path), params, body)
            data = b"" if out is None else json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


if __name__ == "__main__":
    import sys

    serve(Api(SparkSession.builder.appName("kestrel").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1])).serve_forever()
