"""Results as the query APIs' JSON documents.  Rows are collected, so callers limit them first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from .units import number_text


def labels(key) -> dict[str, str]:
    return {e["key"]: e["value"] for e in key}


def vector(df: DataFrame) -> dict:
    """Instant vector: one point a series, numbers as strings."""
    rows = df.orderBy("key", "t").collect()
    return {"status": "success", "data": {"resultType": "vector", "result": [{"metric": labels(r["key"]), "value": [r["t"] / 1000, number_text(r["value"])]} for r in rows]}}


def _by_series(rows: Iterable, per_second: int) -> list[dict]:
    out: list[dict] = []
    for r in rows:
        metric = labels(r["key"])
        if not out or out[-1]["metric"] != metric:
            out.append({"metric": metric, "values": []})
        out[-1]["values"].append([r["t"] / per_second, number_text(r["value"])])
    return out


def matrix(df: DataFrame, per_second: int = 1000) -> dict:
    return {"status": "success", "data": {"resultType": "matrix", "result": _by_series(df.orderBy("key", "t").collect(), per_second)}}


def scalar(value: float, t_ms: int) -> dict:
    return {"status": "success", "data": {"resultType": "scalar", "result": [t_ms / 1000, number_text(value)]}}


def streams(df: DataFrame) -> dict:
    """Log streams: times as strings of nanoseconds; entries carry metadata only where they have some."""
    out: list[dict] = []
    for r in df.collect():
        row = r.asDict(recursive=True)
        stream = labels(row["key"])
        if not out or out[-1]["stream"] != stream:
            out.append({"stream": stream, "values": []})
        meta = {a["key"]: a["value"]["rendered"] for a in row.get("attributes") or []}
        meta |= {k: str(row[k]) for k in ("severity_number", "severity_text", "trace_id", "span_id") if row.get(k)}
        out[-1]["values"].append([str(row["ts_ns"]), row["line"], *([meta] if meta else [])])
    return {"status": "success", "data": {"resultType": "streams", "result": out}}


def search(summaries: DataFrame) -> dict:
    rows = [r.asDict() for r in summaries.collect()]
    return {"traces": [{"traceID": r["trace_id"], "rootServiceName": r["root_service"], "rootTraceName": r["root_name"], "startTimeUnixNano": str(r["start_ns"]), "durationMs": r["duration_ms"], "spanCount": r["span_count"], "errorCount": r["error_count"]} | ({"matched": r["matched"]} if "matched" in r else {}) for r in rows]}


def trace(spans: DataFrame) -> dict:
    """A trace's spans by service, services in order of arrival; attribute values as strings."""
    groups: dict[str, list] = {}
    for r in spans.orderBy("ingest_seq").collect():
        row = r.asDict(recursive=True)
        attributes = [{"key": a["key"], "value": {"stringValue": a["value"]["rendered"]}} for a in row["attributes"] or []]
        groups.setdefault(row["service"], []).append({"traceId": row["trace_id"], "spanId": row["span_id"], "parentSpanId": row["parent_span_id"] or "", "name": row["name"], "kind": row["kind"], "startTimeUnixNano": str(row["start_ns"]), "endTimeUnixNano": str(row["start_ns"] + row["duration_ns"]), "status": row["status"], "attributes": attributes})
    return {"batches": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": s}}]}, "scopeSpans": [{"spans": x}]} for s, x in groups.items()]}
