"""The endpoints over a store folder: what is pushed comes back from queries, reports and after resets."""

import json
import threading
import urllib.request

import pytest

from kestrel import api
from kestrel.sources import snappy, wire

NOW = 1_700_000_600 * 10**9


def attributes(**kw):
    return [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in kw.items()]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    a = api.Api(spark, str(tmp_path_factory.mktemp("store")), lambda: NOW)
    t = NOW - 60 * 10**9
    push = {"streams": [{"stream": {"service": "pay", "level": "error"}, "values": [[str(t), "boom 1"], [str(t + 10**9), "boom 2"]]}, {"stream": {"service": "web", "level": "info"}, "values": [[str(t), '{"k": 3}']]}]}
    assert a.request("POST", "/loki/api/v1/push", body=snappy.compress(json.dumps(push).encode())) == (200, {"accepted": {"streams": 2, "entries": 3}})
    logs = {"resourceLogs": [{"resource": {"attributes": attributes(service__name="pay")}, "scopeLogs": [{"logRecords": [{"timeUnixNano": str(t), "severityNumber": 9, "body": {"stringValue": "fine"}}]}]}]}
    assert a.request("POST", "/v1/logs", body=wire.encode("export_logs", logs)) == (204, None)
    points = [{"timeUnixNano": str(t + i * 10**9), "asDouble": float(i)} for i in range(5)]
    metrics = {"resourceMetrics": [{"resource": {"attributes": attributes(service__name="pay")}, "scopeMetrics": [{"metrics": [{"name": "req.latency", "unit": "s", "gauge": {"dataPoints": points}}]}]}]}
    assert a.request("POST", "/v1/metrics", body=json.dumps(metrics).encode()) == (200, {"accepted": {"series": 5, "samples": 5}})
    clash = json.loads(json.dumps(metrics).replace("req.latency", "req_latency"))
    assert a.request("POST", "/v1/metrics", body=json.dumps(clash).encode())[0] == 400
    spans = [{"traceId": "a" * 32, "spanId": "1" * 16, "name": "root", "kind": 2, "startTimeUnixNano": str(t), "endTimeUnixNano": str(t + 2 * 10**9), "status": {"code": 2}}, {"traceId": "a" * 32, "spanId": "2" * 16, "parentSpanId": "1" * 16, "name": "leaf", "kind": 3, "startTimeUnixNano": str(t + 1), "endTimeUnixNano": str(t + 5)}]
    traces = {"resourceSpans": [{"resource": {"attributes": attributes(service__name="pay")}, "scopeSpans": [{"spans": spans}]}]}
    assert a.request("POST", "/v1/traces", body=wire.encode("export_traces", traces)) == (200, {"accepted": {"traces": 1, "spans": 2}})
    series = {"timeseries": [{"labels": [{"name": "__name__", "value": "up"}, {"name": "service", "value": "web"}], "samples": [{"value": 1.0, "timestamp": str(t // 10**6)}]}]}
    assert a.request("POST", "/api/v1/write", body=snappy.compress(wire.encode("write_request", series))) == (204, None)
    return a


def get(a, path, **params):
    status, out = a.request("GET", path, params)
    assert status == 200, out
    return out


def test_queries(store):
    streams = get(store, "/loki/api/v1/query_range", query='{service="pay"} |= "boom"', limit="1")["data"]["result"]
    assert [x["values"][0][1] for x in streams] == ["boom 2"]
    counts = get(store, "/loki/api/v1/query", query='count_over_time({service="pay"}[1h])')["data"]
    assert counts["resultType"] == "matrix" and {x["values"][-1][1] for x in counts["result"]} == {"1", "2"}
    assert get(store, "/loki/api/v1/labels")["data"] == ["level", "service"] and get(store, "/loki/api/v1/label/level/values")["data"] == ["error", "info"]
    assert [x["value"][1] for x in get(store, "/api/v1/query", query="req_latency")["data"]["result"]] == ["4"]
    assert get(store, "/api/v1/query", query="1 + 1")["data"] == {"resultType": "scalar", "result": [(NOW - 56 * 10**9) / 10**9, "2"]}
    rates = get(store, "/api/v1/query_range", query="rate(req_latency[5m])", start=str(NOW // 10**9 - 60), end=str(NOW // 10**9), step="30")["data"]["result"]
    assert [v for _, v in rates[0]["values"]] == ["1", "1"]
    assert get(store, "/api/v1/labels")["data"] == ["__name__", "service"] and get(store, "/api/v1/label/__name__/values")["data"] == ["req_latency", "up"]
    assert get(store, "/api/v1/series", **{"match[]": ["up"]})["data"] == [{"__name__": "up", "service": "web"}] and len(get(store, "/api/v1/series")["data"]) == 2
    assert get(store, "/api/v1/metadata")["data"]["req_latency"] == [{"type": "gauge", "help": "", "unit": "s"}]
    assert get(store, "/api/search", q='{ name = "leaf" }')["traces"][0]["rootTraceName"] == "root" and len(get(store, "/api/search")["traces"]) == 1
    assert len(get(store, "/api/traces/" + "a" * 32)["batches"][0]["scopeSpans"][0]["spans"]) == 2


def test_reports(store):
    assert get(store, "/ready") == {"status": "ready"}
    assert get(store, "/api/v1/services")["data"]["services"] == [{"name": "pay", "signals": ["logs", "metrics", "traces"]}, {"name": "web", "signals": ["logs", "metrics"]}]
    status = get(store, "/api/v1/status")["data"]
    assert (status["totalLogEntries"], status["totalMetricSeries"], status["totalMetricSamples"], status["totalSpans"], status["totalTraces"], status["serviceCount"]) == (4, 2, 6, 2, 1, 2) and status["memoryBytes"] > 0
    assert get(store, "/api/v1/catalog", service="pay")["data"]["metrics"] == ["req_latency"]
    summary = get(store, "/api/v1/summary", service="pay")["data"]
    assert ([x["line"] for x in summary["logs"]], len(summary["metrics"]), summary["traces"][0]["durationMs"]) == (["boom 2", "boom 1"], 1, 2000.0)
    d = get(store, "/api/v1/diagnose", service="pay")
    assert d["health_factors"] == {"error_rate_pct": pytest.approx(200 / 3), "latency_p99_ms": 2000.0, "span_error_ratio": 0.5} and d["health_score"] == pytest.approx(100 - 40 - 15 - 10) and len(d["suggested_queries"]) == 3
    assert get(store, "/api/v1/diagnose")["services"][0] == {"service": "pay", "health_score": 45.0, "top_issue": "High log error rate: 66.7%"}


@pytest.mark.parametrize(("path", "params", "status"), [
    ("/loki/api/v1/query_range", {"query": "{"}, 400), ("/loki/api/v1/query_range", {"query": '{a="b"}', "start": "x"}, 400), ("/loki/api/v1/query_range", {"query": 'rate({a="b"}[1s])', "start": "1", "end": "100000"}, 400), ("/loki/api/v1/query_range", {"query": '{a="b"}', "step": "0"}, 400),
    ("/api/v1/query", {"query": "sum("}, 400), ("/api/v1/query_range", {"query": "up", "step": "0"}, 400), ("/api/v1/query_range", {"query": "up", "start": "0", "end": "99999999", "step": "1"}, 400), ("/api/v1/series", {"match[]": ["rate(up[5m])"]}, 400),
    ("/api/search", {"q": "{ name = }"}, 400), ("/api/search", {"start": "soon"}, 400), ("/api/traces/xyz", {}, 400), ("/api/traces/" + "b" * 32, {}, 404), ("/api/v1/catalog", {}, 400), ("/api/v1/diagnose", {"service": "none"}, 200), ("/nothing", {}, 404), ("/api/v1/reset", {}, 405),
])
def test_bad_requests(store, path, params, status):
    assert store.request("GET", path, params)[0] == status


def test_bad_bodies(store):
    for path in ("/loki/api/v1/push", "/v1/logs", "/v1/metrics", "/v1/traces"):
        assert store.request("POST", path, body=b"\xff\xff\xff")[0] == 400


def test_server_snapshot_eviction_and_reset(store, spark):
    server = api.serve(store, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/api/v1/label/service/values") as r:
        assert json.load(r)["data"] == ["pay", "web"]
    server.shutdown()
    assert store.request("POST", "/api/v1/snapshot")[1]["status"] == "ok"
    assert store.request("DELETE", "/api/v1/reset", {"service": "pay"}) == (200, {})
    assert get(store, "/api/v1/services")["data"]["services"] == [{"name": "web", "signals": ["logs", "metrics"]}]
    store.evict(3600 * 10**9, logs=1)
    assert get(store, "/api/v1/status")["data"]["totalLogEntries"] == 1
    store.evict(10**9)
    assert get(store, "/api/v1/services")["data"]["services"] == []
    assert store.request("DELETE", "/api/v1/reset") == (200, {}) and get(store, "/api/v1/metadata")["data"] == {}
