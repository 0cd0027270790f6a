"""Readers, stores, retention, streaming and response documents."""

import gzip
import json
import struct

from pyspark.sql import functions as F

from kestrel.functions import labels as L
from kestrel.functions import responses
from kestrel.operators.metrics import Metrics
from kestrel.operators.traces import Traces
from kestrel.sources import ingest, snappy, store, wire
from kestrel.streaming import pipelines


def bodies(spark, *documents):
    return spark.createDataFrame([(json.dumps(d),) for d in documents], "body string")


PUSH = {"streams": [{"stream": {"service": "a", "level": "error"}, "values": [["1700000000000000000", "one", {"trace_id": "AB" * 16, "k": "v"}], ["bad", "dropped"], ["1700000000", "two"]]}]}


def test_push(spark):
    rows = ingest.push(bodies(spark, PUSH, {"streams": []})).orderBy("line").collect()
    assert [(r["line"], r["ts_ns"]) for r in rows] == [("one", 1_700_000_000 * 10**9), ("two", 1_700_000_000 * 10**9)]
    assert rows[0]["trace_id"] == "ab" * 16 and rows[0]["attributes"][0]["key"] == "k" and rows[0]["service"] == "a"


def attributes(**kw):
    return [{"key": k.replace("__", "."), "value": v} for k, v in kw.items()]


def test_export_logs(spark):
    doc = {"resourceLogs": [{"resource": {"attributes": attributes(service__name={"stringValue": "api"}, n={"intValue": "3"}, skip={"arrayValue": {"values": []}})}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "5", "severityNumber": 17, "body": {"stringValue": "boom"}, "traceId": "0" * 32, "attributes": attributes(x={"doubleValue": 1.5})}, {"body": {"intValue": "7"}}]}]}]}
    rows = ingest.export_logs(bodies(spark, doc), now_ns=9).orderBy("ts_ns").collect()
    assert rows[0]["labels"] == {"service": "api", "n": "3", "level": "error"} and rows[0]["trace_id"] is None and rows[0]["line"] == "boom"
    assert (rows[1]["ts_ns"], rows[1]["line"], rows[1]["level"]) == (9, "7", "unknown")


def test_export_metrics(spark):
    point = {"timeUnixNano": "2000000", "attributes": attributes(path={"stringValue": "/"})}
    doc = {"resourceMetrics": [{"resource": {"attributes": attributes(service__name={"stringValue": "api"})}, "scopeMetrics": [{"metrics": [
        {"name": "cpu.load", "gauge": {"dataPoints": [point | {"asDouble": 0.5}]}}, {"name": "reqs", "sum": {"isMonotonic": True, "dataPoints": [point | {"asInt": "4"}]}},
        {"name": "lat", "histogram": {"dataPoints": [point | {"count": "6", "sum": 9.0, "bucketCounts": ["1", "2", "3"], "explicitBounds": [1, 2.5]}]}}, {"name": "q", "summary": {"dataPoints": [point | {"count": "3", "sum": 4.5, "quantileValues": [{"quantile": 0.9, "value": 2.0}]}]}}]}]}]}
    samples, metadata = ingest.export_metrics(bodies(spark, doc))
    got = {(r["metric"], r["labels"].get("le") or r["labels"].get("quantile")): r["value"] for r in samples.collect()}
    assert got == {("cpu_load", None): 0.5, ("reqs", None): 4.0, ("lat_bucket", "1"): 1.0, ("lat_bucket", "2.5"): 3.0, ("lat_bucket", "+Inf"): 6.0, ("lat_sum", None): 9.0, ("lat_count", None): 6.0, ("q", "0.9"): 2.0, ("q_sum", None): 4.5, ("q_count", None): 3.0}
    assert {r["metric"]: r["type"] for r in metadata.collect()} == {"cpu_load": "gauge", "reqs": "counter", "lat": "histogram", "q": "summary"}
    other = metadata.withColumn("source_name", F.translate("source_name", ".", "_"))
    assert [r["metric"] for r in ingest.name_collisions(metadata, other).collect()] == ["cpu_load"]
    known = ingest.upsert_metadata(metadata, metadata.withColumn("type", F.lit("unknown")).withColumn("help", F.lit("h")))
    assert {(r["type"], r["help"]) for r in known.collect()} >= {("gauge", "h"), ("counter", "h")}


def test_export_traces(spark, tmp_path):
    spans = [{"traceId": "a" * 32, "spanId": "b" * 16, "name": "root", "kind": 2, "startTimeUnixNano": "10", "endTimeUnixNano": "30", "status": {"code": 2}, "attributes": attributes(n={"intValue": "5"}), "events": [{"name": "exception", "timeUnixNano": "11", "attributes": []}]}, {"traceId": "0" * 32, "spanId": "c" * 16, "name": "dropped"}]
    doc = {"resourceSpans": [{"resource": {"attributes": attributes(service__name={"stringValue": "api"})}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": spans}]}]}
    rows = ingest.export_traces(bodies(spark, doc))
    t = Traces(rows)
    assert t.query('{ span.n = 5 && status = error && event.name = "exception" && scope.name = "lib" }').count() == 1
    assert responses.trace(t.trace("a" * 32))["batches"][0]["scopeSpans"][0]["spans"][0]["name"] == "root"
    assert responses.search(t.search())["traces"][0]["rootServiceName"] == "api"
    store.save_snapshot({"spans": rows}, f"{tmp_path}/snap")
    assert store.load_snapshot(spark, f"{tmp_path}/snap")["spans"].count() == 1


def message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2, len(value)]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 1]) + struct.pack("<d", value)
        else:
            out += bytes([number << 3, value])
    return out


def test_remote_write(spark):
    label = lambda k, v: message((1, k.encode()), (2, v.encode()))
    series = message((1, label("__name__", "up_total")), (1, label("job", "x")), (2, message((1, 1.5), (2, 100))))
    nameless = message((1, label("job", "y")), (2, message((1, 1.0), (2, 1))))
    body = message((1, series), (1, nameless))
    assert snappy.decompress(snappy.compress(body * 9000)) == body * 9000
    assert snappy.decompress(bytes([8, 0 << 2, 97, (3 << 2) | 1 | 0, 1])) == b"a" * 8
    df = spark.createDataFrame([(snappy.compress(body),), (body,)], "body binary")
    rows = ingest.remote_write(df).collect()
    assert [(r["metric"], r["ts_ms"], r["value"], r["labels"]["job"]) for r in rows] == [("up_total", 100, 1.5, "x")] * 2


def test_streaming_and_store(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps(PUSH) + "\n")
    for _ in range(2):  # the second run finds nothing new
        pipelines.follow(spark, str(landing), "push", f"{tmp_path}/store", f"{tmp_path}/cp").awaitTermination()
    assert store.load(spark, f"{tmp_path}/store", "logs").count() == 2


def test_responses(spark):
    df = spark.createDataFrame([({"__name__": "m", "a": "1"}, t, float(t), t) for t in (1000, 2000)], "labels map<string,string>, ts_ms long, value double, ingest_seq long")
    m = Metrics(df.withColumns({"key": L.of_map(F.col("labels")), "metric": F.lit("m")}))
    assert responses.vector(m.instant("m").df)["data"]["result"][0]["value"] == [2.0, "2000"]
    assert responses.matrix(m.range("m", 1000, 2000, 1000).df)["data"]["result"][0]["values"] == [[1.0, "1000"], [2.0, "2000"]]


def test_wire_forms(spark):
    """Binary, gzipped and Snappy bodies read like their JSON; bodies that can't be read give no rows."""
    value = {"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": "-3"}, {"boolValue": True}, {"bytesValue": "AAE="}]}}}]}}
    record = {"timeUnixNano": "5", "severityNumber": 9, "body": {"stringValue": "h\u00e9"}, "traceId": "ab" * 16, "attributes": [{"key": "x", "value": value}, {"key": "d", "value": {"doubleValue": 0.5}}]}
    doc = {"resourceLogs": [{"resource": {"attributes": attributes(service__name={"stringValue": "api"})}, "scopeLogs": [{"logRecords": [record, {"body": {"intValue": "7"}}]}]}]}
    binary = wire.encode("export_logs", doc)
    assert json.loads(wire.json_body("export_logs", binary)) == doc == json.loads(wire.json_body("export_logs", gzip.compress(binary)))
    unknown_field = binary + bytes([15 << 3 | 2, 3]) + b"abc"
    assert json.loads(wire.json_body("export_logs", unknown_field)) == doc
    push = json.dumps(PUSH).encode()
    assert wire.json_body("push", push) == wire.json_body("push", snappy.compress(push)) == push.decode()
    bad = [None, b"", binary[:-1], b"\x1f\x8b broken", gzip.compress(binary)[:-9], b"\x0f", b"\xff" * 12]
    assert [wire.json_body("export_logs", x) for x in bad] == [None] * len(bad)
    rows = spark.createDataFrame([(x,) for x in [*bad, binary, gzip.compress(json.dumps(doc).encode())]], "body binary")
    got = ingest.export_logs(wire.decoded(rows, "export_logs"), now_ns=9).collect()
    assert sorted((r["line"], r["ts_ns"], r["service"]) for r in got) == [("7", 9, "api")] * 2 + [("h\u00e9", 5, "api")] * 2
    packed = struct.pack("<3Q", 1, 2, 3)
    point = bytes([6 << 3 | 2, 24]) + packed + bytes([7 << 3 | 1]) + struct.pack("<d", 2.5)
    assert wire.message("HistogramPoint", point) == {"bucketCounts": ["1", "2", "3"], "explicitBounds": [2.5]}


def test_binary_landing_files(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.bin").write_bytes(snappy.compress(json.dumps(PUSH).encode()))
    pipelines.follow(spark, str(landing), "push", f"{tmp_path}/store", f"{tmp_path}/cp", binary=True).awaitTermination()
    assert store.load(spark, f"{tmp_path}/store", "logs").count() == 2
