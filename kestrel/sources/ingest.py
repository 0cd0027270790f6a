"""Readers of push and export formats: JSON documents to logs, samples and spans, all within Spark; and the binary write format.

Each takes a DataFrame with one request a row in the column ``body`` (string); landing files may be gzipped, which Spark's text
reader undoes.  Binary requests go through :func:`kestrel.sources.wire.decoded` first.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators.traces import ATTRIBUTES, VALUE
from . import snappy
from .wire import message

SCALAR = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string,arrayValue:string,kvlistValue:string>"
PAIRS = f"array<struct<key:string,value:{SCALAR}>>"
PUSH = "struct<streams:array<struct<stream:map<string,string>,values:array<array<string>>>>>"
LOGS = f"struct<resourceLogs:array<struct<resource:struct<attributes:{PAIRS}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{SCALAR},attributes:{PAIRS},traceId:string,spanId:string>>>>>>>"
POINT = f"struct<attributes:{PAIRS},timeUnixNano:string,asDouble:double,asInt:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,quantileValues:array<struct<quantile:double,value:double>>>"
POINTS = f"struct<dataPoints:array<{POINT}>,isMonotonic:boolean>"
METRICS = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{PAIRS}>,scopeMetrics:array<struct<metrics:array<struct<name:string,description:string,unit:string,gauge:{POINTS},sum:{POINTS},histogram:{POINTS},summary:{POINTS}>>>>>>>"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{PAIRS},status:struct<code:string,message:string>,events:array<struct<name:string,timeUnixNano:string,attributes:{PAIRS}>>,links:array<struct<traceId:string,spanId:string,traceState:string,flags:int,attributes:{PAIRS}>>>"
TRACES = f"struct<resourceSpans:array<struct<resource:struct<attributes:{PAIRS}>,scopeSpans:array<struct<scope:struct<name:string,version:string,attributes:{PAIRS}>,spans:array<{SPAN}>>>>>>"
MAX_LABELS = 128


def numbered(rows: DataFrame, base: int = 0) -> DataFrame:
    """``ingest_seq`` by request and position; increasing, with gaps between partitions."""
    return rows.withColumn("ingest_seq", F.lit(base).cast("long") + F.monotonically_increasing_id())


def time_ns(text: Column) -> Column:
    """Times of unknown unit by magnitude; floats are seconds; null if it is no time."""
    n, x = text.try_cast("bigint"), text.try_cast("double")
    whole = F.when(n > 10**18, n).when(n > 10**15, n * 1000).when(n > 10**12, n * 10**6).otherwise(n * 10**9)
    return F.when(text.rlike(r"^[+-]?\d+$"), whole).otherwise(F.when(~F.isnan(x) & (F.abs(x) < 9e9), (x * 1e9).cast("bigint")))


def hex_id(text: Column, digits: int) -> Column:
    """Lower-case id, or null if it is malformed or all zero."""
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{digits}}}$") & ~text.rlike("^0+$"), F.lower(text))


def push(requests: DataFrame) -> DataFrame:
    """Push documents {"streams": [{"stream": {..}, "values": [[time, line, metadata?], ..]}]} to log rows.

    Entries with fewer than two elements or a time that cannot be read are dropped.
    """
    t = requests.select("*", F.explode(F.from_json("body", PUSH)["streams"]).alias("s")).select("*", F.explode("s.values").alias("v"))
    t = t.filter((F.size("v") >= 2)).withColumn("ts_ns", time_ns(F.get("v", F.lit(0)))).filter("ts_ns is not null")
    labels = F.coalesce(F.col("s.stream"), F.create_map().cast("map<string,string>"))
    t = t.filter(F.size(labels) <= MAX_LABELS)
    meta = F.from_json(F.get("v", F.lit(2)), "map<string,string>")
    first = lambda *names: F.coalesce(*[meta[n] for n in names])
    rest = F.map_entries(F.map_filter(meta, lambda k, _: ~k.isin("trace_id", "traceId", "span_id", "spanId")))
    attributes = F.coalesce(F.transform(rest, lambda e: _attribute(e["key"], e["value"])), F.array()).cast(ATTRIBUTES)
    out = t.select(
        L.of_map(labels).alias("key"), labels.alias("labels"), labels["service"].alias("service"), labels["level"].alias("level"), "ts_ns", F.get("v", F.lit(1)).alias("line"),
        hex_id(first("trace_id", "traceId"), 32).alias("trace_id"), hex_id(first("span_id", "spanId"), 16).alias("span_id"), F.lit(0).alias("severity_number"), F.lit(None).cast("string").alias("severity_text"), attributes.alias("attributes"),
    )
    return numbered(out)


def _attribute(key: Column, text: Column) -> Column:
    n = lambda kind: F.lit(None).cast(kind)
    return F.struct(key.alias("key"), F.struct(F.lit("s").alias("kind"), text.alias("s"), n("bigint").alias("i"), n("double").alias("d"), n("boolean").alias("b"), text.alias("rendered")).alias("value"))


def scalar_text(v: Column) -> Column:
    """Text of a scalar value; null for arrays, lists and bytes."""
    return F.coalesce(v["stringValue"], v["intValue"], number_text(v["doubleValue"]), v["boolValue"].cast("string"))


def number_text(d: Column) -> Column:
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def typed(v: Column) -> Column:
    kind = F.when(v["stringValue"].isNotNull(), "s").when(v["intValue"].isNotNull(), "i").when(v["doubleValue"].isNotNull(), "d").when(v["boolValue"].isNotNull(), "b").otherwise("x")
    other = F.coalesce(v["arrayValue"], v["kvlistValue"], v["bytesValue"], F.lit(""))
    rendered = F.coalesce(scalar_text(v), other)
    return F.struct(kind.alias("kind"), v["stringValue"].alias("s"), v["intValue"].try_cast("bigint").alias("i"), v["doubleValue"].alias("d"), v["boolValue"].alias("b"), rendered.alias("rendered")).cast(VALUE)


def pairs(attributes: Column) -> Column:
    return F.coalesce(attributes, F.array().cast(PAIRS))


def resource_labels(attributes: Column) -> Column:
    """Scalar attributes as label entries, ``service.name`` promoted to ``service``; of equal names the last stays."""
    plain = F.filter(F.transform(pairs(attributes), lambda a: F.struct(a["key"].alias("key"), scalar_text(a["value"]).alias("value"))), lambda e: e["value"].isNotNull())
    promoted = F.exists(plain, lambda e: e["key"] == "service.name")
    kept = F.filter(plain, lambda e: ~(promoted & (e["key"] == "service")))
    return F.transform(kept, lambda e: F.struct(F.when(e["key"] == "service.name", "service").otherwise(e["key"]).alias("key"), e["value"].alias("value")))


def last_wins(entries: Column) -> Column:
    kept = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.array_sort(kept)


def level(severity: Column) -> Column:
    n = F.coalesce(severity, F.lit(0))
    out = F.when(n.between(1, 4), "trace")
    for i, name in enumerate(("debug", "info", "warn", "error", "fatal")):
        out = out.when(n.between(5 + 4 * i, 8 + 4 * i), name)
    return out.otherwise("unknown")


def export_logs(requests: DataFrame, now_ns: int = 0) -> DataFrame:
    """Export documents with resourceLogs to log rows; a record without a time gets ``now_ns``."""
    t = requests.select(F.explode(F.from_json("body", LOGS)["resourceLogs"]).alias("r")).select("r", F.explode("r.scopeLogs").alias("s")).select("r", F.explode("s.logRecords").alias("x"))
    entries = F.concat(resource_labels(F.col("r.resource.attributes")), F.array(F.struct(F.lit("level").alias("key"), level(F.col("x.severityNumber")).alias("value"))))
    key = last_wins(entries)
    body = F.col("x.body")
    line = F.coalesce(scalar_text(body), F.when(body["bytesValue"].isNotNull(), F.concat(F.lit("<bytes len="), F.octet_length(F.unbase64(body["bytesValue"])).cast("string"), F.lit(">"))), body["arrayValue"], body["kvlistValue"], F.lit(""))
    ts = F.coalesce(F.nullif(F.col("x.timeUnixNano").try_cast("bigint"), F.lit(0)), F.lit(now_ns))
    scalars = F.filter(pairs(F.col("x.attributes")), lambda a: scalar_text(a["value"]).isNotNull())
    attributes = F.transform(scalars, lambda a: F.struct(a["key"].alias("key"), typed(a["value"]).alias("value")))
    rows = t.select(key.alias("key"), ts.alias("ts_ns"), line.alias("line"), hex_id(F.col("x.traceId"), 32).alias("trace_id"), hex_id(F.col("x.spanId"), 16).alias("span_id"), F.coalesce("x.severityNumber", F.lit(0)).alias("severity_number"), F.col("x.severityText").alias("severity_text"), attributes.cast(ATTRIBUTES).alias("attributes"))
    rows = rows.withColumn("labels", F.map_from_entries("key"))
    return numbered(rows.withColumns({"service": F.col("labels")["service"], "level": F.col("labels")["level"]}))


def export_metrics(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, metadata) of export documents with resourceMetrics.  Exponential histograms are skipped."""
    t = requests.select(F.explode(F.from_json("body", METRICS)["resourceMetrics"]).alias("r")).select("r", F.explode("r.scopeMetrics").alias("s")).select("r", F.explode("s.metrics").alias("m"))
    t = t.withColumn("name", F.translate("m.name", ".", "_"))
    kind = F.when(F.col("m.gauge").isNotNull(), "gauge").when(F.col("m.sum").isNotNull(), F.when(F.col("m.sum.isMonotonic"), "counter").otherwise("gauge")).when(F.col("m.histogram").isNotNull(), "histogram").when(F.col("m.summary").isNotNull(), "summary").otherwise("unknown")
    metadata = t.select(F.col("name").alias("metric"), kind.alias("type"), F.col("m.description").alias("help"), F.col("m.unit").alias("unit"), F.col("m.name").alias("source_name")).distinct()
    group = F.coalesce("m.gauge", "m.sum", "m.histogram", "m.summary")
    p = t.withColumn("kind", kind).select("r", "name", "kind", F.explode(group["dataPoints"]).alias("p"))
    base = F.concat(resource_labels(F.col("r.resource.attributes")), resource_labels(F.col("p.attributes")))
    p = p.select("name", "kind", base.alias("base"), "p", F.call_function("div", F.coalesce(F.col("p.timeUnixNano").try_cast("bigint"), F.lit(0)), F.lit(1_000_000).cast("long")).alias("ts_ms"))
    extra = lambda key, value: F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))
    one = lambda suffix, value, labels=None: F.struct(F.lit(suffix).alias("suffix"), value.cast("double").alias("value"), (labels if labels is not None else F.array().cast(L.KEY_TYPE)).cast(L.KEY_TYPE).alias("labels"))
    number = F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double"), F.lit(0.0))
    counts = F.transform(F.coalesce("p.bucketCounts", F.array().cast("array<string>")), lambda c: c.try_cast("double"))
    bounds = F.col("p.explicitBounds")
    buckets = F.transform(counts, lambda c, i: one("_bucket", F.aggregate(F.slice(counts, 1, i + 1), F.lit(0.0), lambda a, x: a + x), extra("le", F.coalesce(number_text(F.get(bounds, i)), F.lit("+Inf")))))
    totals = F.array(one("_sum", F.coalesce("p.sum", F.lit(0.0))), one("_count", F.coalesce(F.col("p.count").try_cast("double"), F.lit(0.0))))
    quantiles = F.transform(F.coalesce("p.quantileValues", F.array().cast("array<struct<quantile:double,value:double>>")), lambda q: one("", q["value"], extra("quantile", number_text(q["quantile"]))))
    made = F.when(F.col("kind") == "histogram", F.concat(buckets, totals)).when(F.col("kind") == "summary", F.concat(quantiles, totals)).otherwise(F.array(one("", number)))
    s = p.select("name", "base", "ts_ms", F.explode(made).alias("x"))
    metric = F.concat("name", "x.suffix")
    key = last_wins(F.concat(F.col("base").cast(L.KEY_TYPE), F.col("x.labels"), extra(L.NAME, metric).cast(L.KEY_TYPE)))
    rows = s.select(metric.alias("metric"), key.alias("key"), "ts_ms", F.col("x.value").alias("value")).withColumn("labels", F.map_from_entries("key"))
    return numbered(rows), metadata


def name_collisions(metadata: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Normalized names that stand for several source names; a batch that has one is to be rejected whole."""
    both = metadata.select("metric", "source_name")
    both = both.unionByName(known.select("metric", "source_name")) if known is not None else both
    return both.groupBy("metric").agg(F.count_distinct("source_name").alias("n")).filter("n > 1")


def upsert_metadata(known: DataFrame, new: DataFrame) -> DataFrame:
    """Non-null fields of ``new`` win, but an unknown type never replaces a known one."""
    both = known.withColumn("at", F.lit(0)).unionByName(new.withColumn("at", F.lit(1)), allowMissingColumns=True)
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("at")))
    kind = F.when(F.col("type") != "unknown", F.col("type"))
    return both.groupBy("metric").agg(F.coalesce(latest(kind), F.lit("unknown")).alias("type"), latest(F.col("help")).alias("help"), latest(F.col("unit")).alias("unit"), latest(F.col("source_name")).alias("source_name"))


def export_traces(requests: DataFrame) -> DataFrame:
    """Export documents with resourceSpans to span rows; spans with an invalid id are dropped."""
    t = requests.select(F.explode(F.from_json("body", TRACES)["resourceSpans"]).alias("r")).select("r", F.explode("r.scopeSpans").alias("s")).select("r", "s.scope", F.explode("s.spans").alias("x"))
    t = t.withColumns({"trace_id": hex_id(F.col("x.traceId"), 32), "span_id": hex_id(F.col("x.spanId"), 16)}).filter("trace_id is not null and span_id is not null")
    prefixed = lambda col, prefix: F.transform(pairs(col), lambda a: F.struct(F.concat(F.lit(prefix), a["key"]).alias("key"), typed(a["value"]).alias("value")))
    scope = F.array_compact(F.array(*[F.when(F.col(f"scope.{f}").isNotNull() & (F.col(f"scope.{f}") != ""), _attribute(F.lit(f"scope.{f}"), F.col(f"scope.{f}"))) for f in ("name", "version")]))
    attributes = F.concat(prefixed(F.col("r.resource.attributes"), "resource.").cast(ATTRIBUTES), scope.cast(ATTRIBUTES), prefixed(F.col("scope.attributes"), "scope.").cast(ATTRIBUTES), prefixed(F.col("x.attributes"), "span.").cast(ATTRIBUTES))
    bare = lambda col: F.transform(pairs(col), lambda a: F.struct(a["key"].alias("key"), typed(a["value"]).alias("value"))).cast(ATTRIBUTES)
    service = F.coalesce(F.get(F.filter(pairs(F.col("r.resource.attributes")), lambda a: a["key"] == "service.name"), F.lit(0))["value"]["stringValue"], F.lit("unknown"))
    start, end = (F.coalesce(F.col(f"x.{c}").try_cast("bigint"), F.lit(0)) for c in ("startTimeUnixNano", "endTimeUnixNano"))
    events = F.transform(F.coalesce("x.events", F.array().cast(f"array<struct<name:string,timeUnixNano:string,attributes:{PAIRS}>>")), lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["timeUnixNano"].try_cast("bigint"), F.lit(0)).alias("time_ns"), bare(e["attributes"]).alias("attributes")))
    raw_links = F.coalesce("x.links", F.array().cast(f"array<struct<traceId:string,spanId:string,traceState:string,flags:int,attributes:{PAIRS}>>"))
    links = F.transform(F.filter(raw_links, lambda k: hex_id(k["traceId"], 32).isNotNull() & hex_id(k["spanId"], 16).isNotNull()), lambda k: F.struct(F.lower(k["traceId"]).alias("trace_id"), F.lower(k["spanId"]).alias("span_id"), k["traceState"].alias("trace_state"), k["flags"].alias("flags"), bare(k["attributes"]).alias("attributes")))
    code = F.regexp_replace(F.coalesce("x.status.code", F.lit("0")), "^STATUS_CODE_", "")
    kinds = {n: i for i, n in enumerate(("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"))}
    named = F.regexp_replace(F.coalesce("x.kind", F.lit("0")), "^SPAN_KIND_", "")
    kind = F.coalesce(F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])[named], named.try_cast("int"), F.lit(0))
    rows = t.select(
        "trace_id", "span_id", hex_id(F.col("x.parentSpanId"), 16).alias("parent_span_id"), F.coalesce("x.name", F.lit("")).alias("name"), service.alias("service"), start.alias("start_ns"), (end - start).alias("duration_ns"),
        F.when(code.isin("1", "OK"), "ok").when(code.isin("2", "ERROR"), "error").otherwise("unset").alias("status"), F.nullif(F.col("x.status.message"), F.lit("")).alias("status_message"), F.when(kind.between(0, 5), kind).otherwise(0).cast("int").alias("kind"), attributes.alias("attributes"), events.alias("events"), links.alias("links"),
    )
    return numbered(rows)


# ---- remote write -----------------------------------------------------------------------------------------------------


def write_request(body: bytes) -> list[tuple[dict[str, str], int, float]]:
    """(labels, time in ms, value) of a write request, Snappy-compressed or plain; series without a name are skipped."""
    with contextlib.suppress(ValueError, IndexError):
        body = snappy.decompress(body)
    out = []
    for series in message("write_request", body).get("timeseries", []):
        labels = {x.get("name", ""): x.get("value", "") for x in series.get("labels", [])}
        if L.NAME in labels:
            out += [(labels, int(x.get("timestamp", 0)), x.get("value", 0.0)) for x in series.get("samples", [])]
    return out


def remote_write(requests: DataFrame) -> DataFrame:
    """Samples of write requests in the binary column ``body``.  The only reader that needs Python on the executors."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [r for body in b.column(0).to_pylist() if body for r in write_request(body)]
            labels = pa.array([list(r[0].items()) for r in rows], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([labels, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["labels", "ts_ms", "value"])

    t = requests.select("body").mapInArrow(run, "labels map<string,string>, ts_ms long, value double")
    return numbered(t.select(F.col("labels")[L.NAME].alias("metric"), "labels", L.of_map(F.col("labels")).alias("key"), "ts_ms", "value"))


def inferred_type(metric: Column) -> Column:
    return F.when(metric.rlike("(_bucket|_sum|_count)$"), "histogram").when(metric.endswith("_total"), "counter").otherwise("unknown")


def newest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("n = 1").drop("n")
