"""The test tables as requests in the push and export formats, which the readers must turn into the tables' rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

HOUR_NS, DAY_NS = 3_600_000_000_000, 86_400_000_000_000


def attributes(**columns: Column) -> Column:
    """String attributes; a double underscore in a name stands for a dot."""
    return F.array(*[F.struct(F.lit(k.replace("__", ".")).alias("key"), F.struct(v.alias("stringValue")).alias("value")) for k, v in columns.items()])


def body(signal: str, inner: str, field: str, resource: Column, items: Column) -> Column:
    scopes = F.array(F.struct(items.alias(field)))
    return F.to_json(F.struct(F.array(F.struct(F.struct(resource.alias("attributes")).alias("resource"), scopes.alias(inner))).alias(signal))).alias("body")


def push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as push documents, one for each stream and hour."""
    entry = F.array(F.col("ts_ns").cast("string"), F.col("line"))
    t = tables.logs(spark, sf_dir).groupBy("key", F.expr(f"ts_ns div {HOUR_NS}")).agg(F.collect_list(entry).alias("values"))
    return t.select(F.to_json(F.struct(F.array(F.struct(F.map_from_entries("key").alias("stream"), "values")).alias("streams"))).alias("body"))


def export_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records, a document for each service, type and hour."""
    severity = F.when(F.col("level") == "error", 17).when(F.col("level") == "warn", 13).otherwise(9)
    trace = F.lower(F.lpad(F.hex(F.col("ingest_seq") + 1), 32, "0"))
    record = F.struct(F.col("ts_ns").cast("string").alias("timeUnixNano"), severity.alias("severityNumber"), F.struct(F.col("line").alias("stringValue")).alias("body"), trace.alias("traceId"))
    t = tables.logs(spark, sf_dir).groupBy("service", F.col("labels")["event_type"].alias("et"), F.expr(f"ts_ns div {HOUR_NS}")).agg(F.collect_list(record).alias("records"))
    return t.select(body("resourceLogs", "scopeLogs", "logRecords", attributes(service__name=F.col("service"), event_type=F.col("et")), F.col("records")))


def export_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a gauge a service, type and hour, and each service's whole values as a histogram and a summary a day."""
    e = tables.read(spark, sf_dir, "events")
    e = e.select(tables.service(e).alias("service"), "event_type", (tables.epoch_us(e["ts"]) * 1000).alias("ns"), "value", F.floor("value").cast("double").alias("v"))
    resource = attributes(service__name=F.col("service"))

    def documents(rows: DataFrame, name: str, kind: str, points: Column) -> DataFrame:
        return rows.select(body("resourceMetrics", "scopeMetrics", "metrics", resource, F.array(F.struct(F.lit(name).alias("name"), F.struct(points.alias("dataPoints")).alias(kind)))))

    point = F.struct(attributes(event_type=F.col("event_type")).alias("attributes"), F.col("ns").cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    hours = e.groupBy("service", "event_type", F.expr(f"ns div {HOUR_NS}")).agg(F.collect_list(point).alias("points"))
    edges = [float("-inf"), *tables.BOUNDS, float("inf")]
    counts = [F.count_if((F.col("v") > a) & (F.col("v") <= b)).cast("string") for a, b in zip(edges, edges[1:], strict=False)]
    days = e.groupBy("service", F.expr(f"ns div {DAY_NS}").alias("day")).agg(F.array(*counts).alias("counts"), F.count("*").cast("string").alias("count"), F.sum("v").alias("sum"), F.max("v").alias("most"))
    common = [(F.col("day") * DAY_NS).cast("string").alias("timeUnixNano"), "count", "sum"]
    histogram = F.struct(*common, F.col("counts").alias("bucketCounts"), F.array(*map(F.lit, tables.BOUNDS)).alias("explicitBounds"))
    summary = F.struct(*common, F.array(F.struct(F.lit(1.0).alias("quantile"), F.col("most").alias("value"))).alias("quantileValues"))
    out = documents(hours, "event.value", "gauge", F.col("points"))
    return out.union(documents(days, "event.size", "histogram", F.array(histogram))).union(documents(days, "event.most", "summary", F.array(summary)))


def export_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their items as spans, a document for each trace and service."""
    t = tables.spans(spark, sf_dir)
    own = F.transform(F.filter("attributes", lambda a: a["key"].startswith("span.")), lambda a: F.struct(F.substring(a["key"], F.lit(6), F.length(a["key"])).alias("key"), F.struct(a["value"]["s"].alias("stringValue"), a["value"]["i"].cast("string").alias("intValue")).alias("value")))
    code = F.when(F.col("status") == "ok", 1).when(F.col("status") == "error", 2).otherwise(0)
    end = (F.col("start_ns") + F.col("duration_ns")).cast("string")
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", "kind", F.col("start_ns").cast("string").alias("startTimeUnixNano"), end.alias("endTimeUnixNano"), own.alias("attributes"), F.struct(code.alias("code")).alias("status"))
    rows = t.groupBy("trace_id", "service").agg(F.collect_list(span).alias("spans"))
    return rows.select(body("resourceSpans", "scopeSpans", "spans", attributes(service__name=F.col("service")), F.col("spans")))


def write_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gauge as write requests in their JSON form, one a series and day."""
    sample = F.struct("value", F.col("ts_ms").cast("string").alias("timestamp"))
    t = tables.samples(spark, sf_dir).groupBy("key", F.expr("ts_ms div 86400000")).agg(F.collect_list(sample).alias("samples"))
    labels = F.transform("key", lambda x: F.struct(x["key"].alias("name"), x["value"].alias("value")))
    return t.select(F.to_json(F.struct(F.array(F.struct(labels.alias("labels"), "samples")).alias("timeseries"))).alias("body"))
