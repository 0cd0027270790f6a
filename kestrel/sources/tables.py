"""The three signals from the relational test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators.traces import ATTRIBUTES, EVENTS, LINKS, int_value, text_value

BOUNDS = (10.0, 50.0, 100.0, 250.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def as_map(key: Column) -> Column:
    return F.map_from_entries(key)


def service(events: DataFrame) -> Column:
    return F.concat(F.lit("svc-"), (events["user_id"] % 5).cast("string"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    level = F.when(e["event_type"] == "error", "error").when(e["event_type"] == "signup", "warn").otherwise("info")
    key = L.entries({"service": service(e), "level": level, "event_type": e["event_type"]})
    return e.select(
        key.alias("key"), as_map(key).alias("labels"), service(e).alias("service"), level.alias("level"), (epoch_us(e["ts"]) * 1000).alias("ts_ns"), e["props"].alias("line"),
        e["event_id"].alias("ingest_seq"), F.concat(F.lit("event="), e["event_type"], F.lit(" user="), e["user_id"].cast("string"), F.lit(" value="), F.round(e["value"], 2).cast("string")).alias("logfmt"),
    )


def logfmt_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).withColumn("line", F.col("logfmt"))


def _samples(e: DataFrame, name: str, extra: dict[str, Column], value: Column) -> DataFrame:
    key = L.entries({L.NAME: F.lit(name), "service": service(e)} | extra)
    return e.select(F.lit(name).alias("metric"), as_map(key).alias("labels"), key.alias("key"), (epoch_us(e["ts"]) / 1000).cast("long").alias("ts_ms"), value.alias("value"), e["event_id"].alias("ingest_seq"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge ``event_value`` by service and type."""
    e = read(spark, sf_dir, "events")
    return _samples(e, "event_value", {"event_type": e["event_type"]}, e["value"])


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter ``events_total``: events so far by service and type; it starts again at 100."""
    e = read(spark, sf_dir, "events")
    w = W.partitionBy(service(e), e["event_type"]).orderBy("ts", "event_id")
    e = e.withColumn("c", (F.row_number().over(w) % 100).cast("double"))
    return _samples(e, "events_total", {"event_type": e["event_type"]}, e["c"])


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram ``event_value_bucket`` by service: running counts under each bound."""
    e = read(spark, sf_dir, "events")
    e = e.withColumn("le", F.explode(F.array(*[F.lit(b) for b in BOUNDS], F.lit(float("inf")))))
    w = W.partitionBy(service(e), e["le"]).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("c", F.sum(F.when(F.col("value") <= F.col("le"), 1.0).otherwise(0.0)).over(w))
    text = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("int").cast("string"))
    return _samples(e, "event_value_bucket", {"le": text}, F.col("c"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace an order: the order is the root, its line items are children, a returned one has an exception event."""
    o, i = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    trace = lambda c: F.lower(F.lpad(F.hex(c), 32, "0"))
    span = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    none = F.array().cast(EVENTS)
    root = o.select(
        trace(o["o_orderkey"]).alias("trace_id"), span(o["o_orderkey"] * 16).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("order").alias("name"), F.lit("orders").alias("service"),
        (epoch_us(o["o_orderdate"]) * 1000).alias("start_ns"), (F.floor(o["o_totalprice"]) * 1_000_000).cast("long").alias("duration_ns"), F.when(o["o_orderstatus"] == "F", "error").when(o["o_orderstatus"] == "O", "ok").otherwise("unset").alias("status"),
        F.lit(None).cast("string").alias("status_message"), F.lit(2).alias("kind"), F.array(F.struct(F.lit("resource.service.name").alias("key"), text_value(F.lit("orders")).alias("value")), F.struct(F.lit("span.priority").alias("key"), text_value(o["o_orderpriority"]).alias("value"))).cast(ATTRIBUTES).alias("attributes"),
        none.alias("events"), F.array().cast(LINKS).alias("links"), (o["o_orderkey"] * 16).alias("ingest_seq"),
    )
    name = F.concat(F.lit("supplier-"), (i["l_suppkey"] % 5).cast("string"))
    returned = F.array(F.struct(F.lit("exception").alias("name"), F.lit(0).cast("long").alias("time_ns"), F.array(F.struct(F.lit("exception.type").alias("key"), text_value(F.lit("Returned")).alias("value"))).alias("attributes"))).cast(EVENTS)
    item = i.select(
        trace(i["l_orderkey"]).alias("trace_id"), span(i["l_orderkey"] * 16 + i["l_linenumber"]).alias("span_id"), F.when(i["l_linenumber"] <= 2, span(i["l_orderkey"] * 16)).otherwise(span(i["l_orderkey"] * 16 + i["l_linenumber"] - 1)).alias("parent_span_id"), F.lit("ship").alias("name"), name.alias("service"),
        (epoch_us(i["l_shipdate"]) * 1000).alias("start_ns"), (F.floor(i["l_quantity"]) * 1_000_000).cast("long").alias("duration_ns"), F.when(i["l_returnflag"] == "R", "error").when(i["l_returnflag"] == "A", "ok").otherwise("unset").alias("status"),
        F.lit(None).cast("string").alias("status_message"), F.lit(3).alias("kind"), F.array(F.struct(F.lit("resource.service.name").alias("key"), text_value(name).alias("value")), F.struct(F.lit("span.quantity").alias("key"), int_value(F.floor(i["l_quantity"])).alias("value"))).cast(ATTRIBUTES).alias("attributes"),
        F.when(i["l_returnflag"] == "R", returned).otherwise(none).alias("events"), F.array().cast(LINKS).alias("links"), (i["l_orderkey"] * 16 + i["l_linenumber"]).cast("long").alias("ingest_seq"),
    )
    return root.unionByName(item)
