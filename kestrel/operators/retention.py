"""Retention: what stays after age limits, caps and resets.  All return the surviving rows, to be written elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.rounds import sum_before


def by_age(rows: DataFrame, column: str, cutoff: int) -> DataFrame:
    """Rows at or after the cutoff; on a table partitioned by time this drops partitions."""
    return rows.filter(F.col(column) >= cutoff)


def cap_logs(logs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` entries: the oldest entries of the stream that begins first go first, then those of the next stream."""
    per = logs.groupBy("key").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first"))
    total = per.agg(F.sum("n")).first()[0] or 0
    excess = total - most
    if excess <= 0:
        return logs
    gone = F.least("n", F.greatest(F.lit(0), F.lit(excess) - F.col("before"))).alias("gone")
    cut = sum_before(per, ["first", "key"], "n", "before").select(F.col("key").alias("k"), gone)
    rank = F.row_number().over(W.partitionBy("key").orderBy("ts_ns", "ingest_seq"))
    return logs.withColumn("__n", rank).join(cut, F.col("key") == F.col("k")).filter("__n > gone").select(*logs.columns)


def cap_series(samples: DataFrame, most: int) -> DataFrame:
    """At most ``most`` series: those whose first sample is oldest go."""
    first = samples.groupBy("key").agg(F.min("ts_ms").alias("first"))
    n = first.count()
    if n <= most:
        return samples
    kept = first.orderBy(F.desc("first"), F.desc("key")).limit(most)
    return samples.join(kept, "key", "left_semi")


def cap_spans(spans: DataFrame, most: int) -> DataFrame:
    """Whole traces, newest first, as long as their spans do not exceed ``most``; the oldest go."""
    per = spans.groupBy("trace_id").agg(F.count("*").alias("n"), F.min("start_ns").alias("first"))
    excess = (per.agg(F.sum("n")).first()[0] or 0) - most
    if excess <= 0:
        return spans
    kept = sum_before(per, ["first", "trace_id"], "n", "before").filter(F.col("before") >= excess)
    return spans.join(kept, "trace_id", "left_semi")


def prune_metadata(metadata: DataFrame, samples: DataFrame) -> DataFrame:
    """Metadata of metrics that still have a sample."""
    return metadata.join(samples.select("metric").distinct(), "metric", "left_semi")


def without_service(rows: DataFrame, service: str) -> DataFrame:
    """Everything but one service's rows; other services' spans of a shared trace stay."""
    found = F.col("service") if "service" in rows.columns else F.col("labels")["service"]
    return rows.filter(~found.eqNullSafe(service))
