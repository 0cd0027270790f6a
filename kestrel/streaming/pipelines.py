"""Continuous ingestion with Structured Streaming: landing files to stores, exactly once a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest, store, wire

READERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "push": ("logs", ingest.push),
    "export_logs": ("logs", ingest.export_logs),
    "export_metrics": ("samples", lambda r: ingest.export_metrics(r)[0]),
    "export_traces": ("spans", ingest.export_traces),
    "remote_write": ("samples", ingest.remote_write),
}
#: Arrival numbers of a batch begin at its number times this.
BATCH = 1 << 40


def follow(spark: SparkSession, landing: str, kind: str, root: str, checkpoint: str, binary: bool = False, **trigger):
    """Start a stream of landing files into a store.  Late rows are accepted; retention drops the old.

    Files hold JSON, one request a line, or with ``binary`` one request each in any wire form.
    """
    signal, reader = READERS[kind]

    def write(batch: DataFrame, number: int) -> None:
        rows = reader(batch)
        rows = rows.withColumn("ingest_seq", F.lit(number * BATCH).cast("long") + F.col("ingest_seq") % BATCH).withColumn("batch", F.lit(number).cast("long"))
        column, per_second = store.TIME[signal]
        day = F.to_date(F.timestamp_seconds(F.col(column) / per_second))
        # a batch that is run again replaces what it wrote before
        out = rows.withColumn("day", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("batch", "day").parquet(f"{root}/{signal}")

    if binary:
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(landing)
        requests = files.select(F.col("content").alias("body"))
        if kind != "remote_write":
            requests = wire.decoded(requests, kind)
    else:
        requests = spark.readStream.schema("value string").text(landing).select(F.col("value").alias("body"))
    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def recent_activity(logs: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Entries and errors of each service and window of a stream of logs; windows close once the watermark passes them."""
    t = logs.withColumn("ts", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long"))).withWatermark("ts", late)
    return t.groupBy(F.window("ts", window).alias("window"), "service").agg(F.count("*").alias("entries"), F.count_if(F.col("level") == "error").alias("errors"))
