"""The three stores as Parquet tables, and snapshots of them.

Labels that queries filter by are real columns, and rows are clustered by service and day, so predicates reach the scan as
partition pruning and row-group statistics.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = {"logs": ("ts_ns", 10**9), "samples": ("ts_ms", 10**3), "spans": ("start_ns", 10**9)}


def append(rows: DataFrame, root: str, signal: str) -> None:
    """Add rows to a store; order within it is imposed when it is queried."""
    column, per_second = TIME[signal]
    day = F.to_date(F.timestamp_seconds(F.col(column) / per_second))
    rows.withColumn("day", day).repartition("day").sortWithinPartitions(column).write.mode("append").partitionBy("day").parquet(f"{root}/{signal}")


def load(spark: SparkSession, root: str, signal: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{signal}").drop("day")


def _files(spark: SparkSession, path: str):
    """(file system, path) of a folder, whatever holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, root: str, signal: str) -> bool:
    fs, p = _files(spark, f"{root}/{signal}")
    return fs.exists(p)


def size(spark: SparkSession, root: str, signal: str) -> int:
    """Bytes of a table."""
    fs, p = _files(spark, f"{root}/{signal}")
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def replace(rows: DataFrame, root: str, signal: str) -> None:
    """``rows`` instead of a table that they may be made of: written beside it, then put in its place."""
    spark = rows.sparkSession
    side = f"{root}/.new-{uuid.uuid4().hex}"
    if signal in TIME:
        append(rows, side, signal)
    else:
        rows.write.parquet(f"{side}/{signal}")
    fs, old = _files(spark, f"{root}/{signal}")
    _, new = _files(spark, f"{side}/{signal}")
    kept = bool(spark.read.schema(rows.schema).parquet(f"{side}/{signal}").head(1))
    if fs.exists(old):
        fs.rename(old, new.suffix(".old"))
    if kept:
        fs.rename(new, old)
    fs.delete(new.getParent(), True)


def save_snapshot(signals: dict[str, DataFrame], path: str) -> None:
    """All signals, and then a manifest: a snapshot without one is incomplete and will not load."""
    spark = next(iter(signals.values())).sparkSession
    for name, df in signals.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(n, df.schema.json()) for n, df in signals.items()], "signal string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from pyspark.sql.types import StructType
    import json

    rows = spark.read.schema("signal string, schema string").json(f"{path}/manifest").collect()
    return {r["signal"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{path}/{r['signal']}") for r in rows}
