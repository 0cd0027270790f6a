"""Intermediate tables of plans that run in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may leave that unset and gets a temporary folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kestrel-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/kestrel/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read again: it outlives executors, and plans stay short."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sum_before(df: DataFrame, order: list[str], n: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``n`` over all rows that come earlier in ``order`` (a total order).

    Rows are dealt by ranges and summed within each; only one row a range meets in the window over the ranges.
    """
    t = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = t.groupBy("__part").agg(F.sum(n).alias("__sum"))
    starts = parts.select("__part", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = F.sum(n).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return t.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.coalesce(within, F.lit(0))).drop("__part", "__start")  # a row a partition
