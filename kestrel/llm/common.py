"""Shared pieces: the shared folder, intermediate tables, pass-through Arrow maps, dense ordinals and ASCII case."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BATCH_ROWS = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Unset, a local session gets a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kestrel-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows, so Arrow batches get ``BATCH_ROWS`` of them, if the session has Spark's own default of 10,000.

    Batches are held by the JVM outside its heap and by Python at once.  The setting stays with the session.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, outlives executors, gives exact sizes."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/kestrel-llm/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing lazy reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(table: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A stored table of a few numbers a row: broadcast if it is counted to have at most ``most_rows``, else joined by shuffle."""
    return F.broadcast(table) if table.count() <= most_rows else table


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to make; names compare as Spark compares them."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that what is unpacked from it stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def with_arrow(df: DataFrame, make: Callable[[], Callable], fields: list[T.StructField]) -> DataFrame:
    """Append ``fields``, computed from whole Arrow batches.  ``make()`` runs once a task and returns batch -> arrays.

    An input column that has the name of a new field gives way to it.
    """
    small_batches(df.sparkSession)
    base = without(df, [f.name for f in fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for b in slices(batch):
                yield pa.RecordBatch.from_arrays([*b.columns, *step(b)], names=[*b.schema.names, *names])
            give_back()

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields]))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def dense_index(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Stored copy of ``df`` with ``name``: 0, 1, 2 ... in the global order of ``order``.

    A range exchange and per-partition offsets; only one row a partition meets in the window below.
    """
    t = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright(F.col("__at"), 33)
    w = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = t.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    return t.withColumn("__part", part).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__at") - F.shiftleft(F.col("__part"), 33)).drop("__part", "__start", "__at")


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and what they hold counts against the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
