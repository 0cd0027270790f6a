"""The step grid: sliding windows without a range join.

For steps t_k = start + k * step a row at time s lies in the closed windows [t_k - range - offset, t_k - offset] of consecutive
k; it is given to each of them by an explode of that range of numbers, and a window is then an ordinary hash aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import ceil_div, floor_div

MAX_STEPS = 11_000


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int

    def __post_init__(self):
        if self.end > self.start and self.step <= 0:
            raise ValueError("the step must be positive")
        if self.last >= MAX_STEPS:
            raise ValueError(f"more than {MAX_STEPS} steps")

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step if self.step > 0 and self.end >= self.start else 0

    def time(self, k: Column) -> Column:
        return F.lit(self.start).cast("long") + k * F.lit(self.step).cast("long")

    def steps(self, spark: SparkSession) -> DataFrame:
        """(k, t)."""
        return spark.range(self.last + 1).select(F.col("id").alias("k"), self.time(F.col("id")).alias("t"))

    def cover(self, rows: DataFrame, at: str, width: int, offset: int = 0) -> DataFrame:
        """``rows`` once for each window that holds them, with ``k`` and ``t``; rows outside are pruned by time first."""
        s = F.col(at)
        near = rows.filter(s.between(self.start - width - offset, self.start + self.last * max(self.step, 0) - offset))
        if self.last == 0:
            return near.withColumn("k", F.lit(0).cast("long")).withColumn("t", F.lit(self.start).cast("long"))
        low = F.greatest(F.lit(0).cast("long"), ceil_div(s + offset - self.start, self.step))
        high = F.least(F.lit(self.last).cast("long"), floor_div(s + offset + width - self.start, self.step))
        spans = near.withColumn("__lo", low).withColumn("__hi", high).filter("__lo <= __hi")
        out = spans.withColumn("k", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")
        return out.withColumn("t", self.time(F.col("k")))
