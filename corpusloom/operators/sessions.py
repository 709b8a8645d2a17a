"""Sequences in event rows: previous rows, running sums, episodes and gaps.

One user may own a third of all rows, so nothing is ordered over a whole user. Rows are ordered within slices of time; each
slice hands its last time and its sum to the next ones through a table of one row for each user and slice. Rows without a
time form a slice of their own before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice.
SLICE_S = 3600


def _sliced(rows: DataFrame, ts: str, slice_s: int) -> DataFrame:
    return rows.withColumn("__slice", F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slice_s * 1_000_000)), F.lit(-(1 << 60))))


def with_previous(rows: DataFrame, keys: list[str], ts: str, order: list[str], slice_s: int = SLICE_S) -> DataFrame:
    """The rows with ``previous``, the time of the row before in the order of time and ``order``; null for a key's first."""
    s = _sliced(rows, ts, slice_s)
    last = s.groupBy(*keys, "__slice").agg(F.max(ts).alias("__last"))
    carried = last.select(*keys, "__slice", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__slice")).alias("__carried"))
    inner = F.lag(ts).over(Window.partitionBy(*keys, "__slice").orderBy(ts, *order))
    return s.withColumn("__inner", inner).join(carried, [*keys, "__slice"]).withColumn("previous", F.coalesce("__inner", "__carried")).drop("__slice", "__inner", "__carried")


def with_running_sum(rows: DataFrame, keys: list[str], ts: str, order: list[str], flag: Column, name: str, slice_s: int = SLICE_S) -> DataFrame:
    """The rows with the sum of a number over all rows of the key up to each, in the order of time and ``order``."""
    s = _sliced(rows, ts, slice_s).withColumn("__flag", flag.cast("bigint"))
    total = s.groupBy(*keys, "__slice").agg(F.sum("__flag").alias("__total"))
    before = total.select(*keys, "__slice", F.sum("__total").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inner = F.sum("__flag").over(Window.partitionBy(*keys, "__slice").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("__inner", inner).join(before, [*keys, "__slice"]).withColumn(name, F.col("__inner") + F.coalesce("__before", F.lit(0))).drop("__slice", "__flag", "__inner", "__before")


def episodes(rows: DataFrame, key: str, ts: str, order: list[str], starts: Column) -> DataFrame:
    """The rows with ``episode``, the running number of rows that open one; rows before the first have 0."""
    return with_running_sum(rows, [key], ts, order, F.when(starts, 1).otherwise(0), "episode")


def gap_sessions(rows: DataFrame, key: str, ts: str, order: str, gap_s: int) -> DataFrame:
    """The rows with ``session``, which ends where the next row comes later than the gap."""
    apart = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp")) > gap_s * 1_000_000
    flagged = with_previous(rows, [key], ts, [order]).withColumn("__new", F.coalesce(apart, F.lit(True)).cast("int")).drop("previous")
    return with_running_sum(flagged, [key], ts, [order], F.col("__new"), "session").drop("__new")
