"""Streams of turns and events: windows, suppression of repeats, and an incremental index as a sink.

A sink writes each micro-batch as one version of a manifest table together with the batch's number, so a batch that is
delivered again after a failure is recognised and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import ManifestTable
from ..session import scratch


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files of a folder with a name pattern, as they arrive."""
    schema = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_batch)).parquet(folder)


def with_event_time(stream: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], value: str) -> DataFrame:
    """(start, keys, events, total) of each window; needs event time with a watermark to append."""
    return stream.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "events", "total")


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str]) -> DataFrame:
    """(started, ended, keys, events) of each session, which ends after a gap."""
    return stream.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *keys, "events")


def without_repeats(stream: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key within the watermark's delay; state is dropped after it."""
    return stream.dropDuplicatesWithinWatermark(keys)


def index_into(path: str, transform: Callable[[DataFrame], DataFrame], name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that commits each batch once, with its number."""

    def write(batch: DataFrame, number: int) -> None:
        table = ManifestTable(batch.sparkSession, path)
        if table.processed(name) >= number + 1:
            return
        table.append(transform(batch), processed={name: number + 1})

    return write


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process what is there now, then stop."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_table(stream: DataFrame) -> DataFrame:
    """Run a bounded stream to its end and give what it appended as a table.

    Windows and sessions are appended once the watermark has passed their end, and their state is dropped then; those still open
    at the end of the stream are no result. Each batch is one version of a manifest table, so one that is delivered again is
    not written twice.
    """
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "stream")
    query = stream.writeStream.outputMode("append").foreachBatch(index_into(out, lambda batch: batch)).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return ManifestTable(spark, out).live()
