"""Streaming forms: first sightings of a digest, and counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_sightings(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the watermark; state is bounded by the delay."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def settled_counts(stream: DataFrame, key: str, time: str, window: str, delay: str) -> DataFrame:
    """Counts per key and window, given out once the window is past its delay."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def settled_sessions(stream: DataFrame, key: str, time: str, gap: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """(key, start, last, changes): sessions of changes that have closed, that is, no change of the key came
    for `gap` and the watermark has passed that. What still changes is not given out; state is bounded by
    the sessions that are open within the delay."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    closed = timed.groupBy(F.session_window(time, gap).alias("_session"), key).agg(F.max(time).alias("last"), F.count("*").alias("changes"))
    return closed.select(key, F.col("_session.start").alias("start"), "last", "changes")


def run_available(rows: DataFrame, path: str) -> DataFrame:
    """What a stream gives out over all that is there now, as a table below `path`, where its checkpoint
    lies too: a second run goes on after the first."""
    query = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
