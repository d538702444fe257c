"""Windowed and per-key counters that run the same on a table and on a stream.

A stream gets a watermark; a table needs none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.events import DOMAINS, fan_out

LATENESS = "10 minutes"
RESET = "60 minutes"
IDLE = "30 seconds"


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    return rows.withWatermark("ts", lateness) if rows.isStreaming else rows


def hourly_counters(samples: DataFrame, reset: str = RESET, lateness: str = LATENESS) -> DataFrame:
    """Counters of a process that start again every window of event time."""
    return _timed(samples, lateness).groupBy("pid", F.window("ts", reset)).agg(
        F.count(F.lit(1)).alias("events"), F.sum("oncpu_time").alias("oncpu_total")).select(
        "pid", F.col("window.start").alias("window_start"), "events", "oncpu_total")


def one_warning(warnings: DataFrame, keys: list[str], interval: str = "1 second", lateness: str = LATENESS) -> DataFrame:
    """At most one warning per key and interval of a stream."""
    slot = warnings.withColumn("slot", F.window("ts", interval).getField("start"))
    if warnings.isStreaming:
        return slot.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([*keys, "slot"])
    return slot.dropDuplicates([*keys, "slot"])


def client_sessions(activity: DataFrame, idle: str = IDLE, lateness: str = LATENESS) -> DataFrame:
    """Spans of activity of a client; it is idle from the end of each."""
    return _timed(activity, lateness).groupBy("client", F.session_window("ts", idle)).agg(
        F.count(F.lit(1)).alias("events")).select(
        "client", F.col("session_window.start").alias("active_from"), F.col("session_window.end").alias("idle_from"), "events")


def fan_out_stream(records: DataFrame, sink: Callable[[str, DataFrame, int], None], checkpoint: str,
                   available_now: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Hand each domain of every micro-batch to ``sink(domain, rows, batch)``.

    The trigger interval sets how often reports are made.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for domain, rows in fan_out(batch, DOMAINS).items():
            sink(domain, rows, number)
        batch.unpersist()

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
