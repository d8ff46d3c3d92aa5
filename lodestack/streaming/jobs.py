"""Incremental runs of the batch plans: documents to chunks and vectors, and usage in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def usage_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and failures by hour and type; repeated events count once, later ones than `late` not at all, on a stream."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    found = once.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "calls", "value")


def usage_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events that follow each other within the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("calls"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "calls")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there to Parquet and ends. In complete mode each batch replaces what the one before wrote."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ingest_stream(spark: SparkSession, path: str, ingest: Callable[[DataFrame], object], checkpoint: str) -> StreamingQuery:
    """Hands files that arrive under path to ingest (as binaryFile rows), a batch at a time; a repeated batch is harmless, as ingest replaces."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    q = files.writeStream.foreachBatch(lambda rows, n: ingest(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def record_stream(events: DataFrame, record: Callable[[DataFrame], int], checkpoint: str) -> StreamingQuery:
    """Hands usage events to Engine.record_usage, a batch at a time; a batch that is run again adds nothing, as events are told by id."""
    q = events.writeStream.foreachBatch(lambda rows, n: record(rows) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
