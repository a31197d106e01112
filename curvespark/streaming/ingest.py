"""Streaming ingest: gap sessions by watermark, and micro-batches appended to a keyed vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(track, start, stop, n) of runs of events whose gaps are at most `gap`; later rows than the watermark go."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("track", s.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop")).select("track", "start", "stop", "n")


def append_vectors(stream: DataFrame, keyed, path: str, checkpoint: str):
    """Starts a query that keys every micro-batch (keyed: DataFrame -> DataFrame, with its model frozen) and writes it to path.

    A batch has a folder of its own, batch=<number>, so one that is run again after a failure replaces itself.
    """
    write = lambda batch, n: keyed(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
