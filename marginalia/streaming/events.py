"""Streaming twins: windows with watermarks, replay removal, and keyed debouncing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of events as a stream, a few files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def windowed_counts(events: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Counts and sums for each type and tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def without_replays(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def debounced(events: DataFrame, quiet_ms: int = 500, late: str = "0 seconds") -> DataFrame:
    """(user_id, first_ms, last_ms, n): one row for each burst of a user, when the next burst begins or the watermark passes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        first, last, n = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            out.append((key[0], first, last, n))
            state.remove()
        else:
            for t in sorted(int(t.value // 1_000_000) for b in batches for t in b["ts"]):
                if n and t - last >= quiet_ms:
                    out.append((key[0], first, last, n))
                    first, n = None, 0
                first, last, n = (t if first is None else first), max(t, last or t), n + 1
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "first_ms", "last_ms", "n"])

    keyed = events.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(run, "user_id long, first_ms long, last_ms long, n long", "first long, last long, n long", "append", "EventTimeTimeout")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available now, through the memory sink; for tests and small jobs."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
