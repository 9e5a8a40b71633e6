"""Sessions of a stream of events: keyed state under a watermark, late rows counted, restarted from a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """key, start, last and n of each session: rows of a key with steps of at most gap (an interval) between them.

    On a stream a session is given once, when the watermark (the latest time seen less delay) has passed its end; rows
    before the watermark come too late and are dropped and counted, see late(). State is held per key and open session and
    merged before the shuffle, so it grows with the open sessions and not with the rows. On a table all sessions are given.

    Edge cases: rows without a time are in no session; null keys are one key. Rows that occur twice count twice. An empty
    input gives no sessions.
    """
    rows = events.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time")).where("time is not null")
    if events.isStreaming:
        rows = rows.withWatermark("time", delay)
    held = rows.groupBy(F.session_window("time", f"{gap} 1 microsecond").alias("session"), "key").agg(F.min("time").alias("start"), F.max("time").alias("last"), F.count("*").alias("n"))
    return held.select(F.col("key").alias(key), "start", "last", "n")


def keep(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the sessions that close to the table at path until all present input is read.

    A query started again with the same checkpoint goes on where the last one ended, with its state; the table's own log
    makes a batch that is written again count once.
    """
    return found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late(query: StreamingQuery) -> int:
    """The rows of this run that came after the watermark; rows of one key, session and batch were merged to one before."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
