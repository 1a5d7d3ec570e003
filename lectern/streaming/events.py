"""Event streams: windowed counts, sessions, status from events, ingest.

Every function takes a batch or a streaming DataFrame; on a stream the
watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The states a document passes, in order; failed ends it at any point.
STATES = ("ready", "handling", "pending", "processing", "processed")


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if events.isStreaming else out


def event_windows(events: DataFrame, size: str, slide: str | None = None, ts: str = "ts", kind: str = "event_type", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) of tumbling or sliding windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = _timed(events, ts, late).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs whose events lie less than ``gap`` apart."""
    w = F.session_window(ts, gap)
    out = _timed(events, ts, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(rows: DataFrame, ident: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose id was not seen within the watermark: idempotent re-ingest."""
    if rows.isStreaming:
        return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([ident])
    return rows.dropDuplicates([ident])


def advance_status(moves: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """(key, status): the furthest state of a document; failed is kept."""
    at = F.array_position(F.array(*map(F.lit, STATES)), F.col(state))
    out = moves.groupBy(key).agg(F.max((F.col(state) == "failed").cast("int")).alias("bad"), F.max_by(state, F.struct(at, order)).alias("last"))
    return out.select(key, F.when(F.col("bad") == 1, "failed").otherwise(F.col("last")).alias("status"))


def ingest(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``merge(batch, number)`` once for everything that is there now.

    The checkpoint makes a second run skip what the first has taken; ``merge``
    must give the same result if a batch comes again.
    """
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
