"""Queries whose operators parse or call models; rows are checked by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.resilience import breaker_states
from ..operators import items
from ..sources.html import read_html
from ..streaming.events import sessions
from .ingest import ingest
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add()
def html_page_blocks(t):
    return read_html(t("pages"))


def _content(t):
    """Conversations as content lists: assistants' turns are tables of their text."""
    none = F.lit(None).cast("string")
    table = F.col("role") == "assistant"
    return t("conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("block_idx"),
        F.when(table, "table").otherwise("text").alias("type"),
        F.when(~table, F.col("text")).alias("text"),
        F.when(F.col("role") == "system", 1).alias("text_level"),
        F.floor(F.col("turn") / 2).cast("int").alias("page_idx"),
        F.when(table, F.array(F.concat(F.lit("Turn "), F.col("turn")))).alias("caption"),
        F.lit(None).cast("array<string>").alias("footnote"),
        F.when(table, F.col("text")).alias("body"),
        none.alias("text_format"),
    )


@R.add()
def ingest_status(t):
    return ingest(_content(t)).status


@R.add()
def ingest_item_chunks(t):
    return ingest(_content(t)).item_chunks.select("doc_id", "block_idx", "chunk_order_index", "chunk_id", "entity_name", "entity_type", "summary")


@R.add()
def ingest_edges(t):
    return ingest(_content(t)).edges


def _segments(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    e = t("events").select("user_id", "event_id", "event_type", at.alias("s"), (at + F.greatest(F.col("value"), F.lit(0.0)) * 60).alias("f"))
    speech = e.filter("event_type <> 'view'").select("user_id", F.col("event_id").alias("seg_idx"), F.col("s").alias("s_start"), F.col("f").alias("s_end"), F.col("event_type").alias("text"))
    scenes = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("scene_idx"), F.col("s").alias("start"), F.col("f").alias("end"), F.lit("view").alias("visual"))
    return scenes, speech


@R.add()
def audio_sections(t):
    return items.section_names(items.audio_windows(_segments(t)[1], "user_id", 20).withColumn("name", F.concat(F.lit("audio "), "user_id")), "user_id", "window", "name")


@R.add()
def video_sections(t):
    scenes, speech = _segments(t)
    rows = items.video_windows(scenes, speech, "user_id", 40, 5, 4)
    text = items.merged_channels(F.col("start"), F.col("end"), F.col("visual"), F.col("speech"))
    parts = F.array_sort(F.collect_list(F.struct("scene_idx", text.alias("t"))))
    return rows.groupBy("user_id", "window").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("text"))


@R.add()
def breaker_log(t):
    log = t("events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"), (F.col("event_type") != "error").alias("ok"))
    return breaker_states(log, "user_id", 2, 3600.0)


@R.add("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    return sessions(t("events"), "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
