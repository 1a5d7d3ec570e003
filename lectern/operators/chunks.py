"""Chunks: fixed windows over texts, and the pages they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_id
from .intervals import overlap_join


def _starts(n: Column, step: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def char_windows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_idx, start, end, content): windows of ``size`` characters."""
    body = F.coalesce(F.col(text), F.lit(""))
    step = size - overlap
    # The text falls into steps once; a window is a few steps put together, so
    # no row carries the whole text and none walks it from the start.
    rows = docs.select(key, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("steps"))
    window = lambda k: F.substring(F.array_join(F.slice("steps", k + 1, -(-size // step)), ""), 1, size)
    rows = rows.select(key, F.posexplode(F.transform("steps", lambda _, k: window(k))).alias("chunk_idx", "content"))
    start = F.col("chunk_idx").cast("long") * step
    return rows.select(key, "chunk_idx", start.alias("start"), (start + F.length("content")).alias("end"), "content")


def word_windows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_idx, n_words, content): windows of ``size`` words."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    rows = docs.select(key, words.alias("words"))
    rows = rows.select(key, "words", F.posexplode(_starts(F.size("words"), size - overlap)).alias("chunk_idx", "start"))
    part = F.slice("words", F.col("start") + 1, size)
    return rows.select(key, "chunk_idx", F.size(part).alias("n_words"), F.array_join(part, " ").alias("content"))


def chunk_pages(chunks: DataFrame, blocks: DataFrame, key: str = "doc_id", page: str = "page_idx") -> DataFrame:
    """(key, chunk_idx, page_idx, page_idx_end): least and greatest page a chunk overlaps.

    ``page_idx_end`` is null where it equals the first; chunks on no page are
    left out. Blocks without a page are passed over.
    """
    pages = blocks.filter(F.col(page).isNotNull()).select(key, F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col(page).alias("page"))
    hits = overlap_join(chunks.select(key, "chunk_idx", "start", "end"), pages, key, ("start", "end"), ("p_start", "p_end"), 4096)
    low, high = F.min("page").cast("long"), F.max("page").cast("long")
    return hits.groupBy(key, "chunk_idx").agg(low.alias("page_idx"), F.when(high != low, high).alias("page_idx_end"))


def chunk_rows(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks as stored: keyed by content, equal text in one document once.

    Of equal chunks the last place in the order stands.
    """
    rows = chunks.select(md5_id("chunk-", F.col("content")).alias("chunk_id"), F.col(key).alias("full_doc_id"), F.col("chunk_idx").alias("chunk_order_index"), "content")
    return rows.groupBy("full_doc_id", "chunk_id").agg(F.max("chunk_order_index").alias("chunk_order_index"), F.first("content").alias("content"))
