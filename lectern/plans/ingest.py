"""The whole way of a content list into the stores, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import blocks, chunks, context, graph, items, stores


@dataclass(frozen=True)
class Settings:
    """Sizes of chunks in characters, context reach, and the entity pattern."""

    chunk_size: int = 1200
    overlap: int = 100
    reach: int = 1
    most_context: int = 2000
    pattern: str = "[A-Z][a-z]+"


@dataclass(frozen=True)
class Stores:
    """The tables of one ingest; nothing is computed until they are written."""

    text_chunks: DataFrame
    item_chunks: DataFrame
    entities: DataFrame
    edges: DataFrame
    status: DataFrame


def ingest(content: DataFrame, settings: Settings = Settings(), model=items.stub_model) -> Stores:  # noqa: B008
    """Stores of (doc_id, block_idx, type, text, text_level, page_idx, caption, footnote, body, text_format).

    Texts become chunks with pages; other blocks are described in their
    context and become chunks and entities; what is found in an item's chunk
    belongs to the item.
    """
    texts, others = blocks.split_kinds(content)
    placed = blocks.block_offsets(texts)
    cut = chunks.char_windows(blocks.assemble(placed), settings.chunk_size, settings.overlap)
    pages = chunks.chunk_pages(cut, placed)
    text_chunks = chunks.chunk_rows(cut).join(pages.withColumnRenamed("doc_id", "full_doc_id").withColumnRenamed("chunk_idx", "chunk_order_index"), ["full_doc_id", "chunk_order_index"], "left")

    shown = C.block_text(F.coalesce("type", F.lit("")), F.col("text"), F.col("text_level"), F.col("caption"))
    seen = context.page_context(content.withColumn("shown", shown), "doc_id", "page_idx", "block_idx", F.col("shown"), F.col("type") == "text", settings.reach)
    around = seen.select("doc_id", "block_idx", C.cut_at_sentence(F.col("context"), settings.most_context).alias("context"))
    described = items.describe(others.join(around, ["doc_id", "block_idx"]), model)
    body = F.concat_ws("\n", F.concat(F.lit("["), "type", F.lit("]")), F.array_join(C.captions(F.col("caption")), "; "), F.col("body"), "description")
    item_chunks = described.withColumn("content", body).withColumn("chunk_id", C.md5_id("chunk-", F.col("content")))
    counts = text_chunks.groupBy("full_doc_id").agg(F.count(F.lit(1)).alias("chunks_count")).withColumnRenamed("full_doc_id", "doc_id")
    item_chunks = items.order_in_document(item_chunks, counts, "doc_id", "block_idx")

    own = item_chunks.select("chunk_id", F.col("entity_name").alias("item_entity"))
    found = graph.mentions(text_chunks.select("chunk_id", "content").unionByName(item_chunks.select("chunk_id", "content")), "chunk_id", "content", settings.pattern)
    belongs = graph.belongs_to(found, own, "chunk_id")
    near = graph.neighbours(found, "chunk_id")
    edges = near.select("src", "tgt", "weight").unionByName(belongs.select("src", "tgt", "weight"))
    entities = graph.nodes(found, "chunk_id").select("entity", "docs").unionByName(own.groupBy(F.col("item_entity").alias("entity")).agg(F.count(F.lit(1)).alias("docs")))
    n_items = item_chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"))
    status = content.select("doc_id").distinct().join(counts, "doc_id", "left").join(n_items, "doc_id", "left")
    status = status.select("doc_id", (F.coalesce("chunks_count", F.lit(0)) + F.coalesce("items", F.lit(0))).alias("chunks_count"), F.lit("processing").alias("status"))
    return Stores(text_chunks, item_chunks, entities.groupBy("entity").agg(F.max("docs").alias("docs")), graph.merge_edges(edges.withColumn("source", F.lit("")), "source").drop("sources"), stores.finish_status(status))
