"""Content blocks: splitting texts, offsets, assembly, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blank, md5_id

SEPARATOR = "\n\n"


def line_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_idx, text): the lines of a text, numbered from 0."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("block_idx", "text"))


def split_kinds(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text blocks that are not blank, and blocks of other kinds; no kind is text."""
    kind = F.coalesce(F.col("type"), F.lit("text"))
    return blocks.filter((kind == "text") & ~blank(F.col("text"))), blocks.filter(kind != "text")


def block_offsets(texts: DataFrame, key: str = "doc_id", order: str = "block_idx", gap: int = len(SEPARATOR)) -> DataFrame:
    """``texts`` with start and end of each in the joined document text."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0)).cast("long")
    return texts.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def assemble(texts: DataFrame, key: str = "doc_id", order: str = "block_idx", glue: str = SEPARATOR) -> DataFrame:
    """(key, text): a document's texts in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return texts.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["t"]), glue).alias("text"))


def kind_histogram(blocks: DataFrame, key: str, kind: str = "type") -> DataFrame:
    return blocks.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))


def content_ids(blocks: DataFrame, key: str = "doc_id", order: str = "block_idx") -> DataFrame:
    """(key, content_id): one id for equal blocks in equal order."""
    signature = F.concat(F.coalesce(F.col("type"), F.lit("text")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return assemble(blocks.withColumn("text", signature), key, order, "\n").select(key, md5_id("doc-", F.col("text")).alias("content_id"))


def append_missing(blocks: DataFrame, found: DataFrame, key: str = "doc_id", kind: str = "equation") -> DataFrame:
    """``blocks`` and those of ``found`` (key, text) whose text they lack, on the last page."""
    known = blocks.filter(F.col("type") == kind).select(key, "text")
    last = blocks.groupBy(key).agg(F.max_by("page_idx", "block_idx").alias("page_idx"), F.max("block_idx").alias("top"))
    fresh = found.dropDuplicates([key, "text"]).join(known, [key, "text"], "left_anti").join(last, key)
    at = F.col("top") + F.row_number().over(Window.partitionBy(key).orderBy("text"))
    return blocks.select(key, "block_idx", "type", "text", "page_idx").unionByName(fresh.select(key, at.cast("int").alias("block_idx"), F.lit(kind).alias("type"), "text", "page_idx"))
