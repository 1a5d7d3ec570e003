"""Context of a block: headings above it, texts around it, pages beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heading_path(blocks: DataFrame, key: str, order: str, level: str, text: str, deepest: int = 6, glue: str = " > ") -> DataFrame:
    """``blocks`` with ``section_path``: the headings that hold each block.

    For every level the last heading before the block counts if no heading of
    a higher rank came after it; the block's own heading does not.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__h{k}" for k in range(1, deepest + 1)]
    out = blocks.withColumns({n: F.last(F.when((F.col(level) == k) & (F.trim(text) != ""), F.struct(F.col(order).alias("o"), F.trim(text).alias("t"))), ignorenulls=True).over(w) for k, n in enumerate(names, 1)})
    parts = []
    for k, n in enumerate(names):
        above = [F.coalesce(F.col(f"{m}.o"), F.lit(-1)) for m in names[:k]]
        holds = F.col(f"{n}.o") > (F.greatest(*above) if len(above) > 1 else above[0]) if above else F.col(f"{n}.o").isNotNull()
        parts.append(F.when(holds, F.col(f"{n}.t")))
    return out.withColumn("section_path", F.concat_ws(glue, *parts)).drop(*names)


def neighbor_text(blocks: DataFrame, key: str, order: str, kind: Column, text: str, reach: int = 3, glue: str = " ") -> DataFrame:
    """``blocks`` with ``neighbor_text``: texts up to ``reach`` places away, itself left out.

    All kinds of blocks count as places; only texts that are not blank are taken.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    near = F.collect_list(F.when(kind & (F.trim(text) != ""), F.struct(F.col(order).alias("o"), F.trim(text).alias("t")))).over(w)
    return blocks.withColumn("__near", near).withColumn("neighbor_text", F.array_join(F.transform(F.filter("__near", lambda x: x["o"] != F.col(order)), lambda x: x["t"]), glue)).drop("__near")


def chunk_context(blocks: DataFrame, key: str, order: str, text: str, reach: int = 1, glue: str = "\n") -> DataFrame:
    """``blocks`` with ``context``: texts of the ``reach`` blocks before and after."""
    return neighbor_text(blocks, key, order, F.lit(True), text, reach, glue).withColumnRenamed("neighbor_text", "context")


def page_context(blocks: DataFrame, key: str, page: str, order: str, shown: Column, taken: Column, reach: int = 1) -> DataFrame:
    """``blocks`` with ``context``: texts on pages up to ``reach`` away, in document order.

    Blocks on the same page are among them, the block itself too if ``taken``
    holds for it; texts of other pages carry their page.
    """
    at = F.coalesce(F.col(page), F.lit(0))
    w = Window.partitionBy(key).orderBy("__page").rangeBetween(-reach, reach)
    near = F.array_sort(F.collect_list(F.when(taken & (F.trim(shown) != ""), F.struct(F.col(order).alias("o"), F.col("__page").alias("p"), shown.alias("t")))).over(w))
    label = lambda x: F.when(x["p"] == F.col("__page"), x["t"]).otherwise(F.concat(F.lit("[Page "), x["p"].cast("string"), F.lit("] "), x["t"]))
    out = blocks.withColumn("__page", at).withColumn("__near", near)
    return out.withColumn("context", F.array_join(F.transform("__near", label), "\n")).drop("__near", "__page")
