"""Records of parsing: caches, pages of owned chunks, chart views, artifacts, places in a text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .stores import latest, upsert

PAGES = ("page_idx", "page_idx_end")


def chart_view(blocks: DataFrame) -> DataFrame:
    """``blocks`` with charts that have a picture shown as images; others stay.

    Captions and ``content`` (array) become the image's captions.
    """
    pictured = (F.col("type") == "chart") & (F.coalesce("img_path", F.lit("")) != "")
    shown = {
        "type": F.lit("image"),
        "caption": F.concat(C.captions(F.col("caption")), C.captions(F.col("content"))),
        "footnote": C.captions(F.col("footnote")),
    }
    return blocks.withColumns({name: F.when(pictured, value).otherwise(F.col(name)) for name, value in shown.items()})


def cached_parses(files: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """``files`` (key, mtime, options) whose parse the cache holds, with content and doc_id.

    A parse counts if it is whole and the file's time and options are those it
    was made with, whatever the options' order; any other file is parsed anew.
    """
    whole = (F.size("content") > 0) & (F.coalesce("doc_id", F.lit("")) != "")
    held = cache.filter(whole).select(key, "mtime", C.options_key(F.col("options")).alias("made_with"), "content", "doc_id")
    return files.withColumn("made_with", C.options_key(F.col("options"))).join(held, [key, "mtime", "made_with"]).drop("made_with")


def store_parses(cache: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """``cache`` with the newest of ``fresh`` in place of rows of equal key."""
    return upsert(cache, latest(fresh, [key], "cached_at").select(*cache.columns), [key])


def own_pages(chunks: DataFrame, listed: DataFrame, labels: DataFrame) -> DataFrame:
    """``chunks`` with the pages that their own document gives them.

    ``listed`` (full_doc_id, chunk_id) names the chunks of documents just
    processed, ``labels`` the pages found for some. A chunk that belongs to
    another document keeps its pages; a listed one without a label loses them.
    """
    keys = ["full_doc_id", "chunk_id"]
    found = listed.select(*keys).distinct().join(labels.select(*keys, *[F.col(p).alias(f"__{p}") for p in PAGES]), keys, "left").withColumn("__own", F.lit(True))
    pages = {p: F.when(F.col("__own"), F.col(f"__{p}")).otherwise(F.col(p)).alias(p) for p in PAGES}
    return chunks.join(found, keys, "left").select(*[pages.get(c, F.col(c)) for c in chunks.columns])


def choose_artifacts(found: DataFrame) -> DataFrame:
    """(stem, path): the best of the content lists ``found`` (stem, path, place) for each file.

    One in a folder of the file's name comes first, then the second layout
    version, then one named exactly after the file, then the least place.
    """
    name = C.base_name(F.col("path"))
    scoped = F.array_contains(F.slice(F.reverse(F.split("path", "/")), F.lit(2), F.size(F.split("path", "/"))), F.col("stem"))
    second = name.endswith("_content_list_v2.json")
    exact = F.regexp_replace(name, r"_content_list(_v2)?\.json$", "") == F.col("stem")
    return found.groupBy("stem").agg(F.max_by("path", F.struct(scoped, second, exact, -F.col("place"), "path")).alias("path"))


def located(text: Column, parts: Column) -> Column:
    """(part, start, end) of each of ``parts`` in ``text``, searched from where the last one ended.

    Empty parts and such as are not found are left out; null text holds none.
    """

    @F.pandas_udf("array<struct<part:int,start:int,end:int>>")
    def places(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for whole, some in zip(texts, lists, strict=True):
            cursor, rows = 0, []
            for k, part in enumerate(some if some is not None else []):
                at = whole.find(part, cursor) if whole and part else -1
                if at >= 0:
                    cursor = at + len(part)
                    rows.append({"part": k, "start": at, "end": cursor})
            out.append(rows)
        return pd.Series(out, dtype=object)

    return places(text, parts)
