"""Stores as tables: latest-wins merges, set unions, manifests, status rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``: an aggregate that combines early."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_fields(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides by key; a field that ``new`` leaves null keeps its value."""
    fields = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields])
    return old.join(renamed, keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in fields])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def union_lists(old: DataFrame, new: DataFrame, key: str, items: str) -> DataFrame:
    """(key, items, n): old items, then new ones not among them, in order."""
    rows = old.select(key, F.lit(0).alias("side"), items).unionByName(new.select(key, F.lit(1).alias("side"), items))
    lists = F.array_sort(F.collect_list(F.struct("side", F.col(items).alias("v"))))
    joined = rows.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(lists, lambda x: x["v"]))).alias(items))
    return joined.withColumn("n", F.size(items).cast("long"))


def todo(files: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose keys (path, size, time, options) the manifest does not hold."""
    return files.join(manifest.filter("md5 is not null").select(*keys), keys, "left_anti")


def skipped(files: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    return files.join(manifest.filter("md5 is not null").select(*keys), keys, "left_semi")


def finish_status(status: DataFrame) -> DataFrame:
    """Status rows after the last stage: failed stays failed, the flag is set."""
    return status.withColumns({"status": F.when(F.col("status") == "failed", "failed").otherwise("processed"), "multimodal_processed": F.lit(True)})


def fully_processed(status: DataFrame) -> DataFrame:
    done = (F.col("status") == "processed") & F.coalesce(F.col("multimodal_processed"), F.lit(False))
    return status.withColumn("fully_processed", done)


def drop_placeholders(status: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Status rows whose text was stored."""
    return status.join(texts.select(key).distinct(), key, "left_semi")


def same_sets(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """(key, same): whether both sides hold the same items for a key."""
    side = lambda df, name: df.groupBy(key).agg(F.collect_set(item).alias(name))
    both = side(a, "x").join(side(b, "y"), key, "full_outer")
    empty = F.array().cast(both.schema["x"].dataType)
    x, y = F.coalesce("x", empty), F.coalesce("y", empty)
    return both.select(key, ((F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)).alias("same"))
