"""Intervals in time or text: overlaps, gaps, packing into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], width: float | None = None) -> DataFrame:
    """Pairs of one key whose intervals overlap; touching ends do not.

    Both sides go into buckets of ``width``, so the join is an equi-join on
    (key, bucket); a pair is taken in the later of its two first buckets only,
    which makes it unique without a second shuffle. Without a ``width``,
    buckets are as wide as the intervals are long on average: however long
    they are, there are three times as many rows at most.
    """
    if width is None:
        size = lambda df, s, e: df.select((F.col(e) - F.col(s)).cast("double").alias("__size")).filter("__size > 0")
        mean = F.coalesce(F.greatest(F.avg("__size"), F.lit(1.0)), F.lit(1.0))
        wide = F.broadcast(size(left, *a).unionByName(size(right, *b)).agg(mean.alias("__width")))
        left, right = left.crossJoin(wide), right.crossJoin(wide)
    else:
        left, right = (df.withColumn("__width", F.lit(float(width))) for df in (left, right))
    first = lambda at: F.floor(F.col(at) / F.col("__width"))
    # The last bucket is the one that holds what lies just before the end.
    spread = lambda s, e: F.sequence(first(s), F.greatest(first(s), F.ceil(F.col(e) / F.col("__width")) - 1))
    x = left.withColumn("__x", first(a[0])).withColumn("__bucket", F.explode(spread(*a))).drop("__width")
    y = right.withColumn("__y", first(b[0])).withColumn("__bucket", F.explode(spread(*b))).drop("__width")
    # Spark's estimate leaves out what the buckets add, so it might broadcast any number of rows.
    hit = x.join(y.hint("merge"), [key, "__bucket"]).filter((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))
    return hit.filter(F.col("__bucket") == F.greatest("__x", "__y")).drop("__bucket", "__x", "__y")


def texts_in_range(scenes: DataFrame, segments: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """(key, scene_idx, transcript): texts of segments that overlap a scene, in order.

    ``scenes``: key, scene_idx, start, end. ``segments``: key, seg_idx,
    s_start, s_end, text. Equal starts keep the order of ``seg_idx``.
    """
    hits = overlap_join(scenes, segments, key, ("start", "end"), ("s_start", "s_end"), width)
    rows = F.array_sort(F.collect_list(F.struct("s_start", "seg_idx", "text")))
    return hits.groupBy(key, "scene_idx").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("transcript"))


def outside(segments: DataFrame, scenes: DataFrame, key: str, ident: str = "seg_idx", width: float | None = None) -> DataFrame:
    """Segments that overlap no scene."""
    seen = overlap_join(segments, scenes.select(key, "start", "end"), key, ("s_start", "s_end"), ("start", "end"), width)
    return segments.join(seen.select(key, ident).distinct(), [key, ident], "left_anti")


def islands(rows: DataFrame, key: str, start: str, end: str, *order: str) -> DataFrame:
    """``rows`` with ``island``: numbered runs of intervals that touch or overlap."""
    w = Window.partitionBy(key).orderBy(start, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return rows.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def pack_in_order(tokens: Column, budget: int, most: int | None = None) -> Column:
    """Window numbers of an array of token counts packed greedily in order.

    A window closes when it holds something and the next item would pass
    ``budget``, or when it holds ``most`` items. Items are never split.
    """
    start = F.struct(F.lit(0).alias("window"), F.lit(0).cast("long").alias("load"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & (acc["load"] + x > budget)
        if most is not None:
            full = full | (acc["n"] >= most)
        window = acc["window"] + F.when(full, 1).otherwise(0)
        return F.struct(
            window.alias("window"),
            F.when(full, x.cast("long")).otherwise(acc["load"] + x).alias("load"),
            F.when(full, 1).otherwise(acc["n"] + 1).alias("n"),
            F.concat(acc["out"], F.array(window)).alias("out"),
        )

    return F.aggregate(tokens, start, step)["out"]


def even_groups(index: Column, count: Column, groups: int) -> Column:
    """The group of item ``index`` (from 0) in runs of ceil(count / groups)."""
    return F.floor(index / F.greatest(F.ceil(count / groups), F.lit(1))).cast("long")
