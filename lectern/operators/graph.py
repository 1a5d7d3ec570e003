"""The document graph: entities, relations, what belongs to what, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of the relation between a found entity and the item it was found in.
BELONGS_WEIGHT = 10.0
MERGE_GLUE = "<SEP>"


def mentions(docs: DataFrame, key: str, text: str, pattern: str, least: int = 4) -> DataFrame:
    """(key, entity, n): what ``pattern`` finds in a text, by default extractor.

    A stand-in for a model: pure, so a run can be repeated. Counts combine
    before the shuffle.
    """
    found = F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)))
    return docs.select(key, found.alias("entity")).filter(F.length("entity") >= least).groupBy(key, "entity").agg(F.count(F.lit(1)).alias("n"))


def nodes(found: DataFrame, key: str) -> DataFrame:
    """(entity, docs, n, first_doc): mentions of an entity over all documents."""
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.min(key).alias("first_doc"))


def neighbours(found: DataFrame, key: str, order: Column | None = None, most: int | None = None) -> DataFrame:
    """(src, tgt, weight, docs): entities next to each other in a document's order.

    Entities of a document, alphabetical, are linked to the following one
    only, so a document of many entities yields as many links, not their square.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("entity")
    pairs = found.withColumns({"tgt": F.lead("entity").over(w), "m": F.lead("n").over(w)}).filter("tgt is not null")
    return pairs.groupBy(F.col("entity").alias("src"), "tgt").agg(F.sum(F.least("n", "m")).cast("double").alias("weight"), F.count(F.lit(1)).alias("docs"))


def belongs_to(found: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(src, tgt, weight, key): every entity found in an item's chunk, to the item.

    ``items``: (key, item_entity). The item's own entity is left out.
    """
    return found.join(items, key).filter(F.col("entity") != F.col("item_entity")).select(F.col("entity").alias("src"), F.col("item_entity").alias("tgt"), F.lit(BELONGS_WEIGHT).alias("weight"), key)


def merge_edges(edges: DataFrame, source: str) -> DataFrame:
    """(src, tgt, weight, sources): parallel edges as one, whichever way they point."""
    a, b = F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")
    return edges.groupBy(a, b).agg(F.sum("weight").alias("weight"), F.array_join(F.sort_array(F.collect_set(F.col(source).cast("string"))), MERGE_GLUE).alias("sources"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(entity, hop): what can be reached from ``seeds`` (entity), with the fewest hops.

    One join and one aggregate a hop; only the new rim is joined again.
    """
    both = edges.select("src", "tgt").unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()
    seen = seeds.select("entity").distinct().withColumn("hop", F.lit(0))
    rim = seen
    for hop in range(1, hops + 1):
        rim = rim.join(both, rim["entity"] == both["src"]).select(F.col("tgt").alias("entity")).distinct()
        rim = rim.join(seen.select("entity"), "entity", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(rim)
    return seen


def union_entities(old: Column, new: Column) -> Column:
    """Names in order, each once."""
    return F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))
