"""Retrieval: vector search, expansion over the graph, budgets, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 60
THRESHOLD = 0.2
#: Queries that one scan of the vectors serves.
QUERY_BLOCK = 256


def _dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column, size: Column | None = None) -> Column:
    """The cosine of two vectors; ``size`` is the product of their norms, where known."""
    size = norm(a) * norm(b) if size is None else size
    return F.when(size > 0, _dot(a, b) / size).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, threshold: float | None = None, vec: str = "vec_id", query: str = "query_id") -> DataFrame:
    """(query, vec, sim, rank): the ``k`` vectors most like each query.

    ``queries`` (query, embedding) is counted first and served in blocks of
    ``QUERY_BLOCK``, each broadcast to one scan; ranks are cut to ``k`` in each
    task before the shuffle. Norms are computed once a vector. Ties go to the
    least id.
    """
    numbered = queries.select(query, F.col("embedding").alias("q"), norm(F.col("embedding")).alias("nq"))
    sized = vectors.select(vec, "embedding", norm(F.col("embedding")).alias("nv"))
    n = numbered.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == b)
        hits = sized.crossJoin(F.broadcast(part)).select(query, vec, cosine(F.col("embedding"), F.col("q"), F.col("nv") * F.col("nq")).alias("sim"))
        if threshold is not None:
            hits = hits.filter(F.col("sim") >= threshold)
        out = hits if out is None else out.unionByName(hits)
    w = Window.partitionBy(query).orderBy(F.desc("sim"), vec)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def entity_chunks(seeds: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Documents or chunks that mention a seed entity, with how many of them."""
    return found.join(seeds.select("entity").distinct(), "entity").groupBy(key).agg(F.count(F.lit(1)).alias("hits"))


def combine(*parts: DataFrame) -> DataFrame:
    """Results of several modes: a key once, with its best score."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys = [c for c in out.columns if c != "score"]
    return out.groupBy(*keys).agg(F.max("score").alias("score"))


def within_budget(ranked: DataFrame, group: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows in rank order whose running token sum stays within ``budget``."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(tokens).over(w)).filter(F.col("used") <= budget)


def retrieve(mode: str, query_terms: DataFrame, found: DataFrame, edges: DataFrame, naive: DataFrame, key: str) -> DataFrame:
    """(key, score) by mode: naive, local, global, hybrid, mix or bypass.

    ``query_terms`` (entity); ``found`` mentions; ``naive`` (key, score) from
    vectors. local goes from entities over their edges to documents, global
    from the edges of the entities to both ends; hybrid is both, mix adds naive.
    """
    from .graph import expand

    if mode == "bypass":
        return naive.limit(0)
    if mode == "naive":
        return naive
    score = lambda df: df.select(key, F.col("hits").cast("double").alias("score"))
    local = lambda: score(entity_chunks(expand(query_terms, edges, 1), found, key))

    def over_edges() -> DataFrame:
        seeds = query_terms.select("entity").distinct()
        ends = edges.join(seeds.withColumnRenamed("entity", "src"), "src", "left_semi").select("src", "tgt").unionByName(edges.join(seeds.withColumnRenamed("entity", "tgt"), "tgt", "left_semi").select("src", "tgt"))
        both = ends.select(F.explode(F.array("src", "tgt")).alias("entity"))
        return score(entity_chunks(both, found, key))

    if mode == "local":
        return local()
    if mode == "global":
        return over_edges()
    if mode == "hybrid":
        return combine(local(), over_edges())
    if mode == "mix":
        return combine(local(), over_edges(), naive)
    raise ValueError(f"unknown mode: {mode}")
