"""Queries of parse caches, chunk pages, chart views, artifacts and places in a text.

Remainders deal out cases, and every row has one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("""
WITH c AS (SELECT conv_id, turn, role, role = 'assistant' AS chart, turn % 4 = 1 AS picture FROM conversations)
SELECT conv_id, turn, CASE WHEN chart AND picture THEN 'image' WHEN chart THEN 'chart' ELSE 'text' END AS type,
       CASE WHEN chart AND picture THEN role || '|t' || turn ELSE role || '| ' END AS names, CASE WHEN chart AND picture THEN '' ELSE 'none' END AS notes FROM c""")
def chart_views(t):
    turn = F.col("turn").cast("string")
    made = t("conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", "chart").otherwise("text").alias("type"), F.when(F.col("turn") % 4 == 1, F.concat(F.lit("/p/"), turn)).alias("img_path"),
        F.array("role", F.lit(" ")).alias("caption"), F.array(F.concat(F.lit(" t"), turn)).alias("content"), F.lit(None).cast("array<string>").alias("footnote"),
    )
    out = records.chart_view(made)
    return out.select("conv_id", "turn", "type", F.array_join("caption", "|").alias("names"), F.coalesce(F.array_join("footnote", "|"), F.lit("none")).alias("notes"))


@R.add("SELECT doc_id AS key, 'd' || doc_id AS doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND n_chars IS NOT NULL")
def parse_cache_hits(t):
    """Files whose cached parse is whole, of the same time and of the same options."""
    k = F.col("doc_id").cast("string")
    options = lambda a, b: F.create_map(F.lit(a[0]), a[1], F.lit(b[0]), b[1])
    lang, other = ("lang", F.coalesce("lang", F.lit("un"))), ("method", F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("auto"))
    files = t("documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("mtime"), options(("method", F.lit("auto")), lang).alias("options"))
    content = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("block")))
    late = F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    cache = t("documents").select(F.col("doc_id").alias("key"), (F.col("n_chars") + late).alias("mtime"), options(lang, other).alias("options"), content.alias("content"), F.concat(F.lit("d"), k).alias("doc_id"))
    return records.cached_parses(files, cache).select("key", "doc_id")


@R.add("SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS cached_at, CASE WHEN doc_id % 2 = 0 THEN md5(coalesce(text, '')) ELSE 'old' END AS content FROM documents")
def parse_cache_put(t):
    """The cache after a round that parsed some files twice: the newest parse stays."""
    docs = t("documents").select(F.col("doc_id").alias("key"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    old = docs.select("key", F.lit(0).alias("cached_at"), F.lit("old").alias("content"))
    even = docs.filter("key % 2 = 0")
    fresh = even.select("key", F.lit(1).alias("cached_at"), F.lit("first").alias("content")).unionByName(even.select("key", F.lit(2).alias("cached_at"), "content"))
    return records.store_parses(old, fresh)


@R.add("""
SELECT conv_id AS full_doc_id, 'c' || turn AS chunk_id, CASE WHEN conv_id % 2 = 1 THEN turn WHEN turn % 2 = 0 THEN turn * 10 ELSE -1 END AS page_idx,
       CASE WHEN conv_id % 2 = 0 AND turn % 2 = 0 THEN turn * 10 + 1 ELSE -1 END AS page_idx_end FROM conversations""")
def chunk_pages_owned(t):
    """Pages go to the chunks of the documents they were found for; those without any lose theirs (-1)."""
    rows = t("conversations").select(F.col("conv_id").alias("full_doc_id"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("chunk_id"), "turn")
    chunks = rows.select("full_doc_id", "chunk_id", F.col("turn").alias("page_idx"), F.lit(None).cast("long").alias("page_idx_end"))
    listed = rows.filter("full_doc_id % 2 = 0")
    labels = listed.filter("turn % 2 = 0").select("full_doc_id", "chunk_id", (F.col("turn") * 10).alias("page_idx"), (F.col("turn") * 10 + 1).alias("page_idx_end"))
    return records.own_pages(chunks, listed, labels).fillna(-1, list(records.PAGES))


@R.add("""
WITH f AS (SELECT 's' || conv_id AS stem, turn, turn % 3 = 0 AS scoped, turn % 4 < 2 AS second, turn % 2 = 0 AS exact FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY scoped DESC, second DESC, exact DESC, turn) AS k FROM f)
SELECT stem, '/out/' || CASE WHEN scoped THEN stem || '/auto' ELSE 'other' END || '/' || CASE WHEN exact THEN stem ELSE 'x' END || CASE WHEN second THEN '_content_list_v2.json' ELSE '_content_list.json' END AS path
FROM r WHERE k = 1""")
def artifact_choice(t):
    """Of the content lists that a parser left in folders, the best for each file."""
    stem = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    folder = F.when(F.col("turn") % 3 == 0, F.concat(stem, F.lit("/auto"))).otherwise("other")
    name = F.concat(F.when(F.col("turn") % 2 == 0, stem).otherwise("x"), F.when(F.col("turn") % 4 < 2, "_content_list_v2.json").otherwise("_content_list.json"))
    found = t("conversations").select(stem.alias("stem"), F.concat(F.lit("/out/"), folder, F.lit("/"), name).alias("path"), F.col("turn").alias("place"))
    return records.choose_artifacts(found)


@R.add("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
o AS (SELECT doc_id, x, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
SELECT doc_id, count(*) AS n, sum(s)::BIGINT AS starts, sum(s + length(x))::BIGINT AS ends FROM o WHERE x <> '' GROUP BY doc_id""")
def blocks_located(t):
    """Where each line of a text stands, found from where the last one ended."""
    parts = F.filter(F.split("text", "\n"), lambda x: x != "")
    at = t("documents").select("doc_id", F.explode(records.located(F.col("text"), parts)).alias("at"))
    return at.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("at.start").alias("starts"), F.sum("at.end").alias("ends"))
