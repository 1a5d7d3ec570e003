"""Queries of users: keys, caches, enhancement, pictures for a vision model."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import retrieval, stores

#: Texts of tables longer than this enter a key by their digest.
LONG_TABLE = 200
MODES = ("local", "global", "hybrid", "naive", "mix", "bypass")
#: A retrieved context names a picture after this label. The path ends in a
#: picture's suffix, on the label's line, before white space or a quote (as they
#: are or as JSON writes them), perhaps with one mark between.
LABEL = "(?i)Image Path:"
PICTURE = r'(?i)[ \t]*+([^\r\n]*?\.(?:jpe?g|png|gif|bmp|webp|tiff?))(?=[.,;:)\]]?(?:["\s\x1c-\x1f]|\\["fnrt]|\\u00(?:0b|1[c-f])|$))'


def query_key(query: Column, items: Column, mode: Column, options: Column) -> Column:
    """The cache key of a query with items (array of maps), mode and options.

    Files enter by their digest (``sha256`` in the item's map, in place of its
    path), long tables by theirs, options whatever their order.
    """
    digest = lambda v: F.when(F.length(v) > LONG_TABLE, F.sha2(v.cast("binary"), 256)).otherwise(v)
    short = lambda m: F.transform_values(F.map_filter(m, lambda k, v: ~k.isin("img_path", "path") | ~F.map_contains_key(m, F.lit("sha256"))), lambda k, v: digest(v))
    text = F.array_join(F.transform(items, lambda m: C.options_key(short(m))), "|")
    return F.concat(F.lit("multimodal_query:"), F.md5(F.concat_ws("\n", F.trim(query), mode, text, C.options_key(options)).cast("binary")))


def enhanced(query: Column, descriptions: Column) -> Column:
    """A query and what its items show; without items the query itself."""
    lines = F.transform(descriptions, lambda d: F.concat(F.lit("- "), d))
    return F.when(F.size(descriptions) > 0, F.concat_ws("\n", query, F.lit("Items given with the question:"), F.array_join(lines, "\n"))).otherwise(query)


def image_paths(prompt: Column) -> Column:
    """Paths of pictures that a context names, in order."""
    after = F.split(prompt, LABEL)
    found = F.transform(F.slice(after, F.lit(2), F.greatest(F.size(after) - 1, F.lit(0))), lambda x: F.regexp_extract(x, f"^{PICTURE}", 1))
    return F.filter(found, lambda x: x != "")


def picture_places(prompt: str) -> list[tuple[int, int]]:
    """Where the paths of pictures stand; a label's reaches to the next one at most."""
    labels = [m.end() for m in re.finditer(LABEL, prompt)]
    pattern, found = re.compile(PICTURE), []
    for at, stop in zip(labels, [*[k - len("Image Path:") for k in labels[1:]], len(prompt)], strict=False):
        if m := pattern.match(prompt[at:stop]):
            found.append((at + m.start(1), at + m.end(1)))
    return found


def safe_path(path: Column, *roots: str) -> Column:
    """Whether a path lies below one of ``roots``, without steps upward."""
    below = F.lit(False)
    for root in roots:
        below = below | path.startswith(root.rstrip("/") + "/")
    return below & ~path.rlike(r"(^|/)\.\.(/|$)")


def vision_messages(prompt: str, pictures: dict[str, str], question: str, system: str | None = None) -> list[dict]:
    """Messages for a vision model: texts and pictures in the context's order.

    ``pictures``: Base64 by path. A path that is not among them stays text.
    """
    parts: list[dict] = []
    at = 0
    for start, end in picture_places(prompt):
        if (path := prompt[start:end]) in pictures:
            parts.append({"type": "text", "text": prompt[at:end]})
            parts.append({"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{pictures[path]}"}})
            at = end
    rest = prompt[at:] + f"\n\nQuestion: {question}"
    messages = [{"role": "user", "content": [*parts, {"type": "text", "text": rest}] if parts else rest}]
    return [{"role": "system", "content": system}, *messages] if system else messages


def answer(queries: DataFrame, contexts: DataFrame, cache: DataFrame, model: Callable[[pd.Series], pd.Series], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(answers, cache): queries (key, query, mode) answered from the cache or anew.

    ``contexts`` (key, context) hold what was retrieved; a bypassed query has
    none. Answers that are null are not kept.
    """

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return model(prompts)

    held = queries.join(cache.select(key, "answer"), key, "left")
    hit = held.filter("answer is not null").select(key, "query", "answer", F.lit(True).alias("cached"))
    miss = held.filter("answer is null").drop("answer").join(contexts, key, "left")
    prompt = F.concat_ws("\n\n", F.when(F.col("mode") != "bypass", F.col("context")), "query")
    fresh = miss.withColumn("answer", ask(prompt)).select(key, "query", "answer", F.lit(False).alias("cached"))
    return hit.unionByName(fresh), stores.upsert(cache.select(key, "answer"), fresh.filter("answer is not null").select(key, "answer"), [key])


def contexts(ranked: DataFrame, chunks: DataFrame, query: str, chunk: str, budget: int, entity_budget: int | None = None) -> DataFrame:
    """(query, context): the best chunks that fit ``budget`` tokens, best first.

    ``ranked`` (query, chunk, score); ``chunks`` (chunk, content).
    """
    rows = ranked.join(chunks.select(chunk, "content"), chunk).withColumn("tokens", C.token_estimate(F.col("content")))
    fit = retrieval.within_budget(rows, query, [F.desc("score"), F.col(chunk)], "tokens", budget if entity_budget is None else min(budget, entity_budget))
    texts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(chunk).alias("c"), F.col("content").alias("t"))))
    return fit.groupBy(query).agg(F.array_join(F.transform(texts, lambda x: x["t"]), "\n\n").alias("context"))
