"""Items that are no text: prompts, descriptions, sections, stored rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.answers import entity_udf
from .intervals import even_groups, islands, pack_in_order, texts_in_range

#: Templates by language and key; a language without a key has the English one.
TEMPLATES = {
    "en": {
        "image": "Describe this picture. Captions: {caption}. Notes: {footnote}.",
        "table": "Describe this table. Captions: {caption}. Body: {body}. Notes: {footnote}.",
        "equation": "Explain this formula ({format}): {body}.",
        "generic": "Describe this {type}: {body}.",
        "context": "Text around it: {context}",
    },
    "zh": {"image": "请描述这张图片。标题：{caption}。注释：{footnote}。", "table": "请描述这张表格。标题：{caption}。内容：{body}。注释：{footnote}。"},
}


def template(key: str, language: str = "en") -> str:
    held = TEMPLATES.get(language.strip().lower().split("-")[0].split("_")[0], {})
    return held.get(key) or TEMPLATES["en"].get(key, TEMPLATES["en"]["generic"])


def fill(text: str, **values: Column) -> Column:
    """A template with columns in its places; null reads None."""
    parts: list[Column] = []
    for k, piece in enumerate(text.replace("}", "{").split("{")):
        parts.append(F.coalesce(values[piece].cast("string"), F.lit("None")) if k % 2 and piece in values else F.lit(piece))
    return F.concat(*parts)


def prompts(items: DataFrame, language: str = "en") -> DataFrame:
    """``items`` (type, caption, footnote, body, text_format, context) with ``prompt``."""
    joined = lambda c: F.nullif(F.array_join(C.captions(F.col(c)), "; "), F.lit(""))
    values = {"caption": joined("caption"), "footnote": joined("footnote"), "body": F.nullif("body", F.lit("")), "format": F.col("text_format"), "type": F.col("type")}
    own = F.lit(None).cast("string")
    for kind in ("equation", "table", "image"):
        own = F.when(F.col("type") == kind, fill(template(kind, language), **values)).otherwise(own)
    own = F.coalesce(own, fill(template("generic", language), **values))
    around = F.when(~C.blank(F.col("context")), F.concat(F.lit("\n"), fill(template("context", language), context=F.col("context")))).otherwise("")
    return items.withColumn("prompt", F.concat(own, around))


def stub_model(prompts_: pd.Series) -> pd.Series:
    """Answers that are a pure function of the prompt, so runs can be repeated."""
    import hashlib
    import json

    def answer(p: str) -> str:
        name = "Item " + hashlib.md5(p.encode()).hexdigest()[:6]
        return json.dumps({"detailed_description": p[:200], "entity_info": {"entity_name": name, "entity_type": "item", "summary": p[:80]}})

    return prompts_.map(answer)


def describe(items: DataFrame, model: Callable[[pd.Series], pd.Series] = stub_model) -> DataFrame:
    """``items`` with the model's answer and the entity read off it.

    A model that fails on a batch leaves null answers; the item then describes
    itself, so no row is lost.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in batches:
            try:
                yield model(p)
            except Exception:
                yield pd.Series([None] * len(p), dtype=object)

    asked = prompts(items).withColumn("answer", ask("prompt"))
    return asked.withColumn("entity", entity_udf("answer", "type", F.coalesce("body", F.lit("")))).select("*", "entity.*").drop("entity")


def section_names(sections: DataFrame, item: str, part: str, name: str) -> DataFrame:
    """``sections`` with part numbers from 1; names carry them where there are several."""
    w = Window.partitionBy(item)
    k, n = F.row_number().over(w.orderBy(part)), F.count(F.lit(1)).over(w)
    out = sections.withColumns({"part": k, "parts": n})
    return out.withColumn(name, F.when(F.col("parts") > 1, F.concat(F.col(name), F.lit(" ["), F.col("part"), F.lit("/"), F.col("parts"), F.lit("]"))).otherwise(F.col(name)))


def order_in_document(chunks: DataFrame, status: DataFrame, key: str, *order: str) -> DataFrame:
    """``chunks`` with their place after the chunks that a document already has."""
    before = status.select(key, F.col("chunks_count"))
    w = Window.partitionBy(key).orderBy(*order)
    placed = chunks.join(before, key, "left").withColumn("chunk_order_index", F.coalesce("chunks_count", F.lit(0)) + F.row_number().over(w) - 1)
    return placed.drop("chunks_count")


def audio_windows(segments: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, window, start, end, text): transcripts packed by tokens, never splitting one."""
    rows = F.array_sort(F.collect_list(F.struct("s_start", "seg_idx", "s_end", "text")))
    held = segments.filter(~C.blank(F.col("text"))).groupBy(key).agg(rows.alias("rows"))
    held = held.withColumn("w", pack_in_order(F.transform("rows", lambda r: C.token_estimate(r["text"])), budget))
    flat = held.select(key, F.explode(F.arrays_zip("rows", "w")).alias("x")).select(key, F.col("x.w").alias("window"), "x.rows.*")
    line = F.concat(F.lit("["), C.timestamp_text(F.col("s_start")), F.lit("-"), C.timestamp_text(F.col("s_end")), F.lit("] "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("s_start", "seg_idx", line.alias("line"))))
    return flat.groupBy(key, "window").agg(F.min("s_start").alias("start"), F.max("s_end").alias("end"), F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text"))


def audio_only(segments: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """Speech outside all scenes, touching pieces as one scene without a picture."""
    from .intervals import outside

    alone = islands(outside(segments, scenes, key), key, "s_start", "s_end", "seg_idx")
    texts = F.array_sort(F.collect_list(F.struct("s_start", "seg_idx", "text")))
    return alone.groupBy(key, "island").agg(F.min("s_start").alias("start"), F.max("s_end").alias("end"), F.array_join(F.transform(texts, lambda r: r["text"]), " ").alias("speech"))


def video_windows(scenes: DataFrame, segments: DataFrame, key: str, budget: int, most_scenes: int, most_windows: int) -> DataFrame:
    """(key, scene_idx, start, end, visual, speech, window) of scenes and lone speech.

    Scenes are packed by the tokens of what they show and by number; if that
    makes too many windows, they are dealt in even runs instead.
    """
    spoken = texts_in_range(scenes.select(key, "scene_idx", "start", "end"), segments, key)
    shown = scenes.join(spoken, [key, "scene_idx"], "left").select(key, "start", "end", "visual", F.coalesce("transcript", F.lit("")).alias("speech"))
    lone = audio_only(segments, scenes, key).select(key, "start", "end", F.lit("").alias("visual"), "speech")
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "visual", "speech")))
    held = shown.unionByName(lone).groupBy(key).agg(rows.alias("rows"))
    tokens = F.transform("rows", lambda r: F.when(r["visual"] == "", 0).otherwise(C.token_estimate(r["visual"])))
    held = held.withColumn("w", pack_in_order(tokens, budget, most_scenes))
    flat = held.select(key, F.array_max("w").alias("top"), F.size("rows").alias("n"), F.posexplode(F.arrays_zip("rows", "w")).alias("scene_idx", "x"))
    window = F.when(F.col("top") + 1 > most_windows, even_groups(F.col("scene_idx"), F.col("n"), most_windows)).otherwise(F.col("x.w"))
    return flat.select(key, "scene_idx", "x.rows.*", window.cast("int").alias("window"))


def merged_channels(start: Column, end: Column, visual: Column, speech: Column) -> Column:
    """What a scene shows and says, as one text; what is empty is left out."""
    some = lambda label, c: F.when(~C.blank(c), F.concat(F.lit(label), c))
    head = F.concat(F.lit("["), C.timestamp_text(start), F.lit("-"), C.timestamp_text(end), F.lit("]"))
    return F.concat_ws("\n", head, some("Visual: ", visual), some("Speech: ", speech))
