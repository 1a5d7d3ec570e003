"""Queries of single operators: fields of items, files, status rows, prompts, keys.

Where the tables lack a field (a formula, a path, a header), the query makes it
from the columns there are: remainders deal out cases, and every row has one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import blocks, evaluation, items, stores
from ..sources import files
from . import ask
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

_TEXT = "coalesce(text, '')"


@R.add("""SELECT doc_id, array_to_string(list_filter([trim(lang), '', NULL, trim(source)], lambda x: x IS NOT NULL AND x <> ''), '|') AS names FROM documents""")
def caption_values(t):
    given = F.array("lang", F.lit(" \t"), F.lit(None).cast("string"), F.concat(F.lit(" "), F.col("source"), F.lit("\n")))
    return t("documents").select("doc_id", F.array_join(C.captions(given), "|").alias("names"))


@R.add("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN nullif(lang, '') END, nullif(source, ''), '') AS body FROM documents")
def first_bodies(t):
    own = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, "")
    return t("documents").select("doc_id", C.first_filled(own, F.col("source")).alias("body"))


@R.add("""
WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'x_' || turn END AS latex, CASE WHEN turn % 2 = 0 THEN 'x_' || turn ELSE 'say ' || role END AS said,
                  CASE WHEN turn % 5 = 0 THEN 'mathml' ELSE '' END AS given FROM conversations)
SELECT conv_id, turn, coalesce(latex, said) AS body, CASE WHEN given <> '' THEN given WHEN latex IS NOT NULL THEN 'latex' ELSE '' END AS format,
       CASE WHEN latex IS NOT NULL AND said <> latex THEN said ELSE '' END AS description FROM e""")
def equation_fields(t):
    """Formula, format and what stands beside it; formulas are made from turns."""
    turn = F.col("turn").cast("string")
    latex = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" x_"), turn, F.lit("\n")))
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x_"), turn)).otherwise(F.concat(F.lit("say "), F.col("role"), F.lit(" ")))
    given = F.when(F.col("turn") % 5 == 0, " mathml ")
    none = F.lit(None).cast("string")
    return t("conversations").select(
        "conv_id", "turn", C.equation_text(latex, said, none).alias("body"), C.equation_format(latex, given).alias("format"), C.equation_description(latex, said).alias("description")
    )


@R.add(f"""
SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN '## ' || {_TEXT} ELSE {_TEXT} END
  WHEN role = 'assistant' THEN '[Image: ' || role || ', ' || turn || ']' ELSE '[Table: ' || role || ', ' || turn || ']' END) AS view_md5 FROM conversations""")
def block_views(t):
    kind = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "image").otherwise("table")
    level = F.when(F.col("turn") % 4 == 0, 2)
    names = F.array("role", F.lit(" "), F.col("turn").cast("string"))
    view = C.block_text(kind, F.coalesce("text", F.lit("")), level, names)
    return t("conversations").select("conv_id", "turn", F.md5(view.cast("binary")).alias("view_md5"))


@R.add(r"""
WITH b AS (SELECT conv_id, CASE WHEN turn % 4 = 3 THEN 'text' WHEN role = 'assistant' THEN 'table' ELSE 'text' END AS kind, text FROM conversations)
SELECT conv_id, kind = 'text' AS is_text, count(*) AS n FROM b WHERE kind <> 'text' OR regexp_matches(coalesce(text, ''), '\S') GROUP BY ALL""")
def kind_split(t):
    """Texts that are not blank and blocks of other kinds; no kind is text."""
    kind = F.when(F.col("turn") % 4 == 3, None).when(F.col("role") == "assistant", "table").otherwise("text")
    texts, others = blocks.split_kinds(t("conversations").withColumn("type", kind))
    both = texts.select("conv_id", F.lit(True).alias("is_text")).unionByName(others.select("conv_id", F.lit(False).alias("is_text")))
    return both.groupBy("conv_id", "is_text").agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://files.test/x/' || url_encode('p ' || page_id) || '/' || url_encode('ä&b.png') END AS link FROM pages""")
def public_links(t):
    """Links of files below the public folder; none for files outside it or climbing out."""
    k = F.col("page_id").cast("string")
    path = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/data/out/p "), k, F.lit("/ä&b.png")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("/data/outside/"), k))
        .otherwise(F.concat(F.lit("/data/out/../"), k))
    )
    return t("pages").select("page_id", C.public_url(path, "/data/out/", "https://files.test/x").alias("link"))


_ENDINGS = (".PDF", ".docx", ".png", ".md", ".htm", ".mp3", ".mkv", ".xyz", "", ".tar.txt", ".WEBP", ".xls")


@R.add(rf"""
WITH p AS (SELECT doc_id, 'f' || doc_id || {list(_ENDINGS)}[doc_id % {len(_ENDINGS)} + 1] AS path FROM documents),
s AS (SELECT doc_id, lower(regexp_extract(path, '^.+(\.[^.]+)$', 1)) AS s FROM p)
SELECT doc_id, s AS ending, CASE s WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'office' WHEN '.xls' THEN 'office' WHEN '.png' THEN 'image' WHEN '.webp' THEN 'image'
  WHEN '.md' THEN 'text' WHEN '.txt' THEN 'text' WHEN '.htm' THEN 'html' WHEN '.mp3' THEN 'audio' WHEN '.mkv' THEN 'video' ELSE 'generic' END AS kind,
  s NOT IN ('', '.xyz') AS supported FROM s""")
def file_routes(t):
    """Which kind of reader a file goes to, by its suffix."""
    end = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int"))
    path = F.concat(F.lit("/in/f"), F.col("doc_id").cast("string"), end)
    return t("documents").select("doc_id", C.suffix(path).alias("ending"), C.route(path).alias("kind"), C.suffix(path).isin(*files.SUPPORTED).alias("supported"))


#: First bytes of made files: six kinds of image, a cut bitmap, none.
_HEADS = ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "49492A00", "5249464600000000574542505650", "424D00000000000000000000000028000000", "424D00", "")


@R.add(f"""
WITH f AS (SELECT doc_id, n_chars, unhex({list(_HEADS)}[doc_id % {len(_HEADS)} + 1]) || encode(left({_TEXT}, 30)) AS content FROM documents),
m AS (SELECT doc_id, n_chars, content, hex(content) AS h FROM f),
k AS (SELECT *, CASE WHEN h LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN h LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN h LIKE '474946383961%' THEN 'image/gif'
  WHEN h LIKE '49492A00%' THEN 'image/tiff' WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '57454250' THEN 'image/webp'
  WHEN h LIKE '424D%' AND substr(h, 29, 8) = '28000000' THEN 'image/bmp' END AS mime FROM m)
SELECT doc_id, mime, CASE WHEN mime IS NULL THEN '' ELSE base64(content) END AS encoded,
       coalesce(doc_id % 3 <> 0 AND n_chars <= 2000 AND mime IS NOT NULL, false) AS valid FROM k""")
def image_kinds(t):
    """Media type by first bytes, Base64 of images, and whether a file is a valid image."""
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS) + 1).cast("int")))
    content = F.concat(head, F.substring(F.coalesce("text", F.lit("")), 1, 30).cast("binary"))
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".PNG"))
    valid = F.coalesce(files.valid_image(path, F.col("n_chars"), F.col("content"), 2000), F.lit(False))
    rows = t("documents").withColumn("content", content)
    return rows.select("doc_id", C.image_mime(F.col("content")).alias("mime"), C.encode_image(F.col("content")).alias("encoded"), valid.alias("valid"))


@R.add(f"SELECT doc_id, '/d/' || doc_id AS path, md5({_TEXT}) AS md5, sha256({_TEXT}) AS sha256, 'f.' || (doc_id % 50) || '_' || left(md5('/in/' || doc_id || '/f.' || (doc_id % 50) || '.pdf'), 8) AS folder, 'a/' || doc_id AS name FROM documents")
def file_fingerprints(t):
    """Digests of contents, an output folder for each file, names below a root."""
    k = F.col("doc_id").cast("string")
    made = t("documents").select("doc_id", F.concat(F.lit("/d/"), k).alias("path"), F.col("n_chars").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    signed = files.signatures(made).select("path", "md5", "sha256")
    source = F.concat(F.lit("/in/"), k, F.lit("/f."), (F.col("doc_id") % 50).cast("string"), F.lit(".pdf"))
    folders = t("documents").select("doc_id", F.concat(F.lit("/d/"), k).alias("path"), C.output_dir(source).alias("folder"), files.relative_name(F.concat(F.lit("/root/a/"), k), "/root/").alias("name"))
    return folders.join(signed, "path")


@R.add("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'processed' ELSE 'pending' END AS status FROM documents")
def status_ensured(t):
    """Status rows of every document: those there are stay, the rest is pending."""
    docs = t("documents").select("doc_id")
    return stores.insert_absent(docs.filter("doc_id % 3 = 0").withColumn("status", F.lit("processed")), docs.withColumn("status", F.lit("pending")), ["doc_id"])


@R.add("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'processed' END AS status, true AS multimodal_processed, doc_id % 5 <> 0 AS fully_processed
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def status_finished(t):
    """Status rows after the last stage, of documents whose text was stored."""
    status = F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("handling")
    rows = t("documents").select("doc_id", status.alias("status"), F.lit(None).cast("boolean").alias("multimodal_processed"))
    return stores.fully_processed(stores.finish_status(stores.drop_placeholders(rows, t("labels"), "doc_id")))


@R.add("""
WITH b AS (SELECT conv_id AS doc_id, turn::INT AS block_idx, CASE WHEN role = 'assistant' THEN 'equation' ELSE 'text' END AS type, text, (turn // 2)::INT AS page_idx FROM conversations),
f AS (SELECT DISTINCT conv_id AS doc_id, CASE WHEN turn % 2 = 0 THEN 'e' || (turn % 4) ELSE text END AS text FROM conversations),
n AS (SELECT * FROM f WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = f.doc_id AND b.type = 'equation' AND b.text = f.text)),
l AS (SELECT doc_id, max(block_idx) AS top, max(page_idx) AS page_idx FROM b GROUP BY doc_id),
a AS (SELECT * FROM b UNION ALL SELECT n.doc_id, (top + row_number() OVER (PARTITION BY n.doc_id ORDER BY text))::INT, 'equation', text, l.page_idx FROM n JOIN l ON n.doc_id = l.doc_id)
SELECT doc_id, block_idx, type, md5(coalesce(text, '')) AS text_md5, page_idx FROM a""")
def equations_appended(t):
    """Formulas found elsewhere join a document's blocks unless they are among them."""
    rows = t("conversations")
    kind = F.when(F.col("role") == "assistant", "equation").otherwise("text")
    own = rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_idx"), kind.alias("type"), "text", F.floor(F.col("turn") / 2).cast("int").alias("page_idx"))
    found = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("e"), (F.col("turn") % 4).cast("string"))).otherwise(F.col("text"))
    out = blocks.append_missing(own, rows.select(F.col("conv_id").alias("doc_id"), found.alias("text")).filter("text is not null"))
    return out.select("doc_id", "block_idx", "type", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "page_idx")


@R.add("""
SELECT conv_id, turn, (CASE WHEN conv_id % 2 = 0 THEN conv_id % 7 ELSE 0 END + row_number() OVER w - 1)::BIGINT AS chunk_order_index,
       CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN role || ' [' || row_number() OVER w || '/' || count(*) OVER (PARTITION BY conv_id) || ']' ELSE role END AS section
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def section_order(t):
    """Places after the chunks that a document already has, and numbered section names."""
    rows = t("conversations").select("conv_id", "turn", "role")
    before = rows.select("conv_id").distinct().filter("conv_id % 2 = 0").withColumn("chunks_count", F.col("conv_id") % 7)
    named = items.section_names(rows, "conv_id", "turn", "role")
    placed = items.order_in_document(named, before, "conv_id", "turn")
    return placed.select("conv_id", "turn", F.col("chunk_order_index").cast("long").alias("chunk_order_index"), F.col("role").alias("section"))


@R.add(r"""
WITH s AS (SELECT conv_id, turn, turn * 1700 AS a, turn * 1700 + 95 AS z, CASE WHEN role = 'assistant' AND regexp_matches(coalesce(text, ''), '\S') THEN text END AS visual,
                  CASE WHEN turn % 3 <> 0 THEN role END AS speech FROM conversations),
f AS (SELECT *, CASE WHEN a >= 3600 THEN printf('%d:%02d:%02d', a // 3600, (a % 3600) // 60, a % 60) ELSE printf('%d:%02d', a // 60, a % 60) END AS fa,
             CASE WHEN z >= 3600 THEN printf('%d:%02d:%02d', z // 3600, (z % 3600) // 60, z % 60) ELSE printf('%d:%02d', z // 60, z % 60) END AS fz FROM s)
SELECT conv_id, turn, md5(concat_ws(chr(10), '[' || fa || '-' || fz || ']', 'Visual: ' || visual, 'Speech: ' || speech)) AS scene_md5 FROM f""")
def channel_texts(t):
    """What a scene shows and says, as one text."""
    start = F.col("turn") * 1700
    out = items.merged_channels(start, start + 95, F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("turn") % 3 != 0, F.col("role")).otherwise(" "))
    return t("conversations").select("conv_id", "turn", F.md5(out.cast("binary")).alias("scene_md5"))


@R.add("""
WITH i AS (SELECT conv_id, turn, role, coalesce(nullif(text, ''), 'None') AS body, CASE WHEN turn > 0 THEN chr(10) || 'Text around it: turn ' || turn ELSE '' END AS around FROM conversations)
SELECT conv_id, turn, md5(CASE role WHEN 'assistant' THEN 'Describe this table. Captions: assistant; turn. Body: ' || body || '. Notes: None.'
  WHEN 'user' THEN 'Explain this formula (None): ' || body || '.' ELSE 'Describe this chart: ' || body || '.' END || around) AS prompt_md5 FROM i""")
def item_prompts(t):
    """The prompt for each item that is no text."""
    kind = F.when(F.col("role") == "assistant", "table").when(F.col("role") == "user", "equation").otherwise("chart")
    none = F.lit(None)
    made = t("conversations").select(
        "conv_id", "turn", kind.alias("type"), F.array("role", F.lit(""), F.lit(" turn ")).alias("caption"), none.cast("array<string>").alias("footnote"),
        F.col("text").alias("body"), none.cast("string").alias("text_format"), F.when(F.col("turn") > 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).otherwise(" ").alias("context"),
    )
    return items.prompts(made).select("conv_id", "turn", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@R.add("SELECT event_id, CASE event_type WHEN 'error' THEN 'see the log' WHEN 'click' THEN 'try again' END AS hint FROM events")
def failure_hints(t):
    said = F.concat(F.lit("Step "), F.upper("event_type"), F.lit(" failed"))
    return t("events").select("event_id", C.file_kind_diagnosis(said, {"step error": "see the log", "Click": "try again"}).alias("hint"))


@R.add(f"""
SELECT doc_id, 'multimodal_query:' || md5(concat_ws(chr(10), 'q ' || doc_id, 'mix',
  'body=' || CASE WHEN length({_TEXT}) > {ask.LONG_TABLE} THEN sha256({_TEXT}) ELSE {_TEXT} END || ';sha256=' || md5({_TEXT}) || ';type=table', 'top_k=60')) AS key FROM documents""")
def query_keys(t):
    """Cache keys: files by digest and not by path, long tables by theirs."""
    text = F.coalesce("text", F.lit(""))
    item = F.create_map(F.lit("type"), F.lit("table"), F.lit("img_path"), F.concat(F.lit("/a/"), F.col("doc_id").cast("string")), F.lit("sha256"), F.md5(text.cast("binary")), F.lit("body"), text)
    options = F.create_map(F.lit("top_k"), F.lit("60"), F.lit("only"), F.lit(None).cast("string"))
    key = ask.query_key(F.concat(F.lit(" q "), F.col("doc_id").cast("string"), F.lit(" ")), F.array(item), F.lit("mix"), options)
    return t("documents").select("doc_id", key.alias("key"))


@R.add("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat_ws(chr(10), 'q' || doc_id, 'Items given with the question:', '- ' || coalesce(lang, 'none'), '- ' || coalesce(source, 'none')) ELSE 'q' || doc_id END AS query
FROM documents""")
def enhanced_queries(t):
    shown = F.array(F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")))
    given = F.when(F.col("doc_id") % 2 == 0, shown).otherwise(F.array().cast("array<string>"))
    return t("documents").select("doc_id", ask.enhanced(F.concat(F.lit("q"), F.col("doc_id").cast("string")), given).alias("query"))


@R.add(r"""
WITH p AS (SELECT doc_id, 'Image Path: /img/' || doc_id || '.png is' || chr(10) || 'image path:C:\b\x ' || coalesce(lang, 'un') || '.JPG' || chr(10) || 'Image Path: none' AS prompt FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(prompt, '(?i)Image Path:[ \t]*([^\r\n]*?\.(?:png|jpg))(?:\s|$)', 1), '|') AS paths, 'x ' || regexp_extract(prompt, 'x ([a-z]+)', 1) || '.JPG' AS name FROM p""")
def picture_paths(t):
    """Paths of pictures that a context names, and the file name of the last."""
    k = F.col("doc_id").cast("string")
    prompt = F.concat(F.lit("Image Path: /img/"), k, F.lit(".png is\nimage path:C:\\b\\x "), F.coalesce("lang", F.lit("un")), F.lit(".JPG\nImage Path: none"))
    found = ask.image_paths(prompt)
    return t("documents").select("doc_id", F.array_join(found, "|").alias("paths"), C.base_name(F.element_at(found, -1)).alias("name"))


@R.add("SELECT conv_id AS doc_id, 'q' || turn AS question, role AS method FROM conversations WHERE turn % 8 <> 0")
def evaluation_pending(t):
    """Answers without a successful judgement that states an accuracy."""
    rows = t("conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("question"), F.col("role").alias("method"), "turn")
    done = rows.filter("turn % 2 = 0").withColumns({"success": F.col("turn") % 4 == 0, "accuracy": F.when(F.col("turn") % 8 == 0, 1.0)})
    return evaluation.pending(rows, done).select("doc_id", "question", "method")


@R.add("SELECT doc_id, coalesce(lang, 'un') || ' ' || coalesce(source, 'src') || '中文x, y (z' AS text FROM documents")
def spans_joined(t):
    """Spans in a row: spaces between words, none beside CJK or marks."""
    parts = F.array(F.coalesce("lang", F.lit("un")), F.lit(""), F.coalesce("source", F.lit("src")), *map(F.lit, ("中文", "x", ", y", "(", "z")))
    return t("documents").select("doc_id", C.join_spans(parts).alias("text"))
