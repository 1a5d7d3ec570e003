"""Queries over texts: blocks, chunks, context, identity, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import blocks, chunks, context
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

SIZE, OVERLAP = 1200, 100


@R.add(f"""
SELECT doc_id, (s // {SIZE - OVERLAP})::INT AS chunk_idx, s::BIGINT AS start, (s + length(substring(text, s + 1, {SIZE})))::BIGINT AS "end",
       md5(substring(text, s + 1, {SIZE})) AS content_md5
FROM (SELECT doc_id, text, unnest(range(0, length(text), {SIZE - OVERLAP})) AS s FROM documents)""")
def doc_chunk_windows(t):
    out = chunks.char_windows(t("documents"), SIZE, OVERLAP)
    return out.select("doc_id", "chunk_idx", "start", "end", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@R.add(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS ws FROM documents)
SELECT doc_id, (s // 180)::INT AS chunk_idx, len(ws[s + 1:s + 200])::INT AS n_words, md5(array_to_string(ws[s + 1:s + 200], ' ')) AS content_md5
FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 180)) AS s FROM w)""")
def word_chunk_windows(t):
    out = chunks.word_windows(t("documents"), 200, 20)
    return out.select("doc_id", "chunk_idx", "n_words", F.md5(F.col("content").cast("binary")).alias("content_md5"))


_BLOCKS = """
b AS (SELECT doc_id, (i - 1)::INT AS block_idx, ls[i] AS text
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT * FROM b WHERE regexp_matches(text, '[^\\s\\x0B]')),
o AS (SELECT doc_id, block_idx, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM k)
""".replace("\\\\", "\\")


def _text_blocks(t):
    lines = blocks.line_blocks(t("documents"))
    return lines.filter(~C.blank(F.col("text")))


@R.add(f"WITH {_BLOCKS} SELECT doc_id, block_idx, s AS start, (s + length(text))::BIGINT AS \"end\" FROM o")
def doc_blocks_offsets(t):
    return blocks.block_offsets(_text_blocks(t)).select("doc_id", "block_idx", "start", "end")


@R.add(f"""
WITH {_BLOCKS},
d AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS text FROM k GROUP BY doc_id),
c AS (SELECT doc_id, (s // {SIZE - OVERLAP})::INT AS chunk_idx, s AS cs, s + length(substring(text, s + 1, {SIZE})) AS ce
      FROM (SELECT doc_id, text, unnest(range(0, length(text), {SIZE - OVERLAP})) AS s FROM d)),
p AS (SELECT c.doc_id, chunk_idx, min(block_idx) AS lo, max(block_idx) AS hi
      FROM c JOIN o ON c.doc_id = o.doc_id AND c.cs < o.s + length(o.text) AND o.s < c.ce GROUP BY ALL)
SELECT lang, count(*) AS chunks, sum(lo)::BIGINT AS first_lines, sum(hi)::BIGINT AS last_lines FROM p JOIN documents USING (doc_id) GROUP BY lang""")
def chunk_line_provenance(t):
    """Chunks of every document's text, the lines that each spans, by language."""
    own = blocks.block_offsets(_text_blocks(t))
    cut = chunks.char_windows(blocks.assemble(own), SIZE, OVERLAP)
    pages = chunks.chunk_pages(cut, own.withColumn("page_idx", F.col("block_idx")))
    last = F.coalesce("page_idx_end", "page_idx")
    by = pages.select("doc_id", "page_idx", last.alias("last")).join(t("documents").select("doc_id", "lang"), "doc_id")
    return by.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum("page_idx").alias("first_lines"), F.sum("last").alias("last_lines"))


@R.add("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5, count(*) AS n FROM conversations GROUP BY conv_id")
def conv_text_assembly(t):
    conv = t("conversations")
    whole = blocks.assemble(conv, "conv_id", "turn")
    return whole.join(conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id").select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n")


@R.add("""SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system
FROM conversations GROUP BY conv_id""")
def conv_role_histogram(t):
    kinds = t("conversations").groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.count(F.lit(1)))
    return kinds.select("conv_id", *[F.coalesce(F.col(r), F.lit(0)).alias(f"n_{r}") for r in ("user", "assistant", "system")])


@R.add(r"""
SELECT a.conv_id, a.turn, coalesce(md5(string_agg(trim(b.text), chr(10) ORDER BY b.turn)), md5('')) AS context_md5
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 AND b.turn <> a.turn AND trim(b.text) <> ''
GROUP BY a.conv_id, a.turn""")
def conv_context(t):
    out = context.chunk_context(t("conversations"), "conv_id", "turn", F.col("text"))
    return out.select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@R.add(r"""
SELECT a.conv_id, a.turn, coalesce(md5(string_agg(trim(b.text), ' ' ORDER BY b.turn)), md5('')) AS neighbor_md5
FROM conversations a LEFT JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn + 3 AND b.turn <> a.turn AND b.role = 'user' AND trim(b.text) <> ''
GROUP BY a.conv_id, a.turn""")
def conv_neighbor_text(t):
    out = context.neighbor_text(t("conversations"), "conv_id", "turn", F.col("role") == "user", F.col("text"))
    return out.select("conv_id", "turn", F.md5(F.col("neighbor_text").cast("binary")).alias("neighbor_md5"))


@R.add(r"""
WITH c AS (SELECT conv_id, turn, role, text, turn // 2 AS page FROM conversations)
SELECT a.conv_id, a.turn, coalesce(md5(string_agg(CASE WHEN b.page = a.page THEN b.text ELSE '[Page ' || b.page || '] ' || b.text END, chr(10) ORDER BY b.turn)), md5('')) AS context_md5
FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.page BETWEEN a.page - 1 AND a.page + 1 AND b.role = 'assistant' AND trim(b.text) <> ''
GROUP BY a.conv_id, a.turn""")
def conv_page_context(t):
    rows = t("conversations").withColumn("page", F.floor(F.col("turn") / 2).cast("int"))
    out = context.page_context(rows, "conv_id", "page", "turn", F.col("text"), F.col("role") == "assistant")
    return out.select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@R.add(r"""
WITH c AS (SELECT conv_id, turn, text, CASE WHEN length(text) % 4 = 3 THEN 0 ELSE length(text) % 4 + 1 END AS level, left(trim(text), 12) AS head FROM conversations),
h AS (SELECT *, CASE WHEN level > 0 AND trim(head) <> '' THEN level END AS lv FROM c),
e AS (SELECT a.conv_id, a.turn, b.turn AS at, b.lv, trim(b.head) AS head FROM h a JOIN h b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.lv IS NOT NULL),
k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.conv_id = e.conv_id AND f.turn = e.turn AND f.at > e.at AND f.lv <= e.lv))
SELECT c.conv_id, c.turn, coalesce(string_agg(k.head, ' > ' ORDER BY k.at), '') AS section_path
FROM c LEFT JOIN k ON c.conv_id = k.conv_id AND c.turn = k.turn GROUP BY c.conv_id, c.turn""")
def heading_path(t):
    """The headings above each turn; levels stand in from the text's length."""
    size = F.length("text") % 4
    rows = t("conversations").withColumn("level", F.when(size == 3, 0).otherwise(size + 1)).withColumn("head", F.substring(F.trim("text"), 1, 12))
    return context.heading_path(rows, "conv_id", "turn", "level", F.col("head"), 3).select("conv_id", "turn", "section_path")


@R.add(r"""SELECT page_id, len(regexp_extract_all(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1))::INT AS n,
       md5(array_to_string(regexp_extract_all(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '|')) AS headings_md5 FROM pages""")
def html_headings(t):
    found = F.regexp_extract_all("html", F.lit(r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return t("pages").select("page_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|").cast("binary")).alias("headings_md5"))


@R.add("SELECT doc_id, 'doc-' || md5('text:' || text) AS content_id FROM documents")
def doc_content_id(t):
    one = t("documents").select("doc_id", F.lit("text").alias("type"), "text", F.lit(0).alias("block_idx"))
    return blocks.content_ids(one)


@R.add("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(t):
    by = t("documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("n > 1")


@R.add("""
WITH c AS (SELECT doc_id, (s // 400)::INT AS idx, substring(text, s + 1, 400) AS x FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS s FROM documents))
SELECT doc_id, 'chunk-' || md5(x) AS chunk_id, max(idx)::INT AS chunk_order_index FROM c GROUP BY doc_id, 2""")
def chunk_store_rows(t):
    rows = chunks.chunk_rows(chunks.char_windows(t("documents"), 400, 0))
    return rows.select(F.col("full_doc_id").alias("doc_id"), "chunk_id", "chunk_order_index")


@R.add(r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace('<think>' || left(text, 40) || '</THINK>' || text, '<think>.*?</think>', '', 'gis'), '<thinking>.*?</thinking>', '', 'gis'), chr(32) || chr(10) || chr(9) || chr(13))) AS answer_md5
FROM documents""")
def strip_think(t):
    said = F.concat(F.lit("<think>"), F.substring("text", 1, 40), F.lit("</THINK>"), F.col("text"))
    return t("documents").select("doc_id", F.md5(C.strip_thinking(said).cast("binary")).alias("answer_md5"))


@R.add(r"""
WITH r AS (SELECT doc_id, [[lang, source, 'n|' || n_chars], [left(text, 20)]] AS rows FROM documents),
c AS (SELECT doc_id, list_transform(rows, lambda r: '| ' || array_to_string(list_transform(range(1, 4), lambda i: replace(regexp_replace(coalesce(r[i], ''), '\r\n|\r|\n', ' ', 'g'), '|', '\|')), ' | ') || ' |') AS ls FROM r)
SELECT doc_id, array_to_string([ls[1], '| --- | --- | --- |', ls[2]], chr(10)) AS body FROM c""")
def pipe_table(t):
    rows = F.array(F.array("lang", "source", F.concat(F.lit("n|"), F.col("n_chars").cast("string"))), F.array(F.substring("text", 1, 20)))
    return t("documents").select("doc_id", C.pipe_table(rows).alias("body"))


@R.add("""
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS at
FROM (SELECT event_id, floor(value * 97)::BIGINT AS s FROM events WHERE value >= 0)""")
def timestamp_format(t):
    return t("events").filter("value >= 0").select("event_id", C.timestamp_text(F.col("value") * 97).alias("at"))


@R.add(r"""
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text
  WHEN contains(h, '.') AND 300 - instr(reverse(h), '.') > 240 THEN left(h, 301 - instr(reverse(h), '.'))
  WHEN contains(h, chr(10)) AND 300 - instr(reverse(h), chr(10)) > 240 THEN left(h, 300 - instr(reverse(h), chr(10)))
  ELSE h || '...' END AS context
FROM (SELECT doc_id, text, left(text, 300) AS h FROM documents)""")
def truncated_context(t):
    return t("documents").select("doc_id", C.cut_at_sentence(F.col("text"), 300).alias("context"))


@R.add("SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def token_counts(t):
    return t("documents").select("doc_id", C.token_estimate(F.col("text")).alias("tokens"))


@R.add(r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN true ELSE false END AS is_url,
       list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS name,
       lower(regexp_extract(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')), '^.+(\.[^.]+)$', 1)) AS suffix
FROM pages""")
def page_names(t):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return t("pages").select("page_id", C.is_url(F.col("url")).alias("is_url"), C.base_name(path).alias("name"), C.suffix(path).alias("suffix"))


@R.add(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace('{"a": "' || lang || '", }', '^\s+|\s+$', '', 'g'), ',(\s*[}\]])', '\1', 'g')) AS json_md5,
       json_extract_string(regexp_replace('{"a": "' || lang || '", }', ',(\s*[}\]])', '\1', 'g'), '$.a') AS a FROM documents""")
def cleaned_json(t):
    cleaned = C.clean_json(F.concat(F.lit('{"a": "'), F.col("lang"), F.lit('", }')))
    return t("documents").select("doc_id", F.md5(cleaned.cast("binary")).alias("json_md5"), F.get_json_object(cleaned, "$.a").alias("a"))


@R.add(r"""SELECT doc_id, regexp_replace(left(text, 200), '\.', '') AS cut,
  '<b>' || lang || '</b> &lt;' || source || '&gt;' AS markup FROM documents""")
def inline_markup(t):
    marked = F.concat(F.lit("**"), F.col("lang"), F.lit("** <"), F.col("source"), F.lit(">"))
    first = F.concat(F.substring_index(F.substring("text", 1, 200), ".", 1), F.substring(F.substring("text", 1, 200), F.length(F.substring_index(F.substring("text", 1, 200), ".", 1)) + 2, F.lit(200)))
    return t("documents").select("doc_id", first.alias("cut"), C.inline_markup(marked).alias("markup"))


@R.add("""
SELECT doc_id, 'lang=' || lang || ';n=' || n_chars || ';source=' || source AS options, md5('lang=' || lang || ';n=' || n_chars || ';source=' || source) AS key FROM documents""")
def option_keys(t):
    options = F.create_map(F.lit("source"), F.col("source"), F.lit("n"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang"), F.lit("gone"), F.lit(None).cast("string"))
    key = C.options_key(options)
    return t("documents").select("doc_id", key.alias("options"), F.md5(key.cast("binary")).alias("key"))
