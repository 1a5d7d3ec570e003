"""Column functions: text, tables, equations, media names, keys.

All native expressions. White space means what Unicode calls so.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends of a text, as a character class.
SPACE_CLASS = r"\s\x0B\x1C-\x1F\x85\xA0  -     　"

#: Suffixes by kind of file.
TEXT_SUFFIXES = (".txt", ".md")
OFFICE_SUFFIXES = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx")
IMAGE_SUFFIXES = (".png", ".jpeg", ".jpg", ".bmp", ".tiff", ".tif", ".gif", ".webp")
HTML_SUFFIXES = (".html", ".htm", ".xhtml")
AUDIO_SUFFIXES = (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac", ".opus", ".wma")
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".webm", ".flv", ".wmv", ".m4v")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def blank(text: Column) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(strip(text), F.lit("")) == ""


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty; else the empty text."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def captions(values: Column) -> Column:
    """Stripped, non-blank entries of an array; null is empty."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))


def table_cell(cell: Column) -> Column:
    """One cell of a pipe table: no line breaks, no bare pipe, null is empty."""
    return F.replace(F.regexp_replace(F.coalesce(cell, F.lit("")), "\r\n|\r|\n", " "), F.lit("|"), F.lit("\\|"))


def pipe_table(rows: Column) -> Column:
    """array<array<string>> as a pipe table; short rows are filled up."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.transform(F.sequence(F.lit(0), width - 1), lambda i: table_cell(F.get(r, i)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    # A table whose rows are all empty still has one cell's worth of frame.
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.greatest(F.size(body), F.lit(1)))), "\n")).otherwise("")


def equation_text(latex: Column, text: Column, equation: Column) -> Column:
    return first_filled(strip(latex), strip(text), strip(equation))


def equation_format(latex: Column, given: Column) -> Column:
    named = strip(F.coalesce(given, F.lit("")))
    return F.when(named != "", named).when(~blank(latex), "latex").otherwise("")


def equation_description(latex: Column, text: Column) -> Column:
    """The text beside a formula, where it is not the formula again."""
    return F.when(~blank(latex) & (strip(text) != strip(latex)), F.coalesce(strip(text), F.lit(""))).otherwise("")


def block_text(kind: Column, text: Column, level: Column, names: Column) -> Column:
    """A block as context shows it: headings marked, pictures and tables by caption."""
    named = F.array_join(captions(names), ", ")
    label = lambda word: F.when(named != "", F.concat(F.lit(f"[{word}: "), named, F.lit("]"))).otherwise("")
    heading = F.when(F.coalesce(level, F.lit(0)) > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)
    return F.when(kind == "text", heading).when(kind == "image", label("Image")).when(kind == "table", label("Table")).otherwise("")


def strip_thinking(text: Column) -> Column:
    """Without the reasoning blocks that some models put before an answer."""
    out = F.regexp_replace(text, "(?is)<think>.*?</think>", "")
    return strip(F.regexp_replace(out, "(?is)<thinking>.*?</thinking>", ""))


def clean_json(text: Column) -> Column:
    """Stripped, without commas before a closing bracket."""
    return F.regexp_replace(strip(text), r",(\s*[}\]])", "$1")


def timestamp_text(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; fractions are cut off."""
    s = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-cased suffix with its dot; names that start with a dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def route(path: Column) -> Column:
    """The kind of reader a path goes to."""
    s = suffix(path)
    out = F.when(s == ".pdf", "pdf")
    for kind, names in (("audio", AUDIO_SUFFIXES), ("video", VIDEO_SUFFIXES), ("image", IMAGE_SUFFIXES), ("html", HTML_SUFFIXES), ("office", OFFICE_SUFFIXES), ("text", TEXT_SUFFIXES)):
        out = out.when(s.isin(*names), kind)
    return out.otherwise("generic")


def is_url(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def public_url(path: Column, root: str, base: str) -> Column:
    """A path below ``root`` as a URL below ``base``; null elsewhere."""
    inside = path.startswith(root.rstrip("/") + "/") & ~path.contains("/../")
    rest = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
    quoted = F.array_join(F.transform(F.split(rest, "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")
    return F.when(inside, F.concat(F.lit(base.rstrip("/") + "/"), quoted))


def image_mime(head: Column) -> Column:
    """Media type by the first 18 bytes, null if they are no image's."""
    at = lambda i, n: F.hex(F.substring(head, i, n))
    # Signatures, and the header sizes that a bitmap may have.
    dib = ("0C000000", "28000000", "34000000", "38000000", "40000000", "6C000000", "7C000000")
    return (
        F.when(at(1, 8) == "89504E470D0A1A0A", "image/png")
        .when(at(1, 3) == "FFD8FF", "image/jpeg")
        .when(at(1, 6).isin("474946383761", "474946383961"), "image/gif")
        .when(at(1, 4).isin("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "image/tiff")
        .when((at(1, 4) == "52494646") & (at(9, 4) == "57454250"), "image/webp")
        .when((at(1, 2) == "424D") & (F.length(head) >= 18) & at(15, 4).isin(*dib), "image/bmp")
    )


def encode_image(content: Column) -> Column:
    """Base64 of an image, in one line; the empty text for anything else."""
    # Spark breaks lines after 76 characters.
    return F.when(image_mime(content).isNotNull(), F.translate(F.base64(content), "\r\n", "")).otherwise("")


def md5_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(text.cast("binary")))


def options_key(options: Column) -> Column:
    """One text for a map, whatever the order of its keys; null values are left out."""
    kept = F.map_filter(options, lambda k, v: v.isNotNull())
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def output_dir(path: Column) -> Column:
    """A folder name that two files of one stem do not share."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.md5(path.cast("binary")), 1, 8))


def _paired(line: Column, mark: str, tag: str) -> Column:
    """``line`` with what stands between a mark and the next one in a tag; a mark left over stays."""
    parts = F.split(line, re.escape(mark), -1)
    inside = lambda part: F.concat(F.lit(f"<{tag}>"), part, F.lit(f"</{tag}>"))
    alone = lambda part: F.concat(F.lit(mark), part)
    return F.array_join(F.transform(parts, lambda part, k: F.when(k % 2 == 0, part).when(k + 1 < F.size(parts), inside(part)).otherwise(alone(part))), "")


def inline_markup(text: Column) -> Column:
    """Inline Markdown as markup, after escaping; marks pair up within a line.

    A quote in a link's target is escaped too, so that it ends no attribute.
    """
    safe = text
    for bare, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(bare), F.lit(entity))
    safe = F.regexp_replace(safe, r'(?<=\]\([^)]{0,999})"', "&quot;")

    def one_line(line: Column) -> Column:
        for mark, tag in (("~~", "s"), ("**", "b"), ("__", "b")):
            line = _paired(line, mark, tag)
        return F.regexp_replace(line, r"(?<!\w)([*_])((?:(?!\1).)+)\1(?!\w)", "<i>$2</i>")

    out = F.array_join(F.transform(F.split(safe, "\n", -1), one_line), "\n")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')
    return F.regexp_replace(out, "`([^`]+)`", "<code>$1</code>")


def cut_at_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters, ending at a sentence or line if one ends late.

    A full stop in the last fifth is kept as the end, else a line break there
    is cut before, else dots are added.
    """
    head = F.substring(text, 1, most)
    back = F.reverse(head)
    n = F.length(head)
    stop = n - F.instr(back, ".")  # places from 0; n if there is none
    line = n - F.instr(back, "\n")
    has = lambda c: F.instr(back, c) > 0
    return (
        F.when(F.length(text) <= most, text)
        .when(has(".") & (stop > n * 0.8), F.substring(text, F.lit(1), stop + 1))
        .when(has("\n") & (line > n * 0.8), F.substring(text, F.lit(1), line))
        .otherwise(F.concat(head, F.lit("...")))
    )


def join_spans(parts: Column) -> Column:
    """Texts of spans in a row: a space between words, none beside CJK or marks."""
    cjk = "　-ヿㇰ-ㇿ㐀-鿿｡-ﾟ"

    def step(done: Column, part: Column) -> Column:
        glue = done.rlike(f"[^{cjk}{SPACE_CLASS}(\\[{{]$") & part.rlike(f"^[^{cjk}{SPACE_CLASS},.;:!?)\\]}}]")
        return F.when(part == "", done).when(done == "", part).when(glue, F.concat(done, F.lit(" "), part)).otherwise(F.concat(done, part))

    return strip(F.aggregate(parts, F.lit(""), step))


def file_kind_diagnosis(message: Column, hints: dict[str, str]) -> Column:
    """The hint of the first known phrase in an error message, else null."""
    out = None
    for phrase, hint in hints.items():
        found = F.lower(message).contains(phrase.lower())
        out = F.when(found, hint) if out is None else out.when(found, hint)
    return F.lit(None).cast("string") if out is None else out
