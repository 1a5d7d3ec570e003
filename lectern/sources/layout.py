"""Layout JSON: pages of typed blocks, and trees of references, as blocks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: The block types of the paged format.
FURNITURE = ("page_header", "page_footer", "page_number", "page_aside_text", "page_footnote")
PROSE = ("title", "paragraph", "abstract", "phonetic", "text")
LISTS = ("list", "index")
INLINE_MATH = ("equation_inline", "inline_equation")
#: Where visible text may stand in a span, in order.
TEXT_KEYS = ("title_content", "paragraph_content", "math_content", "code_content", "algorithm_content", "text")
#: Ranges of characters that take no space beside them.
CJK = ((0x3000, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xFF61, 0xFF9F))

ROW = "block_idx int, type string, text string, text_level int, page_idx int, img_path string, caption array<string>, footnote array<string>, body string, text_format string, sub_type string, bbox array<double>, anchor string, raw string"


class LayoutError(ValueError):
    """The payload is no usable list of pages."""


def _wide(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK)


def glue(parts: list[str]) -> str:
    """Spans in a row: a space between words, none beside wide characters or marks."""
    out = ""
    for part in filter(None, parts):
        if out:
            x, y = out[-1], part[0]
            if not (x.isspace() or y.isspace() or _wide(x) or _wide(y) or y in ",.;:!?)]}" or x in "([{"):
                out += " "
        out += part
    return out.strip()


def visible(value: Any) -> str:
    """The text that a value shows; inline formulas in dollar signs."""
    match value:
        case None:
            return ""
        case str():
            return value
        case list() | tuple():
            return glue([visible(v) for v in value])
        case dict():
            if value.get("type") in INLINE_MATH:
                inner = visible(value.get("content", value.get("text", "")))
                return inner if not inner or inner[0] == "$" else f"${inner}$"
            return _first_text(value)
        case _:
            return str(value)


def _first_text(value: dict) -> str:
    if value.get("content") not in (None, "") and (t := visible(value["content"])):
        return t
    if value.get("children"):
        return visible(value["children"])
    for key in TEXT_KEYS:
        if t := visible(value.get(key)):
            return t
    return ""


def named(value: Any) -> list[str]:
    """Captions: a text, a span, a run of spans or a list of any of these."""
    if isinstance(value, list | tuple) and not any(isinstance(v, dict) and "type" in v for v in value):
        return [t for v in value for t in named(v)]
    text = visible(value).strip()
    return [text] if text else []


def source_path(source: Any) -> str:
    if isinstance(source, dict):
        source = next((source[k] for k in ("path", "source", "url") if k in source), "")
    path = source.strip() if isinstance(source, str) else ""
    return "" if path.replace("\\", "/").rsplit("/", 1)[-1] in ("", ".", "..") else path


def _whole(value: Any) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _pick(content: dict, *keys: str, rest: Any = "") -> Any:
    return next((content[k] for k in keys if k in content), rest)


def layout_block(block: dict, page: int, furniture: bool = False) -> dict | None:
    """One block of the paged format as a row; None if it shows nothing."""
    kind = block.get("type").strip() if isinstance(block.get("type"), str) else ""
    inner = block.get("content")
    content = dict(inner) if isinstance(inner, dict) else {} if inner in (None, "") else {"content": inner}
    row: dict = {}
    if kind in FURNITURE:
        row = {"type": kind, "text": visible(_pick(content, f"{kind}_content", "text", rest=content)).strip()} if furniture else {}
    elif kind in INLINE_MATH:
        text = visible(_pick(content, "math_content", "text", rest=content)).strip()
        row = {"type": "text", "text": text if not text or text[0] == "$" else f"${text}$"}
    elif kind in PROSE:
        row = {"type": "text", "text": visible(_pick(content, f"{kind}_content", "text", "content", rest=content)).strip()}
        level = _whole(_pick(content, "level", rest=block.get("level"))) if kind == "title" else None
        row["text_level"] = level if level and level > 0 else None
    elif kind in LISTS:
        entries = content.get("list_items", [])
        entries = entries if isinstance(entries, list | tuple) else [entries]
        items = [visible(_pick(e, "item_content", "content", "text", rest=e) if isinstance(e, dict) else e).strip() for e in entries]
        items = [i for i in items if i] or [t for t in [visible(_pick(content, "text", rest=content)).strip()] if t]
        row = {"type": "text", "text": "\n".join(items), "sub_type": content.get("list_type") or None}
    elif kind == "ref_text":
        row = {"type": "text", "text": visible(_pick(content, "ref_text_content", "text", "content", rest=content)).strip(), "sub_type": "reference_list"}
    elif kind in ("image", "table", "chart"):
        text = visible(_pick(content, "chart_content", "content") if kind == "chart" else content.get("content", "") if kind == "image" else "").strip()
        body = next((content[k] for k in ("html", "table_body", "table_data") if content.get(k) not in (None, "")), None) if kind == "table" else None
        row = {"type": kind, "text": text or None, "body": body if isinstance(body, str | None) else json.dumps(body, ensure_ascii=False), "img_path": source_path(content.get("image_source"))}
        row |= {"caption": named(content.get(f"{kind}_caption")), "footnote": named(content.get(f"{kind}_footnote"))}
        row["shown"] = True
    elif kind == "equation_interline":
        form = _pick(content, "math_type", "text_format", rest=None)
        row = {"type": "equation", "text": visible(_pick(content, "math_content", "text", "latex")).strip() or None, "text_format": form if isinstance(form, str) and form else None, "img_path": source_path(content.get("image_source")), "shown": True}
    elif kind in ("code", "algorithm"):
        row = {"type": "code", "sub_type": kind, "body": visible(_pick(content, f"{kind}_content", "content")).strip(), "caption": named(content.get(f"{kind}_caption")), "footnote": named(content.get(f"{kind}_footnote")), "text_format": content.get("code_language") or None, "shown": True}
    if not row or not (row.pop("shown", False) or row.get("text")):
        return None
    own = _whole(block.get("page_idx"))
    row["page_idx"] = page if own is None else own
    box = block.get("bbox")
    row["bbox"] = [float(x) for x in box] if isinstance(box, list | tuple) and len(box) == 4 else None
    row["anchor"] = block["anchor"].strip() or None if isinstance(block.get("anchor"), str) else None
    sub = block.get("sub_type", content.get("sub_type"))
    if isinstance(sub, str) and sub.strip():
        row["sub_type"] = sub.strip()
    return row


def layout_blocks(payload: Any, furniture: bool = False) -> list[dict]:
    """Rows of a list of pages; LayoutError if there is none to read."""
    if not (isinstance(payload, list) and payload and all(isinstance(p, list) for p in payload)):
        raise LayoutError("a list of pages, each a list of blocks, is wanted")
    if not all(isinstance(b, dict) for p in payload for b in p) or not any(payload):
        raise LayoutError("pages hold objects, one at least")
    return [row for page, found in enumerate(payload) for b in found if (row := layout_block(b, page, furniture)) is not None]


def tree_blocks(tree: dict) -> list[dict]:
    """Rows of a tree whose nodes refer to each other, in reading order.

    A reference such as ``#/texts/3`` names a list and a place; groups and the
    body are passed through to their children. Pages count from 0.
    """

    def target(ref: Any) -> tuple[str, dict] | None:
        parts = ref.get("$ref", "").strip("#/").split("/") if isinstance(ref, dict) else []
        if parts == ["body"]:
            return "body", tree.get("body", {})
        if len(parts) != 2 or not parts[1].isdigit():
            return None
        found = tree.get(parts[0], [])
        return (parts[0], found[int(parts[1])]) if int(parts[1]) < len(found) else None

    def texts_of(refs: Any) -> list[str]:
        found = [target(r) for r in refs or []]
        return [t for f in found if f for t in [f[1].get("orig") or f[1].get("text") or ""] if t]

    out, stack, seen = [], [("body", tree.get("body", {}))], set()
    while stack:
        kind, node = stack.pop()
        if id(node) in seen:
            continue
        seen.add(id(node))
        pages = [p.get("page_no") for p in node.get("prov") or [] if isinstance(p, dict)]
        page = next((p - 1 for p in pages if isinstance(p, int) and p > 0), 0)
        row = None
        if kind == "texts":
            text = node.get("orig") or node.get("text") or ""
            if text.strip():
                row = {"type": "equation" if node.get("label") == "formula" else "text", "text": text}
                if node.get("label") == "formula":
                    row["text_format"] = "latex"
                elif node.get("label") in ("section_header", "title"):
                    row["text_level"] = int(node.get("level") or 1)
        elif kind == "pictures":
            row = {"type": "image", "img_path": source_path((node.get("image") or {}).get("uri")), "caption": texts_of(node.get("captions")), "footnote": texts_of(node.get("footnotes"))}
        elif kind == "tables":
            grid = (node.get("data") or {}).get("grid") or []
            cells = [[c.get("text", "") if isinstance(c, dict) else str(c) for c in line] for line in grid]
            row = {"type": "table", "body": json.dumps(cells, ensure_ascii=False), "caption": texts_of(node.get("captions")), "footnote": texts_of(node.get("footnotes"))}
        if row:
            out.append({"page_idx": page, **row})
        stack.extend(f for f in map(target, reversed(node.get("children") or [])) if f)
    return out


def ocr_lines(result: Any) -> list[str]:
    """Text lines anywhere in a recognizer's result; boxes and scores are passed by."""
    if isinstance(result, str):
        return [result.strip()] if result.strip() else []
    if isinstance(result, dict):
        for key in ("rec_texts", "texts", "text"):
            if result.get(key):
                return ocr_lines(result[key])
        return [t for v in result.values() if isinstance(v, list | dict | tuple) for t in ocr_lines(v)]
    if isinstance(result, list | tuple):
        if len(result) == 2 and isinstance(result[0], str) and isinstance(result[1], int | float):
            return ocr_lines(result[0])
        return [t for v in result for t in ocr_lines(v)]
    return []


def read_layout(payloads: DataFrame, furniture: bool = False) -> DataFrame:
    """Blocks of (path, json), paged or tree: path, the columns of ``ROW``, error.

    A payload that cannot be read has one row with its reason.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROW.split(", ")]
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["json"], strict=True):
                try:
                    payload = json.loads(text or "")
                    found = tree_blocks(payload) if isinstance(payload, dict) else layout_blocks(payload, furniture)
                    rows += [{"path": path, "block_idx": k, "raw": json.dumps(b, ensure_ascii=False), **b} for k, b in enumerate(found)]
                except ValueError as e:
                    rows.append({"path": path, "error": str(e)})
            columns = {n: pd.Series([r.get(n) for r in rows], dtype=object) for n in ("path", *names, "error")}
            yield pd.DataFrame(columns).astype({"block_idx": "Int32", "text_level": "Int32", "page_idx": "Int32"})

    return payloads.select("path", "json").mapInPandas(run, f"path string, {ROW}, error string")
