"""Pages of HTML as content blocks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements whose text is not shown, and those that end a block.
HIDDEN = frozenset(("script", "style", "head", "template", "noscript", "svg"))
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.level: int | None = None
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.blocks.append({"type": "text", "text": text} | ({"text_level": self.level} if self.level else {}))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag == "img":
            given = dict(attrs)
            if given.get("src"):
                if self.rows is None:
                    self.end_block()
                self.blocks.append({"type": "image", "img_path": given["src"], "caption": [given["alt"].strip()] if (given.get("alt") or "").strip() else []})
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.cell = []
        elif tag == "table":
            self.end_block()
            self.rows = []
        elif tag in BLOCKS:
            self.end_block()
            self.level = HEADINGS.get(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.rows is not None:
            if tag in ("td", "th") and self.cell is not None:
                (self.rows or [self.rows.append([]) or self.rows[-1]])[-1].append(" ".join("".join(self.cell).split()))
                self.cell = None
            elif tag == "table":
                rows = [r for r in self.rows if r]
                if rows:
                    self.blocks.append({"type": "table", "body": json.dumps(rows, ensure_ascii=False)})
                self.rows = self.cell = None
        elif tag in BLOCKS:
            self.end_block()
            self.level = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.rows is None else self.cell if self.cell is not None else []).append(data)


def html_blocks(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.end_block()
    return reader.blocks


def read_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block_idx, type, text, text_level, img_path, body) of HTML pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "block_idx", "type", "text", "text_level", "img_path", "body"]
        for f in frames:
            rows = [(k, i, b["type"], b.get("text"), b.get("text_level"), b.get("img_path"), b.get("body")) for k, page in zip(f[key], f[html], strict=True) for i, b in enumerate(html_blocks(page))]
            yield pd.DataFrame({n: pd.Series([r[j] for r in rows], dtype=object) for j, n in enumerate(names)}).astype({"block_idx": "Int32", "text_level": "Int32"})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, block_idx int, type string, text string, text_level int, img_path string, body string")
