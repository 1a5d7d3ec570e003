"""What models answer: JSON wherever it hides, entities, scores."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import strip

THINKING = re.compile(r"<(think|thinking)>.*?</\1>", re.S | re.I)
#: Control characters that JSON made of the first letters of LaTeX commands.
_EATEN = {"\f": r"\f", "\b": r"\b", "\t": r"\t", "\r": r"\r"}

ENTITY = T.StructType([T.StructField(n, T.StringType()) for n in ("description", "entity_name", "entity_type", "summary")])


_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_WORDS = {"true": True, "false": False, "null": None}
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")


class _Reader:
    """Reads one JSON value from a place in a text, as leniently as told.

    ``commas``: one may stand before a closing bracket. ``plain``: a backslash
    before a letter is no escape, as in LaTeX that was not escaped. Deep
    nesting and anything else out of order raises ValueError.
    """

    def __init__(self, text: str, commas: bool, plain: bool) -> None:
        self.text, self.commas, self.plain = text, commas, plain

    def blank(self, at: int) -> int:
        while at < len(self.text) and self.text[at] in " \t\n\r":
            at += 1
        return at

    def value(self, at: int, depth: int = 0) -> tuple[Any, int]:
        c = self.text[at : at + 1]
        if c == '"':
            return self.string(at + 1)
        if c and c in "{[" and depth < 100:
            return self.items(at + 1, c, depth)
        if number := _NUMBER.match(self.text, at):
            return json.loads(number[0]), number.end()
        for word, meaning in _WORDS.items():
            if self.text.startswith(word, at):
                return meaning, at + len(word)
        raise ValueError("no value")

    def items(self, at: int, opened: str, depth: int) -> tuple[Any, int]:
        closing = "}" if opened == "{" else "]"
        keys, values, after_comma = [], [], False
        while True:
            at = self.blank(at)
            if self.text[at : at + 1] == closing and (not after_comma or self.commas):
                return (dict(zip(keys, values, strict=True)) if opened == "{" else values), at + 1
            if values and not after_comma:
                raise ValueError("no comma")
            if opened == "{":
                if self.text[at : at + 1] != '"':
                    raise ValueError("no key")
                key, at = self.string(at + 1)
                at = self.blank(at)
                if self.text[at : at + 1] != ":":
                    raise ValueError("no colon")
                keys.append(key)
                at = self.blank(at + 1)
            found, at = self.value(at, depth + 1)
            values.append(found)
            at = self.blank(at)
            after_comma = self.text[at : at + 1] == ","
            at += after_comma

    def string(self, at: int) -> tuple[str, int]:
        out: list[str] = []
        while True:
            c = self.text[at : at + 1]
            if c == '"':
                return "".join(out), at + 1
            if not c or c < " ":
                raise ValueError("an open string")
            if c != "\\":
                out.append(c)
                at += 1
                continue
            c = self.text[at + 1 : at + 2]
            if self.plain and c.isascii() and c.isalpha():
                out.append("\\")
                at += 1
            elif c == "u":
                out.append(chr(int(self.text[at + 2 : at + 6], 16)))
                at += 6
            elif c in _ESCAPES:
                out.append(_ESCAPES[c])
                at += 2
            else:
                raise ValueError("no escape")


def _objects(text: str) -> Iterator[tuple[int, dict]]:
    """(leniency, object) of the objects in ``text``, none inside another."""
    at = text.find("{")
    while at >= 0:
        for leniency, (commas, plain) in enumerate(((False, False), (True, False), (True, True))):
            try:
                found, end = _Reader(text, commas, plain).value(at)
            except ValueError:
                continue
            yield leniency, found
            at = end - 1
            break
        at = text.find("{", at + 1)


def _fences(text: str) -> list[str]:
    """What stands between triple backticks, a language's name left out."""
    return [part.removeprefix("json") for part in text.split("```")[1::2]]


def _restored(value: Any) -> Any:
    """Commands whose first letter an escape took: ``\\frac``, ``\\beta``, ``\\theta``."""
    if isinstance(value, str):
        return re.sub("[\f\b\t\r](?=[a-zA-Z]{2})", lambda m: _EATEN[m[0]], value) if re.search("[\f\b]", value) else value
    if isinstance(value, dict):
        return {k: _restored(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_restored(v) for v in value]
    return value


def _field(text: str, name: str) -> str | None:
    """The string after a key, its escapes as they stand; None if it has no end."""
    at = text.find(f'"{name}":')
    if at < 0:
        return None
    rest = text[at + len(name) + 3 :].lstrip()
    end = 1
    while end < len(rest) and rest[end] != '"':
        end += 2 if rest[end] == "\\" else 1
    return rest[1:end] if rest[:1] == '"' and end < len(rest) else None


def parse_object(text: str) -> dict:
    """The object meant: one that needs the least leniency, a fenced one before others.

    An empty object counts as none. Where nothing parses, known fields are
    picked out one by one.
    """
    clean = THINKING.sub("", text)
    found = [x for part in (*_fences(clean), clean) for x in _objects(part) if x[1]]
    if found:
        return _restored(min(found, key=lambda x: x[0])[1])
    description = _field(text, "detailed_description") or ""
    name = _field(text, "entity_name") or "entity_" + hashlib.md5(text.encode()).hexdigest()
    summary = _field(text, "summary")
    return {"detailed_description": description, "entity_info": {"entity_name": name, "entity_type": _field(text, "entity_type") or "unknown", "summary": description[:100] if summary is None else summary}}


def describe_entity(answer: str | None, kind: str, body: str, name: str | None = None) -> tuple[str, str, str, str]:
    """(description, entity name, type, summary) of an answer.

    The name carries its kind. An answer without the wanted fields describes
    the item by its own text; a given name wins.
    """
    clean = THINKING.sub("", answer or "").strip()
    parsed = parse_object(answer) if answer else {}
    info = parsed.get("entity_info") if isinstance(parsed.get("entity_info"), dict) else {}
    described = parsed.get("detailed_description")
    if described and all(info.get(k) for k in ("entity_name", "entity_type", "summary")):
        return str(described), name or f"{info['entity_name']} ({info['entity_type']})", str(info["entity_type"]), str(info["summary"])
    text = clean or body or ""
    return text, name or f"{kind}_{hashlib.md5((body or '').encode()).hexdigest()[:8]}", kind, text[:97] + "..." if len(text) > 100 else text


@F.pandas_udf(ENTITY)
def entity_udf(answer: pd.Series, kind: pd.Series, body: pd.Series) -> pd.DataFrame:
    rows = [describe_entity(a, k, b) for a, k, b in zip(answer, kind, body, strict=True)]
    return pd.DataFrame(rows, columns=["description", "entity_name", "entity_type", "summary"])


def evaluation_score(answer: Column) -> Column:
    """1, 0 or null of a judge's answer: its number, else its words, else 0.

    Positive words are looked for first and as substrings, so that
    ``incorrect`` scores 1: kept for equal results.
    """
    number = F.regexp_extract(answer, r'(?i)"?accuracy"?\s*[:=]\s*"?([01])', 1)
    low = F.lower(answer)
    good = low.contains("correct") | low.contains("accurate") | low.contains("yes")
    return F.when(answer.isNull(), None).when(number != "", number.cast("int")).when(good, 1).otherwise(0)


def balance_json(text: Column) -> Column:
    """An answer's JSON without fences and control characters, its braces closed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*```(?:json)?\s*$", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    return F.concat(strip(bare), F.repeat(F.lit("}"), F.greatest(count("{") - count("}"), F.lit(0))))
