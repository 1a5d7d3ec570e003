"""Office math to LaTeX, by a table of templates over an element's parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: The namespaces of office documents.
MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: Large operators.
OPERATORS = {
    "∑": r"\sum",
    "∏": r"\prod",
    "∐": r"\coprod",
    "∫": r"\int",
    "∬": r"\iint",
    "∭": r"\iiint",
    "∮": r"\oint",
    "∯": r"\oiint",
    "⋃": r"\bigcup",
    "⋂": r"\bigcap",
    "⨀": r"\bigodot",
    "⨁": r"\bigoplus",
    "⨂": r"\bigotimes",
}
#: Symbols in text.
SYMBOLS = {
    "±": r"\pm",
    "×": r"\times",
    "÷": r"\div",
    "∂": r"\partial",
    "∇": r"\nabla",
    "√": r"\sqrt{}",
    "∞": r"\infty",
    "≈": r"\approx",
    "≠": r"\neq",
    "≤": r"\leq",
    "≥": r"\geq",
    "→": r"\to",
    "⇒": r"\Rightarrow",
    "⇔": r"\Leftrightarrow",
    "∈": r"\in",
    "∉": r"\notin",
    "⊂": r"\subset",
    "⊆": r"\subseteq",
    "⋅": r"\cdot",
    "…": r"\dots",
}
#: Accents.
ACCENTS = {
    "̂": r"\hat",
    "̃": r"\tilde",
    "̄": r"\bar",
    "̇": r"\dot",
    "̈": r"\ddot",
    "⃗": r"\vec",
    "̌": r"\check",
    "̆": r"\breve",
}
#: Brackets that LaTeX spells otherwise.
BRACKETS = {"{": r"\{", "}": r"\}", "‖": r"\|", "⟨": r"\langle", "⟩": r"\rangle", "⌊": r"\lfloor", "⌋": r"\rfloor", "⌈": r"\lceil", "⌉": r"\rceil"}
#: Function names that are commands.
FUNCTIONS = frozenset("sin cos tan csc sec cot sinh cosh tanh coth arcsin arccos arctan log lg ln exp lim liminf limsup max min sup inf det dim ker arg deg gcd hom Pr".split())

#: Elements whose LaTeX is their parts in a frame: ``<part>`` is that child's.
TEMPLATES = {
    "f": r"\frac{<num>}{<den>}",
    "sSup": "{<e>}^{<sup>}",
    "sSub": "{<e>}_{<sub>}",
    "sSubSup": "{<e>}_{<sub>}^{<sup>}",
    "sPre": "{}_{<sub>}^{<sup>}{<e>}",
    "limLow": "<e>_{<lim>}",
    "limUpp": "<e>^{<lim>}",
    "box": "<e>",
    "phant": r"\phantom{<e>}",
}
_PART = re.compile("<([A-Za-z]+)>")
#: Text that tracked changes took away.
REMOVED = ("del", "moveFrom")


def escape(text: str | None) -> str:
    """Symbols as commands, kept apart from letters that follow or may follow."""
    text = text or ""
    out = []
    for c, after in zip(text, [*text[1:], "a"], strict=False):
        command = SYMBOLS.get(c)
        ends_word = command and command[-1].isalpha() and after.isascii() and after.isalpha()
        out.append(f"{command} " if ends_word else command or c)
    return "".join(out)


class _Node:
    """An element with its parts by name."""

    def __init__(self, element: ElementTree.Element) -> None:
        self.element = element
        self.name = element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""

    def all(self, name: str) -> list[_Node]:
        return [_Node(c) for c in self.element if c.tag == MATH + name]

    def part(self, name: str) -> _Node | None:
        return next(iter(self.all(name)), None)

    def inner(self, name: str) -> str:
        found = self.part(name)
        return "" if found is None else found.content()

    def filled(self, name: str) -> bool:
        found = self.part(name)
        return found is not None and len(found.element) > 0

    def option(self, group: str, name: str, default: str | None, bare: str | None = None) -> str | None:
        """The value of a property; ``bare`` if it stands without one."""
        held = self.part(group)
        found = None if held is None else held.part(name)
        return default if found is None else found.element.get(MATH + "val", default if bare is None else bare)

    def content(self) -> str:
        return "".join(_Node(c).latex() + escape(c.tail) for c in self.element)

    def latex(self) -> str:
        if self.name in REMOVED:
            return ""
        if self.name in TEMPLATES:
            return _PART.sub(lambda m: self.inner(m[1]), TEMPLATES[self.name])
        special = getattr(self, f"_{self.name}", None)
        return special() if special else self.content()

    def _t(self) -> str:
        return escape(self.element.text)

    def _r(self) -> str:
        return "".join(t._t() for t in self.all("t"))

    def _oMathPara(self) -> str:  # noqa: N802
        return " ".join(m.latex() for m in self.all("oMath"))

    def _rad(self) -> str:
        hidden = (self.option("radPr", "degHide", "0", "1") or "").lower() in ("1", "true", "on")
        degree = f"[{self.inner('deg')}]" if self.filled("deg") and not hidden else ""
        return rf"\sqrt{degree}{{{self.inner('e')}}}"

    def _nary(self) -> str:
        sign = self.option("naryPr", "chr", None)
        out = OPERATORS.get(sign, sign) if sign else r"\int"
        out += "".join(f"{mark}{{{self.inner(name)}}}" for name, mark in (("sub", "_"), ("sup", "^")) if self.filled(name))
        body = self.inner("e")
        return f"{out} {body}" if body else out

    def _func(self) -> str:
        name, argument = self.part("fName"), self.inner("e")
        for kind, mark in (("limLow", "_"), ("limUpp", "^")):
            limit = name.part(kind) if name else None
            if limit and (base := limit.inner("e").strip()) in FUNCTIONS:
                return rf"\{base}{mark}{{{limit.inner('lim')}}}{{{argument}}}"
        said = name.content().strip() if name else ""
        if said in FUNCTIONS:
            return rf"\{said}{{{argument}}}"
        held = self.part("e")
        bracketed = held is not None and [c.tag for c in held.element] == [MATH + "d"]
        return said + argument if bracketed else f"{said}({argument})"

    def _d(self) -> str:
        left, right, between = (self.option("dPr", n, d) for n, d in (("begChr", "("), ("endChr", ")"), ("sepChr", ",")))
        return BRACKETS.get(left, left) + between.join(e.content() for e in self.all("e")) + BRACKETS.get(right, right)

    def _m(self) -> str:
        rows = [" & ".join(e.content() for e in row.all("e")) for row in self.all("mr")]
        return r"\begin{matrix} " + r" \\ ".join(rows) + r" \end{matrix}"

    def _eqArr(self) -> str:  # noqa: N802
        return r"\begin{aligned} " + r" \\ ".join(e.content() for e in self.all("e")) + r" \end{aligned}"

    def _bar(self) -> str:
        return (r"\overline" if self.option("barPr", "pos", "top") == "top" else r"\underline") + f"{{{self.inner('e')}}}"

    def _acc(self) -> str:
        return ACCENTS.get(self.option("accPr", "chr", "̂"), r"\hat") + f"{{{self.inner('e')}}}"

    def _groupChr(self) -> str:  # noqa: N802
        sign, below = self.option("groupChrPr", "chr", "", ""), self.option("groupChrPr", "pos", "top") == "bot"
        brace = {"⏞": r"\overbrace", "⏟": r"\underbrace"}.get(sign)
        return (brace or (r"\underset" if below else r"\overset") + f"{{{sign}}}") + f"{{{self.inner('e')}}}"


def omml_latex(element: ElementTree.Element) -> str:
    return _Node(element).latex().strip()


def equations(root: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Outermost equations in order, tracked deletions left out."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == MATH + "oMath":
            yield node
        elif node.tag not in (WORD + "del", WORD + "moveFrom"):
            stack.extend(reversed(node))


def docx_equations(content: bytes) -> list[str]:
    """LaTeX of a document's equations; none if it is no readable document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as held:
            root = ElementTree.fromstring(held.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    return [t for t in map(omml_latex, equations(root)) if t]


def read_equations(files: DataFrame) -> DataFrame:
    """(path, eq_idx, latex) of (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, k, t) for p, c in zip(f["path"], f["content"], strict=True) for k, t in enumerate(docx_equations(c))]
            yield pd.DataFrame(rows, columns=["path", "eq_idx", "latex"])

    return files.select("path", "content").mapInPandas(run, "path string, eq_idx int, latex string")
