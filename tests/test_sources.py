"""Files, Markdown, layout JSON, office math."""

import io
import json
import zipfile
from xml.etree import ElementTree

import pytest

from lectern.functions import omml
from lectern.sources import files, layout, text

PNG = bytes.fromhex("89504E470D0A1A0A") + b"\0" * 16


def known(*names):
    return lambda name: f"/d/{name}" if name in names else None


def kinds(blocks):
    return [(b["type"], b.get("text") or b.get("img_path"), b.get("text_level")) for b in blocks]


def test_markdown_paragraphs_headings_fences():
    md = "# Top\r\nfirst\nsecond  \n\n## *Sub* #\n```\n# no heading\n\n![x](a.png)\n```\nlast\n####### seven"
    assert kinds(text.markdown_blocks(md, known("a.png"))) == [
        ("text", "Top", 1),
        ("text", "first\nsecond", None),
        ("text", "*Sub* #", 2),
        ("text", "```\n# no heading\n\n![x](a.png)\n```\nlast\n####### seven", None),
    ]


def test_fence_closes_only_on_its_own_mark():
    assert len(text.markdown_blocks("````\n```\n# a\n````\n# b")) == 2
    assert len(text.markdown_blocks("~~~\n```\n# a")) == 1


def test_markdown_images():
    find = known("a.png", "b c.png", "a%2Bb.png", "p(1).png")
    blocks = text.markdown_blocks('before\n![one](a.png "Title")\nsee ![two](<b c.png>) here\nmore', find)
    assert kinds(blocks) == [("text", "before", None), ("image", "/d/a.png", None), ("text", "see two here\nmore", None), ("image", "/d/b c.png", None)]
    assert blocks[1]["img_caption"] == ["one", "Title"]
    assert kinds(text.markdown_blocks("![](a%2Bb.png) ![x](p(1).png)", find)) == [("image", "/d/a%2Bb.png", None), ("image", "/d/p(1).png", None)]
    for kept in ("![x](http://h/a.png)", "![x](missing.png)", r"\![x](a.png)", "`![x](a.png)`", "a `code\n![x](a.png)` b"):
        assert kinds(text.markdown_blocks(kept, find)) == [("text", kept, None)]
    assert kinds(text.markdown_blocks("`open ![x](a.png)", find))[-1] == ("image", "/d/a.png", None)


def test_unclosed_images_take_linear_time():
    import time

    began = time.time()
    assert text.image_references("![a" * 60_000) == []
    assert text.image_references("`" * 3 + "![x](" * 30_000) == []
    assert time.time() - began < 3


def test_plain_text_and_encodings():
    assert [b["text"] for b in text.plain_blocks("a\r\nb\r\n \r\n\r\nc ")] == ["a\nb", "c"]
    assert text.decode_bytes("é".encode("utf-16")) == "é"
    assert text.decode_bytes("﻿é".encode()) == "é"
    assert text.decode_bytes("中文".encode("gbk")) == "中文"
    assert text.decode_bytes(None) == ""


def test_files_to_blocks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\n\n![x](p.png)\n![y](q.png)")
    (tmp_path / "p.PNG").write_bytes(PNG)
    (tmp_path / "p.png").write_bytes(PNG)
    (tmp_path / "q.png").write_bytes(b"no image")
    (tmp_path / "sub/b.TXT").write_bytes("é\n\nx".encode("latin-1"))
    (tmp_path / "sub/c.bin").write_bytes(b"")
    found = files.discover(spark, str(tmp_path))
    assert {(r.path.split("/")[-1], r.kind) for r in found.select("path", "kind").collect()} == {("a.md", "text"), ("p.PNG", "image"), ("p.png", "image"), ("q.png", "image"), ("b.TXT", "text")}
    assert files.discover(spark, str(tmp_path), recursive=False).count() == 4
    got = sorted((r.path.split("/")[-1], r.block_idx, r.type, r.text, r.img_path and r.img_path.split("/")[-1]) for r in files.read_texts(found).collect())
    assert got == [("a.md", 0, "text", "T", None), ("a.md", 1, "image", None, "p.png"), ("a.md", 2, "text", "![y](q.png)", None), ("b.TXT", 0, "text", "é", None), ("b.TXT", 1, "text", "x", None)]
    assert files.signatures(found).filter("length(md5) = 32 and length(sha256) = 64").count() == 5


def test_readers():
    files.register_reader(" Mine ", lambda f: f)
    assert files.list_readers() == ["mine", "text"]
    assert files.get_reader("MINE")("x") == "x"
    files.unregister_reader("mine")
    for call in (lambda: files.get_reader("mine"), lambda: files.register_reader("text", print), lambda: files.unregister_reader("text"), lambda: files.register_reader(" ", print)):
        with pytest.raises(ValueError):
            call()


def test_layout_pages():
    pages = [
        [
            {"type": "page_header", "content": {"page_header_content": "h"}},
            {"type": "title", "content": {"title_content": [{"type": "text", "content": "A"}, {"type": "equation_inline", "content": "x"}], "level": "2"}, "bbox": [1, 2, 3, 4]},
            {"type": "paragraph", "content": {"paragraph_content": [{"type": "text", "content": "中"}, {"type": "text", "content": "文"}, {"content": "end"}, {"content": "."}]}},
            {"type": "image", "content": {"image_source": {"path": "i/a.png"}, "image_caption": ["one", {"content": "two"}]}},
            {"type": "nonsense"},
        ],
        [
            {"type": "table", "content": {"html": "<table/>", "table_footnote": "n"}, "page_idx": "7"},
            {"type": "equation_interline", "content": {"math_content": "a=b", "math_type": "latex"}},
            {"type": "list", "content": {"list_items": [{"item_content": "x"}, "", "y"]}},
            {"type": "algorithm", "content": {"algorithm_content": "do"}},
            {"type": "paragraph", "content": {"paragraph_content": " "}},
        ],
    ]
    rows = layout.layout_blocks(pages)
    assert [(r["type"], r.get("text"), r["page_idx"]) for r in rows] == [("text", "A $x$", 0), ("text", "中文end.", 0), ("image", None, 0), ("table", None, 7), ("equation", "a=b", 1), ("text", "x\ny", 1), ("code", None, 1)]
    assert rows[0]["text_level"] == 2 and rows[0]["bbox"] == [1, 2, 3, 4]
    assert rows[2]["caption"] == ["one", "two"] and rows[2]["img_path"] == "i/a.png"
    assert rows[3]["footnote"] == ["n"] and rows[6]["sub_type"] == "algorithm"
    assert len(layout.layout_blocks(pages, furniture=True)) == 8
    for bad in ([], {}, [[]], [["x"]], None):
        with pytest.raises(layout.LayoutError):
            layout.layout_blocks(bad)
    assert layout.source_path({"url": " images/ "}) == "" and layout.source_path("a\\b.png") == "a\\b.png"


def test_layout_tree_and_frame(spark):
    tree = {
        "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/texts/9"}]},
        "groups": [{"children": [{"$ref": "#/tables/0"}, {"$ref": "#/texts/1"}]}],
        "texts": [{"label": "section_header", "level": 2, "text": "H", "prov": [{"page_no": 3}]}, {"label": "formula", "orig": "x"}, {"text": "cap"}],
        "tables": [{"captions": [{"$ref": "#/texts/2"}], "data": {"grid": [[{"text": "a"}]]}}],
    }
    rows = layout.tree_blocks(tree)
    assert [(r["type"], r.get("text"), r["page_idx"]) for r in rows] == [("text", "H", 2), ("table", None, 0), ("equation", "x", 0)]
    assert rows[1]["caption"] == ["cap"]
    frame = spark.createDataFrame([("t", json.dumps(tree)), ("bad", "{"), ("null", None)], "path string, json string")
    got = layout.read_layout(frame).collect()
    assert sorted((r.path, r.block_idx if r.block_idx is not None else -1, r.error is None) for r in got) == [("bad", -1, False), ("null", -1, False), ("t", 0, True), ("t", 1, True), ("t", 2, True)]
    assert layout.ocr_lines([[[0, 1], ("line", 0.9)], {"rec_texts": ["a", " "]}, "b"]) == ["line", "a", "b"]


def omml_of(body):
    return omml.omml_latex(ElementTree.fromstring(f'<m:oMath xmlns:m="{omml.MATH[1:-1]}" xmlns:w="{omml.WORD[1:-1]}">{body}</m:oMath>'))


def run(t):
    return f"<m:r><m:t>{t}</m:t></m:r>"


@pytest.mark.parametrize(
    ("body", "latex"),
    [
        (f"<m:f><m:num>{run('a')}</m:num><m:den>{run('b')}</m:den></m:f>", r"\frac{a}{b}"),
        (f"<m:sSubSup><m:e>{run('x')}</m:e><m:sub>{run('i')}</m:sub><m:sup>{run('2')}</m:sup></m:sSubSup>", "{x}_{i}^{2}"),
        (f"<m:rad><m:deg>{run('3')}</m:deg><m:e>{run('x')}</m:e></m:rad>", r"\sqrt[3]{x}"),
        (f"<m:rad><m:radPr><m:degHide/></m:radPr><m:deg>{run('3')}</m:deg><m:e>{run('x')}</m:e></m:rad>", r"\sqrt{x}"),
        (f'<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{run("i")}</m:sub><m:sup/><m:e>{run("x")}</m:e></m:nary>', r"\sum_{i} x"),
        (f"<m:nary><m:e>{run('x')}</m:e></m:nary>", r"\int x"),
        (f"<m:func><m:fName>{run('sin')}</m:fName><m:e>{run('x')}</m:e></m:func>", r"\sin{x}"),
        (f"<m:func><m:fName><m:limLow><m:e>{run('lim')}</m:e><m:lim>{run('n→∞')}</m:lim></m:limLow></m:fName><m:e>{run('x')}</m:e></m:func>", r"\lim_{n\to\infty }{x}"),
        (f"<m:func><m:fName>{run('f')}</m:fName><m:e><m:d><m:e>{run('x')}</m:e></m:d></m:e></m:func>", "f(x)"),
        (f'<m:d><m:dPr><m:begChr m:val="{{"/><m:endChr m:val=""/></m:dPr><m:e>{run("x")}</m:e><m:e>{run("y")}</m:e></m:d>', r"\{x,y"),
        (f"<m:m><m:mr><m:e>{run('a')}</m:e><m:e>{run('b')}</m:e></m:mr><m:mr><m:e>{run('c')}</m:e></m:mr></m:m>", r"\begin{matrix} a & b \\ c \end{matrix}"),
        (f"<m:eqArr><m:e>{run('a')}</m:e><m:e>{run('b')}</m:e></m:eqArr>", r"\begin{aligned} a \\ b \end{aligned}"),
        (f'<m:bar><m:barPr><m:pos m:val="bot"/></m:barPr><m:e>{run("x")}</m:e></m:bar>', r"\underline{x}"),
        (f'<m:acc><m:accPr><m:chr m:val="⃗"/></m:accPr><m:e>{run("x")}</m:e></m:acc>', r"\vec{x}"),
        (f'<m:groupChr><m:groupChrPr><m:chr m:val="⏟"/></m:groupChrPr><m:e>{run("x")}</m:e></m:groupChr>', r"\underbrace{x}"),
        (f"<m:phant><m:e>{run('x')}</m:e></m:phant>", r"\phantom{x}"),
        (f"<w:del>{run('x')}</w:del>{run('y')}", "y"),
        (run("a≤b"), r"a\leq b"),
        (run("a≤1"), r"a\leq1"),
        ("<m:f/>", r"\frac{}{}"),
    ],
)
def test_omml(body, latex):
    assert omml_of(body) == latex


def test_docx_equations(spark):
    xml = f'<w:document xmlns:m="{omml.MATH[1:-1]}" xmlns:w="{omml.WORD[1:-1]}"><w:p><m:oMathPara><m:oMath>{run("a")}</m:oMath></m:oMathPara><w:del><m:oMath>{run("b")}</m:oMath></w:del><m:oMath>{run("c")}</m:oMath></w:p></w:document>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", xml)
    frame = spark.createDataFrame([("d", bytearray(held.getvalue())), ("bad", bytearray(b"x"))], "path string, content binary")
    assert [(r.path, r.eq_idx, r.latex) for r in omml.read_equations(frame).orderBy("eq_idx").collect()] == [("d", 0, "a"), ("d", 1, "c")]
