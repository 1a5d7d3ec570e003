"""Queries of users, and HTML pages."""

import pandas as pd
from pyspark.sql import functions as F

from lectern.plans import ask
from lectern.sources.html import html_blocks, read_html


def keyed(spark, query, items, mode, options):
    row = spark.createDataFrame([(query, items, mode, options)], "q string, i array<map<string,string>>, m string, o map<string,string>")
    return row.select(ask.query_key(F.col("q"), F.col("i"), F.col("m"), F.col("o")).alias("k")).first().k


def test_query_keys(spark):
    base = keyed(spark, "what", [{"type": "image", "img_path": "/a/x.png", "sha256": "1"}], "mix", {"k": "1", "n": None})
    assert base.startswith("multimodal_query:")
    assert base == keyed(spark, " what ", [{"type": "image", "img_path": "/b/x.png", "sha256": "1"}], "mix", {"k": "1"})
    others = [
        keyed(spark, "what", [{"type": "image", "img_path": "/a/x.png", "sha256": "2"}], "mix", {"k": "1"}),
        keyed(spark, "what", [], "mix", {"k": "1"}),
        keyed(spark, "what", [{"type": "image", "sha256": "1"}], "naive", {"k": "1"}),
        keyed(spark, "what", [{"type": "image", "sha256": "1"}], "mix", {"k": "2"}),
    ]
    assert len({base, *others}) == 5


def test_image_paths(spark):
    prompt = 'x\nImage Path: /w/a b.png\nCaptions: y\n{"c": "Image Path: /w/c.JPG\\nmore"}\nimage path: /w/note.txt'
    row = spark.createDataFrame([(prompt,)], "p string")
    assert row.select(ask.image_paths(F.col("p")).alias("x")).first().x == ["/w/a b.png", "/w/c.JPG"]
    safe = row.select(*[ask.safe_path(F.lit(p), "/w", "/v/") for p in ("/w/a", "/v/a", "/wx/a", "/w/../a")]).first()
    assert list(safe) == [True, True, False, False]
    messages = ask.vision_messages(prompt, {"/w/a b.png": "QQ=="}, "why", "sys")
    assert [m["role"] for m in messages] == ["system", "user"]
    assert [p["type"] for p in messages[1]["content"]] == ["text", "image_url", "text"]
    assert isinstance(ask.vision_messages("none", {}, "why")[0]["content"], str)


def test_answers_and_cache(spark):
    queries = spark.createDataFrame([("a", "q1", "mix"), ("b", "q2", "bypass"), ("c", "q3", "mix")], "key string, query string, mode string")
    ranked = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("b", 1, 0.5)], "key string, chunk int, score double")
    chunks = spark.createDataFrame([(1, "first"), (2, "x" * 400)], "chunk int, content string")
    context = ask.contexts(ranked, chunks, "key", "chunk", 50)
    cache = spark.createDataFrame([("c", "known")], "key string, answer string")
    out, kept = ask.answer(queries, context, cache, lambda p: pd.Series([x.replace("\n\n", "+") for x in p]))
    assert {(r.key, r.answer, r.cached) for r in out.collect()} == {("a", "first+q1", False), ("b", "q2", False), ("c", "known", True)}
    assert kept.count() == 3


def test_enhanced(spark):
    row = spark.range(1).select(ask.enhanced(F.lit("q"), F.array(F.lit("a"), F.lit("b"))).alias("x"), ask.enhanced(F.lit("q"), F.array().cast("array<string>")).alias("y")).first()
    assert row.x.splitlines()[0] == "q" and row.x.splitlines()[-1] == "- b" and row.y == "q"


def test_html(spark):
    page = '<html><head><title>t</title></head><body><h2>A &amp; b</h2><p>one <b>two</b><br>three<script>x<y</script><img src="i.png" alt=" c "><table><tr><td>1</td><th>2 </th></tr><tr></tr></table>end'
    assert html_blocks(page) == [
        {"type": "text", "text": "A & b", "text_level": 2},
        {"type": "text", "text": "one two"},
        {"type": "text", "text": "three"},
        {"type": "image", "img_path": "i.png", "caption": ["c"]},
        {"type": "table", "body": '[["1", "2"]]'},
        {"type": "text", "text": "end"},
    ]
    assert html_blocks(None) == [] and html_blocks("<td>x</td>") == [{"type": "text", "text": "x"}]
    got = read_html(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"))
    assert got.count() == 6 and got.filter("text_level = 2").count() == 1


def test_image_paths_end_where_they_should(spark):
    """Delimiters, several labels, line breaks; long blanks cost no more than their length."""
    import time

    cases = {
        "Image Path: /a.png is shown": ["/a.png"],
        "Image Path: /x\nand y.png": [],
        "Image Path: /a.svg Image Path: /b.png": ["/b.png"],
        "image path: /a.png.backup\nIMAGE PATH: /c d.JPG.": ["/c d.JPG"],
        '{"t": "Image Path: /e.webp\\nCaptions: x"}': ["/e.webp"],
        "no label /a.png": [],
        "Image Path:" + " " * 20_000 + "x.pngx": [],
    }
    began = time.time()
    for prompt, want in cases.items():
        assert [prompt[a:b] for a, b in ask.picture_places(prompt)] == want
    assert time.time() - began < 1
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(cases)], "k int, p string")
    got = {r.k: r.x for r in rows.select("k", ask.image_paths(F.col("p")).alias("x")).collect()}
    assert got == dict(enumerate(cases.values()))
