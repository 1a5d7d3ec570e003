"""Column functions, answers, resilience, items, ingest, streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import answers, resilience
from lectern.functions import columns as C
from lectern.operators import blocks, evaluation, graph, intervals, items, stores
from lectern.plans.ingest import ingest
from lectern.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tables_and_captions(spark):
    rows = F.array(F.array(F.lit("a|b"), F.lit(None).cast("string")), F.array(F.lit("x\r\ny")))
    assert one(spark, C.pipe_table(rows)) == "| a\\|b |  |\n| --- | --- |\n| x y |  |"
    assert one(spark, C.pipe_table(F.array().cast("array<array<string>>"))) == ""
    assert one(spark, C.captions(F.array(F.lit(" a "), F.lit(" "), F.lit(None).cast("string")))) == ["a"]
    assert one(spark, C.captions(F.lit(None).cast("array<string>"))) == []


def test_equations(spark):
    n = F.lit(None).cast("string")
    assert one(spark, C.equation_text(F.lit(" "), F.lit(" t "), F.lit("e"))) == "t"
    assert one(spark, C.equation_text(n, n, n)) == ""
    assert one(spark, C.equation_format(F.lit("x"), n)) == "latex"
    assert one(spark, C.equation_description(F.lit("x"), F.lit("what"))) == "what"
    assert one(spark, C.equation_description(F.lit("x"), F.lit(" x"))) == ""


@pytest.mark.parametrize(
    ("left", "right", "joined"), [("a", "b", "a b"), ("中", "文", "中文"), ("a", "文", "a文"), ("a", ",", "a,"), ("(", "b", "(b"), ("a ", "b", "a b"), ("", "b", "b")]
)
def test_spans(spark, left, right, joined):
    assert one(spark, C.join_spans(F.array(F.lit(left), F.lit(right)))) == joined


def test_paths(spark):
    assert one(spark, C.public_url(F.lit("/r/a b/ü.png"), "/r", "http://h/")) == "http://h/a%20b/%C3%BC.png"
    assert one(spark, C.public_url(F.lit("/other/x"), "/r", "http://h")) is None
    assert one(spark, C.suffix(F.lit("/a/.hidden"))) == ""
    assert one(spark, C.route(F.lit("x.DOCX"))) == "office"
    assert one(spark, C.output_dir(F.lit("/a/b.c.pdf"))).startswith("b.c_")
    assert one(spark, C.image_mime(F.unhex(F.lit("52494646000000005745425000000000")))) == "image/webp"
    assert one(spark, C.image_mime(F.unhex(F.lit("424D" + "00" * 12 + "28000000")))) == "image/bmp"
    assert one(spark, C.image_mime(F.unhex(F.lit("424D" + "00" * 16)))) is None


def test_answers():
    good = '{"detailed_description": "d", "entity_info": {"entity_name": "N", "entity_type": "t", "summary": "s"}}'
    assert answers.describe_entity(f"<think>{{}}</think>```json\n{good}\n```", "image", "b") == ("d", "N (t)", "t", "s")
    assert answers.describe_entity(good, "image", "b", "Own")[1] == "Own"
    assert answers.parse_object('x {"a": 1,} y') == {"a": 1}
    assert answers.parse_object(r'{"a": "\alpha"}') == {"a": r"\alpha"}
    assert answers.parse_object('{} {"b": 2}') == {"b": 2}
    assert answers.parse_object('"detailed_description": "x" cut {')["detailed_description"] == "x"
    text, name, kind, summary = answers.describe_entity("plain words", "table", "body")
    assert (text, kind, summary) == ("plain words", "table", "plain words") and name.startswith("table_")
    assert answers.describe_entity(None, "table", "body")[0] == "body"


def test_scores(spark):
    got = [one(spark, answers.evaluation_score(F.lit(x))) for x in ('{"accuracy": 1}', "accuracy: 0", "incorrect", "no idea")]
    assert got == [1, 0, 1, 0]
    assert one(spark, answers.balance_json(F.lit('```json\n{"a": {"b": 1}\n```'))) == '{"a": {"b": 1}}'


def test_retry():
    waits, calls = [], []

    @resilience.retry(3, (ValueError,), waits.append, jitter=False, base=1, most=1.5)
    def f():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError

        return "ok"

    assert f() == "ok" and waits == [1, 1.5]
    with pytest.raises(ValueError):
        resilience.retry(1, sleep=waits.append)(lambda: int("x"))()


def test_breaker(spark):
    now = [0.0]
    b = resilience.Breaker(2, 10, lambda: now[0])
    early = b.enter()
    for _ in range(2):
        b.leave(b.enter(), False)
    assert b.state == "open"
    with pytest.raises(resilience.CircuitOpen):
        b.enter()
    b.leave(early, True)
    assert b.state == "open"  # a result from before counts for nothing
    now[0] = 10
    turn = b.enter()
    with pytest.raises(resilience.CircuitOpen):
        b.enter()  # one call may try
    b.leave(turn, True)
    assert b.state == "closed"
    log = spark.createDataFrame([("a", float(t), ok) for t, ok in [(0, False), (1, False), (2, True), (12, True)]], "k string, t double, ok boolean")
    assert [r.state for r in resilience.breaker_states(log, "k", 2, 10.0).orderBy("t").collect()] == ["closed", "open", "open", "closed"]


def test_packing_and_windows(spark):
    assert one(spark, intervals.pack_in_order(F.array(*map(F.lit, [50, 50, 1, 200, 5])), 100)) == [0, 0, 1, 2, 3]
    assert one(spark, intervals.pack_in_order(F.array(*map(F.lit, [1, 1, 1])), 100, 2)) == [0, 0, 1]
    assert one(spark, intervals.pack_in_order(F.array().cast("array<int>"), 100)) == []
    segs = spark.createDataFrame([("v", 0, 0.0, 2.0, "first"), ("v", 1, 1.0, 3.0, "second"), ("v", 2, 2.0, 6.0, "third"), ("v", 3, 9.0, 9.5, "late")], "k string, seg_idx int, s_start double, s_end double, text string")
    scenes = spark.createDataFrame([("v", 0, 5.0, 10.0, "picture")], "k string, scene_idx int, start double, end double, visual string")
    out = items.video_windows(scenes, segs, "k", 100, 5, 3).orderBy("scene_idx").collect()
    assert [(r.start, r.end, r.visual, r.speech) for r in out] == [(0.0, 3.0, "", "first second"), (5.0, 10.0, "picture", "third late")]
    audio = items.audio_windows(segs, "k", 2).orderBy("window").collect()
    assert [r.text for r in audio] == ["[0:00-0:02] first\n[0:01-0:03] second", "[0:02-0:06] third\n[0:09-0:09] late"]


def test_stores(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(stores.upsert(old, new, ["k"]).collect()) == sorted([(1, "a"), (2, None), (3, "c")], key=str) or {tuple(r) for r in stores.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, None), (3, "c")}
    assert {tuple(r) for r in stores.merge_fields(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in stores.insert_absent(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_expand(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, tgt string")
    got = {r.entity: r.hop for r in graph.expand(spark.createDataFrame([("a",)], "entity string"), edges, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_append_missing(spark):
    have = spark.createDataFrame([("d", 0, "text", "t", 4), ("d", 1, "equation", "x", 5)], "doc_id string, block_idx int, type string, text string, page_idx int")
    found = spark.createDataFrame([("d", "x"), ("d", "y"), ("d", "y")], "doc_id string, text string")
    assert [tuple(r) for r in blocks.append_missing(have, found).filter("block_idx > 1").collect()] == [("d", 2, "equation", "y", 5)]


CONTENT = "doc_id string, block_idx int, type string, text string, text_level int, page_idx int, caption array<string>, footnote array<string>, body string, text_format string"


def test_ingest(spark):
    rows = [
        ("d", 0, "text", "Alpha Heading", 1, 0, None, None, None, None),
        ("d", 1, None, "Gamma said words of Delta here", None, 0, None, None, None, None),
        ("d", 2, "table", None, None, 1, ["Table One"], None, "| a |", None),
        ("d", 3, "text", "  ", None, 1, None, None, None, None),
        ("e", 0, "image", None, None, 0, None, None, None, None),
    ]
    out = ingest(spark.createDataFrame(rows, CONTENT))
    text = out.text_chunks.collect()
    assert [(r.full_doc_id, r.content, r.page_idx) for r in text] == [("d", "Alpha Heading\n\nGamma said words of Delta here", 0)]
    found = {r.doc_id: r for r in out.item_chunks.collect()}
    assert found["d"].chunk_order_index == 1 and found["e"].chunk_order_index == 0
    assert "[Page 0] # Alpha Heading" in found["d"].prompt
    assert {(r.doc_id, r.chunks_count, r.status) for r in out.status.collect()} == {("d", 2, "processed"), ("e", 1, "processed")}
    assert out.edges.filter("weight >= 10").count() >= 1
    assert out.entities.filter("entity = 'Delta'").count() == 1


def test_failed_model_keeps_items(spark):
    def broken(prompts: pd.Series) -> pd.Series:
        raise RuntimeError

    rows = [("d", 0, "table", None, None, 0, None, None, "| a |", None)]
    got = ingest(spark.createDataFrame(rows, CONTENT), model=broken).item_chunks.first()
    assert got.description == "| a |" and got.entity_name.startswith("table_")


def test_prompts_by_language():
    assert items.template("image", "zh-CN") != items.template("image", "en")
    assert items.template("equation", "zh") == items.template("equation")


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = events.event_windows(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    query.processAllAvailable()
    query.stop()
    same = lambda df: {tuple(r) for r in df.collect()}
    assert same(spark.table("hours")) == same(events.event_windows(batch, "1 hour"))

    def merge(rows, number):
        rows.dropDuplicates(["event_id"]).write.mode("overwrite").parquet(str(tmp_path / f"out/{number}"))

    for _ in range(2):
        events.ingest(events.first_seen(stream, "event_id", "ts"), merge, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/*")).count() == batch.count()


def test_status_and_sessions(spark):
    moves = spark.createDataFrame([("a", "ready", 1), ("a", "processed", 2), ("b", "failed", 1), ("b", "processed", 2), ("c", "handling", 1), ("c", "ready", 2)], "k string, s string, t int")
    assert {tuple(r) for r in events.advance_status(moves, "k", "s", "t").collect()} == {("a", "processed"), ("b", "failed"), ("c", "handling")}
    assert events.sessions(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "10 minutes").agg(F.sum("n")).first()[0] == 1000


def test_evaluation(spark, tmp_path):
    answer = "struct<success:boolean,result:string,error:string>"
    given = spark.createDataFrame([("d", "q" * 120, "e", (True, "r", None), (False, None, "bad"))], f"doc_id string, question string, expected_answer string, mix {answer}, naive {answer}")
    rows = evaluation.to_rows(given, ["mix", "naive"])
    assert [r.method for r in rows.collect()] == ["mix"]
    done = evaluation.judged(rows.withColumn("answer", F.lit('```json\n{"accuracy": 1\n```'))).select("doc_id", "question", "method", "expected_answer", "result", "accuracy", "success")
    assert done.first().accuracy == 1 and evaluation.pending(rows, done).count() == 0
    assert evaluation.pending(rows, done.limit(0)).count() == 1
    assert evaluation.record(done, done.withColumn("accuracy", F.lit(0))).first().accuracy == 0
    evaluation.save(done, str(tmp_path))
    assert spark.read.json(str(tmp_path / "detail")).first().question == "q" * 120
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).first().question == "q" * 100 + "..."


def test_objects_in_answers():
    """The least lenient reading wins, a fenced object before others, an inner one only if its outer fails."""
    read = answers.parse_object
    assert read('{"a": 1} then ```json\n{"b": {"c": [1, 2.5, true, null]}}\n```') == {"b": {"c": [1, 2.5, True, None]}}
    assert read('{"x": 1,} and {"y": "s"}') == {"y": "s"}
    assert read('{"outer": {"inner": 1},}') == {"outer": {"inner": 1}}
    assert read('{bad {"inner": "\\u00e9\\n"}') == {"inner": "\u00e9\n"}
    assert read('<think>{"no": 1}</think>{"yes": "} {"}') == {"yes": "} {"}
    assert read("{" * 3000)["entity_info"]["entity_type"] == "unknown"


def test_markup_ends_no_attribute(spark):
    row = spark.createDataFrame([('[a](u"x) **b** ~~c~~ `d` *e* **open\n__f__',)], "t string")
    want = '<a href="u&quot;x">a</a> <b>b</b> <s>c</s> <code>d</code> <i>e</i> **open\n<b>f</b>'
    assert row.select(C.inline_markup(F.col("t")).alias("m")).first().m == want


def test_long_images_are_encoded_in_one_line(spark):
    import base64

    content = b"GIF89a" + bytes(range(256))
    row = spark.createDataFrame([(bytearray(content),)], "c binary").select(C.encode_image(F.col("c")).alias("x")).first()
    assert row.x == base64.b64encode(content).decode()


def test_long_intervals_make_few_bucket_rows_and_are_not_broadcast(spark):
    scene = [(u, i, 977.0 * i, 977.0 * i + 40.0 * (i % 90)) for u in range(3) for i in range(40)]
    seg = [(u, i, 613.0 * i, 613.0 * i + 55.0 * (i % 77), f"t{i}") for u in range(3) for i in range(60)]
    x = spark.createDataFrame(scene, "k long, scene_idx long, start double, end double")
    y = spark.createDataFrame(seg, "k long, seg_idx long, s_start double, s_end double, text string")
    want = {(u, i): " ".join(t for v, _, c, d, t in seg if u == v and a < d and c < b) for u, i, a, b in scene}
    found = intervals.texts_in_range(x, y, "k")
    assert {(r.k, r.scene_idx): r.transcript for r in found.collect()} == {k: t for k, t in want.items() if t}
    # Spark would broadcast what it takes for a few rows, however many buckets they fill.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    alone = {(u, j) for u, j, c, d, _ in seg if not any(u == v and a < d and c < b for v, _, a, b in scene)}
    assert {(r.k, r.seg_idx) for r in intervals.outside(y, x, "k").collect()} == alone
    week = spark.createDataFrame([(1, 1, 0.0, 7e5), (1, 2, 10.0, 6e5)], "k long, i long, s double, e double")
    pairs = intervals.overlap_join(week, week.toDF("k", "j", "c", "d"), "k", ("s", "e"), ("c", "d"))
    assert pairs.count() == 4
