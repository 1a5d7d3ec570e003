"""Operators that compare rows with each other, and the pipeline."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import lines, links, neardup, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item string, size int, body string, bucket int, id int, mark int, spans int, gone int, __gone int, __spans int, line int"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "clash", 1, "clash", 2, 3, 4, 5, 6, 7, 8, 9) for k, t in texts], DOCS)


def word_texts(seed=0, families=12):
    """Random texts with copies, near copies of all degrees, and odd ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  Two")]
    key = 10
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((key, " ".join(copy)))
            key += 1
    return out


@pytest.mark.parametrize(("size", "least"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, least):
    texts = word_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, texts), size=size, least=least).collect()}
    assert got == brute.near_components(dict(texts), size, least)


def test_near_duplicates_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = neardup.op4_minhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_components(texts, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_one_large_group(spark, monkeypatch):
    """A chain of near copies whose ends are far apart, in blocks smaller than it."""
    monkeypatch.setattr(links, "BLOCK", 8)
    rng = random.Random(4)
    now, texts = [f"w{rng.randrange(500)}" for _ in range(80)], []
    for k in range(60):
        now = list(now)
        now[rng.randrange(80)] = f"x{k}"
        texts.append((k, " ".join(now)))
    rng.shuffle(texts)
    texts = [(k, t) for k, (_, t) in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, texts), size=3, least=85).collect()}
    assert got == brute.near_components(dict(texts), 3, 85)


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert neardup.near_duplicates(none).count() == 0
    assert lines.duplicate_lines(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert suffixes.repeated_spans(none).count() == 0
    assert suffixes.remove_repeated(none).count() == 0


def test_repeated_rows(spark):
    twice = frame(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "z" * 500)] * 2)
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(twice).collect()} == {(1, 1), (2, 2)}
    assert {r.doc_id: r.text for r in lines.dedup_lines(twice).collect()} == {1: "a b c d e f g", 2: "z" * 500}
    assert {(r.doc_id, str(r.spans)) for r in suffixes.repeated_spans(twice).collect()} == {(1, "None"), (2, "[[0, 500]]")}


def test_estimate():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**32, (200, 120), dtype=np.uint64).astype(np.uint32)
        b = np.where(rng.random((200, 120)) < share, a, rng.integers(0, 2**32, (200, 120), dtype=np.uint64).astype(np.uint32))
        pack = lambda m: [int.from_bytes(neardup.pack_low_bits(x), "little") for x in m]
        assert abs(np.mean([neardup.estimate(x, y, 120) for x, y in zip(pack(a), pack(b), strict=True)]) - share) < 0.02


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(400, k) for k in range(401, 460)]
    got = {r.item: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.roots({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)


def line_texts(seed=0):
    rng = random.Random(seed)
    make = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 14)))
    known = [make() for _ in range(25)]
    out = [(1, None), (2, ""), (3, "\n \n"), (4, "x\nx\n\nX\n x \t\ny")]
    for key in range(10, 60):
        rows = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(known) if rng.random() < 0.4 else make()
            if rng.random() < 0.3:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            rows.append(rng.choice(["", " "]) + line)
        out.append((key, "\n".join(rows)))
    return out


def test_lines(spark):
    texts = line_texts()
    want = brute.line_fates(dict(texts), 8, 80)
    got = {(r.doc_id, r.line): (r.kept_id, r.kept_line) for r in lines.duplicate_lines(frame(spark, texts)).collect()}
    gone = {k: v for k, v in want.items() if k != v}
    assert set(got) <= set(gone) and len(got) >= 0.99 * len(gone)
    left = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, texts)).collect()}
    for key, text in texts:
        assert left[key] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (key, k) not in got))
    assert lines.dedup_lines(frame(spark, texts)).columns == frame(spark, texts).columns


def test_line_query_recall(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    gone = {k for k, v in brute.line_fates(texts, 8, 80).items() if k != v}
    got = {(r.doc_id, int(k)) for r in lines.op3_line_dedup(spark, sf_dir).collect() for k in r.lines.split(",")}
    assert got <= gone and len(got) >= 0.99 * len(gone)


def edge_texts(pairs=6000, seed=5):
    """Pairs of lines whose similarity is 0.8 exactly: 40 of 50 shingles."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for _ in range(pairs):
        base = make(47)
        rows += [base + make(5), base + make(5)]
    rng.shuffle(rows)
    return [(k, "\n".join(rows[k * 60 : k * 60 + 60])) for k in range(len(rows) // 60)]


def test_no_link_of_lines_is_lost(spark):
    texts = edge_texts()
    gone = {k: v for k, v in brute.line_fates(dict(texts), 8, 80).items() if k != v}
    got = {(r.doc_id, r.line): (r.kept_id, r.kept_line) for r in lines.duplicate_lines(frame(spark, texts)).collect()}
    assert len(gone) > 5900 and got == gone


def test_lines_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df, texts in ((docs, {r.doc_id: r.text for r in docs.collect()}), (frame(spark, line_texts()), dict(line_texts()))):
        gone = {k: v for k, v in brute.line_fates(texts, 8, 80).items() if k != v}
        assert {(r.doc_id, r.line): (r.kept_id, r.kept_line) for r in lines.duplicate_lines(df).collect()} == gone


def test_line_query_names_the_classes(spark, tmp_path):
    texts = line_texts()
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute.line_fates(dict(texts), 8, 80)
    rows = lines.op3_line_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, k.line): (k.kept_id, k.kept_line) for r in rows for k in r.kept} == {k: v for k, v in want.items() if k != v}
    assert all(r.lines == ",".join(str(k.line) for k in r.kept) and r.n_removed == len(r.kept) for r in rows)
    of = set(v for k, v in want.items() if k != v)
    got = {(r.doc_id, r.line): (r.kept_id, r.kept_line) for r in lines.op3_line_classes(spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if v in of}


def repeated_texts(seed=0):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abé") for _ in range(n))
    passage, other = noise(60), noise(45)
    out = [(1, None), (2, ""), (3, "ab" * 40), (4, "a" * 100), (5, passage), (6, passage[:30]), (7, "c" * 19 + "d" + "c" * 19)]
    for key in range(10, 40):
        parts = [noise(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            whole = rng.choice([passage, other])
            a = rng.randrange(len(whole))
            parts += [whole[a : a + rng.randint(1, 60)], noise(rng.randint(0, 30))]
        out.append((key, "".join(parts)))
    return [*out, (50, out[-1][1]), (51, out[-1][1])]


def spans_of(flags):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(flags, np.uint8).astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


@pytest.mark.parametrize(("length", "most"), [(20, 10**6), (20, 1), (9, 10**6)])
def test_suffixes(spark, monkeypatch, length, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    monkeypatch.setattr(suffixes, "ROWS", 16)
    texts = repeated_texts()
    want = brute.repeated_cover(dict(texts), length)
    got = {r.doc_id: r.spans or [] for r in suffixes.repeated_spans(frame(spark, texts), length=length).collect()}
    assert got == {k: spans_of(f) for k, f in want.items()}
    left = {r.doc_id: r.text for r in suffixes.remove_repeated(frame(spark, texts), length=length).collect()}
    assert left[1] is None and left[2] == "" and all("�" not in t for t in left.values() if t)
    for key, text in texts:
        if text and not any(want[key]):
            assert left[key] == text


def test_two_lengths_at_once(spark):
    texts = repeated_texts(3)
    want = {n: brute.repeated_cover(dict(texts), n) for n in (20, 12)}
    for r in suffixes.repeated_spans(frame(spark, texts), length=20, passage=12).collect():
        assert (r.spans or [], r.passages or []) == (spans_of(want[20][r.doc_id]), spans_of(want[12][r.doc_id]))


@pytest.mark.parametrize("most", [1, 24, 10**6])
def test_large_groups_lose_no_partner(spark, monkeypatch, most):
    """One short passage in every text; each longer string in two of them, far apart."""
    monkeypatch.setattr(suffixes, "MOST", most)
    monkeypatch.setattr(suffixes, "ROWS", 16)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, tails = noise(14), [noise(9) for _ in range(60)]
    texts = [(k, noise(rng.randint(8, 15)) + core + tails[k % 60] + noise(rng.randint(8, 15))) for k in range(120)]
    want = {n: brute.repeated_cover(dict(texts), n) for n in (20, 12)}
    assert sum(map(any, want[20].values())) == 120
    for r in suffixes.repeated_spans(frame(spark, texts), length=20, passage=12).collect():
        assert (r.spans or [], r.passages or []) == (spans_of(want[20][r.doc_id]), spans_of(want[12][r.doc_id]))


def test_periodic_texts(spark):
    """One row of anchors stands for the equal places of a periodic text."""
    texts = [(1, "a" * 5000), (2, "ab" * 900), (3, "x" + "abc" * 300), (4, "y" * 19)]
    want = brute.repeated_cover(dict(texts), 20)
    got = {r.doc_id: r.spans or [] for r in suffixes.repeated_spans(frame(spark, texts), length=20).collect()}
    assert got == {k: spans_of(f) for k, f in want.items()}
    marked = suffixes._marked(frame(spark, texts[:1]), "doc_id", "text").select("id", "mark", "body")
    assert suffixes._find_anchors(marked, (20,)).count() < 60


def test_suffix_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want, passages = brute.repeated_cover(texts, 400), brute.repeated_cover(texts, suffixes.PASSAGE)
    for r in suffixes.op2_suffix_dedup(spark, sf_dir).collect():
        body, flags = (texts[r.doc_id] or "").encode(), want[r.doc_id]
        kept = bytes(np.frombuffer(body, np.uint8)[np.frombuffer(flags, np.uint8) == 0])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(body), sum(flags), len(spans_of(flags)), hashlib.sha256(kept).hexdigest())
        assert r.n_passage_bytes == sum(passages[r.doc_id])


def test_suffix_sort_and_collisions():
    rng = np.random.default_rng(1)
    for trial in range(30):
        n, depth = int(rng.integers(1, 40)), 12
        rows = rng.integers(97, 99, (n, depth)).astype(np.uint8)
        sizes = rng.integers(0, depth + 1, n)
        rows[np.arange(depth)[None, :] >= sizes[:, None]] = 0
        group = np.sort(rng.integers(0, 4, n))
        if trial % 3 == 0 and n > 1:
            rows[1:] = rows[0]
            sizes[1:] = sizes[0]
        order, shared = suffixes.suffix_sort(group, rows, sizes)
        keys = [(group[i], rows[i, : sizes[i]].tobytes()) for i in order]
        assert keys == sorted(keys)
        for k in range(1, n):
            (g, x), (h, y) = keys[k - 1], keys[k]
            common = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert shared[k] == (common if g == h else 0)


def test_colliding_hashes_are_found_out(monkeypatch):
    """With a hash that never tells strings apart, bytes decide."""
    monkeypatch.setattr(suffixes, "powers", lambda n: (np.zeros(4096, np.uint64), np.zeros(4096, np.uint64)))
    rows = np.frombuffer(b"zyabxyab", np.uint8).reshape(4, 2)
    order, shared = suffixes.suffix_sort(np.zeros(4, int), rows, np.full(4, 2))
    assert [rows[i].tobytes() for i in order] == [b"ab", b"ab", b"xy", b"zy"] and shared.tolist() == [0, 2, 0, 0]


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert sorted(out.columns) == sorted(names)
            after = {r.doc_id: r.text for r in out.collect()}
            assert set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before)
        if name == "minhash_near_dedup":
            want = brute.near_components(before, 5, 80)
            assert set(after) == {k for k, (n, c) in want.items() if n == 0 or c == k}
        if name == "suffix_dedup":
            cover = brute.repeated_cover(before, corpus_pipeline.REPEATED)
            assert all(after[k] == t for k, t in before.items() if not any(cover[k]))
            assert all(len((after[k] or "").encode()) <= len((t or "").encode()) - sum(cover[k]) for k, t in before.items())
        docs = out
    assert docs.select("doc_id").distinct().count() == len(before)
    assert docs.filter(F.col("length") * 4 != F.octet_length("ids")).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """Each row is judged by its own text."""
    words = [f"w{i}" for i in range(100)]
    texts = [(1, "some other text that stands alone"), (1, " ".join(words[:99])), (2, " ".join(words))]
    for order in (texts, texts[::-1]):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, order), size=3, least=85).collect())
        assert got == [(1, 4, 1), (1, 97, 1), (2, 98, 1)]
    rows = [(1, "a line of its own here\nunique second line"), (1, "another first line, quite different\nshared line of two documents"), (2, "shared line of two documents\nthe end")]
    left = sorted(r.text for r in lines.dedup_lines(frame(spark, rows)).collect())
    assert left == sorted([rows[0][1], rows[1][1], "the end"])


def test_log_of_equal_lines(spark):
    text = "\n".join(["the same line again and again"] * 30_000)
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, [(1, text), (2, text)])).collect()}
    assert got == {1: "the same line again and again", 2: ""}


def test_similar_lines_counts_exactly():
    rng = random.Random(6)
    pool = ["".join(rng.choice("ab é日") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    pool += [x[:-1] + "z" for x in pool]
    left, right = (list(x) for x in zip(*[(a, b) for a in pool for b in pool], strict=True))
    sets = [lines.line_shingles(x) for x in pool]
    want = [100 * len(a & b) >= 80 * len(a | b) for a in sets for b in sets]
    assert lines.similar_lines(left, right).tolist() == want


def test_estimates_agree(spark):
    """The column's estimate is the function's."""
    rng = np.random.default_rng(1)
    for count in (54, 120):
        m = rng.integers(0, 4, (20, count), dtype=np.uint64).astype(np.uint32)
        words = links.pack_planes(m).tolist()
        df = spark.createDataFrame([(words[i], words[i + 1]) for i in range(0, 20, 2)], "a array<bigint>, b array<bigint>")
        got = [r[0] for r in df.select(links.estimated(F.col("a"), F.col("b"), count)).collect()]
        number = [int.from_bytes(links.pack_low_bits(x), "little") for x in m]
        assert np.allclose(got, [links.estimate(number[i], number[i + 1], count) for i in range(0, 20, 2)])


def test_no_link_is_lost_between_parts():
    """Lines on either side stand in parts of unequal numbers of lines."""
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    left = [make(2000) for _ in range(200)] + [make(60) for _ in range(1000)]
    right = [x[:-1] + "#" for x in left]
    assert lines.similar_lines(left, right).all()
    assert not lines.similar_lines(left[:-1], right[1:]).any()


def test_lines_of_bytes_build_no_string_sets(monkeypatch):
    """Shingles are compared as integers, which cost a small part of sets of strings."""
    monkeypatch.setattr(lines, "line_shingles", None)
    base = "a line of plain words, long enough to have many shingles, naïve or not"
    assert lines.similar_lines([base, base, "кириллица: " + base], [base + "!", base[::-1], "кириллица: " + base + "!"]).tolist() == [True, False, True]


def test_chain_of_lines_in_large_buckets(spark, monkeypatch):
    """Neighbours of a chain link, others do not; buckets hold many of them."""
    rng = random.Random(8)
    now, rows = [rng.choice("abcdefghijklmnop") for _ in range(110)], []
    for _ in range(150):
        now[rng.randrange(110)] = rng.choice("qrstuvwxyz")
        rows.append("".join(now))
    rng.shuffle(rows)
    texts = [(k, "\n".join(rows[k * 10 : k * 10 + 10])) for k in range(15)]
    gone = {k: v for k, v in brute.line_fates(dict(texts), 8, 80).items() if k != v}
    for block in (512, 20):
        monkeypatch.setattr(links, "BLOCK", block)
        got = {(r.doc_id, r.line): (r.kept_id, r.kept_line) for r in lines.duplicate_lines(frame(spark, texts)).collect()}
        assert len(gone) > 50 and got == gone
