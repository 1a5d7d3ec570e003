"""Operators that judge or turn rows one by one, and sharding."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid, media, packing, pieces, quality, sharding, urls
from lectern.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality string, item string"
SAMPLE = [
    (1, None, None, None, None, "q", "i"),
    (2, "", "en", "s", 0, None, None),
    (3, " \n\t ", "en", "s", 4, None, None),
    (4, "the cat and the dog of it. " * 12, "en", "s", 1, None, None),
    (4, "the cat and the dog of it. " * 12, "en", "s", 1, None, None),
    (5, "Ein Haus und der Baum. " + "wort " * 30_000, "de", "s", 1, None, None),
    (6, "ünï\x1ccode 日本 😀 ▁x  y", "fr", None, 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(SAMPLE, DOCS).cache()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def counts(text):
    body = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", body)
    lines = [x for x in body.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    often = Counter(wins)
    covered = {k for i, w in enumerate(wins) if often[w] > 1 for k in range(i, i + 8)}
    n_rep = len(covered)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in body), len(lines) - len(set(lines)), n_rep, len(ws) < 20 or 100 * n_rep > 30 * len(ws)


def test_quality_counts(docs):
    got = quality.score_quality(docs, "text").collect()
    assert len(got) == len(SAMPLE)
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, r.base_failed) == counts(r.text)
        assert not (r.kept and r.base_failed)
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.filter("quality = 'q'").count() == 0
    assert quality.filter_quality(docs.limit(0)).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = " ".join(f"the word{i} of a line{i}" for i in range(30))
    rows = [(0, clean), (1, " | ".join(f"word{i}" for i in range(40))), (2, " ".join(f"W{i}!! A{i}" for i in range(30))), (3, "the same words again and again here now " * 9)]
    got = {r.doc_id: r.kept for r in quality.score_quality(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}


def test_quality_stays_native(docs):
    plan = quality.score_quality(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda f: sorted(tuple(map(str, r)) for r in f[names].fillna("").itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_minimax():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = [(i, int(s)) for i, s in enumerate(rng.integers(1, 50, rng.integers(1, 12)))]
        k = int(rng.integers(1, 5))
        n = len(sizes)
        best = {(0, 0): 0}
        for parts in range(1, k + 1):
            for end in range(1, n + 1):
                options = [max(best[parts - 1, cut], sum(s for _, s in sizes[cut:end])) for cut in range(end) if (parts - 1, cut) in best]
                if options:
                    best[parts, end] = min(options)
        want = min(v for (parts, end), v in best.items() if end == n)
        got, cuts = sharding.minimax_cuts(sizes, k)
        assert got == want and len(cuts) <= k
    assert sharding.minimax_cuts([], 4) == (0, [])


def test_shards(spark, sf_dir, texts):
    rows = sharding.op10_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 16, zlib.crc32(body), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of[body].add(r.shard)
    assert set(load) <= set(range(40)) and all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for t in texts.values():
        sizes[int(hashlib.md5((t or "").encode()).hexdigest()[:8], 16) >> (32 - sharding.UNIT_BITS)] += len((t or "").encode()) + 16
    assert max(load.values()) == sharding.minimax_cuts(sorted(sizes.items()), 40)[0]


def test_shards_with_a_group_of_a_third(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "copy" * 30 if k % 3 == 0 else rng.bytes(58).hex()) for k in range(6000)]
    load, copies = Counter(), set()
    for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=40).collect():
        load[r.shard] += r.size
        copies |= {r.shard} if r.doc_id % 3 == 0 else set()
    assert sorted(load) == list(range(40)) and len(copies) == 1
    others = [n for s, n in load.items() if s not in copies]
    assert max(others) < 1.1 * sum(others) / 39


def test_balanced_cuts():
    sizes = [(0, 5), (1, 40), (2, 5), (3, 12), (4, 3), (5, 3)]
    assert sharding.balanced_cuts(sizes, 4) == ([0, 4], [1, 3])
    assert sharding.balanced_cuts(sizes, 1) == ([0], []) and sharding.balanced_cuts([], 3) == ([], [])
    assert sharding.balanced_cuts([(7, 9)], 3) == ([], [7])


def test_shards_of_odd_rows(docs):
    got = sharding.assign_shards(docs, shards=3).collect()
    assert len(got) == len(SAMPLE) and sharding.assign_shards(docs.limit(0)).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_urls(spark):
    pages = [
        (1, "HTTP://A.Example.ORG/es/x?y#z"),
        (2, "http://x.com/fr/1"),
        (3, "http://x.com/de/"),
        (4, "http://example.org/en/17"),
        (5, "http://org"),
        (6, None),
        (7, "no scheme"),
        (8, "http://notorg/a"),
        (9, "http://x.net/?a=://b"),
        (9, "http://x.net/?a=://b"),
        (10, "http://bad.co.uk:80/p;q?x"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(9, 1), (10, 1), (10, 1), (2, 0), (99, 1), (None, 1), (1, None)], "doc_id long, bad int")
    got = sorted(urls.filter_urls(frame, labels).select("page_id", "host", "path", "rule", "verdict").collect())
    assert len(got) == len(pages)
    by = {r.page_id: (r.host, r.path, r.rule) for r in got}
    assert by[1] == ("a.example.org", "/es/x", "example.org/es/")
    assert by[2][2] == "com/fr/" and by[3][2] == "com/de/" and by[4] == ("example.org", "/en/17", "example.org/en/1")
    assert by[5] == ("org", "", None) and by[6] == ("", "", None) == by[7] and by[8] == ("notorg", "/a", None)
    assert by[9] == ("x.net", "/", None) and by[10] == ("bad.co.uk:80", "/p;q", None)
    assert {r.verdict for r in got if r.rule} == {"allow", "block"}
    assert urls.filter_urls(frame.limit(0), labels).count() == 0
    assert {r.verdict for r in urls.filter_urls(frame, labels.limit(0)).collect()} <= {"allow", "block"}


def test_hosts_with_bad_pages_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.site.net/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300)], "doc_id long, bad int")
    for salt_rows in (1_000_000, 10):
        got = {(r.host, r.verdict) for r in urls.filter_urls(pages, labels, salt_rows=salt_rows).collect()}
        assert got == {("bad.site.net", "block"), ("good.site.net", "allow")}


def test_image_formats():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode_image(media.encode_pgm(grey)) == grey).all()
    assert (media.decode_image(media.encode_ppm(colour)) == colour).all()
    assert (media.decode_image(media.encode_bmp(colour)) == colour).all()
    assert media.decode_image(b"P2 # c\n2 1\n# d\n9\n3 4").tolist() == [[3, 4]]
    assert media.decode_image(b"P1\n3 1\n101").tolist() == [[0, 255, 0]]
    assert media.decode_image(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode_image(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P5\n9 9\n255\nx", b"P5\n0 1\n255\n", b"BM", b"GIF89a", b"P5", b"P2 2 1 9 x y", b"BM" + b"\0" * 60):
        with pytest.raises(media.MediaError):
            media.decode_image(bad)
    assert np.allclose(media.area_resize(grey, 5, 7), grey)
    assert np.allclose(media.area_resize(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    assert np.isclose(media.area_resize(grey, 3, 2).mean(), grey.mean())
    assert (media.read_tile(media.npy_tile(colour)) == colour).all()


def test_media_frame(spark):
    rows = [(1, bytearray(media.encode_pgm(np.full((3, 3), 9, np.uint8)))), (2, None), (3, bytearray(b"x"))]
    got = {r.k: r for r in media.decode_media(spark.createDataFrame(rows, "k int, c binary"), "k", "c", 4).collect()}
    assert got[1].error is None and media.read_tile(got[1].tile).tolist() == [[9] * 4] * 4
    assert got[2].error and got[3].error and got[2].tile is None


def test_media_query(spark, sf_dir, texts):
    for r in media.op1_media_columns(spark, sf_dir).collect():
        body = (texts[r.doc_id] or "").encode()
        whole = body + b"\xff" * (-len(body) % 576 or 576 * (not body))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        stored = media.store_payload(body)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_of_odd_texts(docs):
    assert media.store_texts(docs.withColumn("media", F.lit(1))).count() == len(SAMPLE)
    assert media.store_texts(docs.limit(0)).count() == 0


def packed_right(rows, bodies, encode, capacity=2048):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0
    for key, body in bodies.items():
        ids, at = np.array([*encode(body), 1], "<u4"), 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)


def test_packing(spark, sf_dir, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    one = Tokenizer.from_file(path)
    encode = lambda t: one.encode(t or "", add_special_tokens=False).ids
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed_right(packing.pack_documents(whole, path).collect(), texts, encode)
    odd = {r[0]: r[1] for r in SAMPLE}
    packed_right(packing.pack_documents(docs.dropDuplicates(["doc_id"]).withColumn("ids", F.lit(0)), path, capacity=64, pool=3).collect(), odd, encode, 64)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_word_encoder_equals_library():
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.WordEncoder(path, most=300)
    random.seed(5)
    letters = "aBTré'İΣσςÀß.,;:!?  \n\t\x1c\x85\xa0 ​µK1²½日😀é_-<|endoftext|>don't'll"
    found = ["".join(random.choice(letters) for _ in range(40)) for _ in range(1500)]
    for at in range(0, len(found), 100):
        part = found[at : at + 100]
        assert encoder.encode(part) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]


def test_subset_sum():
    import itertools
    import random

    random.seed(2)
    for _ in range(200):
        items = [random.randint(1, 12) for _ in range(random.randint(1, 8))]
        seed, room = max(items), random.randint(12, 30)
        have = Counter(items)
        chosen = Counter(packing.closest_multiset(have, room, seed))
        assert all(have[n] >= k for n, k in chosen.items()) and chosen[seed]
        rest = list(items)
        rest.remove(seed)
        best = max(seed + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if seed + sum(c) <= room)
        assert sum(n * k for n, k in chosen.items()) == best


def test_pieces_equal_library(texts):
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = pieces.TrieEncoder(path, most=5000)
    random.seed(1)
    odd = ["".join(random.choice("abc the inéß日😀  \n.,=-0011tionre\t\0") for _ in range(60)) for _ in range(800)]
    sample = [*list(texts.values())[:300], *odd, "", " ", "  a ", "\n", "aaaaaaaaaaaaaaaa", "lllllll 0000000000"]
    for at in range(0, len(sample), 200):
        part = [t or "" for t in sample[at : at + 200]]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)]
        assert got == sp.encode(part)
        assert [pieces.decode(g, encoder.vocabulary.as_bytes) for g in got] == part


def test_pieces_frame(docs, spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encode_pieces(docs.dropDuplicates(["doc_id"]).withColumn("ids", F.lit("clash")), path)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(ids, path).collect()}
    # A mark in a text is a space to the vocabulary.
    assert back == {r[0]: (r[1] or "").replace("▁", " ") for r in SAMPLE}
    assert pieces.encode_pieces(docs.limit(0), path).count() == 0


def test_language_gradients():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], *(rng.standard_normal(s).astype(np.float32) * 0.5 for s in ((2, 9, 256), (2, 9, 3), (2, 6), (2, 1))))
    xs, want = rng.integers(97, 100, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        return -np.log(langid.position_probabilities(model, xs)[:, want, np.arange(4)]).mean()

    f, kf = langid._states(model, 0, xs, True)
    b, kb = langid._states(model, 1, xs[::-1], True)
    error = langid._probabilities(model, f, b[::-1])
    error[:, want, np.arange(4)] -= 1
    error /= 20
    back = np.matmul(model.output.T, error)
    for d, (kept, grad, x) in enumerate(((kf, back[:, :3], xs), (kb, back[::-1, 3:], xs[::-1]))):
        gi, gw = np.zeros_like(model.inputs[0]), np.zeros_like(model.recurrent[0])
        langid._through_time(model, d, x, kept, grad, gi, gw)
        for weights, g, at in ((model.inputs[d], gi, (4, 98)), (model.recurrent[d], gw, (7, 1)), (model.recurrent[d], gw, (1, 2))):
            old = weights[at]
            weights[at] = old + 1e-2
            up = loss()
            weights[at] = old - 1e-2
            down = loss()
            weights[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_language_query(spark, sf_dir, docs):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = langid.op7_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id][0] == r.lang_pred for r in unseen) >= 0.97 * len(unseen)
    none = langid.identify(docs, None).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    model = langid.Model(["x"], np.zeros((2, 3, 256), np.float32), np.zeros((2, 3, 1), np.float32), np.zeros((1, 2), np.float32), np.zeros((1, 1), np.float32))
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs.withColumn("score", F.lit(1)), model).collect()} == {1: "und", 2: "und", 3: "und", 4: "x", 5: "x", 6: "x"}
    xs, _, languages = langid.training_sample(docs.limit(0), "doc_id", "text", "lang")
    assert len(xs) == 0 and languages == []


def test_samples_out_of_range():
    for bad in (b"P2 1 1 255 300", b"P2 1 1 255 -1", b"P2 1 1 65535 70000", b"P3 1 1 9 1 2 10"):
        with pytest.raises(media.MediaError):
            media.decode_image(bad)


def test_other_bitmaps():
    """8 bits with a palette, 32 bits plain and by bit fields."""
    import struct

    def bitmap(bits, packed, extra, rows):
        return struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + len(extra)) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, bits, packed, 0, 0, 0, 2, 0) + extra + rows

    want = [[[3, 2, 1], [6, 5, 4]]]
    assert media.decode_image(bitmap(8, 0, bytes([1, 2, 3, 0, 4, 5, 6, 0]), bytes([0, 1, 0, 0]))).tolist() == want
    assert media.decode_image(bitmap(32, 0, b"", bytes([1, 2, 3, 0, 4, 5, 6, 0]))).tolist() == want
    masks = struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)
    assert media.decode_image(bitmap(32, 3, masks, bytes([3, 2, 1, 0, 6, 5, 4, 0]))).tolist() == want
    with pytest.raises(media.MediaError):
        media.decode_image(bitmap(32, 3, bytes(12), bytes(8)))


def test_long_words_take_linear_memory():
    import tracemalloc

    encoder = pieces.TrieEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    word = "abcdefghij" * 4000
    tracemalloc.start()
    (ids,) = encoder.encode([word])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000 and pieces.decode(np.frombuffer(ids, "<u4").tolist(), encoder.vocabulary.as_bytes) == word


def test_pieces_with_scores():
    """The same trie on a vocabulary with scores, against all segmentations."""
    import random

    random.seed(3)
    scores = {p: -random.random() * 3 for p in ["▁", *"abc", "▁a", "ab", "bc", "abc", "▁ab", "cab", "bca", "aa"]}
    encoder = pieces.TrieEncoder(pieces.ScoredVocabulary(scores))
    names = list(scores)

    def best(word):
        if not word:
            return 0.0
        return max((scores[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in scores), default=-1e9)

    for _ in range(100):
        text = "".join(random.choice("abc ") for _ in range(random.randint(1, 12)))
        ids = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert "".join(names[i] for i in ids) == "▁" + text.replace(" ", "▁")
        assert abs(sum(scores[names[i]] for i in ids) - sum(best(w) for w in pieces.WORD.findall("▁" + text.replace(" ", "▁")))) < 1e-9


def test_pieces_query(spark, sf_dir, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = pieces.op6_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "")
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.round_trip and r.decoded_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())


def test_packing_query(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packing.op9_packing(spark, sf_dir).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(texts)
    for key, rows in by_doc.items():
        ids, at = np.array([*one.encode(texts[key] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        total = sum(r.length for r in rows)
        assert sorted(r.offset for r in rows) == [sum(s.length for s in rows if s.offset < r.offset) for r in sorted(rows, key=lambda r: r.offset)]
        assert total == 2048 or total & (total - 1) == 0


def test_every_language_is_learned(spark):
    rows = [(k, f"text {k} in words", f"l{k % 90}") for k in range(360)] + [(1000, "ab", "tiny")]
    xs, ys, languages = langid.training_sample(spark.createDataFrame(rows, "id long, body string, tongue string"), "id", "body", "tongue")
    assert languages == sorted({r[2] for r in rows}) and len(xs) == len(ys) == 361


def test_ports_do_not_part_a_domain(spark):
    hosts = [("a.co.uk:8080", 4, 4), ("me@a.co.uk", 4, 0), ("b.a.co.uk", 0, 0)]
    sites = spark.createDataFrame(hosts, "host string, n long, bad long").select("host", urls.site_of(F.col("host")).alias("s"))
    assert {(r.s, r.d, r.u) for r in sites.select("s", urls.domain_of(F.col("s")).alias("d"), urls.suffix_of(F.col("s")).alias("u")).collect()} == {("a.co.uk", "a.co.uk", "co.uk"), ("b.a.co.uk", "a.co.uk", "co.uk")}


def test_strength_follows_the_counts(spark):
    """Hosts that differ much get weak priors, hosts alike strong ones."""
    rng = np.random.default_rng(3)
    for concentration, low, high in ((4.0, 3.0, 5.5), (60.0, 40.0, 90.0)):
        rates = rng.beta(0.3 * concentration, 0.7 * concentration, 4000)
        rows = [(40, int(rng.binomial(40, p)), 0.3) for p in rates]
        got = {r.strength for r in urls._weigh(spark.createDataFrame(rows, "n long, bad long, prior double"), 10.0).collect()}
        assert len(got) == 1 and low < got.pop() < high
    assert {r.strength for r in urls._weigh(spark.createDataFrame([(0, 0, 0.3)], "n long, bad long, prior double"), 10.0).collect()} == {10.0}


def test_spread_cuts():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = [(k, int(s)) for k, s in enumerate(rng.integers(1, 30, int(rng.integers(1, 60))))]
        shards = int(rng.integers(1, 12))
        capacity, cuts = sharding.minimax_cuts(sizes, shards)
        loads = [sum(s for u, s in sizes if a <= u < b) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)]
        assert len(cuts) <= shards and cuts[0] == 0 and max(loads) == capacity and min(loads) > 0
    sizes = [(k, 10) for k in range(400)] + [(400, 25)]
    cuts = sharding.minimax_cuts(sizes, 40)[1]
    loads = [sum(s for u, s in sizes if a <= u < b) for a, b in zip(cuts, [*cuts[1:], 401], strict=True)]
    assert len(loads) == 40 and min(loads) >= 90


def test_carried_columns(docs):
    rows = docs.withColumns({"unit": F.lit(1), "sub": F.lit(2), "first": F.lit(3), "size": F.lit(4)})
    out = sharding.assign_shards(rows, shards=3, carry=("unit", "sub", "first", "size"))
    assert out.columns == ["doc_id", "size", "text_crc32", "unit", "sub", "first", "_size", "shard", "slot"]
    assert {(r["unit"], r["sub"], r["first"], r["_size"]) for r in out.collect()} == {(1, 2, 3, 4)}
