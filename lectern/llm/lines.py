"""Line dedup: fuzzy lines by MinHash over character shingles.

Lines, stripped of outer white space, that are equal form a class; its first
place stands for it. Bands of minima over character shingles give candidates,
confirmed by the Jaccard similarity of their shingle sets; of each component
the line at the least (id, line number) stays and the others go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_settled, free_name, settle, table
from .hashing import ODD, band_hashes, mix, seeds
from .links import Likeness, collisions, components, link_items, pack_planes

SHINGLE = 8
LEAST = 80
#: A link of similarity 0.8 shares no band with probability 2.5e-6, one of 0.85 with 2e-8.
BANDS, ROWS = 18, 3
#: Estimates this far below the threshold go; a link is lost so with probability 5e-8.
MARGIN = 0.42
#: Shapes of lines that a comparison of many keeps.
SHAPES = 512
#: Characters that a block of signatures works on; its arrays stay in the cache.
CHARS = 64_000
#: Most bits of the filter that lines pass before an exact join: 16 MB.
FILTER_BITS = 1 << 27
BLANK = " \t\n\x0b\x0c\r"


def line_shingles(line: str, size: int = SHINGLE) -> frozenset[str]:
    return frozenset(line[i : i + size] for i in range(max(1, len(line) - size + 1)))


def _hashes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of ``lines``, one for every place, and how many each line has.

    Lines stand in one array, the short filled up to one shingle.
    """
    text = "".join([x.ljust(size, "\0") for x in lines])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.maximum(np.fromiter(map(len, lines), np.int64, len(lines)) - size + 1, 1)
    n = len(codes) - size + 1
    # A polynomial of each place's next 1, 2, 4, ... characters, as ``size`` needs them.
    run, factor, width, sums, done = codes + np.uint64(1), int(ODD), 1, None, 0
    while width <= size:
        if size & width:
            part = run[done : done + n]
            sums = part.copy() if sums is None else sums + part * np.uint64(pow(int(ODD), done, 1 << 64))
            done += width
        run = run[:-width] + run[width:] * np.uint64(factor)
        factor, width = factor * factor % (1 << 64), 2 * width
    inside = np.ones(n, bool)
    ends = np.cumsum(counts + size - 1)[:-1]
    inside[(ends[:, None] - np.arange(1, size)).ravel()] = False
    return mix(sums[inside]), counts


def _parts(lines: list[str]) -> Iterator[list[str]]:
    """``lines`` in runs of about ``CHARS`` characters, or one line."""
    at = 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and (end == at or chars + len(lines[end]) <= CHARS):
            chars += len(lines[end])
            end += 1
        yield lines[at:end]
        at = end


def line_minima(lines: list[str], size: int = SHINGLE) -> np.ndarray:
    """Minima (lines, BANDS * ROWS) over the shingles of non-empty lines."""
    factor, _ = seeds(BANDS * ROWS, 2)
    out = [np.empty((0, BANDS * ROWS), np.uint32)]
    for part in _parts(lines):
        hashes, counts = _hashes(part, size)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(counts) - counts
        minima = np.empty((BANDS * ROWS, len(part)), np.uint32)
        buffer = np.empty_like(x)
        for k in range(BANDS * ROWS):
            np.minimum.reduceat(np.multiply(x, factor[k], out=buffer), starts, out=minima[k])
        out.append(minima.T)
    return np.concatenate(out)


def _bytes(*lines: str) -> list[bytes] | None:
    """``lines`` with a byte for each character, the same in all; None if 256 bytes are too few."""
    letters, at = np.unique(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    if len(letters) > 256:
        return None
    ends = np.cumsum([0, *map(len, lines)])
    return [at[i:j].astype(np.uint8).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _keys(data: bytes, size: int) -> np.ndarray:
    """The distinct strings of ``size`` bytes, 8 at most, as ascending integers."""
    keys = np.ndarray((len(data) - size + 1,), "<u8", data + bytes(8 - size), strides=(1,)) & np.uint64((1 << 8 * size) - 1)
    keys.sort()
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return keys[new]


def line_shape(line: str, size: int = SHINGLE) -> tuple[str, np.ndarray | None]:
    """The line and, where a shingle's characters fit the bytes of an integer, its distinct shingles."""
    if size > 8 or len(line) < size:
        return line, None
    try:
        return line, _keys(line.encode("latin-1"), size)
    except UnicodeEncodeError:
        return line, None


def shingle_count(line: str, size: int = SHINGLE) -> int:
    """How many distinct shingles ``line`` has."""
    keys = line_shape(line, size)[1]
    if keys is None and len(line) >= size and size <= 8 and (data := _bytes(line)):
        keys = _keys(data[0], size)
    return len(line_shingles(line, size) if keys is None else keys)


def alike(x: tuple[str, np.ndarray | None], y: tuple[str, np.ndarray | None], least: int = LEAST, size: int = SHINGLE) -> bool:
    """Whether two shapes of lines link: exact, since keys are the shingles themselves."""
    (line, a), (other, b) = x, y
    if a is None or b is None:
        data = _bytes(line, other) if size <= 8 and min(len(line), len(other)) >= size else None
        if data is None:
            p, q = line_shingles(line, size), line_shingles(other, size)
            return 100 * len(p & q) >= least * len(p | q)
        a, b = (_keys(d, size) for d in data)
    if 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    met = np.concatenate((a, b))
    met.sort()
    both = int(np.count_nonzero(met[1:] == met[:-1]))
    return 100 * both >= least * (len(met) - both)


def similar_lines(left: list[str], right: list[str], least: int = LEAST, size: int = SHINGLE) -> np.ndarray:
    """Whether each pair of lines links."""
    shape = lru_cache(SHAPES)(lambda line: line_shape(line, size))
    return np.fromiter((alike(shape(x), shape(y), least, size) for x, y in zip(left, right, strict=True)), bool, len(left))


def _each_line(bodies: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Row and line number of every line with a word, the stripped lines, and their 128-bit digests (lines, 2)."""
    owner, number, lines = [], [], []
    for row, body in enumerate(bodies):
        found = [x.strip(BLANK) for x in (body or "").split("\n")]
        at = [k for k, x in enumerate(found) if x]
        owner += [row] * len(at)
        number += at
        lines += [found[k] for k in at]
    codes = b"".join([hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines])
    return np.array(owner, np.int64), np.array(number, np.int32), lines, np.frombuffer(codes, "<i8").reshape(-1, 2)


def _marked(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, mark, text): the hash of the text tells rows of one id apart."""
    body = F.col(f"`{text}`")
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("mark"), body.alias("text"))


def _lines(docs: DataFrame, banded: bool) -> DataFrame:
    """(id, mark, line, c1, c2) of each line with a word; its arrays sig and bands if ``banded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                owner, number, lines, codes = _each_line(part.column(2).to_pylist())
                owner = pa.array(owner)
                columns = [part.column(0).take(owner), part.column(1).take(owner), pa.array(number), *[pa.array(codes[:, k]) for k in (0, 1)]]
                if banded:
                    minima = line_minima(lines)
                    for words in (pack_planes(minima), band_hashes(minima, ROWS)):
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel())))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "mark", "line", "c1", "c2", *(["sig", "bands"] if banded else [])]
    return docs.mapInArrow(run, f"id {kind}, mark long, line int, c1 long, c2 long" + ", sig array<bigint>, bands array<bigint>" * banded)


def _filter(keys: DataFrame) -> np.ndarray:
    """A bitmap over the hashes c1 of ``keys``: a Bloom filter of one hash.

    Sixteen bits a key, ``FILTER_BITS`` at most; what it lets through is
    joined exactly, so beyond that it only filters less.
    """
    size = 1 << 20
    wanted = 16 * keys.count()
    while size < min(wanted, FILTER_BITS):
        size *= 2
    at = F.pmod("c1", F.lit(size)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        start = (r["part"] - 1) * len(r["bits"])
        out[start : start + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _bodies(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(c1, c2, body, size) of the lines whose digest is among ``keys`` (c1, c2), and maybe others."""
    bits = _filter(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                _, _, lines, codes = _each_line(batch.column(0).slice(at, 512).to_pylist())
                place = codes[:, 0] % (len(bits) * 8)
                hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                yield pa.RecordBatch.from_arrays([*[pa.array(codes[hit, k]) for k in (0, 1)], pa.array([lines[k] for k in hit], pa.string())], ["c1", "c2", "body"])

    found = docs.select("text").mapInArrow(run, "c1 long, c2 long, body string")
    return found.groupBy("c1", "c2").agg(F.first("body").alias("body"))


def _sized(items: DataFrame) -> DataFrame:
    """``items`` with size, the number of distinct shingles of ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index("body")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shingle_count(x) for x in bodies], pa.int32())], [*batch.schema.names, "size"])

    return items.mapInArrow(run, T.StructType([*items.schema, T.StructField("size", T.IntegerType())]))


def _fates(df: DataFrame, id_col: str, text: str, least: int) -> DataFrame:
    """(id, mark, line, keep): lines of classes of two or more; ``keep`` is the place (id, line, mark) kept."""
    docs = _marked(df, id_col, text)
    place = F.struct("id", "line", "mark")
    grouped = _lines(docs, True).groupBy("c1", "c2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("sig", "bands")])
    # A number for each class, fixed by being written: one long in every bucket row.
    classes = settle(grouped.withColumn("item", F.monotonically_increasing_id()), "classes")
    hits = collisions(classes.select(F.explode("bands").alias("bucket"), "item"))
    known = settle(classes.select("c1", "c2", "item", "bands", "sig").join(hits.select("item").distinct(), "item", "left_semi"), "known")
    items = settle(_sized(known.join(_bodies(docs, known), ["c1", "c2"]).drop("c1", "c2")), "items")

    like = Likeness(line_shape, lambda x, y: alike(x, y, least), least, least / 100 - MARGIN, BANDS * ROWS, lambda left, right: similar_lines(left, right, least))
    joined = components(link_items(hits, items, like))
    for done in (hits, known, items):
        drop_settled(done)
    # The least place of a component is the one kept; places combine before they meet.
    placed = classes.select("item", "place").join(joined, "item")
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    linked = joined.join(first, "component").select("item", "first")
    # Classes whose line stays and stands alone need no look-up.
    fate = classes.select("c1", "c2", "item", "place", "n").join(linked, "item", "left").withColumn("keep", F.coalesce("first", "place")).filter("n > 1 or first is not null")
    return _lines(docs, False).join(fate.select("c1", "c2", "keep"), ["c1", "c2"]).select("id", "mark", "line", "keep")


def line_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, line, kept_id, kept_line): lines of classes of two or more, and the line kept for each.

    The kept line is in it too, as its own. Any other line stands alone. Line
    numbers start at 0. Lines link where 100 * intersection >= ``least`` *
    union of their character shingles; a line shorter than a shingle is its own
    only one. Lines without a word are never touched. Null and empty texts have
    none. Rows that share an id are told apart by their texts; equal rows have
    equal lines and share their fate. Ties fall to the least (id, line). Other
    columns do not matter. An empty table gives no rows.
    """
    return _fates(df, id_col, text, least).select(F.col("id").alias(id_col), "line", F.col("keep.id").alias("kept_id"), F.col("keep.line").alias("kept_line"))


def _gone(df: DataFrame, id_col: str, text: str, least: int) -> DataFrame:
    return _fates(df, id_col, text, least).filter(F.struct("id", "line", "mark") != F.col("keep"))


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, line, kept_id, kept_line): the ``line_classes`` less the lines kept."""
    return _gone(df, id_col, text, least).select(F.col("id").alias(id_col), "line", F.col("keep.id").alias("kept_id"), F.col("keep.line").alias("kept_line"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with duplicate lines taken out of ``text``; other columns stay.

    A text that loses every line with a word keeps its blank lines; rows never
    go. Null texts stay null. Columns of any other name pass through.
    """

    @F.pandas_udf("string")
    def left(texts: pd.Series, lost: pd.Series) -> pd.Series:
        out = []
        for t, numbers in zip(texts, lost, strict=True):
            if numbers is not None and t is not None:
                numbers = set(numbers.tolist())
                t = "\n".join([x for k, x in enumerate(t.split("\n")) if k not in numbers])
            out.append(t)
        return pd.Series(out, dtype=object)

    key, mark, lost = (free_name(df, c) for c in ("id", "mark", "lost"))
    gone = _gone(df, id_col, text, least).groupBy("id", "mark").agg(F.collect_set("line").alias(lost))
    gone = gone.select(F.col("id").alias(key), F.col("mark").alias(mark), lost)
    body = F.col(f"`{text}`")
    joined = df.join(gone, (F.col(f"`{id_col}`") == F.col(key)) & (F.xxhash64(body) == F.col(mark)), "left")
    return joined.withColumn(text, left(body, F.col(lost))).select(*[F.col(f"`{c}`") for c in df.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, the lines removed and what is kept for each, for documents that lose any.

    ``kept``: (line, kept_id, kept_line) of each, in order of lines. A line
    that no row names as removed is kept. Null and empty texts lose nothing;
    of equal lines the least (doc_id, line) stays. No documents, no rows.
    """
    gone = duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sort_array(F.collect_list(F.struct("line", "kept_id", "kept_line"))).alias("kept")
    return gone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_removed"), F.array_join(F.sort_array(F.collect_list("line")), ",").alias("lines"), kept)


def op3_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, kept_id, kept_line: every line of a class of two or more, kept ones included.

    Null and empty texts have no lines. No documents, no rows.
    """
    return line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
