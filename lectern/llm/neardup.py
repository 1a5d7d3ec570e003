"""MinHash near-dedup with b-bit signatures.

Documents with equal shingle sets form a class, and its least id stands for
it. Bands of minima give candidates; the low bits of all minima, packed, give
a similarity estimate corrected for chance collisions, and pairs far below the
threshold go; the rest are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_settled, settle, table
from .hashing import band_hashes, digest, seeds, shingle_hashes
from .links import Likeness, collisions, components, estimate, link_items, pack_low_bits, pack_planes  # noqa: F401

#: A link of similarity 0.85 shares no band with probability 8e-7.
BANDS, ROWS = 24, 5
#: Estimates this far below the threshold go; a link is lost so with probability 3e-8.
MARGIN = 0.25


def shingles(text: str, size: int) -> frozenset[bytes]:
    """Distinct shingles of the words of ``text``, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def signatures(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """id, mark (hash of the text), n_shingles, c1, c2 (digest of the set), sig and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, addend = (x[:, None] for x in seeds(BANDS * ROWS))
        for batch in batches:
            n, c1, c2, sigs, bands = [], [], [], [], []
            for data in batch.column(2).to_pylist():
                found = shingle_hashes((data or b"").lower(), size)
                a, b = digest(found.tobytes())
                n.append(len(found))
                c1.append(a)
                c2.append(b)
                if len(found):
                    x = (found >> np.uint64(32)).astype(np.uint32)
                    minima = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
                    for at in range(0, len(x), 4096):
                        np.minimum(minima, (factor * x[at : at + 4096] + addend).min(axis=1), out=minima)
                    sigs.append(pack_planes(minima[None])[0])
                    bands.append(band_hashes(minima[None], ROWS)[0])
                else:
                    sigs.append(np.empty(0, np.int64))
                    bands.append(np.empty(0, np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (sigs, bands)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), *lists], ["id", "mark", "n_shingles", "c1", "c2", "sig", "bands"])

    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))
    return docs.mapInArrow(run, f"id {kind}, mark long, n_shingles long, c1 long, c2 long, sig array<bigint>, bands array<bigint>")


def text_of(name: str) -> Column:
    return F.col(f"`{name}`").cast("binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, least: int = 80) -> DataFrame:
    """One row for each of ``df``: id, n_shingles, component_id, kept.

    Links join documents with 100 * intersection >= ``least`` * union of their
    ``size``-word shingle sets; a component is named by its least id, and that
    row alone is kept. Null, empty and wordless texts have no shingles, no
    links and are kept. Rows of one id are told apart by their texts: each has
    its own text's component, and equal rows share their fate. Equal texts are
    linked however short; ties fall to the least id. Other columns do not
    matter. An empty table gives no rows.
    """
    signed = settle(signatures(df, id_col, text, size), "signed")
    shaped = signed.filter("n_shingles > 0")
    grouped = shaped.groupBy("c1", "c2").agg(F.min(F.struct("id", "mark")).alias("place"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # A number for each class, fixed by being written.
    classes = settle(grouped.withColumn("item", F.monotonically_increasing_id()), "classes")
    hits = collisions(classes.select(F.explode("bands").alias("bucket"), "item"))
    wanted = classes.join(hits.select("item").distinct(), "item", "left_semi").select("item", "size", "sig", "bands", F.col("place.id").alias("id"), F.col("place.mark").alias("mark"))
    bodies = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text)).alias("mark"), F.col(f"`{text}`").alias("body"))
    items = settle(wanted.join(bodies, ["id", "mark"]).drop("id", "mark").dropDuplicates(["item"]), "items")

    def similar(a: frozenset, b: frozenset) -> bool:
        both = len(a & b)
        return 100 * both >= least * (len(a) + len(b) - both)

    like = Likeness(lambda body: shingles(body, size), similar, least, least / 100 - MARGIN, BANDS * ROWS)
    joined = components(link_items(hits, items, like))
    drop_settled(items)
    drop_settled(hits)
    linked = classes.select("c1", "c2", "item", "place.id").join(joined, "item")
    first = linked.groupBy("component").agg(F.min("id").alias("first"))
    of_class = linked.join(first, "component").select("c1", "c2", "first")
    of_class = classes.select("c1", "c2", "place.id").join(of_class, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("first", "id").alias("component"))
    placed = signed.select("id", "n_shingles", "c1", "c2").join(of_class, ["c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    out = placed.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(f"`{id_col}`") == F.col("component_id"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of ``documents``: three words, 0.85.

    Null, empty and wordless texts have no shingles and stand alone. Repeated
    rows each have their row; rows of one id are told apart by their texts.
    No documents, no rows.
    """
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, least=85)
