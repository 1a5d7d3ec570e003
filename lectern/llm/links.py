"""Links between similar items: candidates, verification, components.

Two items are candidates if they share a bucket. In each bucket every item is
first compared with the bucket's least one; components of the links found let
all buckets go whose items are already together. In the buckets left, all
pairs of different components are compared, in blocks of bounded size. So no
link between items of a shared bucket is lost, and a group of copies costs
one comparison a member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_settled, settle

#: Items of a block; a task of the second round holds two blocks.
BLOCK = 512
#: Items of a block whose pairs are all looked at together, and about how many
#: pairs of a larger one are.
FEW, PAIRS = 16, 1 << 17
LOW_BITS = 2


def collisions(buckets: DataFrame) -> DataFrame:
    """(bucket, item) to (bucket, item, hub) for buckets of two items or more.

    ``hub`` is the least item. One shuffle, by bucket; rows are two keys, and
    a large bucket spills. Settled.
    """
    w = Window.partitionBy("bucket")
    return settle(buckets.withColumns({"hub": F.min("item").over(w), "top": F.max("item").over(w)}).filter("hub <> top").drop("top"), "collisions")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(item, component) for every item of ``edges`` (a, b): the least item reachable.

    Distributed union-find by alternating stars: each item's larger neighbours,
    then its smaller ones, move to its least neighbour. Ends when nothing
    moves; trees get at least twice as flat each time. Every step is written to
    shared storage, and nothing but two numbers reaches the driver.
    """
    pairs = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        small = large.filter("a > b").groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(F.col("b").alias("x"), "m").filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        star = star.unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        before, pairs = pairs, settle(star, name)
        drop_settled(before)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("a").alias("item"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("item"), F.col("b").alias("component")).distinct()
    )


def pack_planes(minima: np.ndarray, bits: int = LOW_BITS) -> np.ndarray:
    """The low ``bits`` bits of minima (items, K) as 64-bit words, bit plane after bit plane."""
    n, count = minima.shape
    planes = (minima[:, None, :] >> np.arange(bits, dtype=np.uint32)[None, :, None]) & np.uint32(1)
    packed = np.zeros((n, bits, -(-count // 64) * 8), np.uint8)
    packed[:, :, : -(-count // 8)] = np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")
    return packed.reshape(n, -1).view("<i8")


def pack_low_bits(minima: np.ndarray, bits: int = LOW_BITS) -> bytes:
    """The packed low bits of one item's minima."""
    return pack_planes(minima[None], bits).tobytes()


def estimate(a: int, b: int, count: int, bits: int = LOW_BITS) -> float:
    """Similarity of packed signatures, as integers, corrected for chance.

    Two different minima agree in ``bits`` low bits with probability 2 ** -bits.
    """
    differ, plane = a ^ b, -(-count // 64) * 64
    some = 0
    for k in range(bits):
        some |= differ >> plane * k
    agree = 1 - (some & (1 << plane) - 1).bit_count() / count
    chance = 2.0**-bits
    return (agree - chance) / (1 - chance)


def estimated(a: Column, b: Column, count: int, bits: int = LOW_BITS) -> Column:
    """``estimate`` of two signatures that are arrays of their 64-bit words."""
    words = -(-count // 64)
    differ = [F.bit_count(reduce(Column.bitwiseOR, [a[k * words + w].bitwiseXOR(b[k * words + w]) for k in range(bits)])) for w in range(words)]
    chance = 2.0**-bits
    return (1 - reduce(Column.__add__, differ) / count - chance) / (1 - chance)


@dataclass(frozen=True)
class Likeness:
    """What makes two items a link, and what may rule a pair out before.

    ``shape`` turns a body into what ``similar`` compares. Similar items have
    sizes within ``least`` percent of each other, and signatures of ``count``
    minima whose estimate is at least ``floor``. ``confirm``, where given,
    judges lists of bodies at once.
    """

    shape: Callable[[str], object]
    similar: Callable[[object, object], bool]
    least: int
    floor: float
    count: int
    confirm: Callable[[list[str], list[str]], np.ndarray] | None = None

    def judge(self, left: list[str], right: list[str]) -> np.ndarray:
        if self.confirm is not None:
            return self.confirm(left, right)
        # Rows of one hub stand together after the join: its shape is kept.
        out, held, last = np.zeros(len(left), bool), None, None
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            if x != last:
                held, last = self.shape(x), x
            out[i] = self.similar(held, self.shape(y))
        return out

    def rules_in(self, a: str, b: str) -> Column:
        """Whether the columns size_a, sig_a and size_b, sig_b allow a link."""
        n, m = F.col(f"size_{a}"), F.col(f"size_{b}")
        return (100 * F.least(n, m) >= self.least * F.greatest(n, m)) & (estimated(F.col(f"sig_{a}"), F.col(f"sig_{b}"), self.count) >= self.floor)


def link_items(hits: DataFrame, items: DataFrame, like: Likeness) -> DataFrame:
    """Verified links (a, b) that connect all similar items of shared buckets.

    ``hits``: from ``collisions``. ``items``: (item, body, size, sig, bands)
    for every item in ``hits``, settled; ``sig`` is an array of words.
    """
    kind = items.schema["item"].dataType.simpleString()
    schema = f"a {kind}, b {kind}"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(like.judge(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], ["a", "b"])

    traits = lambda k: items.select(F.col("item").alias(k), F.col("size").alias(f"size_{k}"), F.col("sig").alias(f"sig_{k}"))
    body = lambda k: items.select(F.col("item").alias(k), F.col("body").alias(f"body_{k}"))
    stars = hits.filter("item <> hub").select(F.col("hub").alias("a"), F.col("item").alias("b")).distinct()
    # Only pairs that sizes and signatures allow fetch their bodies.
    near = stars.join(traits("b"), "b").join(traits("a"), "a").filter(like.rules_in("a", "b")).select("a", "b")
    first = near.join(body("b"), "b").join(body("a"), "a").select("a", "b", "body_a", "body_b")
    first = settle(first.mapInArrow(compare, schema), "links")
    found = components(first)

    # Pairs with the hub are settled; what is left are the others of a bucket.
    others = hits.filter("item <> hub").select("bucket", "item")
    rows = settle(others.join(found, "item", "left").withColumn("component", F.coalesce("component", "item")), "placed")
    # Rows of a bucket combine before the shuffle: few buckets are still apart.
    apart = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("bucket", "n")
    rows = rows.join(apart, "bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")})
    rows = rows.join(items, "item").select("bucket", "x", "y", "mine", "item", F.xxhash64("component").alias("component"), "size", "sig", "bands", "body")

    def filtered(block: pa.Table) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """What leaves of pairs (rows i, j) of ``block`` those that may be links."""
        component, mine, size, bucket, x, y = (block.column(c).to_numpy() for c in ("component", "mine", "size", "bucket", "x", "y"))
        bands, sig = (block.column(c).combine_chunks().flatten().to_numpy().reshape(len(block), -1) for c in ("bands", "sig"))
        size, alone, words = size.astype(np.int64), x == y, -(-like.count // 64)
        chance = 2.0 ** -(sig.shape[1] // words)

        def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = (component[i] != component[j]) & (alone[i] | (mine[i] != mine[j]))
            i, j = i[keep], j[keep]
            keep = 100 * np.minimum(size[i], size[j]) >= like.least * np.maximum(size[i], size[j])
            i, j = i[keep], j[keep]
            differ = (sig[i] ^ sig[j]).reshape(len(i), sig.shape[1] // words, words)
            some = np.bitwise_or.reduce(differ, axis=1).view(np.uint64)
            agree = 1 - np.bitwise_count(some).sum(axis=1) / like.count
            keep = (agree - chance) / (1 - chance) >= like.floor
            i, j = i[keep], j[keep]
            # A pair that shares several buckets is compared in the first.
            same = bands[i] == bands[j]
            keep = bands[i, same.argmax(axis=1)] == bucket[i]
            return i[keep], j[keep]

        return fit

    def small(block: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (rows i, j) of blocks of few rows that may be links, all blocks at once."""
        i, j = (np.concatenate(x) for x in zip(*[(np.repeat(starts[sizes == n], len(p)) + np.tile(p, (sizes == n).sum()), np.repeat(starts[sizes == n], len(q)) + np.tile(q, (sizes == n).sum())) for n in np.unique(sizes) for p, q in [np.triu_indices(n, 1)]], strict=True))
        return filtered(block)(i, j)

    def large(block: pa.Table) -> Iterator[tuple[int, int]]:
        """Links (rows i, j) of one block: rows that a link has joined are not compared again."""
        fit, component, body = filtered(block), block.column("component").to_pylist(), block.column("body")
        parent: dict = {}
        shapes: dict = {}

        def root(c):
            while c in parent:
                c = parent[c]
            return c

        step = max(1, PAIRS // len(block))
        for at in range(0, len(block), step):
            each = np.arange(at, min(at + step, len(block)))
            i = np.repeat(each, each)
            j = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
            for p, q in zip(*(x.tolist() for x in fit(i, j)), strict=True):
                a, b = root(component[p]), root(component[q])
                if a == b:
                    continue
                for k in (p, q):
                    if k not in shapes:
                        shapes[k] = like.shape(body[k].as_py())
                if like.similar(shapes[p], shapes[q]):
                    parent[a] = b
                    yield p, q

    def links_of(block: pa.Table) -> pa.RecordBatch:
        """Links of whole blocks (bucket, x, y), rows in that order."""
        key = np.stack([block.column(c).to_numpy().astype(np.int64) for c in ("bucket", "x", "y")])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        sizes = np.diff(np.concatenate([starts, [len(block)]]))
        few = (sizes <= FEW) & (sizes > 1)
        i = j = np.empty(0, np.int64)
        if few.any():
            i, j = small(block, starts[few], sizes[few])
            body = block.column("body")
            keep = like.judge(body.take(pa.array(j)).to_pylist(), body.take(pa.array(i)).to_pylist())
            i, j = i[keep], j[keep]
        rest = [(s + p, s + q) for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True) for p, q in large(block.slice(s, n))]
        rows = (np.concatenate([own, np.array([r[k] for r in rest], np.int64)]) for k, own in enumerate((i, j)))
        item = block.column("item").combine_chunks()
        return pa.RecordBatch.from_arrays([item.take(pa.array(r)) for r in rows], ["a", "b"])

    def in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            whole = pa.concat_tables(held)
            key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("bucket", "x", "y")])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            # The last block may go on in the next batch.
            held = [whole]
            if len(edges):
                yield links_of(whole.slice(0, int(edges[-1])))
                held = [whole.slice(int(edges[-1]))]
        if held and len(held[0]):
            yield links_of(held[0])

    second = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "item").mapInArrow(in_block, schema)
    return first.unionByName(settle(second, "links"))
