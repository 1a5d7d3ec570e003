"""Sharding: the smallest capacity for which ordered atomic groups fit.

Equal texts form a group that no cut splits. Groups stand in the order of
their text's MD5, in ``2 ** UNIT_BITS`` consecutive units by its leading bits;
a unit is the atom of the partition. Their sizes, at most that many numbers,
come to the driver; a binary search finds the least capacity for which a
greedy fill needs no more than the wanted shards, and cuts there. A unit
larger than an even share gets a shard of its own, outside that order. A unit
holds one group or a few at common sizes, and at any size less than a
thousandth of a shard unless one text alone is larger.

All work on rows is native: hash, partial sums, one shuffle by (unit, sub).
``sub``, a hash of the row's id, splits a unit that one text fills.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, table

UNIT_BITS = 15
SUBS = 1024
SHARDS = 40
OVERHEAD = 16


def greedy_cuts(sizes: list[tuple[int, int]], capacity: int) -> list[int]:
    """The first unit of every shard when each takes as much as fits."""
    cuts, load = [], None
    for unit, size in sizes:
        if load is None or load + size > capacity:
            cuts.append(unit)
            load = 0
        load += size
    return cuts


def minimax_cuts(sizes: list[tuple[int, int]], shards: int) -> tuple[int, list[int]]:
    """The least capacity with at most ``shards`` runs, and cuts that keep it.

    ``sizes``: (unit, size) in order. No units: capacity 0, no cuts.
    """
    if not sizes:
        return 0, []
    low = max(max(s for _, s in sizes), -(-sum(s for _, s in sizes) // shards))
    high = sum(s for _, s in sizes)
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low, spread_cuts(sizes, low, shards)


def spread_cuts(sizes: list[tuple[int, int]], capacity: int, shards: int) -> list[int]:
    """The first unit of every shard, none above ``capacity``, each end as near to an even share as can be.

    A greedy fill leaves all slack to the last shard. Here a shard ends where
    the sum so far is closest to its even part, among the ends that keep it
    within the capacity and leave a rest that the other shards can take.
    """
    upto = [0]
    for _, size in sizes:
        upto.append(upto[-1] + size)
    n, total = len(sizes), upto[-1]
    # least[k]: the first unit from which the rest fits k shards, filled from the back.
    least = [n]
    for _ in range(shards):
        least.append(bisect_left(upto, upto[least[-1]] - capacity))
    cuts, at = [], 0
    for k in range(shards):
        if at == n:
            break
        cuts.append(sizes[at][0])
        low, high = max(at + 1, least[shards - k - 1]), bisect_right(upto, upto[at] + capacity) - 1
        share = total * (k + 1) / shards
        end = min(max(bisect_left(upto, share), low), high)
        if end - 1 >= low and share - upto[end - 1] < upto[end] - share:
            end -= 1
        at = end
    return cuts


def balanced_cuts(sizes: list[tuple[int, int]], shards: int) -> tuple[list[int], list[int]]:
    """Cuts of the common units, and the units that take a shard of their own.

    A unit larger than an even share of what is left stands apart, until none
    is; fewer than ``shards`` do. The rest, in order, gets the least capacity
    for the shards left.
    """
    rest, apart = list(sizes), []
    while True:
        total, left = sum(s for _, s in rest), shards - len(apart)
        large = [u for u, s in rest if s * left > total]
        if not large or left < 2:
            break
        apart += large
        rest = [(u, s) for u, s in rest if u not in set(large)]
    return minimax_cuts(rest, shards - len(apart))[1], sorted(apart)


def _shard_of(unit: Column, cuts: list[int], apart: list[int]) -> Column:
    """How many cuts lie at or below ``unit``, less one; units apart come after."""
    out = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= unit)) - 1 if cuts else F.lit(0)
    for k, u in enumerate(apart):
        out = F.when(unit == u, len(cuts) + k).otherwise(out)
    return out


def assign_shards(df: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``df``: id, size, text_crc32, shard, slot.

    Null text has no bytes and groups with the empty text. Repeated rows and
    equal ids each get a slot of their own. An empty table gives no rows.
    ``carry`` names further columns to keep; one that has the name of a result
    column gets an underscore before it.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    unit, sub, first = (free_name(df, c) for c in ("unit", "sub", "first"))
    results = {id_col.lower(), "size", "text_crc32", "shard", "slot"}
    rows = df.select(
        F.col(f"`{id_col}`"),
        (F.octet_length(body).cast("long") + overhead).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        (F.conv(F.substring(F.md5(body.cast("binary")), 1, 8), 16, 10).cast("long") / 2 ** (32 - UNIT_BITS)).cast("int").alias(unit),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SUBS)).cast("int").alias(sub),
        *[F.col(f"`{c}`").alias(f"_{c}" if c.lower() in results else c) for c in carry],
    )
    loads = rows.groupBy(unit, sub).agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n"))
    # At most 2 ** UNIT_BITS numbers.
    sizes = [(r[0], r[1]) for r in loads.groupBy(unit).agg(F.sum("load")).collect()]
    cuts, apart = balanced_cuts(sorted(sizes), shards)
    # At most 2 ** UNIT_BITS * SUBS rows, however many the table has.
    before = Window.partitionBy("shard").orderBy(unit, sub).rowsBetween(Window.unboundedPreceding, -1)
    starts = loads.withColumn("shard", _shard_of(F.col(unit), cuts, apart)).select(unit, sub, "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(unit, sub).orderBy(F.col(f"`{id_col}`"), "size", "text_crc32")
    return rows.join(starts, [unit, sub]).withColumn("slot", (F.col(first) + F.row_number().over(within) - 1).cast("long")).drop(unit, sub, first)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: size, CRC, shard and slot of every row of ``documents``.

    Null texts have no bytes and group with empty ones. Repeated rows each get
    a slot. No documents, no rows.
    """
    out = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
