"""Suffix-array dedup: repeated strings by hash-compared suffix sort.

Which strings of ``LENGTH`` bytes start at two places or more? Every such
string holds an anchor, a place of the least hash among its windows of a
gram; equal strings have equal anchors at equal offsets. So only places with a
common anchor need comparing, aligned at it:

1. Anchors of all texts, each with a digest of its surroundings, the bytes
   that strings with that anchor may reach on both sides.
2. Surroundings that occur twice are repeated throughout, by the 64 bits of
   the anchor and 64 of BLAKE2b; of those that differ at one anchor, one
   instance each is fetched.
3. The suffixes at these anchors are sorted, and so are the reversed prefixes
   before them: a merge sort whose comparisons find the common extension by
   binary search on prefix polynomial hashes. Neighbours' extensions are then
   verified byte by byte. Sorted neighbours give classes for every extension,
   and a string is repeated if another instance shares its class on both sides.
   An anchor with more surroundings than one sort holds is parted: strings
   that start in one range of offsets share all bytes that every string of the
   range has, so instances that differ there need not meet. Where a part is
   still too large, its strings are counted one by one, by 256-bit digests.
4. Intervals go back to all instances and to their documents.

Sorting an aligned sample of suffixes is what keeps the work in proportion to
repeated text; the string comparison is as in a full suffix array. Several
lengths are searched for at once, on the anchors of the shortest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_settled, free_name, settle, table
from .hashing import mix, powers

LENGTH = 400
#: Bytes of a passage that counts as repeated beside the strings of ``LENGTH``:
#: about fifty words.
PASSAGE = 240
#: Surroundings that one sort holds, if no group has more.
ROWS = 8192
#: Most surroundings of a group that is sorted as it is, and how many offsets
#: the parts of a larger one span.
MOST, WIDTH = 8192, 16
#: Bytes between the prefix hashes of a row.
STEP = 8


def gram_size(shortest: int) -> int:
    """Half the shortest length: the other half is the window that anchors cover."""
    return max(1, shortest // 2)


def prefix_sums(body: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of ``body``, modulo 2 ** 64."""
    up, _ = powers(len(body) + 1)
    out = np.empty(len(body) + 1, np.uint64)
    out[0] = 0
    np.cumsum((body + np.uint64(1)) * up[: len(body)], out=out[1:])
    return out


def _least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of every run of ``wide`` values: minima from both ends of blocks."""
    n = len(values)
    full = -(-n // wide) * wide
    blocks = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    runs = n - wide + 1
    return np.minimum(behind[:runs], ahead[wide - 1 : wide - 1 + runs])


def anchors(body: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of ``body``, ascending.

    Every window of ``length`` bytes has the places of the least gram hash
    among them, ties included. Texts shorter than ``length`` have none.
    """
    gram = gram_size(length)
    if len(body) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    b = np.frombuffer(body, np.uint8)
    sums = prefix_sums(b)
    _, down = powers(len(b) + 1)
    n = len(b) - gram + 1
    grams = mix((sums[gram:] - sums[:n]) * down[:n])
    wide = length - gram + 1
    # A gram is the least of a window that holds it if it equals the largest
    # of its windows' minima.
    top = np.iinfo(np.uint64).max
    minima = top - np.concatenate([np.zeros(wide - 1, np.uint64), _least(grams, wide), np.zeros(wide - 1, np.uint64)])
    found = np.flatnonzero(top - _least(minima, wide) == grams)
    return found, grams[found]


def _extension(hashes: np.ndarray, chunks: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common extension of rows ``i`` and ``j``: binary search on prefix hashes, the rest on ``STEP`` bytes."""
    low = np.zeros(len(i), np.int32)
    high = np.full(len(i), hashes.shape[1] - 1, np.int32)
    while True:
        open_ = low < high
        if not open_.any():
            break
        middle = (low + high + 1) >> 1
        same = hashes[i, middle] == hashes[j, middle]
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    at = np.minimum(low, chunks.shape[1] - 1)
    differ = chunks[i, at] ^ chunks[j, at]
    # The lowest bit that differs lies in the first byte that does.
    bit = np.frexp((differ & (~differ + np.uint64(1))).astype(np.float64))[1] - 1
    ext = low * STEP + np.where(differ == 0, STEP, bit >> 3)
    return np.minimum(ext, np.minimum(sizes[i], sizes[j])).astype(np.int32)


def _compare_bytes(coded: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common extensions of rows by their bytes, and whether ``a`` sorts no later."""
    real, ahead = np.empty(len(a), np.int64), np.ones(len(a), bool)
    for at in range(0, len(a), 4096):
        i, j = a[at : at + 4096], b[at : at + 4096]
        x, y = coded[i], coded[j]
        differ = x != y
        some = differ.any(axis=1)
        first = differ.argmax(axis=1)
        rows = np.arange(len(i))
        real[at : at + 4096] = np.minimum(np.where(some, first, coded.shape[1]), np.minimum(sizes[i], sizes[j]))
        ahead[at : at + 4096] = ~some | (x[rows, first] < y[rows, first])
    return real, ahead


def suffix_sort(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings by (group, string), and neighbours' common extensions.

    ``rows``: (N, D) bytes, row i valid to ``sizes[i]``. A merge sort, all
    merges of a level at once: a row's place in a merged run is its own place
    plus the rows of the other run before it, by binary search. Comparisons
    take the first difference from the common extension. The extension of a
    row and the one before it is verified on the bytes; where hashes collided,
    the order is made anew by plain comparison.
    """
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % STEP)))
    n, depth = rows.shape
    chunks = rows.view("<u8")
    coded = rows.astype(np.uint16) + np.uint16(1)
    coded[np.arange(depth)[None, :] >= sizes[:, None]] = 0
    up, _ = powers(depth + 1)
    hashes = np.zeros((n, depth // STEP + 1), np.uint64)
    for at in range(0, n, 1024):
        part = coded[at : at + 1024].astype(np.uint64)
        # Past a row's end its own number stands in: nothing is equal there.
        own = np.arange(at, at + len(part), dtype=np.uint64)[:, None] + np.uint64(1 << 32)
        hashes[at : at + len(part), 1:] = np.cumsum(np.where(part > 0, part, own) * up[:depth], axis=1)[:, STEP - 1 :: STEP]

    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether row i sorts before row j; rows that are equal keep their order."""
        out = group[i] < group[j]
        tie = np.flatnonzero(group[i] == group[j])
        if len(tie):
            a, b = i[tie], j[tie]
            ext = _extension(hashes, chunks, sizes, a, b)
            end = ext >= depth
            at = np.minimum(ext, depth - 1)
            x, y = coded[a, at], coded[b, at]
            out[tie] = np.where(end | (x == y), a < b, x < y)
        return out

    order = np.lexsort((np.arange(n), group))
    width = 1
    counts = np.bincount(group, minlength=1) if n else np.zeros(1, int)
    first = np.cumsum(counts) - counts
    place = np.arange(n)  # by position in ``order``: groups are contiguous
    of = group[order]
    local = place - first[of] if n else place
    while n and width < counts.max():
        run = local // width
        other = run ^ 1
        low = np.minimum(first[of] + other * width, first[of] + counts[of])
        high = np.minimum(low + width, first[of] + counts[of])
        start, stop = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(start < stop)
            if not len(open_):
                break
            middle = (start[open_] + stop[open_]) >> 1
            ahead = before(order[middle], order[open_])
            start[open_] = np.where(ahead, middle + 1, start[open_])
            stop[open_] = np.where(ahead, stop[open_], middle)
        base = first[of] + (run & ~1) * width
        target = base + (local - run * width) + (start - low)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    shared = np.zeros(n, np.int32)
    if n > 1:
        a, b = order[:-1], order[1:]
        same = group[a] == group[b]
        ext = np.where(same, _extension(hashes, chunks, sizes, a, b), 0)
        shared[1:] = ext
        real, ahead = _compare_bytes(coded, sizes, a, b)
        if (same & ((real != np.minimum(ext, np.minimum(sizes[a], sizes[b]))) | ~ahead)).any():
            order = np.array(sorted(range(n), key=lambda i: (int(group[i]), rows[i, : sizes[i]].tobytes(), i)))
            a, b = order[:-1], order[1:]
            same = group[a] == group[b]
            real, _ = _compare_bytes(coded, sizes, a, b)
        shared[1:] = np.where(same, real, 0)
    return order, shared


def repeated_offsets(group: np.ndarray, before: list[bytes], after: list[bytes], many: np.ndarray, lengths: tuple[int, ...], within: tuple[int, int]) -> list[np.ndarray]:
    """For each length (N, offsets): whether the string that starts x before the anchor repeats.

    Row i: the bytes ``before[i]`` the anchor and ``after[i]`` from it on, of
    group ``group[i]``; rows of a group differ. ``many[i]``: the surroundings
    occur more than once, so all their strings do. Offsets are those from
    ``within[0]`` to ``within[1]``, both included.
    """
    n = len(before)
    left, right = (np.zeros((n, max(1, max(map(len, x), default=1))), np.uint8) for x in (before, after))
    left_size, right_size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (x, y) in enumerate(zip(before, after, strict=True)):
        left[i, : len(x)] = np.frombuffer(x, np.uint8)[::-1]
        right[i, : len(y)] = np.frombuffer(y, np.uint8)
        left_size[i], right_size[i] = len(x), len(y)
    l_order, l_shared = suffix_sort(group, left, left_size)
    r_order, r_shared = suffix_sort(group, right, right_size)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    new_left = group[l_order] != np.concatenate([[-1], group[l_order][:-1]])
    new_right = group[r_order] != np.concatenate([[-1], group[r_order][:-1]])
    out = []
    for length in lengths:
        flags = np.zeros((n, within[1] - within[0] + 1), bool)
        for x in range(within[0], within[1] + 1):
            fits = np.flatnonzero((left_size >= x) & (right_size >= length - x))
            if not len(fits):
                continue
            # Rows that share x bytes before and length - x from the anchor on.
            left_class[l_order] = np.cumsum(new_left | (l_shared < x))
            right_class[r_order] = np.cumsum(new_right | (r_shared < length - x))
            both = left_class[fits] * (n + 1) + right_class[fits]
            order = np.argsort(both)
            same = both[order][1:] == both[order][:-1]
            twice = np.zeros(len(fits), bool)
            twice[order[1:]] = same
            twice[order[:-1]] |= same
            flags[fits, x - within[0]] = twice | many[fits]
        out.append(flags)
    return out


def _intervals(flags: np.ndarray, first: int) -> list[int]:
    """Runs of true offsets, counted from ``first``, as [first, last, first, last, ...]."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    edges[1::2] -= 1
    return (edges + first).tolist()


def _find_anchors(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(id, mark, place, until, n, ahead, anchor, near) of (id, mark, body): anchors, digests of surroundings.

    ``ahead``: bytes from the anchor on, the greatest length at most. Equal
    (anchor, near), 128 bits, is equal surroundings. Equal ones in a row, as in
    periodic text, are one row: ``n`` of them, the last at ``until``.
    """
    shortest, longest = min(lengths), max(lengths)
    reach = shortest - gram_size(shortest)

    def digest(body: bytes, p: int) -> int:
        return int.from_bytes(hashlib.blake2b(body[max(0, p - reach) : p + longest] + min(p, reach).to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows, columns = [], [[] for _ in range(6)]
                for row, body in enumerate(part.column(2).to_pylist()):
                    at, found = anchors(body, shortest)
                    if not len(at):
                        continue
                    near = np.array([digest(body, p) for p in at.tolist()], np.int64)
                    # Anchors in a row lie closer than a string is long.
                    first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (near[1:] != near[:-1])]))
                    last = np.concatenate([first[1:], [len(at)]]) - 1
                    rows.append(np.full(len(first), row))
                    for held, values in zip(columns, (at[first], at[last], last - first + 1, np.minimum(len(body) - at[first], longest), found[first].view(np.int64), near[first]), strict=True):
                        held.append(values)
                joined = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
                pick = joined(rows, pa.int64())
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pick), part.column(1).take(pick), *[joined(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    ["id", "mark", "place", "until", "n", "ahead", "anchor", "near"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, mark long, place int, until int, n int, ahead int, anchor long, near long")


def _compare(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(anchor, near, offsets for each length) of (key, low, high, anchor, near, n, before, after), by suffix sort.

    Tasks hold groups of one ``key`` in blocks of ``ROWS`` rows; a group is
    kept together, whatever its size. Offsets from ``low`` to ``high`` are
    judged, the same for all rows of a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(part: pa.Table) -> Iterator[pa.RecordBatch]:
            key, near = part.column("key").to_numpy(), part.column("near").to_numpy()
            anchor = part.column("anchor").to_numpy()
            # A row read twice, because its document is, would be its own rival.
            part = part.take(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (near[1:] != near[:-1]) | (anchor[1:] != anchor[:-1])])))
            low = part.column("low").to_numpy()
            for start in np.unique(low).tolist():
                some = part.filter(pa.array(low == start))
                key = some.column("key").to_numpy()
                group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
                within = (start, some.column("high")[0].as_py())
                flags = repeated_offsets(group, some.column("before").to_pylist(), some.column("after").to_pylist(), some.column("n").to_numpy() > 1, lengths, within)
                offsets = [pa.array([_intervals(f, start) for f in each], pa.list_(pa.int32())) for each in flags]
                yield pa.RecordBatch.from_arrays([*[some.column(c).combine_chunks() for c in ("anchor", "near")], *offsets], names)

        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            while count >= ROWS:
                block = pa.concat_tables(held)
                key = block.column("key").to_numpy()
                edges = np.flatnonzero(key[1:] != key[:-1]) + 1
                # As many whole groups as fit a block, one at least.
                fit = edges[edges <= ROWS]
                if len(fit):
                    cut = int(fit[-1])
                elif len(edges):
                    cut = int(edges[0])
                else:
                    held = [block]
                    break
                yield from solve(block.slice(0, cut))
                held, count = [block.slice(cut)], count - cut
        if count:
            yield from solve(pa.concat_tables(held))

    names = ["anchor", "near", *[f"o{k}" for k in range(len(lengths))]]
    schema = "anchor long, near long, " + ", ".join(f"{c} array<int>" for c in names[2:])
    return rows.repartition("key").sortWithinPartitions("key", "anchor", "near").mapInArrow(run, schema)


def _count_strings(parts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(anchor, near, offsets for each length) of (low, high, anchor, near, n, before, after), whatever their number.

    A string at one offset repeats if its digest does; digests combine before
    the shuffle. Rows of one ``anchor`` differ in ``near``.
    """
    x, size = F.col("x"), F.col("length")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(length).alias("length")) for k, length in enumerate(lengths)])
    each = parts.withColumn("x", F.explode(F.sequence("low", "high"))).select("*", F.inline(kinds))
    each = each.filter((F.length("before") >= x) & (F.length("after") >= size - x))
    string = F.concat(F.substring(F.col("before"), F.length("before") - x + 1, x), F.substring(F.col("after"), F.lit(1), size - x))
    each = settle(each.select("anchor", "near", "low", "n", "k", "x", F.unhex(F.sha2(string, 256)).alias("string")), "strings")
    key = ["anchor", "k", "x", "string"]
    often = each.groupBy(*key).agg(F.sum("n").alias("times")).filter("times > 1").drop("times")
    found = each.join(often, key, "left_semi").groupBy("anchor", "near", "low")
    # Runs of offsets: where one begins, where one ends.
    runs = "flatten(zip_with(filter({0}, x -> not array_contains({0}, x - 1)), filter({0}, x -> not array_contains({0}, x + 1)), (a, b) -> array(a, b)))"
    names = [f"o{k}" for k in range(len(lengths))]
    offsets = found.agg(*[F.array_sort(F.collect_list(F.when(F.col("k") == k, x))).alias(c) for k, c in enumerate(names)])
    return offsets.select("anchor", "near", *[F.expr(runs.format(c)).alias(c) for c in names])


def _judge(cut: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(anchor, near, offsets for each length) of the surroundings ``cut``, hot anchors parted.

    The byte key of a part only deals rows out: the sort compares bytes, so
    keys that collide do no harm.
    """
    shortest = min(lengths)
    reach = shortest - gram_size(shortest)
    rows = cut.select(F.col("anchor").alias("key"), F.lit(0).alias("low"), F.lit(reach).alias("high"), "anchor", "near", "n", "before", "after", "kinds")
    out = _compare(rows.filter(F.col("kinds") <= MOST).drop("kinds"), lengths)
    hot = rows.filter(F.col("kinds") > MOST)
    if hot.isEmpty():
        return out
    hot = hot.dropDuplicates(["anchor", "near"])
    low = F.explode(F.sequence(F.col("low"), F.col("high"), F.lit(WIDTH))).alias("low")
    parts = hot.select(low, F.col("high").alias("top"), "anchor", "near", "n", "before", "after")
    parts = parts.withColumn("high", F.least(F.col("low") + (WIDTH - 1), F.col("top"))).filter((F.length("before") >= F.col("low")) & (F.length("after") >= shortest - F.col("high")))
    shared = F.struct("anchor", "low", F.expr("right(hex(before), 2 * low)"), F.expr(f"substring(after, 1, {shortest} - high)"))
    parts = settle(parts.withColumn("key", F.xxhash64(shared)).select("key", "low", "high", "anchor", "near", "n", "before", "after"), "parts")
    sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most")).filter("kinds > 1 or most > 1").drop("most")
    parts = parts.join(sizes, "key")
    out = out.unionByName(_compare(parts.filter(F.col("kinds") <= MOST).drop("kinds"), lengths))
    return out.unionByName(_count_strings(parts.filter(F.col("kinds") > MOST), lengths))


def _merge(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals [start, end) of each owner: maximal runs, ascending and apart."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # Owners are set apart, so one running maximum serves all of them.
    far = owner.astype(np.int64) << 32
    reach = np.maximum.accumulate(end + far) if len(end) else end
    new = np.flatnonzero(np.concatenate([[True], (start + far)[1:] > reach[:-1]])) if len(end) else order
    last = np.concatenate([new[1:], [len(end)]])[: len(new)] - 1
    return owner[new], start[new], reach[last] - far[last]


def _marked(df: DataFrame, id_col: str, text: str) -> DataFrame:
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    return docs.withColumn("mark", F.xxhash64("body"))


def find_spans(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(id, mark, s0, s1, ..) of the texts (id, mark, body) that have repeated strings: the spans for each length."""
    if min(lengths) < 8:
        raise ValueError("strings of fewer than 8 bytes are not searched for")
    shortest, longest = min(lengths), max(lengths)
    reach = shortest - gram_size(shortest)
    found = settle(_find_anchors(docs.select("id", "mark", "body"), lengths), "anchors")

    # Copies combine before the shuffle: a row for each kind of surroundings,
    # with any one instance of it.
    kinds = settle(found.groupBy("anchor", "near").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("id", "mark", "place", "ahead")]), "kinds")
    # Counts combine too: the kinds of a hot anchor do not meet in one task.
    often = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("times")).filter("times > 1").drop("times")
    rivals = settle(kinds.join(often, "anchor"), "rivals")
    drop_settled(kinds)

    # Surroundings without a rival at their anchor: repeated throughout.
    throughout = [
        F.when(length - F.col("ahead") <= F.least(F.lit(reach), F.col("place")), F.array(F.greatest(F.lit(0), length - F.col("ahead")), F.least(F.lit(reach), F.col("place"))))
        .otherwise(F.array().cast("array<int>"))
        .alias(f"o{k}")
        for k, length in enumerate(lengths)
    ]
    alone = rivals.filter("kinds = 1").select("anchor", "near", *throughout)
    cut = rivals.filter("kinds > 1").join(docs, ["id", "mark"]).select(
        "anchor",
        "near",
        "n",
        F.expr(f"substring(body, greatest(place - {reach}, 0) + 1, least(place, {reach}))").alias("before"),
        F.expr(f"substring(body, place + 1, {longest})").alias("after"),
        "kinds",
    )
    names = [f"o{k}" for k in range(len(lengths))]
    cut = settle(cut, "surroundings")
    result = settle(_judge(cut, lengths).unionByName(alone).filter(" or ".join(f"size({c}) > 0" for c in names)), "repeated")
    drop_settled(cut)
    drop_settled(rivals)
    hits = found.join(result, ["anchor", "near"]).groupBy("id", "mark").agg(F.collect_list(F.struct("place", "until", *names)).alias("hits"))
    spans = settle(_join_spans(hits, lengths), "spans")
    drop_settled(found)
    drop_settled(result)
    return spans


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """``id, body, spans, passages``: UTF-8 texts with the runs that repeated strings cover.

    A byte is covered if some string of ``length`` bytes holds it that starts
    at another place too, in this text or another; ``spans`` are the maximal
    runs [start, end), null if there are none. ``passages`` are the same for
    strings of ``passage`` bytes (``length`` if it is None). Null texts count
    as empty. Repeated rows repeat each other: their texts, if long enough, are
    covered whole. Rows that share an id are told apart by their texts. An
    empty table gives no rows.
    """
    docs = _marked(df, id_col, text)
    lengths = (length,) if passage in (None, length) else (length, passage)
    found = docs.join(find_spans(docs, lengths), ["id", "mark"], "left")
    return found.select(F.col("id").alias(id_col), "body", *[F.when(F.size(c) > 0, F.col(c)).alias(n) for c, n in (("s0", "spans"), (f"s{len(lengths) - 1}", "passages"))])


def _join_spans(hits: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(id, mark, s0, ..) of (id, mark, hits): the union of all strings found in a text."""

    def spans_of(hits: pa.ListArray, name: str, length: int) -> pa.Array:
        owner = np.repeat(np.arange(len(hits)), pa.compute.list_value_length(hits).to_numpy())
        flat = hits.flatten()
        offsets = flat.field(name)
        each = pa.compute.list_value_length(offsets).to_numpy() // 2
        ranges = offsets.flatten().to_numpy().reshape(-1, 2).astype(np.int64)
        place, until = (np.repeat(flat.field(c).to_numpy().astype(np.int64), each) for c in ("place", "until"))
        of, start, end = _merge(np.repeat(owner, each), place - ranges[:, 1], until - ranges[:, 0] + length)
        pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1) * 2, pa.int32()), pa.array(np.stack([start, end], axis=1).reshape(-1), pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(hits) + 1)), pa.int32()), pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [spans_of(batch.column(2), f"o{k}", length) for k, length in enumerate(lengths)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names)

    kind = hits.schema["id"].dataType.simpleString()
    names = ["id", "mark", *[f"s{k}" for k in range(len(lengths))]]
    return hits.mapInArrow(run, f"id {kind}, mark long, " + ", ".join(f"{c} array<array<int>>" for c in names[2:]))


def _kept(body: bytes, spans: list[list[int]] | None) -> bytes:
    at, out = 0, []
    for a, b in spans or []:
        out.append(body[at:a])
        at = b
    return b"".join([*out, body[at:]]) if spans else body


def _whole_characters(body: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans widened so that no character is cut."""
    out: list[list[int]] = []
    for a, b in spans:
        while a > 0 and body[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(body) and body[b] & 0xC0 == 0x80:
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` without the repeated strings of ``text``, whole characters removed.

    All copies go, the first included. Rows and other columns stay; a null
    text stays null.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans, strict=True):
            if found is not None and t is not None:
                body = t.encode("utf-8", "surrogatepass")
                t = _kept(body, _whole_characters(body, [list(map(int, s)) for s in found])).decode("utf-8", "replace")
            out.append(t)
        return pd.Series(out, dtype=object)

    key, mark, held = (free_name(df, c) for c in ("id", "mark", "spans"))
    spans = find_spans(_marked(df, id_col, text), (length,)).select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("s0").alias(held))
    joined = df.join(spans, (F.col(f"`{id_col}`") == F.col(key)) & (F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))) == F.col(mark)), "left")
    return joined.withColumn(text, cut(F.col(f"`{text}`"), F.col(held))).select(*[f"`{c}`" for c in df.columns])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, for every row of ``documents``.

    Bytes covered by repeated strings of 400 bytes go, all copies alike;
    ``n_passage_bytes`` counts those covered by repeated strings of ``PASSAGE``
    bytes, from the same search. Null and empty texts have no bytes and the
    hash of nothing. Repeated rows each have their row and repeat each other.
    No documents, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, spans, passages = batch.column(1).to_pylist(), [s or [] for s in batch.column(2).to_pylist()], [s or [] for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(b) for b in bodies], pa.int64()),
                    pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array([hashlib.sha256(_kept(b, s)).hexdigest() for b, s in zip(bodies, spans, strict=True)], pa.string()),
                    pa.array([sum(y - x for x, y in s) for s in passages], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"],
            )

    found = repeated_spans(table(spark, sf_dir, "documents"), passage=PASSAGE)
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")
