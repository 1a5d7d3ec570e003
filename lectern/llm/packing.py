"""Packing: tokens into windows of one length, by minimum bin slack.

Every document becomes ids; whole windows are cut off it and its remainder
goes to a pool. For each further window a subset-sum program over bitsets
finds the multiset of remaining lengths that comes closest to the capacity,
the longest one always among them; counts are backtracked from the bitsets.
Where no multiset fills the window, the next remainder is cut to fit. What a
task has left at its end is cut at powers of two, which need no padding.

Tasks pack what they read: no shuffle, and a task holds at most ``POOL``
remainders, each shorter than a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, table

CAPACITY = 2048
END_ID = 1
POOL = 2048
#: Characters of words that a cache holds.
CACHE_BYTES = 64_000_000
#: Bits of a sequence id below the task's number.
TASK_BITS = 32


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file, words kept in a bounded cache.

    The vocabulary's pre-tokenizer drops white space, joins nothing across it,
    and parts letters from punctuation; so a text's ids are its words' in
    order, and a word's are its letters' and its closing mark's. New words go
    through the library together. Its lower-casing is Python's on Latin-1
    texts, which share their words' cases here. Texts with characters on whose
    being white space the two differ go through the library whole.
    """

    ODD = re.compile("[\x1c-\x1f\u180e\u200b\ufeff]")
    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.known: dict[str, bytes] = {}
        self.held = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, fresh: set[str]) -> None:
        known, marks = self.known, self.MARKS
        closed = [w for w in fresh if w[-1] in marks and w[:-1].isalpha() and self._latin(w)]
        plain = list((fresh.difference(closed) | {w[:-1] for w in closed} | {w[-1] for w in closed}).difference(known))
        # Words of Latin letters alone: each ends at the next end-of-word id.
        letters = [w for w in plain if w.isalpha() and self._latin(w)]
        for at in range(0, len(letters), 4096):
            part = letters[at : at + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            ids = ids.tobytes()
            known.update(zip(part, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        others = list(set(plain).difference(letters))
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            starts = np.cumsum([0, *[len(w) + 1 for w in part]])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            cuts = (np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), starts) * 4).tolist()
            known.update(zip(part, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        for w in closed:
            known[w] = known[w[:-1]] + known[w[-1]]

    @staticmethod
    def _latin(text: str) -> bool:
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _lower(self, text: str) -> str:
        return text.lower() if self._latin(text) else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if self.ODD.search(t) else self._lower(t).split() for t in texts]
        every = set().union(*[ws for ws in split if ws])
        fresh = every.difference(self.known)
        if len(self.known) + len(fresh) > self.most or self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
            fresh = every
        self._learn(fresh)
        self.held += sum(map(len, fresh))
        get = self.known.__getitem__
        return [self._whole(t) if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split, strict=True)]


def closest_multiset(counts: dict[int, int], capacity: int, seed: int) -> dict[int, int]:
    """Lengths and how many of each, ``seed`` among them, whose sum is closest below capacity.

    ``counts``: available lengths, ``seed`` included. A bit of the set stands
    for a reachable sum; a length with count c enters in parts of 1, 2, 4, ...
    copies, so every count up to c can be reached. The bitset after each part
    is kept, and the way back reads off which parts the best sum needed.
    """
    room = capacity - seed
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == seed), room // length)
        part = 1
        while left > 0 and not reach >> room & 1:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= reach << (length * part) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = {seed: 1}
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= length * part
    return chosen


class Packer:
    """Packs pieces (key, start, ids) into sequences; ``take`` yields rows."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, pool: int = POOL) -> None:
        self.capacity, self.pool, self.next = capacity, pool, first_id
        self.by_length: dict[int, list[tuple]] = {}
        self.held = self.tokens = 0

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.by_length.setdefault(n, []).append(piece)
        self.held += 1
        self.tokens += n

    def _pop(self, length: int) -> tuple:
        stack = self.by_length[length]
        piece = stack.pop()
        if not stack:
            del self.by_length[length]
        self.held -= 1
        self.tokens -= length
        return piece

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, start, ids, whole in pieces:
            yield key, start, len(ids) // 4, ids, whole, self.next, at
            at += len(ids) // 4
        self.next += 1

    def _cut_from(self, length: int, want: int) -> tuple:
        """``want`` tokens off a piece of ``length``; the rest goes back."""
        key, start, ids, whole = self._pop(length)
        if length > want:
            self._put((key, start + want, ids[want * 4 :], whole))
        return key, start, ids[: want * 4], whole

    def _window(self, capacity: int) -> Iterator[tuple]:
        seed = max((n for n in self.by_length if n <= capacity), default=0)
        chosen = closest_multiset({n: len(v) for n, v in self.by_length.items() if n <= capacity}, capacity, seed) if seed else {}
        pieces = [self._pop(n) for n, k in chosen.items() for _ in range(k)]
        room = capacity - sum(len(p[2]) // 4 for p in pieces)
        while room and self.by_length:
            n = max(self.by_length)
            pieces.append(self._cut_from(n, min(n, room)))
            room -= len(pieces[-1][2]) // 4
        return self._sequence(pieces)

    def take(self, key, ids: bytes) -> Iterator[tuple]:
        n, step = len(ids) // 4, self.capacity
        for start in range(0, n - step + 1, step):
            yield from self._sequence([(key, start, ids[start * 4 : (start + step) * 4], n)])
        if n % step:
            self._put((key, n - n % step, ids[(n - n % step) * 4 :], n))
        while self.held >= self.pool and self.tokens >= step:
            yield from self._window(step)

    def finish(self) -> Iterator[tuple]:
        while self.tokens >= self.capacity:
            yield from self._window(self.capacity)
        while self.tokens:
            yield from self._window(1 << (self.tokens.bit_length() - 1))


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """One row a piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit, ``end_id`` after each document.
    Null and empty texts are that one id. Repeated rows are packed each for
    itself; rows of one id are told apart by their sequences. Sequence ids are
    the task's number and a count, the same if a task runs again. An empty
    table gives no rows. Sequences shorter than ``capacity`` have a power of
    two of tokens.
    """
    kind = df.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        packer = Packer(TaskContext.get().partitionId() << TASK_BITS, capacity, pool)
        id_type, out = None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            id_type = batch.schema.types[0]
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = part.column(0).to_pylist()
                for key, ids in zip(keys, encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    out.extend(packer.take(key, ids + end))
                if len(out) >= 2048:
                    yield flush()
        out.extend(packer.finish())
        if out:
            yield flush()

    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every piece of every row of ``documents``, whole.

    Null and empty texts are the end id alone. Repeated rows are packed each
    for itself. No documents, no rows.
    """
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
