"""SentencePiece encoding and decoding: Viterbi on a trie of marked words.

A text, its spaces marked, falls into marked words that no piece crosses. The
distinct words of a block are sorted, which lays them out as the depth-first
order of their trie: what two neighbours share is a prefix whose forward
scores are computed once. The forward state of a prefix is its best score, the
last piece of that path and where it starts; ids are read off backwards.

With a ``ScoredVocabulary`` the score of a path is the sum of its pieces'. The
public vocabulary is of merges, where that would not give its ids: there a
transition between two pieces scores 0 if the merge order leaves them apart and
minus infinity if a merge would join across them, so exactly one path to every
prefix stays finite, and it is the library's own segmentation.
Characters outside the vocabulary become their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, table

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
NEVER = 1 << 40


class Vocabulary:
    """Pieces, their merge ranks and how each came about."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, int] = {}
        self.rank: dict[str, int] = {}
        self.as_bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.as_bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.as_bytes.append(b"")
            else:
                self.as_bytes.append(piece.replace(MARK, " ").encode())
                self.pieces[piece] = i
                # Equal scores merge from the left: one rank for one string.
                self.rank[piece] = int(-sp.get_score(i))
        self.longest = max(map(len, self.pieces), default=1)
        self.split: dict[str, tuple[str, str] | None] = {}
        #: Scores that add up along a path, by id; None where merges decide.
        self.gain: dict[int, float] | None = None

    def merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of ``word`` by merging the best-ranked neighbours, and the last merge."""
        parts: list[str | None] = list(word)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        rank, last = self.rank, None
        queue = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        heapq.heapify(queue)
        while queue:
            _, i, whole = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != whole:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and parts[a] + parts[b] in rank:
                    heapq.heappush(queue, (rank[parts[a] + parts[b]], a, parts[a] + parts[b]))
        return [p for p in parts if p is not None], last

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes ``piece``; None for a character.

        A piece that merging alone would never make has no halves but itself,
        and is marked by an empty pair.
        """
        found = self.split.get(piece, False)
        if found is False:
            parts, last = self.merge(piece)
            found = None if len(piece) == 1 else last if len(parts) == 1 else ("", "")
            self.split[piece] = found
        return found

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` ends with just these two pieces.

        Undoes the merges of both sides from the latest back. At every moment
        the characters next to the border belong to the two parts at hand; the
        border is crossed if joining these ranks before the merge that grew
        either of them, from the left where ranks are equal.
        """
        rank, a, b, sooner = self.rank, left, right, NEVER
        while True:
            join = rank.get(a + b, NEVER)
            # ``sooner``: the rank of the merge undone last, doubled; odd if it
            # stood left of the border, where it wins a tie.
            if 2 * join < sooner:
                return False
            half_a, half_b = self.halves(a), self.halves(b)
            rank_a = rank[a] if half_a else -1
            rank_b = rank[b] if half_b else -1
            if half_a is None and half_b is None:
                return True
            if rank_a > rank_b:
                a, sooner = half_a[1], 2 * rank_a
            else:
                b, sooner = half_b[0], 2 * rank_b + 1


START, BARRIER = -1, -2
#: Score of a path that cannot be, and of a character outside the vocabulary.
NOWHERE, BARRIER_SCORE = float("-inf"), -1e6
#: Characters of words and bytes of ids that a cache holds.
CACHE_BYTES = 64_000_000


class ScoredVocabulary:
    """Pieces with scores: the best path is the one of the greatest sum, ties to the longest last piece."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.pieces = {p: k for k, p in enumerate(scores)}
        self.gain = {k: scores[p] for p, k in self.pieces.items()}
        self.byte_ids = list(range(len(scores), len(scores) + 256))
        self.as_bytes = [*[p.replace(MARK, " ").encode() for p in scores], *[bytes([b]) for b in range(256)]]

    def halves(self, piece: str) -> None:
        return None

    def stay_apart(self, left: str, right: str) -> bool:
        return True


class TrieEncoder:
    """Ids of sorted distinct words, prefixes scored once; a bounded cache.

    A cache key is what stands between two spaces; its mark is implied. Line
    feeds are no piece, so they end a word and begin one without a mark.
    """

    def __init__(self, path: str | ScoredVocabulary, most: int = 500_000) -> None:
        self.vocabulary = v = Vocabulary(path) if isinstance(path, str) else path
        self.most = most
        self.held = 0
        self.known: dict[str, bytes] = {}
        self.names = {i: p for p, i in v.pieces.items()}
        self.codes = {i: i.to_bytes(4, "little") for i in self.names}
        #: Whether two pieces stay apart, by both ids.
        self.fit: dict[int, bool] = {}
        #: Pieces from their last character back: {character: node}, "" the id.
        self.backward: dict = {}
        for piece, i in v.pieces.items():
            if v.halves(piece) == ("", ""):
                continue  # merging never makes it
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i

    def _unknown(self, char: str) -> bytes:
        return b"".join(self.vocabulary.byte_ids[x].to_bytes(4, "little") for x in char.encode("utf-8", "surrogatepass"))

    def encode_words(self, ordered: list[str]) -> Iterator[tuple[str, bytes]]:
        """``ordered``: distinct words, sorted. Yields each with its ids."""
        backward, fit, codes, names, stay = self.backward, self.fit, self.codes, self.names, self.vocabulary.stay_apart
        # Forward state of each prefix of the current branch: its score, its
        # last piece, and where that piece starts. Memory is linear in a word.
        # A character outside the vocabulary is a barrier.
        score: list[float] = [0.0]
        last: list[int] = [START]
        back: list[int] = [0]
        path = ""
        gain = self.vocabulary.gain
        for word in ordered:
            shared = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                shared += 1
            del score[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
            for end in range(shared, len(word)):
                node, start, found = backward, end, []
                while start >= 0:
                    node = node.get(word[start])
                    if node is None:
                        break
                    if "" in node:
                        found.append((node[""], start))
                    start -= 1
                best, choice = NOWHERE, None
                for piece, start in reversed(found):
                    left = last[start]
                    if gain is not None:
                        value = score[start] + gain[piece]
                    elif left < 0:
                        value = score[start]
                    else:
                        both = left << 32 | piece
                        fits = fit.get(both)
                        if fits is None:
                            fits = fit[both] = stay(names[left], names[piece])
                        value = score[start] if fits else NOWHERE
                    if value > best:
                        best, choice = value, (piece, start)
                        if gain is None:
                            break  # one path stays finite
                if choice is None:
                    best, choice = score[end] + BARRIER_SCORE, (BARRIER, end)
                score.append(best)
                last.append(choice[0])
                back.append(choice[1])
            path = word
            at, found_ids = len(word), []
            while at:
                start = back[at]
                found_ids.append(codes[last[at]] if last[at] >= 0 else self._unknown(word[start]))
                at = start
            yield word, b"".join(reversed(found_ids))

    def _learn(self, fresh: set[str]) -> None:
        """``fresh``: keys. Those with line feeds are put together from parts."""
        parts = {k: (MARK + k).split("\n") for k in fresh if "\n" in k}
        distinct = {MARK + k for k in fresh if k not in parts}.union(*parts.values()) - {""}
        found = dict(self.encode_words(sorted(distinct)))
        found[""] = b""
        feed = self._unknown("\n")
        for k in fresh:
            ids = self.known[k] = feed.join([found[p] for p in parts[k]]) if k in parts else found[MARK + k]
            self.held += len(k) + len(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = []
        for t in texts:
            if not t or MARK in t or "  " in t or t[0] == " " or t[-1] == " ":
                split.append([w[1:] for w in self._runs(t)] if t else [])
            else:
                split.append(t.split(" "))
        fresh = {w for ws in split for w in ws}.difference(self.known)
        if len(self.known) + len(fresh) > self.most or self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
            fresh = {w for ws in split for w in ws}
        self._learn(fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    @staticmethod
    def _runs(text: str) -> list[str]:
        """Words of a text with runs of spaces: each run of marks opens one."""
        return WORD.findall(MARK + text.replace(" ", MARK))


def decode(ids: list[int], as_bytes: list[bytes]) -> str:
    """Text of ids: pieces joined, marks to spaces, the leading mark dropped."""
    body = b"".join([as_bytes[i] for i in ids])
    return body[1:].decode("utf-8", "replace") if body[:1] == b" " else body.decode("utf-8", "replace")


BLOCK_CHARS = 8_000_000


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column 1 holds about ``most`` bytes in each, or one row."""
    for batch in batches:
        at, sizes, n = 0, 0, 0
        for i, x in enumerate(pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()):
            if n and sizes + x > most:
                yield batch.slice(at, n)
                at, sizes, n = i, 0, 0
            sizes += x
            n += 1
        if n:
            yield batch.slice(at, n)


def encode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids: one row for each of ``df``; little-endian unsigned 32-bit ids.

    Null and empty texts have no ids. Repeated rows repeat. Tasks share
    nothing; a block of texts and a cache of words bound a task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("pieces", model_path), lambda: TrieEncoder(model_path))
        for part in blocks(batches):
            found = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id, text: the inverse of ``encode_pieces``. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        as_bytes = Vocabulary(model_path).as_bytes
        for part in blocks(batches):
            texts = [decode(np.frombuffer(x or b"", "<u4").tolist(), as_bytes) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, the CRC of the text decoded from the ids, and whether it is the text.

    One row for every row of ``documents``. Null and empty texts have no ids.
    Repeated rows repeat. No documents, no rows.
    """
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = per_worker(("pieces", path), lambda: TrieEncoder(path))
        as_bytes = encoder.vocabulary.as_bytes
        for part in blocks(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = encoder.encode(texts)
            back = [decode(np.frombuffer(x, "<u4").tolist(), as_bytes) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                    pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"],
            )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
