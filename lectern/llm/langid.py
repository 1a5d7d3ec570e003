"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Texts are read in segments of ``SEGMENT`` bytes, forward and backward. Every
byte gets class probabilities from both states; a document's are the mean over
all of its bytes. Training is backpropagation through time on a bounded,
documented sample of labelled rows; prediction reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SEGMENT = 64
HIDDEN = 10
#: The training sample: rows a language, segments a row.
ROWS_PER_LANGUAGE = 400
SEGMENTS_PER_ROW = 6
STEPS, BATCH, RATE = 320, 192, 0.02
#: Segments that prediction runs at once.
LANES = 2048
LETTER = r"\p{L}"


@dataclass
class Model:
    """Weights: per direction an input table and a recurrent matrix, one output layer."""

    languages: list[str]
    inputs: np.ndarray  # (2, 3H, 256)
    recurrent: np.ndarray  # (2, 3H, H)
    output: np.ndarray  # (C, 2H)
    bias: np.ndarray  # (C, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _states(model: Model, d: int, xs: np.ndarray, keep: bool):
    """States (T, H, B) of direction ``d`` over bytes ``xs`` (T, B) in its order.

    Update and reset gates scale the old state; the reset gate acts on the
    recurrent part of the candidate.
    """
    steps, lanes = xs.shape
    h_size = model.recurrent.shape[2]
    out = np.empty((steps, h_size, lanes), np.float32)
    kept = []
    h = np.zeros((h_size, lanes), np.float32)
    table_, w = model.inputs[d], model.recurrent[d]
    for t in range(steps):
        a = np.take(table_, xs[t], axis=1)
        r = w @ h
        gates = a[: 2 * h_size]
        gates += r[: 2 * h_size]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, g = gates[:h_size], gates[h_size:]
        candidate = a[2 * h_size :]
        candidate += g * r[2 * h_size :]
        np.tanh(candidate, out=candidate)
        if keep:
            kept.append((h, z, g, r[2 * h_size :], candidate))
        h = candidate + z * (h - candidate)
        out[t] = h
    return out, kept


def _probabilities(model: Model, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Class probabilities (T, C, B)."""
    logits = np.matmul(model.output, np.concatenate([forward, backward], axis=1)) + model.bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def position_probabilities(model: Model, xs: np.ndarray) -> np.ndarray:
    """Of every byte of segments ``xs`` (T, B): (T, C, B)."""
    forward, _ = _states(model, 0, xs, False)
    backward, _ = _states(model, 1, xs[::-1], False)
    return _probabilities(model, forward, backward[::-1])


def _through_time(model: Model, d: int, xs: np.ndarray, kept: list, grad: np.ndarray, gi: np.ndarray, gw: np.ndarray) -> None:
    """Adds the gradients of direction ``d`` given those of its states (T, H, B)."""
    h_size = model.recurrent.shape[2]
    w = model.recurrent[d]
    dh = np.zeros_like(grad[0])
    lanes = grad.shape[2]
    for t in range(len(kept) - 1, -1, -1):
        before, z, g, r, candidate = kept[t]
        dh = dh + grad[t]
        dc = dh * (1 - z) * (1 - candidate * candidate)
        dz = dh * (before - candidate) * z * (1 - z)
        dg = dc * r * g * (1 - g)
        din = np.concatenate([dz, dg, dc])
        drec = np.concatenate([dz, dg, dc * g])
        gw += drec @ before.T
        one_hot = np.zeros((lanes, 256), np.float32)
        one_hot[np.arange(lanes), xs[t]] = 1
        gi += din @ one_hot
        dh = dh * z + w.T @ drec
    assert gw.shape == (3 * h_size, h_size)


def train(segments: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> Model:
    """Fits a model to segments (N, T) of bytes and class numbers (N,).

    Every position's cross entropy counts alike. Classes are drawn evenly.
    """
    rng = np.random.default_rng(seed)
    classes = len(languages)
    make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    model = Model(languages, make(2, 3 * hidden, 256, scale=0.3), make(2, 3 * hidden, hidden, scale=hidden**-0.5), make(classes, 2 * hidden, scale=0.3), np.zeros((classes, 1), np.float32))
    weights = [model.inputs, model.recurrent, model.output, model.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_class = [np.flatnonzero(labels == c) for c in range(classes)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, -(-batch // classes)) for rows in by_class])
        xs = np.ascontiguousarray(segments[pick].T)
        want = labels[pick]
        forward, kept_f = _states(model, 0, xs, True)
        backward, kept_b = _states(model, 1, xs[::-1], True)
        states = np.concatenate([forward, backward[::-1]], axis=1)
        error = _probabilities(model, forward, backward[::-1])
        error[:, want, np.arange(len(want))] -= 1
        error /= error.shape[0] * error.shape[2]
        grads = [np.zeros_like(w) for w in weights]
        grads[2] += np.einsum("tcb,thb->ch", error, states, optimize=True)
        grads[3] += error.sum(axis=(0, 2))[:, None]
        back = np.matmul(model.output.T, error)
        _through_time(model, 0, xs, kept_f, back[:, :hidden], grads[0][0], grads[1][0])
        _through_time(model, 1, xs[::-1], kept_b, back[::-1, hidden:], grads[0][1], grads[1][1])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 1.5 * (1 - step / (steps + 1)) + 0.05)
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def cut(texts: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of ``texts`` in segments (N, size): bytes, lengths, text numbers.

    The last segment of a text is filled with spaces past its length.
    """
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    rows = np.full((int(counts.sum()), size), 32, np.uint8)
    lengths = np.full(len(rows), size, np.int64)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        if n:
            rows[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
            lengths[at + n - 1] = len(t) - (n - 1) * size
            at += n
    return rows, lengths, np.repeat(np.arange(len(texts)), counts)


def predict(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities over all bytes of each text: (texts, C)."""
    rows, lengths, owner = cut(texts)
    total = np.zeros((len(texts), len(model.languages)))
    steps = np.arange(rows.shape[1])[:, None, None]
    for at in range(0, len(rows), LANES):
        part = slice(at, at + LANES)
        p = position_probabilities(model, np.ascontiguousarray(rows[part].T))
        short = lengths[part] < rows.shape[1]
        if short.any():
            p[:, :, short] *= steps < lengths[part][short][None, None, :]
        np.add.at(total, owner[part], p.sum(axis=0).T)
    return total / np.maximum([[len(t)] for t in texts], 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, id_col: str, text: str, lang: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Segments, class numbers and languages of a bounded sample of ``docs``.

    Every language; ``ROWS_PER_LANGUAGE`` rows of each by the least hash of
    their id, ``SEGMENTS_PER_ROW`` segments spread over each row's whole text,
    or its only one: what reaches the driver has that bound for a language.
    Two passes: counts, then the rows whose hash lies in the share that holds
    enough of them.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    share = F.least(F.lit(1.0), 3.0 * ROWS_PER_LANGUAGE / F.col("count"))
    # One row a language.
    limits = known.groupBy("lang").count().select("lang", share.alias("share"))
    mixed = F.xxhash64(F.lit("sample"), F.col("id"))
    near = known.withColumn("mixed", mixed).join(F.broadcast(limits), "lang").filter(F.col("mixed") / 2.0**64 + 0.5 <= F.col("share"))
    order = Window.partitionBy("lang").orderBy("mixed", "id", "text")
    rows = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= ROWS_PER_LANGUAGE)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, lengths, _ = cut([data])
                full = rows[lengths > SEGMENT // 2] if len(rows) > 1 else rows
                for i in sorted(set(np.linspace(0, len(full) - 1, SEGMENTS_PER_ROW).astype(int).tolist())) if len(full) else []:
                    out.append((name, full[i].tobytes()))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], ["lang", "bytes"])

    got = rows.select("lang", F.col("text").cast("binary").alias("bytes")).mapInArrow(segments, "lang string, bytes binary").collect()
    got = sorted((r["lang"], bytes(r["bytes"])) for r in got)
    languages = sorted({n for n, _ in got})
    xs = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(-1, SEGMENT)
    ys = np.array([languages.index(n) for n, _ in got], np.int64)
    return xs, ys, languages


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score: one row for each of ``df``.

    ``und`` and score 0 for null texts, texts without a letter, and all texts
    where no labelled row was there to learn from. Repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                letters = part.column(2).to_pylist()
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                some = [i for i, (t, has) in enumerate(zip(texts, letters, strict=True)) if t and has]
                if model is not None and some:
                    means = predict(model, [texts[i] for i in some])
                    for i, row in zip(some, means, strict=True):
                        best = int(row.argmax())
                        names[i], scores[i] = model.languages[best], min(1.0, float(row[best]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    has_letter = F.coalesce(F.col(text).rlike(LETTER), F.lit(False))
    rows = df.select(F.col(id_col), F.col(text).cast("binary").alias("__text"), has_letter.alias("__letter"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, for every row of ``documents``, by its whole text.

    Null texts and texts without a letter are ``und`` with score 0, and so are
    all texts if no row can be learned from. Repeated rows repeat. No
    documents, no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    xs, ys, languages = training_sample(docs.filter(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    model = train(xs, ys, languages) if languages else None
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
