"""Media columns: Netpbm and BMP images to numpy arrays, tiles and hashes.

Images are decoded to arrays, resized by exact area averages read off an
integral image, written as NPY tiles and hashed by horizontal differences.
Work is row by row inside Arrow batches: no shuffle, and memory is bounded by
one batch and one image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROW = 24
BLOCK = ROW * ROW
TILE = 8


class MediaError(ValueError):
    """The bytes are no image that this module reads."""


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit array (height, width) as binary Netpbm."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    """An 8-bit array (height, width, 3) as binary Netpbm."""
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit array (height, width, 3) in RGB as an uncompressed 24-bit BMP."""
    height, width = samples.shape[:2]
    line = -(-width * 3 // 4) * 4
    rows = np.zeros((height, line), np.uint8)
    rows[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm_head(data: bytes, fields: int) -> tuple[list[int], int]:
    """``fields`` numbers after the magic, and the place after the last one's delimiter."""
    found, at = [], 2
    while len(found) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise MediaError("a Netpbm header number is missing")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap = kind in (1, 4)
    head, at = _netpbm_head(data, 2 if bitmap else 3)
    width, height, most = head[0], head[1], 1 if bitmap else head[2]
    if not (width and height and 0 < most < 65536):
        raise MediaError("a Netpbm size or maximum is out of range")
    planes = 3 if kind in (3, 6) else 1
    count = width * height * planes
    if kind <= 3:
        body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        values = [int(c) for c in body.decode("ascii", "replace") if c in "01"] if kind == 1 else [int(x) for x in body.split()]
        if len(values) < count:
            raise MediaError("samples are missing")
        if not all(0 <= v <= most for v in values[:count]):
            raise MediaError("a sample is out of range")
        out = np.array(values[:count], np.uint16 if most > 255 else np.uint8)
    elif kind == 4:
        line = -(-width // 8)
        if len(data) - at < line * height:
            raise MediaError("samples are missing")
        out = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at).reshape(height, line), axis=1)[:, :width].reshape(-1)
    else:
        wide = most > 255
        if len(data) - at < count * (2 if wide else 1):
            raise MediaError("samples are missing")
        out = np.frombuffer(data, ">u2" if wide else np.uint8, count, at)
    if bitmap:
        out = (1 - out) * np.uint8(255)  # 1 is black
    return out.reshape((height, width, 3) if planes == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("the BMP header is short")
    start, header, width, height, _, bits, packed = struct.unpack("<10xIIiiHHI", data[:34])
    if width <= 0 or height == 0 or packed not in (0, 3) or bits not in (8, 24, 32) or (packed == 3 and bits != 32):
        raise MediaError("a BMP variant that is not read")
    line = -(-width * bits // 32) * 4
    rows = abs(height)
    if len(data) - start < line * rows:
        raise MediaError("samples are missing")
    body = np.frombuffer(data, np.uint8, line * rows, start).reshape(rows, line)
    if height > 0:
        body = body[::-1]
    if bits == 8:
        colours = struct.unpack("<I", data[46:50])[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        given = np.frombuffer(data, np.uint8, min(colours, 256) * 4, 14 + header).reshape(-1, 4)
        palette[: len(given)] = given
        return palette[body[:, :width]][:, :, 2::-1]
    each = bits // 8
    if packed == 3:
        return _masked(body[:, : width * 4].copy().view("<u4").reshape(rows, width), struct.unpack("<III", data[54:66]))
    return body[:, : width * each].reshape(rows, width, each)[:, :, 2::-1]


def _masked(pixels: np.ndarray, masks: tuple[int, int, int]) -> np.ndarray:
    """Red, green and blue in 8 bits of 32-bit pixels, by their bit fields."""
    out = np.empty((*pixels.shape, 3), np.uint8)
    for k, mask in enumerate(masks):
        if not mask:
            raise MediaError("a BMP bit field is empty")
        shift = (mask & -mask).bit_length() - 1
        top = mask >> shift
        out[:, :, k] = ((pixels & np.uint32(mask)) >> np.uint32(shift)).astype(np.float64) * (255 / top) + 0.5
    return out


def decode_image(data: bytes) -> np.ndarray:
    """Array (height, width) or (height, width, 3); raises MediaError."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _decode_netpbm(data)
        if data[:2] == b"BM":
            return _decode_bmp(data)
    except (struct.error, ValueError, IndexError, OverflowError, MemoryError) as e:
        raise e if isinstance(e, MediaError) else MediaError(str(e)) from e
    raise MediaError("neither Netpbm nor BMP")


def to_grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area averages of a 2-D array on a grid of height x width cells.

    The integral image, read linearly between its nodes, is the integral up to
    any fractional place; four readings give a cell's sum, for enlarging too.
    """
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def read(values: np.ndarray, cells: int) -> np.ndarray:
        at = np.linspace(0, len(values) - 1, cells + 1)
        low = np.minimum(at.astype(int), len(values) - 2)
        part = (at - low)[:, None]
        return values[low] * (1 - part) + values[low + 1] * part

    grid = read(read(sums, height).T, width).T
    cells = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return cells * (height * width / image.size)


def difference_hash(image: np.ndarray, side: int = TILE) -> str:
    """Hex of side x side bits: whether a cell is darker than its right neighbour."""
    small = area_resize(to_grey(image), side, side + 1)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_tile(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def decode_media(df: DataFrame, id_col: str, content: str, tile: int = 64) -> DataFrame:
    """Images of a binary column: id, height, width, channels, tile, dhash, error.

    ``tile`` is the NPY file of a tile x tile area-resized grey image in 8
    bits. Null or unreadable content has null values and its reason in
    ``error``; one bad image never fails the job. Repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    image = decode_image(data or b"")
                    small = np.rint(area_resize(to_grey(image), tile, tile)).clip(0, 65535)
                    small = small.astype(np.uint8 if image.dtype == np.uint8 else np.uint16)
                    rows.append((*image.shape[:2], 1 if image.ndim == 2 else 3, npy_tile(small), difference_hash(image), None))
                except MediaError as e:
                    rows.append((None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "height", "width", "channels", "tile", "dhash", "error"]
    return df.select(id_col, content).mapInArrow(run, f"`{id_col}` {kind}, height int, width int, channels int, tile binary, dhash string, error string")


def store_payload(data: bytes) -> bytes:
    """Bytes, padded with 255 to a positive multiple of a block, as a PGM image."""
    padded = data + b"\xff" * (-len(data) % BLOCK or BLOCK * (not data))
    return encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, ROW))


def store_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as images: id, n_bytes, media. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([store_payload(t) for t in texts], pa.binary())], [id_col, "n_bytes", "media"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text).cast("binary").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` stored as images, read back, with what each holds and a feature.

    Null and empty texts are one block of padding. Repeated rows repeat; equal
    texts have equal values. No documents, no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                image = decode_image(media)
                payload = image.tobytes()
                tile = npy_tile(np.rint(area_resize(image, TILE, TILE)).astype(np.uint8))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), read_tile(tile).tobytes().hex()))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_hex"]
    stored = store_texts(table(spark, sf_dir, "documents"))
    return stored.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_hex string")
