"""Files as tables: discovery, routing, signatures, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .text import decoded, text_blocks

SUPPORTED = (".pdf", *C.OFFICE_SUFFIXES, *C.IMAGE_SUFFIXES, *C.TEXT_SUFFIXES, *C.HTML_SUFFIXES, *C.AUDIO_SUFFIXES, *C.VIDEO_SUFFIXES)
MOST_IMAGE_BYTES = 50 * 1024 * 1024


def discover(spark: SparkSession, *roots: str, recursive: bool = True, suffixes: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(path, size, mtime, kind, content) of supported files, each path once.

    Only the columns a query asks for are read; the suffix is matched before
    any content is.
    """
    wanted = tuple((s if s.startswith(".") else f".{s}").lower() for s in suffixes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(roots))
    rows = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return rows.filter(C.suffix(F.col("path")).isin(*wanted)).withColumn("kind", C.route(F.col("path"))).dropDuplicates(["path"])


def signatures(files: DataFrame) -> DataFrame:
    """(path, size, mtime, md5, sha256): what tells whether a file changed."""
    return files.select("path", "size", "mtime", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def relative_name(path: Column, root: str) -> Column:
    """A file's name below ``root``; its base name elsewhere."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(C.base_name(path))


def valid_image(path: Column, size: Column, content: Column, most: int = MOST_IMAGE_BYTES) -> Column:
    """An image by suffix, size and first bytes."""
    return C.suffix(path).isin(*C.IMAGE_SUFFIXES) & (size <= most) & C.image_mime(content).isNotNull()


def read_texts(files: DataFrame) -> DataFrame:
    """Blocks of the text and Markdown files among ``files``."""
    folder = F.regexp_replace(F.col("path"), "[^/]*$", "")
    images = files.filter(valid_image(F.col("path"), F.col("size"), F.col("content"))).select(F.col("path").alias("image"), folder.alias("folder"))
    near = images.groupBy("folder").agg(F.collect_list("image").alias("images"))
    texts = files.filter(C.suffix(F.col("path")).isin(*C.TEXT_SUFFIXES)).withColumn("folder", folder)
    return text_blocks(texts.join(near, "folder", "left").select("path", decoded(F.col("content")).alias("text"), "images"))


#: Readers by name: functions of a files table that return blocks.
_readers: dict[str, Callable[[DataFrame], DataFrame]] = {"text": read_texts}
_BUILT_IN = frozenset(_readers)


def _name(name: str) -> str:
    named = name.strip().lower() if isinstance(name, str) else ""
    if not named:
        raise ValueError("a reader needs a name")
    return named


def register_reader(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    if _name(name) in _BUILT_IN:
        raise ValueError(f"{name} is built in")
    if not callable(reader):
        raise TypeError("a reader is a function of a files table")
    _readers[_name(name)] = reader


def unregister_reader(name: str) -> None:
    if _name(name) in _BUILT_IN:
        raise ValueError(f"{name} is built in")
    if _readers.pop(_name(name), None) is None:
        raise KeyError(name)


def get_reader(name: str) -> Callable[[DataFrame], DataFrame]:
    if _name(name) not in _readers:
        raise ValueError(f"no reader {name}; there are {', '.join(list_readers())}")
    return _readers[_name(name)]


def list_readers() -> list[str]:
    return sorted(_readers)
