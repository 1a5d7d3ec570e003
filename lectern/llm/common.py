"""Shared pieces: table access, shared storage, byte and word helpers."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``.

    A plain reference inside a lambda would be computed again for every
    element, because Catalyst inlines it; a lambda variable is computed once.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Where a local session names none (tests, a notebook) a temporary folder is
    set for it; on a cluster executors could not see it, so there it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: its owner clears the folder
            return


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    # Shuffle files of finished steps go when the driver collects its garbage.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete what ``settle`` wrote for ``df``, once nothing reads it any more."""
    for spark, path in list(_made):
        if any(path.rsplit("/", 1)[-1] in f for f in df.inputFiles()[:1]):
            remove(spark, path)
            _made.remove((spark, path))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_worker(key, make: Callable):
    """What ``make`` returns, made once in each Python worker process.

    Functions reach executors by value, with module globals of their own for
    every task; a module in ``sys.modules`` outlives them.
    """
    held = sys.modules.setdefault("_lectern_worker", types.ModuleType("_lectern_worker"))
    if not hasattr(held, "made"):
        held.made = {}
    if key not in held.made:
        held.made[key] = make()
    return held.made[key]
