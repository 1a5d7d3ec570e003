"""A training corpus from raw documents, in five stages.

Quality rules, line dedup, near-duplicate removal, repeated-string removal,
packing. Each stage takes the documents that the one before it kept, writes
its result as Parquet in shared storage, and hands on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import settle, table
from lectern.llm.lines import dedup_lines
from lectern.llm.neardup import near_duplicates
from lectern.llm.packing import pack_documents
from lectern.llm.quality import filter_quality
from lectern.llm.suffixes import remove_repeated

#: Bytes of a repeated string: below what fifty words mostly take.
REPEATED = 240


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line only where its component keeps it."""
    return _counted(dedup_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    kept = near_duplicates(docs, size=5, least=80).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings that occur twice."""
    return _counted(remove_repeated(docs, length=REPEATED))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("suffix_dedup", repeats), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs


#: Components and string repeats are beyond SQL here; tests compare each stage
#: with a plain version.
ORACLE_SQL = None
