"""Evaluations: what is left to judge, results as rows, tables to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import balance_json, evaluation_score
from .reports import any_error, shown
from .stores import upsert

KEYS = ["doc_id", "question", "method"]


def to_rows(results: DataFrame, methods: list[str]) -> DataFrame:
    """One row for each method's answer struct (success, result, error) that can be judged."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("given")) for m in methods]))
    rows = results.select("doc_id", "question", "expected_answer", each.alias("x")).select("doc_id", "question", "expected_answer", "x.method", "x.given.*")
    return rows.filter(F.coalesce("success", F.lit(False)) & ~any_error(F.col("error")) & F.col("result").isNotNull())


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows without a successful judgement."""
    judged = done.filter(F.col("success") & F.col("accuracy").isNotNull()).select(*KEYS)
    return rows.join(judged, KEYS, "left_anti")


def judged(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Rows with the accuracy that a judge's answer states; null answers failed."""
    clean = balance_json(F.col(answer))
    return rows.withColumns({"accuracy": evaluation_score(clean), "success": F.col(answer).isNotNull()})


def record(done: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert(done, fresh.select(*done.columns), KEYS)


def save(results: DataFrame, folder: str) -> None:
    """JSON with everything and CSV with long texts cut, each written whole or not at all."""
    results.write.mode("overwrite").json(f"{folder}/detail")
    cut = {"question": 100, "expected_answer": 100, "result": 200}
    summary = results.select(*[shown(F.col(c), cut[c]).alias(c) if c in cut else F.col(c) for c in results.columns])
    summary.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/summary")
