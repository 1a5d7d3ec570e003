"""Reports: rates, per-method accuracy, events, evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """A percentage; 0 of nothing."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def batch_summary(outcomes: DataFrame, *group: str) -> DataFrame:
    """Counts by outcome; files that were skipped count as done."""
    n = lambda name: F.count_if(F.col("outcome") == name)
    ok, failed, skipped = n("ok"), n("failed"), n("skipped")
    return outcomes.groupBy(*group).agg(ok.alias("successful"), failed.alias("failed"), skipped.alias("skipped"), F.round(rate(ok + skipped, F.count(F.lit(1))), 6).alias("success_rate"))


def event_metrics(events: DataFrame, kind: str, duration: str, error: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.round(F.sum(duration), 4).alias("total"), F.round(F.avg(duration), 6).alias("mean")]
    if error:
        aggs.append(F.slice(F.array_sort(F.collect_set(error)), 1, 5).alias("errors"))
    return events.groupBy(kind).agg(*aggs)


def method_accuracy(scores: DataFrame, *group: str, correct: str = "accuracy", metrics: tuple[str, ...] = ()) -> DataFrame:
    """Samples, correct ones, rate and metric means of each group, nulls left out."""
    judged = F.count(correct)
    right = F.coalesce(F.sum(F.col(correct).cast("long")), F.lit(0))
    return scores.groupBy(*group).agg(judged.alias("samples"), right.alias("correct"), F.round(rate(right, judged), 6).alias("accuracy"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in metrics])


def unpivot_methods(results: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """One row for each method column: keys, method, answer."""
    return results.unpivot(keys, methods, "method", "answer")


def any_error(error: Column, *parts: Column) -> Column:
    out = F.coalesce(F.length(error) > 0, F.lit(False))
    for p in parts:
        out = out | F.coalesce(F.length(p) > 0, F.lit(False))
    return out


def error_summary(names: list[str], most: int = 50) -> Column:
    """Messages of all columns that hold one, each cut to ``most`` characters."""
    said = lambda n: F.when(F.length(F.col(n)) > most, F.concat(F.substring(F.col(n), 1, most), F.lit("..."))).otherwise(F.col(n))
    return F.concat_ws("; ", *[F.when(F.length(F.col(n)) > 0, F.concat(F.lit(f"{n}: "), said(n))) for n in names])


def shown(text: Column, most: int) -> Column:
    """A text for a table: cut to ``most`` characters, dots after a cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def folder_number(ident: Column) -> Column:
    """The number that an id such as ``12/name`` begins with; others last."""
    return F.coalesce(F.regexp_extract(ident, r"^(\d+)/", 1).try_cast("long"), F.lit(1_000_000_000))


def classify(text: Column, keywords: dict[str, list[str]], rest: str) -> Column:
    out = None
    for name, wanted in keywords.items():
        hit = F.lit(False)
        for word in wanted:
            hit = hit | F.lower(text).contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(rest) if out is None else out.otherwise(rest)
