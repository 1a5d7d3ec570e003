"""Quality rules: a threshold table compiled into one Spark projection.

No user function runs: words, windows and lines are arrays, and every metric
is a built-in expression over them. One pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, table, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent function words; each as written and with a capital initial.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "le la les de des du et un une en que qui pour dans par sur avec est au ce pas plus "
    "der die das und von zu den mit ist des dem nicht ein eine sich auf für als auch "
    "el los las y del que se una por con para su es lo como más al no"
).split()

#: (metric, least, most); None leaves a side open. A document keeps its place
#: if every metric lies inside its bounds.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.10),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.50),
    ("bullet_line_ratio", None, 0.90),
    ("ellipsis_line_ratio", None, 0.50),
)


def _covered(ws: Column) -> Column:
    """Words inside windows that occur twice, by sorting the windows themselves."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)),
        lambda i: F.struct(F.array_join(F.slice(ws, i, WINDOW), " ").alias("w"), i.alias("p")),
    )

    def positions(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["w"] == F.get(s, k)["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["p"]))

    # Ascending starts: each window adds the words that the one before left uncovered.
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(let(F.sort_array(windows), positions), start, step)["n"]


def repeated_words(ws: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text.

    Hashes of the windows settle the usual case, a text without repeats:
    distinct hashes prove distinct windows. Otherwise the windows themselves
    are sorted and compared, so the count is exact.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    return F.when(F.size(ws) <= WINDOW, 0).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(ws)))
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measure(text: Column) -> Column:
    """A struct of counts and ratios of one text; null counts as empty.

    Words and lines are bound once: whatever reads several fields of the
    struct, a filter too, does not split the text again.
    """
    body = F.coalesce(text, F.lit(""))
    stop = sorted({*STOP_WORDS, *(w[0].upper() + w[1:] for w in STOP_WORDS)})
    has_word = r"[^\x20\x09-\x0D]"
    from_words = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.size(F.filter(ws, lambda w: F.regexp_replace(w, r"[.,;:!?]+$", "").isin(stop))).cast("long").alias("n_stop_words"),
            repeated_words(ws).cast("long").alias("n_repeat_words"),
        ),
    )
    from_lines = let(
        F.filter(F.split(body, "\n"), lambda x: x.rlike(has_word)),
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(ls, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09]*$"))).cast("long").alias("n_ellipsis_lines"),
        ),
    )
    counted = F.struct(
        from_words.alias("w"),
        from_lines.alias("l"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )

    def ratios(m: Column) -> Column:
        w, ln, n, chars, symbols = m["w"], m["l"], m["w"]["n_words"], m["word_chars"], m["n_symbols"]
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            symbols.alias("n_symbols"),
            ln["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            _share(chars, n).alias("mean_word_chars"),
            _share(symbols, n).alias("symbol_ratio"),
            _share(w["n_stop_words"], n).alias("stop_word_ratio"),
            _share(ln["n_dup_lines"], ln["n_lines"]).alias("dup_line_ratio"),
            _share(ln["n_bullet_lines"], ln["n_lines"]).alias("bullet_line_ratio"),
            _share(ln["n_ellipsis_lines"], ln["n_lines"]).alias("ellipsis_line_ratio"),
        )

    return let(counted, ratios)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def verdict(q: Column, thresholds=THRESHOLDS) -> Column:
    """The table as one boolean expression: true if every metric is in bounds."""
    out = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            out &= q[name] >= least
        if most is not None:
            out &= q[name] <= most
    return out


def score_quality(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``df`` with ``quality`` (struct), ``base_failed`` and ``kept``.

    Null and empty texts fail for want of words. Rows are judged one by one,
    so repeated rows get equal verdicts and an empty table stays empty. Other
    columns pass through; those of the three names are replaced.
    """
    judge = lambda q: F.struct(q.alias("quality"), base_failed(q).alias("base_failed"), (~base_failed(q) & verdict(q, thresholds)).alias("kept"))
    held = free_name(df, "judged")
    found = df.withColumn(held, let(measure(F.col(text)), judge))
    return found.withColumns({c: F.col(f"{held}.{c}") for c in ("quality", "base_failed", "kept")}).drop(held)


def filter_quality(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``df`` that pass, with the columns of ``df``."""
    return df.filter(let(measure(F.col(text)), lambda q: ~base_failed(q) & verdict(q, thresholds)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios, base_failed and kept, for every row of ``documents``.

    Null and empty texts have no words and fail. Repeated rows repeat. No
    documents, no rows.
    """
    q = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ratios = ("mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in counts], "base_failed", "kept", *[F.round(f"quality.{c}", 6).alias(c) for c in ratios])
