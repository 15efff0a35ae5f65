"""Numeric features of a text, all of them built-in expressions inside codegen.

Every feature is defined for null and empty texts (they count as a text of no
characters) and uses the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.llm.common import table, words

#: Labelled rows that a model is fitted on; the rows with the least hash of doc_id are taken.
FIT_ROWS = 20_000


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _times(text: Column, ascii_text: str) -> Column:
    """How often a fixed ASCII text occurs, without overlap: bytes lost when it is taken out."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(ascii_text), F.lit("")))).cast("double") / len(ascii_text)


def text_features(text: Column) -> dict[str, Column]:
    """Feature name -> expression over the text column."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n_words = F.greatest(words(t), F.lit(1)).cast("double")
    n_chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    return {
        "log_words": F.log1p(words(t).cast("double")),
        "word_length": n_chars / n_words,
        "shouted": _times(t, "!!") / n_words,
        "capitals": _count(t, "\\p{Lu}{2,}") / n_words,
        "symbol_runs": _count(t, "[#$%&*=~^]{2,}") / n_words,
        "bars": _times(t, "|") / n_words,
        "echoes": _count(t, "(?<![^ \\n])([^ \\n]+) \\1(?![^ \\n])") / n_words,
        "digits": _count(t, "[0-9]+") / n_words,
        "line_repeats": F.lit(1.0) - F.size(F.array_distinct(lines)) / F.size(lines),
        "stops": _times(t, ".") / n_words,
        "commas": _times(t, ",") / n_words,
    }


NAMES = [
    "log_words", "word_length", "shouted", "capitals", "symbol_runs", "bars", "echoes", "digits", "line_repeats", "stops", "commas",
]


def labelled_features(spark: SparkSession, docs: DataFrame, sf_dir: str, target: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Features and label (0 or 1) of a bounded, deterministic sample of labelled documents.

    The sample is the fit_rows labels of least (hash of doc_id, doc_id); only
    these documents' features are computed. Labels other than 0 and 1 and null
    ids are left out.
    """
    labels = table(spark, sf_dir, "labels").filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
    sample = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(target).cast("int").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"))
    joined = own.join(F.broadcast(sample), "__id")  # at most fit_rows rows
    return joined.select("label", *(c.alias(k) for k, c in text_features(F.col("__text")).items()))
