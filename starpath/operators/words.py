"""Word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starpath.functions import text


def count_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(word, cnt)`` over blank-separated words, case kept; counts are combined before the shuffle."""
    words = lines.select(F.explode(text.tokens(F.col(column))).alias("word")).filter(F.col("word") != "")
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def by_count(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), "word")


def top_with_letter(counts: DataFrame, letter: str, size: int = 10) -> DataFrame:
    """The most frequent words with a first letter; on fresh counts the filter reaches below the aggregate."""
    return by_count(counts.filter(text.starts_with_letter(F.col("word"), letter))).limit(size)
