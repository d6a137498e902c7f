"""Word frequencies and stop words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions.text import col, drop_noise
from chatterlake.functions.tokens import cloud_word, segment
from chatterlake.sources.words import word_table


def stop_word_union(base: DataFrame, user: DataFrame) -> DataFrame:
    return base.select("word").union(user.select("word")).distinct()


def without_words(df: DataFrame, words: Iterable[str] | DataFrame, column: str = "word") -> DataFrame:
    """Rows whose word is not in the set; a null word is in no set.

    One left anti join for every size of the set; Spark picks its strategy by the table's size.
    """
    if not isinstance(words, DataFrame):
        words = word_table(df.sparkSession, words)
    return df.join(words.select(F.col("word").alias(column)), column, "left_anti")


def word_counts(
    df: DataFrame,
    text: str,
    stop_words: Iterable[str] | DataFrame = fv.CLOUD_STOP_WORDS,
    tokens: Column | None = None,
    keys: Iterable[str] = (),
) -> DataFrame:
    """word, freq over all texts (per ``keys`` if given), without stop words.

    Stop words are taken out after counting: there each word is one row, so the join is as small
    as the vocabulary and has no hot key, however often a stop word occurs in the text.
    """
    keys = list(keys)
    cut = segment(drop_noise(col(text))) if tokens is None else tokens
    raw = df.where(F.col(text).isNotNull()).select(*keys, F.explode(cut).alias("token"))
    words = raw.select(*keys, cloud_word("token").alias("word")).where(F.col("word").isNotNull())
    counted = words.groupBy(*keys, "word").agg(F.count("*").alias("freq"))
    return without_words(counted, stop_words)


def by_frequency(counts: DataFrame) -> DataFrame:
    """Most frequent first, equal ones in code-point order."""
    return counts.orderBy(F.desc("freq"), F.asc("word"))


def top_words(counts: DataFrame, n: int) -> DataFrame:
    return by_frequency(counts).limit(n)
