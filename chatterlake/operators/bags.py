"""Bags of words and the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions.tokens import bag


def bag_of_words(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, word, n: counted inside each row, without a shuffle."""
    return df.select(key, F.inline(bag(tokens)))


def vocabulary(bags: DataFrame) -> DataFrame:
    """word, term_freq, doc_freq.

    A bag has each word once, so the document frequency is a plain count and needs no distinct.
    """
    return bags.groupBy("word").agg(
        F.sum("n").alias("term_freq"), F.count("*").alias("doc_freq")
    )
