"""Rows of one label, and summaries of what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv


def with_label(df: DataFrame, value: str, label: str = "sentiment") -> DataFrame:
    return df.where(F.col(label) == value)


def labelled(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """Rows that belong to one of the three splits; unknown and null labels belong to none."""
    return df.where(F.col(label).isin(*fv.LABELS))


def is_pending(label: str = "sentiment", score: str = "score"):
    return F.col(label).isNull() | F.col(score).isNull()


def pending(df: DataFrame, label: str = "sentiment", score: str = "score") -> DataFrame:
    return df.where(is_pending(label, score))


def run_summary(df: DataFrame, label: str = "sentiment", score: str = "score") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.count_if(is_pending(label, score)).alias("to_do")
    )
