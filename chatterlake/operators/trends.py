"""Daily trends.

One aggregation gives every figure, so each day travels once per map task however many rows it has.
The label columns are listed, not discovered: that saves the pass a pivot would make to find them
and keeps the schema the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv

LABEL_COLUMNS = tuple(sorted((*fv.LABELS, fv.UNKNOWN)))


def _by_day(df: DataFrame, day: Column, *figures: Column) -> DataFrame:
    """Rows without a day belong to no group and are dropped."""
    dated = df.withColumn("day", day).where(F.col("day").isNotNull())
    return dated.groupBy("day").agg(*figures)


def rows_per_day(df: DataFrame, day: Column) -> DataFrame:
    return _by_day(df, day, F.count("*").alias("n"))


def labels_per_day(
    df: DataFrame, day: Column, label: str = "sentiment", labels: Sequence[str] = LABEL_COLUMNS
) -> DataFrame:
    """One column per label, 0 where a day lacks it; a day without any label does not appear."""
    counts = [F.count_if(F.col(label) == name).alias(name) for name in labels]
    return _by_day(df.where(F.col(label).isNotNull()), day, *counts)


def average_per_day(df: DataFrame, day: Column, score: str = "score", decimals: int | None = None) -> DataFrame:
    """Mean score over the rows that have one; a day without scores stays, as null."""
    mean = F.avg(score)
    mean = mean if decimals is None else F.round(mean, decimals)
    return _by_day(df, day, mean.alias("avg_score"))


def daily_trends(
    df: DataFrame,
    day: Column,
    label: str = "sentiment",
    score: str = "score",
    labels: Sequence[str] = LABEL_COLUMNS,
    decimals: int | None = None,
) -> DataFrame:
    """Rows, labels and mean score per day from one pass over the rows."""
    mean = F.avg(score)
    return _by_day(
        df,
        day,
        F.count("*").alias("n"),
        *[F.count_if(F.col(label) == name).alias(name) for name in labels],
        (mean if decimals is None else F.round(mean, decimals)).alias("avg_score"),
    )
