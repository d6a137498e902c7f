"""Word lists: one word per line."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.functions.text import strip
from chatterlake.sources.tables import path_exists


def word_table(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    """The distinct words as a table whose size Spark knows; null is no word."""
    listed = [w for w in dict.fromkeys(words) if w is not None]
    return spark.createDataFrame(pa.table({"word": pa.array(listed, pa.string())}))


def read_words(spark: SparkSession, path: str, default: Iterable[str] = ()) -> DataFrame:
    """The trimmed, non-empty lines as a set; the default list when there is no file."""
    if not path_exists(spark, path):
        return word_table(spark, default)
    lines = spark.read.text(path).select(strip("value").alias("word"))
    return lines.where(F.col("word") != "").distinct()
