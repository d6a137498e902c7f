"""Identity and order for tables that have no key column, from where each row is stored.

An id is one whole number: the number of the row's file, in the order of paths, above its place in the file.
So ids rise in the order of files and rows, do not follow how the scan is split, and stay the same as
long as the files do.  Every operator that takes a key or order column takes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.operators.ranking import numbered
from chatterlake.sources import csv_splits
from chatterlake.storage import stored

PLACE_BITS = 44  # rows, or bytes, of one file
MOST_FILES = 1 << 63 - PLACE_BITS
BROADCAST_FILES = 100_000  # paths and numbers


def _with_ids(df: DataFrame, file: Column, place: Column, into: str) -> DataFrame:
    """``df``, whose columns begin with ``__`` go, with ``into`` first."""
    rest = [c for c in df.columns if not c.startswith("__")]
    if into in rest:
        raise ValueError(f"the table has a column {into} of its own")
    files = stored(numbered(df.select(file.alias("__path")).distinct(), "__path", into="__file"), "files")
    n_files = files.count()
    if n_files > MOST_FILES:
        raise ValueError(f"{n_files} files; row ids hold {MOST_FILES}")
    files = F.broadcast(files) if n_files <= BROADCAST_FILES else files
    row_id = F.shiftleft("__file", PLACE_BITS) + place
    return df.withColumn("__path", file).join(files, "__path").select(row_id.alias(into), *rest)


def read_table_with_ids(spark: SparkSession, path: str, into: str = "row_id", **options) -> DataFrame:
    """Parquet rows with their ids as the first column; no rows give no rows."""
    df = spark.read.options(**options).parquet(path)
    df = df.select("*", F.col("_metadata.file_path").alias("__from"), F.col("_metadata.row_index").alias("__nth"))
    return _with_ids(df, F.col("__from"), F.col("__nth"), into)


def read_csv_with_ids(spark: SparkSession, path: str, into: str = "row_id", **options) -> DataFrame:
    """CSV rows with their ids as the first column, read by ``csv_splits.read_large_csv``.

    A row's place is the split's first byte plus the row's number within the split, which is below the
    number of its bytes; ids are the same again with the same ``split_bytes``.
    """
    df = csv_splits.read_large_csv(spark, path, place="__place", **options)
    return _with_ids(df, F.col("__place.file"), F.col("__place.split") + F.col("__place.row"), into)
