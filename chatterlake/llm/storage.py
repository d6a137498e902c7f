"""Intermediate tables: written to the shared folder and read back, which cuts the lineage.

A lost executor then costs the tasks of one stage at most; nothing is kept on an executor alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chatterlake.session import shared_folder

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for this run, below one folder per application, so that all can go at once."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/llm-{app}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder; the shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
