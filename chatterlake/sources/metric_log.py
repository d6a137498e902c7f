"""Saved topic metrics: the text form, one line per topic count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """k, bound, coherence from the lines of a log; other lines are left out."""
    part = lambda i: F.regexp_extract("value", fv.METRIC_LINE_PATTERN, i)
    lines = spark.read.text(path).where(F.col("value").rlike(fv.METRIC_LINE_PATTERN))
    return lines.select(
        part(1).cast("int").alias("k"),
        part(2).cast("double").alias("bound"),
        part(3).cast("double").alias("coherence"),
    )


def latest_run(metrics: DataFrame) -> DataFrame:
    """Of a metric table with run_id and written_at, the rows of the run written last."""
    last = metrics.agg(F.max_by("run_id", "written_at").alias("run_id"))
    return metrics.join(F.broadcast(last), "run_id", "left_semi")
