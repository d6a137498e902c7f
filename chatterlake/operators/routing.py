"""Which rows need a translation, and what the others get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions.text import is_blank, is_chinese, strip

KEEP, BLANK, COPY, SEND = "keep", "blank", "copy", "send"


def route(source: str, target: str, copy_chinese: bool = True) -> Column:
    """keep: has a translation; blank: nothing to translate; copy: Chinese already; send: the rest.

    The serial form has no Chinese test (``copy_chinese=False``).
    """
    chosen = F.when(~is_blank(target), KEEP).when(is_blank(source), BLANK)
    if copy_chinese:
        chosen = chosen.when(is_chinese(strip(source)), COPY)
    return chosen.otherwise(SEND)


def routed(
    df: DataFrame, source: str, target: str, copy_chinese: bool = True, column: str = "route"
) -> DataFrame:
    """Adds the route and fills the target of every row that needs no request."""
    if target not in df.columns:
        df = df.withColumn(target, F.lit(None).cast("string"))
    filled = (
        F.when(F.col(column) == BLANK, "")
        .when(F.col(column) == COPY, strip(source))
        .when(F.col(column) == KEEP, F.col(target))
    )
    return df.withColumn(column, route(source, target, copy_chinese)).withColumn(target, filled)


def distinct_requests(df: DataFrame, source: str) -> DataFrame:
    """request_key, request, n_rows: each stripped text once.

    Copies are counted on the map side, so a text is moved at most once per map task.
    """
    sent = df.select(strip(source).alias("request"))
    return (
        sent.groupBy("request")
        .agg(F.count("*").alias("n_rows"))
        .select(F.md5("request").alias("request_key"), "request", "n_rows")
    )
