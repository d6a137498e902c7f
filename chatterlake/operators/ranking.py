"""Numbers for all rows of a table in a given order, without bringing them together.

The rows are dealt by ranges of the order and sorted within each; a row's number is the number of
rows of the ranges before its own plus its place there.  Only one count per range is brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.storage import stored

_PLACE_BITS = 33  # monotonically_increasing_id holds the partition above these bits and the row below them


def numbered(df: DataFrame, *order: Column | str, into: str = "number") -> DataFrame:
    """``df`` with a column ``into``: 0, 1, 2 … in the given order.

    Rows that tie in every ordering column are numbered in any order among themselves, so name enough
    columns to tell apart what must be.  The ranges are sampled, so ``df`` is read twice: hand it a
    table.  The numbers do not depend on how many ranges there are.  No rows give no rows.
    """
    at = f"__at_{into}"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = stored(placed, "numbered")
    part = F.shiftright(at, _PLACE_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))  # one row per range
    place = F.col(at).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    both = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return both.withColumn(into, F.col("__start") + place).drop(at, "__part", "__start")
