"""Left join of many rows to a table with one row per key, safe against hot keys.

Adaptive skew handling does not reach this join: the lookup side usually comes out of an
aggregation on the same key, Spark reuses that partitioning, and partitions that feed a join through
an aggregate are not split.  So hot keys are salted here, by their exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000
NULL_SALTS = 1 << 20


def hot_keys(df: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """key, __salts for keys with more rows than one task should get.

    There are at most (rows of df / rows_per_salt) such keys: 100,000 of them, a few megabytes, for
    10^11 rows.  Counts are combined on the map side.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > rows_per_salt).select(
        key, F.ceil(F.col("n") / F.lit(rows_per_salt)).cast("int").alias("__salts")
    )


def lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: Sequence[str],
    rows_per_salt: int = ROWS_PER_SALT,
    hot: DataFrame | None = None,
) -> DataFrame:
    """df left join table on ``key``; ``table`` has one row per key, so no row is added or lost.

    Rows of a hot key are spread over its salts by a hash of ``spread_by`` (columns that tell the
    rows apart), and that key's lookup row is repeated once per salt.  Rows without a key match
    nothing; they are spread too, or they would all meet in one task.
    """
    hot = F.broadcast(hot_keys(df, key, rows_per_salt) if hot is None else hot)
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    spread_over = F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(salts).cast("long")
    left = df.join(hot, key, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*spread_by), spread_over).cast("int")
    )
    right = table.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    joined = left.drop("__salts").join(right.drop("__salts"), [key, "__salt"], "left")
    return joined.drop("__salt").select(*df.columns, *[c for c in table.columns if c != key])
