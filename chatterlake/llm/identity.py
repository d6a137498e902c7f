"""Tells rows that share a key apart.

A row is named by its key and ``twin``: 0 where no other row has the key, else 1, 2 … for the distinct
texts under the key, in the order of their hashes.  Rows equal in key and text have one name.  Only keys
and hashes of rows that share a key are moved to find the names; tables without such rows pay one count
of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.storage import stored
from chatterlake.operators.ranking import numbered

BROADCAST_ROWS = 500_000  # of 24 bytes


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_twins(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with a column ``twin``; the ids are not null.

    Texts of one key whose 64-bit hashes are equal count as one.  A null text is a text of its own.
    """
    shared = stored(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "shared-keys")
    if shared.isEmpty():
        return rows.withColumn("twin", F.lit(0).cast("long"))
    name = F.xxhash64("text", F.col("text").isNull())
    named = rows.select("id", name.alias("name")).join(_small(shared), "id", "left_semi").distinct()
    ranked = stored(numbered(stored(named, "shared-names"), "id", "name"), "ranked-names")
    # numbers go through all keys; a key's own begin at its least one
    firsts = stored(ranked.groupBy("id").agg(F.min("number").alias("first")), "first-names")
    twins = ranked.join(_small(firsts), "id").select("id", "name", (F.col("number") - F.col("first") + 1).alias("twin"))
    twins = stored(twins, "twins")
    named = rows.withColumn("name", name).join(_small(twins), ["id", "name"], "left")
    return named.select(*rows.columns, F.coalesce("twin", F.lit(0).cast("long")).alias("twin"))


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row for each name of rows (id, text, twin): only rows that share a key are grouped."""
    copies = rows.where("twin > 0").dropDuplicates(["id", "twin"])
    return rows.where("twin = 0").union(copies)
