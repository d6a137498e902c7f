"""Rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number for each key, and the key goes to the shard with the best draw.  Keys and
shards are all that decides, so a further shard takes over the keys for which its own draw is the
best and moves no other.  Draws are -ln(u) / weight with u from the key and the shard: the smallest
of such exponential draws falls to each shard in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.storage import stored

DRAW_BITS = 60
ROWS_PER_CELL = 20_000
COPIES_AT_ONCE = 10_000  # places of equal rows that are listed together


def _draw(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DRAW_BITS // 4)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << DRAW_BITS)
    return -F.log(unit) / F.lit(float(weight))


def shard_of(key: Column | str, weights: Mapping[int, float]) -> Column:
    """The shard of a key; a null key counts as the empty text, so all of them share a shard."""
    key = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    draws = [F.struct(_draw(key, s, w).alias("draw"), F.lit(s).alias("shard")) for s, w in weights.items() if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def numbered(rows: DataFrame, key: str, shard: str = "shard", slot: str = "slot", per_cell: int | None = None) -> DataFrame:
    """Adds the place of each row within its shard, from 0 without gaps.

    Equal rows are counted first and travel as one; their places follow each other.  A shard is cut into
    cells by a hash of the whole row; the cells' counts give where each begins, and the distinct rows of a
    cell are numbered by key, then by the other columns.  So a rerun gives each row the same place, also
    where rows share a key or have none, and no cell grows with such rows.  A cell has ``per_cell``
    distinct rows on average at any size.
    """
    per_cell = per_cell or ROWS_PER_CELL
    order = [key, *[c for c in rows.columns if c != key]]
    distinct = stored(rows.groupBy(*order).agg(F.count("*").alias("__n")), "distinct-rows")
    n_cells = max(1, distinct.count() // (per_cell * max(1, distinct.select(shard).distinct().count())))
    celled = distinct.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(n_cells)))
    counts = celled.groupBy(shard, "__cell").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select(shard, "__cell", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")), "cells")
    earlier = F.sum("__n").over(Window.partitionBy(shard, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = celled.withColumn("__place", F.coalesce(earlier, F.lit(0))).join(starts, [shard, "__cell"])
    first = F.col("__start") + F.col("__place")
    placed = placed.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
    last = F.least(F.col("__from") + COPIES_AT_ONCE, "__n") - 1
    return placed.select(*rows.columns, F.explode(F.sequence(first + F.col("__from"), first + last)).alias(slot))


def assign(
    docs: DataFrame,
    weights: Mapping[int, float],
    grown: Mapping[int, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    law: str = "key",
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row.

    Size is the text's UTF-8 bytes plus 16; null text has none, its checksum is 0.  Rows with the same
    key are in the same shard, each with a slot of its own: by size and checksum of the text, rows that are
    equal in these as they come.  No rows give no rows.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(key),
        (F.length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit(law).alias("law"),
        shard_of(key, weights).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return numbered(stored(narrow, "shards"), key)
