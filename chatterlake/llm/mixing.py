"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every row has a 60-bit hash of its key.  Words are added up by source and by the first 12 bits of the
hash; the bucket in which a source's budget ends is looked at again by its next 12 bits, and so on, so
each look after the first reads one bucket in 4096.  What is left is one threshold per source, and
the mix is a filter: no row is sorted or compared with another.  A larger budget has a larger
threshold, so mixes of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
DIGITS, LEVELS = 12, 5
HASH_BITS = DIGITS * LEVELS
MOST_REPEATS = 3
BROADCAST_SOURCES = 50_000


def word_count(text: Column | str) -> Column:
    """Runs of characters other than the space and the characters 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(key: Column | str) -> Column:
    """60 bits of the key's md5 as a number; a null key hashes like the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> also weight and target; one row per source, so this stays small.

    Weights are 1, 2, 3, repeating, over the sources in code-point order, null last.  A target ends
    at ``repeats`` times the source's size and what is over goes to the others by weight.  In the order
    of size / weight the capped sources come first, so running sums find the level at which the rest
    share.  (The two windows run over one row per source.)
    """
    ranked = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    with_weight = sizes.withColumn("weight", ((ranked - 1) % 3 + 1).cast("long"))
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio, F.asc_nulls_last("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = with_weight.withColumn("cap", F.col("source_size") * F.lit(repeats)).select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(after).alias("sharing"),
        F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    share = (F.col("weight") * (F.col("total") - F.col("capped"))).cast("double") / F.col("sharing")
    over = level.withColumn("over", F.col("cap").cast("double") < share)
    everyone = Window.partitionBy()
    first_free = over.select(
        "*",
        F.min(F.when(~F.col("over"), F.struct("capped", "sharing"))).over(everyone).alias("free"),
    )
    free_share = (F.col("weight") * (F.col("total") - F.col("free.capped"))).cast("double") / F.col("free.sharing")
    target = F.when(F.col("over"), F.col("cap").cast("double")).otherwise(free_share)
    return first_free.select("source", "source_size", "weight", target.alias("target"))


def _boundary(rows: DataFrame, level: int, open_budgets: DataFrame) -> DataFrame:
    """Per source the bucket of this level in which the budget ends, and what is left of it there."""
    bits = HASH_BITS - DIGITS * (level + 1)
    prefix = F.shiftright("hash", bits)
    histogram = rows.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("prefix"))
    summed = _with_source(histogram.withColumn("running", running), open_budgets)
    ends = summed.where(F.col("running") > F.col("budget"))
    found = ends.groupBy("source").agg(F.min_by(F.struct("prefix", "running", "words", "budget"), "prefix").alias("b"))
    return found.select(
        "source",
        F.col("b.prefix").alias("prefix"),
        F.col("b.words").alias("words"),
        (F.col("b.budget") - (F.col("b.running") - F.col("b.words"))).alias("budget"),
    )


def _with_source(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Joins one row per source; null is a source like any other."""
    there = per_source.withColumnRenamed("source", "__source")
    return rows.join(there, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def plan_mix(rows: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target, copies, threshold from source, size and hash of all rows.

    A row is taken ``copies`` times, and once more if its hash is below the threshold.  The row in
    which a budget ends is taken if that brings the source nearer to its target.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, repeats).withColumn(
        "copies",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    )
    budget = F.col("target") - F.col("copies") * F.col("source_size")
    goals = stored(goals.withColumn("budget", budget), "mix-goals")
    small = goals.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)
    edge = stored(_boundary(rows, 0, hint(goals.select("source", "budget"))), "mix-level")
    for level in range(1, LEVELS):
        bits = HASH_BITS - DIGITS * level
        inside = _with_source(rows, hint(edge.select("source", "prefix")))
        rows = inside.where(F.shiftright("hash", bits) == F.col("prefix")).drop("prefix")
        if level == 1:
            rows = stored(rows, "mix-boundary")  # one bucket in 4096: all further looks read this
        edge = stored(_boundary(rows, level, hint(edge.select("source", "budget"))), "mix-level")
    nearer = F.col("words") - F.col("budget") < F.col("budget")
    thresholds = edge.select("source", (F.col("prefix") + nearer.cast("long")).alias("threshold"))
    return _with_source(goals, hint(thresholds), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", repeats: int = MOST_REPEATS) -> DataFrame:
    """All rows with their key, size, source_size, target and the words taken (0: not in the mix).

    Null texts have size 0 and are taken 0 times; null is a source of its own, the last.  Rows of one
    key fall together: all or none take the extra copy.  Other columns are not read.  No rows give no
    rows.
    """
    sized = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), key_hash(key).alias("hash")
    )
    sized = stored(sized, "mix-sizes")
    plan = plan_mix(sized, repeats)
    plan = stored(plan, "mix-plan")
    there = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    copies = F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long")
    return _with_source(sized, there).select(
        F.col("key").alias(key), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", repeats: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: each row of ``docs``, whole, as often as the mix takes it.

    The plan is one row per source, so the rows are read, filtered and repeated in place.
    """
    sized = docs.select(F.col(source).alias("source"), word_count(text).alias("size"), key_hash(key).alias("hash"))
    plan = stored(plan_mix(stored(sized, "mix-sizes"), repeats), "mix-plan")
    there = plan.select(F.col("source").alias("__mix_source"), F.col("copies").alias("__mix_copies"), F.col("threshold").alias("__mix_threshold"))
    there = F.broadcast(there) if plan.count() <= BROADCAST_SOURCES else there
    joined = docs.join(there, F.col(source).eqNullSafe(F.col("__mix_source")))
    times = (F.col("__mix_copies") + (key_hash(key) < F.col("__mix_threshold")).cast("long")).cast("int")
    return joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(c) for c in docs.columns])
