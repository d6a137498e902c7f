"""Benchmark decontamination: MinHash containment search by size classes, then exact containment.

A test item is contained in a document if the document has ``percent`` or more of the item's distinct
shingles of five words.  A document is far longer than an item, so their similarity says nothing; a
MinHash sketch of the item alone does.  The items are dealt to classes by size, doubling from class to
class, and an item's sketch is its K smallest shingle hashes, K from the class's largest size: as many
as the item may miss, and one.  A containing document then has at least one of them (all but the
missed ones, in fact), so the search loses nothing, while documents are probed with a fifth of the
items' hashes.  Candidates are confirmed on all of the item's shingles in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm import arrays
from chatterlake.llm.storage import stored

PERCENT = 80
PROBE_HASHES = 4_000_000  # of eight bytes; more items than that are searched by a join
BROADCAST_IDS = 100_000


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = arrays.split_words(texts, lower=True)
    return arrays.distinct_sets(*arrays.shingle_hashes(words.hashes(), words.bounds))


def _hash_rows(probes):
    """Rows (id, hash) of the texts' distinct shingles; only those among the sorted probes, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if probes is None else probes.value
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                sets, bounds = _sets(part.column("text"))
                owner = np.repeat(np.arange(len(part)), np.diff(bounds))
                if wanted is not None and len(wanted):
                    at = np.minimum(np.searchsorted(wanted, sets), len(wanted) - 1)
                    hit = wanted[at] == sets
                    sets, owner = sets[hit], owner[hit]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(owner)), pa.array(sets.view(np.int64))], ["id", "hash"]
                )

    return run


def _hashes(texts: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """(id, hash) of all texts, or of those hashes among ``probes``.

    Up to ``PROBE_HASHES`` probes every task looks them up in place; more are joined.
    """
    schema = "id long, hash long"
    if probes is None:
        return texts.mapInArrow(_hash_rows(None), schema)
    if probes.count() > PROBE_HASHES:
        return texts.mapInArrow(_hash_rows(None), schema).join(probes, "hash", "left_semi").select("id", "hash")
    context = texts.sparkSession.sparkContext
    known = np.sort(probes.toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
    return texts.mapInArrow(_hash_rows(context.broadcast(known)), schema) if len(known) else probes.selectExpr("hash AS id", "hash")


def sketches(item_hashes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item, hash, n, need): of each item its class's number of smallest hashes.

    ``need`` of them must be in a document that contains the item.
    """
    sizes = item_hashes.groupBy("item").agg(F.count("*").alias("n"))
    miss = lambda n: F.floor(n * F.lit(100 - percent) / 100)
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1).cast("long") - 1
    sizes = sizes.withColumn("k", F.least(miss(top) + 1, "n")).withColumn("need", F.col("k") - miss(F.col("n")))
    ranked = item_hashes.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("hash")))
    return ranked.join(sizes, "item").where("rank <= k").select("item", "hash", "n", "need")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    percent: int = PERCENT,
) -> DataFrame:
    """doc key, item key, n_shared, n_item (shingles) for each item contained in a document.

    Null and empty texts have no shingles: such items are in no document, such documents hold none.
    Items of fewer than five words are one shingle, which only a text of just these words has.  Rows
    without a key are left out; rows that share a key are one text.  Equal items are found each.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    items = items.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL")
    known = stored(_hashes(items).select(F.col("id").alias("item"), "hash").distinct(), "item-hashes")
    sketch = stored(sketches(known, percent), "item-sketches")
    small = known.count() <= PROBE_HASHES // 8
    hint = F.broadcast if small else (lambda df: df)

    found = stored(_hashes(docs, sketch.select("hash").distinct()), "sketch-hits")
    hits = found.distinct().join(hint(sketch), "hash").groupBy("id", "item").agg(F.count("*").alias("hits"), F.first("need").alias("need"))
    candidates = stored(hits.where("hits >= need").select("id", "item"), "candidates")

    ids = candidates.select("id").distinct()
    near = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    wanted = known.join(hint(candidates.select("item").distinct()), "item", "left_semi")
    shared = _hashes(near, stored(wanted.select("hash").distinct(), "wanted")).distinct()
    counted = shared.join(hint(known), "hash").groupBy("id", "item").agg(F.count("*").alias("n_shared"))
    sizes = known.groupBy("item").agg(F.count("*").alias("n_item"))
    exact = counted.join(hint(sizes), "item").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return exact.select(F.col("id").alias(key), F.col("item").alias(item), "n_shared", "n_item")


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; rows without a key stay."""
    gone = stored(leaks(docs, items, key, text, percent=percent).select(F.col(key).alias("__gone")).distinct(), "leaks")
    there = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(there, F.col(key) == F.col("__gone"), "left_anti")
