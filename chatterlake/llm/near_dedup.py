"""Near-duplicate documents by SetSketch registers.

A document's sketch holds, per register, the smallest of exponential draws over its shingles on a
logarithmic scale of base ``BASE``, cut to one byte.  The smaller of two draws is that of the union, so
sketches of parts merge; equal registers are as likely as the sets are similar.  Documents that share
a band of registers are candidates; the two sketches and the known set sizes give the most likely
similarity, clearly unlike pairs go, and all others are confirmed on their full shingle sets.

Groups of copies may be large, so pairs within a group are never listed as such:

* documents of equal sets are one class and only its smallest id goes on;
* every class is compared with two only: of the smallest classes of its buckets, the smallest one and
  the one it meets most often;
* the links found so far give components, and only buckets that still hold several of them are looked
  at again: if a class there may be linked with another component, it is compared with all of that
  component on full sets, in cells of bounded size.

No link between two classes of a bucket is lost: they end up compared or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm import arrays
from chatterlake.llm.components import components
from chatterlake.llm.storage import stored

BASE = 1.1
RATE = 20.0  # the draws' rate; sets the scale's zero
LIMIT = 255
REGISTERS = 180
MOST_MISSED = 1e-6  # of pairs at exactly the threshold, those that may share no band
PERCENT = 85
LEAST_ESTIMATE_MARGIN = 6.0  # standard deviations below the threshold that a candidate may be estimated
EQUAL_SLACK = 0.08  # a pair with this much fewer equal registers cannot be estimated as high
CELL_PROBES, CELL_ROWS = 400, 800
PAIRS_PER_TARGET = 256
BROADCAST_IDS = 100_000  # eight bytes each

_KEYS = np.random.default_rng(7).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Register value k belongs to draws in (BASE ** -k, BASE ** (1 - k)]; these are those borders as uniform numbers.
_BORDERS = -np.expm1(-RATE * BASE ** -np.arange(LIMIT + 1, dtype=float))


def registers(sets: np.ndarray, bounds: np.ndarray, keys: np.ndarray = _KEYS) -> np.ndarray:
    """One row of registers per non-empty set; bounds must not hold empty sets."""
    out = np.empty((len(bounds) - 1, len(keys)), np.uint8)
    rising = -_BORDERS[1:]
    for i, key in enumerate(keys):
        drawn = sets * key
        drawn ^= drawn >> np.uint64(31)
        drawn *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum.reduceat(drawn, bounds[:-1]).astype(float) * 2.0**-64
        out[:, i] = np.searchsorted(rising, -least, side="right")
    return out


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity under which the two rows of registers are most likely.

    With u and v the sets' shares of n_a + n_b, a register of a is larger with probability
    p(u - v J), smaller with p(v - u J), p(x) = -log_BASE(1 - x (BASE - 1) / BASE).  The likelihood has
    one maximum, found by halving on its slope.
    """
    larger, smaller = (a > b).sum(-1), (a < b).sum(-1)
    equal = a.shape[-1] - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    c, scale = (BASE - 1) / BASE, 1 / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x):
        return np.maximum(-np.log1p(-c * x) * scale, 1e-12)

    for _ in range(24):
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        dx, dy = -v * c * scale / (1 - c * x), -u * c * scale / (1 - c * y)
        slope = larger * dx / p(x) + smaller * dy / p(y) - equal * (dx + dy) / np.maximum(1 - p(x) - p(y), 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def banding(percent: int) -> tuple[int, int]:
    """Bands and registers in each: as long as at the threshold at most ``MOST_MISSED`` of pairs share no band."""
    c = (BASE - 1) / BASE
    equal = 1 + 2 * math.log1p(-c * (1 - percent / 100) / 2) / math.log(BASE)  # of one register, for sets of one size
    fit = [n for n in range(1, 9) if REGISTERS % n == 0 and (1 - max(equal, 0.0) ** n) ** (REGISTERS // n) <= MOST_MISSED]
    rows = max(fit, default=1)
    return REGISTERS // rows, rows


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - LEAST_ESTIMATE_MARGIN * (j * (1 - j) / REGISTERS) ** 0.5


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = arrays.split_words(texts, lower=True)
    return arrays.distinct_sets(*arrays.shingle_hashes(words.hashes(), words.bounds))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            sets, bounds = _sets(part.column("text"))
            sizes = np.diff(bounds)
            full = sizes > 0
            sketches = np.zeros((len(sizes), REGISTERS), np.uint8)
            ids = np.zeros((len(sizes), 2), np.uint64)
            if full.any():
                tight = np.append(bounds[:-1][full], bounds[-1])
                sketches[full] = registers(sets, tight)
                ids[full, 0] = np.add.reduceat(sets, tight[:-1])
                ids[full, 1] = np.add.reduceat(arrays.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), tight[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(sizes, pa.int64()),
                    arrays.binary_array(ids.reshape(-1), np.arange(len(sizes) + 1) * 2),
                    arrays.binary_array(sketches.reshape(-1), np.arange(len(sizes) + 1) * REGISTERS),
                ],
                ["id", "n_shingles", "set_id", "sketch"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            sets, bounds = _sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), arrays.binary_array(sets, bounds)], ["id", "members"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            columns = batch.column("a_members"), batch.column("b_members")
            for i, (one, two) in enumerate(zip(*columns)):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _likely(percent: int):
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (_matrix(batch.column(c)) for c in ("a_sketch", "b_sketch"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("a_n", "b_n"))
            keep = likely_similarity(a, b, n_a, n_b) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def _meet(percent: int):
    """Of one cell: (probe, target) for each probe that may be linked with a row of another component.

    Of two components the smaller one is asked: its row is the probe, the other component the target.
    Two rows that meet in several bands are looked at in the first of them only.
    """
    least = least_estimate(percent)
    fewest = (least - EQUAL_SLACK) * REGISTERS
    n_bands, n_rows = banding(percent)

    def run(rows):
        import pandas as pd

        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), REGISTERS)
        reps, parts, sizes, weights = (rows[c].to_numpy() for c in ("rep", "component", "n_shingles", "weight"))
        probes, others, band = np.flatnonzero(rows["as_probe"]), np.flatnonzero(~rows["as_probe"]), rows["band"].iloc[0]
        found = set()
        for i in probes:
            n = sizes[others]
            fits = (parts[others] != parts[i]) & (100 * np.minimum(n, sizes[i]) >= percent * np.maximum(n, sizes[i]))
            near = others[fits]
            equal = sketches[near] == sketches[i]
            first_band = equal.reshape(-1, n_bands, n_rows).all(2).argmax(1)
            near = near[(equal.sum(1) >= fewest) & (first_band == band)]
            if len(near):
                one = np.broadcast_to(sketches[i], (len(near), REGISTERS))
                likely = likely_similarity(one, sketches[near], np.full(len(near), float(sizes[i])), sizes[near].astype(float))
                for j in near[likely >= least]:
                    asks = (weights[i], -parts[i]) < (weights[j], -parts[j])
                    found.add((reps[i], parts[j]) if asks else (reps[j], parts[i]))
        return pd.DataFrame(list(found), columns=["probe", "target"], dtype="int64")

    return run


def _compare(percent: int):
    """Of one cell: a link for each probe that is similar enough to a member; the sets decide."""

    def run(rows):
        import pandas as pd

        ids = rows["id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["members"]]
        probes, members = np.flatnonzero(rows["as_probe"]), np.flatnonzero(~rows["as_probe"])
        sizes = np.array([len(sets[i]) for i in members])
        flat = np.concatenate([sets[i] for i in members]) if len(members) else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(members)), sizes)[order]
        found = []
        for i in probes:
            low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            counts = high - low
            at = np.repeat(high - np.cumsum(counts), counts) + np.arange(counts.sum())
            shared = np.bincount(owner[at], minlength=len(members))
            linked = np.flatnonzero(100 * shared >= percent * (sizes + len(sets[i]) - shared))
            if len(linked):
                found.append((ids[i], ids[members[linked]].min()))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, members): the shingle sets of the given documents, from their whole texts."""
    ids = stored(ids.distinct(), "wanted-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = docs.join(wanted, "id", "left_semi").mapInArrow(_set_batches, "id long, members binary")
    return stored(sets.dropDuplicates(["id"]), "full-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("members").alias("a_members"))
    two = sets.select(F.col("id").alias("b"), F.col("members").alias("b_members"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "a_members", "b_members")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def _likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    side = lambda s: classes.select(*[F.col(x).alias(f"{s}{y}") for x, y in (("rep", ""), ("n_shingles", "_n"), ("sketch", "_sketch"))])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = both.where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    return fits.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(_likely(percent), "a long, b long")


def _questions(members: DataFrame, labelled: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(probe, target): a class that may be linked with some class of another component, found in a bucket."""
    rows = members.join(labelled, "rep")
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = stored(mixed.where("low < high").select("bucket"), "mixed")
    rows = rows.join(mixed, "bucket").join(classes.select("rep", "n_shingles", "sketch"), "rep")
    rows = stored(rows.select("bucket", "band", "rep", "component", "weight", "n_shingles", "sketch"), "mixed-rows")
    parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    per_bucket = parts.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("rest")
    )
    cells = stored(per_bucket.select("bucket", "largest", *_cells("rest", "n")), "mixed-cells")
    rows = rows.join(cells, "bucket").withColumnRenamed("rep", "id")
    both = _dealt(rows.where("component != largest"), rows, "bucket", "band", "component", "weight", "n_shingles", "sketch")
    both = both.withColumnRenamed("id", "rep")
    cells = _over_all_tasks(both, "bucket")
    return cells.groupBy("bucket", "block", "slice").applyInPandas(_meet(percent), "probe long, target long").distinct()


def _cells(probes: str, rows: str):
    """In how many blocks the probes and in how many slices the rows of a group are cut."""
    return (
        F.ceil(F.col(probes) / CELL_PROBES).cast("int").alias("n_blocks"),
        F.ceil(F.col(rows) / CELL_ROWS).cast("int").alias("n_slices"),
    )


def _dealt(probes: DataFrame, rows: DataFrame, group: str, *values: str) -> DataFrame:
    """Each row of a slice in every block, each probe of a block in every slice: all of them meet once."""
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [group, "block", "slice", "id", *values, "as_probe"]
    as_row = rows.withColumn("slice", pick("n_slices", 1)).withColumn("block", every("n_blocks")).withColumn("as_probe", F.lit(False))
    as_probe = probes.withColumn("block", pick("n_blocks", 2)).withColumn("slice", every("n_slices")).withColumn("as_probe", F.lit(True))
    return as_row.select(columns).union(as_probe.select(columns))


def _over_all_tasks(cells: DataFrame, group: str) -> DataFrame:
    """Cells are few bytes but much work, so they are not joined to tasks by their bytes."""
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(tasks, group, "block", "slice")


def _answers(questions: DataFrame, labelled: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between probes and their targets, each probe compared with the whole target.

    A target with few comparisons is written out as pairs; of a large one, blocks of probes and
    slices of the component meet in cells with their full sets.
    """
    asked = questions.groupBy("target").agg(F.count("*").alias("n_probes"))
    sized = labelled.groupBy("component").agg(F.count("*").alias("n_members"))
    asked = asked.join(sized, F.col("target") == F.col("component")).drop("component")
    large = F.col("n_probes") * F.col("n_members") > PAIRS_PER_TARGET
    asked = stored(asked.withColumn("large", large), "targets")
    members = labelled.join(asked, F.col("component") == F.col("target")).withColumnRenamed("rep", "id")
    members = stored(members.select("target", "id", "n_probes", "n_members", "large"), "target-members")
    probes = stored(questions.join(asked, "target").withColumnRenamed("probe", "id"), "probes")
    sets = _full_sets(members.select("id").union(probes.select("id")), docs)
    pairs = probes.where("NOT large").select("target", F.col("id").alias("x")).join(members.where("NOT large").select("target", F.col("id").alias("y")), "target")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = _confirmed(pairs, sets, percent)
    in_cells = lambda df: df.where("large").select("target", "id", *_cells("n_probes", "n_members")).join(sets, "id")
    cells = _over_all_tasks(_dealt(in_cells(probes), in_cells(members), "target", "members"), "target")
    return links.union(cells.groupBy("target", "block", "slice").applyInPandas(_compare(percent), "a long, b long"))


def _first_pairs(members: DataFrame) -> DataFrame:
    """Each class with two firsts of its buckets: the smallest, and the one it meets in most buckets."""
    met = members.where("rep != first").groupBy("rep", "first").agg(F.count("*").alias("n"))
    best = met.groupBy("rep").agg(
        F.min("first").alias("smallest"), F.max_by("first", F.struct("n", -F.col("first"))).alias("likeliest")
    )
    return best.select(F.explode(F.array_distinct(F.array("smallest", "likeliest"))).alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id, kept for every row of ``docs``.

    A text has its distinct shingles of five words, A to Z lower-cased; with fewer words the whole
    sequence is one shingle.  Texts without words, and null texts, have no shingle and are linked with
    nothing.  Documents with 100 * common >= percent * all shingles are linked.  A row without a key is
    linked with nothing, has no component and is kept.  Rows that share a key are one document with
    several texts.  Other columns are not read; no rows give no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = stored(
        docs.mapInArrow(_sketch_batches, "id long, n_shingles long, set_id binary, sketch binary"), "sketches"
    )
    usable = sketched.where("id IS NOT NULL AND n_shingles > 0")
    grouped = usable.groupBy("set_id", "n_shingles", "sketch").agg(F.min("id").alias("rep"))
    classes = stored(grouped, "classes")

    n_bands, n_rows = banding(percent)
    band = lambda i: F.xxhash64(F.substring("sketch", i * n_rows + 1, n_rows), F.lit(i))
    banded = stored(classes.select("rep", F.posexplode(F.array(*[band(i) for i in range(n_bands)])).alias("band", "bucket")), "bands")
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    members = stored(banded.join(stored(buckets.select("bucket", "first"), "buckets"), "bucket"), "bucket-members")

    first_pairs = stored(_first_pairs(members), "pairs")
    likely = stored(_likely_pairs(first_pairs, classes, percent), "likely")
    sets = _full_sets(likely.select(F.col("a").alias("id")).union(likely.select("b")), docs)
    links = stored(_confirmed(likely, sets, percent), "confirmed")
    reached = components(links)
    labelled = members.select("rep").distinct().join(reached, F.col("rep") == F.col("node"), "left")
    labelled = stored(labelled.select("rep", F.coalesce("component", "rep").alias("component")), "labelled")
    weights = labelled.groupBy("component").agg(F.count("*").alias("weight"))
    weighed = stored(labelled.join(weights, "component"), "weighed")
    questions = stored(_questions(members.select("bucket", "band", "rep"), weighed, classes, percent), "questions")
    if not questions.isEmpty():
        links = links.union(stored(_answers(questions, labelled, docs, percent), "answers"))
        reached = components(links)

    named = classes.join(reached, F.col("rep") == F.col("node"), "left")
    named = stored(named.select("set_id", "n_shingles", F.coalesce("component", "rep").alias("component")), "named")
    joined = sketched.select("id", "n_shingles", "set_id").join(named, ["set_id", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce(component, F.col("id")))
    return joined.select(
        F.col("id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def first_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that near-duplicate removal keeps, with all their columns."""
    found = near_duplicates(docs, key, text, percent)
    gone = stored(found.where("NOT kept").select(F.col(key).alias("__gone")).distinct(), "gone")
    there = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(there, F.col(key) == F.col("__gone"), "left_anti")
