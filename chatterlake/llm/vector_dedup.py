"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, learnt independently on the two halves of unit vectors, span a grid of cells: a vector's
home is the cell of its nearest entry in each half.  From its home a vector goes on to the cells next in
distance, the sum of its squared distances to their two entries, in the order of the multi-sequence
traversal, and stops where the distance is farther than the home's by a margin.  The margin is set so that
of vectors at exactly the similarity asked for, in random directions, the share ``RECALL`` has its home
within it.  Of two vectors the one with the lower home looks for the other, so each pair meets in one cell.
Every pair that meets is verified on its vectors.

Equal vectors of one label are one class and go through the index once.  A cell with many rows is cut into
units of bounded size that hold each pair once.  A unit adds up each class's links and passes on one link
to the smallest class of each group that hangs together there, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm import arrays
from chatterlake.llm.components import components
from chatterlake.llm.storage import stored

SIMILARITY = 0.98
RECALL = 0.995
SAMPLE = 32_768  # distinct vectors, about, that codebooks and margin are learnt from
CELL_ROWS = 64  # rows of a label and cell that the grid is laid out for
MOST_ENTRIES = 1024  # of a codebook; with more vectors cells get fuller
LLOYD_ROUNDS = 10
UNIT_ROWS = 1024  # of each side of a unit
ROWS_AT_ONCE = 4096
BROADCAST_CELLS = 200_000  # sixty bytes each
SLICE_BYTES = 1 << 19
_SEED = 20240613

_PLACE = ["label", "width", "cell"]


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, vec, digest: vec (bytes of its numbers) is null unless it can link with anything."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    number = "float" if kind == "float" else "double"
    v = F.col(vector).cast(f"array<{number}>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fits = v.isNotNull() & fits & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.when(fits, v).alias("v"))
    label_type = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            size = 4 if pa.types.is_float32(v.type.value_type) else 8
            flat = v.flatten()
            data = flat.buffers()[1]
            data = pa.py_buffer(b"") if data is None else data.slice(flat.offset * size, len(flat) * size)
            lengths = v.value_lengths().fill_null(0).to_numpy().astype(np.int64) * size
            offsets = np.zeros(len(v) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            there = pa.array(~v.is_null().to_numpy(zero_copy_only=False)).buffers()[1]
            vec = pa.Array.from_buffers(pa.binary(), len(v), [there, pa.py_buffer(offsets), data])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), vec], ["id", "label", "vec"])

    packed = rows.mapInArrow(run, f"id long, label {label_type}, vec binary")
    return packed.withColumn("digest", F.unhex(F.md5("vec")))


def units(vecs: list[bytes], number: str, dims: int) -> np.ndarray:
    """Unit vectors in double precision, zeros behind the last component."""
    out = np.zeros((len(vecs), dims))
    lengths = np.array([len(v) for v in vecs], np.int64) // np.dtype(number).itemsize
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        some = np.frombuffer(b"".join(vecs[i] for i in rows), number).reshape(len(rows), n).astype(np.float64)
        some /= np.abs(some).max(1)[:, None]  # so that squares neither overflow nor vanish
        out[rows, :n] = some / np.sqrt((some * some).sum(1))[:, None]
    return out


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries."""
    return (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * x @ entries.T


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Each row's nearest entry, some rows at a time."""
    return np.concatenate([distances(x[at : at + ROWS_AT_ONCE], entries).argmin(1) for at in range(0, len(x), ROWS_AT_ONCE)])


def learnt(x: np.ndarray, n_entries: int) -> np.ndarray:
    """A codebook by Lloyd's steps from every so manieth row."""
    entries = x[np.linspace(0, len(x) - 1, n_entries).astype(np.int64)].copy()
    for _ in range(LLOYD_ROUNDS):
        entry = nearest(x, entries)
        order = np.argsort(entry, kind="stable")
        there, first = np.unique(entry[order], return_index=True)
        entries[there] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return entries


@dataclass(frozen=True)
class Grid:
    """The two codebooks and the margin of the traversal."""

    left: np.ndarray
    right: np.ndarray
    margin: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return distances(x[:, :cut], self.left), distances(x[:, cut:], self.right)

    def beyond_home(self, x: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How much farther than its home each row is from the home of its other one."""
        left, right = self.halves(x)
        to_left, to_right = self.halves(other)
        at = np.arange(len(x))
        there = left[at, to_left.argmin(1)] + right[at, to_right.argmin(1)]
        return there - left.min(1) - right.min(1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's home, and (row, cell) of all cells of a higher number within the margin.

        Both halves' entries are taken in rising distance.  A row's step along the left ones allows it so
        many steps along the right ones; all rows take each left step together, and those whose next one
        is beyond the margin have ended.
        """
        left, right = self.halves(x)
        by_left, by_right = np.argsort(left, 1, kind="stable"), np.argsort(right, 1, kind="stable")
        left, right = np.take_along_axis(left, by_left, 1), np.take_along_axis(right, by_right, 1)
        left -= left[:, :1].copy()
        right -= right[:, :1].copy()
        home = by_left[:, 0] * len(self.right) + by_right[:, 0]
        rows, cells = [], []
        live = np.arange(len(x))
        for step in range(left.shape[1]):
            live = live[left[live, step] <= self.margin]
            if not len(live):
                break
            within = right[live] <= self.margin - left[live, step][:, None]
            row, other = np.nonzero(within)
            row = live[row]
            cell = by_left[row, step] * len(self.right) + by_right[row, other]
            higher = cell > home[row]
            rows.append(row[higher])
            cells.append(cell[higher])
        return home, np.concatenate(rows), np.concatenate(cells)


def lay_out(sample: np.ndarray, n_rows: int, similarity: float, recall: float) -> Grid:
    """Codebooks of the sample's halves; the margin from its rows turned to ``similarity`` in random directions."""
    n_entries = int(np.ceil(np.sqrt(max(n_rows, 1) / CELL_ROWS)))
    n_entries = min(max(n_entries, 1), MOST_ENTRIES, len(sample))
    cut = (sample.shape[1] + 1) // 2
    grid = Grid(learnt(sample[:, :cut], n_entries), learnt(sample[:, cut:], n_entries), 0.0)
    rng = np.random.default_rng(_SEED)
    turned = rng.standard_normal(sample.shape)
    turned -= (turned * sample).sum(1)[:, None] * sample
    turned /= np.maximum(np.sqrt((turned * turned).sum(1)), 1e-300)[:, None]
    turned = similarity * sample + np.sqrt(1 - similarity**2) * turned
    steps = range(0, len(sample), ROWS_AT_ONCE)
    beyond = np.concatenate([grid.beyond_home(sample[i : i + ROWS_AT_ONCE], turned[i : i + ROWS_AT_ONCE]) for i in steps])
    return Grid(grid.left, grid.right, float(np.quantile(beyond, recall, method="higher")))


def _index_batches(grid: Grid, number: str, dims: int):
    itemsize = np.dtype(number).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in arrays.slices(batch, "vec", SLICE_BYTES):
                vecs = some.column("vec").to_pylist()
                home, row, cell = grid.visits(units(vecs, number, dims))
                at = np.concatenate([np.arange(len(vecs)), row])
                picked = some.take(pa.array(at))
                width = np.array([len(v) for v in vecs], np.int64)[at] // itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        picked.column("label"), pa.array(width, pa.int32()), pa.array(np.concatenate([home, cell]), pa.int64()),
                        pa.array(np.arange(len(at)) < len(vecs)), picked.column("class_id"), picked.column("n"), picked.column("vec"),
                    ],
                    [*_PLACE, "at_home", "class_id", "n", "vec"],
                )

    return run


def _in_units(indexed: DataFrame) -> DataFrame:
    """The rows with ``row`` and ``column`` of the units they meet in, and their ``side`` there.

    Cells of up to ``UNIT_ROWS`` rows are one unit (side 0: at home, 2: visiting).  Larger ones are cut:
    the rows at home into slices, the visiting ones into blocks.  Unit (i, j), i < j, holds two slices,
    (i, i) one slice alone, and (i, j) below zero the block -i - 1 and the slice j.
    """
    sizes = indexed.groupBy(*_PLACE).agg(F.count("*").alias("n_rows"), F.sum(F.col("at_home").cast("long")).alias("n_home"))
    slices = lambda n: F.ceil(n / UNIT_ROWS).cast("int")
    large = sizes.where(F.col("n_rows") > UNIT_ROWS).select(
        *_PLACE, slices(F.col("n_home")).alias("slices"), slices(F.col("n_rows") - F.col("n_home")).alias("blocks")
    )
    large = stored(large, "large-cells")
    large = F.broadcast(large) if large.count() <= BROADCAST_CELLS else large
    cut = indexed.join(large, _PLACE, "left")
    deal = lambda n, salt: F.pmod(F.xxhash64("class_id", F.lit(salt)), n).cast("int")
    mine = F.when(F.col("at_home"), deal("slices", 1)).otherwise(deal("blocks", 2))
    cut = cut.withColumn("mine", mine)
    unit = lambda i, j, side: F.struct(i.cast("int").alias("row"), j.cast("int").alias("column"), F.lit(side).alias("side"))
    zero, s, b = F.lit(0), F.col("slices"), F.col("blocks")
    every = lambda n: F.sequence(zero, n - 1)
    none = F.array().cast("array<struct<row:int,column:int,side:int>>")
    others = F.transform(
        every(s), lambda k: F.when(k < F.col("mine"), unit(k, F.col("mine"), 1)).when(k > F.col("mine"), unit(F.col("mine"), k, 0)).otherwise(unit(k, k, 0))
    )
    met = F.when(b > 0, F.transform(every(F.greatest(b, F.lit(1))), lambda k: unit(-k - 1, F.col("mine"), 1))).otherwise(none)
    visits = F.transform(every(F.greatest(s, F.lit(1))), lambda k: unit(-F.col("mine") - 1, k, 0))
    of = (
        F.when(s.isNull(), F.array(F.when(F.col("at_home"), unit(zero, zero, 0)).otherwise(unit(zero, zero, 2))))
        .when(F.col("at_home"), F.concat(others, met))
        .when(s > 0, visits)
        .otherwise(none)
    )
    return cut.withColumn("unit", F.explode(of)).select(*_PLACE, "unit.row", "unit.column", "unit.side", "class_id", "n", "vec")


def _labelled(linked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The smallest label that each row reaches over the links of a symmetric matrix."""
    while True:
        reached = np.minimum(labels, np.where(linked, labels[None, :], labels.max()).min(1))
        if (reached == labels).all():
            return labels
        labels = reached


def _unit_links(class_id: np.ndarray, n: np.ndarray, side: np.ndarray, x: np.ndarray, alone: bool, similarity: float):
    """class, links, least of a unit's classes that have a link there: ``least`` is the smallest class of their group."""
    if alone:  # rows at home with each other and with the visiting ones
        wanted = (side[:, None] == 0) | (side[None, :] == 0)
        np.fill_diagonal(wanted, False)
    else:
        wanted = side[:, None] != side[None, :]
    linked = (x @ x.T >= similarity) & wanted
    there = np.flatnonzero(linked.any(1))
    if not len(there):
        return class_id[there], n[there], class_id[there]
    linked = linked[np.ix_(there, there)]
    return class_id[there], linked @ n[there], _labelled(linked, class_id[there])


def _meet(similarity: float, number: str, dims: int):
    """Goes through units that lie in order, one unit in memory at a time."""
    place = [*_PLACE, "row", "column"]

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        unit = pa.Table.from_batches(held).combine_chunks()
        if len(unit) < 2:
            return None
        alone = unit["row"][0].as_py() == unit["column"][0].as_py()
        side = unit["side"].to_numpy()
        x = units(unit["vec"].to_pylist(), number, dims)
        found = _unit_links(unit["class_id"].to_numpy(), unit["n"].to_numpy(), side, x, alone, similarity)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["class_id", "links", "least"]) if len(found[0]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in place)))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if held and keys[start] != last:
                    if (out := links(held)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(start, end - start))
                last = keys[start]
        if held and (out := links(held)) is not None:
            yield out

    return run


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """key, n_links, component_id, kept for every row of ``vectors``.

    Rows of equal labels whose vectors have a cosine of ``similarity`` or more, in double precision, are
    linked.  Codebooks and margin come from a sample of about ``SAMPLE`` distinct vectors by a hash; every row
    is indexed.  No pair below the similarity is linked; of those at it about ``recall`` are found, of closer
    ones more, of equal vectors all.

    A vector that is null, empty, zero or holds a null or a component that is not finite, and a row without
    a label, is linked with nothing and is its own component.  A row without a key is linked with nothing, has
    no component and is kept.  Vectors of different lengths are not compared.  Rows that share a key are
    vectors of their own: each has its own links and component.  No rows give no rows; other columns are not
    read.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector, label), "vectors")
    number = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    grouped = rows.where("vec IS NOT NULL").groupBy("label", "digest", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = stored(grouped.withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    about = classes.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("bytes"), F.countDistinct("label").alias("labels")).first()
    named = classes.select("label", "digest", F.col("rep").alias("component"), (F.col("n") - 1).alias("links"))
    if about.n:
        dims = about.bytes // np.dtype(number).itemsize
        share = F.lit(SAMPLE / about.n)
        chosen = classes.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < share * float(1 << 30))
        sample = chosen.select("vec", "digest").orderBy("digest").limit(2 * SAMPLE).toArrow()["vec"].to_pylist() or [classes.first().vec]
        grid = lay_out(units(sample, number, dims), about.n // max(about.labels, 1), similarity, recall)
        kind = classes.schema["label"].dataType.simpleString()
        schema = f"label {kind}, width int, cell long, at_home boolean, class_id long, n long, vec binary"
        indexed = stored(classes.mapInArrow(_index_batches(grid, number, dims), schema), "cells")
        place = [*_PLACE, "row", "column"]
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = _in_units(indexed).repartition(tasks, *place).sortWithinPartitions(*place)
        links = stored(met.mapInArrow(_meet(similarity, number, dims), "class_id long, links long, least long"), "vector-links")
        reached = components(links.select(F.col("class_id").alias("a"), F.col("least").alias("b")))
        reached = reached.select(F.col("node").alias("class_id"), F.col("component").alias("group"))
        more = links.groupBy("class_id").agg(F.sum("links").alias("more"))
        linked = stored(classes.select("class_id", "rep").join(reached, "class_id").join(more, "class_id"), "linked-classes")
        firsts = linked.groupBy("group").agg(F.min("rep").alias("component"))
        linked = linked.join(firsts, "group").select("class_id", "component", "more")
        named = classes.join(linked, "class_id", "left").select(
            "label", "digest", F.coalesce("component", "rep").alias("component"),
            (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"),
        )
        named = stored(named, "named-classes")
    joined = rows.select("id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
