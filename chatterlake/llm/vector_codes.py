"""Codes of vectors: each of a few equal parts is named by the nearest entry of a codebook learnt from all.

Components are whole numbers, so every sum is exact and the result does not depend on how rows are dealt.
The distinct parts of each position, with their counts, lie in lexicographic order over the tasks.  A task
walks the trie of its parts depth-first, a block of leaves at a time: the squared distances of a prefix to
all entries are added up once and shared by all parts that begin with it, and the prefix that a block has
in common with the block before is taken over from there.  Leaves take the nearest entry and add their
weighted components to its sum; the driver gets one sum per entry and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.storage import stored

SCALE = 4096.0
LEAVES = 4096  # leaves of the trie in one block
COMPONENTS_AT_ONCE = 1 << 20
LARGEST = (1 << 63) - 1
BROADCAST_LABELS = 100_000
_LIMB = 10**18  # sums travel in pieces of so many decimal digits, so they may be of any size

Codebooks = list[list[tuple[int, ...]]]


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); 64-bit numbers where the sums below fit them, else Python's integers."""
    floors = np.floor(SCALE * values.astype(np.float64))
    if np.abs(floors).max(initial=0) < _most(floors.shape[-1]):
        return floors.astype(np.int64)
    return np.array([int(x) for x in floors.reshape(-1)], object).reshape(floors.shape)


def _most(n: int) -> float:
    """Components below this have a squared distance over ``n`` of them that fits 64 bits."""
    return 2.0 ** ((62 - max(n, 1).bit_length()) // 2 - 1)


@dataclass
class Walk:
    """A depth-first walk over lexicographically sorted distinct parts, block by block."""

    entries: np.ndarray  # entries x width
    last: np.ndarray | None = None
    path: list[np.ndarray] = field(default_factory=list)  # per depth the distances of the last leaf's prefix

    def block(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, ties to the lower one, and its squared distance."""
        n, width = parts.shape
        shared = 0
        if self.last is not None:
            differ = np.flatnonzero(parts[0] != self.last)
            shared = int(differ[0]) if len(differ) else width
        sums = np.zeros((1, len(self.entries)), parts.dtype)
        node = np.zeros(n, np.int64)  # of each leaf, its prefix at this depth
        begins = np.zeros(n, bool)
        begins[0] = True
        path = []
        for depth in range(width):
            begins[1:] |= parts[1:, depth] != parts[:-1, depth]
            first = np.flatnonzero(begins)
            known = first[: 1 if depth < shared else 0]
            fresh = first[len(known) :]
            step = parts[fresh, depth][:, None] - self.entries[None, :, depth]
            below = sums[node[fresh]] + step * step
            sums = np.concatenate([self.path[depth][None], below]) if len(known) else below
            node = np.cumsum(begins) - 1
            path.append(sums[-1])
        self.last, self.path = parts[-1], path
        nearest = sums.argmin(1) if sums.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in sums])
        return nearest[node], sums[node, nearest[node]]


def walked(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and distances of sorted distinct parts, in blocks."""
    walk = Walk(entries)
    found = [walk.block(parts[at : at + LEAVES]) for at in range(0, len(parts), LEAVES)]
    return np.concatenate([c for c, _ in found]), np.concatenate([d for _, d in found])


def _entries(book: list[tuple[int, ...]], like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and parts in one kind of number that is large enough for both."""
    most = _most(like.shape[1])
    if like.dtype == object or any(abs(x) >= most for e in book for x in e):
        return np.array(book, object).reshape(len(book), -1), like.astype(object)
    return np.array(book, np.int64).reshape(len(book), -1), like


def _pack(parts: np.ndarray) -> tuple[np.ndarray, bool]:
    """Rows of bytes in the order of the parts; ``wide`` ones take eight bytes a component."""
    if parts.dtype != object and np.abs(parts).max(initial=0) < 1 << 31:
        return (parts.astype(np.int64) + (1 << 31)).astype(">u4").view(np.uint8).reshape(len(parts), -1), False
    bits = np.array(parts, np.float64).view(np.uint64)  # floors of doubles are doubles
    bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    return bits.astype(">u8").view(np.uint8).reshape(len(parts), -1), True


def _unpack(rows: np.ndarray, wide: bool, width: int) -> np.ndarray:
    if not wide:
        return rows.view(">u4").reshape(-1, width).astype(np.int64) - (1 << 31)
    bits = rows.view(">u8").reshape(-1, width).astype(np.uint64)
    bits = np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits)
    return np.array([int(x) for x in bits.view(np.float64).reshape(-1)], object).reshape(-1, width)


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dims)


def _cut(vectors: np.ndarray, n_parts: int, width: int) -> np.ndarray:
    """rows x parts x width, zeros behind the last component."""
    padded = np.zeros((len(vectors), n_parts * width))
    padded[:, : vectors.shape[1]] = vectors
    return whole(padded).reshape(len(vectors), n_parts, width)


def _some(batch: pa.RecordBatch, dims: int) -> Iterator[pa.RecordBatch]:
    step = max(COMPONENTS_AT_ONCE // max(dims, 1), 1)
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, v of the rows whose vector is there and has only finite components."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & finite)


def first_vectors(rows: DataFrame, n: int) -> list[list[float]]:
    """The vectors of the ``n`` smallest ids; of several rows of one id the least vector."""
    found: list = []
    left = rows
    while len(found) < n:
        some = left.orderBy(F.asc_nulls_last("id"), "v").limit(n).collect()
        if not some:
            break
        for row in some:
            if len(found) < n and (not found or row.id != found[-1].id):
                found.append(row)
        last = some[-1].id
        if len(some) < n or last is None:
            break
        left = rows.where((F.col("id") > F.lit(last)) | F.col("id").isNull())
    return [row.v for row in found]


def distinct_parts(rows: DataFrame, dims: int, n_parts: int, width: int) -> DataFrame:
    """position, wide, part, n: the distinct parts in lexicographic order over the tasks, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _some(batch, dims):
                cut = _cut(_matrix(some.column("v"), dims), n_parts, width)
                for position in range(n_parts):
                    packed, wide = _pack(np.ascontiguousarray(cut[:, position]))
                    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(position, pa.int32()), len(packed)), pa.repeat(pa.scalar(wide), len(packed)), flat.cast(pa.binary())],
                        ["position", "wide", "part"],
                    )

    parts = rows.select("v").mapInArrow(run, "position int, wide boolean, part binary")
    counted = stored(parts.groupBy("position", "wide", "part").agg(F.count("*").alias("n")), "parts")
    order = ["position", "wide", "part"]
    return stored(counted.repartitionByRange(*order).sortWithinPartitions(*order), "sorted-parts")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """The rows of one position and kind at a time, in their order."""
    if not len(batch):
        return
    kind = batch.column("position").to_numpy() * 2 + batch.column("wide").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1), len(batch)]
    for start, end in zip(cuts, cuts[1:]):
        yield int(kind[start]) // 2, bool(kind[start] % 2), batch.slice(start, end - start)


def _sums(books: Codebooks, width: int):
    """Per entry and component, the sum over its parts, and how many there are (component -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], int] = {}
        walks: dict[tuple[int, str], Walk] = {}
        for batch in batches:
            for position, wide, some in _runs(batch):
                flat = b"".join(some.column("part").to_pylist())
                parts = _unpack(np.frombuffer(flat, np.uint8), wide, width)
                entries, parts = _entries(books[position], parts)
                walk = walks.setdefault((position, parts.dtype.str), Walk(entries))
                n = some.column("n").to_numpy()
                for at in range(0, len(parts), LEAVES):
                    block = parts[at : at + LEAVES]
                    code, _ = walk.block(block)
                    weighted = block.astype(object) * n[at : at + LEAVES, None].astype(object) if _large(block, n) else block * n[at : at + LEAVES, None]
                    sums = np.zeros((len(entries), width), weighted.dtype)
                    np.add.at(sums, code, weighted)
                    counts = np.zeros(len(entries), np.int64)
                    np.add.at(counts, code, n[at : at + LEAVES])
                    for e in np.flatnonzero(counts):
                        for d, x in enumerate([*sums[e], counts[e]]):
                            place = (position, int(e), d if d < width else -1)
                            totals[place] = totals.get(place, 0) + int(x)
        rows = [(*place, limb, Decimal(x)) for place, total in totals.items() for limb, x in enumerate(_limbs(total))]
        columns = list(zip(*rows)) or [[]] * 5
        types = [pa.int32()] * 4 + [pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["position", "entry", "component", "limb", "total"])

    return run


def _large(block: np.ndarray, n: np.ndarray) -> bool:
    """Whether the weighted sums of a block may not fit 64 bits."""
    return block.dtype != object and float(np.abs(block).max(initial=0)) * float(n.sum()) >= 2.0**62


def _limbs(total: int) -> list[int]:
    sign, left, out = (-1 if total < 0 else 1), abs(total), []
    while left or not out:
        left, low = divmod(left, _LIMB)
        out.append(sign * low)
    return out


def refined(parts: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """Each entry moved to the floor of the mean of its parts; entries without parts stay."""
    schema = "position int, entry int, component int, limb int, total decimal(38,0)"
    summed = parts.mapInArrow(_sums(books, width), schema).groupBy("position", "entry", "component", "limb").agg(F.sum("total").alias("total"))
    totals: dict[tuple[int, int, int], int] = {}
    for r in summed.collect():  # parts x entries x (width + 1) rows, and as many again for each 18 digits
        place = (r.position, r.entry, r.component)
        totals[place] = totals.get(place, 0) + int(r.total) * _LIMB**r.limb
    return [
        [
            tuple(totals[p, e, d] // totals[p, e, -1] for d in range(width)) if (p, e, -1) in totals else entry
            for e, entry in enumerate(book)
        ]
        for p, book in enumerate(books)
    ]


def encoded(rows: DataFrame, books: Codebooks, dims: int, width: int) -> DataFrame:
    """id, label, code, error: every vector's entries by position, and its squared distance to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _some(batch, dims):
                cut = _cut(_matrix(some.column("v"), dims), len(books), width)
                codes = np.empty((len(some), len(books)), np.int64)
                errors = np.zeros(len(some), object)
                for position, book in enumerate(books):
                    entries, parts = _entries(book, np.ascontiguousarray(cut[:, position]))
                    packed, _ = _pack(parts)
                    _, at, back = np.unique(_keys(packed), return_index=True, return_inverse=True)
                    code, error = walked(parts[at], entries)
                    codes[:, position] = code[back.reshape(-1)]
                    errors += error[back.reshape(-1)].astype(object)
                text = ["".join(f"{c:02x}" for c in r) for r in codes]
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("label"), pa.array(text, pa.string()), pa.array([min(int(e), LARGEST) for e in errors], pa.int64())],
                    ["id", "label", "code", "error"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def _keys(packed: np.ndarray) -> np.ndarray:
    """Rows of bytes as single values that sort as bytes do."""
    return np.ascontiguousarray(packed).view(np.dtype((np.void, packed.shape[1]))).reshape(-1)


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    n_parts: int = 8, n_entries: int = 16, rounds: int = 6,
) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of every usable row.

    Rows whose vector is null or holds a null or a component that is not finite are dropped.  A component x
    is floor(4096 * x).  Codebooks begin as the parts of the ``n_entries`` smallest keys, at most 256, or of
    as many as there are; ``rounds`` times every part goes to its nearest entry and every entry to the floor
    of the mean of its parts.

    All vectors are as long as that of the smallest key; rows of another length cannot be cut alike and are
    dropped too.  A length that the parts do not divide is filled up with zeros.  Of rows that share a key
    the one with the least vector can begin an entry; all are encoded.  A null key comes after all others.
    Null labels are one label.  An error too large for a long is the largest one.  No usable rows give no
    rows.  Other columns are not read.
    """
    if not 0 < n_entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    rows = usable(vectors, key, vector, label)
    first = first_vectors(rows, 1)
    dims = len(first[0]) if first else 0
    rows = rows.where(F.size("v") == dims)
    width = max(-(-dims // n_parts), 1)
    seeds = first_vectors(rows, n_entries)
    cut = _cut(np.array(seeds, float).reshape(len(seeds), dims), n_parts, width)
    books: Codebooks = [[tuple(int(x) for x in entry) for entry in cut[:, p]] for p in range(n_parts)]
    if seeds:
        parts = distinct_parts(rows, dims, n_parts, width)
        for _ in range(rounds):
            books = refined(parts, books, width)
    found = stored(encoded(rows, books, dims, width), "codes")
    sums = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = stored(sums.select(F.col("label").alias("of"), F.least("total", F.lit(LARGEST)).cast("long").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
