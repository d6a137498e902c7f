"""Draws documents that look like a target collection, by importance weights of hashed features.

Features are runs of words; a feature's bucket is the CRC-32 of its bytes, modulo the number of buckets.
The CRC of all features of a slice of text is worked out at once.  CRC-32 is linear in the bytes: a byte's
contribution depends only on its value and its distance from the feature's end, so one table of these is
looked up for every byte and the contributions of a feature are XORed together with
``bitwise_xor.reduceat``; a constant by length accounts for the register's start and end values.  Features
longer than the table are cut from their end into blocks of the table's reach; neighbouring blocks are
folded in pairs, the left one moved on by the length of the right one, until one is left.

The features of a document are hashed once: their buckets are kept as a table, which gives the counts of
all documents, and then each document's weight.  Documents are ranked by range of their score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm import arrays
from chatterlake.llm.storage import stored
from chatterlake.operators.ranking import numbered

REACH = 64  # bytes that the position table covers, a power of two
_REACH_POWER = REACH.bit_length() - 1
_ONES = np.uint32(0xFFFFFFFF)
_REFLECTED = 0xEDB88320  # fixed value: the polynomial of CRC-32
FEATURE_BYTES = 4 << 20  # bytes of features that are hashed at a time

Operator = np.ndarray  # four tables of 256: what each byte of a register becomes
_LANES = np.arange(4)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_REFLECTED), table >> 1).astype(np.uint32)
    return table


_BYTE = _byte_table()


def _one_byte_on(register: np.ndarray) -> np.ndarray:
    return (register >> np.uint32(8)) ^ _BYTE[register & np.uint32(255)]


def _apply(operator: Operator, register: np.ndarray) -> np.ndarray:
    out = np.zeros_like(register)
    for lane in _LANES:
        out ^= operator[lane][(register >> np.uint32(8 * lane)) & np.uint32(255)]
    return out


def _position_table() -> np.ndarray:
    rows = [_BYTE]
    for _ in range(REACH - 1):
        rows.append(_one_byte_on(rows[-1]))
    return np.stack(rows)


#: Row d, column b: what a byte b adds when d bytes of the feature come after it.
POSITIONS = _position_table()
_FLAT = POSITIONS.reshape(-1)
_OPERATORS = [np.stack([_one_byte_on(np.arange(256, dtype=np.uint32) << np.uint32(8 * lane)) for lane in _LANES])]


def _moved_by(power: int) -> Operator:
    """Moves a register on by 2 ** power bytes."""
    while len(_OPERATORS) <= power:
        last = _OPERATORS[-1]
        _OPERATORS.append(np.stack([_apply(last, last[lane]) for lane in _LANES]))
    return _OPERATORS[power]


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """What the start value of the register has become after so many bytes, with the final complement."""
    out = np.full(len(lengths), _ONES)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        moved = np.flatnonzero(lengths >> power & 1)
        out[moved] = _apply(_moved_by(power), out[moved])
    return out ^ _ONES


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _block_sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The XOR of the contributions of spans of 1 to ``REACH`` bytes."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    at = _ranges(starts, lengths)
    distance = np.repeat(starts + lengths - 1, lengths) - at
    return np.bitwise_xor.reduceat(_FLAT[distance * 256 + data[at]], np.cumsum(lengths) - lengths)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of the bytes; spans may overlap, but none is empty."""
    lengths = ends - starts
    blocks = (lengths + REACH - 1) // REACH
    owner = np.repeat(np.arange(len(starts)), blocks)
    from_end = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(owner))
    block_end = ends[owner] - from_end * REACH
    block_start = np.maximum(block_end - REACH, starts[owner])
    sums = _block_sums(data, block_start, block_end - block_start)
    power = _REACH_POWER
    while len(owner) > len(starts):
        left = np.flatnonzero(from_end & 1)
        sums[left] = _apply(_moved_by(power), sums[left])
        from_end >>= 1
        begins = np.ones(len(owner), bool)
        begins[1:] = (owner[1:] != owner[:-1]) | (from_end[1:] != from_end[:-1])
        begins = np.flatnonzero(begins)
        sums, owner, from_end = np.bitwise_xor.reduceat(sums, begins), owner[begins], from_end[begins]
        power += 1
    return sums ^ length_constants(lengths)


#: Bytes of a word: digits, letters, and all bytes of characters beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def joined_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends, bounds: the words of all texts with A to Z lower-cased, one space after each.

    Word k is ``data[starts[k]:ends[k]]``; text i has the words ``bounds[i]`` to ``bounds[i + 1]``.
    """
    data, offsets = arrays.texts_and_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends where its text ends
    begins[edges] |= inside[1:-1][edges]
    stops[edges - 1] |= inside[1:-1][edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    bounds = np.searchsorted(first, offsets)
    lengths = last - first
    ends = np.cumsum(lengths + 1) - 1 if len(first) else first
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    joined[_ranges(ends - lengths, lengths)] = data[inside[1:-1]]
    return joined, ends - lengths, ends, bounds


def feature_buckets(texts: pa.Array, shortest: int, longest: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features text by text, each text's bounds among them, and its number of words."""
    data, starts, ends, bounds = joined_words(texts)
    n_words = np.diff(bounds)
    text = np.repeat(np.arange(len(n_words)), n_words)
    found, owners = [], []
    for width in range(shortest, longest + 1):
        first = np.arange(max(len(starts) - width + 1, 0))
        first = first[text[first] == text[first + width - 1]]
        span = ends[first + width - 1] - starts[first]
        piece = np.cumsum(span) // FEATURE_BYTES
        for one in np.split(first, np.flatnonzero(np.diff(piece)) + 1):
            if len(one):
                found.append(crc32_spans(data, starts[one], ends[one + width - 1]) % np.uint32(n_buckets))
        owners.append(text[first])
    owner = np.concatenate(owners)
    buckets = np.concatenate(found) if found else np.zeros(0, np.uint32)
    order = np.argsort(owner, kind="stable")
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(np.bincount(owner, minlength=len(n_words)), out=out[1:])
    return buckets[order], out, n_words


def hashed(docs: DataFrame, key: str, text: str, shortest: int, longest: int, n_buckets: int) -> DataFrame:
    """id, n_words, n_features, buckets (32-bit numbers as bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in arrays.slices(batch, "text"):
                buckets, bounds, n_words = feature_buckets(some.column("text"), shortest, longest, n_buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("id"), pa.array(n_words, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                        arrays.binary_array(buckets.astype("<u4"), bounds),
                    ],
                    ["id", "n_words", "n_features", "buckets"],
                )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(run, "id long, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(features: DataFrame, n_buckets: int) -> np.ndarray:
    """How many features each bucket holds; a task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_buckets, np.int64)
        for batch in batches:
            data, _ = arrays.texts_and_bytes(batch.column("buckets"))
            sums += np.bincount(data.view("<u4"), minlength=n_buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(sums[there])], ["bucket", "n"])

    counted = features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # a row per bucket at most
    out = np.zeros(n_buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth of its unit: how much likelier a bucket is in the target than in the source, one added to each."""
    n = len(source)
    above, below = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * above / ((float(s) + 1) * below))) for s, t in zip(source, target)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight: the sum of the gains of a row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.texts_and_bytes(batch.column("buckets"))
            sums = np.zeros(len(data) // 4 + 1, np.int64)
            np.cumsum(gain[data.view("<u4")], out=sums[1:])
            weight = sums[offsets[1:] // 4] - sums[offsets[:-1] // 4]
            columns = [batch.column(c) for c in ("id", "n_words", "n_features")] + [pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def draw(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_key: str = "item_id",
    target_text: str = "text",
    shortest: int = 1,
    longest: int = 1,
    n_buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
) -> DataFrame:
    """key, n_features, weight, score, rank for every row of ``docs``.

    ``percent`` of the rows with ``least_words`` words or more are drawn without replacement: those of the
    highest weight plus Gumbel noise, which follows the key alone; ties go to the smaller key.  ``rank`` is
    1, 2, 3 … for drawn rows, else null.

    A text that is null, empty or without words has no features and weight 0; its noise is as for any
    other.  A key that is null counts as an empty text in the noise and comes last among ties.  Rows that
    share a key share their noise and are ranked apart.  An empty target gives each bucket the same count;
    no rows give no rows.  Other columns are not read.
    """
    features = hashed(docs, key, text, shortest, longest, n_buckets)
    wanted = hashed(target, target_key, target_text, shortest, longest, n_buckets)
    rows = weighed(features, gains(bucket_counts(features, n_buckets), bucket_counts(wanted, n_buckets)))
    drawn = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chance = (F.conv(F.substring(F.sha2(drawn, 256), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    rows = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(chance))))
    rows = stored(rows.withColumn("eligible", F.col("n_words") >= least_words), "scores")
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    most = rows.where("eligible").count() * percent // 100
    rank = F.when(F.col("eligible") & (F.col("number") < most), F.col("number") + 1)
    return numbered(rows, *order).select(F.col("id").alias(key), "n_features", "weight", "score", rank.alias("rank"))
