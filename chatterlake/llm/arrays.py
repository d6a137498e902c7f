"""Texts of an Arrow batch as flat NumPy arrays: words, their hashes, and shingles of words.

A word is a run of characters other than the space and the characters 9 to 13.  All these functions
work on one slice of a few megabytes at a time, so a task's memory does not follow its rows.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SHINGLE = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD6E8FEB86659FD93)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def worker_cache(name: str) -> dict:
    """A dictionary that lasts as long as the Python process.

    Functions travel to the workers by value, so a module's own dictionaries would last one task only.
    """
    holder = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    return holder.__dict__.setdefault(name, {})


def release() -> None:
    """Gives back what earlier tasks left in this process: long tables of powers, and pages that the allocators keep."""
    import ctypes

    worker_cache("powers").clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits (a bijection)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    cache = worker_cache("powers")
    have = cache.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = cache[base] = np.multiply.accumulate(full)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes; equal spans give equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    spread = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(data) + 1)[starts]
    return mix(spread + (ends - starts).astype(np.uint64) * _STEP)


def texts_and_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, or binary values, and each one's offsets; null is empty."""
    texts = pc.fill_null(pc.cast(texts, pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    last = offsets[-1] if len(offsets) else 0
    return data[first:last], offsets - first


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    if not len(batch):
        return
    lengths = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0)
    piece = np.cumsum(lengths.to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(batch)]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


@dataclass
class Words:
    """Word k is data[starts[k]:ends[k]]; text i has the words bounds[i] to bounds[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time; equal words have equal ones everywhere."""
        padded = np.append(self.data, np.zeros(8, np.uint8))
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        at, left = self.starts, self.ends - self.starts
        out = left.astype(np.uint64) * _STEP
        live = slice(None)
        while len(at):
            out[live] = mix(out[live] ^ (eight[at] & _FIRST_BYTES[np.minimum(left, 8)]))
            longer = np.flatnonzero(left > 8)
            live = longer if isinstance(live, slice) else live[longer]
            at, left = at[longer] + 8, left[longer] - 8
        return out


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of all texts; ``lower`` lower-cases A to Z only."""
    data, offsets = texts_and_bytes(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = is_space(data)
    before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    before[1:] = np.append(space[:-1], True) if len(data) else True
    before[1 : len(data)] = space[: len(data) - 1] if len(data) else False
    before[offsets] = True
    after[: len(data)] = np.append(space[1:], True) if len(data) else True
    inner = offsets[(offsets > 0) & (offsets <= len(data))]
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before[: len(data)])
    ends = np.flatnonzero(~space & after[: len(data)]) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words, in text order, and each text's bounds among them.

    A text of fewer words, but at least one, has the whole sequence as its only shingle.
    """
    n_words = np.diff(bounds)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    at = np.repeat(bounds[:-1] - out[:-1], counts) + np.arange(out[-1])
    left = np.repeat(bounds[1:], counts) - at
    padded = np.append(words, np.zeros(width, np.uint64))
    sums = np.zeros(len(at), np.uint64)
    for k in range(width):
        sums = sums * _STEP + np.where(k < left, padded[at + k], _U(0))
    return mix(sums + np.minimum(left, width).astype(np.uint64)), out


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in rising order, and the new bounds."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
    out = np.zeros(len(bounds), np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return np.concatenate(parts) if parts else hashes[:0], out


def binary_array(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per text: its part of the flat array, as bytes."""
    flat = np.ascontiguousarray(flat)
    offsets = pa.py_buffer((bounds * flat.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(flat)])
