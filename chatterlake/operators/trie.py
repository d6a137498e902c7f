"""A dictionary as a trie of two arrays, matched at all places of a batch of texts together.

Nodes are numbered by depth, then by prefix.  An edge is one number, its node above its character; edges in
rising order lead to the nodes 1, 2, 3, ..., so the sorted edges are all there is to walk by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHAR_BITS = 21
SLICE_BYTES = 1 << 20


def code_points(data: np.ndarray) -> np.ndarray:
    """The characters of valid UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of strings without nulls, and the bounds of each string among them."""
    strings = strings.cast(pa.string())
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _starts(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


@dataclass(frozen=True)
class Trie:
    edges: np.ndarray
    is_word: np.ndarray  # by node

    @classmethod
    def of(cls, words: pa.Array) -> Trie:
        words = words.cast(pa.string()).unique()
        words = words.take(pc.sort_indices(words))  # by bytes, which is by characters
        data, bounds = flat(words)
        chars = code_points(data).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(_starts(data))])[bounds]
        start, length = bounds[:-1], np.diff(bounds)
        edges, ends, at, node, nodes = [], [np.zeros(1, bool)], np.flatnonzero(length), np.zeros(len(length), np.int64), 1
        depth = 0
        while len(at):
            key = (node[at] << CHAR_BITS) | chars[start[at] + depth]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            child = np.cumsum(new) - 1
            edges.append(key[new])
            is_word = np.zeros(len(edges[-1]), bool)
            is_word[child[length[at] == depth + 1]] = True
            ends.append(is_word)
            node[at] = nodes + child
            nodes += len(is_word)
            depth += 1
            at = at[length[at] > depth]
        return cls(np.concatenate([np.zeros(0, np.int64), *edges]), np.concatenate(ends))

    def longest(self, chars: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Length of the longest word that begins at each character and does not pass ``end``; 0 if there is none."""
        out = np.zeros(len(chars), np.int64)
        if not len(self.edges):
            return out
        at, node, depth = np.flatnonzero(end > np.arange(len(chars))), None, 0
        node = np.zeros(len(at), np.int64)
        while len(at):
            key = (node << CHAR_BITS) | chars[at + depth]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            there = self.edges[edge] == key
            at, node = at[there], edge[there] + 1
            depth += 1
            out[at[self.is_word[node]]] = depth
            more = at + depth < end[at]
            at, node = at[more], node[more]
        return out


def _taken(length: np.ndarray) -> np.ndarray:
    """The places of matches from left to right, without those that begin within an earlier one."""
    places = np.flatnonzero(length)
    out, free = [], 0
    for at, end in zip(places.tolist(), (places + length[places]).tolist()):
        if at >= free:
            out.append(at)
            free = end
    return np.array(out, np.int64)


def cut(runs: pa.Array, cuttable: int, trie: Trie) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all runs in order, and the number of tokens of each run.

    A run that begins with a character of ``cuttable`` or above is cut into the longest words from left to
    right; what is between them makes overlapping pairs of characters, or one token if it is a single one.
    Any other run is a token.
    """
    data, byte_bounds = flat(runs)
    byte_at = np.append(np.flatnonzero(_starts(data)), len(data))
    bounds = np.searchsorted(byte_at, byte_bounds)
    chars = code_points(data).astype(np.int64)
    size = np.diff(bounds)
    run = np.repeat(np.arange(len(size)), size)
    filled = size > 0
    cuts = np.zeros(len(size), bool)
    cuts[filled] = chars[bounds[:-1][filled]] >= cuttable
    end = np.where(cuts[run], bounds[1:][run], 0)  # nothing is looked up in other runs
    length = trie.longest(chars, end)
    words = _taken(length)
    edge = np.zeros(len(chars) + 1, np.int64)
    np.add.at(edge, words, 1)
    np.add.at(edge, words + length[words], -1)
    loose = (np.cumsum(edge[:-1]) == 0) & cuts[run]
    pair = np.zeros(len(chars), bool)
    pair[:-1] = loose[:-1] & loose[1:] & (run[:-1] == run[1:])
    alone = loose & ~pair
    alone[1:] &= ~pair[:-1]
    whole = bounds[:-1][~cuts & filled]
    starts = np.concatenate([words, np.flatnonzero(pair), np.flatnonzero(alone), whole])
    sizes = np.concatenate([length[words], np.full(pair.sum(), 2), np.ones(alone.sum(), np.int64), size[~cuts & filled]])
    order = np.argsort(starts, kind="stable")
    starts, sizes = starts[order], sizes[order]
    first, last = byte_at[starts], byte_at[starts + sizes]
    offsets = np.concatenate([[0], np.cumsum(last - first)])
    source = np.repeat(first - offsets[:-1], last - first) + np.arange(offsets[-1])
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[source]))
    return tokens, np.bincount(run[starts], minlength=len(size))


def cut_lists(lists: pa.Array, cuttable: int, trie: Trie) -> pa.Array:
    """``cut`` for a column of lists of runs: one list of tokens per row, null for null.

    Rows are worked on in slices of about ``SLICE_BYTES`` of text, as a byte takes some hundred bytes of arrays.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = upto[np.cumsum(sizes, dtype=np.int64)]
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1), len(lists)]
    parts = [_cut_slice(lists.slice(a, b - a), cuttable, trie) for a, b in zip(cuts, cuts[1:])]
    return pa.concat_arrays(parts)


def _cut_slice(lists: pa.Array, cuttable: int, trie: Trie) -> pa.Array:
    runs = lists.flatten()
    tokens, counts = cut(runs, cuttable, trie)
    per_row = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row_ends = np.concatenate([[0], np.cumsum(per_row)])
    ends = np.concatenate([[0], np.cumsum(counts)])[row_ends]
    offsets = pa.array(ends.astype(np.int32), mask=np.append(pc.is_null(lists).to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, tokens.cast(pa.string()))
