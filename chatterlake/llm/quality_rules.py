"""Line-first quality rules.

Each line is judged by itself: by its closing punctuation, as navigation (fields between separators),
as boilerplate (fixed phrases), as shouting and as symbol noise.  Lines that fail are removed, and a
document is rejected when that takes more than ``MOST_LOST`` percent of its characters in words, or
when the whole text fails the base rules (too few words, too many repeated ones).

All counts are taken on flat arrays of a few megabytes of text; repeated word windows are found by
exact naming (pairs of equal names get equal names, doubled three times), not by hashing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm import arrays

LEAST_WORDS = 20
WINDOW = 8  # words; a power of two
MOST_REPEATED = 30  # percent of the words
MOST_LOST = 50  # percent of the characters in words
SYMBOLS = b"#*$%&|<>"
SEPARATORS = b"|<>"
CLOSING = (".", "!", "?", "…", ":", ";", '"', "'", ")", "”", "’", "»", "。", "！", "？", "」")
PHRASES = (
    "cookie", "javascript", "lorem ipsum", "all rights reserved", "terms of use", "privacy policy",
    "licensed under", "is licensed", "released under", "sign in", "log in", "subscribe", "click here", "read more", "copyright",
)
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)).encode())
RULES = ("no_end", "navigation", "boilerplate", "shouting", "noise")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(
    [f"{c} long" for c in COUNTS] + ["base_failed boolean", "kept boolean", "n_lines long", "n_bad_lines long", "lost_chars long"]
    + [f"n_{r} long" for r in RULES]
)


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL, _SEPARATOR = _table(SYMBOLS), _table(SEPARATORS)
_UPPER, _LOWER = (_table(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122)))


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _names(*keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0."""
    name = np.zeros(len(keys[0]), np.int64)
    for key in keys:
        key = np.unique(key, return_inverse=True)[1]
        name = np.unique(name * (int(key.max()) + 1 if len(key) else 1) + key, return_inverse=True)[1]
    return name


def _word_names(words: arrays.Words) -> np.ndarray:
    lengths = words.ends - words.starts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.repeat(words.starts - bounds[:-1], lengths) + np.arange(bounds[-1])
    flat = pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(words.data[inside]))]
    )
    return flat.dictionary_encode().indices.to_numpy().astype(np.int64)


def repeated_words(words: arrays.Words, width: int = WINDOW) -> np.ndarray:
    """Per text, the words in a window of ``width`` words that the text has twice or more."""
    n, bounds = len(words.starts), words.bounds
    name, span = _word_names(words), 1
    while span < width:
        left = name[: max(0, len(name) - span)]
        name, span = _names(left * (int(name.max()) + 1 if len(name) else 1) + name[span:]), span * 2
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(doc[: len(name)] == doc[width - 1 : width - 1 + len(name)])
    window = _names(doc[starts], name[starts])
    again = starts[np.bincount(window)[window] > 1] if len(window) else starts
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + width, -1)
    covered = _running(np.cumsum(edges)[:n] > 0)
    return covered[bounds[1:]] - covered[bounds[:-1]]


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; a text has one line more than line breaks."""
    breaks = np.flatnonzero(data == 10)
    text_of_break = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    text = np.concatenate([np.arange(len(offsets) - 1), text_of_break])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    order = np.lexsort((ends, np.concatenate([np.arange(len(offsets) - 1), text_of_break])))
    return starts, ends[order], text


def _per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n).astype(np.int64)


def _without(data: np.ndarray, offsets: np.ndarray, lines: tuple[np.ndarray, ...], gone: np.ndarray) -> pa.Array:
    """The texts made up of the lines that are not ``gone``; all lines are given, in order."""
    starts, ends, text = lines
    edge = np.zeros(len(data) + 2, np.int64)
    np.add.at(edge, starts[gone], 1)
    np.add.at(edge, np.minimum(ends[gone] + 1, offsets[1:][text[gone]]), -1)  # with the line break, if one follows
    stays = np.cumsum(edge)[: len(data)] == 0
    left = np.flatnonzero(~gone)
    last = left[np.append(text[left][1:] != text[left][:-1], True)] if len(left) else left
    stays[ends[last[ends[last] < offsets[1:][text[last]]]]] = False  # no line follows the last one any more
    bounds = _running(stays)[offsets]
    kept = pa.py_buffer(np.ascontiguousarray(data[stays]))
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds), kept).cast(pa.string())


def judge(ids: pa.Array, texts: pa.Array) -> tuple[pa.RecordBatch, tuple]:
    """Counts and verdicts, and what ``_without`` needs to remove the lines that fail."""
    words = arrays.split_words(texts)
    data, offsets, n = words.data, words.offsets, len(texts)
    of_words = np.diff(words.bounds)
    space = arrays.is_space(data)
    chars = _running(~space & ((data & 0xC0) != 0x80))
    symbols, separators = _running(_SYMBOL[data]), _running(_SEPARATOR[data])
    upper, lower = _running(_UPPER[data]), _running(_LOWER[data])
    between = lambda sums, a, b: sums[b] - sums[a]

    starts, ends, text = lines = _lines(data, offsets)
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    filled = last > first
    starts, ends, text, first, last = (x[filled] for x in (starts, ends, text, first, last))
    n_words = last - first
    line_chars = between(chars, starts, ends)
    close_at = words.ends[last - 1] if len(last) else last
    tails = [bytes(data[max(0, e - 4) : e]).decode("utf-8", "ignore")[-1:] for e in close_at]
    marks = between(symbols, starts, ends)
    ups, downs = between(upper, starts, ends), between(lower, starts, ends)
    lowered = np.where(_UPPER[data], data + 32, data).astype(np.uint8).tobytes()
    phrase_at = np.array([m.start() for m in _PHRASE.finditer(lowered)], np.int64)
    holding = np.searchsorted(phrase_at, ends) > np.searchsorted(phrase_at, starts)
    failed = {
        "no_end": ~np.isin(tails, CLOSING) if len(tails) else np.zeros(0, bool),
        "navigation": between(separators, starts, ends) * 5 > n_words,
        "boilerplate": holding & (n_words <= 30),
        "shouting": (ups > 2 * downs) & (ups + downs >= 20),
        "noise": (marks * 10 > line_chars) & (marks >= 3),
    }
    bad = np.logical_or.reduce(list(failed.values())) if len(text) else np.zeros(0, bool)
    lost = _per_text(line_chars * bad, text, n)
    gone = np.zeros(len(filled), bool)
    gone[filled] = bad

    same = _names(text, _line_names(data, starts, ends))
    n_dup = _per_text(np.ones(len(text)), text, n)
    if len(same):
        seen = np.unique(same, return_index=True)[1]
        n_dup -= _per_text(np.ones(len(seen)), text[seen], n)
    repeat = repeated_words(words)
    word_chars = between(chars, offsets[:-1], offsets[1:])
    base_failed = (of_words < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * of_words)
    kept = ~base_failed & (100 * lost <= MOST_LOST * word_chars)
    columns = [of_words, word_chars, between(symbols, offsets[:-1], offsets[1:]), n_dup, repeat, base_failed, kept]
    columns += [_per_text(np.ones(len(text)), text, n), _per_text(bad, text, n), lost]
    columns += [_per_text(failed[r], text, n) for r in RULES]
    names = ["doc_id", *COUNTS, "base_failed", "kept", "n_lines", "n_bad_lines", "lost_chars", *[f"n_{r}" for r in RULES]]
    counts = pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in columns]], names)
    return counts, (data, offsets, lines, gone)


def _line_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lines = pa.array([bytes(data[a:b]) for a, b in zip(starts, ends)], pa.large_binary())
    return lines.dictionary_encode().indices.to_numpy().astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            yield judge(part.column("doc_id"), part.column("text"))[0]


def _cleaned_batches(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text):
                counts, parts = judge(pa.nulls(len(part), pa.int64()), part.column(text))
                part = part.set_column(part.schema.get_field_index(text), text, _without(*parts))
                yield part.filter(counts.column("kept"))

    return run


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, kept, and lines failed by rule.

    Null text is empty: no words, so it fails the base rules.  Lines without a word are not judged.
    Repeated rows and null keys are judged like any other; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_batches, SCHEMA).withColumnRenamed("doc_id", key)


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, their texts without the lines that fail.

    Lines are judged first and removed with their line breaks; rows that lose too much or fail the base
    rules, which are those of the whole text, are left out.  Lines without a word stay.  Null and empty texts
    fail the base rules.  Rows that repeat or have no key stay as many as they are; no rows give no rows.
    """
    return docs.mapInArrow(_cleaned_batches(text), docs.schema)
