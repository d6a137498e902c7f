"""Removal of repeated passages: every byte in a string of ``LENGTH`` bytes that also starts earlier.

A suffix array of all positions would move the corpus many times over, so suffixes are sorted where
repeats can show: at anchors.  An anchor is the place of the smallest hash of a ``KEY``-byte string among
all such strings of a window of ``LENGTH`` bytes, the first one on ties; it depends on the window's bytes
alone, so equal windows have the same anchor at the same place.  One byte in thirty or so is an anchor.

1. Anchor keys are counted over the corpus; those that occur once are done.
2. The others come with the bytes around them.  Those of one key are sorted by what follows and, backwards,
   by what precedes: multikey quicksort over eight-byte digits to a shallow depth, then blind tries for
   the groups that still agree.  The sorted order's common prefixes tell, for each window around an
   anchor, which others have the same window, and all but the earliest are repeats.
3. Keys that occur very often, such as those of a common line, are not brought together: each window
   around them is counted by its own hash, with the earliest place found by partial minima.
4. Repeated windows become spans, and each text loses its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm import arrays
from chatterlake.llm.identity import one_of_each, with_twins
from chatterlake.llm.storage import stored

LENGTH = 100
KEY = 40
SIDE = LENGTH - KEY  # bytes before and behind a key that its windows reach
HOT = 100_000  # anchors of one key that are sorted together, at most: about 100 MB
DIGIT, SHALLOW = 8, 16  # bytes
SORTED_ROWS = 60_000
FIRST_KEY = -(1 << 63)
SLICE_BYTES = 1 << 20  # a byte of text takes about a hundred while its anchors are looked for


# --- anchors ------------------------------------------------------------------------------------
def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values."""
    out, span = values, 1
    while span * 2 <= width:
        out, span = np.minimum(out[: len(out) - span], out[span:]), span * 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors and their keys' hashes; windows do not cross texts."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places = np.arange(len(data) - KEY + 1)
    hashes = arrays.span_hashes(data, places, places + KEY)
    low = np.uint64(0xFFFFFFFF)  # half of the hash with the place below it: the least is the first smallest one
    least = _window_minima((hashes & ~low) | places.astype(np.uint64), SIDE + 1)
    text_end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    found = np.unique((least & low)[text_end - np.arange(len(least)) >= LENGTH]).astype(np.int64)
    return found, hashes[found]


def _names(part: pa.RecordBatch, owner: np.ndarray) -> list[pa.Array]:
    return [part.column(c).take(pa.array(owner)) for c in ("id", "twin")]


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices(batch, "text", SLICE_BYTES):
            data, offsets = arrays.texts_and_bytes(part.column("text"))
            places, keys = anchors(data, offsets)
            owner = np.searchsorted(offsets, places, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), *_names(part, owner), pa.array(places - offsets[owner])],
                ["key", "id", "twin", "at"],
            )


# --- sorting ------------------------------------------------------------------------------------
def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    return len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Places of the distinct strings in rising order.

    A blind trie keeps branching bytes only: a string goes down by these, is compared with one leaf,
    and goes in where the comparison says.
    """
    root: list = [0]  # a place, or [depth, {byte: node}, place of some leaf below]
    for i in range(1, len(strings)):
        new, node = strings[i], root[0]
        while not isinstance(node, int):
            node = node[1].get(new[node[0]], node[2])
        depth = _common(new, strings[node])
        holder, where, node = root, 0, root[0]
        while not isinstance(node, int) and node[0] < depth:
            holder, where = node[1], new[node[0]]
            node = holder[where]
        if not isinstance(node, int) and node[0] == depth:
            node[1][new[depth]] = i
        else:
            leaf = node if isinstance(node, int) else node[2]
            holder[where] = [depth, {strings[leaf][depth]: node, new[depth]: i}, leaf]
    out, stack = [], [root[0]]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack += [child for _, child in sorted(node[1].items(), reverse=True)]
    return out


def sorted_order(groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows of bytes in rising order within each group; equal ones stand together."""
    names = groups.astype(np.int64)
    for start in range(0, min(SHALLOW, rows.shape[1]), DIGIT):
        # multikey step: only rows that still agree with another one are told apart by the next digit
        order = np.argsort(names, kind="stable")
        sizes = np.bincount(names)
        open_rows = order[sizes[names[order]] > 1]
        digit = np.ascontiguousarray(rows[open_rows, start : start + DIGIT]).view(">u8")[:, 0].astype(np.uint64)
        by = np.lexsort((digit, names[open_rows]))
        open_rows, digit = open_rows[by], digit[by]
        new = np.append(True, (names[open_rows][1:] != names[open_rows][:-1]) | (digit[1:] != digit[:-1])) if len(open_rows) else np.zeros(0, bool)
        key = np.zeros(len(names), np.int64)
        key[open_rows] = np.cumsum(new)
        names = np.unique(names * (len(names) + 1) + key, return_inverse=True)[1]
    order = np.argsort(names, kind="stable")
    cuts = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        if b - a > 1:
            places: dict[bytes, list[int]] = {}
            for i in order[a:b].tolist():
                places.setdefault(rows[i].tobytes(), []).append(i)
            if len(places) > 1:
                distinct = list(places)
                order[a:b] = [i for k in blind_trie_order(distinct) for i in places[distinct[k]]]
    return order


def _depth_names(groups: np.ndarray, rows: np.ndarray, depths: range) -> list[np.ndarray]:
    """For each depth, numbers that are equal for rows of one group that agree up to it."""
    order = sorted_order(groups, rows)
    differs = rows[order][1:] != rows[order][:-1]
    common = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    common[groups[order][1:] != groups[order][:-1]] = -1
    out = []
    for depth in depths:
        name = np.empty(len(order), np.int64)
        name[order] = np.concatenate([[0], np.cumsum(common < depth)])
        out.append(name)
    return out


def repeated_windows(
    groups: np.ndarray, ids: np.ndarray, texts: np.ndarray,
    before: np.ndarray, behind: np.ndarray, room: np.ndarray, left: np.ndarray,
) -> np.ndarray:
    """Whether the window that begins r bytes before a row's key also begins earlier: one row each, r from 0.

    Earlier is a smaller id, or a smaller place in the same text.  ``texts``: number of each row's text; rows come by id, text and place;
    ``before``: the bytes before the key, last one first, and ``behind`` those behind it; ``left`` and ``room``: how many of
    them belong to the text.
    """
    preceding = _depth_names(groups, before, range(SIDE + 1))
    following = _depth_names(groups, behind, range(SIDE + 1))
    out = np.zeros((len(groups), SIDE + 1), bool)
    for r in range(SIDE + 1):
        fits = np.flatnonzero((left >= r) & (room >= SIDE - r))
        if len(fits):
            name = preceding[r][fits] * (len(groups) + 1) + following[SIDE - r][fits]
            # the row below the name, in one number: a sort keeps the rows' order and needs no places; n ** 3 < 2 ** 63
            name, row = np.divmod(np.sort(name * len(groups) + fits), len(groups))
            new = np.append(True, name[1:] != name[:-1])
            least = ids[row[new]][np.cumsum(new) - 1]
            own = np.append(False, ~new[1:] & (texts[row][1:] == texts[row][:-1]))  # the row before is in the same text
            out[row[own | (ids[row] > least)], r] = True
    return out


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of their anchors -> (key, id, twin, at, left, room, bytes around)."""
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            data, offsets = arrays.texts_and_bytes(part.column("text"))
            owner, at, keys = _own_anchors(part, data, offsets)
            place = offsets[owner] + at
            left, room = np.minimum(at, SIDE), np.minimum(offsets[owner + 1] - place - KEY, SIDE)
            padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE + KEY, np.uint8)])
            around = np.lib.stride_tricks.sliding_window_view(padded, 2 * SIDE + KEY)[place] if len(place) else np.zeros((0, 2 * SIDE + KEY), np.uint8)
            column = np.arange(2 * SIDE + KEY)
            around = np.where((column >= SIDE - left[:, None]) & (column < SIDE + KEY + room[:, None]), around, 0).astype(np.uint8)
            sides = np.concatenate([around[:, :SIDE][:, ::-1], around[:, SIDE + KEY :]], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys), *_names(part, owner), pa.array(at), pa.array(left, pa.int64()), pa.array(room, pa.int64()),
                    arrays.binary_array(sides.reshape(-1), np.arange(len(at) + 1) * 2 * SIDE),
                ],
                ["key", "id", "twin", "at", "left", "room", "sides"],
            )


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of anchors, their places and keys, of rows with a list of anchors."""
    found = part.column("found")
    n = pa.compute.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = found.flatten()
    return n, flat.field("at").to_numpy().astype(np.int64), flat.field("key").to_numpy()


def _own_anchors(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor's row, place and key; all are looked up again, so a clash of two texts' names cannot mix them."""
    n, at, keys = _flat(part)
    owner = np.repeat(np.arange(len(part)), n)
    inside = np.flatnonzero(at + KEY <= np.diff(offsets)[owner])
    place = offsets[owner[inside]] + at[inside]
    own = inside[arrays.span_hashes(data, place, place + KEY).view(np.int64) == keys[inside]]
    return owner[own], at[own], keys[own]


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of their anchors -> (window, id, twin, at, again) of all windows around them.

    ``again``: the window begins earlier in the same text.  Equal windows have the same anchors, so all of a text's are here.
    """
    for batch in batches:
        for part in arrays.slices(batch, "text", SLICE_BYTES):
            data, offsets = arrays.texts_and_bytes(part.column("text"))
            owner, at, _ = _own_anchors(part, data, offsets)
            place = offsets[owner] + at
            starts = np.unique((place[:, None] - np.arange(SIDE + 1)).reshape(-1))
            owner = np.searchsorted(offsets, starts, "right") - 1
            fits = (starts >= 0) & (owner >= 0)
            fits[fits] = starts[fits] + LENGTH <= offsets[owner[fits] + 1]
            starts, owner = starts[fits], owner[fits]
            windows = arrays.span_hashes(data, starts, starts + LENGTH)
            by = np.lexsort((starts, windows, owner))
            again = np.zeros(len(starts), bool)
            again[by[1:]] = (windows[by][1:] == windows[by][:-1]) & (owner[by][1:] == owner[by][:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows.view(np.int64)), *_names(part, owner), pa.array(starts - offsets[owner]), pa.array(again)],
                ["window", "id", "twin", "at", "again"],
            )


def _spans(ids: np.ndarray, twins: np.ndarray, texts: np.ndarray, at: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """(id, twin, start, end) of what the repeated windows around each key cover, touching ones together."""
    edges = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, least = np.nonzero(edges == 1)
    most = np.nonzero(edges == -1)[1] - 1  # both in the order of rows, then of r
    starts, ends = at[row] - most, at[row] - least + LENGTH
    by = np.lexsort((starts, texts[row]))
    row, starts, ends = row[by], starts[by], ends[by]
    new = np.append(True, (texts[row][1:] != texts[row][:-1]) | (starts[1:] > ends[:-1]))[: len(row)]
    firsts = np.flatnonzero(new)
    last = np.maximum.reduceat(ends, firsts) if len(firsts) else ends
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (ids[row[firsts]], twins[row[firsts]], starts[firsts], last)], ["id", "twin", "start", "end"]
    )


def _sort_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in key order -> spans of repeated windows; a key's rows are handled together."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        by = np.lexsort([rows.column(c).to_numpy() for c in ("at", "twin", "id")])
        key, ids, twins, at, left, room = (rows.column(c).to_numpy()[by] for c in ("key", "id", "twin", "at", "left", "room"))
        sides = np.frombuffer(b"".join(rows.column("sides").to_pylist()), np.uint8).reshape(len(rows), 2 * SIDE)[by]
        groups = np.unique(key, return_inverse=True)[1]
        texts = np.cumsum(np.append(0, (ids[1:] != ids[:-1]) | (twins[1:] != twins[:-1])))
        return _spans(ids, twins, texts, at, repeated_windows(groups, ids, texts, sides[:, :SIDE], sides[:, SIDE:], room, left))

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        cut = len(rows)
        if not last:  # the last key's rows may go on in the next batch
            key = rows.column("key").to_numpy()
            cut = int(np.flatnonzero(key == key[-1])[0])
            held.extend(rows.slice(cut).to_batches())
        if cut:
            yield done(rows.slice(0, cut))

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= SORTED_ROWS:
            yield from flush(False)
    if held:
        yield from flush(True)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        texts = batch.column("text").cast(pa.large_binary())
        for key, text, spans in zip(batch.column("key").to_pylist(), texts, batch.column("spans").to_pylist()):
            raw = text.as_py() or b""
            cut = [(start, min(end, len(raw))) for start, end in _merged(spans) if start < len(raw)]
            kept, at = [], 0
            for start, end in cut:
                kept.append(raw[at:start])
                at = end
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((key, len(raw), len(raw) - len(rest), [{"start": a, "end": b} for a, b in cut], rest))
        kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        names = ["key", "n_bytes", "n_removed", "spans", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


# --- jobs ---------------------------------------------------------------------------------------
def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, twin, start, end) of repeated windows of docs (id, twin, text), each name once; spans overlap where several keys saw them."""
    found = docs.mapInArrow(_anchor_batches, "key long, id long, twin long, at long")
    counted = stored(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeat-keys")
    placed = stored(found.join(counted, "key"), "repeat-anchors")
    lists = lambda rows: rows.groupBy("id", "twin").agg(F.collect_list(F.struct("at", "key")).alias("found"))
    own = lambda rows: docs.join(lists(rows), ["id", "twin"]).select("id", "twin", "text", "found")
    around = own(placed.where(F.col("n") <= HOT))
    around = around.mapInArrow(_context_batches, "key long, id long, twin long, at long, left long, room long, sides binary")
    spans = around.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_batches, "id long, twin long, start long, end long")
    spans = stored(spans, "spans")
    hot = placed.where(F.col("n") > HOT)
    if hot.isEmpty():
        return spans
    windows = stored(own(hot).mapInArrow(_window_batches, "window long, id long, twin long, at long, again boolean"), "windows")
    earliest = windows.groupBy("window").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = windows.join(stored(earliest.select("window", "first"), "earliest"), "window").where("again OR id > first")
    return spans.union(repeated.select("id", "twin", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, spans (start, end in bytes) and kept (the remaining bytes) of every row.

    Null text is empty; texts under ``LENGTH`` bytes lose nothing.  A missing key counts as smaller than
    all others.  Rows that share a key, or have none, are texts of their own without an order: none of them
    repeats another, and each loses what repeats within itself or in a row of a smaller key.  Other columns
    are not read; no rows give no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = with_twins(rows.withColumn("id", F.coalesce("key", F.lit(FIRST_KEY))))
    spans = stored(repeated_spans(one_of_each(rows.select("id", "twin", "text"))), "repeated")
    own = spans.groupBy("id", "twin").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = rows.join(own, ["id", "twin"], "left").select("key", "text", "spans")
    out = both.mapInArrow(_cut_batches, "key long, n_bytes long, n_removed long, spans array<struct<start long, end long>>, kept binary")
    return out.withColumnRenamed("key", key)
