"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words; a line goes if an earlier one (smaller key, or same text and smaller
number) shares ``PERCENT`` percent of the words of both.  Lines of equal sets are one class, of which the
earliest line goes on.  Its words are ordered by rarity.  Two similar lines share a word among the
first few of each, so these prefixes are indexed by word, and lines that meet there pass the filters
of length, of position (what can still follow the shared word) and of a 128-bit picture of the set
before anything is compared.  A bit of the picture tells whether an odd number of the set's words has its
hash, so that two pictures differ in no more bits than the sets in words, and do not fill up in long lines.

No text is moved or stored: it is read once for the rarity of words and the numbers of lines, once for
names and prefixes, and once a round for the full sets of lines that met, which a bitmap of fixed size
names in the tasks.  Prefixes hold 32 bits of each word's hash, enough to meet; sets hold all 64.

The rarity of a word is read from ``BUCKETS`` counters, each the number of times that words of its hash
stand in texts; any common order of words is right, and this one has a fixed size however many words there are.

Postings travel as packed arrays, one row for a part of the words and some thousands of lines.  A task
meets one part at a time, of about ``ROWS_AT_ONCE`` postings.

A line's number holds the number of its row among those that share a key (see ``identity``) above
``LINE_BITS`` bits, so that (id, line) names one place, and rows of one key have an order.

Every line only needs one earlier match.  So each is first compared with the earliest line it meets
under each word, on full sets; only lines that found no match, but met more, are compared with all, under their own words only.
A word with many lines is cut into blocks, which are cells of their own at first; its lines without a match then meet all blocks.
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

PERCENT = 80
BUCKETS = 1 << 19
BUCKETS_A_ROW = 1 << 13
BITS = 1 << 26  # of a bitmap of lines or words that tasks look for: 8 MB
HOT_LIST = 2_000  # lines that meet under one word in one task, at most
HOT_CELL = 1_000
PAIRS_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 200_000
BROADCAST_IDS = 100_000
OWNER_SHIFT = 42
LINE_BITS = 31  # a text is shorter than 2^31 bytes
_U = np.uint64
_POSTING = (("cell", "<u4"), ("n", "<u4"), ("place", "<u4"), ("id", "<i8"), ("line", "<i8"), ("low", "<u8"), ("high", "<u8"), ("role", "u1"))
TARGET, BOTH, ASKER = range(3)  # what a posting is for


# --- lines --------------------------------------------------------------------------------------
def _distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash) in that order; one sort of a number made of both, which is checked."""
    key = (owner.astype(np.uint64) << _U(OWNER_SHIFT)) | (hashes >> _U(64 - OWNER_SHIFT))
    by = np.argsort(key)
    key = key[by]
    same = key[1:] == key[:-1]
    if (same & (hashes[by][1:] != hashes[by][:-1])).any() or (len(owner) and int(owner[-1]) >> (64 - OWNER_SHIFT)):
        by = np.lexsort((hashes, owner))
        same = (owner[by][1:] == owner[by][:-1]) & (hashes[by][1:] == hashes[by][:-1])
    first = by[np.append(True, ~same)[: len(by)]]
    return owner[first], hashes[first]


def _line_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where lines begin; lines are numbered over all texts."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    return starts[: np.searchsorted(starts, len(data))]


def _line_names(part: pa.RecordBatch, offsets: np.ndarray, starts: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the numbers, with the twin's, of these lines."""
    owner = np.searchsorted(offsets, starts[line], "right") - 1
    twin = part.column("twin").to_numpy(zero_copy_only=False)[owner]
    return owner, line - np.searchsorted(starts, offsets[owner]) + (twin << LINE_BITS)


def _cuts(line: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & hashes.dtype.type(BUCKETS - 1)).astype(np.int64)


ROW = "id long, twin long, lines array<long>, block int, counts binary"


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row with words the numbers of the lines that have some; then the task's counters of words, in blocks."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
    names = ["id", "twin", "lines", "block", "counts"]
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            words = arrays.split_words(part.column("text"))
            if not len(words.starts):
                continue
            counts += np.bincount(_bucket(words.hashes()), minlength=BUCKETS)
            starts = _line_starts(words.data, words.offsets)
            line = np.searchsorted(starts, words.starts, "right") - 1
            owner, number = _line_names(part, words.offsets, starts, line[_cuts(line)])
            cuts = _cuts(owner)
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(owner)).astype(np.int32)), pa.array(number & (1 << LINE_BITS) - 1))
            rows = pa.array(owner[cuts])
            none = [pa.nulls(len(rows), k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("twin").take(rows), lists, *none], names)
    blocks = counts.reshape(-1, min(BUCKETS, BUCKETS_A_ROW))
    used = np.flatnonzero(blocks.any(axis=1))
    none = [pa.nulls(len(used), k) for k in kinds[:3]]
    packed = pa.array([blocks[k].tobytes() for k in used], pa.binary())
    yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), packed], names)


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counters of each block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
            sums[block] = sums.get(block, 0) + np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"]
    )


def _one_line_words(words: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word) of rows of one line each."""
    return _distinct(np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds)), words.hashes())


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of its rarest words a set of ``n`` needs so that each similar set shares one."""
    return n - (n * percent + 99) // 100 + 1


LINE = "id long, line long, n long, one long, two long, low long, high long, prefix binary"


def _line_batches(table, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines with words: place, number of distinct words, the set's name and picture, and its rarest words.

        A word that no other place has cannot be shared; such ones are left out of the prefix, at whose front they are.
        """
        rarity = table.value
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                words = arrays.split_words(part.column("text"))
                starts = _line_starts(words.data, words.offsets)
                line, hashes = _distinct(np.searchsorted(starts, words.starts, "right") - 1, words.hashes())
                cuts = _cuts(line)
                if not len(cuts):
                    continue
                n = np.diff(np.append(cuts, len(line)))
                owner, number = _line_names(part, words.offsets, starts, line[cuts])
                two = np.add.reduceat(arrays.mix(hashes ^ _U(0x5851F42D4C957F2D)), cuts)
                bits, upper = _U(1) << (hashes >> _U(58)), (hashes >> _U(57) & _U(1)).astype(bool)
                low, high = (np.bitwise_xor.reduceat(np.where(x, bits, _U(0)), cuts) for x in (~upper, upper))
                often = rarity[_bucket(hashes)]
                # hashes rise within a line already, so a stable sort leaves equally rare words in their order
                by = np.argsort(line << 32 | often.astype(np.int64), kind="stable")
                place = np.arange(len(line)) - np.repeat(cuts, n)
                use = (place < np.repeat(prefix_length(n, percent), n)) & (often[by] > 1)
                bounds = np.append(0, np.cumsum(np.add.reduceat(use, cuts, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(owner)), pa.array(number), pa.array(n),
                        pa.array(np.add.reduceat(hashes, cuts).view(np.int64)), pa.array(two.view(np.int64)),
                        pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), arrays.binary_array(hashes[by][use].astype(np.uint32), bounds),
                    ],
                    ["id", "line", "n", "one", "two", "low", "high", "prefix"],
                )

    return run


# --- bitmaps ------------------------------------------------------------------------------------
def _line_bits(ids: np.ndarray, line: np.ndarray) -> np.ndarray:
    return arrays.mix(ids.astype(np.int64).view(_U) ^ arrays.mix(line.astype(np.int64).view(_U))) & _U(BITS - 1)


def _lines_of(batch: pa.RecordBatch) -> np.ndarray:
    return _line_bits(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "line")))


def _word_bits(words: np.ndarray) -> np.ndarray:
    return words.astype(_U) & _U(BITS - 1)


def _words_of(asking):
    """The rarest words of the lines that a bitmap names."""

    def bits(batch: pa.RecordBatch) -> np.ndarray:
        flat = arrays.texts_and_bytes(batch.column("prefix").filter(pa.array(_has(asking.value, _lines_of(batch)))))[0]
        return _word_bits(np.frombuffer(flat.tobytes(), "<u4"))

    return bits


def _has(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[(bits >> _U(6)).astype(np.int64)] >> (bits & _U(63)) & _U(1)).astype(bool)


def _bitmap(rows: DataFrame, bits) -> np.ndarray:
    """The bits of all rows; ``bits`` gives those of a batch.  At most BITS / 64 rows are brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(bits(batch))
            slot = (found >> _U(6)).astype(np.int64)
            cuts = _cuts(slot)
            each = _U(1) << (found & _U(63))
            each = np.bitwise_or.reduceat(each, cuts) if len(cuts) else each
            yield pa.RecordBatch.from_arrays([pa.array(slot[cuts]), pa.array(each.view(np.int64))], ["slot", "bits"])

    found = rows.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(BITS >> 6, 1), _U)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(_U)
    return out


# --- postings -----------------------------------------------------------------------------------
def _posted(batch: pa.RecordBatch, percent: int, rarity: np.ndarray, asked: tuple, hot: bool) -> dict[str, np.ndarray]:
    """The postings of a batch of lines, under hot words or the others; ``asked``: bitmaps of lines and words, or nothing."""
    flat, offsets = arrays.texts_and_bytes(batch.column("prefix"))
    words, kept = np.frombuffer(flat.tobytes(), "<u4"), np.diff(offsets) // 4
    row = np.repeat(np.arange(len(batch)), kept)
    n = batch.column("n").to_numpy()
    place = np.arange(len(row)) - np.repeat(offsets[:-1] // 4, kept) + (prefix_length(n, percent) - kept)[row]
    use = (rarity[_bucket(words)] > HOT_LIST) == hot
    whole = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "line", "low", "high")}
    whole["role"] = np.full(len(batch), BOTH)
    if asked:
        lines, only = (x.value for x in asked)
        use &= _has(only, _word_bits(words))
        whole["role"] = np.where(_has(lines, _line_bits(whole["id"], whole["line"])), BOTH, TARGET)
    row = row[use]
    return {"cell": words[use], "n": n[row], "place": place[use], **{c: x[row] for c, x in whole.items()}}


def _packed(rows: dict[str, np.ndarray], n_parts: int) -> pa.RecordBatch:
    """One row for each part of the cells: the bytes of its columns, most alike ones together."""
    part = (arrays.mix(rows["cell"].astype(_U)) % _U(n_parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    part = part[by]
    cuts = _cuts(part)
    columns = [np.ascontiguousarray(rows[c][by].astype(kind)).view(np.uint8).reshape(len(by), np.dtype(kind).itemsize) for c, kind in _POSTING]
    packed = [b"".join(x[a:b].T.tobytes() for x in columns) for a, b in zip(cuts, np.append(cuts[1:], len(by)))]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(packed, pa.binary())], ["part", "rows"])


def _unpacked(packed: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in _POSTING)
    found: dict[str, list] = {c: [] for c, _ in _POSTING}
    for one in packed:
        n, at = len(one) // width, 0
        for c, kind in _POSTING:
            size = np.dtype(kind).itemsize
            block = np.frombuffer(one, np.uint8, n * size, at).reshape(size, n)
            found[c].append(np.ascontiguousarray(block.T).view(kind).ravel())
            at += n * size
    return {c: np.concatenate(x) for c, x in found.items()}


PACKED = "part int, rows binary"


def _part_batches(table, percent: int, asked: tuple, n_parts: int):
    """Lines -> packed postings under words that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            for part in arrays.slices(batch, "prefix"):
                held.append(_posted(part, percent, table.value, asked, hot=False))
                if sum(len(x["cell"]) for x in held) >= ROWS_AT_ONCE:
                    yield _packed({c: np.concatenate([x[c] for x in held]) for c in held[0]}, n_parts)
                    held = []
        if held:
            yield _packed({c: np.concatenate([x[c] for x in held]) for c in held[0]}, n_parts)

    return run


POSTING = "word long, n long, place long, id long, line long, low long, high long, role long"


def _hot_batches(table, percent: int, asked: tuple):
    """Lines -> postings under hot words, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "prefix"):
                rows = _posted(part, percent, table.value, asked, hot=True)
                kept = [pa.array(x.astype(np.int64)) for x in rows.values()]
                yield pa.RecordBatch.from_arrays(kept, ["word", *list(rows)[1:]])

    return run


def _dealt_batches(n_parts: int):
    """Hot postings with the cells they go to -> packed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _packed({c: batch.column(c).to_numpy(zero_copy_only=False) for c, _ in _POSTING}, n_parts)

    return run


def _meeting_batches(percent: int, every: bool):
    """Packed postings in the order of parts -> (id, line, other_id, other_line, more): earlier lines that pass the filters.

    Of each asking line the earliest one under each word, and whether there are more; or all of them.
    """

    def meet(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        by = np.lexsort((rows["n"], rows["cell"]))
        cell, n, place, ids, line, low, high, role = (rows[c][by] for c, _ in _POSTING)
        n, place = n.astype(np.int64), place.astype(np.int64)
        order = np.lexsort((line, ids))
        new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (line[order][1:] != line[order][:-1]))
        when = np.empty(len(order), np.int64)
        when[order] = np.cumsum(new) - 1  # the same for all postings of a line
        holder = order[new]

        # under a word, lines rise in size: each meets those after it that are not too long for it
        key = cell.astype(_U) << _U(32) | n.astype(_U)
        longest = np.minimum(100 * n // percent, (1 << 32) - 1)
        ends = np.searchsorted(key, cell.astype(_U) << _U(32) | longest.astype(_U), "right")
        least = (percent * 2 * n + 99 + percent) // (100 + percent)
        count = np.where(n - place >= least, ends - np.arange(len(n)) - 1, 0)
        earliest = np.full(len(n), len(n), np.int64)
        met = np.zeros(len(n), np.int64)
        live = np.flatnonzero(count)
        chunk = np.cumsum(count[live]) // PAIRS_AT_ONCE
        for some in np.split(live, np.flatnonzero(np.diff(chunk)) + 1):
            m = count[some]
            i = np.repeat(some, m)
            j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + i + 1
            both = n[i] + n[j]
            need = (percent * both + 99 + percent) // (100 + percent)
            fits = np.minimum(n[i] - place[i], n[j] - place[j]) >= need
            i, j, both, need = i[fits], j[fits], both[fits], need[fits]
            # sets of one size that need all of it would be one class
            apart = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j])
            fits = (both - apart >= 2 * need) & ((n[i] < n[j]) | (need < n[i]))
            i, j = i[fits], j[fits]
            i, j = np.where(when[i] > when[j], i, j), np.where(when[i] > when[j], j, i)
            fits = (when[i] != when[j]) & (role[i] != TARGET) & (role[j] != ASKER)
            i, j = i[fits], j[fits]
            if every:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[i], line[i], ids[j], line[j], np.zeros(len(i), bool))], ["id", "line", "other_id", "other_line", "more"]
                )
            else:
                np.minimum.at(earliest, i, when[j])
                met += np.bincount(i, minlength=len(n))
        if not every:
            i = np.flatnonzero(met)
            j = holder[earliest[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids[i], line[i], ids[j], line[j], met[i] > 1)], ["id", "line", "other_id", "other_line", "more"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows")):
                if part != at and held:
                    yield from meet(_unpacked(held))
                    held = []
                at = part
                held.append(rows.as_buffer())
        if held:
            yield from meet(_unpacked(held))

    return run


# --- sets ---------------------------------------------------------------------------------------
def _set_batches(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The full sets of the lines that the bitmap names, and of few others."""
        bitmap = wanted.value
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                data, offsets = arrays.texts_and_bytes(part.column("text"))
                starts = _line_starts(data, offsets)
                owner, number = _line_names(part, offsets, starts, np.arange(len(starts)))
                ids = part.column("id").to_numpy(zero_copy_only=False)[owner]
                take = np.flatnonzero(_has(bitmap, _line_bits(ids, number)))
                if not len(take):
                    continue
                ends = np.append(starts[1:], len(data))[take]
                sizes = ends - starts[take]
                bounds = np.append(0, np.cumsum(sizes))
                chosen = data[np.arange(bounds[-1]) + np.repeat(starts[take] - bounds[:-1], sizes)]
                row, hashes = _one_line_words(arrays.split_words(arrays.binary_array(chosen, bounds)))
                sets = arrays.binary_array(hashes, np.searchsorted(row, np.arange(len(take) + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array(number[take]), sets], ["id", "line", "words"])

    return run


def _verify_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for k, (one, two) in enumerate(zip(batch.column("words"), batch.column("other_words"))):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("line")], ["id", "line"]).filter(pa.array(keep))

    return run


# --- jobs ---------------------------------------------------------------------------------------
def _dealt(hot: DataFrame, counts: DataFrame, every: bool) -> DataFrame:
    """Postings under words with many lines, with the cells they go to.

    In the first round each block of a word's lines is a cell, so no posting is copied.  Later each block of lines
    that ask meets each block of all lines.
    """
    both = hot.join(counts.select("word", "blocks", "ask_blocks"), "word")
    own, columns = F.pmod(F.xxhash64("id", "line"), "blocks").cast("int"), [c for c, _ in _POSTING[1:]]
    if every:
        asking = F.pmod(F.xxhash64("line", "id"), "ask_blocks").cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        targets = both.where("ask_blocks > 0").withColumn("role", F.lit(TARGET).cast("long")).withColumn("own", own).withColumn("ask", upto("ask_blocks"))
        askers = both.where(F.col("role") == BOTH).withColumn("role", F.lit(ASKER).cast("long")).withColumn("ask", asking).withColumn("own", upto("blocks"))
        both = targets.unionByName(askers)
    else:
        both = both.withColumn("own", own).withColumn("ask", F.lit(0))
    cell = F.xxhash64("word", "own", "ask").bitwiseAND(F.lit((1 << 32) - 1))
    return both.select(cell.alias("cell"), *columns)


def _meetings(lines: DataFrame, table, asked: tuple, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of lines (id, line, n, low, high, prefix): with the earliest of each word, or all of those that are asked for.

    ``asked``: nothing, or bitmaps of the lines that ask and of their words.  Also (id, line) of the lines that did not meet all others.
    """
    hot = stored(lines.mapInArrow(_hot_batches(table, percent, asked), POSTING), "hot-postings")
    blocks = lambda n: F.ceil(n / HOT_CELL).cast("int")
    counts = hot.groupBy("word").agg(F.count("*").alias("n"), F.count(F.when(F.col("role") == BOTH, 1)).alias("asks"))
    counts = stored(counts.select("word", blocks(F.col("n")).alias("blocks"), blocks(F.col("asks")).alias("ask_blocks"), "n", "asks"), "hot-words")
    copies = F.expr("n * ask_blocks + asks * blocks") if asked else F.col("n")
    n_hot = counts.agg(F.sum(copies)).first()[0] or 0
    n_rows = lines.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    n_parts = 1 + (n_rows // 4 + n_hot) // ROWS_AT_ONCE
    parts = lines.mapInArrow(_part_batches(table, percent, asked, n_parts), PACKED)
    if n_hot:
        parts = parts.union(_dealt(hot, counts, bool(asked)).mapInArrow(_dealt_batches(n_parts), PACKED))
    dealt = parts.repartition("part").sortWithinPartitions("part")
    found = dealt.mapInArrow(_meeting_batches(percent, bool(asked)), "id long, line long, other_id long, other_line long, more boolean")
    pairs = found.groupBy("id", "line", "other_id", "other_line").agg(F.bool_or("more").alias("more"))
    return stored(pairs, "meetings"), hot.join(counts.where("blocks > 1"), "word", "left_semi").select("id", "line")


def _matched(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, line) of lines that are similar to the other line of some pair, by their full sets."""
    wanted = pairs.select("id", "line").union(pairs.select("other_id", "other_line"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, _lines_of))
    sets = stored(docs.mapInArrow(_set_batches(bitmap), "id long, line long, words binary"), "line-sets")
    others = sets.select(F.col("id").alias("other_id"), F.col("line").alias("other_line"), F.col("words").alias("other_words"))
    both = pairs.select("id", "line", "other_id", "other_line").join(sets, ["id", "line"]).join(others, ["other_id", "other_line"])
    return stored(both.mapInArrow(_verify_batches(percent), "id long, line long").distinct(), "matched")


def repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, twin, lines, removed) of every row of docs (id, twin, text) with words, each name once: its lines with words, and those to remove."""
    context = docs.sparkSession.sparkContext
    read = stored(docs.mapInArrow(_row_batches, ROW), "rows")
    counted = read.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_sum_batches, "block int, counts binary")
    rarity = np.zeros(BUCKETS, np.uint32).reshape(-1, min(BUCKETS, BUCKETS_A_ROW))
    for r in counted.collect():  # BUCKETS / BUCKETS_A_ROW rows at most
        rarity[r.block] = np.minimum(np.frombuffer(r.counts, np.int64), (1 << 31) - 1)
    table = context.broadcast(rarity.ravel())

    named = docs.mapInArrow(_line_batches(table, percent), LINE)
    lines = named.groupBy("n", "one", "two").agg(F.min(F.struct("id", "line", "low", "high", "prefix")).alias("first")).select("first.*", "n")
    lines = stored(lines, "line-classes")

    pairs, split = _meetings(lines, table, (), percent)
    matched = _matched(pairs, docs, percent)
    there = F.broadcast(matched) if matched.count() <= BROADCAST_IDS else matched
    unsure = pairs.where("more").select("id", "line").union(split).distinct().join(there, ["id", "line"], "left_anti")
    unsure = stored(unsure, "unsure")
    if not unsure.isEmpty():
        asking = context.broadcast(_bitmap(unsure, _lines_of))
        words = context.broadcast(_bitmap(lines.select("id", "line", "prefix"), _words_of(asking)))
        rest, _ = _meetings(lines, table, (asking, words), percent)
        matched = matched.union(_matched(rest, docs, percent))
    firsts = lines.select("id", "line", F.lit(True).alias("first")).union(matched.select("id", "line", F.lit(False)))
    number = F.col("line").bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    lists = firsts.groupBy("id", F.shiftright("line", LINE_BITS).alias("twin")).agg(
        F.collect_list(F.when(F.col("first"), number)).alias("firsts"), F.collect_list(F.when(~F.col("first"), number)).alias("gone")
    )
    none = F.array().cast("array<bigint>")
    stay = F.array_except(F.coalesce("firsts", none), F.coalesce("gone", none))
    joined = read.where("block IS NULL").select("id", "twin", "lines").join(lists, ["id", "twin"], "left")
    return joined.select("id", "twin", "lines", F.array_except("lines", stay).alias("removed"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_lines, n_removed, removed: of each row the numbers of the lines to remove, and ``twin``, which tells rows apart.

    Lines without words are neither counted nor removed.  Null and empty texts, and rows without a
    key, have n_lines 0.  Rows that share a key are documents of their own, in the order of their texts'
    hashes; those of equal text are one, as they cannot be told apart: none of them repeats another, and
    each of them has a row.  Other columns are not read; no rows give no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known = with_twins(rows.where("id IS NOT NULL"))
    found = repeated_lines(one_of_each(known.where("text IS NOT NULL").select("id", "twin", "text")), percent)
    per_text = found.select("id", "twin", F.size("lines").cast("long").alias("n_lines"), "removed")
    joined = known.select("id", "twin").join(per_text, ["id", "twin"], "left")
    joined = joined.unionByName(rows.where("id IS NULL").select("id"), allowMissingColumns=True)
    removed = F.coalesce("removed", F.array().cast("array<bigint>"))
    return joined.select(
        F.col("id").alias(key), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"),
        removed.alias("removed"), F.coalesce("twin", F.lit(0)).alias("twin"),
    )


def without_lines(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their texts less the lines that ``dedup_lines`` found in the same rows."""
    lists = found.where("n_removed > 0").select(F.col(key).alias("id"), "twin", F.col("removed").alias("lines"))
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    known = with_twins(named.where("id IS NOT NULL")).join(lists.dropDuplicates(["id", "twin"]), ["id", "twin"], "left")
    both = known.select("row", "text", "lines").unionByName(named.where("id IS NULL").select("row", "text"), allowMissingColumns=True)
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("lines", i.cast("long"))), "\n")
    cleaned = F.when(F.col("lines").isNotNull(), kept).otherwise(F.col("text"))
    return both.withColumn("row", F.col("row").withField(text, cleaned)).select("row.*")
