"""Token ids of documents in files: canonical length-limited Huffman codes from global counts.

Ids are counted over all documents, the counts give one code of at most ``LIMIT`` bits, and each
document's ids become one bit string with the bit offset of every ``BLOCK``-th id beside it.  Blocks
decode independently, and a task decodes all of its blocks step by step together with one table.

On disk: ``<path>/code`` holds (id, bits), from which the canonical code follows, and ``<path>/ids``
holds chunks of documents in rising key order: keys, numbers of ids and of bytes, bit strings and
offsets.  Both are written by Spark's committing writer, so a lost executor leaves no half file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterlake.llm import arrays
from chatterlake.llm.storage import stored

LIMIT = 18  # bits; at least the logarithm of the number of ids in use
BLOCK = 512
CHUNK_IDS = 1 << 19
CACHED_PIECES = 1_500_000  # of about 50 bytes each
CACHED_BYTES = 64  # of a piece, at most
JOINED_BYTES = 1 << 16


# --- ids ----------------------------------------------------------------------------------------
def _ends_safely(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each of these bytes is surely no white space.

    Characters whose first byte also begins some Unicode white space count as unsafe.
    """
    first, safe = data[last], (data[last] > 32) & (data[last] < 127)
    long = np.flatnonzero(first >= 128)
    at = last[long]
    for _ in range(3):  # back to the first byte of the character
        inner = np.flatnonzero((data[at] & 0xC0) == 0x80)
        at[inner] = np.maximum(at[inner] - 1, 0)
    safe[long] = (data[at] >= 0xC0) & ~np.isin(data[at], (0xC2, 0xE1, 0xE2, 0xE3))
    return safe


def _pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces that the byte-level tokenizer treats on their own.

    Its pattern takes white space only at the front of a match or as a match of its own, so a text may
    be cut before any white space that follows a character which is none.
    """
    space = arrays.is_space(data)
    cut = np.zeros(len(data), bool)
    at = np.flatnonzero(space[1:] & ~space[:-1])
    cut[at[_ends_safely(data, at)] + 1] = True
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in each worker."""
    loaded = arrays.worker_cache("tokenizers")
    if path not in loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded[path] = Tokenizer.from_file(path)
    return loaded[path]


def _ranges(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``firsts``, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(firsts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _encode_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, path: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and where among them each piece's begin and how many they are.

    Pieces that may stand behind each other in a text are encoded as one text: those that begin with white
    space and end without.  The ids' lengths in bytes tell them apart again.
    """
    encoder = tokenizer(path)
    size = _token_bytes(path)
    last = data[ends - 1]
    joins = arrays.is_space(data)[starts] & (last > 32) & (last < 127)
    joined, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
    lengths = ends - starts
    text = data[_ranges(starts[joined], lengths[joined])]
    upto = np.cumsum(lengths[joined])
    cuts = np.append(np.flatnonzero(np.diff(upto // JOINED_BYTES, prepend=-1)), len(joined)) if len(joined) else np.zeros(1, np.int64)
    groups = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    begin = lambda i: int(upto[i - 1]) if i else 0
    texts = [text[begin(i) : begin(j)].tobytes().decode() for i, j in groups]
    texts += [data[i:j].tobytes().decode() for i, j in zip(starts[alone].tolist(), ends[alone].tolist())]
    found = [np.array(got.ids, kind) for got in encoder.encode_batch_fast(texts, add_special_tokens=False)]
    n = np.empty(len(starts), np.int64)
    for (i, j), ids in zip(groups, found):
        n[joined[i:j]] = np.diff(np.searchsorted(np.cumsum(size[ids]), upto[i:j] - begin(i)) + 1, prepend=0)
    n[alone] = [len(ids) for ids in found[len(groups) :]]
    order = np.append(joined, alone)
    firsts = np.empty(len(starts), np.int64)
    firsts[order] = np.cumsum(n[order]) - n[order]
    return np.concatenate([*found, np.zeros(0, kind)]), firsts, n


def _token_bytes(path: str) -> np.ndarray:
    """Bytes of text that each id stands for; this kind of vocabulary writes one character for each byte."""
    sizes = arrays.worker_cache("token bytes")
    if path not in sizes:
        encoder = tokenizer(path)
        sizes[path] = np.array([len(encoder.id_to_token(i) or "") for i in range(encoder.get_vocab_size(True))], np.int64)
    return sizes[path]


class Known:
    """Pieces with their ids, as arrays: 64-bit hashes in rising order lead to them, and their bytes confirm them.

    At most ``CACHED_PIECES``.  When they would be more, those go that were not asked for again since they came or
    since the last time; of the others the younger half of the room stays.
    """

    def __init__(self, kind: np.dtype):
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, kind), np.zeros(1, np.int64)
        self.used = np.zeros(0, bool)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece among those known, or -1."""
        out = np.full(len(starts), -1)
        if len(self.keys) and len(starts):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            slot, lengths = self.slot[at], ends - starts
            hit = np.flatnonzero((self.keys[at] == hashes) & (self.text_at[slot + 1] - self.text_at[slot] == lengths))
            slot, lengths = slot[hit], lengths[hit]
            same = data[_ranges(starts[hit], lengths)] == self.text[_ranges(self.text_at[slot], lengths)]
            whole = np.logical_and.reduceat(same, np.cumsum(lengths) - lengths) if len(hit) else np.zeros(0, bool)
            out[hit[whole]] = slot[whole]
            self.used[slot[whole]] = True
        return out

    def add(self, data, starts, ends, hashes, ids, firsts, n) -> None:
        """New pieces; of equal hashes one, and long ones not at all."""
        short = np.flatnonzero(ends - starts <= CACHED_BYTES)
        keys, first = np.unique(hashes[short], return_index=True)
        at = np.searchsorted(self.keys, keys)
        new = (self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), bool)
        keys, take = keys[new][:CACHED_PIECES], short[first[new]][:CACHED_PIECES]
        if len(self.used) + len(take) > CACHED_PIECES:
            self._shrink(CACHED_PIECES - len(take))
        number = len(self.used) + np.arange(len(take))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, number)
        lengths = (ends - starts)[take]
        self.text = np.append(self.text, data[_ranges(starts[take], lengths)])
        self.text_at = np.append(self.text_at, self.text_at[-1] + np.cumsum(lengths))
        self.ids = np.append(self.ids, ids[_ranges(firsts[take], n[take])])
        self.ids_at = np.append(self.ids_at, self.ids_at[-1] + np.cumsum(n[take]))
        self.used = np.append(self.used, np.zeros(len(take), bool))

    def _shrink(self, room: int) -> None:
        keep = np.flatnonzero(self.used)
        room = min(room, CACHED_PIECES // 2)
        keep = keep[len(keep) - min(room, len(keep)) :]
        number = np.full(len(self.used), -1)
        number[keep] = np.arange(len(keep))
        stays = number[self.slot] >= 0
        self.keys, self.slot = self.keys[stays], number[self.slot[stays]]
        for name in ("text", "ids"):
            values, at = getattr(self, name), getattr(self, f"{name}_at")
            lengths = np.diff(at)[keep]
            setattr(self, name, values[_ranges(at[:-1][keep], lengths)])
            setattr(self, f"{name}_at", np.append(0, np.cumsum(lengths)))
        self.used = np.zeros(len(keep), bool)


def encode(texts: pa.Array, path: str, end_id: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids, with the end id after each text, and the texts' bounds among them.

    Each distinct piece of a slice is looked up once, and encoded if the worker does not know it from its earlier slices.
    """
    data, offsets = arrays.texts_and_bytes(texts)
    starts = _pieces(data, offsets)
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    kind = np.dtype(f"<u{width}")
    cache = arrays.worker_cache(f"pieces of {path} in {width} bytes")
    known = cache.setdefault("known", Known(kind))
    text, text_bounds = arrays.texts_and_bytes(pieces.dictionary)
    begin, end = text_bounds[:-1], text_bounds[1:]
    hashes = arrays.span_hashes(text, begin, end)
    slot = known.find(text, begin, end, hashes)
    new, old = np.flatnonzero(slot < 0), np.flatnonzero(slot >= 0)
    ids, new_firsts, new_lengths = _encode_pieces(text, begin[new], end[new], path, kind)
    # the end id, the new pieces' ids and those of the others, one behind the other
    lengths, firsts = np.ones(len(slot) + 1, np.int64), np.zeros(len(slot) + 1, np.int64)
    lengths[new], firsts[new] = new_lengths, new_firsts + 1
    lengths[old], firsts[old] = (known.ids_at[slot[old] + 1] - known.ids_at[slot[old]]), known.ids_at[slot[old]] + 1 + len(ids)
    flat = np.concatenate([np.array([end_id], kind), ids, known.ids])
    known.add(text, begin[new], end[new], hashes[new], ids, new_firsts, new_lengths)
    text_starts = np.searchsorted(starts, offsets)  # among the pieces
    which = np.insert(pieces.indices.to_numpy().astype(np.int64), text_starts[1:], len(slot))
    n = lengths[which]
    sums = np.concatenate([[0], np.cumsum(n)])
    return flat[_ranges(firsts[which], n)], sums[text_starts + np.arange(len(text_starts))]


# --- the code -----------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 for unused ones, at most ``limit``; the cheapest such code.

    Package-merge: in each of ``limit`` rounds the sorted symbols merge with pairs of the round
    before, and going back through the rounds tells how many symbols each of them takes.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64)
    packages, rounds = np.zeros(0), []
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by_weight = np.argsort(merged, kind="stable")
        rounds.append(np.cumsum(by_weight < len(weights)))
        merged = merged[by_weight]
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    take = 2 * len(weights) - 2
    for symbols_upto in reversed(rounds):
        symbols = int(symbols_upto[take - 1]) if take else 0
        lengths[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: shorter ones first, equal lengths by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.int64)
    if len(order):
        top = int(lengths.max())
        steps = np.left_shift(1, top - lengths[order])
        codes[order] = np.concatenate([[0], np.cumsum(steps)[:-1]]) >> (top - lengths[order])
    return codes


def pack(ids: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """Bit strings of all texts, each from a whole byte on: bytes, byte bounds, offsets of the blocks, their bounds."""
    bits = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(bits)])
    n_bits = ends[bounds[1:]] - ends[bounds[:-1]]
    byte_bounds = np.concatenate([[0], np.cumsum((n_bits + 7) // 8)])
    counts = np.diff(bounds)
    shift = byte_bounds[:-1] * 8 - ends[bounds[:-1]]
    at = ends[:-1] + np.repeat(shift, counts)
    out = np.zeros((byte_bounds[-1] + 15) // 8, np.uint64)
    if len(ids):
        word, room = at >> 6, 64 - (at & 63) - bits  # bits left in the word behind the code; below 0 if it crosses
        crossing = np.flatnonzero(room < 0)
        values = codes[ids].astype(np.uint64)
        parts = values << np.maximum(room, 0).astype(np.uint64)
        parts[crossing] = values[crossing] >> (-room[crossing]).astype(np.uint64)
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[firsts]] = np.bitwise_or.reduceat(parts, firsts)
        out[word[crossing] + 1] |= values[crossing] << (64 + room[crossing]).astype(np.uint64)
    data = out.astype(">u8").view(np.uint8)[: byte_bounds[-1]]
    n_blocks = (counts + BLOCK - 1) // BLOCK
    block_bounds = np.concatenate([[0], np.cumsum(n_blocks)])
    nth = np.arange(block_bounds[-1]) - np.repeat(block_bounds[:-1], n_blocks)
    text = np.repeat(np.arange(len(counts)), n_blocks)
    offsets = ends[bounds[text] + nth * BLOCK] - ends[bounds[text]]
    return data, byte_bounds, offsets, block_bounds


class Decoder:
    """Decodes many blocks side by side with one table over the next ``top`` bits."""

    def __init__(self, lengths: np.ndarray):
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.top = int(lengths.max()) if len(order) else 1
        spans = np.left_shift(1, self.top - lengths[order])
        pad = (1 << self.top) - int(spans.sum())
        self.symbols = np.append(np.repeat(order, spans), np.zeros(pad, np.int64)).astype(np.uint32)
        self.bits = np.append(np.repeat(lengths[order], spans), np.ones(pad, np.int64))

    def decode(self, data: bytes, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of all blocks in turn; ``at``: first bit of each block, ``counts``: its ids."""
        padded = np.frombuffer(data + bytes(8), np.uint8)
        window = np.ndarray(len(padded) - 3, ">u4", padded, strides=(1,))
        firsts = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(firsts[-1], np.uint32)
        order = np.argsort(-counts, kind="stable")
        at, into, left = at[order].copy(), firsts[:-1][order], counts[order]
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))
            now = at[:live]
            bits = (window[now >> 3].astype(np.int64) << (now & 7)) & 0xFFFFFFFF
            index = bits >> (32 - self.top)
            out[into[:live] + step] = self.symbols[index]
            now += self.bits[index]
        return out


# --- jobs ---------------------------------------------------------------------------------------
def _ids(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binary values, and the values' bounds among them."""
    data, offsets = arrays.texts_and_bytes(column)
    return np.frombuffer(data.tobytes(), f"<u{width}"), offsets // width


def _encode_batches(path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays.release()  # a step before may have left much, and this one keeps its pieces
        for batch in batches:
            for part in arrays.slices(batch, "text", arrays.SLICE_BYTES // 2):
                ids, bounds = encode(part.column("text"), path, end_id, width)
                yield pa.RecordBatch.from_arrays([part.column("key"), arrays.binary_array(ids, bounds)], ["key", "ids"])

    return run


def _count_batches(n_ids: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_ids, np.int64)
        for batch in batches:
            counts += np.bincount(_ids(batch.column("ids"), width)[0], minlength=n_ids)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    return run


def _pack_batches(lengths: np.ndarray, width: int):
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("ids")).to_numpy() // width
            group = np.cumsum(sizes) // CHUNK_IDS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(batch)] if len(batch) else [0]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                ids, bounds = _ids(part.column("ids"), width)
                data, byte_bounds, offsets, block_bounds = pack(ids, bounds, lengths, codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(sizes[a:b], pa.int64()),
                        arrays.binary_array(data, byte_bounds),
                        arrays.binary_array(offsets.astype("<u4"), block_bounds),
                    ],
                    ["key", "n", "bits", "blocks"],
                )

    return run


CHUNK_SCHEMA = "part int, first long, keys array<long>, ns array<long>, sizes array<long>, bits binary, blocks binary"


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole documents, in the order in which they come."""
    from pyspark import TaskContext

    part, first = TaskContext.get().partitionId(), 0
    rows: list[dict] = []

    def chunk():
        nonlocal first
        row = {
            "part": part,
            "first": first,
            "keys": [r["key"] for r in rows],
            "ns": [r["n"] for r in rows],
            "sizes": [len(r["bits"]) for r in rows],
            "bits": b"".join(r["bits"] for r in rows),
            "blocks": b"".join(r["blocks"] for r in rows),
        }
        first += sum(row["ns"])
        rows.clear()
        schema = pa.schema(
            [("part", pa.int32()), ("first", pa.int64())]
            + [(c, pa.list_(pa.int64())) for c in ("keys", "ns", "sizes")]
            + [("bits", pa.binary()), ("blocks", pa.binary())]
        )
        return pa.RecordBatch.from_pylist([row], schema)

    held = 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append(row)
            held += row["n"]
            if held >= CHUNK_IDS:
                held = 0
                yield chunk()
    if rows:
        yield chunk()


def _decode_batches(lengths: np.ndarray):
    decoder = Decoder(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["ns"], np.int64)
                n_blocks = (counts + BLOCK - 1) // BLOCK
                starts = np.concatenate([[0], np.cumsum(row["sizes"])])[:-1] * 8
                nth = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
                at = np.repeat(starts, n_blocks) + np.frombuffer(row["blocks"], "<u4")
                ids = decoder.decode(row["bits"], at, np.minimum(np.repeat(counts, n_blocks) - nth * BLOCK, BLOCK))
                bounds = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["keys"], pa.int64()),
                        pa.array(np.full(len(counts), row["part"], np.int32)),
                        pa.array(row["first"] + bounds[:-1]),
                        pa.array(counts),
                        arrays.binary_array(ids.astype("<u4"), bounds),
                    ],
                    ["key", "part", "within", "n_tokens", "ids"],
                )

    return run


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> None:
    """Encodes every text and writes code and ids below ``path``, in rising key order.

    Null and empty texts have the end id only.  A null key comes first; rows that share a key are each
    written, next to each other.  Other columns are not read.  No rows give an empty set of files.
    ``vocabulary`` names the tokenizer's file on every executor.
    """
    n_ids = tokenizer(vocabulary).get_vocab_size(with_added_tokens=True)
    width = 2 if n_ids <= 1 << 16 else 4
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    coded = stored(rows.mapInArrow(_encode_batches(vocabulary, end_id, width), "key long, ids binary"), "token-ids")
    counted = coded.mapInArrow(_count_batches(n_ids, width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(n_ids, np.int64)
    for row in counted.collect():  # as many rows as the vocabulary has ids, at most
        counts[row.id] = row.n
    lengths = code_lengths(counts, limit)
    spark = docs.sparkSession
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    packed = coded.mapInArrow(_pack_batches(lengths, width), "key long, n long, bits binary, blocks binary")
    ordered = packed.repartitionByRange(F.asc_nulls_first("key")).sortWithinPartitions(F.asc_nulls_first("key"), "n", "bits")
    ordered.mapInArrow(_chunk_batches, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/ids")


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids before it), n_tokens and ids (little-endian, four bytes each) of all documents."""
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max([r.id for r in code], default=0) + 1, np.int64)
    for row in code:
        lengths[row.id] = row.bits
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/ids")
    counts = chunks.select("part", F.aggregate("ns", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "token-starts")
    schema = "key long, part int, within long, n_tokens long, ids binary"
    found = chunks.mapInArrow(_decode_batches(lengths), schema).join(F.broadcast(starts), "part")
    return found.select(F.col("key").alias(key), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")
