import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chatterlake.llm import token_output as t
from chatterlake.llm.storage import new_folder
from cases import frame, near_copies, row

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b\n\n c\t d ", " lead", "it's  they'll 12 345", "世界　杯  x  y\u0085 z", "a\x1c b", "<|endoftext|> x <|endoftext|>", "é é  é\n", "😀 😀 　 a", "…  b", "​ c", "ñ\xa0 d"]


def whole(texts):
    encoder = Tokenizer.from_file(VOCABULARY)
    return [e.ids + [0] for e in encoder.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_encode_like_whole_texts():
    texts = ODD + [r[1] for r in near_copies(11)] + [None, ""]
    ids, bounds = t.encode(pa.array(texts), VOCABULARY, 0, 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole(texts)


def test_no_cache_room(monkeypatch):
    monkeypatch.setattr(t, "CACHED_PIECES", 3)
    monkeypatch.setattr(t, "JOINED_BYTES", 5)
    ids, bounds = t.encode(pa.array(ODD), VOCABULARY, 0, 4)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole(ODD)


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    return cost


@pytest.mark.parametrize("seed", range(4))
def test_code_is_cheapest_and_limited(seed):
    rng = np.random.default_rng(seed)
    counts = (rng.pareto(0.5, 300) * 5).astype(np.int64)
    wide, narrow = t.code_lengths(counts, 40), t.code_lengths(counts, 9)
    assert (wide * counts).sum() == huffman_cost(counts)
    assert narrow.max() <= 9 and (narrow > 0).tolist() == (counts > 0).tolist()
    for lengths in (wide, narrow):
        assert sum(2.0 ** -lengths[lengths > 0]) <= 1
    codes = [format(c, f"0{n}b") for c, n in zip(t.canonical_codes(narrow), narrow) if n]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_pack_round_trip():
    rng = np.random.default_rng(5)
    bounds = np.array([0, 0, 1, 513, 5000, 5000, 9000])
    ids = rng.geometric(0.02, 9000)
    lengths = t.code_lengths(np.bincount(ids))
    data, byte_bounds, offsets, block_bounds = t.pack(ids, bounds, lengths, t.canonical_codes(lengths))
    decoder = t.Decoder(lengths)
    for i in range(len(bounds) - 1):
        counts = np.array([min(512, bounds[i + 1] - a) for a in range(bounds[i], bounds[i + 1], 512)], np.int64)
        got = decoder.decode(data[byte_bounds[i] : byte_bounds[i + 1]].tobytes(), offsets[block_bounds[i] : block_bounds[i + 1]].astype(np.int64), counts)
        assert got.tolist() == ids[bounds[i] : bounds[i + 1]].tolist()


def written(spark, rows):
    path = new_folder(spark, "test-tokens")
    t.write_tokens(frame(spark, rows), path, VOCABULARY)
    return t.read_tokens(spark, path).collect()


def test_files_hold_all_ids_in_order(spark):
    rows = near_copies(12) + [row(5000 + i, x) for i, x in enumerate(ODD)] + [row(None, "none"), row(7, "again"), row(7, None)]
    got = sorted(written(spark, rows), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda k: (k is not None, k))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    want = sorted((repr(r[0]), ids) for r, ids in zip(rows, whole([r[1] for r in rows])))
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want


def test_no_rows_and_no_words(spark):
    assert written(spark, []) == []
    assert [(r.start, r.n_tokens, bytes(r.ids)) for r in written(spark, [row(1, None)])] == [(0, 1, bytes(4))]
    assert zlib.crc32(bytes(4)) == 0x2144DF1C
