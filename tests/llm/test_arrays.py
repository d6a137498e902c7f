import random

import numpy as np
import pyarrow as pa

from chatterlake.llm import arrays
from cases import words


def made(rng):
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab \t\né世") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
    column = pa.array(texts, pa.string())
    return (texts[1:], column.slice(1)) if len(texts) > 2 else (texts, column)


def test_words_hashes_and_shingles():
    rng = random.Random(1)
    for _ in range(200):
        texts, column = made(rng)
        w = arrays.split_words(column)
        want = [words(t) for t in texts]
        assert [[bytes(w.data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.bounds, w.bounds[1:])] == want
        flat = [x for ws in want for x in ws]
        hashes = w.hashes()
        assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))
        found, bounds = arrays.shingle_hashes(hashes, w.bounds)
        shingles = [[tuple(x[i : i + 5]) for i in range(len(x) - 4)] if len(x) >= 5 else [tuple(x)] if x else [] for x in want]
        assert [len(x) for x in shingles] == np.diff(bounds).tolist()
        flat = [x for s in shingles for x in s]
        assert len(set(flat)) == len(set(found.tolist())) == len(set(zip(flat, found.tolist())))


def test_hashes_do_not_depend_on_the_place():
    long = "x" * 1000 + "é" * 40
    one, two = (arrays.split_words(pa.array(t)).hashes() for t in ([long, "b"], ["aa b", long]))
    assert one[0] == two[2] and one[1] == two[1]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 90, 3, 40, 2)] + [None])], ["text"])
    parts = list(arrays.slices(batch, "text", 50))
    assert sum(map(len, parts)) == 7 and len(parts) > 1
    assert list(arrays.slices(batch.slice(0, 0), "text")) == []


def test_release_gives_back_the_powers():
    long = arrays.powers(3, 1 << 18).copy()
    assert 3 in arrays.worker_cache("powers")
    arrays.release()
    assert not arrays.worker_cache("powers")
    assert (arrays.powers(3, 1 << 18) == long).all()
