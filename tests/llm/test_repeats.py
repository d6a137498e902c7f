import random

import numpy as np
import pyarrow as pa
import pytest

from chatterlake.llm import repeats
from cases import frame, near_copies, row


def brute(rows):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if seen.setdefault(raw[p : p + 100], (r[0], p)) != (r[0], p):
                gone[p : p + 100] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((r[0], len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(map(repr, out))


def got(spark, rows):
    return sorted(
        repr((r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)))
        for r in repeats.remove_repeats(frame(spark, rows)).collect()
    )


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé世") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(8)]
    texts = [r[1] for r in near_copies(seed, 25, 4) if r[1] is None or len(r[1]) < 5000]
    for _ in range(40):
        texts.append(" ".join([word(), *rng.sample(passages, rng.randint(1, 3)), word() * rng.randint(1, 9)]))
    texts += ["a" * 99, "a" * 100, "a" * 101, "a" * 350, "ab" * 200, "xyz" * 70, passages[0], passages[0] + "!", "世" * 120]
    rng.shuffle(texts)
    return [row(None if i == 3 else i * 2 - 9, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SORTED_ROWS", 50)
    rows = made(21 + hot % 7)
    assert got(spark, rows) == brute(rows)


def test_blind_trie_sorts():
    rng = random.Random(4)
    strings = list({bytes(rng.choice(b"ab\x00") for _ in range(9)) for _ in range(400)})
    rng.shuffle(strings)
    assert [strings[i] for i in repeats.blind_trie_order(strings)] == sorted(strings)


def test_sorted_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (500, 60)).astype(np.uint8) * (rng.random((500, 60)) < 0.03)
    groups = rng.integers(0, 4, 500)
    order = repeats.sorted_order(groups, rows.astype(np.uint8))
    keys = [(groups[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    common = bytes(rng.choice(b"abcd") for _ in range(100))
    for _ in range(50):
        data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 90))) + common + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 90)))
        at = data.index(common)
        places, keys = repeats.anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        inside = {(p - at, int(k)) for p, k in zip(places, keys) if at <= p <= at + 60}
        only = repeats.anchors(np.frombuffer(common, np.uint8), np.array([0, 100]))
        assert (int(only[0][0]), int(only[1][0])) in inside


def test_no_rows_and_one_key_twice(spark):
    assert repeats.remove_repeats(frame(spark, [])).collect() == []
    rows = [row(1, "ab" * 30), row(1, "ab" * 30)]
    assert [(r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(frame(spark, rows)).collect()] == [(0, b"ab" * 30)] * 2


def brute_shared_keys(rows):
    """Several rows may share a key: each loses what begins earlier in itself or in a row of a smaller key."""
    at = lambda r: (r[0] is not None, r[0] or 0)
    least = {}
    for r in rows:
        raw = (r[1] or "").encode()
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            least[w] = min(least.get(w, at(r)), at(r))
    out = []
    for r in rows:
        raw, seen = (r[1] or "").encode(), set()
        lost = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            lost[p : p + 100] |= w in seen or least[w] < at(r)
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], lost, [0]])))
        kept = bytes(np.frombuffer(raw, np.uint8)[~lost])
        out.append((r[0], len(raw), int(lost.sum()), list(zip(edges[::2].tolist(), edges[1::2].tolist())), kept))
    return sorted(map(repr, out))


@pytest.mark.parametrize("hot", [100_000, 1])
def test_rows_that_share_a_key(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(31)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, other, equal = text(300), text(200), text(250)
    sides = text(59), text(59)
    rows = [row(0, passage + text(50)), row(0, sides[0] + other[:50] + sides[1])]
    for key in (None, 4):
        rows += [row(key, text(3000) + passage), row(key, text(150)), row(key, equal), row(key, equal)]
        rows += [row(key, None), row(key, ""), row(key, text(700)), row(key, 2 * text(130) + passage), row(key, passage)]
        rows += [row(key, text(59) + other[:50] + text(59)), row(key, sides[0] + other[50:100] + sides[1]), row(key, text(10))]
    assert got(spark, rows) == brute_shared_keys(rows)


def test_places_behind_a_shorter_row():
    """A place of a longer text of the same name comes with the slice's last row."""
    found = pa.array([[{"at": 150, "key": 1}]], pa.list_(pa.struct([("at", pa.int64()), ("key", pa.int64())])))
    part = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([1]), pa.array(["x" * 120]), found], ["id", "twin", "text", "found"])
    for batches in (repeats._context_batches, repeats._window_batches):
        assert [b.num_rows for b in batches(iter([part]))] == [0]
