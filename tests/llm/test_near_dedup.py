import random

import numpy as np
import pytest

from chatterlake.llm import near_dedup
from cases import frame, near_copies, row, words


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def test_equals_brute_force(spark):
    rows = near_copies()
    got = near_dedup.near_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_chain_of_links_and_stragglers(spark):
    """Each text links with the next only, and a bucket's first member with few of them."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[i * 4 : i * 4 + 140]) for i in range(12)]
    rows = [row(100 - i, t) for i, t in enumerate(texts)]
    got = near_dedup.near_duplicates(frame(spark, rows))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_missing_and_repeated_keys_and_no_rows(spark):
    rows = [row(None, "a b c"), row(None, "a b c"), row(4, "a b c"), row(4, "a b c"), row(4, "q"), row(9, None)]
    got = sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 1, None, True)] * 2 + [(4, 1, 4, True)] * 3 + [(9, 0, 9, True)], key=repr)
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_kept_rows_have_all_columns(spark):
    rows = near_copies(3)
    kept = near_dedup.first_of_each_group(frame(spark, rows))
    assert {tuple(r) for r in kept.collect()} == {r for r in rows if (r[0], True) in {(i, k) for i, _, _, k in brute(rows)}}


def test_similarity_estimate_is_near():
    rng = np.random.default_rng(1)
    for share, n_b in ((0.3, 900), (0.85, 1000), (0.95, 980)):
        a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
        common = int(share * (len(a) + n_b) / (1 + share))
        b = np.unique(np.concatenate([a[:common], rng.integers(0, 1 << 63, n_b - common, dtype=np.uint64)]))
        r = near_dedup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        got = near_dedup.likely_similarity(r[:1], r[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - share) < 0.12


def test_sketch_of_union_is_the_larger_register():
    sets = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = near_dedup.registers(sets, np.array([0, 1000, 2000]))
    assert (near_dedup.registers(sets, np.array([0, 2000]))[0] == np.maximum(one, two)).all()


@pytest.mark.parametrize("percent", [50, 80])
def test_bands_follow_the_threshold(spark, percent):
    """Pairs barely at the threshold, which the bands for 85 percent would often miss."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(10**9)}" for _ in range(304)]
        n = next(n for n in range(300, 0, -1) if 100 * (300 - n) >= percent * (300 + n))  # shingles that the copy has of its own
        rows += [row(2 * i, " ".join(base)), row(2 * i + 1, " ".join(base[n:] + [f"v{rng.randrange(10**9)}" for _ in range(n)]))]
    got = near_dedup.near_duplicates(frame(spark, rows), percent=percent)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(r[0], r[0] // 2 * 2) for r in rows}
    bands, registers = near_dedup.banding(percent)
    assert bands * registers == near_dedup.REGISTERS and near_dedup.banding(85) == (30, 6)
