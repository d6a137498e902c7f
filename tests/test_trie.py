"""Cutting by the array trie, against a walk that looks up every length at every place."""

import random

import pyarrow as pa
import pytest

from chatterlake.operators import segmentation, trie
from chatterlake.sources.words import word_table


def walked(run, words):
    if not run or run[0] < "一":
        return [run] if run else []
    out, rest = [], ""
    pairs = lambda piece: [piece] if len(piece) == 1 else [piece[i : i + 2] for i in range(len(piece) - 1)]
    at = 0
    while at < len(run):
        size = max((n for n in range(1, len(run) - at + 1) if run[at : at + n] in words), default=0)
        if size:
            out += pairs(rest) + [run[at : at + size]]
            rest, at = "", at + size
        else:
            rest, at = rest + run[at], at + 1
    return out + pairs(rest)


@pytest.mark.parametrize("seed", range(20))
def test_equal_to_the_walk(seed):
    rng = random.Random(seed)
    letters = "世界杯足球比赛𠀀"[: rng.randint(2, 8)]
    made = lambda low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    words = {made(1, 6) for _ in range(rng.choice([0, 1, 5, 40]))}
    rows = [None if rng.random() < 0.1 else [made(1, 30) if rng.random() < 0.8 else "goal7" for _ in range(rng.randint(0, 4))] for _ in range(40)]
    want = [None if row is None else [t for run in row for t in walked(run, words)] for row in rows]
    lists = pa.array([["skipped"], *rows], pa.list_(pa.string())).slice(1)
    built = trie.Trie.of(pa.array(sorted(words, key=lambda _: rng.random()), pa.string()))
    assert trie.cut_lists(lists, ord("一"), built).to_pylist() == want
    assert int(built.is_word.sum()) == len(words)


def test_no_rows_and_a_word_longer_than_all_runs():
    built = trie.Trie.of(pa.array(["世" * 5000, "世"]))
    assert trie.cut_lists(pa.array([], pa.list_(pa.string())), ord("一"), built).to_pylist() == []
    assert trie.cut_lists(pa.array([["世" * 3], [], ["界"]]), ord("一"), built).to_pylist() == [["世"] * 3, [], ["界"]]


def test_a_dictionary_beyond_the_bound_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "今天的足球比赛很好 goal"), (2, None)], "id int, c string")
    words = word_table(spark, ["足球比赛", "今天"])
    here = segmentation.with_tokens(df, "c", words).orderBy("id").collect()
    monkeypatch.setattr(segmentation, "TRIE_CHARS", 5)
    assert segmentation.with_tokens(df, "c", words).orderBy("id").collect() == here


def test_rows_are_cut_in_slices(monkeypatch):
    """All rows of a batch together took some hundred bytes of arrays for each byte of text."""
    rng = random.Random(5)
    rows = [None if i % 7 == 0 else ["足球" * rng.randint(0, 20), "goal"][: rng.randint(0, 2)] for i in range(200)]
    lists, built = pa.array(rows, pa.list_(pa.string())), trie.Trie.of(pa.array(["足球"]))
    want = trie.cut_lists(lists, ord("一"), built)
    sizes, cut = [], trie.cut
    monkeypatch.setattr(trie, "SLICE_BYTES", 300)
    monkeypatch.setattr(trie, "cut", lambda runs, *a: sizes.append(sum(map(len, runs.to_pylist())) * 3) or cut(runs, *a))
    assert trie.cut_lists(lists.slice(3), ord("一"), built).to_pylist() == want.to_pylist()[3:]
    assert len(sizes) > 10 and max(sizes) <= 300 + 140
