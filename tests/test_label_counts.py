import math
import random
from collections import Counter

import pytest

from chatterlake.functions import fixed_values as fv
from chatterlake.operators import label_counts as nb

SCHEMA = "id long, content string, sentiment string, score double"
MARKS = {"positive": ["great", "精彩", "win"], "negative": ["awful", "糟糕", "lose"], "neutral": ["match", "比赛", "today"]}


def made(n, seed):
    rng = random.Random(seed)
    filler = ["the", "team", "goal", "ball", "cup", "rain", *[f"w{i}" for i in range(200)]]
    rows = []
    for i in range(n):
        label = rng.choice(fv.LABELS)
        words = [rng.choice(filler) for _ in range(rng.randint(0, 12))] + rng.choices(MARKS[label], k=2)
        rng.shuffle(words)
        rows.append((i, " ".join(words), label, 0.5))
    return rows


def defined(train, text):
    """The label and its probability, written down as defined, over words without Chinese runs."""
    known = [r for r in train if r[2] in fv.LABELS and r[1] is not None]
    counts = {v: Counter(w for r in known if r[2] == v for w in r[1].split()) for v in fv.LABELS}
    n = Counter(r[2] for r in known)
    every = set().union(*counts.values())
    cost = lambda part, whole: -math.floor(math.log(part / whole) / nb.UNIT)
    total = {v: sum(counts[v].values()) + len(every) for v in fv.LABELS}
    sums = [
        cost(n[v] + 1, len(known) + len(fv.LABELS)) + sum(cost(counts[v][w] + 1, total[v]) for w in (text or "").split() if w in every)
        for v in fv.LABELS
    ]
    least = min(sums)
    return fv.LABELS[sums.index(least)], round(1 / sum(math.exp((least - s) * nb.UNIT) for s in sums), 6)


@pytest.mark.parametrize("hot", [1 << 16, 40, 0])
def test_equals_the_definition(spark, monkeypatch, hot):
    monkeypatch.setattr(nb, "HOT_WORDS", hot)
    plain = lambda rows: [(i, t if t is None or t.isascii() else "plain", v, s) for i, t, v, s in rows]
    train = plain(made(150, 1)) + [(900, None, "positive", 0.1), (901, "goal goal", "odd", 0.1), (902, "", "neutral", 0.1), (903, "x", None, None)]
    todo = plain(made(60, 2)) + [(70, None, "", 0.0), (71, "", "", 0.0), (72, "unseen words only", "", 0.0), (73, "goal " * 900, "", 0.0)]
    model = nb.fit(spark.createDataFrame(train, SCHEMA).repartition(5), "content")
    rows = spark.createDataFrame([(i, t, None, None) for i, t, *_ in todo], SCHEMA).repartition(3)
    got = {r.id: (r.sentiment, r.score) for r in nb.label_pending(rows, model, "content", "id").collect()}
    assert len(got) == len(todo)
    for i, text, *_ in todo:
        label, chance = defined(train, text)
        assert got[i][0] == label and got[i][1] == pytest.approx(chance, abs=2e-6)


def test_held_out_labels(spark):
    model = nb.fit(spark.createDataFrame(made(600, 1), SCHEMA), "content")
    held_out = made(300, 2)
    rows = spark.createDataFrame([(i, t, None, None) for i, t, *_ in held_out], SCHEMA)
    got = {r.id: r for r in nb.label_pending(rows, model, "content", "id").collect()}
    assert sum(got[i].sentiment == label for i, _, label, _ in held_out) >= 0.95 * len(held_out)
    assert all(1 / 3 - 1e-6 <= r.score <= 1 for r in got.values())


def test_own_results_stay_and_odd_rows(spark):
    model = nb.fit(spark.createDataFrame(made(200, 3), SCHEMA), "content")
    rows = [(1, "great", "negative", 0.1), (2, None, None, None), (None, "great win", None, None), (3, "awful", None, 0.2), (3, "lose", None, 0.2)]
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], SCHEMA + ", key string, cost_positive long")
    got = nb.label_pending(df, model, "content", "id")
    assert got.columns == df.columns
    found = sorted(got.collect(), key=repr)
    assert len(found) == len(rows) and {r.key for r in found} == {"k"} and {r.cost_positive for r in found} == {5}
    by = lambda key: [(r.sentiment, r.score) for r in found if r.id == key]
    assert by(1) == [("negative", 0.1)] and by(None) == by(2)
    assert by(3)[0] == by(3)[1] and by(3)[0][0] == "negative"


def test_nothing_labelled_and_no_rows(spark):
    none = spark.createDataFrame([(1, "a", None, None)], SCHEMA)
    model = nb.fit(none, "content")
    assert nb.label_pending(none, model, "content", "id").collect() == none.collect()
    model = nb.fit(spark.createDataFrame(made(20, 4), SCHEMA), "content")
    assert nb.label_pending(none.limit(0), model, "content", "id").collect() == []
