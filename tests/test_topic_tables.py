"""The models as tables against a plain version of the same updates, and against the library's fit."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterlake.operators import topic_tables as tt
from chatterlake.operators import topics

THEMES = (["球", "goal", "team", "win", "cup"], ["rain", "sun", "wind", "snow"], ["pay", "tax", "debt", "loan", "rate"])


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(11)
    out = [[], ["goal"], ["goal"], ["once"]]
    for i in range(70):
        theme = THEMES[i % 3]
        out.append([rng.choice(theme if rng.random() < 0.9 else THEMES[0]) for _ in range(rng.randint(1, 40))])
    return out + [["long", *THEMES[1]] * 300]


@pytest.fixture(scope="module")
def texts(spark, documents):
    return spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "id long, tokens array<string>").repartition(4)


def psi(x):
    return topics._digamma(np.asarray(x, float))


def unpacked(row):
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.float32).astype(float)


def plain(data, models_started, k, schedule):
    """Dense updates of one model in double precision: (batch, weight) in turn; word rows by number."""
    first = {r.term_id: np.frombuffer(r.weights, np.float32) for r in models_started.rows.collect()}
    part = list(models_started.layout.parts())[models_started.layout.topic_counts.index(k)]
    lam = np.stack([first[i][part] for i in range(data.n_terms)]).astype(float)
    bags = data.bags.collect()
    gammas = {}
    for batch, weight in schedule:
        beta = np.exp(psi(lam) - psi(lam.sum(0)))
        sums = np.zeros_like(lam)
        for row in (b for b in bags if b.batch == batch):
            ids, c = unpacked(row)
            rows = beta[ids]
            g = gammas.get(row.text, np.ones(k))
            for _ in range(200):
                theta = np.exp(psi(g) - psi(g.sum()))
                new = 1 / k + theta * ((c / (rows @ theta)) @ rows)
                if np.abs(new - g).mean() < 1e-6:
                    break
                g = new
            theta = np.exp(psi(g) - psi(g.sum()))
            gammas[row.text] = g
            sums[ids] += row.weight * (c / (rows @ theta))[:, None] * theta * rows
        factor = data.n_texts / data.batch_sizes[batch]
        lam = (1 - weight) * lam + weight * (1 / k + factor * sums)
    return lam


@pytest.mark.parametrize("batch_texts, pieces", [(1000, 3), (30, 2)])
def test_updates_equal_the_plain_ones(texts, monkeypatch, batch_texts, pieces):
    monkeypatch.setattr(tt, "CLOSE", 1e-6)
    monkeypatch.setattr(tt, "STEPS", 200)
    monkeypatch.setattr(tt, "ROWS_AT_ONCE", 3)
    monkeypatch.setattr(tt, "WORDS_AT_ONCE", 40)
    data = tt.corpus(texts, batch_texts, pieces)
    schedule, seen = [], 0
    for a_pass in range(3):
        for batch in sorted(data.batch_sizes):
            schedule.append((batch, (1 + a_pass + seen / 20) ** -0.5))
            seen += data.batch_sizes[batch]
    models = tt.fitted(data, [2, 4], passes=3, chunk=20)
    got = {r.term_id: np.frombuffer(r.weights, np.float32) for r in models.rows.collect()}
    for k, part in zip((2, 4), models.layout.parts()):
        want = plain(data, tt.started(data, [2, 4]), k, schedule)
        have = np.stack([got[i][part] for i in range(data.n_terms)])
        assert np.allclose(have, want, rtol=0.02, atol=0.05), np.abs(have - want).max()
        assert np.allclose(models.totals[part], have.sum(0), rtol=1e-5)


def test_corpus_tables(texts, documents):
    data = tt.corpus(texts, 30, 2)
    counts = {}
    for d in documents:
        for w in d:
            counts[w] = counts.get(w, 0) + 1
    want = sorted(counts, key=lambda w: (-counts[w], w))
    assert [r.word for r in data.terms.orderBy("term_id").collect()] == want
    assert data.n_texts == sum(map(bool, documents)) == sum(data.batch_sizes.values())
    rows = data.bags.collect()
    assert sum(r.weight * unpacked(r)[1].sum() for r in rows) == sum(map(len, documents))
    assert len({r.text for r in rows}) == len(rows) == len({tuple(d) for d in documents if d})
    needs = {(r.batch, p, r.term_id) for r in data.needs.collect() for p in r.pieces}
    assert needs == {(r.batch, r.piece, i) for r in rows for i in unpacked(r)[0]}


def test_words_keep_their_mass(texts, documents):
    """With one batch and a first weight of 1, a word's weights sum up to its occurrences."""
    models = tt.fitted(tt.corpus(texts), [3, 5], passes=4)
    for k in (3, 5):
        mass = {r.word: r.mass for r in tt.word_mass(models, k).collect()}
        for w in {w for d in documents for w in d}:
            assert mass[w] == pytest.approx(sum(d.count(w) for d in documents), rel=1e-4, abs=1e-3)


def test_figures_follow_neither_order_nor_cores(spark, texts):
    first = tt.sweep(texts, (2, 3), passes=3).orderBy("k").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        second = tt.sweep(texts.orderBy(F.desc("id")).coalesce(2), (2, 3), passes=3).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for a, b in zip(first, second, strict=True):
        assert a.k == b.k and a.bound == pytest.approx(b.bound, rel=1e-9) and a.coherence == pytest.approx(b.coherence, rel=1e-9)


def test_bounds_are_those_of_separate_fits(texts):
    """Both begin at random and end in one of several optima, so the best of three starts are compared."""
    data = tt.corpus(texts)
    ours = max(tt.measures(tt.fitted(data, [3], 12, seed))[0][3] for seed in (1, 2, 3))
    with topics.corpus(texts) as shared:
        theirs = max(topics.per_word_bound(topics.fit(shared.features, 3, 12, seed), shared.features) for seed in (1, 2, 3))
    assert ours == pytest.approx(theirs, rel=0.05)


def test_top_words_and_terms(texts, documents):
    models = tt.fitted(tt.corpus(texts), [2, 3], passes=10)
    top = tt.top_words(models, 4).orderBy("k", "topic", "rank").collect()
    assert [(r.k, r.topic, r.rank) for r in top] == [(k, t, n) for k in (2, 3) for t in range(k) for n in range(1, 5)]
    weights = {r.word: r.weights for r in tt.term_weights(models, 3).collect()}
    assert np.allclose(np.sum(list(weights.values()), axis=0), 1, rtol=1e-5)
    for r in top:
        if r.k == 3:
            assert r.weight == pytest.approx(weights[r.word][r.topic])
            assert r.weight >= sorted((w[r.topic] for w in weights.values()), reverse=True)[r.rank - 1] - 1e-9
    shares = tt.topic_shares(models, 3).collect()
    assert sum(r.share for r in shares) == pytest.approx(1) and sum(r.tokens for r in shares) == pytest.approx(sum(map(len, documents)), rel=1e-5)
    terms = topics.topic_terms(tt.term_weights(models, 3), tt.topic_shares(models, 3), 0.6, 3)
    assert terms.count() == 9


def test_old_tables_go(spark, texts):
    import os

    models = tt.fitted(tt.corpus(texts), [2], passes=3)
    path = models.folder.path
    parent = os.path.dirname(path.removeprefix("file:"))
    kept = [x for x in os.listdir(parent) if x.startswith("topic-models")]
    assert os.path.basename(path) in kept
    assert len([x for x in models.gammas.values() if os.path.isdir(x.path.removeprefix("file:"))]) == 1


def test_no_texts(spark):
    none = spark.createDataFrame([([],), (None,)], "tokens array<string>")
    assert tt.sweep(none, (2, 3), passes=2).count() == 0


def test_narrow_models_take_more_words_at_once():
    """Small slices of narrow models spent most of an update on calls instead of numbers."""
    import pyarrow as pa

    texts = pa.RecordBatch.from_arrays([pa.array([bytes(8 * 500)] * 1000, pa.binary())], ["ids"])
    width = sum(topics.fv.TOPIC_COUNTS)
    assert len(list(tt._slices(texts, width))) > len(list(tt._slices(texts, 5))) == 1
    for w in (5, width, 10 * width):
        assert sum(map(len, tt._slices(texts, w))) == 1000


def test_topics_do_not_follow_the_slices():
    rng = np.random.default_rng(3)
    layout, bounds = tt.Layout((2, 3)), np.cumsum([0, 4, 9, 5, 30, 1, 12])
    beta, n = rng.random((40, 5)).astype(np.float32), len(bounds) - 1
    local, counts = rng.integers(0, 40, bounds[-1]), rng.integers(1, 5, bounds[-1]).astype(np.float32)
    start = np.ones((n, 5), np.float32)
    gamma, theta, norm = tt.text_topics(layout, beta, local, counts, bounds, start)
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        alone = tt.text_topics(layout, beta, local[a:b], counts[a:b], np.array([0, b - a]), start[:1])
        assert np.allclose(alone[0], gamma[i], atol=0.05) and np.allclose(alone[2], norm[a:b], rtol=0.02)
        assert np.allclose(norm[a:b, 0], beta[local[a:b], :2] @ theta[i, :2], rtol=1e-4)


def test_an_update_is_two_jobs_without_a_shuffle(spark, texts):
    """Joins, shuffles and tables of all words took most of an update's time."""
    models = tt.started(tt.corpus(texts, 30, 2), [3])
    spark.sparkContext.setJobGroup("one update", "")
    try:
        tt.updated(models, 0, 1.0)
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup("one update")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(j.stageIds) for j in jobs] == [1, 1]


def test_each_model_of_a_sweep_ends_alone():
    """A text's topics in one model went on changing until those in all others stood still."""
    rng = np.random.default_rng(5)
    bounds = np.cumsum([0, 40, 9, 50, 30, 3, 12])
    beta, n = rng.random((60, 25)).astype(np.float32) ** 8, len(bounds) - 1
    local, counts = rng.integers(0, 60, bounds[-1]), rng.integers(1, 5, bounds[-1]).astype(np.float32)
    start = np.ones((n, 25), np.float32)
    both = tt.text_topics(tt.Layout((5, 20)), beta, local, counts, bounds, start)[0]
    for k, part in ((5, slice(0, 5)), (20, slice(5, 25))):
        alone = tt.text_topics(tt.Layout((k,)), np.ascontiguousarray(beta[:, part]), local, counts, bounds, start[:, part])[0]
        assert np.allclose(both[:, part], alone, rtol=1e-5, atol=1e-6)


def test_words_of_texts_are_not_rows_of_a_table(spark, documents, monkeypatch):
    """A row for each text and word was written, and moved twice; a piece has a row for each of its own words."""
    names = {}
    kept = tt.stored
    monkeypatch.setattr(tt, "stored", lambda df, name: names.setdefault(name, kept(df, name)))
    tt.corpus(spark.createDataFrame([(d,) for d in documents], "tokens array<string>"), 1000, 1)
    assert names["piece-words"].count() == len({w for d in documents for w in d}) + 1
    assert set(names) == {"tokens", "piece-words", "word-counts", "terms"}


def test_shuffles_go_when_a_table_is_written(spark):
    from chatterlake.storage import Folder

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in map(str, disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before = files()
    Folder.write(spark.range(1000).groupBy((F.col("id") % 7).alias("a")).count(), "grouped")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before


def test_fewer_words_than_parts(spark):
    few = spark.createDataFrame([(["b", "a", "b"],), (["a"],)], "tokens array<string>")
    models = tt.fitted(tt.corpus(few), [2], passes=2)
    assert {r.word: round(r.mass) for r in tt.word_mass(models, 2).collect()} == {"a": 2, "b": 2}
    assert tt.top_words(models, 4).count() == 4
    none = tt.fitted(tt.corpus(few.where("false")), [2], passes=2)
    assert none.rows.count() == tt.top_words(none, 4).count() == tt.word_mass(none, 2).count() == 0
