import random

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.operators import sentiment


def made(n, seed):
    rng = random.Random(seed)
    marks = {"positive": ["great", "精彩", "win"], "negative": ["awful", "糟糕", "lose"], "neutral": ["match", "比赛", "today"]}
    filler = ["the", "team", "goal", "ball", "cup", "rain"]
    rows = []
    for i in range(n):
        label = rng.choice(fv.LABELS)
        words = [rng.choice(filler) for _ in range(rng.randint(3, 12))] + rng.choices(marks[label], k=2)
        rng.shuffle(words)
        rows.append((i, " ".join(words), label, 0.5))
    return rows


SCHEMA = "id long, content string, sentiment string, score double"


def test_held_out_labels(spark):
    model = sentiment.fit_labels(spark.createDataFrame(made(600, 1), SCHEMA), "content", features=1 << 10)
    held_out = made(300, 2)
    pending = spark.createDataFrame([(i, t, None, None) for i, t, *_ in held_out], SCHEMA)
    got = {r.id: r for r in sentiment.label_pending(pending, model, "content").collect()}
    right = sum(got[i].sentiment == label for i, _, label, _ in held_out)
    assert right >= 0.95 * len(held_out)
    assert all(1 / 3 - 1e-9 <= r.score <= 1 for r in got.values())


def test_own_results_stay_and_odd_rows_get_one(spark):
    rows = [(1, "great", "negative", 0.1), (2, None, None, None), (3, "", "positive", None), (4, "great win", None, 0.2)]
    model = sentiment.fit_labels(spark.createDataFrame(made(200, 3), SCHEMA), "content", features=1 << 10, most_rows=150)
    got = sentiment.label_pending(spark.createDataFrame(rows, SCHEMA), model, "content")
    assert got.columns == ["id", "content", "sentiment", "score"]
    found = {r.id: r for r in got.collect()}
    assert (found[1].sentiment, found[1].score) == ("negative", 0.1)
    assert all(r.sentiment in fv.LABELS and 0 <= r.score <= 1 for r in found.values())
    assert found[4].sentiment == "positive"


def test_rows_to_fit_on_are_dealt_out(spark):
    """They came through one task, each with its text."""
    rows = [(f"text {i % 40}", float(i % 3)) for i in range(300)] + [("many", 1.0)] * 50
    known = spark.createDataFrame(rows, f"content string, {sentiment.TARGET} double").repartition(7)
    ordered = known.orderBy(F.md5("content"), sentiment.TARGET)
    for most in (1, 17, 200, 350, 1000):
        found = sentiment.smallest(known, "content", most)
        assert sorted(found.collect()) == sorted(ordered.limit(most).collect()), most
        assert found.rdd.getNumPartitions() == sentiment.PIECES
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    assert sentiment.smallest(known.where("false"), "content", 5).count() == 0


def test_all_rows_are_fitted_on(spark):
    """The default was a bound of 200,000 rows."""
    labels = F.array(*[F.lit(v) for v in fv.LABELS])
    rows = spark.range(200_500).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("content"), F.get(labels, (F.col("id") % 3).cast("int")).alias("sentiment"))
    model = sentiment.fit_labels(rows, "content", features=1 << 6)
    assert model.stages[1].numDocs == 200_500


def test_copies_of_a_text_come_apart_and_all_count(spark, monkeypatch):
    monkeypatch.setattr(sentiment, "COPIES", 10)
    monkeypatch.setattr(sentiment, "ROWS_PER_PIECE", 20)
    rows = [("great win", 0.0)] * 405 + [("great win", 1.0)] * 10 + [(f"match {i}", 2.0) for i in range(50)]
    known = spark.createDataFrame(rows, f"content string, {sentiment.TARGET} double")
    counter = HashingTF(inputCol=sentiment.TOKENS, outputCol=sentiment.COUNTS, numFeatures=16)
    parts = sentiment.dealt(known, "content", counter).rdd.glom().map(lambda p: [r[sentiment.TARGET] for r in p]).collect()
    assert len(parts) >= 465 / 20
    assert sorted(sum(parts, [])) == sorted(t for _, t in rows)
    assert max(len(p) for p in parts) < 100
