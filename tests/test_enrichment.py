"""Lookup, resume, model calls and the stream, on small tables with hot keys."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chatterlake.operators import enrichment, lookup, resuming, routing, splitting
from chatterlake.streaming import scoring

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers do not have this module


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def hot_posts(spark):
    """A third of the rows has one text, a tenth has none; ids differ."""
    text = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 10 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("text "), F.col("id") % 50))
    )
    return spark.range(600).select(F.col("id").alias("post_id"), text.alias("content"))


def test_lookup_salts_hot_keys_and_keeps_every_row(spark, hot_posts):
    table = hot_posts.where("content is not null").select("content").distinct().where("content <> 'text 7'")
    table = table.withColumn("value", F.upper("content"))
    hot = lookup.hot_keys(hot_posts, "content", 20)
    assert rows(hot, "content") == [("hot", 10)]
    got = lookup.lookup(hot_posts, table, "content", ["post_id"], rows_per_salt=20)
    want = hot_posts.join(table, "content", "left").select("post_id", "content", "value")
    assert rows(got, "post_id") == rows(want, "post_id")


def test_hot_and_missing_keys_are_spread(spark, hot_posts):
    table = hot_posts.where("content is not null").select("content").distinct().withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lookup.lookup(hot_posts, table, "content", ["post_id"], rows_per_salt=20)
        placed = got.withColumn("part", F.spark_partition_id())
        for kind in ("content = 'hot'", "content is null"):
            parts = placed.where(kind).groupBy("part").count().count()
            assert parts > 1, kind
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_resume_keeps_own_results_and_row_count(spark):
    df = spark.createDataFrame(
        [(1, "a", None, None), (2, "a", "positive", 0.9), (3, None, None, None), (4, "b", None, 0.5), (5, "z", None, None)],
        "post_id long, content string, sentiment string, score double",
    )
    done = spark.createDataFrame(
        [(9, "a", "neutral", None), (8, "a", None, 0.1), (10, "a", "negative", 0.2), (1, None, "negative", 0.3), (2, "b", "unknown", 0.0)],
        "post_id long, content string, sentiment string, score double",
    )
    got = resuming.merge_results(df, done, ["content"], "post_id")
    assert rows(got, "post_id") == [
        (1, "a", "negative", 0.2), (2, "a", "positive", 0.9), (3, None, None, None),
        (4, "b", "unknown", 0.5), (5, "z", None, None),
    ]


def test_resume_without_result_or_key_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "post_id long, content string")
    done = spark.createDataFrame([("a", "positive", 0.5)], "content string, sentiment string, score double")
    got = resuming.merge_results(df, done, ["content"], "post_id")
    assert rows(got, "post_id") == [(1, "a", "positive", 0.5), (2, "b", None, None)]
    other = done.withColumnRenamed("content", "something")
    assert rows(resuming.merge_results(df, other, ["content"], "post_id"), "post_id") == [
        (1, "a", None, None), (2, "b", None, None),
    ]


def test_two_key_columns_do_not_run_together(spark):
    df = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc")], "id long, x string, y string")
    done = spark.createDataFrame([("a", "bc", "positive", 0.5)], "x string, y string, sentiment string, score double")
    got = resuming.merge_results(df, done, ["x", "y"], "id")
    assert [r.sentiment for r in got.orderBy("id").collect()] == [None, "positive"]


def score_of(text):
    if text == "text 8":
        raise TimeoutError("late")
    return f"positive,0.{len(text):02d}"


def expected_scores(posts, blank=("positive", 0.0)):
    out = []
    for post_id, content in rows(posts, "post_id"):
        if content is None:
            out.append((post_id, *blank))
        elif content == "text 8":
            out.append((post_id, "unknown", 0.0))
        else:
            out.append((post_id, "positive", len(content) / 100))
    return out


@pytest.mark.parametrize("parallel, per_salt", [(1, 1_000_000), (5, 20)])
def test_scores_do_not_depend_on_partitions_or_salts(spark, hot_posts, parallel, per_salt):
    got = enrichment.score_rows(
        hot_posts, "content", enrichment.each(score_of), "post_id", parallel=parallel, rows_per_salt=per_salt
    )
    assert rows(got.select("post_id", "sentiment", "score"), "post_id") == expected_scores(hot_posts)


def test_remote_scale_does_not_ask_for_blank_text(spark):
    df = spark.createDataFrame([(1, " 　"), (2, None), (3, " good ")], "post_id long, content string")

    def call(texts):
        assert list(texts) == ["good"]
        return ["negative,-2"]

    got = enrichment.score_rows(df, "content", call, "post_id", "remote", parallel=1)
    assert rows(got.select("post_id", "sentiment", "score"), "post_id") == [
        (1, "neutral", 0.0), (2, "neutral", 0.0), (3, "negative", -1.0),
    ]


def recording(folder):
    """A call that leaves one file per text it is asked for."""

    def call(texts):
        import uuid
        from pathlib import Path

        for text in texts:
            (Path(folder) / uuid.uuid4().hex).write_text(text)
        return ["neutral,0.50"] * len(texts)

    return call


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir())


@pytest.mark.parametrize("waves", [1, 3])
def test_stored_answers_are_not_asked_for_again(spark, tmp_path, hot_posts, waves):
    log = tmp_path / "log"
    log.mkdir()
    path = str(tmp_path / "answers")
    first = hot_posts.where("post_id < 300")
    for df in (first, hot_posts, hot_posts):
        got = enrichment.score_rows(df, "content", recording(log), "post_id", path=path, parallel=2, waves=waves)
        assert got.where("sentiment = 'neutral' and score = 0.5").count() == df.count()
    texts = {c or "" for _, c in rows(hot_posts, "post_id")}
    assert asked(log) == sorted(texts)


def test_a_batch_that_fails_as_a_whole_gives_the_fallback(spark):
    df = spark.createDataFrame([(1, "a")], "post_id long, content string")

    def call(texts):
        raise RuntimeError("down")

    got = enrichment.score_rows(df, "content", call, "post_id")
    assert rows(got.select("sentiment", "score"), "score") == [("unknown", 0.0)]


def test_translation(spark):
    df = spark.createDataFrame(
        [(1, " hello "), (2, "今天天气很好"), (3, "  "), (4, None), (5, "bad"), (6, "done")],
        "id long, comment string",
    ).withColumn("translation", F.when(F.col("id") == 6, "完成"))

    def translate(text):
        if text == "bad":
            raise ValueError("y" * 300)
        return f" <{text}> "

    got = enrichment.translate_rows(df, "comment", "translation", enrichment.each(translate), "id")
    out = {r.id: (r.translation, r.failed) for r in got.collect()}
    assert out == {
        1: ("<hello>", False), 2: ("今天天气很好", False), 3: ("", False), 4: ("", False),
        5: ("[翻译失败:ValueError] " + "y" * 160, True), 6: ("完成", False),
    }
    # the marker is not blank, so a second run leaves it alone; the serial form sends Chinese text too
    again = routing.routed(got, "comment", "translation")
    assert {r.route for r in again.collect()} == {"keep", "blank"}
    serial = routing.routed(df.drop("translation"), "comment", "translation", copy_chinese=False)
    assert {r.id for r in serial.collect() if r.route == "send"} == {1, 2, 5, 6}


def test_pending_and_summary(spark):
    df = spark.createDataFrame(
        [("positive", 0.5), (None, 0.5), ("neutral", None), ("unknown", 0.0)], "sentiment string, score double"
    )
    assert splitting.pending(df).count() == 2
    assert splitting.run_summary(df).first()[:] == (4, 2)
    assert splitting.labelled(df).count() == 2


def test_stream_scores_only_what_is_new(spark, tmp_path, hot_posts):
    source, out, log = tmp_path / "in", str(tmp_path / "out"), tmp_path / "log"
    log.mkdir()
    schema = "post_id long, content string"

    def run():
        stream = scoring.new_files(spark, str(source), schema, files_per_batch=1)
        query = scoring.score_stream(
            stream, "content", recording(log), "post_id", str(tmp_path / "answers"), out, str(tmp_path / "progress")
        )
        query.awaitTermination(120)

    hot_posts.where("post_id < 300").coalesce(2).write.parquet(str(source))
    run()
    assert spark.read.parquet(out).count() == 300
    hot_posts.where("post_id >= 300").coalesce(1).write.mode("append").parquet(str(source))
    run()
    run()
    done = spark.read.parquet(out)
    assert done.count() == 600 and done.select("post_id").distinct().count() == 600
    assert asked(log) == sorted({c or "" for _, c in rows(hot_posts, "post_id")})


def test_answer_stream_knows_earlier_texts_by_its_state(spark, tmp_path, hot_posts):
    source, answers, log = tmp_path / "in", str(tmp_path / "answers"), tmp_path / "log"
    log.mkdir()
    state = []

    def run():
        stream = scoring.new_files(spark, str(source), "post_id long, content string", files_per_batch=1)
        query = scoring.answer_stream(stream, "content", recording(log), answers, str(tmp_path / "progress"))
        query.awaitTermination(120)
        state.extend(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])

    hot_posts.where("post_id < 300").coalesce(2).write.parquet(str(source))
    run()
    hot_posts.where("post_id >= 300").coalesce(1).write.mode("append").parquet(str(source))
    run()
    run()
    texts = {c or "" for _, c in rows(hot_posts, "post_id")}
    assert asked(log) == sorted(texts) and state[-1] == len(texts)
    assert spark.read.parquet(answers).count() == len(texts)

    def never(_):
        raise AssertionError("all texts are answered")

    scored = enrichment.score_rows(hot_posts, "content", never, "post_id", path=answers)
    plain = enrichment.score_rows(hot_posts, "content", recording(tmp_path), "post_id")
    assert rows(scored, "post_id") == rows(plain, "post_id")


def test_json_replies(spark):
    from chatterlake.functions import replies

    df = spark.createDataFrame([(1, "hello"), (2, "x")], "id long, comment string")

    def call(texts):
        return ['{"message":{"content":" %s! "}}' % t if t == "hello" else None for t in texts]

    got = enrichment.translate_rows(df, "comment", "t", call, "id", read=replies.reply_text)
    assert rows(got.select("id", "t", "failed"), "id") == [(1, "hello!", False), (2, "", False)]
    scored = enrichment.score_rows(
        df, "comment", lambda ts: ['{"choices":[{"message":{"content":"positive,0.90"}}]}'] * len(ts), "id",
        read=replies.reply_text,
    )
    assert rows(scored.select("sentiment", "score"), "score") == [("positive", 0.9)] * 2


def test_broken_replies_are_failures(spark):
    from chatterlake.functions import replies

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, comment string")
    bodies = {"a": '{"message":{"content":"x"}}', "b": '{"choices":[]}', "c": "no json"}
    got = enrichment.translate_rows(
        df, "comment", "t", lambda ts: [bodies[t] for t in ts], "id", read=replies.reply_text, broken=replies.broken_reply
    )
    assert rows(got.select("id", "t", "failed"), "id") == [
        (1, "x", False),
        (2, "[翻译失败:IndexError] list index out of range", True),
        (3, "[翻译失败:JSONDecodeError] the reply is no JSON object", True),
    ]


def test_resume_after_a_run_that_left_no_answers(spark, tmp_path):
    path = tmp_path / "answers"
    (path / "_temporary").mkdir(parents=True)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, comment string")
    got = enrichment.score_rows(df, "comment", lambda ts: ["positive,0.50"] * len(ts), "id", path=str(path))
    assert [r.score for r in got.collect()] == [0.5, 0.5]


def test_working_columns_do_not_clash(spark):
    """A table may itself have columns named request, route, parsed, salt or request_key."""
    names = ("request", "route", "parsed", "salt", "salts", "request_key", "text_key", "sentiment_done")
    df = spark.createDataFrame([(1, "a")], "id long, comment string").withColumns({c: F.lit(c) for c in names})
    call = lambda texts: ["positive,0.90"] * len(texts)
    scored = enrichment.score_rows(df, "comment", call, "id").first()
    translated = enrichment.translate_rows(df, "comment", "t", call, "id").first()
    done = spark.createDataFrame([("a", "neutral", 0.5)], "comment string, sentiment string, score double")
    resumed = resuming.merge_results(df, done, ["comment"], "id").first()
    for row in (scored, translated, resumed):
        assert [row[c] for c in names] == list(names)
    assert (scored.sentiment, translated.t, resumed.sentiment) == ("positive", "positive,0.90", "neutral")
