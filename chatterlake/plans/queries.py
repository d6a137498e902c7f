"""The registered queries: every operator over the given tables, or over what derives from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions import replies, text, times, tokens
from chatterlake.operators import (
    bags,
    cleaning,
    cooccurrence,
    enrichment,
    label_counts,
    ranking,
    resuming,
    routing,
    segmentation,
    sentiment,
    splitting,
    topic_tables,
    topics,
    trends,
    words,
)
from chatterlake.plans.fixtures import as_posts, comments, posts, table
from chatterlake.session import shared_folder
from chatterlake.sources import csv_splits, row_ids
from chatterlake.sources import tables as sources
from chatterlake.sources.words import word_table
from chatterlake.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WINDOW_WORDS = ("and", "das", "der", "et", "goal", "ist", "les", "of", "que", "the", "und", "比赛", "足球")
USER_WORDS = ("世界杯", "比赛", "足球", "足球比赛", "非常精彩")
SYSTEM_TEXT = "Give the mood of the text as label,score."
LIST_SIZE = fv.COHERENCE_TOP_WORDS
CSV_SPLIT_BYTES = 1 << 20


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _day():
    return times.day_of("posted_at")


# --- scans and cleaning -----------------------------------------------------------------------
@query
def scan_posts(spark, sf_dir):
    return posts(spark, sf_dir)


@query
def preview(spark, sf_dir):
    return sources.preview(posts(spark, sf_dir), "post_id")


@query
def null_literals(spark, sf_dir):
    """Cells that hold each of the null literals, and some that only look like one."""
    cells = F.array(*[F.lit(v) for v in (*fv.NULL_LITERALS, " NA", "na", "Null")])
    docs = table(spark, sf_dir, "documents")
    cell = F.coalesce(F.get(cells, (F.col("doc_id") % 29).cast("int")), F.col("source"))
    return sources.null_literals(docs.select("doc_id", cell.alias("cell")))


@query
def csv_by_splits(spark, sf_dir):
    """Posts written as CSV, line breaks and quotes within cells too, and read back by byte ranges."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = posts(spark, sf_dir, ("post_id", "content", "lang", "source"))
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(header=True, escape='"', quoteAll=True, **kept).csv(path)
    schema = "post_id bigint, content string, lang string, source string"
    return csv_splits.read_large_csv(spark, path, schema, split_bytes=CSV_SPLIT_BYTES)


@query
def clean_posts(spark, sf_dir):
    rows = posts(spark, sf_dir, ("content", "lang", "source", "posted_at", "sentiment", "score"))
    return cleaning.clean_rows(rows, "content")


@query
def dedupe_by_text(spark, sf_dir):
    return cleaning.first_per_text(
        posts(spark, sf_dir, ("post_id", "content", "lang", "source")), "content", "post_id"
    )


@query
def first_without_key(spark, sf_dir):
    """Posts stored without their key, in its order: the first of each text, and its place among all rows."""
    path = f"{shared_folder(spark)}/keyless-{uuid.uuid4().hex}"
    rows = posts(spark, sf_dir, ("post_id", "content", "lang", "source"))
    rows = rows.repartitionByRange("post_id").sortWithinPartitions("post_id").drop("post_id")
    rows.write.parquet(path)
    placed = ranking.numbered(row_ids.read_table_with_ids(spark, path), "row_id", into="position").drop("row_id")
    return cleaning.first_per_text(placed, "content", "position")


@query
def parse_time(spark, sf_dir):
    parsed = times.parse_time("posted_at")
    return posts(spark, sf_dir, ("post_id", "posted_at")).select(
        "post_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("at"), F.to_date(parsed).alias("day")
    )


@query
def dataset_summary(spark, sf_dir):
    """Posts and comments in one run: rows, rows with text, distinct texts of each."""
    both = sources.datasets(
        posts=posts(spark, sf_dir, ("content",)),
        comments=comments(spark, sf_dir).select(F.col("comment").alias("content")),
    )
    per_text = both.groupBy("dataset", "content").agg(F.count("*").alias("n"))
    return per_text.groupBy("dataset").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~text.is_blank("content"), F.col("n")).otherwise(0)).alias("with_text"),
        F.count("content").alias("texts"),
    )


# --- trends and labels ------------------------------------------------------------------------
@query
def posts_per_day(spark, sf_dir):
    return trends.rows_per_day(posts(spark, sf_dir, ("posted_at",)), _day())


@query
def sentiment_per_day(spark, sf_dir):
    return trends.labels_per_day(posts(spark, sf_dir, ("posted_at", "sentiment")), _day())


@query
def avg_sentiment_per_day(spark, sf_dir):
    return trends.average_per_day(posts(spark, sf_dir, ("posted_at", "score")), _day(), decimals=6)


@query
def daily_trends(spark, sf_dir):
    return trends.daily_trends(
        posts(spark, sf_dir, ("posted_at", "sentiment", "score")), _day(), decimals=6
    )


@query
def cleaned_sentiment_per_day(spark, sf_dir):
    """Clean, then labels per day: the flagship."""
    return trends.labels_per_day(clean_posts(spark, sf_dir), _day())


@query
def events_per_day(spark, sf_dir):
    """The trends over a second table, with its event types as labels."""
    return trends.daily_trends(
        table(spark, sf_dir, "events"),
        F.to_date("ts"),
        label="event_type",
        score="value",
        labels=("click", "error", "purchase", "signup", "view"),
        decimals=4,
    )


def _split(label: str) -> Query:
    def split(spark, sf_dir):
        return splitting.with_label(
            posts(spark, sf_dir, ("post_id", "content", "sentiment", "score")), label
        )

    split.__name__ = f"split_{label}"
    return split


for _label in fv.LABELS:
    query(_split(_label))


@query
def run_summary(spark, sf_dir):
    return splitting.run_summary(posts(spark, sf_dir, ("sentiment", "score")))


@query
def pending_rows(spark, sf_dir):
    return splitting.pending(posts(spark, sf_dir, ("post_id", "sentiment", "score")))


# --- text -------------------------------------------------------------------------------------
def _per_post(column) -> Query:
    def run(spark, sf_dir):
        rows = posts(spark, sf_dir, ("post_id", "content"))
        return rows.select("post_id", *column())

    return run


QUERIES["strip_text"] = _per_post(lambda: [text.strip("content").alias("stripped")])
QUERIES["strip_urls"] = _per_post(lambda: [text.remove_urls("content").alias("without_urls")])
QUERIES["clean_text"] = _per_post(lambda: [text.clean_text("content").alias("cleaned")])
QUERIES["text_steps"] = _per_post(
    lambda: [
        text.urls_to_space("content").alias("urls"),
        text.mentions_to_space("content").alias("mentions"),
        text.unwrap_hash_topics("content").alias("hash_topics"),
        text.keycaps_to_space("content").alias("keycaps"),
    ]
)
QUERIES["chinese_flag"] = _per_post(
    lambda: [
        text.is_chinese("content").alias("chinese"),
        F.round(text.chinese_share("content"), 6).alias("share"),
    ]
)


def _joined(array):
    return F.array_join(array, "|")


QUERIES["segment"] = _per_post(
    lambda: [_joined(tokens.segment(text.clean_text("content"))).alias("tokens")]
)
QUERIES["token_rules"] = _per_post(
    lambda: [
        _joined(tokens.cloud_tokens(tokens.segment(text.clean_text("content")))).alias("words")
    ]
)


def _topic_tokens(stop_words: Sequence[str] = fv.TOPIC_STOP_WORDS):
    return tokens.topic_tokens(tokens.segment(tokens.topic_text("content")), stop_words)


QUERIES["lda_tokens"] = _per_post(lambda: [_joined(_topic_tokens()).alias("tokens")])


@query
def segment_with_dictionary(spark, sf_dir):
    rows = posts(spark, sf_dir, ("post_id", "content"))
    cut = segmentation.with_tokens(rows, "content", word_table(spark, USER_WORDS))
    return cut.select("post_id", _joined(F.col("tokens")).alias("tokens"))


# --- replies and requests ---------------------------------------------------------------------
@query
def parse_local(spark, sf_dir):
    return posts(spark, sf_dir, ("post_id", "reply")).select(
        "post_id", F.inline(F.array(replies.parse_local("reply")))
    )


@query
def parse_remote(spark, sf_dir):
    return posts(spark, sf_dir, ("post_id", "reply")).select(
        "post_id", F.inline(F.array(replies.parse_remote("reply")))
    )


@query
def parse_remote_decimals(spark, sf_dir):
    """Scores with more than two decimals, made from the document lengths: all rounding cases."""
    docs = table(spark, sf_dir, "documents")
    number = F.format_string("%.3f", ((F.col("n_chars") * 7 + F.col("doc_id")) % 2001 - 1000) / 1000)
    made = docs.select("doc_id", F.concat(F.lit("Positive, "), number).alias("reply"))
    return made.select("doc_id", F.inline(F.array(replies.parse_remote("reply"))))


@query
def reply_text(spark, sf_dir):
    """Reply bodies of each form around the post's text."""
    message = lambda c: F.struct(F.struct(c.alias("content")).alias("message"))
    choice = lambda c: F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("message"))).alias("choices"))
    content = F.col("content")
    body = (
        F.when(F.col("post_id") % 6 == 0, F.to_json(message(content)))
        .when(F.col("post_id") % 6 == 1, F.to_json(choice(content)))
        .when(F.col("post_id") % 6 == 2, F.lit('{"error":"none"}'))
        .when(F.col("post_id") % 6 == 3, F.lit('{"message":null}'))
        .when(F.col("post_id") % 6 == 4, F.lit('{"choices":[]}'))
        .otherwise(F.lit("no json"))
    )
    rows = posts(spark, sf_dir, ("post_id", "content")).withColumn("body", body)
    return rows.select(
        "post_id",
        replies.reply_text("body").alias("text"),
        replies.first_choice_text("body").alias("choice_text"),
        replies.broken_reply("body").getField("type").alias("error"),
        replies.broken_choice("body").getField("type").alias("choice_error"),
    )


@query
def model_request(spark, sf_dir):
    rows = posts(spark, sf_dir, ("post_id", "content"))
    requests = [
        replies.chat_request("m", SYSTEM_TEXT, "content", **options).alias(f"{form}_request")
        for form, options in fv.REQUEST_OPTIONS.items()
    ]
    return rows.select("post_id", *requests)


@query
def failed_marker(spark, sf_dir):
    rows = posts(spark, sf_dir, ("post_id", "content", "source"))
    kind = F.concat(F.lit("Error_"), F.col("source"))
    message = F.coalesce(F.col("content"), F.lit("no text"))
    marked = rows.select(
        "post_id",
        replies.failed_marker(kind, message, "concurrent").alias("concurrent"),
        replies.failed_marker(kind, message, "serial").alias("serial"),
    )
    return marked.withColumn("failed", replies.is_failed("concurrent"))


# --- words ------------------------------------------------------------------------------------
@query
def word_freq(spark, sf_dir):
    return words.word_counts(posts(spark, sf_dir, ("content",)), "content")


@query
def positive_word_freq(spark, sf_dir):
    rows = splitting.with_label(posts(spark, sf_dir, ("content", "sentiment")), "positive")
    return words.word_counts(rows, "content")


@query
def wordcloud_input(spark, sf_dir):
    return words.top_words(word_freq(spark, sf_dir), fv.CLOUD_TOP_N)


@query
def top50_words(spark, sf_dir):
    return words.top_words(word_freq(spark, sf_dir), fv.PREVIEW_TOP_N)


@query
def stopword_union(spark, sf_dir):
    """The default list and, as the user's own, the ten most frequent words."""
    frequent = words.word_counts(posts(spark, sf_dir, ("content",)), "content", stop_words=())
    return words.stop_word_union(
        word_table(spark, fv.CLOUD_STOP_WORDS), words.top_words(frequent, 10)
    )


@query
def stopword_removal(spark, sf_dir):
    """Word counts without a stop-word table that is itself derived from the texts."""
    return words.word_counts(
        posts(spark, sf_dir, ("content",)), "content", stop_words=stopword_union(spark, sf_dir)
    )


# --- routing, resume, enrichment --------------------------------------------------------------
@query
def translation_route(spark, sf_dir):
    rows = comments(spark, sf_dir)
    serial = routing.route("comment", "translation", copy_chinese=False).alias("serial_route")
    return routing.routed(rows.withColumn("serial_route", serial), "comment", "translation").drop("comment")


@query
def distinct_requests(spark, sf_dir):
    routed = routing.routed(comments(spark, sf_dir), "comment", "translation")
    return routing.distinct_requests(routed.where(F.col("route") == routing.SEND), "comment")


@query
def resume_merge(spark, sf_dir):
    """Posts take over what an earlier run, here the parsed replies, found for the same text."""
    parsed = replies.parse_local("reply")
    known = F.when(parsed.sentiment != fv.UNKNOWN, parsed.sentiment)
    done = posts(spark, sf_dir, ("post_id", "content", "reply")).select(
        "post_id", "content", known.alias("sentiment"), F.when(known.isNotNull() & (F.col("post_id") % 5 != 0), parsed.score).alias("score")
    )
    rows = posts(spark, sf_dir, ("post_id", "content", "sentiment", "score"))
    return resuming.merge_results(rows, done, ["content"], "post_id").select("post_id", "sentiment", "score")


def _recorded(spark, sf_dir):
    return enrichment.recorded(posts(spark, sf_dir, ("post_id", "content", "reply")), "content", "reply", "post_id")


@query
def enrich_local(spark, sf_dir):
    rows = posts(spark, sf_dir, ("post_id", "content", "sentiment", "score"))
    scored = enrichment.score_rows(rows, "content", _recorded(spark, sf_dir), "post_id", "local")
    return scored.select("post_id", "sentiment", "score")


@query
def enrich_remote(spark, sf_dir):
    rows = posts(spark, sf_dir, ("post_id", "content", "sentiment", "score"))
    replies_by_stripped = posts(spark, sf_dir, ("post_id", "content", "reply")).withColumn(
        "content", text.strip("content")
    )
    recorded = enrichment.recorded(replies_by_stripped, "content", "reply", "post_id")
    scored = enrichment.score_rows(rows, "content", recorded, "post_id", "remote")
    return scored.select("post_id", "sentiment", "score")


def _label_by_length(text: str) -> str:
    """Stands in for a model: the reply depends on the text's length."""
    if len(text) % 11 == 0:
        raise TimeoutError("no reply")
    return f"{fv.LABELS[len(text) % 3]},0.{len(text) % 100:02d}"


@query
def enrich_called(spark, sf_dir):
    """Every pending post through the batch call, each distinct text once."""
    rows = posts(spark, sf_dir, ("post_id", "content", "sentiment", "score"))
    call = enrichment.each(_label_by_length)
    scored = enrichment.score_rows(rows, "content", call, "post_id", "local")
    return scored.select("post_id", "sentiment", "score")


@query
def model_labels(spark, sf_dir):
    """The model of the labelled posts for all others; shown is what does not depend on its weights."""
    rows = posts(spark, sf_dir, ("post_id", "content", "sentiment", "score"))
    model = sentiment.fit_labels(rows, "content")
    own = F.col("sentiment").isNotNull() & F.col("score").isNotNull()
    marked = rows.withColumns({"own_sentiment": F.when(own, F.col("sentiment")), "own_score": F.when(own, F.col("score"))})
    found = sentiment.label_pending(marked, model, "content")
    valid = F.col("sentiment").isin(*fv.LABELS) & F.col("score").between(0.0, 1.0)
    unchanged = F.coalesce((F.col("own_sentiment") == F.col("sentiment")) & (F.col("own_score") == F.col("score")), F.lit(True))
    return found.select("post_id", "own_sentiment", "own_score", (valid & unchanged).alias("valid"))


@query
def label_words(spark, sf_dir):
    """The words of the count model of the labelled posts, with their costs."""
    model = label_counts.fit(posts(spark, sf_dir, ("content", "sentiment")), "content")
    return model.words.read()


@query
def labels_by_counts(spark, sf_dir):
    """The count model of the labelled posts for all others."""
    rows = posts(spark, sf_dir, ("post_id", "content", "sentiment", "score"))
    found = label_counts.label_pending(rows, label_counts.fit(rows, "content"), "content", "post_id")
    return found.select("post_id", "sentiment", "score")


@query
def stream_scores(spark, sf_dir):
    """The same calls for all posts as they arrive, with stored answers."""
    docs = table(spark, sf_dir, "documents")
    # a pattern takes a table of one file as well as a folder
    arriving = scoring.new_files(spark, f"{sf_dir}/documents.parquet*", docs.schema)
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = scoring.score_stream(
        as_posts(arriving, ("post_id", "content")),
        "content",
        enrichment.each(_label_by_length),
        "post_id",
        f"{run}/answers",
        f"{run}/out",
        f"{run}/progress",
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{run}/out").select("post_id", "sentiment", "score")


@query
def stream_answers(spark, sf_dir):
    """One answer for each distinct text of the posts as they arrive; the stream's state knows the texts so far."""
    docs = table(spark, sf_dir, "documents")
    arriving = scoring.new_files(spark, f"{sf_dir}/documents.parquet*", docs.schema)
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    call = enrichment.each(_label_by_length)
    scoring.answer_stream(as_posts(arriving, ("content",)), "content", call, f"{run}/answers", f"{run}/progress").awaitTermination()
    return spark.read.parquet(f"{run}/answers").select("request_key", "reply", "error_type")


def _translate_by_length(text: str) -> str:
    if len(text) % 5 == 0:
        raise ValueError(f"cannot translate: {text}")
    return f" 译文 {len(text)} "


@query
def translate_comments(spark, sf_dir):
    rows = comments(spark, sf_dir)
    call = enrichment.each(_translate_by_length)
    return enrichment.translate_rows(rows, "comment", "translation", call, "comment_id").drop("comment")


# --- bags, windows, topics --------------------------------------------------------------------
def _topic_texts(spark, sf_dir, *extra: str) -> DataFrame:
    """One row per distinct text, with its topic tokens."""
    rows = posts(spark, sf_dir, ("post_id", "content", *extra))
    first = cleaning.first_per_text(rows, "content", "post_id")
    return first.select("post_id", *extra, _topic_tokens().alias("tokens"))


@query
def bag_of_words(spark, sf_dir):
    return bags.bag_of_words(_topic_texts(spark, sf_dir), "post_id", F.col("tokens"))


@query
def vocabulary(spark, sf_dir):
    return bags.vocabulary(bag_of_words(spark, sf_dir))


@query
def window_cooccurrence(spark, sf_dir):
    counts = cooccurrence.window_counts(
        _topic_texts(spark, sf_dir), F.col("tokens"), {"all": list(WINDOW_WORDS)}
    )
    return counts


def _frequent_by_lang(texts: DataFrame) -> DataFrame:
    counted = texts.select("lang", F.explode("tokens").alias("word")).groupBy("lang", "word").count()
    best = F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("count"), F.asc("word"))
    )
    ranked = counted.withColumn("rank", best).where(F.col("rank") <= LIST_SIZE)
    return ranked.select(F.col("lang").alias("topic"), "word")


@query
def coherence_by_lang(spark, sf_dir):
    """c_v of the most frequent words of each language: the measure without a model, so exact."""
    with topics.kept(_topic_texts(spark, sf_dir, "lang")) as texts:
        scores = cooccurrence.coherence(texts, F.col("tokens"), _frequent_by_lang(texts))
    return scores.select("topic", F.round("coherence", 6).alias("coherence"))


SWEEP_COUNTS = fv.TOPIC_COUNTS
SWEEP_PASSES = fv.LDA_PASSES


@query
def topic_sweep(spark, sf_dir):
    """All 18 topic counts with all passes, fitted together."""
    return topic_tables.sweep(_topic_texts(spark, sf_dir), SWEEP_COUNTS, SWEEP_PASSES)


def _models(spark, sf_dir, k: int = 5, passes: int | None = None) -> topic_tables.Models:
    return topic_tables.fitted(topic_tables.corpus(_topic_texts(spark, sf_dir)), [k], passes or SWEEP_PASSES)


@query
def topic_words(spark, sf_dir):
    return topic_tables.top_words(_models(spark, sf_dir)).select("topic", "rank", "word", "weight")


@query
def topic_coherence(spark, sf_dir):
    return topic_tables.coherences(_models(spark, sf_dir)).select("topic", "coherence")


@query
def topic_relevance(spark, sf_dir):
    models = _models(spark, sf_dir)
    return topics.topic_terms(topic_tables.term_weights(models, 5), topic_tables.topic_shares(models, 5))


@query
def topic_mass(spark, sf_dir):
    """Each word's weight over all topics of a fitted model, less the priors: an exact word count."""
    models = _models(spark, sf_dir, passes=3)  # it holds after every pass
    return topic_tables.word_mass(models, 5).select("word", F.round("mass").cast("long").alias("mass"))


@query
def numbered_vocabulary(spark, sf_dir):
    return topic_tables.vocabulary(bag_of_words(spark, sf_dir))


@query
def relevance_by_lang(spark, sf_dir):
    """The words of each language by relevance: the measure with languages as topics, so exact."""
    with topics.kept(_topic_texts(spark, sf_dir, "lang")) as texts:
        counted = texts.select("lang", F.explode("tokens").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
        totals = sorted(counted.groupBy("lang").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.lang)  # few languages
        whole = sum(r.n for r in totals)
        shares = spark.createDataFrame(
            [(i, float(r.n), r.n / whole) for i, r in enumerate(totals)], "topic int, tokens double, share double"
        )
        weight = lambda r: F.coalesce(F.sum(F.when(F.col("lang") == r.lang, F.col("n"))), F.lit(0)) / F.lit(float(r.n))
        weights = counted.groupBy("word").agg(F.array(*[weight(r) for r in totals]).alias("weights"))
        terms = topics.topic_terms(weights, shares)
        langs = F.array(*[F.lit(r.lang) for r in totals])
        rounded = [F.round(c, 6).alias(c) for c in ("relevance", "saliency", "topic_of_word", "topic_share")]
        return terms.select(F.get(langs, "topic").alias("lang"), "word", F.round("term_freq").cast("long").alias("term_freq"), *rounded)
