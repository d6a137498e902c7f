"""Results of a caller-supplied model for each distinct text, joined back to the rows.

The model call itself is the caller's: a function from a list of texts to a list of replies, run in
``mapInPandas`` on the distinct texts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions.replies import failed_marker, parse_local, parse_remote
from chatterlake.functions.text import is_blank, strip
from chatterlake.operators.lookup import ROWS_PER_SALT, lookup
from chatterlake.operators.resuming import with_result_columns
from chatterlake.operators.routing import SEND, routed
from chatterlake.operators.splitting import is_pending
from chatterlake.session import shared_folder
from chatterlake.sources.tables import path_exists, remove

Call = Callable[[Sequence[str]], Sequence[str | None | Exception]]
Answers = Call | DataFrame  # a function to call, or recorded answers

# names of working columns: the caller's tables may have any others
REQUEST, KEY, PARSED, ROUTE = "__request", "__request_key", "__parsed", "__route"

ANSWER_SCHEMA = "request_key string, reply string, error_type string, error_message string"
STORED_SCHEMA = f"{ANSWER_SCHEMA}, answered_at timestamp"


def each(function: Callable[[str], str | None]) -> Call:
    """Turns a function of one text into a batch function; an exception is kept as the answer."""

    def call(texts: Sequence[str]) -> list[str | None | Exception]:
        answers: list[str | None | Exception] = []
        for text in texts:
            try:
                answers.append(function(text))
            except Exception as error:  # the caller's code: any failure is an answer
                answers.append(error)
        return answers

    return call


def ask(requests: DataFrame, call: Call, parallel: int | None = None) -> DataFrame:
    """request_key, request -> request_key, reply, error_type, error_message.

    The requests are dealt by key over as many tasks as any shuffle has, so the calls in flight are as
    many as the executors have cores.  ``parallel`` is for a model that takes no more calls at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["request"].tolist()
            try:
                answers = list(call(texts))
            except Exception as error:
                answers = [error] * len(texts)
            failed = [isinstance(a, Exception) for a in answers]
            yield pd.DataFrame(
                {
                    "request_key": batch["request_key"],
                    "reply": [None if bad else a for a, bad in zip(answers, failed)],
                    "error_type": [type(a).__name__ if bad else None for a, bad in zip(answers, failed)],
                    "error_message": [str(a) if bad else None for a, bad in zip(answers, failed)],
                }
            )

    wanted = requests.select("request_key", "request")
    tasks = parallel or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = wanted.repartition(tasks, "request_key")  # a set number: few bytes, but many calls
    return spread.mapInPandas(run, ANSWER_SCHEMA)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """request_key, request, n_rows from rows with a request; null is sent as ''."""
    text = F.coalesce(F.col(REQUEST), F.lit(""))
    counted = rows.groupBy(text.alias("request")).agg(F.count("*").alias("n_rows"))
    return counted.select(F.md5("request").alias("request_key"), "request", "n_rows")


def stored_answers(path: str, wanted: DataFrame) -> DataFrame:
    """The stored answers to the wanted requests, one per key: the earliest, should two runs have
    asked for the same text.

    Only wanted ones reach the aggregation, so a small batch does not pay for a long history.
    """
    rest = ["reply", "error_type", "error_message"]
    first = F.min_by(F.struct(*rest), "answered_at").alias("first")
    stored = wanted.sparkSession.read.schema(STORED_SCHEMA).parquet(path).join(wanted.select("request_key"), "request_key", "left_semi")
    return stored.groupBy("request_key").agg(first).select("request_key", "first.*")


def answer_all(requests: DataFrame, call: Call, path: str, parallel: int | None = None, waves: int = 1) -> DataFrame:
    """Asks for what ``path`` does not hold yet, appends the answers there, and reads them back.

    The stored answers are cache and progress log in one.  Each of the ``waves`` commits on its
    own, so a lost job repeats one wave at most; the open requests are written once beforehand, so
    the source is not read again for each wave.
    """
    spark = requests.sparkSession
    fresh = requests
    if path_exists(spark, path):
        known = spark.read.schema(STORED_SCHEMA).parquet(path).select("request_key")  # a run may have left none
        fresh = fresh.join(known, "request_key", "left_anti")

    def store(open_requests: DataFrame) -> None:
        answers = ask(open_requests, call, parallel)
        answers.withColumn("answered_at", F.current_timestamp()).write.mode("append").parquet(path)

    if waves == 1:
        store(fresh)
    else:
        run = spark.range(1).select(F.expr("uuid()")).first()[0]
        queue = f"{shared_folder(spark)}/requests-{run}"
        wave = F.pmod(F.xxhash64("request_key"), F.lit(waves)).cast("int")
        fresh.withColumn("wave", wave).write.partitionBy("wave").parquet(queue)
        queued = spark.read.schema("request_key string, request string, n_rows long, wave int").parquet(queue)
        try:
            for number in range(waves):
                store(queued.where(F.col("wave") == number))
        finally:
            remove(spark, queue)
    return stored_answers(path, requests)


def with_answers(
    rows: DataFrame,
    source: Answers,
    results: dict[str, Column],
    row_key: str,
    path: str | None = None,
    parallel: int | None = None,
    waves: int = 1,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Rows with a request, plus ``results``: expressions over the answer columns.

    Results are worked out once per distinct request; only they are joined to the rows.  Without
    ``path`` the calls are part of the returned plan: good for calls that may be repeated when a
    task is.  With ``path`` they are stored first and never repeated.
    """
    if isinstance(source, DataFrame):
        answers = source
    else:
        requests = distinct_texts(rows)
        answers = (
            ask(requests, source, parallel)
            if path is None
            else answer_all(requests, source, path, parallel, waves)
        )
    found = answers.select(
        F.col("request_key").alias(KEY), *[c.alias(name) for name, c in results.items()]
    )
    keyed = rows.withColumn(KEY, F.md5(F.coalesce(F.col(REQUEST), F.lit(""))))
    return lookup(keyed, found, KEY, [row_key], rows_per_salt)


def score_rows(
    df: DataFrame,
    text: str,
    source: Answers,
    row_key: str,
    scale: str = "local",
    path: str | None = None,
    parallel: int | None = None,
    waves: int = 1,
    rows_per_salt: int = ROWS_PER_SALT,
    read: Callable[[str], Column] = F.col,
) -> DataFrame:
    """Label and score for every pending row; rows that have both are returned as they are.

    A failed call has a null reply, which the parsers turn into their fallback, as they do for a
    text without any answer.  On the remote scale blank texts are (neutral, 0.0) without a call.
    ``read`` takes the reply text from what the model returns: ``replies.reply_text`` for JSON.
    """
    df = with_result_columns(df)
    remote = scale == "remote"
    parse, fallback = (parse_remote, "neutral") if remote else (parse_local, fv.UNKNOWN)
    no_result = F.struct(F.lit(fallback).alias("sentiment"), F.lit(0.0).alias("score"))
    blank = is_blank(text) if remote else F.lit(False)
    request = strip(text) if remote else F.coalesce(F.col(text), F.lit(""))

    answered = with_answers(
        df.where(is_pending() & ~blank).withColumn(REQUEST, request),
        source,
        {PARSED: parse(read("reply"))},
        row_key,
        path,
        parallel,
        waves,
        rows_per_salt,
    )
    results = F.coalesce(PARSED, no_result)
    asked = answered.withColumns({c: results.getField(c) for c in ("sentiment", "score")})
    rest = df.where(~(is_pending() & ~blank))
    if remote:
        filled = {c: F.when(is_pending(), no_result.getField(c)).otherwise(F.col(c)) for c in ("sentiment", "score")}
        rest = rest.withColumns(filled)
    return asked.select(*df.columns).unionByName(rest)


def translate_rows(
    df: DataFrame,
    text: str,
    target: str,
    source: Answers,
    row_key: str,
    form: str = "concurrent",
    path: str | None = None,
    parallel: int | None = None,
    waves: int = 1,
    rows_per_salt: int = ROWS_PER_SALT,
    read: Callable[[str], Column] = strip,
    broken: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Fills ``target``; adds ``failed``.  Rows that need no request are filled by their route.

    ``read`` takes the translation from what the model returns: ``replies.reply_text`` or, in the
    serial form, ``replies.first_choice_text`` for JSON.  ``broken`` says what is wrong with a reply,
    ``replies.broken_reply`` or ``replies.broken_choice``; such replies are failures too.
    """
    columns = [*dict.fromkeys([*df.columns, target])]
    rows = routed(df, text, target, form == "concurrent", ROUTE)
    none = F.lit(None).cast("struct<type string, message string>")
    wrong = none if broken is None else broken("reply")
    error_type = F.coalesce("error_type", wrong.getField("type"))
    failed = error_type.isNotNull()
    error_message = F.coalesce("error_message", wrong.getField("message"), F.lit(""))
    translation = F.when(failed, failed_marker(error_type, error_message, form)).otherwise(
        F.coalesce(read("reply"), F.lit(""))
    )
    sent = with_answers(
        rows.where(F.col(ROUTE) == SEND).withColumn(REQUEST, strip(text)).drop(target),
        source,
        {target: translation, "failed": failed},
        row_key,
        path,
        parallel,
        waves,
        rows_per_salt,
    )
    rest = rows.where(F.col(ROUTE) != SEND).withColumn("failed", F.lit(False))
    return sent.select(*columns, "failed").unionByName(rest.select(*columns, "failed"))


def recorded(replies: DataFrame, text: str, reply: str, order: str) -> DataFrame:
    """Answers from a table of recorded replies: the first reply of each text, by ``order``."""
    key = F.md5(F.coalesce(F.col(text), F.lit(""))).alias("request_key")
    first = F.min(F.struct(order, reply)).getField(reply).alias("reply")
    none = F.lit(None).cast("string")
    return (
        replies.groupBy(key)
        .agg(first)
        .select("request_key", "reply", none.alias("error_type"), none.alias("error_message"))
    )
