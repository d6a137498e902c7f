"""The given tables, and the posts and comments that Spark derives from them.

The given texts hold no Chinese, links, emoji or blank rows, so the queries read them through
``posts``: all the documents with their texts, some with such cases around them, and further rows that
are such cases.  ``comments`` are the turns of the conversations, in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.sources.tables import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that are added to the given ones: their texts are the special cases.
ADDED = "doc_id % 10 IN (3, 4, 5)"
ADDED_ID = 1_000_000_000_000
POST_ID = f"doc_id + {ADDED_ID} * added"

CONTENT = """CASE WHEN added = 1 THEN CASE doc_id % 10 WHEN 3 THEN NULL WHEN 4 THEN '　  '
      ELSE '今天的足球比赛非常精彩 goal 2024 😀' END
    ELSE CASE doc_id % 10
    WHEN 0 THEN concat(text, ' https://t.example/', CAST(doc_id AS STRING), ' @user', CAST(doc_id % 7 AS STRING))
    WHEN 1 THEN concat('　 ', text, ' 　')
    WHEN 2 THEN concat('#世界杯# 今天的比赛非常精彩 ', text)
    ELSE text END END"""

_DAY = "lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')"
POSTED_AT = f"""CASE WHEN doc_id % 11 = 0 THEN 'not a date'
    WHEN doc_id % 7 = 1 THEN concat('2024/1/', CAST(doc_id % 28 + 1 AS STRING), ' 9:05')
    WHEN doc_id % 7 = 2 THEN concat('2024-01-', {_DAY}, 'T12:00:30')
    WHEN doc_id % 7 = 3 THEN concat('2024-01-', {_DAY}, ' 12:00:30.250')
    WHEN doc_id % 7 = 4 THEN concat('2024-1-', CAST(doc_id % 28 + 1 AS STRING))
    ELSE concat('2024-01-', {_DAY}, ' 12:00:00') END"""

SENTIMENT = """CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
    WHEN quality = 0 THEN 'neutral' END"""

SCORE = "CASE WHEN label_id IS NOT NULL THEN CAST(doc_id % 100 AS DOUBLE) / 100 END"

REPLY = """CASE doc_id % 13
    WHEN 0 THEN concat('<think>a,', chr(10), 'b</think>positive,0.80')
    WHEN 1 THEN 'negative,0.15' WHEN 2 THEN ' Neutral , .50 ' WHEN 3 THEN 'positive,0.8'
    WHEN 4 THEN 'positive,0.875' WHEN 5 THEN 'negative,-0.37' WHEN 6 THEN 'positive,1.50'
    WHEN 7 THEN 'positive,nan' WHEN 8 THEN 'positive,0.5d' WHEN 9 THEN 'I think it is positive'
    WHEN 10 THEN NULL WHEN 11 THEN 'NEGATIVE，0.20'
    ELSE concat('答：neutral,0.', lpad(CAST(doc_id % 100 AS STRING), 2, '0')) END"""

COMMENT_ADDED = "(conv_id + turn) % 6 > 2"
COMMENT_ID = "(conv_id * 1000 + turn) * 2 + added"
COMMENT = """CASE WHEN added = 1 THEN CASE (conv_id + turn) % 6
      WHEN 3 THEN concat(' 今天的足球比赛非常精彩 ', CAST(conv_id % 5 AS STRING)) WHEN 4 THEN '　 ' ELSE NULL END
    WHEN (conv_id + turn) % 6 = 1 THEN concat('　', text, ' 　') ELSE text END"""

COLUMNS = ("post_id", "content", "lang", "source", "posted_at", "sentiment", "score", "reply")


def posts(spark: SparkSession, sf_dir: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Posts with the wanted columns; the labels are only joined when a column needs them."""
    docs = table(spark, sf_dir, "documents")
    if "content" in columns:
        docs = spread(docs)
    if {"sentiment", "score"} & set(columns):
        labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
        docs = docs.join(labels, docs.doc_id == labels.label_id, "left")
    return as_posts(docs, columns)


def as_posts(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    copies = F.when(F.expr(ADDED), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    docs = docs.withColumn("added", F.explode(copies))
    made = {
        "post_id": F.expr(POST_ID),
        "content": F.expr(CONTENT),
        "lang": F.col("lang"),
        "source": F.col("source"),
        "posted_at": F.expr(POSTED_AT),
        "sentiment": F.expr(SENTIMENT),
        "score": F.expr(SCORE),
        "reply": F.expr(REPLY),
    }
    return docs.select(*[made[c].alias(c) for c in columns])


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns: comment_id, comment, and a translation that some rows have already; special cases are added."""
    copies = F.when(F.expr(COMMENT_ADDED), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    turns = table(spark, sf_dir, "conversations").withColumn("added", F.explode(copies))
    return turns.select(
        F.expr(COMMENT_ID).alias("comment_id"),
        F.expr(COMMENT).alias("comment"),
        F.expr(
            """CASE conv_id % 4 WHEN 0 THEN '已有译文' WHEN 1 THEN '  ' WHEN 2 THEN NULL
            ELSE '' END"""
        ).alias("translation"),
    )
