"""A sentiment model of our own: logistic regression on hashed words, fitted on the labelled rows."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions.text import clean_text
from chatterlake.functions.tokens import segment
from chatterlake.operators.resuming import with_result_columns
from chatterlake.operators.splitting import is_pending
from chatterlake.storage import stored

FEATURES = 1 << 14
PIECES = 16  # of the rows that are fitted on, at least
ROWS_PER_PIECE = 12_500
COPIES = 1_000  # equal rows that stay together
PREFIX = 4  # hexadecimal digits of a hash by which rows are counted
HASH, ROWS = "__hash", "__rows"
TOKENS, COUNTS, TARGET, GUESS, CHANCE = "__tokens", "__counts", "__target", "__guess", "__chance"


def _with_tokens(df: DataFrame, text: str) -> DataFrame:
    """A null text has no words."""
    return df.withColumn(TOKENS, segment(clean_text(F.coalesce(F.col(text), F.lit("")))))


def _last(counted: DataFrame, most_rows: int) -> tuple[str, float, int] | None:
    """Hash and target of the last of the first ``most_rows`` rows, and how many rows like it belong to them.

    ``counted``: hash, target, rows.  The driver reads a sum for each prefix of the hashes, then the keys of one prefix.
    """
    prefix = F.substr(HASH, F.lit(1), F.lit(PREFIX))
    left = most_rows
    for part in sorted(counted.groupBy(prefix.alias("prefix")).agg(F.sum(ROWS).alias("n")).collect(), key=lambda r: r.prefix):
        if part.n < left:
            left -= part.n
            continue
        keys = counted.where(prefix == part.prefix).select(HASH, TARGET, ROWS).collect()
        for row in sorted(keys):
            if row[2] >= left:
                return row[0], row[1], left
            left -= row[2]
    return None


def smallest(known: DataFrame, text: str, most_rows: int) -> DataFrame:
    """The ``most_rows`` rows (text, target) with the smallest hashes of their texts, dealt to ``PIECES`` parts in one order.

    Only hashes are counted to find where these rows end.  Equal rows travel as one, so no task reads more than its part.
    """
    hashed = known.withColumn(HASH, F.md5(text))
    last = _last(stored(hashed.groupBy(HASH, TARGET).agg(F.count("*").alias(ROWS)), "label-hashes"), most_rows)
    n = F.col(ROWS)
    if last:
        at, target, left = last
        is_last = (F.col(HASH) == at) & (F.col(TARGET) == target)
        hashed = hashed.where((F.col(HASH) < at) | (F.col(HASH) == at) & (F.col(TARGET) <= target))
        n = F.when(is_last, F.lit(left).cast("long")).otherwise(n)
    once = hashed.groupBy(HASH, text, TARGET).agg(F.count("*").alias(ROWS)).withColumn(ROWS, n).where(F.col(ROWS) > 0)
    dealt = once.repartition(PIECES, HASH).sortWithinPartitions(HASH, TARGET)
    return dealt.withColumn(ROWS, F.explode(F.sequence(F.lit(1).cast("long"), ROWS))).select(text, TARGET)


def dealt(known: DataFrame, text: str, counter: HashingTF) -> DataFrame:
    """target and word counts of every row (text, target), in one order over parts that grow in number with the rows.

    A text's words are counted and moved once for all its copies, which come apart again by ``COPIES``, so no part has all of a frequent text.
    """
    counted = counter.transform(_with_tokens(known.withColumn(HASH, F.md5(text)), text))
    counted = counted.groupBy(HASH, TARGET).agg(F.first(COUNTS).alias(COUNTS), F.count("*").alias(ROWS))
    counted = stored(counted, "label-words")
    one = F.lit(1).cast("long")
    groups = F.ceil(F.col(ROWS) / F.lit(COPIES))
    n = counted.agg(F.sum(F.least(F.col(ROWS), F.lit(COPIES)) * groups)).first()[0] or 0
    cut = counted.withColumn("__group", F.explode(F.sequence(one, groups)))
    cut = cut.withColumn(ROWS, F.least(F.col(ROWS) - (F.col("__group") - 1) * COPIES, F.lit(COPIES).cast("long")))
    placed = cut.repartition(max(PIECES, math.ceil(n / ROWS_PER_PIECE)), HASH, "__group").sortWithinPartitions(HASH, TARGET, "__group")
    return placed.withColumn(ROWS, F.explode(F.sequence(one, ROWS))).select(TARGET, COUNTS)


def fit_labels(
    rows: DataFrame, text: str, label: str = "sentiment", features: int = FEATURES, most_rows: int | None = None
) -> PipelineModel:
    """The model of all rows with one of the known labels and a text.

    Only a caller who names ``most_rows`` has it fitted on that many, those with the smallest hashes of their
    texts.  Equal rows in any order give the same model.
    """
    target = F.array_position(F.array(*[F.lit(v) for v in fv.LABELS]), F.col(label)) - 1
    known = rows.where(F.col(label).isin(*fv.LABELS) & F.col(text).isNotNull()).select(text, target.cast("double").alias(TARGET))
    if most_rows is not None:
        known = smallest(known, text, most_rows)
    counter = HashingTF(inputCol=TOKENS, outputCol=COUNTS, numFeatures=features)
    counts = dealt(known, text, counter)
    weigher = IDF(inputCol=COUNTS, outputCol="__weights").fit(counts)
    judge = LogisticRegression(
        featuresCol="__weights", labelCol=TARGET, predictionCol=GUESS, probabilityCol=CHANCE, rawPredictionCol="__raw",
        family="multinomial", regParam=0.05, maxIter=20,
    )
    return PipelineModel(stages=[counter, weigher, judge.fit(weigher.transform(counts))])


def label_pending(df: DataFrame, model: PipelineModel, text: str) -> DataFrame:
    """Every row that lacks label or score gets the likeliest label and its probability; others stay."""
    df = with_result_columns(df)
    guessed = model.transform(_with_tokens(df, text))
    label = F.get(F.array(*[F.lit(v) for v in fv.LABELS]), F.col(GUESS).cast("int"))
    chance = F.array_max(vector_to_array(CHANCE))
    found = {"sentiment": label, "score": chance}
    return guessed.withColumns({c: F.when(is_pending(), v).otherwise(F.col(c)) for c, v in found.items()}).select(df.columns)
