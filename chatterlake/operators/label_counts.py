"""A sentiment model that is a table of counts: multinomial naive Bayes over the words of labelled rows.

For each word the model holds how often the rows of each label have it.  That is one aggregation over
all labelled rows, whatever their number: nothing is iterated, bounded or sampled.  A text's cost under a
label is the sum over its words of minus the log of ``(count + 1) / (words of the label + distinct words)``,
plus the same for the share of the label among the rows.  Costs are whole numbers of ``UNIT``, so
sums do not follow the order of rows, and the same tables always give the same labels and scores.

The words of pending rows meet the model in two ways that give the same numbers.  The most frequent
words, at most ``HOT_WORDS``, go to all tasks and add up inside the row's own task; only what is left is
joined by word, one row per row and word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions.text import clean_text
from chatterlake.functions.tokens import bag, segment
from chatterlake.operators.resuming import with_result_columns
from chatterlake.operators.splitting import is_pending, labelled, pending
from chatterlake.storage import Folder

UNIT = 1e-6
HOT_WORDS = 1 << 16
DIGITS = 6  # of the score
_STEPS = 16  # classes of frequencies between a number and its double
COSTS = [f"cost_{label}" for label in fv.LABELS]


def words_of(text: Column | str) -> Column:
    """The words that are counted; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return segment(clean_text(F.coalesce(text, F.lit(""))))


def cost_of(part: Column, whole: Column) -> Column:
    return -F.floor(F.log(part / whole) / UNIT)


@dataclass(frozen=True)
class LabelCounts:
    """``words``: word, n, and one cost per label; ``rows``: the costs of a row without words, in the order of labels."""

    words: Folder
    rows: tuple[int, ...] | None

    def drop(self) -> None:
        """Deletes the table, once nothing will read it any more."""
        self.words.drop()


def fit(rows: DataFrame, text: str, label: str = "sentiment", name: str = "label-counts") -> LabelCounts:
    """The model of all rows with one of the known labels and a text; each text is read once.

    Without such rows ``rows`` of the model is null, and it labels nothing.  The costs of words are written
    out once, so that the model is a table as any other and can be joined by many jobs.
    """
    known = labelled(rows, label).where(F.col(text).isNotNull())
    each = known.select(F.col(label).alias("label"), F.explode_outer(bag(words_of(text))).alias("at"))
    # a row without words still counts for its label; it comes as one with no word
    of_label = lambda value, c: F.sum(F.when(F.col("label") == value, c).otherwise(0))
    counted = each.groupBy(F.col("at.word").alias("word")).agg(*[of_label(v, F.col("at.n")).alias(v) for v in fv.LABELS])
    counted = Folder.write(counted.where("word IS NOT NULL"), f"{name}-counts")
    counts = counted.read()
    sums = counts.agg(F.count("*").alias("words"), *[F.sum(v).alias(v) for v in fv.LABELS]).first()
    n_rows = {r["label"]: r["count"] for r in known.groupBy(F.col(label).alias("label")).count().collect()}  # three rows at most

    total = sum(n_rows.values())
    costs = [cost_of(F.col(v) + 1, F.lit((sums[v] or 0) + sums["words"])).alias(c) for v, c in zip(fv.LABELS, COSTS)]
    all_counts = F.expr(" + ".join(f"`{v}`" for v in fv.LABELS))
    words = Folder.write(counts.select("word", all_counts.alias("n"), *costs), name)
    counted.drop()
    if not total:
        return LabelCounts(words, None)
    share = [cost_of(F.lit(n_rows.get(v, 0) + 1), F.lit(total + len(fv.LABELS))).alias(c) for v, c in zip(fv.LABELS, COSTS)]
    return LabelCounts(words, tuple(rows.sparkSession.range(1).select(*share).first()))


def hot_words(words: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The table in two: the most frequent words, at most ``most`` of them, by classes of frequency, and all others."""
    size = F.floor(F.log2(F.col("n").cast("double")) * _STEPS)
    sizes = words.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()  # some hundred rows
    held, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["size"]):
        held += row["words"]
        if held > most:
            break
        least = row["size"]
    is_hot = F.lit(False) if least is None else size >= least
    return words.where(is_hot), words.where(~is_hot)


def row_costs(df: DataFrame, model: LabelCounts, text: str, key: str) -> DataFrame:
    """key and the costs of its words, for each key whose rows have a word that the model knows."""
    hot, others = hot_words(model.words.read(), HOT_WORDS)
    each = df.select(F.col(key).alias("key"), F.inline(bag(words_of(text)))).withColumnRenamed("n", "times")
    met = each.join(F.broadcast(hot.drop("n")), "word", "left")
    # a row's hot words end as one row, its others as one each, before anything is moved
    other = F.when(F.col(COSTS[0]).isNull(), F.col("word")).alias("other")
    sums = [F.sum(F.col("times") * F.col(c)).alias(c) for c in COSTS]
    met = Folder.write(met.groupBy("key", other).agg(F.sum("times").alias("times"), *sums), "row-words").read()
    joined = met.where("other IS NOT NULL").drop(*COSTS).join(others.drop("n").withColumnRenamed("word", "other"), "other")
    whole = met.where("other IS NULL").select("key", *COSTS)
    rest = joined.select("key", *[(F.col("times") * F.col(c)).alias(c) for c in COSTS])
    return whole.union(rest).groupBy("key").agg(*[F.sum(c).alias(c) for c in COSTS])


def label_pending(df: DataFrame, model: LabelCounts, text: str, key: str) -> DataFrame:
    """Every row that lacks label or score gets the likeliest label and its probability; others stay.

    Words that the model does not know say nothing.  A row without known words gets the label most rows
    have; ties go to the first label in their fixed order.  Rows that share a key get one label, that of all
    their words together, and rows without a key that of a row without words.  A model of no rows changes nothing.
    """
    df = with_result_columns(df)
    if model.rows is None:
        return df
    found = row_costs(pending(df).where(F.col(key).isNotNull()), model, text, key).withColumnRenamed("key", "__key")
    names = [f"__{c}" for c in COSTS]
    found = found.select("__key", *[F.col(c).alias(n) for c, n in zip(COSTS, names)])
    both = df.join(found, is_pending() & (F.col(key) == F.col("__key")), "left")
    costs = [F.coalesce(n, F.lit(0).cast("long")) + F.lit(own) for n, own in zip(names, model.rows)]
    least = F.least(*costs)
    place = F.array_position(F.array(*costs), least).cast("int")
    label = F.get(F.array(*[F.lit(v) for v in fv.LABELS]), place - 1)
    others = sum((F.exp((least - c) * UNIT) for c in costs), F.lit(0.0))
    values = {"sentiment": label, "score": F.round(1 / others, DIGITS)}
    return both.withColumns({c: F.when(is_pending(), v).otherwise(F.col(c)) for c, v in values.items()}).select(df.columns)
