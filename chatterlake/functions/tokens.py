"""Word segmentation and token rules.

Latin letters and digits form words as they stand.  Chinese runs have no spaces: without a
dictionary they are cut into overlapping two-character tokens, with one they are cut by longest
match first (see ``operators.segmentation``).  The cuts are deterministic, so equal texts always
give equal tokens, but they are not those of a statistical segmenter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions.text import col, remove_urls, strip

RUNS = f"([0-9A-Za-z]+|[{fv.CJK}]+)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Inside a lambda a plain expression is evaluated again for each array element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def two_char_tokens(run: Column) -> Column:
    """Overlapping two-character tokens of a run; a one-character run stays as it is."""
    return F.when(F.length(run) == 1, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
    )


def is_cjk(run: Column) -> Column:
    return run >= F.lit("一")


def segment(c: Column | str) -> Column:
    """array<string> of tokens in text order, without a dictionary."""
    c = col(c)
    runs = F.regexp_extract_all(c, F.lit(RUNS), F.lit(1))
    cut = F.flatten(
        F.transform(runs, lambda r: F.when(is_cjk(r), two_char_tokens(r)).otherwise(F.array(r)))
    )
    # a text without Chinese characters needs no second level of arrays
    return F.when(c.rlike(f"[{fv.CJK}]"), cut).otherwise(runs)


def cloud_word(token: Column | str) -> Column:
    """Word-count rule for one token: the word to count, or null when it is not counted.

    Digits only and single characters are not counted; all-Latin words are lower-cased and need
    three letters; mixed tokens keep their case.
    """
    t = col(token)
    # anchored patterns stop at the first character that does not fit
    return (
        F.when((F.length(t) < 2) | t.rlike("^[0-9]+$"), None)
        .when(~t.rlike("^[A-Za-z]+$"), t)
        .when(F.length(t) > 2, F.lower(t))
    )


def cloud_tokens(tokens: Column) -> Column:
    """The word-count rules over a whole token array."""
    return F.filter(F.transform(tokens, cloud_word), lambda w: w.isNotNull())


def topic_text(c: Column | str) -> Column:
    """Text as the topic model sees it: stripped, lower case, without links."""
    return remove_urls(F.lower(strip(c)))


def topic_tokens(tokens: Column, stop_words: Iterable[str] = ()) -> Column:
    """Topic-model rules: no one-character tokens, no stop words; repeats and order are kept."""
    stop = list(stop_words)

    def keep(t: Column) -> Column:
        long_enough = F.length(t) > 1
        return long_enough & ~t.isin(stop) if stop else long_enough

    return F.filter(tokens, keep)


def bag(tokens: Column) -> Column:
    """array<struct<word, n>> of one text, in word order, counted inside the row.

    All tokens of a text are already in one row, so sorting them there and measuring the runs of
    equal words needs no shuffle; grouping exploded tokens by (document, word) would move every
    token of the corpus.
    """
    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda i, j: F.struct(
                    F.get(s, i).alias("word"),
                    (F.coalesce(F.get(b, j + 1), F.size(s)) - i).cast("long").alias("n"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)
