"""Segmentation with a user dictionary: longest match first, two-character tokens for the rest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions.tokens import RUNS, is_cjk, segment, two_char_tokens
from chatterlake.operators import trie
from chatterlake.operators.lookup import lookup

TRIE_CHARS = 32_000_000  # sent to each worker as at most 9 bytes each


def _usable(dictionary: DataFrame) -> DataFrame:
    """Only words of Chinese characters can match inside a Chinese run."""
    return dictionary.select("word").where(F.col("word").rlike(f"^[{fv.CJK}]+$")).distinct()


def with_tokens(
    df: DataFrame,
    text: str,
    dictionary: DataFrame,
    method: str = "set",
) -> DataFrame:
    """Adds ``tokens``; all methods give the same ones.  The caller names how the dictionary travels.

    "set": as a trie of arrays in each Python worker, for dictionaries of up to ``TRIE_CHARS``
    characters, larger ones are joined; "pattern": as one regular expression inside the JVM, for a few
    words; "join": dealt out, for dictionaries of any size.
    """
    usable = _usable(dictionary)
    if method == "join" or (method == "set" and _characters(usable) > TRIE_CHARS):
        return _by_join(df, text, usable)
    words = usable.toArrow()["word"].combine_chunks()
    if not len(words):
        return df.withColumn("tokens", segment(text))
    return {"pattern": _by_pattern, "set": _by_trie}[method](df, text, words)


def _characters(words: DataFrame) -> int:
    return words.agg(F.sum(F.length("word"))).first()[0] or 0


def _by_pattern(df: DataFrame, text: str, words: pa.Array) -> DataFrame:
    """Alternatives are tried in order, so the longest word of a position must come first."""
    listed = "|".join(sorted(words.to_pylist(), key=lambda w: (-len(w), w)))

    def cut(run: Column) -> Column:
        # matches are set apart by marks, which a run of letters cannot contain
        parts = F.regexp_extract_all(
            F.regexp_replace(run, f"({listed})", "<$1>"), F.lit(f"<[{fv.CJK}]+>|[{fv.CJK}]+"), F.lit(0)
        )
        unmarked = lambda p: F.array(F.substr(p, F.lit(2), F.length(p) - 2))
        return F.flatten(
            F.transform(
                parts, lambda p: F.when(p.startswith("<"), unmarked(p)).otherwise(two_char_tokens(p))
            )
        )

    runs = F.regexp_extract_all(text, F.lit(RUNS), F.lit(1))
    tokens = F.flatten(
        F.transform(runs, lambda r: F.when(is_cjk(r), cut(r)).otherwise(F.array(r)))
    )
    return df.withColumn(
        "tokens", F.when(F.col(text).rlike(f"[{fv.CJK}]"), tokens).otherwise(runs)
    )


def _by_trie(df: DataFrame, text: str, words: pa.Array) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(trie.Trie.of(words))

    @F.arrow_udf("array<string>")
    def cut(runs: pa.Array) -> pa.Array:
        return trie.cut_lists(runs, ord("一"), shared.value)

    return df.withColumn("tokens", cut(F.regexp_extract_all(text, F.lit(RUNS), F.lit(1))))


def _by_join(df: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """Every place and length a word could have is looked up; then the matches are walked in order.

    Each distinct text is cut once, under its own hash.  No group is larger than one run of one text.
    """
    key, named = "__text_key", F.md5(F.col(text)).alias("__text_key")
    longest = dictionary.agg(F.max(F.length("word"))).first()[0] or 0
    texts = df.select(named, text).where(F.col(text).isNotNull()).dropDuplicates([key])
    if not longest:
        return df.withColumn("tokens", segment(text))
    runs = texts.select(
        key, F.posexplode(F.regexp_extract_all(text, F.lit(RUNS), F.lit(1))).alias("run_no", "run")
    )
    chinese = runs.where(is_cjk(F.col("run")))
    places = chinese.select(key, "run_no", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    room = F.least(F.lit(longest), F.length("run") - F.col("at") + 1)
    sized = places.select(key, "run_no", "at", "run", F.explode(F.sequence(F.lit(1), room)).alias("size"))
    word = F.substr("run", F.col("at"), F.col("size")).alias("word")
    candidates = sized.select(key, "run_no", "at", "size", word)
    known = dictionary.withColumn("known", F.lit(True))
    matches = lookup(candidates, known, "word", [key, "run_no", "at"]).where("known")
    longest_here = matches.groupBy(key, "run_no", "at").agg(F.max("size").alias("size"))
    per_run = longest_here.groupBy(key, "run_no").agg(
        F.array_sort(F.collect_list(F.struct("at", "size"))).alias("found")
    )
    walk = F.aggregate(
        "found",
        F.expr("named_struct('free', 1, 'taken', cast(array() as array<struct<at:int,size:int>>))"),
        lambda state, m: F.when(
            m.at >= state.free,
            F.struct((m.at + m.size).alias("free"), F.array_append(state.taken, m).alias("taken")),
        ).otherwise(state),
        lambda state: state.taken,
    )

    def rest(start: Column, end: Column) -> Column:
        piece = F.substr(F.col("run"), start, end - start)
        return F.when(end > start, two_char_tokens(piece)).otherwise(F.array().cast("array<string>"))

    def cut(taken: Column) -> Column:
        def before(m: Column, i: Column) -> Column:
            last = F.get(taken, i - 1)
            start = F.coalesce(last.at + last.size, F.lit(1))
            return F.concat(rest(start, m.at), F.array(F.substr(F.col("run"), m.at, m.size)))

        last = F.get(taken, F.size(taken) - 1)
        return F.concat(
            F.flatten(F.transform(taken, before)), rest(last.at + last.size, F.length("run") + 1)
        )

    matched = per_run.withColumn("taken", walk)
    cut_runs = runs.join(matched, [key, "run_no"], "left").select(
        key,
        "run_no",
        F.when(F.col("taken").isNotNull(), cut(F.col("taken")))
        .when(is_cjk(F.col("run")), two_char_tokens(F.col("run")))
        .otherwise(F.array("run"))
        .alias("tokens"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("run_no", "tokens")))
    per_text = cut_runs.groupBy(key).agg(F.flatten(F.transform(ordered, lambda r: r.tokens)).alias("tokens"))
    none = F.when(F.col(text).isNotNull(), F.array().cast("array<string>"))
    joined = df.withColumn(key, F.md5(F.col(text))).join(per_text, key, "left").drop(key)
    return joined.withColumn("tokens", F.coalesce("tokens", none))
