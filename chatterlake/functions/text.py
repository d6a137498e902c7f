"""Text normalisation as column expressions (JVM side, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Strip every Unicode white-space character from both ends.

    ``trim`` with a character set only looks at the ends of the string, so it costs nothing on
    long texts; a regex would scan all of it.
    """
    return F.trim(col(c), F.lit(fv.WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def remove_urls(c: Column | str) -> Column:
    """Topic-model variant: anything from ``http`` or ``www`` to the next white space, removed."""
    return F.regexp_replace(col(c), fv.URL_ANYWHERE, "")


def urls_to_space(c: Column | str) -> Column:
    """Word-count variant: only links with a scheme, replaced by one space."""
    return F.regexp_replace(col(c), fv.URL_WITH_SCHEME, " ")


def mentions_to_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), fv.MENTION, " ")


def unwrap_hash_topics(c: Column | str) -> Column:
    """``#topic#`` becomes the topic padded by spaces."""
    return F.regexp_replace(col(c), fv.HASH_TOPIC, " $1 ")


def keycaps_to_space(c: Column | str) -> Column:
    """Keycap emoji are the only emoji that contain a character the word filter would keep."""
    return F.regexp_replace(col(c), fv.KEYCAP_EMOJI, " ")


_NOISE = f"{fv.URL_WITH_SCHEME}|{fv.MENTION}|{fv.KEYCAP_EMOJI}"


def drop_noise(c: Column | str) -> Column:
    """Links, mentions and keycap emoji to spaces, in one scan and only where one can occur.

    A link or a mention runs to the next white space, so cutting at the leftmost of them gives the
    same words as cutting links first and mentions second.
    """
    c = col(c)
    may_match = c.contains("://") | c.contains("@") | c.contains("\u20e3")
    return F.when(may_match, F.regexp_replace(c, _NOISE, " ")).otherwise(c)


def clean_text(c: Column | str) -> Column:
    """Words of Latin letters, digits and Chinese characters, joined by single spaces.

    Hash signs and all other emoji are outside the kept characters, so they separate words without
    a step of their own; null gives the empty string.
    """
    words = F.regexp_extract_all(drop_noise(c), F.lit(f"[{fv.KEPT_CHARS}]+"), F.lit(0))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def chinese_share(c: Column | str) -> Column:
    """Chinese characters / all characters; null for null or empty text."""
    c = col(c)
    total = F.length(c)
    other = F.length(F.regexp_replace(c, f"[{fv.CJK}]+", ""))
    return F.when(total > 0, (total - other).cast("double") / total.cast("double"))


def is_chinese(c: Column | str) -> Column:
    return F.coalesce(chinese_share(c) > fv.CHINESE_SHARE, F.lit(False))
