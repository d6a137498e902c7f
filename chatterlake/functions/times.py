"""Text to timestamp and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterlake.functions.text import col

#: Day with or without zeros, then a time of minutes, seconds or fractions, and a zone; tried in order.
FORMATS = tuple(f"yyyy{s}M{s}d[{gap}H:m[:s[.SSSSSSSSS]][XXX]]" for s in "-/" for gap in (" ", "'T'"))


def parse_time(c: Column | str, formats: Sequence[str] = FORMATS) -> Column:
    """The first format that fits, null when none does."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in formats])


def day_of(c: Column | str, formats: Sequence[str] = FORMATS) -> Column:
    return F.to_date(parse_time(c, formats))
