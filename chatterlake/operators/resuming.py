"""Taking earlier results over into a new run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.operators.lookup import ROWS_PER_SALT, lookup

RESULTS = {"sentiment": "string", "score": "double"}


def with_result_columns(df: DataFrame, results: dict[str, str] = RESULTS) -> DataFrame:
    """Adds the result columns, as null, where they are missing."""
    missing = {c: F.lit(None).cast(t) for c, t in results.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def text_key(keys: Sequence[str]):
    """One short join key for the key columns; null if one of them is null, so it never matches.

    Each part is hashed on its own before they are joined, so the borders between parts cannot shift.
    """
    parts = [F.md5(F.col(k).cast("string")) for k in keys]
    return parts[0] if len(parts) == 1 else F.md5(F.concat(*parts))


def merge_results(
    df: DataFrame,
    done: DataFrame,
    keys: Sequence[str],
    row_key: str,
    results: dict[str, str] = RESULTS,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Each row keeps its own result, else takes the earlier one of the same key columns.

    ``done`` gives at most one row per key, so what is taken over was said together: the first by
    ``row_key`` of those with all results, else of those with any; without such a column the smallest
    results.  No row is added.  Without the key columns in ``done`` nothing can be taken over.
    """
    df = with_result_columns(df, results)
    offered = [c for c in results if c in done.columns]
    if not set(keys) <= set(done.columns) or not offered:
        return df
    names = {c: f"__{c}_done" for c in offered}

    any_missing = F.greatest(*[F.col(c).isNull() for c in offered], F.lit(False))
    order = [F.col(row_key)] if row_key in done.columns else []
    candidate = F.struct(any_missing.alias("__missing"), *order, *[F.col(c).alias(names[c]) for c in offered])
    earlier = (
        done.withColumn("__text_key", text_key(keys))
        .where(F.col("__text_key").isNotNull() & F.coalesce(*[F.col(c).cast("string") for c in offered]).isNotNull())
        .groupBy("__text_key")
        .agg(F.min(candidate).alias("__first"))
        .select("__text_key", *[F.col("__first").getField(n).alias(n) for n in names.values()])
    )
    keyed = df.withColumn("__text_key", text_key(keys))
    merged = lookup(keyed, earlier, "__text_key", [row_key], rows_per_salt)
    taken = {c: F.coalesce(F.col(c), F.col(names[c])) for c in offered}
    return merged.withColumns(taken).drop("__text_key", *names.values())
