"""Writers."""

from __future__ import annotations

import itertools
import posixpath
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.clustering import LDAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.operators.splitting import labelled
from chatterlake.operators.topics import topic_lines
from chatterlake.sources.tables import create_file, names_in, path_exists, remove

BOM = "\ufeff"


def write_csv(
    df: DataFrame, path: str, bom: bool = True, mode: str = "errorifexists", order: str | None = None
) -> None:
    """CSV with a header row; with ``bom`` each part starts with the UTF-8 byte order mark.

    The mark is the first character of the first column's name, so spreadsheets see it in front of
    the header and Spark drops it again on reading.  With ``order`` the parts follow each other in
    the order of that column; the sort is made here only, not by the steps before.
    """
    df = df.orderBy(order) if order else df
    first, *rest = df.columns
    out = df.withColumnRenamed(first, BOM + first) if bom else df
    out.write.mode(mode).options(header=True, escape='"', encoding="UTF-8").csv(path)


def free_path(spark, base: str, suffix: str = fv.TRANSLATED_SUFFIX) -> str:
    """``base`` + suffix, or with the least of (1), (2), ... whose name its folder does not hold yet."""
    folder = posixpath.dirname(base) or "."
    taken = names_in(spark, folder)
    return next(p for p in _candidates(base, suffix) if not {posixpath.basename(p), posixpath.basename(_claim_of(p))} & taken)


def _candidates(base: str, suffix: str) -> Iterator[str]:
    folder, name = posixpath.split(base)
    stem, extension = posixpath.splitext(name)
    for n in itertools.chain([""], (f"({n})" for n in itertools.count(1))):
        yield posixpath.join(folder, f"{stem}{suffix}{n}{extension}")


def _claim_of(path: str) -> str:
    """The file that a writer holds while it writes; readers pass over names that begin with a dot."""
    folder, name = posixpath.split(path)
    return posixpath.join(folder, f".{name}.claim")


@contextmanager
def claimed_path(spark, base: str, suffix: str = fv.TRANSLATED_SUFFIX) -> Iterator[str]:
    """A free path that no other writer gets while this one writes.

    A name is claimed by making a file that must not exist yet, which a file system grants to one writer
    only; whoever loses goes on to the next number.  The claim goes when the block ends.  A name that another
    writer finished after the folder was listed is seen after claiming it, and given back.  A writer that dies
    leaves its claim, so its number is passed over.
    """
    taken = names_in(spark, posixpath.dirname(base) or ".")
    for path in _candidates(base, suffix):
        claim = _claim_of(path)
        if {posixpath.basename(path), posixpath.basename(claim)} & taken or not create_file(spark, claim):
            continue
        try:
            if not path_exists(spark, path):
                yield path
                return
        finally:
            remove(spark, claim)


def write_new(df: DataFrame, base: str, suffix: str = fv.TRANSLATED_SUFFIX) -> str:
    """Parquet at a path that nothing is overwritten at, also by two writers at once; returns the path."""
    with claimed_path(df.sparkSession, base, suffix) as path:
        df.write.mode("errorifexists").parquet(path)
    return path


def write_split(df: DataFrame, path: str, label: str = "sentiment", form: str = "parquet", **options) -> None:
    """One folder per label; rows with an unknown or no label go nowhere.

    The rebalance hint lets Spark join small pieces and split a label that holds most rows, so the
    folders get files of even size instead of one file per task and label.
    """
    split = labelled(df, label).hint("rebalance", F.col(label))
    split.write.options(**options).partitionBy(label).format(form).save(path)


def save_model(model: LDAModel, base: str, k: int) -> str:
    path = f"{base}/k={k}"
    model.write().overwrite().save(path)
    return path


def write_topic_lines(top: DataFrame, path: str) -> None:
    """One line per topic, in topic order; k lines in all, so one file."""
    topic_lines(top).orderBy("topic").select("line").coalesce(1).write.text(path)


def append_metrics(metrics: DataFrame, path: str, run_id: str, dataset: str) -> None:
    """Adds a run to the metric table; earlier runs stay."""
    stamped = metrics.withColumns(
        {"run_id": F.lit(run_id), "dataset": F.lit(dataset), "written_at": F.current_timestamp()}
    )
    stamped.write.mode("append").parquet(path)


def append_metric_lines(metrics: DataFrame, path: str) -> None:
    """The text form of the metric log, one line per topic count."""
    line = F.format_string(
        fv.METRIC_LINE, F.col("k"), F.col("bound").cast("string"), F.col("coherence").cast("string")
    )
    metrics.orderBy("k").select(line.alias("line")).coalesce(1).write.mode("append").text(path)
