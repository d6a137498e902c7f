"""Scoring of posts as they arrive: the resumable run as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chatterlake.operators.enrichment import Call, ask, score_rows


def new_files(
    spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000
) -> DataFrame:
    """Rows of the Parquet files that come into a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], progress: str) -> StreamingQuery:
    """Everything that is new since the last run, in batches, then stop.

    ``progress`` is the checkpoint folder: it remembers which files are done.
    """
    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    rows: DataFrame,
    text: str,
    call: Call,
    row_key: str,
    answers: str,
    out: str,
    progress: str,
    scale: str = "local",
    parallel: int | None = None,
) -> StreamingQuery:
    """Scores new rows into ``out``; ``answers`` keeps every reply, so no text is asked for twice.

    A batch that is run again after a failure replaces its own part of ``out`` and finds its
    replies stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scored = score_rows(kept, text, call, row_key, scale, answers, parallel)
            (
                scored.withColumn("batch", F.lit(number))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch")
                .parquet(out)
            )
        finally:
            kept.unpersist()

    return each_batch(rows, write, progress)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal requests within a batch of rows the first, so that a frequent text is not sent row by row."""
    for batch in batches:
        keys = batch.column("request_key").to_numpy(zero_copy_only=False)
        yield batch.take(pa.array(np.unique(keys, return_index=True)[1]))


def answer_stream(
    rows: DataFrame, text: str, call: Call, answers: str, progress: str, parallel: int | None = None
) -> StreamingQuery:
    """Asks once for each distinct text that arrives and keeps the answers in the folder ``answers``.

    The keys of all requests so far are the stream's state, so a batch meets only the state of its own keys
    and never reads the answers of earlier ones; null counts as ''.  State is 32 bytes a text: let
    ``spark.sql.streaming.stateStore.providerClass`` name the RocksDB store where that is more than the executors'
    memory.  A batch that is run again after a failure asks again and replaces its own answers.  ``answers`` is
    for this stream alone; ``enrichment.stored_answers`` reads it.
    """
    request = F.coalesce(F.col(text), F.lit(""))
    requests = rows.select(F.md5(request).alias("request_key"), request.alias("request"))
    requests = requests.mapInArrow(_once, requests.schema).dropDuplicates(["request_key"])

    def write(batch: DataFrame, number: int) -> None:
        (
            ask(batch, call, parallel)
            .withColumns({"answered_at": F.current_timestamp(), "batch": F.lit(number)})
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(answers)
        )

    return each_batch(requests, write, progress)
