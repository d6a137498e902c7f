"""CSV with quoted line breaks, where one large file is read by many tasks.

Whether a line break ends a row depends on all quotes before it in the file.  A first scan counts, for
each split of a file, its quotes and whether its lines are valid UTF-8.  Sums over a file's splits then
say, for each split, whether it begins within quotes, the file's encoding, and which split holds the
beginning of the row that is open there.  A second scan cuts each split into rows by that.  A row over
several splits is put together from its pieces, which are all that is shuffled.

Line breaks, quotes and commas are never part of a longer character in UTF-8 or GB18030, so all this
is done on bytes and only whole pieces are decoded.

Every row has a place, (file, split, number within it), which is the same in each run with the same split
size.  It serves as identity and order of a table without a key column.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from chatterlake.sources.csv_files import LEGACY, typed
from chatterlake.sources.tables import require_columns
from chatterlake.storage import stored

SPLIT_BYTES = 64 << 20
BROADCAST_SPLITS = 500_000  # of about 200 bytes; beyond it the splits are joined by a shuffle
MARK = b"\xef\xbb\xbf"
PLACE = "struct<file: string, split: bigint, row: bigint>"
_KEYS = ["file", "start"]
_STATS = "file string, start long, quotes long, lines long, begins_if_open boolean, utf8 boolean, header binary"
_PIECES = "file string, start long, owner long, row long, whole boolean, text string"


def lines_of(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """(file, start, line, utf8): all lines as bytes, by the split in which they begin.

    The scan belongs to a session whose split size does not follow the number of cores, so that two
    scans of the same files are split alike.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(min(split_bytes, 4 << 20)))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    text = own.read.option("lineSep", "\n").text(path)
    text = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
        F.is_valid_utf8("value").alias("utf8"),
    )
    return spark.createDataFrame([], text.schema).union(text)  # all else belongs to the caller's session


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The pieces of a batch that belong to one split, in order."""
    start = batch.column("start").to_numpy()
    file = batch.column("file").dictionary_encode()
    number = file.indices.to_numpy()
    new = np.flatnonzero((start[1:] != start[:-1]) | (number[1:] != number[:-1])) + 1
    bounds = [0, *new.tolist(), len(start)] if len(start) else [0]
    for a, b in zip(bounds, bounds[1:]):
        yield (file.dictionary[int(number[a])].as_py(), int(start[a])), batch.slice(a, b - a)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False).astype(np.int64)


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split; the header is the first row of a file, as far as the split holds it."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("lines", pa.int64()),
                        ("begins_if_open", pa.bool_()), ("utf8", pa.bool_()), ("header", pa.binary())])
    here = None
    for batch in batches:
        for key, part in _runs(batch):
            if here is None or (here["file"], here["start"]) != key:
                if here:
                    yield pa.RecordBatch.from_pylist([_with_header(here)], schema)
                here = dict(file=key[0], start=key[1], quotes=0, lines=0, begins_if_open=False, utf8=True, head=[], ended=key[1] > 0)
            before = here["quotes"] + np.concatenate([[0], np.cumsum(_quotes(part.column("line")))])
            here["begins_if_open"] |= bool((before[:-1] % 2 == 1).any())
            if not here["ended"]:
                shut = np.flatnonzero(before[1:] % 2 == 0)
                end = int(shut[0]) + 1 if len(shut) else len(part)
                here["head"] += part.column("line").slice(0, end).to_pylist()
                here["ended"] = len(shut) > 0
            here["quotes"] = int(before[-1])
            here["lines"] += len(part)
            here["utf8"] &= bool(pc.all(part.column("utf8")).as_py())
    if here:
        yield pa.RecordBatch.from_pylist([_with_header(here)], schema)


def _with_header(split: dict) -> dict:
    header = b"\n".join(split["head"]) if split["start"] == 0 and split["ended"] else None
    return {k: v for k, v in split.items() if k not in ("head", "ended")} | {"header": header}


def splits_of(lines: DataFrame) -> DataFrame:
    """(file, start, open, owner, shut, legacy, header) of each split that has lines.

    ``open``: it begins within quotes, in a row that began in the split ``owner``; ``shut``: all its own
    rows end in it.  A file whose quotes do not pair up stops the reader.
    """
    found = lines.mapInArrow(_stats_batches, _STATS)
    whole = Window.partitionBy("file")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    begins = F.when(~F.col("open") | F.col("begins_if_open"), F.col("start"))
    unpaired = F.raise_error(F.concat(F.lit("quotes do not pair up in "), F.col("file")))
    found = found.withColumn("open", odd)
    return found.select(
        "file", "start", "open",
        F.when(F.col("open"), F.last(begins, ignorenulls=True).over(before)).alias("owner"),
        ((F.col("quotes") + F.col("open").cast("int")) % 2 == 0).alias("shut"),
        F.when(F.sum("quotes").over(whole) % 2 == 0, ~F.bool_and("utf8").over(whole)).otherwise(unpaired).alias("legacy"),
        "header",
    )


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of splits, whole or in pieces; a row number within its split, for pieces the last one."""
    names = ["file", "start", "owner", "row", "whole", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    here, held, count, foreign, charset = None, [], 0, False, "utf-8"

    def decoded(lines: list[bytes]) -> str:
        return b"\n".join(lines).decode(charset, errors="replace")

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows: list[tuple] = []
    for batch in batches:
        for key, part in _runs(batch):
            first = lambda name: part.column(name)[0].as_py()
            if key != here:
                if held:  # what the split before leaves open
                    rows.append((*here, owner if foreign else here[1], count, False, decoded(held)))
                here, held, count, foreign = key, [], 0, first("open")
                owner, charset = first("owner"), LEGACY if first("legacy") else "utf-8"
                odd = int(foreign)
            lines = part.column("line").to_pylist()
            shut = (odd + np.cumsum(_quotes(part.column("line")))) % 2 == 0
            for line, ends in zip(lines, shut.tolist()):
                held.append(line)
                if ends:
                    if foreign:
                        rows.append((*key, owner, -1, False, decoded(held)))
                    else:
                        rows.append((*key, key[1], count, True, decoded(held)))
                        count += 1
                    held, foreign = [], False
            odd = int(not shut[-1])
        if rows:
            yield out(rows)
            rows = []
    if held:
        rows.append((*here, owner if foreign else here[1], count, False, decoded(held)))
    if rows:
        yield out(rows)


def _pieces(lines: DataFrame, splits: DataFrame, n_splits: int) -> DataFrame:
    wanted = splits.select(*_KEYS, "open", "owner", "legacy")
    if n_splits <= BROADCAST_SPLITS:  # lines stay where they are, in their order
        known = lines.join(F.broadcast(wanted), _KEYS)
    else:
        known = lines.withColumn("nth", F.monotonically_increasing_id()).join(wanted.hint("shuffle_hash"), _KEYS)
        known = known.sortWithinPartitions(*_KEYS, "nth")
    return known.select("file", "start", "line", "open", "owner", "legacy").mapInArrow(_piece_batches, _PIECES)


def rows_of(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(place, text): each row of the files, headers and empty ones too, with its line breaks.

    Only splits with an open end are read again for pieces of rows.
    """
    n_splits = splits.count()
    whole = _pieces(lines, splits, n_splits).where("whole").select("file", "start", "row", "text")
    cut = splits.where("open OR NOT shut")
    pieces = _pieces(lines, cut, n_splits).where("NOT whole")
    piece = F.struct("start", "row", "text")
    joined = pieces.groupBy("file", "owner").agg(F.sort_array(F.collect_list(piece)).alias("found"))
    joined = joined.select(
        "file", F.col("owner").alias("start"), F.get("found", 0)["row"].alias("row"),
        F.array_join(F.transform("found", lambda x: x["text"]), "\n").alias("text"),
    )
    place = F.struct("file", F.col("start").alias("split"), "row").cast(PLACE)
    return whole.union(joined).select(place.alias("place"), "text")


def _header(splits: DataFrame) -> list[str]:
    first = splits.where("start = 0").orderBy("file").select("file", "header", "legacy").first()
    if first is None:
        return []
    if first.header is None:
        raise ValueError(f"the header of {first.file} is longer than a split")
    text = bytes(first.header).removeprefix(MARK).decode(LEGACY if first.legacy else "utf-8").rstrip("\r")
    names = next(csv.reader([text], strict=True), [])
    return [name or f"_c{i}" for i, name in enumerate(names)]


def read_large_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    columns: Iterable[str] | None = None,
    place: str | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """CSV rows as ``read_csv`` gives them, with every file split; ``place`` names a column for the rows' places.

    Quotes stand around cells only, and are doubled within them; line breaks within quotes stay as they are.  A file is UTF-8 if all its lines are, else
    GB18030.  Each file has a header row; its first row is left out, and the names are those of the first file.
    Empty lines are no rows.  Cells that are lacking at a row's end are null.  Files without any row give no
    rows and, without a schema, no columns.
    """
    lines = lines_of(spark, path, split_bytes)
    splits = stored(splits_of(lines), "csv-splits")
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in kinds] if kinds else _header(splits)
    if place in names:
        raise ValueError(f"the files have a column {place} of their own")
    if not names:
        return spark.createDataFrame([], StructType([]))
    own = [f"c{i}" for i in range(len(names))]
    text = F.rtrim("text", F.lit("\r"))
    rows = rows_of(lines, splits).where((text != "") & ~_is_header(F.col("place")))
    cells = F.from_csv(text, ", ".join(f"{c} string" for c in own), {"escape": '"', "multiLine": "true"})
    df = rows.select("place", cells.alias("cells")).select("place", *[F.col(f"cells.{c}").alias(c) for c in own])
    if kinds:
        kinds = StructType([StructField(c, f.dataType) for c, f in zip(own, kinds)])
    df = typed(df, kinds, beside=("place",)) if place else typed(df.drop("place"), kinds)
    df = df.toDF(*([place] if place else []), *names)
    return require_columns(df, columns) if columns else df


def _is_header(place: Column) -> Column:
    return (place["split"] == 0) & (place["row"] == 0)
