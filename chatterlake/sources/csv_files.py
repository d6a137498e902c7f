"""CSV with a header row, quoted line breaks, and UTF-8 or a Chinese legacy encoding."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chatterlake.sources.tables import null_literals, require_columns

LEGACY = "GB18030"  # contains GBK and GB2312
CHARSETS = "spark.sql.legacy.javaCharsets"
INFERRED = ("bigint", "double", "boolean")  # the first that fits all cells of a column


def files_by_encoding(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The files under ``path``, by whether all their lines are valid UTF-8.

    The text reader hands over raw bytes and a line break is never part of a longer character in
    these encodings, so files of any size are checked in parallel, line by line.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    checked = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    files: dict[bool, list[str]] = {True: [], False: []}
    for row in checked.collect():
        files[row.utf8].append(unquote(row.file))
    return files


def typed(df: DataFrame, schema: StructType | str | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """Text columns with null literals as null, cast to ``schema``, or to the narrowest type that fits all.

    Nulls are found before types, so ``NaN`` in a number column is null.  A cell that does not fit the
    schema is null.  Without a schema, one pass over the cells finds which of whole numbers, numbers
    and truth values hold for all of a column.  The columns ``beside`` come first and stay as they are.
    """
    df = null_literals(df)
    if schema:
        wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return df.select(*beside, *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])
    names = [c for c in df.columns if c not in beside]
    misfits = [
        F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), 1)).alias(f"{i}_{kind}")
        for i, c in enumerate(names)
        for kind in INFERRED
    ]
    filled = [F.count(F.col(c)).alias(f"{i}_filled") for i, c in enumerate(names)]
    found = df.agg(*filled, *misfits).first()
    kinds = {}
    for i, c in enumerate(names):
        fits = [kind for kind in INFERRED if found[f"{i}_filled"] and not found[f"{i}_{kind}"]]
        if fits:
            kinds[c] = F.col(c).cast(fits[0])
    return df.withColumns(kinds) if kinds else df


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    columns: Iterable[str] | None = None,
    encoding: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV rows; null literals are null; ``columns`` must be present.

    Without ``encoding`` each file is UTF-8 if all its lines are, else GB18030.  All files are read as
    text and typed together.  Here a file with quoted line breaks is read by one task; ``csv_splits``
    has a reader for large ones.
    """

    def read(paths: list[str], charset: str) -> DataFrame:
        options = {"header": True, "multiLine": multi_line, "escape": '"', "encoding": charset}
        reader = spark.read.options(**options)
        if schema:
            wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            reader = reader.schema(StructType([StructField(f.name, StringType()) for f in wanted]))
        return reader.csv(paths)

    files = {True: [path], False: []} if encoding else files_by_encoding(spark, path)
    if (files[False] or encoding not in (None, "UTF-8")) and spark.conf.get(CHARSETS) != "true":
        raise ValueError(f"set {CHARSETS} to true: Spark reads {encoding or LEGACY} only then")
    if not files[False]:
        df = read([path], encoding or "UTF-8")
    else:
        df = read(files[False], LEGACY)
        if files[True]:
            df = read(files[True], "UTF-8").unionByName(df)
    df = typed(df, schema)
    return require_columns(df, columns) if columns else df
