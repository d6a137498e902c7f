"""Table scans and the checks made before a run."""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv


def read_table(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    return spark.read.options(**options).format(form).load(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan in at least as many pieces as there are cores, for work that is heavy per row.

    Only a table of few small files is moved for it; a large one has more pieces than cores and is
    returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that the caller has made."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def create_file(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; false if there is one already, which only one of several callers at once is spared."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        if store.getUri().getScheme() == "file":  # Hadoop's local files are looked up first and made then
            place = jvm.java.io.File(target.toUri().getPath())
            place.getParentFile().mkdirs()
            return place.createNewFile()
        store.create(target, False).close()
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def names_in(spark: SparkSession, folder: str) -> set[str]:
    """The names of what a folder holds, by one listing; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {entry.getPath().getName() for entry in store.listStatus(target)} if store.exists(target) else set()


def earlier_results(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame | None:
    """Output of an earlier run, or None when there is none."""
    return read_table(spark, path, form, **options) if path_exists(spark, path) else None


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The table itself; an error that names them if it lacks some of the columns."""
    if lacking := set(columns).difference(df.columns):
        raise ValueError(f"missing columns {sorted(lacking)}; the table has {df.columns}")
    return df


def null_literal(c: Column | str) -> Column:
    """Null where the text is one of the literals a default CSV read takes for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~c.isin(*fv.NULL_LITERALS), c)


def null_literals(df: DataFrame) -> DataFrame:
    text = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: null_literal(c) for c in text}) if text else df


def preview(df: DataFrame, key: str, n: int = fv.PREVIEW_ROWS) -> DataFrame:
    """The first rows by key; each task keeps n rows, so nothing is sorted as a whole."""
    return df.orderBy(key).limit(n)


def has_rows(df: DataFrame) -> bool:
    """Guard for empty input; stops at the first row found."""
    return not df.isEmpty()


def datasets(**tables: DataFrame) -> DataFrame:
    """Several inputs as one table with a ``dataset`` column, so one run serves them all."""
    named = [df.select(F.lit(name).alias("dataset"), "*") for name, df in tables.items()]
    whole = named[0]
    for df in named[1:]:
        whole = whole.unionByName(df)
    return whole
