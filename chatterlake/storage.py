"""Tables between two steps: written to the shared folder and read back, which cuts the lineage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from chatterlake.session import shared_folder

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Folder:
    """A table of this application in the folder that all executors share."""

    spark: SparkSession
    path: str
    schema: StructType | None = None

    @classmethod
    def new(cls, spark: SparkSession, name: str) -> Folder:
        """A folder of its own, which tasks may fill with files."""
        return cls(spark, f"{shared_folder(spark)}/steps-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")

    @classmethod
    def write(cls, df: DataFrame, name: str, compression: str = "zstd") -> Folder:
        """The shuffle files of the write go when it ends."""
        spark = df.sparkSession
        path = cls.new(spark, name).path
        before = spark.conf.get(_DROP_SHUFFLES)
        spark.conf.set(_DROP_SHUFFLES, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            spark.conf.set(_DROP_SHUFFLES, before)
        return cls(spark, path, df.schema)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the table, once nothing will read it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the folder that all executors share, below one folder per application."""
    return Folder.write(df, name).read()
