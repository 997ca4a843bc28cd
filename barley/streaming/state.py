"""Tables that a stream carries from batch to batch: a version per batch, each made from the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def path_of(folder: str, name: str, number: int) -> str:
    return f"{folder}/{name}/batch={number}"


class Carried:
    """A named table of a stream. A batch reads the version before its own and writes its own, so that a batch that is run again after a failure leaves
    the same version. Only two versions are kept: what a batch reads does not grow with the age of the stream."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name

    def before(self, spark: SparkSession, number: int) -> DataFrame | None:
        """What the batch before ``number`` left; None for the first one."""
        return None if number == 0 else spark.read.parquet(path_of(self.folder, self.name, number - 1))

    def keep(self, table: DataFrame, number: int) -> None:
        """The version before once more."""
        self.leave(table, number)

    def leave(self, table: DataFrame, number: int) -> DataFrame:
        spark, path = table.sparkSession, path_of(self.folder, self.name, number)
        table.write.mode("overwrite").parquet(path)
        remove(spark, path_of(self.folder, self.name, number - 2))
        return spark.read.schema(table.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; nothing happens if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
