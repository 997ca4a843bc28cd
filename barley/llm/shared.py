"""Intermediate tables in the folder that all executors share, and checks of a table's shape."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local master gets a temporary folder; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, is computed once.

    The folder is the cluster's scratch space; its owner clears what ``drop`` has not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stashed = path
    return table


#: Arrow batches on their way to Python workers, so that long texts and large sets do not fill workers and the buffers of their executor
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Batches of a bounded size for the jobs that run inside; the session's own settings hold again afterwards."""
    before = {key: spark.conf.get(key) for key in BATCHES}
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def drop(*tables: DataFrame) -> None:
    """Delete stashed tables of which nothing will be read again: all that was made from them is written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stashed)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """At the end of a pass over large texts, return what a worker no longer uses to the machine: workers live on beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):   # elsewhere than on Linux the allocator has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """What comes out of an exchange, made from at most ``rows`` rows, in one task for ``each`` of them, where the session would take more tasks. Rounds over small tables
    otherwise cost as many tasks and files as large ones. Larger tables stay as they are dealt."""
    wanted = max(1, -(-rows // each))
    return df.coalesce(wanted) if wanted < tasks(df.sparkSession) else df


class Carried:
    """Columns that come through an operator beside a text, so that its verdict stays on the row. Without any, the id alone does."""

    def __init__(self, df: DataFrame, id_column: str, text_column: str, carry: list[str] | tuple[str, ...]):
        self.id_column, self.text_column, self.names = id_column, text_column, [c for c in df.columns if c in set(carry)]
        beside = [c for c in self.names if c != text_column]
        row = [F.struct(*[F.col(f"`{c}`") for c in beside]).alias("row")] if beside else []
        self.rows = df.select(F.col(f"`{id_column}`").alias("id"), *row, F.col(f"`{text_column}`").cast("string").alias("text"))
        self.with_text = text_column in self.names

    def schema(self, rows: DataFrame, more: str) -> str:
        """Of what a pass over ``rows`` gives: all of them but the text, unless that is carried."""
        own = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text" or self.with_text]
        return ", ".join([*own, more])

    def columns(self) -> list:
        if not self.names:
            return [F.col("id").alias(self.id_column)]
        return [F.col("text").alias(c) if c == self.text_column else F.col(f"row.`{c}`") for c in self.names]
