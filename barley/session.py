"""Session settings, and the one place that knows how to cut lineage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "barley", **extra: str) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller's own session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.maxFields", "300")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextlib.contextmanager
def dealt_over(spark: SparkSession, tasks: int):
    """Exchanges that are planned inside take ``tasks`` tasks; the session's own number holds again afterwards."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, tasks)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set, a local master gets a temporary one and a cluster an error: its executors would
    not see a folder of the driver."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    Reliable checkpoints survive the loss of executors; local ones would not.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: with this on, a query's shuffle files go as soon as it has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_apart(df: DataFrame, name: str = "pass") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, for tables as large as the input.

    Parquet takes a fraction of a checkpoint's disk, ``forget`` deletes it when nothing reads it any more, and the shuffle files it came from go
    once it is written. The folder is the cluster's scratch space; its owner clears what ``forget`` has not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.apart = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``write_apart`` from which all that was made is written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.apart)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
