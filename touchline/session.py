"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "touchline", master: str | None = None, shuffle_partitions: int | None = None):
    """A session with the settings the operators rely on; a cluster keeps its own master and sizes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir``, or a scratch folder on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        if folder.startswith("file:") and not context.master.startswith("local"):
            raise RuntimeError(f"{folder} is a folder of one machine; set spark.checkpoint.dir to one that all executors share")
        return folder
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Paths of the tables that ``settle`` has written, in order.
SETTLED: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The copy survives the loss of executors, cuts the lineage, and gives the planner true sizes,
    so that a later join is broadcast only when the written side is really small. It is removed
    when the session ends, or earlier by ``remove_settled``.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _file_system(df.sparkSession, path)
    files.deleteOnExit(place)
    SETTLED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows_a_file(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables that are settled inside have at most ``rows`` rows in a file. For rows that hold many rows as bytes: a reader
    unpacks thousands of values of a file at once, whatever their length."""
    name = "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def remove_settled(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        place, files = _file_system(spark, path)
        files.delete(place, True)
        SETTLED.remove(path)
