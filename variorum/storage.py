"""Tables written in the shared folder of the cluster, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local folder, which only a local master may use."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"variorum-shared-{os.getpid()}")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is there goes when the driver ends, or with clean()."""
    path = f"{shared_folder(spark)}/variorum/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _writer(df: DataFrame, codec: str | None) -> DataFrameWriter:
    writer = df.write.mode("errorifexists")
    return writer.option("compression", codec) if codec else writer


def put(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> tuple[DataFrame, str]:
    """df, written once as Parquet in the shared folder and read again, and its path there."""
    path = new_folder(df.sparkSession, name)
    writer = _writer(df, codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again."""
    return put(df, name, partition_by, codec)[0]


@contextlib.contextmanager
def freed() -> Iterator[None]:
    """Tables that are written inside go at the end."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            delete(*_written.pop())


def put_from(spark: SparkSession, name: str, make: Callable[[], DataFrame], codec: str | None = None) -> tuple[DataFrame, str]:
    """What make gives, written and read again, and its path; the tables that were written to make it go."""
    path = new_folder(spark, name)
    with freed():
        df = make()
        _writer(df, codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def kept_from(spark: SparkSession, name: str, make: Callable[[], DataFrame], codec: str | None = None) -> DataFrame:
    """What make gives, written and read again; the tables that were written to make it go."""
    return put_from(spark, name, make, codec)[0]


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean() -> None:
    """Deletes every table that kept() has written; results not yet read from them are lost."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            delete(spark, path)


def _at_exit() -> None:
    try:
        clean()
    except Exception:  # noqa: BLE001  the JVM may have gone first
        _written.clear()


atexit.register(_at_exit)
