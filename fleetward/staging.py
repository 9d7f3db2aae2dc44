"""Tables written once and read again, where a plan would repeat its parts over and over."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes, counted before the join is planned.
BROADCAST_BYTES = 48 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    One of our own is a folder of this machine, so a session on more machines must name one.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("fleetward.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="fleetward-")
        spark.conf.set("fleetward.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of what was staged within the innermost released() of this thread or task; None outside of any.
_SCOPE: ContextVar[list[str] | None] = ContextVar("fleetward_staged", default=None)


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which the innermost released() removes."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, what: str) -> DataFrame:
    """df from the shared folder: its lineage ends there, and it outlives the executors that made it.

    The table stays until released().
    """
    return written(df, new_path(df.sparkSession, what))


def measured(df: DataFrame, what: str, row_bytes: int) -> DataFrame:
    """df staged, with a broadcast hint if its rows, of so many bytes each in memory, are few enough; else it is joined by shuffle."""
    own = staged(df, what)
    return F.broadcast(own) if own.count() * row_bytes <= BROADCAST_BYTES else own


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, what was staged within: for code that has written its own result by then.

    Each block has a list of its own, and threads do not see each other's.
    """
    own: list[str] = []
    outer = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        for path in own:
            remove(spark, path)
