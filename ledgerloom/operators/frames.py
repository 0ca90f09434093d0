"""Cutting lineage in loops: checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a statement at its end, not when the driver next collects garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. The session names it; only where none is set (local mode) is
    one made."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this name in the shared one, for what a job writes and reads again."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written down and read again. A checkpoint would write rows uncompressed and keep the estimated sizes of the plan it cuts off."""
    return staged(df, "cut")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again. In a loop of joins this is better than a checkpoint, which keeps
    the estimated sizes of the plan that it cuts off: they multiply with every join."""
    path = work_dir(df.sparkSession, name)
    with _swept(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    if _made.get() is not None:
        _made.get().append(out)
    return out


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files on the disks of the executors: it is read from Parquet from then on."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before) if before is not None else spark.conf.unset(SWEEP)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, staged; the tables that it staged on the way are deleted."""
    token = _made.set([])
    try:
        out = staged(make(), name)
        inner = _made.get()
    finally:
        _made.reset(token)
    unstage(*[df for df in inner if df is not out])
    if _made.get() is not None:
        _made.get().append(out)
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
