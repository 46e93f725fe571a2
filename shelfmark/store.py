"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, on one machine alone, a temporary folder that goes at exit.

    On a cluster executors do not share temporary folders, so an unset folder is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="shelfmark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again.

    This cuts the lineage: after the loss of an executor, later stages reread the table instead of
    repeating what made it. What the writing exchanged is on no disk afterwards: nothing reads it again. The folder
    is removed when the driver ends.
    """
    return _written(df, label)[0]


@contextlib.contextmanager
def lent(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """`written`, for the time of the block alone."""
    table, drop = _written(df, label)
    try:
        yield table
    finally:
        drop()


def _written(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfmark/{label}-{uuid.uuid4().hex}"
    drop = _drop_at_exit(spark, path)
    with _exchanges_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), drop


@contextlib.contextmanager
def _exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """A write that begins in here has its shuffle files removed as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _drop_at_exit(spark: SparkSession, path: str) -> Callable[[], None]:
    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended already
            pass

    atexit.register(drop)
    return drop
