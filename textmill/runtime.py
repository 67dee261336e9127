"""Shared plumbing: the shared folder, cutting lineage, spreading small inputs."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has written to shared folders, outside of any scope.
_WRITTEN: list[str] = []
_SCOPE: ContextVar[list[str] | None] = ContextVar("textmill_scope", default=None)
#: Inputs under so many bytes a core are rebalanced.
SMALL_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``, and it is an error if it
    does not. A local session without the setting gets a temporary folder.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="textmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        given = "file://" + own
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def write_table(df: DataFrame, tag: str) -> str:
    """Write ``df`` to the shared folder as Parquet; the path of the table.

    It stays until ``discard_table``, the end of its ``scope``, or ``discard_tables``.
    """
    path = f"{shared_dir(df.sparkSession)}/textmill-{tag}-{uuid.uuid4().hex}"
    held = _SCOPE.get()
    (_WRITTEN if held is None else held).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage like ``checkpoint()`` and survives the loss of executors,
    but stays columnar, so later stages read only the columns they use. The
    table stays until its ``scope`` ends, or until ``discard_tables``.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, tag))


def discard_table(spark: SparkSession, path: str) -> None:
    """Delete one table of ``write_table`` that nothing reads any more."""
    for held in (_WRITTEN, _SCOPE.get() or []):
        if path in held:
            held.remove(path)
    _delete(spark, [path])


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of what is no longer referred to.

    It does so when the driver happens to collect its garbage, which may be after
    a long work of several rounds has filled the disk.
    """
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, paths: list[str]) -> int:
    n = 0
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """The tables written inside are deleted at the end, and no others.

    Results must have been written or collected by then. Scopes nest; those of
    other threads are their own.
    """
    held: list[str] = []
    token = _SCOPE.set(held)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _delete(spark, held)


def discard_tables(spark: SparkSession) -> int:
    """Delete what ``materialize`` has written outside of scopes, when no result needs it any more."""
    return _delete(spark, _WRITTEN)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a small input over the cores of the session.

    One small file would run a Python stage on one core. How large an input is
    comes from the statistics of its plan, which runs nothing. Large inputs
    have more splits than cores and pass unchanged, without a shuffle, as do
    streams.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES else df
