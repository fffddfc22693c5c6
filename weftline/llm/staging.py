"""Tables that jobs leave for later jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of our own only where that is unset and executors are this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no earlier run has used; it goes when the driver ends, or by :func:`drop`."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


@contextmanager
def setting(spark: SparkSession, **values: str):
    """Session settings for the jobs of a block (double underscores stand for dots)."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: its lineage ends here, and its shuffle files go when the write ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, **{_CLEANUP: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*tables: DataFrame | str) -> None:
    """Delete staged tables (or paths) that no later job reads."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_staged_at", None)
        for at in [x for x in _kept if x[1] == path]:
            _kept.remove(at)
            _delete(*at)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand texts to Python in batches of few rows, since one text may be very long.

    The session keeps the setting, the same for all operators: their results are lazy, and it is read when they run.
    """
    spark.conf.set(_ARROW_ROWS, str(rows))


def tidy(run: Callable, *also: Callable[[], None]) -> Callable:
    """``run`` (batches to batches) that gives memory back when its task ends: Python workers stay, beside whatever stage comes next."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            for f in also:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only where the C library offers it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


@atexit.register
def _at_end() -> None:
    for spark, path in _kept:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before; its shared folder is the cluster's to clear
            return
