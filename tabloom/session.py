"""Spark session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app_name: str = "tabloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on; extra settings come as keyword arguments with
    ``__`` in place of dots (``spark__sql__shuffle__partitions="2000"``)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for durable intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder: on a cluster that folder would vanish with its machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
        configured = tempfile.mkdtemp(prefix="tabloom-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


_written: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the durable tables that are written inside, at the end.

    A result that still reads one of them has to be stored before.
    """
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            _delete(spark, path)
        del _written[before:]


def _delete(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing = threading.Lock()
_frees = 0
_freed_before: str | None = None


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete shuffle files at the end of each query that is made inside.

    Spark keeps them otherwise until the driver happens to collect its garbage. Several threads may be inside.
    """
    global _frees, _freed_before
    with _freeing:
        if not _frees:
            _freed_before = spark.conf.get(_FREED, None)
            spark.conf.set(_FREED, "true")
        _frees += 1
    try:
        yield
    finally:
        with _freeing:
            _frees -= 1
            if not _frees:
                spark.conf.unset(_FREED) if _freed_before is None else spark.conf.set(_FREED, _freed_before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    The result survives lost executors, has no lineage, and fixes values that depend on how rows
    were partitioned. Parquet keeps column pruning for the readers of the table.
    """
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tabloom-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def folded(steps: Iterable[Callable[[DataFrame | None], DataFrame]], spark: SparkSession) -> DataFrame:
    """Steps that each take the table before (the first None) and are ``durable``; only the last table stays."""
    table, path = None, None
    for step in steps:
        last = path
        table, path = _stored(step(table))
        if last:
            _delete(spark, last)
            _written.remove(last)
    return table
