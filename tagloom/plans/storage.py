"""Intermediate tables in the folder that all executors share.

Long plans are cut by writing a table and reading it back, not by caching: a written table outlives any
executor, and its lineage is a file scan. The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir`` (or the checkpoint directory already set on the context). Only a
    single-process local session without either gets a temporary folder; a cluster without one is an error,
    because a machine-local folder could not be read by the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        already = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = already.get() if already.isDefined() else None
    if not configured:
        if not _local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tagloom-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


#: Folders of the tables staged so far that nobody dropped, and the applications whose leftovers the program's end removes.
_STAGED: list[str] = []
_SWEPT: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; :func:`workspace` removes it."""
    folder = f"{shared_dir(spark)}/tagloom-{spark.sparkContext.applicationId}"
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        atexit.register(_sweep, spark.sparkContext._jvm, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def _sweep(jvm, folder: str) -> None:
    """Remove all tables of an application when its program ends: a lazy result may read them until then."""
    with suppress(Exception):  # without a JVM nothing can be removed any more
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folders: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a table from :func:`stage` that no later plan reads."""
    _delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, every table that was staged inside: a query's result must have been read or written by then."""
    first = len(_STAGED)
    try:
        yield
    finally:
        _delete(spark, _STAGED[first:])
        del _STAGED[first:]
