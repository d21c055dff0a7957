"""Shared-folder helpers: all intermediate files live where every executor can see them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: What a Python worker keeps from task to task; tasks that end in release() drop it.
kept: dict = {}


def base_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a URI; a temporary folder where that is unset and the session is local (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="quern-"))
            atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
        base = _own[0]
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return base.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh URI below the shared folder."""
    return f"{base_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back."""
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As written(), with the folder, for dropped() once nothing reads it any more."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(uri: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    f, path = open_fs(uri)
    f.delete_dir(path)


def open_fs(uri: str):
    """(filesystem, path) for a URI, on whatever store the cluster shares (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def release() -> None:
    """Drop what is kept and give freed memory back to the system at the end of a task, so that idle Python workers hold little beside the JVM."""
    kept.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import ctypes.util

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)  # glibc only
    if give:
        give(0)


def make_dir(uri: str) -> str:
    f, path = open_fs(uri)
    f.create_dir(path, recursive=True)
    return uri


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
