"""The folder that driver and executors share, and bytes written to it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where a local session has none (tests, a single machine) a temporary one is
    set; on a cluster a machine's own folder would not be shared, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fieldstone-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Remove stored tables that nothing reads any more."""
    for p in paths:
        at, fs = _file_system(spark, p)
        fs.delete(at, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file written by the driver to any file system that Spark knows."""
    at, fs = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def holds_bytes(spark: SparkSession, path: str) -> bool:
    """Whether a folder has a file that is not empty."""
    at, fs = _file_system(spark, path)
    return fs.getContentSummary(at).getLength() > 0


def read_head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file of any file system that Spark knows."""
    at, fs = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


#: The C library's allocator: few arenas, and large blocks of their own that go back when freed.
_MALLOC = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072"}


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and give freed memory back at once."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in _MALLOC.items():
        env.setdefault(name, value)
